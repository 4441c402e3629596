"""Operator 7: license scan as an exact set-similarity join.

Templates are license notices and whole license texts, a dict or a table (name,
text) of bounded size that travels with the tasks.  A text block (a line, or
overlapping runs of the words of a longer line or of the whole text, as notices
are often wrapped; the longer the template, the longer the runs) matches a
template if it holds at least `threshold` of the template's distinct words.  The
tokens of all templates are ordered by their frequency over all documents,
rarest first, and a block's tokens likewise; a template's prefix are the tokens
of which a match must hold one; the length filter asks for enough distinct words
in the block, and the positional filter for enough tokens after the first common
one, in the template and in the block.  No match is lost, and only blocks with a
prefix token are looked at.

Base labels are phrases whose words stand consecutively; they are counted at
all places, whatever the blocks.

Edge cases: a null text counts as empty; texts and lines of any length are
read whole; repeated rows give equal rows; a null doc_id is kept; extra
columns do not matter; empty tables give empty results.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_bytes

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license texts and the notices that stand for them.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "cc-by-sa": "licensed under a creative commons attribution sharealike license",
    "cc-by-text": "licensed under a creative commons attribution license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
    "public-domain": "this work is dedicated to the public domain",
    "rights": "copyright all rights reserved",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
}
#: Words of a block of a long line or text, and how far blocks are apart, for
#: templates of up to BLOCK - STRIDE words, which lie whole in some block; for
#: longer ones both are doubled until they do.
BLOCK, STRIDE = 64, 32
#: Bytes of templates that may travel with the tasks.
MOST_BYTES = 16_000_000
#: What separates words becomes a space (a line feed stays), letters go lower.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 10 if c == 10 else 32 for c in range(256))


def lines_of(text: bytes) -> list[list[bytes]]:
    return [own for line in text.translate(WORDS).split(b"\n") if (own := line.split())]


def frequencies(texts: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """In how many documents each template token stands, over all documents."""

    def run(batches):
        found = dict.fromkeys(tokens, 0)
        for b in batches:
            for t in b.column(1):
                for w in tokens.intersection(t.as_py().translate(WORDS).split()):
                    found[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


class Scanner:
    """The join's index: templates as ranks of their tokens, rarest first."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float, phrases: dict[str, str]) -> None:
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        tokens = sorted({w for t in templates.values() for w in t.encode().split()}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(tokens)}
        self.own: dict[str, list[int]] = {}
        self.need: dict[str, int] = {}
        #: for each size of blocks, the templates and places of a prefix token
        self.by_prefix: dict[int, dict[int, list[tuple[str, int]]]] = {}
        for name, words in templates.items():
            said = words.encode().split()
            own = sorted({self.rank[w] for w in said})
            need, block = math.ceil(threshold * len(own) - 1e-9), BLOCK
            while len(said) > block * (BLOCK - STRIDE) // BLOCK:
                block *= 2
            self.own[name], self.need[name] = own, need
            for place, r in enumerate(own[: len(own) - need + 1]):
                self.by_prefix.setdefault(block, {}).setdefault(r, []).append((name, place))
        self.signs = {tokens[r] for at in self.by_prefix.values() for r in at}

    def block(self, words: list[bytes], size: int, best: dict[str, float]) -> None:
        """Templates that the block contains; its tokens are ordered as theirs."""
        known = sorted({r for w in words if (r := self.rank.get(w)) is not None})
        here, held = self.by_prefix[size], set(known)
        for i, r in enumerate(known):
            for name, place in here.get(r, ()):
                own, need = self.own[name], self.need[name]
                # no more can match than are left of the template and the block
                if len(known) < need or min(len(own) - place, len(known) - i) < need or any(x in held for x in own[:place]):
                    continue
                have = 1
                for j in range(place + 1, len(own)):
                    if have + len(own) - j < need:
                        break
                    have += own[j] in held
                if have >= need and have / len(own) > best.get(name, 0):
                    best[name] = have / len(own)

    def blocks_of(self, words: list[bytes], size: int, best: dict[str, float]) -> None:
        """All blocks of the words that hold a prefix token."""
        here, rank, stride = self.by_prefix[size], self.rank, size * STRIDE // BLOCK
        if len(words) <= size:
            starts = {0} if any(rank.get(w) in here for w in words) else set()
        else:
            last = (len(words) - size + stride - 1) // stride
            starts = {k for i, w in enumerate(words) if rank.get(w) in here for k in range(max((i - size) // stride + 1, 0), min(i // stride, last) + 1)}
        for k in starts:
            self.block(words[k * stride : k * stride + size], size, best)

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first and last word, base labels, labels, score."""
        lines = lines_of(text)
        flat = b" ".join([b" ".join(x) for x in lines])
        n = sum(map(len, lines))
        said = b" " + flat + b" "
        places, base = [], set()
        for phrase, label in self.phrases:
            at = said.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = said.find(phrase, at + 1)
        best: dict[str, float] = {}
        whole = [w for line in lines for w in line]
        if not self.signs.isdisjoint(whole):
            for size in self.by_prefix:
                if size == BLOCK and len(lines) > 1:
                    for line in lines:
                        self.blocks_of(line, size, best)
                self.blocks_of(whole, size, best)
        score = 1.0 if base else max(best.values(), default=0.0)
        ends = [said.count(b" ", 0, p) if p else 0 for p in (min(places), max(places))] if places else [None, None]
        return n, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | set(best))), score


def template_table(table: DataFrame) -> dict[str, str]:
    """Templates of a table (name, text), read once and checked for size."""
    size = table.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the templates have {size} bytes, over {MOST_BYTES}")
    return {r["name"]: r["text"].encode().translate(WORDS).decode() for r in table.select("name", "text").collect()}


def scan_documents(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, threshold: float = 0.8, phrases: dict[str, str] | None = None) -> DataFrame:
    templates, phrases = template_table(templates) if isinstance(templates, DataFrame) else templates or TEMPLATES, phrases or PHRASES
    texts = text_bytes(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    scanner = Scanner(templates, frequencies(texts, {w for t in templates.values() for w in t.encode().split()}), threshold, phrases)

    def run(batches):
        for b in batches:
            rows = [scanner.scan(t.as_py()) for t in b.column(1)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
