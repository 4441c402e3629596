"""Every operator against a brute-force version, an exact round trip or
held-out accuracy; and the edge cases that its docstring defines."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, embed_graph, knn, langid, license, minhash, mixing, quality, slots, substring
from graphloom.llm.queries import tokenizer_path

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, spans string, size long, score double, label int"


def words(t):
    return (t or "").encode().split()


def corpus() -> list[tuple]:
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["straße", "naïve", "日本", "of", "the", "the", "the"]
    out, base = [], [rnd.choices(vocab, k=rnd.choice([3, 20, 60, 150])) for _ in range(40)]
    passage = rnd.choices(vocab, k=30)
    for i in range(120):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        if i % 4 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage
        out.append((i, rnd.choice([" ", "  ", "\n", "\t "]).join(w)))
    out += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "x " * 5000), (205, "x " * 5000), (206, "A B C D E"), (207, "a b c d e"), (208, "\x0b\x0c\x1c\x85\xa0 w"), (3, out[3][1])]
    rnd.shuffle(out)
    return [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), "clash", 1, 0.5, 1) for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), FIELDS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


def find(par, x):
    while par[x] != x:
        x = par[x]
    return x


# ------------------------------------------------------------------ common


def test_word_hashes():
    texts = [b"", b"a b", b" a\tb ", b"b a\n", b"ab"]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, doc, h = common.WordHasher()(data, offsets)
    raw = data.tobytes()
    assert [raw[s:e] for s, e in zip(starts, ends, strict=True)] == [w for t in texts for w in t.split()]
    assert doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    assert h[0] == h[2] == h[5] and h[0] != h[1] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    par = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(par, a), find(par, b)
        par[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(par, x) for x in par if any(a != b and x in (a, b) for a, b in edges)}


# --------------------------------------------------------------- embeddings


def vectors(spark):
    rnd = np.random.default_rng(2)
    rows, centers = [], rnd.normal(size=(12, 8))
    for i in range(400):
        v = centers[i % 12] + rnd.normal(size=8) * (0.02 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v], int(i % 2), "x"))
    rows += [(500, None, 1, "x"), (501, [0.0] * 8, 1, "x"), (502, [float("nan")] * 8, 1, "x"), (503, [float("inf")] * 8, 0, "x"), (504, [None] * 8, 0, "x"), (505, rows[0][1], None, "x"), (506, rows[0][1], 0, "x"), (507, rows[0][1], 0, "x"), (508, [1e300] * 8, 0, "x"), (509, [1.0] * 3, 0, "x"), (510, [], 0, "x"), (7, rows[7][1], 1, "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string").repartition(3)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_embedding_graph(spark, monkeypatch):
    rows, df = vectors(spark)
    unit = {}
    for i, v, label, _ in rows:
        if good(v) and label is not None and any(v):
            x = np.array(v) / max(abs(y) for y in v)
            unit[i] = (label, x / np.linalg.norm(x))
    links, par = defaultdict(int), {i: i for i, *_ in rows}
    for a in unit:
        for b in unit:
            if a != b and unit[a][0] == unit[b][0] and len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.98:
                links[a] += 1
                p, q = find(par, a), find(par, b)
                par[max(p, q)] = min(p, q)
    for shard, block in ((8192, 8192), (60, 8192), (8192, 50)):
        monkeypatch.setattr(embed_graph, "SHARD", shard)
        monkeypatch.setattr(embed_graph, "BLOCK", block)
        out = embed_graph.near_duplicates(df)
        got = out.collect()
        assert len(got) == len(rows)
        found = sum({r.vec_id: r.n_links for r in got}.values())
        assert found >= (0.9 if shard == 60 else 0.999) * sum(links.values())
        assert all(r.n_links <= links[r.vec_id] for r in got)
        if shard != 60:
            assert {r.vec_id: r.component_id for r in got} == {i: find(par, i) for i in par}
            assert embed_graph.recall(df, out, every=2) >= 0.9
    assert embed_graph.near_duplicates(df.limit(0), audit=0.9).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [0.01, 1.0], "a"), (4, [1.0, 0.0], "b"), (None, [1.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    got = embed_graph.near_duplicates(two, audit=0.9).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, True)] * 2 + [(2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (None, 0, None, True)], key=str)


def test_embedding_graph_many_shards(spark, monkeypatch):
    """A label in many shards: every link's ends meet in a shard of each."""
    x = np.random.default_rng(6).normal(size=(600, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(embed_graph, "SHARD", 6)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    nodes = embed_graph.unit_vectors(df).withColumnRenamed("vec_id", "rep").withColumn("n", F.lit(1).cast("long"))
    shards, own = defaultdict(set), {}
    for r in embed_graph.sharded(nodes, least=0.98).collect():
        shards[r.rep].add(r.shard)
        if r.own:
            own[r.rep] = r.shard
    near = np.argwhere((x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)).tolist()
    assert len(set(own.values())) > 60 and len(near) > 500
    assert all(own[a] in shards[b] for a, b in near)
    out = embed_graph.near_duplicates(df)
    assert sum(r.n_links for r in out.collect()) == len(near)
    assert embed_graph.recall(df, out, every=1) == 1.0


def test_top_k(spark, monkeypatch):
    rows, df = vectors(spark)
    ints = {i: [math.floor(64 * x) for x in v] for i, v, *_ in rows if good(v) and i != 508}
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:20]
        want |= {(q, n + 1, i, -t) for n, (t, i) in enumerate(s)}
    for data, ask in ((4096, 2048), (32, 8)):
        monkeypatch.setattr(knn, "DATA_BLOCK", data)
        monkeypatch.setattr(knn, "QUERY_BLOCK", ask)
        assert {tuple(r) for r in knn.top_k(df.where("vec_id <> 508")).collect()} == want
    assert knn.top_k(df.limit(0)).collect() == []
    big = spark.createDataFrame([(0, [3e9, 1.0], 0, ""), (1, [3e9, 2.0], 0, ""), (2, [-3e9, 2.0], 0, "")], "vec_id long, embedding array<double>, label int, rep string")
    assert [(r.vec_id, r.rank) for r in knn.top_k(big).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_top_k_many_lengths(spark, monkeypatch):
    """Vectors of a length without a pivot take part as well."""
    monkeypatch.setattr(knn, "MOST_PIVOTS", 2)
    rows = [(i, [float(i)] * (1 + i % 5)) for i in range(60)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, every=1).collect()
    want = {(i, n + 1, j) for i, v in rows for n, j in enumerate(sorted((j for j, w in rows if j != i and len(w) == len(v)), key=lambda j: (-i * j, j))[:2])}
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == want


def test_pruned_cells(spark, monkeypatch):
    """Far clusters are not sent, and results stay exact."""
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (np.array([90.0, 0.0]) if i % 2 else np.array([-90.0, 5.0])) + rnd.normal(size=2)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(knn, "DATA_BLOCK", 60)
    ints = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = defaultdict(list)
    for r in knn.top_k(df, k=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in range(0, 600, 20):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -t) for n, (t, i) in enumerate(s)]
    # neither half is sent to the other's queries
    ints_df = knn.integers(df).cache()
    pivots = knn.chosen_pivots(ints_df)
    cells = knn.query_cells(ints_df.where("vec_id % 20 = 0"), pivots).groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    far = {2: np.zeros(len(pivots[2]))}
    for c in cells:
        far[2][c.cell] = c.far
    monkeypatch.setattr(knn, "QUERY_BLOCK", 6)
    groups, n = knn.cell_groups(cells)
    sent = knn.needed_by(ints_df, pivots, far, knn.sure_scores(ints_df, pivots, far, 5), groups).agg(F.sum(F.size("groups"))).first()[0]
    assert n > 4 and sent < 0.5 * 600 * n


# ----------------------------------------------------------------- dedup


def test_substring(spark, docs, empty, monkeypatch):
    rows = corpus()
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, t, *_ in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                keep[k : k + 13] = [False] * 13
        want[i] = (len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep, strict=True) if y)).hexdigest())
    for docs_per_route, windows, hot, held in ((200, 20_000, 10_000, 8_000_000), (2, 5, 10_000, 100), (2, 5, 3, 8_000_000)):
        monkeypatch.setattr(substring, "ROUTE_DOCS", docs_per_route)
        monkeypatch.setattr(substring, "HOT_DOCS", hot)
        monkeypatch.setattr(substring, "HELD_BYTES", held)
        monkeypatch.setattr(substring, "HELD_ANCHORS", held // 100)
        monkeypatch.setattr(substring, "AUTOMATON", windows)
        got = substring.without_repeats(docs).collect()
        assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(v[1] for v in want.values()) > 100
    nulls = spark.createDataFrame([(None, rows[0][1]), (None, rows[0][1]), (1, None), (2, rows[0][1])], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in substring.without_repeats(nulls).collect()} == {(None, 0), (1, 0), (2, 0)}
    assert substring.without_repeats(empty).collect() == []
    # rows of one doc_id with different texts lose each their own words
    w = [f"k{i}" for i in range(40)]
    two = spark.createDataFrame([(1, " ".join(w), 7), (2, " ".join(["x", *w[:20]]), 8), (2, " ".join(w[20:] + ["y", "z"]), None), (2, "a  b", 9), (None, None, 1)], "doc_id long, text string, n_removed int")
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring.without_repeats(two).collect()) == [("1", 40, 0), ("2", 2, 0), ("2", 21, 20), ("2", 22, 20), ("None", 0, 0)]
    kept = substring.without_repeats(two, as_text=True)
    assert kept.columns == [*two.columns, "__n_words", "__n_removed"]
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in kept.collect() if r.text != " ".join(w)) == [("2", "a  b", 9), ("2", "x", 8), ("2", "y z", None), ("None", None, 1)]


def shingle_truth(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    par = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    p, q = find(par, a), find(par, b)
                    par[max(p, q)] = min(p, q)
    return {i: (len(s), find(par, i)) for i, s in sets.items()}


def test_minhash(docs, empty, monkeypatch):
    rows = corpus()
    want = shingle_truth(rows, 4, 80)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_large_buckets(spark, monkeypatch):
    """Documents that share most of a passage but are not similar."""
    rnd = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"d{i // 2}-{j}" for j in range(20)]
        rows.append((i, " ".join(passage + own + ([f"z{i}"] if i % 2 else []))))
    rnd.shuffle(rows)
    want = shingle_truth(rows, 4, 80)
    for block in (1024, 20, 4):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in want.items()}


def test_minhash_few_shared_half_keys(spark, monkeypatch):
    """Similar pairs that share only two or three half keys, in buckets that
    others of less similarity make large."""
    rows = []
    for g in (25, 45, 90, 164, 418, 439):
        rnd = random.Random(g)
        base = [f"g{g}w{i}" for i in range(90)]
        sets = [rnd.sample(base, 75) + [f"g{g}z{n}-{j}" for j in range(10)] for n in range(12)]
        sets += [base + [f"g{g}{x}{j}" for j in range(11)] for x in "xy"]
        rows += [(g * 100 + n, " ".join(s)) for n, s in enumerate(sets)]
    want = {i: c for i, (_, c) in shingle_truth(rows, 1, 80).items()}
    assert sum(i != c for i, c in want.items()) == 6
    for block in (4096, 5):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_minhash_hot_bucket(spark, monkeypatch):
    """Pairs of similarity 0.80 to 0.85 among many documents of one template,
    which fall into the same buckets and are mostly not similar, beside a group
    of near copies."""
    rnd = random.Random(12)
    base, rows, planted = [f"s{i}" for i in range(200)], [], []
    for i in range(150):
        own = [x if rnd.random() < 0.7 else f"t{i}-{j}" for j, x in enumerate(base)]
        rows.append((i, " ".join(own)))
        if i % 5 == 0:
            for j in rnd.sample(range(len(own)), 19):
                own[j] = f"u{i}-{j}"
            rows.append((1000 + i, " ".join(own)))
            planted.append((i, 1000 + i))
    rows += [(2000 + i, " ".join([*base[:150], f"v{i}"])) for i in range(60)]
    want = {i: c for i, (_, c) in shingle_truth(rows, 1, 80).items()}
    assert all(want[a] == want[b] for a, b in planted)
    for block in (1024, 30):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_minhash_odd_ids(spark):
    """Null doc_ids, one doc_id with two texts, and its repeated rows."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, one), (None, two), (5, one), (5, two), (5, one), (6, one + " c"), (7, two + " c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True)] * 2 + [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False)], key=str)


# ------------------------------------------------------- language, licenses


def test_langid(spark, empty):
    rnd = random.Random(1)
    sounds = {"en": ["th", "ing", "er", "and"], "de": ["sch", "ung", "ä", "ein"], "fr": ["eau", "oi", "é", "ez"]}
    rows = [(i, " ".join("".join(rnd.choices(sounds[x], k=3)) for _ in range(rnd.randint(1, 30))), x) for i, x in enumerate(rnd.choices(list(sounds), k=300))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !", "de"), (903, "eauoiez " * 20000, None), (904, "x", None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [(by[i].lang_pred, x) for i, t, x in rows if i < 300 and by[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert by[903].lang_pred == "fr" and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_langid_is_exact():
    """Bins and sums against one gram at a time."""
    texts = ["", "ab", "abcab", "ü日本x"]
    total = defaultdict(int)
    for bins, first, last in langid.text_grams(texts, 12):
        for t, (a, b) in enumerate(zip(first, last, strict=True)):
            for x in bins[a:b].tolist():
                total[t, x] += 1
    alone = defaultdict(int)
    for t, text in enumerate(texts):
        for bins, first, last in langid.text_grams([text], 12):
            for x in bins[first[0] : last[0]].tolist():
                alone[t, x] += 1
    assert total == alone and sum(alone.values()) == sum(max(len(t) - n + 1, 0) for t in texts for n in range(1, 5))


def test_license(spark, empty):
    texts = ["CC BY cc-by\nAll rights. Reserved all", "gnu General\nPublic License; general public license", None, "", "Released under the MIT License.", "x " * 500 + "licensed under the Apache License, Version 2.0 " + "y " * 500, "日本cc by", "cc by cc by", "Permission is hereby granted, free of charge, to any person obtaining copies of software"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in license.scan_documents(df).collect()}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for p, label in license.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in hits]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        best = set()
        for line in low.split("\n"):
            own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)
            for k in range(0, max(len(own) - license.BLOCK + license.STRIDE, 1), license.STRIDE) if len(own) > license.BLOCK else (0,):
                block = set(own[k : k + license.BLOCK])
                best |= {n for n, x in license.TEMPLATES.items() if 10 * len(block & set(x.split())) >= 8 * len(set(x.split()))}
        assert set(filter(None, r.labels.split(","))) == best | {x for _, x in hits}
    assert "mit" in got[4].labels and "apache-2.0" in got[5].labels and "mit-grant" in got[8].labels
    assert license.scan_documents(empty).collect() == []


def test_license_wrapped(spark):
    """Notices as they stand in license files, wrapped."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    gpl = " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation"
    long = "a b c\n" * 50
    texts = [bsd, gpl, long + bsd.replace(" ", "\n") + long, "Redistribution and use in\nsource"]
    got = {r.doc_id: r for r in license.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(4)] == ["bsd", "gpl,gpl-notice", "bsd", ""]
    assert got[0].score == 1.0


# ------------------------------------------------------------- mix and rank


def test_mixing(docs, empty):
    rows = corpus()
    got = mixing.mix_report(docs).collect()
    source = {r[0]: r[3] for r in rows}
    size = defaultdict(int)
    for i, t, _, s, *_ in rows:
        size[s] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    total, free, caps = sum(size.values()), set(names), {s: 3 * n for s, n in size.items()}
    while True:
        level = (total - sum(caps[s] for s in names if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > caps[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else caps[s] for s in names}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 12 for s in names if s != source[204])
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()))
    again = mixing.resampled(docs)
    assert again.columns == docs.columns and again.where("doc_id = 10").count() == next(r.copies for r in got if r.doc_id == 10)
    assert mixing.mix_report(empty).collect() == []


def test_resampled_rows_of_one_key(spark):
    """Rows without doc_id, of one source and size, share the key's copies."""
    rows = [(None, f"a{i} b c d", s) for s, n in (("p", 90), ("q", 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = sum(r.copies for r in mixing.mix_report(df).collect())
    out = mixing.resampled(df).collect()
    assert len(out) == want and abs(want - 120) <= 4
    assert 30 < sum(r.source == "p" for r in out) < 60
    assert set(out) <= set(df.collect())


def test_quality(spark, empty):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        bad = rnd.random() < 0.3
        w = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(rnd.randint(1, 80))]
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        labels.append((i, int(not bad), 0))
    rows += [(900, None), (901, ""), (902, "x" * 300_000), (None, "a")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame([*labels, (0, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert quality.quality_scores(empty, marks).collect() == []
    assert {round(r.score, 6) for r in quality.quality_scores(docs, marks.limit(0)).collect()} == {0.5}
    assert quality.accepted(docs, marks).columns == docs.columns


def test_license_whole_texts(spark):
    """Whole license texts against brute force over all blocks, with words put
    in and left out, and whatever stands around them."""
    rnd = random.Random(4)
    texts = []
    for name, t in license.TEMPLATES.items():
        w = t.split()
        for drop, add in ((0.0, 0), (0.1, 3), (0.35, 0)):
            own = [x for x in w if rnd.random() >= drop]
            for _ in range(add):
                own.insert(rnd.randrange(len(own) + 1), "zebra")
            around = [f"q{rnd.randrange(999)}" for _ in range(rnd.choice([0, 90, 400]))]
            said = around + own + around
            texts.append("".join(x + rnd.choice([" ", " ", "\n", ", "]) for x in said).title() if rnd.random() < 0.5 else " ".join(said))
    df = spark.createDataFrame([(None if i == 0 else i % 40, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    found = license.scan_documents(df)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.labels) for r in found.collect())
    want = []
    for n, t in enumerate(texts):
        lines = [x for line in t.lower().split("\n") if (x := re.findall(r"[a-z0-9]+", line))]
        words_, best = [w for x in lines for w in x], set()
        for name, said in license.TEMPLATES.items():
            own, size = set(said.split()), license.BLOCK
            while len(said.split()) > size - size * license.STRIDE // license.BLOCK:
                size *= 2
            step = size * license.STRIDE // license.BLOCK
            for w in [words_, *(lines if size == license.BLOCK else [])]:
                for k in range(0, max(len(w) - size + step, 1), step) if len(w) > size else (0,):
                    if len(own & set(w[k : k + size])) >= 0.8 * len(own) - 1e-9:
                        best.add(name)
        flat = f" {' '.join(words_)} "
        best |= {label for p, label in license.PHRASES.items() if f" {p} " in flat}
        want.append((n != 0, n % 40 if n else 0, ",".join(sorted(best))))
    assert got == sorted(want)
    assert {"mit-text", "bsd-2-clause-text", "gpl-header", "isc-text", "zlib-text"} <= {x for _, _, ls in want for x in ls.split(",")}
    table = spark.createDataFrame([("own", "Some words, of our OWN license")], "name string, text string")
    assert [r.labels for r in license.scan_documents(spark.createDataFrame([(1, "x\nsome words of our own license")], "doc_id long, text string"), table).collect()] == ["own"]


def test_langid_scores(spark):
    """Scores against counts of one n-gram at a time; hot languages and columns
    of clashing names."""
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choices("abcdé ", k=rnd.randint(1, 40))), "xyy"[i % 3]) for i in range(60)] + [(None, "ab", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(9)).repartition(6)
    langs, bits, logs, prior = langid.train(df)

    def bins(t):
        t = t.lower()
        for n in range(1, langid.LONGEST + 1):
            for i in range(len(t) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x9E3779B97F4A7C15 + ord(t[i + k]) + k + 1) % 2**64
                yield int(common.mix(np.array([h], dtype=np.uint64))[0] >> np.uint64(64 - bits))

    counts, docs = {x: np.full(1 << bits, 0.5) for x in "xy"}, dict.fromkeys("xy", 0)
    for i, t, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            docs[lang] += 1
            for b in bins(t):
                counts[lang][b] += 1
    assert langs == ["x", "y"] and np.allclose(prior, np.log(np.array(list(docs.values())) / sum(docs.values())))
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, t, _ in rows:
        if t.strip():
            s = np.array([np.log(docs[x] / sum(docs.values())) + sum(np.log(counts[x][b] / counts[x].sum()) for b in bins(t)) for x in "xy"])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            assert got[i].lang_pred == "xy"[int(s.argmax())] and got[i].score == pytest.approx(p.max(), abs=1e-4)
    with pytest.raises(ValueError):
        langid.train(spark.range(9).selectExpr("id AS doc_id", "'a' AS text", "cast(id as string) AS lang"), bits=24)


def test_top_k_odd_ids_and_lengths(spark):
    """300 lengths, and rows of one vec_id, which count once."""
    rows = [(i, [float((i * 7 + j) % 11 - 5) for j in range(1 + i % 300)]) for i in range(600)] + [(0, [9.0]), (20, None), (None, [1.0])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")), k=3).collect()
    ints = {}
    for i, v in rows:
        if i is not None and v is not None:
            ints[i] = min(ints.get(i, v), v)
    want = set()
    for q in (i for i in ints if i % 20 == 0):
        s = sorted((-sum(math.floor(64 * a) * math.floor(64 * b) for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:3]
        want |= {(q, n + 1, i, -t) for n, (t, i) in enumerate(s)}
    assert {tuple(r) for r in got} == want


def test_quality_column(spark):
    """The compiled column, and one tree, against a plain version."""
    rnd = np.random.default_rng(5)
    x, y = rnd.normal(size=(200, len(quality.STATS))), (rnd.random(200) < 0.5).astype(float)
    y[x[:, 2] > 0.3] = 1
    model = quality.learn_rules(x, y)
    df = spark.createDataFrame([(i, tuple(map(float, row))) for i, row in enumerate(x)], f"i long, {quality.HELD} struct<{', '.join(f'{s}:double' for s in quality.STATS)}>")
    got = {r.i: r.s for r in df.select("i", quality.score_column(model).alias("s")).collect()}
    for i, row in enumerate(x):
        total = model[0] + sum(w for w, rule in model[1] if all((row[f] > cut) == above for f, cut, above in rule))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)))
    assert model[1] and np.mean([(got[i] > 0.5) == (y[i] > 0.5) for i in range(200)]) > 0.7


# --------------------------------------------------------------- tokens


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    odd = ["<|endoftext|>", "<|startoftext|>x", "Don't WE'LL İSTANBUL ΣΑΣ ﬁ ½ ١٢ áᰀ\x1c\x85\xa0b", "é" * 300, "日本語" * 50, "‍\U0001f468", "<|endof", "'s's'", "a<|endoftext|>b"]
    enc = bpe.Encoder(bpe.tokenizer_spec(tokenizer_path()))
    rnd = random.Random(6)
    alphabet = list("abcdeABé'sS lL\n\t.,!?<|>Σσ٣½日́ ") + ["<|endoftext|>", "'ll", "the"]
    texts = odd + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 90))) for _ in range(300)]
    for t, ids in zip(texts, enc.encode_many(texts), strict=True):
        assert ids == own.encode(t, add_special_tokens=False).ids
        assert enc.decode(ids) == own.decode(ids, skip_special_tokens=False)
        assert enc.merge([enc.inner[b] for b in t.encode()[:20]]) == enc.merge([enc.inner[b] for b in t.encode()[:20]])
    got = {r.doc_id: r for r in bpe.token_digests(docs, tokenizer_path()).collect()}
    for i, t, *_ in corpus():
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    full = bpe.encode_documents(docs, tokenizer_path())
    assert all(r.decoded == own.decode(r.token_ids, skip_special_tokens=False) for r in full.collect())
    assert {r.doc_id: r.decoded for r in bpe.decode_tokens(full, tokenizer_path()).collect()} == {r.doc_id: r.decoded for r in full.collect()}
    assert bpe.token_digests(empty, tokenizer_path()).collect() == []
    nulls = docs.sparkSession.createDataFrame([(None, "a b", 1), (None, None, 1), (1, "a b", 1)], "doc_id long, text string, n_tokens int")
    assert sorted((str(r.doc_id), r.n_tokens) for r in bpe.token_digests(nulls, tokenizer_path()).collect()) == [("1", 2), ("None", 0), ("None", 2)]


def test_merge_tree_long_words():
    enc = bpe.Encoder(bpe.tokenizer_spec(tokenizer_path()))
    rnd = random.Random(2)
    for n in (2, 3, 9, 64, 65, 66, 400):
        w = "".join(rnd.choices("thinger", k=n))
        ids = [enc.inner[b] for b in w.encode()]
        ids[-1] = enc.final[ord(w[-1])]
        plain = list(ids)
        while True:
            best = min(((enc.merges[a << 20 | b][0], k) for k, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a << 20 | b in enc.merges), default=None)
            if best is None:
                break
            k = best[1]
            plain[k : k + 2] = [enc.merges[plain[k] << 20 | plain[k + 1]][1]]
        assert enc.merge(list(ids)) == plain == enc.merge_many([w.encode()])[0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel(n):
    f = slots.Feistel(n, 99)
    x = f.slots(np.arange(n))
    assert sorted(x.tolist()) == list(range(n)) and f.numbers(x).tolist() == list(range(n))
    if n > 100:
        assert x.tolist() != slots.Feistel(n, 100).slots(np.arange(n)).tolist()


def test_slots(spark, docs, empty, tmp_path):
    """Exact round trips: from the shards back to the ids, and to the texts."""
    import public_tokenizers
    import tiktoken

    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = slots.Vocabulary.of(slots.vocabulary_bytes(vocabulary), pattern)
    assert isinstance(own.own, tiktoken.Encoding) and own.end == 50256
    path, stride = f"file://{tmp_path}/out", 128
    odd = [(None, None), (None, "no id"), (300, "<|endoftext|> \u65e5\u672c\u8a9e \U0001f468"), (301, None)]
    corpus_and_odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("ids", F.lit("clash")).withColumn("slot", F.lit(1))
    layout, manifest = slots.materialise(slots.token_ids(corpus_and_odd, vocabulary, pattern), path, own.end, length=64, per_shard=100)
    # the passes after the first must not depend on how files are split
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    by_slot = lambda r: (r.slot, r.place)
    rows = sorted(manifest.collect(), key=by_slot)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert sorted(manifest.collect(), key=by_slot) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted({r.slot for r in rows}) == list(range(layout["n"])) and layout["stride"] == stride + 1
    read = slots.read_slots(spark, path, 0, layout["n"])
    assert len(read) == layout["n"] and all(len(x) == stride for x in read)
    piece = lambda r: read[r.slot][2 * r.place : 2 * (r.place + r.n_tokens)]
    assert all(zlib.crc32(piece(r)) == r.crc32 and r.shard == r.slot // 100 and r.byte_offset == r.slot % 100 * (stride + 1) + 2 * r.place for r in rows)
    # every id of every sequence belongs to one piece, but for the last of a task
    filled = defaultdict(int)
    for r in rows:
        assert r.place == filled[r.slot]
        filled[r.slot] += r.n_tokens
    assert sum(n < 64 for n in filled.values()) <= corpus_and_odd.rdd.getNumPartitions()
    assert slots.read_slots(spark, path, 95, 30) == read[95:125]
    whole = defaultdict(list)
    for r in rows:
        whole[r.doc_id].append((r.chunk, piece(r)))
    texts = defaultdict(list)
    for i, t in [r[:2] for r in corpus()] + odd:
        texts[i].append(t or "")
    for i, some in texts.items():
        if len(some) == 1:
            ids = np.frombuffer(b"".join(x for _, x in sorted(whole[i])), "<u2")
            assert ids[-1] == own.end and own.own.decode(ids[:-1].tolist()) == some[0]
        else:
            assert len(whole[i]) >= len(some)
    assert slots.materialise(slots.token_ids(empty, vocabulary, pattern), f"{path}2", own.end)[1].collect() == []
    packed = slots.packed_ids(spark.createDataFrame([(1, [1, 70000]), (2, None)], "doc_id long, token_ids array<int>"), 4)
    assert {r.doc_id: bytes(r.ids) for r in packed.collect()} == {1: np.array([1, 70000], "<u4").tobytes(), 2: b""}
    _, four = slots.materialise(packed, f"{path}3", 99999, width=4, length=2, per_shard=2)
    assert sorted((r.doc_id, r.n_tokens) for r in four.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens")).collect()) == [(1, 3), (2, 1)]


def test_slots_missing(spark):
    """A shard that lacks a slot is not written."""
    layout = {"n": 2, "key": 1, "length": 2, "width": 1, "end": 9, "per_shard": 5}
    all_rows = [(0, 0, 2, 1, b"a"), (0, 2, 2, 2, b"b")]
    for some in (all_rows, all_rows[:1], [*all_rows, all_rows[1]]):
        ids = spark.createDataFrame(some, "part int, first long, n long, doc_id long, ids binary")
        out = slots.in_order(slots.shard_blobs(ids, layout, {0: 0}).repartitionById(1, F.col("shard")), layout, {})
        if some is all_rows:
            assert sorted(bytes(r.record) for r in out.collect()) == [b"a\t", b"b\t"]
        else:
            with pytest.raises(Exception, match="does not hold each of its slots"):
                out.collect()
