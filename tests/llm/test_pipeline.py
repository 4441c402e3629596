import hashlib
from collections import Counter

import corpus_pipeline as p

from graphloom.llm.queries import tokenizer_path


def test_pipeline(spark, sf):
    """Each stage on its own input against a plain version of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    frames = [docs]
    for _, stage in p.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
    given, good, once, cut, mix, last = [[r.asDict() for r in f.collect()] for f in frames]
    assert all(set(rows[0]) == set(p.COLUMNS) for rows in (good, once, cut, mix))
    ids = lambda rows: {r["doc_id"] for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = ids(given) - ids(good)
    assert sum(labels.get(i, 0) for i in gone) <= 0.1 * len(given)

    sets = {}
    for r in good:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    par = {i: i for i in sets}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    assert ids(once) == {i for i in par if find(i) == i}

    first, kept = {}, {}
    for r in sorted(once, key=lambda r: r["doc_id"]):
        w = (r["text"] or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), r["doc_id"]) < r["doc_id"]:
                keep[k : k + 13] = [False] * 13
        kept[r["doc_id"]] = r["text"] if all(keep) else b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()
        if not any(keep) and w:
            del kept[r["doc_id"]]
    assert {r["doc_id"]: r["text"] for r in cut} == kept

    copies = Counter(r["doc_id"] for r in mix)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    assert Counter(r["doc_id"] for r in last) == copies
    for r in last:
        found = own.encode(kept[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()


def test_pipeline_odd_rows(spark, sf, tmp_path):
    """Null and empty texts, null and repeated doc_ids, long texts, columns of
    clashing names, and an empty table, through every stage."""
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(6).collect()]
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, prose[0]), (2, prose[1]), (2, prose[1]), (2, prose[2]), (3, None), (4, ""), (None, prose[3]), (None, prose[3]), (None, None), (5, long), (6, prose[0]), (7, prose[4] + " " + prose[5])]
    fields = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, n_removed int, score double, component_id string, __rows int, __row int, __kept int, copies int, size int, key string, spans string, __quality_stats string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[None] * 13) for i, t in rows], fields)
    for given in (docs, docs.limit(0)):
        frames = [given]
        for k, (_, stage) in enumerate(p.STAGES):
            stage(spark, frames[-1], sf).write.parquet(f"{tmp_path}/{given is docs}{k}")
            frames.append(spark.read.parquet(f"{tmp_path}/{given is docs}{k}"))
            assert k == 4 or frames[-1].columns == p.COLUMNS
        if given is not docs:
            assert all(f.count() == 0 for f in frames)
    # every stage on all of the rows
    out = {name: stage(spark, docs, sf).collect() for name, stage in p.STAGES}
    good = Counter((r.doc_id, r.text) for r in out["quality classifier"])
    assert all(good[x] in (0, n) for x, n in Counter(rows).items())
    once = out["near dedup"]
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in once if r.doc_id is not None) == sorted([(1, prose[0][:9]), (2, min(prose[1], prose[2])[:9]), (3, ""), (4, ""), (5, long[:9]), (7, prose[4][:9])])
    assert sum(r.doc_id is None for r in once) == 3
    cut = {(r.doc_id, r.text) for r in out["substring dedup"]}
    assert 6 not in {i for i, _ in cut} and {(None, prose[3]), (None, None), (3, None), (4, "")} <= cut
    mix = Counter(r.doc_id for r in out["mixing"])
    assert mix[3] == mix[4] == 1 and sum(mix.values()) >= len(rows) - 2
    assert len(out["encoding"]) == len(rows) and {r.n_tokens for r in out["encoding"] if r.doc_id in (3, 4)} == {0}


def test_encoding_in_small_batches(spark, sf, monkeypatch):
    """Whole texts go to Python few at a time, and the session's setting stays."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang", "'s' AS source", "3L AS n_chars")
    monkeypatch.setattr(p.bpe, "token_digests", lambda docs, path: docs.mapInArrow(sizes, "n long"))
    got = [r.n for r in p.encoding_stage(spark, docs, sf).collect()]
    assert sum(got) == 3000 and max(got) <= 512
    assert spark.conf.get(key) == before
