"""The registered graph queries against their SQL in DuckDB."""

import duckdb
import pytest

from graphloom.suite.graphs import star
from graphloom.suite.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    show = lambda row: repr(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in row.items()))
    want = sorted(show(dict(zip(cols, r, strict=True))) for r in cur.fetchall())
    got = sorted(show(r.asDict()) for r in QUERIES[name](spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("part, table, rows", [("optional_match", "customer", 1), ("math", "part", 1), ("multi_type", "lineitem", 2)])
def test_whole_tables(spark, sf, part, table, rows):
    """Each of these has a query that covers every key of its table, in tables
    that are larger than the bounds of g08, g11 and g35."""
    sf = sf.replace("0.001", "0.01")
    n = spark.read.parquet(f"{sf}/{table}.parquet").count() * rows
    out = [QUERIES[name](spark, sf) for name in QUERIES if part in name and "anchored" not in name]
    assert n in [sum(r.n for r in df.collect()) if "kind" in df.columns else df.count() for df in out]


def test_fulltext_gives_all_matches(spark, tmp_path):
    """More matches than the 100000 that g78 once stopped at, some of them in
    one column only, beside a null."""
    sql = "SELECT i AS p_partkey, CASE i % 4 WHEN 0 THEN NULL WHEN 1 THEN 'plum' ELSE 'Dark RED ' || i % 50 END AS p_name, CASE i % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'tin' END AS p_type, 'b' AS p_brand, 1 AS p_size, 1.5::DOUBLE AS p_retailprice FROM range(140000) r(i)"
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = sorted(con.execute(ORACLES["g78_fulltext_standard"]).fetchall())
    assert len(want) == 105000
    got = QUERIES["g78_fulltext_standard"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == want
    call = "CALL db.index.fulltext.queryNodes('words', 'red'%s) YIELD node RETURN node.id AS id"
    find = lambda limit: [r.id for r in star(spark, str(tmp_path)).cypher(call % limit).collect()]
    ranked = [r.id for r in got]
    assert ranked[:100] == find("") and ranked[:7] == find(", 7")
