"""The benchmark tables as property graphs, one layout each."""

from __future__ import annotations

from functools import cache, partial

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from graphloom.api import Graph


def node(label, table, ident, /, **props):
    return {"label": label, "table": table, "node_id": ident, "property_mappings": props}


def edge(rel_type, table, a, z, source, target, edge_id=None, /, **props):
    return {"type": rel_type, "table": table, "from_id": a, "to_id": z, "from_node": source, "to_node": target, "edge_id": edge_id, "property_mappings": props}


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
STAR = {
    "name": "star",
    "graph_schema": {
        "nodes": [
            node("Region", "region", "r_regionkey", id="r_regionkey", name="r_name"),
            node("Nation", "nation", "n_nationkey", id="n_nationkey", name="n_name"),
            node("Customer", "customer", "c_custkey", id="c_custkey", name="c_name", balance="c_acctbal", segment="c_mktsegment", rich="c_acctbal > 5000"),
            node("Supplier", "supplier", "s_suppkey", id="s_suppkey", name="s_name", balance="s_acctbal"),
            node("Part", "part", "p_partkey", id="p_partkey", name="p_name", brand="p_brand", size="p_size", price="p_retailprice", kind="p_type"),
            node("Order", "orders", "o_orderkey", id="o_orderkey", status="o_orderstatus", total="o_totalprice", date="o_orderdate", priority="o_orderpriority"),
            {"label": "User", "table": "events", "node_id": "id", "property_mappings": {}, "from_node_properties": {"id": "user_id"}},
            node("Event", "events", "event_id", id="event_id", ts="ts", kind="event_type", value="value"),
            node("Turn", "conversations", ["conv_id", "turn"], conv="conv_id", turn="turn", role="role"),
            node("Vector", "embeddings", "vec_id", id="vec_id", embedding="embedding", cluster="label"),
            node("Document", "documents", "doc_id", id="doc_id", text="text", lang="lang", source="source"),
        ],
        "edges": [
            edge("IN_REGION", "nation", "n_nationkey", "n_regionkey", "Nation", "Region"),
            edge("LIVES_IN", "customer", "c_custkey", "c_nationkey", "Customer", "Nation"),
            edge("LIVES_IN", "supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation"),
            edge("PLACED", "orders", "o_custkey", "o_orderkey", "Customer", "Order"),
            edge("CONTAINS", "lineitem", "l_orderkey", "l_partkey", "Order", "Part", LINE, quantity="l_quantity", price="l_extendedprice", discount="l_discount", flag="l_returnflag", status="l_linestatus", shipped="l_shipdate", tax="l_tax"),
            edge("SUPPLIED_BY", "lineitem", "l_orderkey", "l_suppkey", "Order", "Supplier", LINE, quantity="l_quantity", flag="l_returnflag"),
            edge("DID", "events", "user_id", "event_id", "User", "Event", "event_id", kind="event_type", value="value"),
            {"polymorphic": True, "table": "events", "from_id": "user_id", "to_id": "event_id", "from_node": "User", "to_node": "Event", "type_column": "event_type", "type_values": ["click", "view", "purchase"], "edge_id": "event_id", "property_mappings": {"value": "value"}},
            edge("NEXT_TURN", "turns", ["conv_id", "turn"], ["conv_id", "next_turn"], "Turn", "Turn"),
            edge("TOP_TRADE", "top_trade", "src", "dst", "Nation", "Nation", items="items"),
        ],
        "vector_indexes": [{"name": "vectors", "label": "Vector", "property": "embedding", "similarity": "cosine"}, {"name": "distances", "label": "Vector", "property": "embedding", "similarity": "euclidean"}],
        "fulltext_indexes": [{"name": "words", "label": "Part", "properties": ["name", "kind"], "analyzer": "standard"}, {"name": "exact", "label": "Part", "properties": ["name"], "analyzer": "exact"}],
    },
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations"]


#: Schemas of tables that were opened before, by application and path.
SCHEMAS: dict = {}


def opened(spark: SparkSession, path: str):
    """A table; its schema is read from the files only once."""
    at = spark.sparkContext.applicationId, path
    if at not in SCHEMAS:
        SCHEMAS[at] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[at]).parquet(path)


def star(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph; a table is opened when a query first needs it."""
    read = cache(lambda name: opened(spark, f"{sf_dir}/{name}.parquet"))

    def turns():
        c = read("conversations").select("conv_id", "turn")
        return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"]).select("conv_id", "turn", (F.col("turn") + 1).alias("next_turn"))

    def top_trade():
        pairs = (
            read("lineitem").select("l_orderkey", "l_suppkey").join(read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
            .join(read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
            .join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
            .groupBy("src", "dst").agg(F.count("*").alias("items"))
        )
        place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("items"), "dst"))
        return pairs.withColumn("r", place).where("r <= 3").select("src", "dst", "items")

    tables = {n: partial(read, n) for n in TABLES} | {"turns": cache(turns), "top_trade": cache(top_trade)}
    return Graph(spark, STAR, tables)


#: The derived tables, for the SQL side.
TURNS_SQL = "turns AS (SELECT a.conv_id, a.turn, b.turn AS next_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
TRADE_SQL = "top_trade AS (SELECT src, dst, items FROM (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS items, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, s_nationkey) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) WHERE r <= 3)"
