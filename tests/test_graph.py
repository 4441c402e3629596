"""Small graphs with known answers, in every table layout."""

import pytest
from pyspark.sql import functions as F

from graphloom import CypherError, Graph

SOCIAL = {
    "name": "social",
    "graph_schema": {
        "nodes": [
            {"label": "User", "table": "users", "node_id": "user_id", "property_mappings": {"id": "user_id", "name": "name", "age": "age", "born": "born", "since": "since"}},
            {"label": "Product", "table": "products", "node_id": "product_id", "property_mappings": {"id": "product_id", "name": "pname", "price": "price"}},
        ],
        "edges": [
            {"type": "FOLLOWS", "table": "follows", "from_id": "a", "to_id": "b", "from_node": "User", "to_node": "User", "property_mappings": {"since": "y"}},
            {"type": "FRIEND", "table": "friends", "from_id": "a", "to_id": "b", "from_node": "User", "to_node": "User"},
            {"type": "BOUGHT", "table": "bought", "from_id": "u", "to_id": "p", "from_node": "User", "to_node": "Product", "property_mappings": {"n": "n"}},
            {"type": "OLDER", "table": "follows", "from_id": "a", "to_id": "b", "from_node": "User", "to_node": "User", "constraints": "from.age > to.age"},
        ],
    },
}


@pytest.fixture(scope="module")
def g(spark):
    people = [(10, "Ivo", 41, "1984-03-09", 1650000000000), (20, "Mara", 19, "2006-11-30", 0), (30, "Tess", 64, None, None), (40, "Noor", 33, "1992-02-29", 1000), (50, "Olaf", 27, "1998-07-04", 86400000), (60, "Pia", 52, "1973-12-31", 2)]
    users = spark.createDataFrame(people, "user_id long, name string, age int, born string, since long").withColumn("born", F.to_date("born"))
    return Graph(spark, SOCIAL, {
        "users": users, "products": spark.createDataFrame([(1, "kayak", 750.0), (2, "paddle", 45.5), (3, "map", 9.0), (4, "tent", 310.0)], "product_id long, pname string, price double"),
        "follows": spark.createDataFrame([(10, 20, 2011), (20, 10, 2012), (20, 30, 2013), (30, 40, 2014), (30, 50, 2015), (50, 20, 2016), (40, 50, 2017), (20, 40, 2018)], "a long, b long, y int"),
        "friends": spark.createDataFrame([(10, 30), (30, 60), (50, 50), (40, 10)], "a long, b long"), "bought": spark.createDataFrame([(20, 1, 1), (20, 3, 4), (40, 2, 2), (50, 3, 1), (50, 4, 1)], "u long, p long, n int"),
    })


def values(g, text, **params):
    return sorted((tuple(r) for r in g.cypher(text, params).collect()), key=repr)


def test_optional_keeps_everyone(g):
    got = values(g, "MATCH (u:User) OPTIONAL MATCH (u)-[:FOLLOWS]->(v:User) RETURN u.name AS n, count(v) AS k")
    assert got == [("Ivo", 1), ("Mara", 3), ("Noor", 1), ("Olaf", 1), ("Pia", 0), ("Tess", 2)]


def test_optional_multi_hop_is_all_or_nothing(g):
    got = values(g, "MATCH (u:User) OPTIONAL MATCH (u)-[:FOLLOWS]->(v:User)-[:BOUGHT]->(p:Product {name: 'map'}) RETURN u.id AS u, v.id AS v, p.id AS p")
    assert got == [(10, 20, 3), (20, None, None), (30, 50, 3), (40, 50, 3), (50, 20, 3), (60, None, None)]


def test_trails(g):
    # 10-20, 10-20-10, 10-20-30, 10-20-40, 10-20-30-40, 10-20-30-50, 10-20-40-50
    assert values(g, "MATCH (a:User {name: 'Ivo'})-[:FOLLOWS*1..3]->(b:User) RETURN b.id AS b, count(*) AS n") == [(10, 1), (20, 1), (30, 1), (40, 2), (50, 2)]


def test_path_functions(g):
    got = values(g, "MATCH p = (a:User {id: 10})-[:FOLLOWS*2]->(b:User) RETURN [n IN nodes(p) | n.__id] AS ids, length(p) AS l, [r IN relationships(p) | r.since] AS y")
    assert got == [(["10", "20", "10"], 2, [2011, 2012]), (["10", "20", "30"], 2, [2011, 2013]), (["10", "20", "40"], 2, [2011, 2018])]


def test_path_node_properties(g):
    got = values(g, "MATCH p = (a:User {id: 20})-[:FOLLOWS]->(b:User)-[:FOLLOWS]->(c:User) RETURN [n IN nodes(p) | n.name] AS names")
    assert got == [(["Mara", "Ivo", "Mara"],), (["Mara", "Noor", "Olaf"],), (["Mara", "Tess", "Noor"],), (["Mara", "Tess", "Olaf"],)]
    got = values(g, "MATCH p = (a:User {id: 30})-[:FOLLOWS*2..3]->(b:User) RETURN [n IN nodes(p) | n.name + '!'] AS names, all(n IN nodes(p) WHERE n.age > 24) AS old")
    # only 30-40-50 leaves out Mara, who is 19
    assert len(got) == 6 and [x for x, old in got if old] == [["Tess!", "Noor!", "Olaf!"]] and (["Tess!", "Olaf!", "Mara!", "Ivo!"], False) in got
    got = values(g, "MATCH p = shortestPath((a:User {id: 10})-[:FOLLOWS*]->(b:User {id: 50})) RETURN size([n IN nodes(p) WHERE n.age > 29]) AS k")
    assert got == [(2,)]


def test_weighted_path_in_a_query(g):
    q = "MATCH (a:User)-[r:FOLLOWS]->(b:User) WITH a.id AS source, b.id AS target, r.since - 2010 AS weight MATCH p = shortestPath((x:User {id: 10})-[*]->(y:User {id: 50})) RETURN cost(p) AS c, length(p) AS l"
    assert values(g, q) == [(9.0, 3)]  # 1 + 3 + 5, by 20 and 30


def test_shortest(g):
    assert values(g, "MATCH (a:User {id: 10}), (b:User {id: 50}) MATCH p = shortestPath((a)-[:FOLLOWS*]->(b)) RETURN length(p) AS l") == [(3,)]
    assert values(g, "MATCH p = allShortestPaths((a:User {id: 20})-[:FOLLOWS*..5]->(b:User {id: 50})) RETURN length(p) AS l") == [(2,), (2,)]
    assert values(g, "MATCH (a:User {id: 60}), (b:User {id: 10}) OPTIONAL MATCH p = shortestPath((a)-[:FOLLOWS*]->(b)) RETURN p IS NULL AS none, length(p) AS l") == [(True, None)]


def test_undirected_self_loop_once(g):
    got = values(g, "MATCH (a:User)-[:FRIEND]-(b:User) RETURN a.id AS a, b.id AS b")
    assert got == [(10, 30), (10, 40), (30, 10), (30, 60), (40, 10), (50, 50), (60, 30)]


def test_undirected_walk_mixes_directions(g):
    got = values(g, "MATCH (a:User {id: 40})-[:FOLLOWS*2]-(b:User) RETURN b.id AS b, count(*) AS n")
    # over 30: 20, 50; over 20: 10 twice, 30, 50; over 50: 30, 20
    assert got == [(10, 2), (20, 2), (30, 2), (50, 2)]


def test_uniqueness_is_per_match(g):
    one = values(g, "MATCH (a:User)-[:FRIEND]-(b:User)-[:FRIEND]-(c:User) WHERE a.id = 60 RETURN c.id AS c")
    two = values(g, "MATCH (a:User)-[:FRIEND]-(b:User) WHERE a.id = 60 MATCH (b)-[:FRIEND]-(c:User) RETURN c.id AS c")
    assert one == [(10,)] and two == [(10,), (60,)]


def test_constraint(g):
    assert values(g, "MATCH (a:User)-[:OLDER]->(b:User) RETURN a.id AS a, b.id AS b") == [(10, 20), (30, 40), (30, 50), (40, 50), (50, 20)]


def test_semantics(g):
    q = "RETURN round(-2.5) AS a, range(1, 0) AS b, split('a.b', '.') AS c, 7 / 2 AS d, -7 / 2 AS e, [1, 2, 3][5] AS f, 'x' + 'y' AS g, 5 / 2.0 AS h, substring('hello', 1, 3) AS i, 1 IN [] AS j"
    assert values(g, q) == [(-2.0, [], ["a", "b"], 3, -3, None, "xy", 2.5, "ell", False)]
    assert values(g, "RETURN [1, 2, 3, 4][-2..] AS a, [1, 2, 3][..-1] AS b, tail([]) AS c, last([1, 2]) AS d, 10 % 3 AS e, 2 ^ 3 AS f, toInteger('3.9') AS g, toInteger('x') AS h, toString(1.0) AS i") == [([3, 4], [1, 2], [], 2, 1, 8.0, 3, None, "1.0")]
    assert values(g, "RETURN true XOR false AS a, null = null AS b, NOT null AS c, coalesce(null, 2) AS d") == [(True, None, None, 2)]


def test_temporal(g):
    got = values(g, "MATCH (u:User) WHERE u.id IN [10, 60] RETURN u.born.year AS y, month(u.born) AS m, dayOfWeek(u.born) AS d, year(u.since) AS s, toString(u.born + duration({days: 1})) AS t")
    assert got == [(1973, 12, 1, 1970, "1974-01-01"), (1984, 3, 5, 2022, "1984-03-10")]


def test_order_nulls(g):
    rows = [r[0] for r in g.cypher("MATCH (u:User) RETURN u.born AS b ORDER BY u.born").collect()]
    assert rows[-1] is None and [r[0] for r in g.cypher("MATCH (u:User) RETURN u.born AS b ORDER BY b DESC").collect()][0] is None


def test_whole_entities(g):
    assert g.cypher("MATCH (u:User) RETURN u").columns == ["u.age", "u.born", "u.id", "u.name", "u.since"]
    assert g.cypher("MATCH (u:User)-[r:FOLLOWS]->() RETURN r").columns == ["r.since"]
    assert values(g, "MATCH (u:User) WITH collect(u) AS us UNWIND us AS u RETURN u.name AS n")[0] == ("Ivo",)
    assert values(g, "MATCH (u:User)-[:BOUGHT]->(p) WITH u, collect(p.name) AS ps WHERE size(ps) > 1 RETURN u.name AS n, size(ps) AS k") == [("Mara", 2), ("Olaf", 2)]


def test_untyped(g):
    assert values(g, "MATCH (n) RETURN labels(n)[0] AS l, count(*) AS k") == [("Product", 4), ("User", 6)]
    assert values(g, "MATCH (:User {id: 50})-[r]->(x) RETURN type(r) AS t, count(*) AS k") == [("BOUGHT", 2), ("FOLLOWS", 1), ("FRIEND", 1), ("OLDER", 1)]


def test_patterns_in_expressions(g):
    assert values(g, "MATCH (u:User) WHERE NOT (u)-[:BOUGHT]->() RETURN u.id AS i") == [(10,), (30,), (60,)]
    assert values(g, "MATCH (u:User) RETURN u.id AS i, size([(u)-[b:BOUGHT]->(p) WHERE p.price > 100 | p.name]) AS k, exists((u)-[:FOLLOWS]->()) AS f") == [(10, 0, True), (20, 1, True), (30, 0, True), (40, 0, True), (50, 1, True), (60, 0, False)]


def test_errors(g):
    for text in ("MATCH (n:Nope) RETURN n", "MATCH ()-[:NOPE]->() RETURN 1", "RETURN x", "RETURN $p", "RETURN nope(1)", "MATCH (u:User)", "CALL no.such()", "MATCH (u:User) RETURN u.id AS a UNION MATCH (u:User) RETURN u.id AS b", "MATCH (u:User) RETURN u.name LIMIT 'x'"):
        with pytest.raises(CypherError):
            g.cypher(text)
    assert g.validate("MATCH (n:Nope) RETURN n") and g.validate("MATCH (n:User) RETURN n") is None


def test_writes(spark):
    t = {"users": spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "user_id long, name string, age int"), "follows": spark.createDataFrame([(1, 2)], "a long, b long")}
    schema = {"graph_schema": {"nodes": [{"label": "User", "table": "users", "node_id": "user_id", "property_mappings": {"id": "user_id", "name": "name", "age": "age"}}], "edges": [{"type": "FOLLOWS", "table": "follows", "from_id": "a", "to_id": "b", "from_node": "User", "to_node": "User"}]}}
    g = Graph(spark, schema, t)
    g.cypher("UNWIND [3, 4] AS i CREATE (u:User {id: i, name: 'n' + toString(i)})")
    assert g.counters["nodes_created"] == 2
    g.cypher("MATCH (u:User) WHERE u.id > 2 SET u.age = u.id * 10")
    assert g.counters["properties_set"] == 2
    g.cypher("MATCH (u:User {id: 1}) REMOVE u.name")
    with pytest.raises(CypherError):
        g.cypher("MATCH (u:User {id: 2}) DELETE u")
    g.cypher("MATCH (u:User {id: 2}) DETACH DELETE u")
    assert g.counters["nodes_deleted"] == 1 and g.counters["relationships_deleted"] == 1
    assert values(g, "MATCH (u:User) RETURN u.id AS i, u.name AS n, u.age AS a") == [(1, None, 1), (3, "n3", 30), (4, "n4", 40)]


def test_layouts(spark):
    flights = spark.createDataFrame([(1, "SFO", "CA", "JFK", "NY", 10), (2, "JFK", "NY", "LAX", "CA", 20), (3, "SFO", "CA", "LAX", "CA", 5)], "fid long, o string, os string, d string, ds string, dist int")
    schema = {"graph_schema": {"nodes": [{"label": "Airport", "table": "flights", "node_id": "code", "property_mappings": {}, "from_node_properties": {"code": "o", "state": "os"}, "to_node_properties": {"code": "d", "state": "ds"}}], "edges": [{"type": "FLIGHT", "table": "flights", "from_id": "o", "to_id": "d", "from_node": "Airport", "to_node": "Airport", "edge_id": "fid", "property_mappings": {"dist": "dist"}}]}}
    g = Graph(spark, schema, {"flights": flights})
    assert values(g, "MATCH (a:Airport) RETURN a.code AS c, a.state AS s") == [("JFK", "NY"), ("LAX", "CA"), ("SFO", "CA")]
    assert values(g, "MATCH (a:Airport)-[f:FLIGHT]->(b:Airport)-[h:FLIGHT]->(c:Airport) RETURN a.state AS a, b.code AS b, c.code AS c, f.dist + h.dist AS d") == [("CA", "JFK", "LAX", 30)]
    plan = g.cypher("MATCH (a:Airport)-[f:FLIGHT]->(b:Airport) RETURN a.state AS a, b.state AS b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    acc = spark.createDataFrame([("x", 1, "A"), ("x", 2, "B"), ("y", 1, "C")], "bank string, no int, who string")
    tr = spark.createDataFrame([(1, "x", 1, "y", 1), (2, "y", 1, "x", 2)], "tid long, fb string, fn int, tb string, tn int")
    c = Graph(spark, {"graph_schema": {"nodes": [{"label": "Account", "table": "acc", "node_id": ["bank", "no"], "property_mappings": {"bank": "bank", "no": "no", "who": "who"}}], "edges": [{"type": "SENT", "table": "tr", "from_id": ["fb", "fn"], "to_id": ["tb", "tn"], "from_node": "Account", "to_node": "Account", "edge_id": "tid"}]}}, {"acc": acc, "tr": tr})
    assert values(c, "MATCH (a:Account)-[:SENT]->(b:Account) RETURN a.who AS a, b.who AS b") == [("A", "C"), ("C", "B")]
    assert values(c, "MATCH (a:Account {who: 'A'})-[:SENT*1..3]->(b:Account) RETURN b.who AS b") == [("B",), ("C",)]


def test_outputs(g, tmp_path):
    nodes, edges = g.query_graph("MATCH (a:User)-[r:FOLLOWS]->(b:User) RETURN a, r, b")
    assert nodes.count() == 5 and edges.count() == 8
    g.export("MATCH (u:User) RETURN u.id AS id", f"{tmp_path}/x.csv")
    g.cypher(f"COPY (MATCH (u:User) RETURN u.id AS id, u.name AS name) TO '{tmp_path}/y.parquet' FORMAT parquet")
    assert g.spark.read.parquet(f"{tmp_path}/y.parquet").count() == 6
    g.cypher(f"CALL apoc.export.json.query('MATCH (u:User) RETURN u.id AS id', '{tmp_path}/z.json')")
    assert g.spark.read.json(f"{tmp_path}/z.json").count() == 6
    assert '"n":"Ivo"' in g.formatted("MATCH (u:User {id: 10}) RETURN u.name AS n")
    assert "Ivo" in g.formatted("MATCH (u:User {id: 10}) RETURN u.name AS n", "CSVWithNames")
    assert g.cypher("EXPLAIN MATCH (u:User) RETURN u").first()[0]


def test_procedures(g):
    assert values(g, "CALL db.relationshipTypes() YIELD relationshipType AS t RETURN count(t) AS n") == [(4,)]
    assert g.cypher("CALL db.schema.nodeTypeProperties()").count() == 8
    assert g.cypher("CALL apoc.meta.stats() YIELD nodeCount RETURN nodeCount").first()[0] == 10
    assert g.cypher("SHOW DATABASES").count() == 1
    for p in ("dbms.components", "dbms.info", "dbms.procedures", "dbms.functions", "db.indexes", "db.propertyKeys", "apoc.meta.schema", "db.schema.visualization", "dbms.clientConfig", "dbms.showCurrentUser"):
        g.cypher(f"CALL {p}()").collect()


def test_weighted(spark):
    from graphloom.operators.paths import weighted_shortest

    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "source long, target long, weight double")
    assert weighted_shortest(e, 1, 3).first().cost == 2.0
    assert weighted_shortest(e, 1, 3, fewest_hops=True).first().cost == 5.0


def test_weighted_long_paths(spark):
    import pytest

    from graphloom.operators.paths import weighted_shortest

    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(52)], "source long, target long, weight double").coalesce(1)
    assert weighted_shortest(e, 0, 52).first().cost == 52.0
    with pytest.raises(RuntimeError):
        weighted_shortest(e, 0, 52, most=3)


def test_streaming(spark, tmp_path):
    from graphloom.streaming.matching import stream_query

    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("id long, name string").parquet(f"{tmp_path}/in")
    g = Graph(spark, {"graph_schema": {"nodes": [{"label": "N", "table": "n", "node_id": "id", "property_mappings": {"id": "id", "name": "name"}}], "edges": []}}, {"n": s})
    q = stream_query(g, "MATCH (n:N) WHERE n.id > 1 RETURN n.name AS name").writeStream.format("memory").queryName("out1").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r.name for r in spark.sql("SELECT * FROM out1").collect()] == ["b"]
