"""Schemas, sources and layouts beyond the small social graph."""

import pytest

from graphloom import CypherError, Graph, load_schemas
from graphloom.sources.storage import read_source, write_export

YAML = """
default_schema: two
schemas:
  - name: one
    graph_schema:
      nodes:
        - {label: A, table: t, node_id: id, property_mappings: {id: id}}
      edges: []
  - name: two
    graph_schema:
      nodes:
        - {label: Dog, table: pets, node_id: id, property_mappings: {id: id, name: pet_name, loud: "upper(pet_name)"}, label_column: kind, label_value: dog}
        - {label: Cat, table: pets, node_id: id, auto_discover_columns: true, exclude_columns: [kind], naming_convention: camelCase, label_column: kind, label_value: cat}
        - {label: Old, table: pets, node_id: id, property_mappings: {id: id}, filter: "age > 5"}
      edges:
        - {polymorphic: true, table: rel, from_id: a, to_id: b, type_column: t, from_label_column: fl, to_label_column: tl, type_values: [CHASES, LIKES], from_label_values: [Dog, Cat], to_label_values: [Dog, Cat], edge_id: eid}
"""


@pytest.fixture(scope="module")
def pets(spark):
    t = spark.createDataFrame([(1, "dog", "rex", 7), (2, "cat", "tom", 3), (3, "cat", "kit", 9)], "id long, kind string, pet_name string, age int")
    r = spark.createDataFrame([(1, 1, 2, "CHASES", "Dog", "Cat"), (2, 2, 3, "LIKES", "Cat", "Cat"), (3, 3, 1, "LIKES", "Cat", "Dog")], "eid long, a long, b long, t string, fl string, tl string")
    return Graph(spark, YAML, {"pets": t, "rel": r, "t": spark.createDataFrame([(1,)], "id long")})


def rows(g, text, **params):
    return sorted((tuple(r) for r in g.cypher(text, params).collect()), key=repr)


def test_schema_file():
    found, default = load_schemas(YAML)
    assert set(found) == {"one", "two"} and default == "two"
    with pytest.raises(CypherError):
        load_schemas({"nodes": [], "edges": [{"type": "R", "table": "r", "from_id": "a", "to_id": "b", "from_node": "X", "to_node": "X"}]})
    with pytest.raises(CypherError):
        load_schemas({"nodes": [{"label": "A", "table": "t"}]})


def test_shared_and_polymorphic_tables(pets):
    assert rows(pets, "MATCH (d:Dog) RETURN d.name AS n, d.loud AS l") == [("rex", "REX")]
    assert rows(pets, "MATCH (c:Cat) RETURN c.petName AS n, c.age AS a") == [("kit", 9), ("tom", 3)]
    assert rows(pets, "MATCH (o:Old) RETURN o.id AS i") == [(1,), (3,)]
    assert rows(pets, "MATCH (a)-[r:CHASES|LIKES]->(b) RETURN labels(a)[0] AS a, type(r) AS t, labels(b)[0] AS b") == [("Cat", "LIKES", "Cat"), ("Cat", "LIKES", "Dog"), ("Dog", "CHASES", "Cat")]
    assert rows(pets, "MATCH (d:Dog)-[*2..3]->(x) RETURN labels(x)[0] AS l, count(*) AS n") == [("Cat", 1), ("Dog", 1)]
    assert rows(pets, "MATCH (x) WHERE x:Dog RETURN count(*) AS n") == [(1,)]
    assert rows(pets, "USE one MATCH (a:A) RETURN a.id AS i") == [(1,)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for kind in ("parquet", "csv", "json", "orc"):
        write_export(df, f"{tmp_path}/x.{kind}")
        assert sorted(map(tuple, read_source(spark, f"{tmp_path}/x.{kind}").select("id", "name").collect())) == [(1, "a"), (2, "b")]
    write_export(df, f"{tmp_path}/y", "TabSeparated")
    g = Graph(spark, {"graph_schema": {"nodes": [{"label": "N", "table": "n", "node_id": "id", "source": f"{tmp_path}/x.parquet", "property_mappings": {"id": "id", "name": "name"}}], "edges": []}})
    assert rows(g, "MATCH (n:N) RETURN n.name AS n") == [("a",), ("b",)]
    assert g.register_sources() == ["n"] and spark.table("n").count() == 2
    assert read_source(spark, "table_function:SELECT 1 AS x").first().x == 1
    with pytest.raises(CypherError):
        g.cypher("CREATE (n:N {id: 3})")
    with pytest.raises(ValueError):
        write_export(df, f"{tmp_path}/z.xyz")


def test_view_parameters(spark):
    t = spark.createDataFrame([(1, "x"), (2, "y")], "id long, tenant_id string")
    schema = {"graph_schema": {"nodes": [{"label": "N", "table": "t", "node_id": "id", "property_mappings": {"id": "id"}, "view_parameters": ["tenant_id"]}], "edges": []}}
    with pytest.raises(CypherError):
        Graph(spark, schema, {"t": t}).cypher("MATCH (n:N) RETURN n.id AS i")
    g = Graph(spark, schema, {"t": t}, view_parameters={"tenant_id": "y"})
    assert rows(g, "MATCH (n:N) RETURN n.id AS i") == [(2,)]
    g.cypher("CALL sys.set('tenant_id', 'x')")
    assert rows(g, "MATCH (n:N) RETURN n.id AS i") == [(1,)]


def test_direct_writes(spark):
    schema = {"graph_schema": {"nodes": [{"label": "N", "table": "n", "node_id": "id", "property_mappings": {"id": "id", "name": "name"}}], "edges": [{"type": "R", "table": "r", "from_id": "a", "to_id": "b", "from_node": "N", "to_node": "N"}]}}
    g = Graph(spark, schema, {"n": spark.createDataFrame([(1, "a")], "id long, name string"), "r": spark.createDataFrame([], "a long, b long")})
    g.create_node("N", id=2, name="b")
    g.create_edges("R", [{"a": 1, "b": 2}])
    g.upsert_nodes("N", [{"id": 2, "name": "c"}])
    assert rows(g, "MATCH (a:N)-[:R]->(b:N) RETURN a.name AS a, b.name AS b") == [("a", "c")]
    assert g.delete_nodes("N", [2])["relationships_deleted"] == 1
    assert Graph.draft({"n": g.tables.given["n"]})["graph_schema"]["nodes"][0]["label"] == "N"


def test_impossible_chain(pets):
    schema = {"graph_schema": {"nodes": [{"label": "A", "table": "t", "node_id": "id"}, {"label": "B", "table": "t", "node_id": "id"}], "edges": [{"type": "R", "table": "rel", "from_id": "a", "to_id": "b", "from_node": "A", "to_node": "B"}]}}
    g = Graph(pets.spark, schema, pets.tables.given)
    with pytest.raises(CypherError):
        g.cypher("MATCH (a:A)-[:R*2..3]->(b) RETURN b")
