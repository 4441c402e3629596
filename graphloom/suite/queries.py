"""One query per operator family: openCypher on the star graph, and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.suite.graphs import TRADE_SQL, TURNS_SQL, star

#: name -> (openCypher, parameters, SQL)
SUITE: dict[str, tuple[str, dict, str]] = {}


def add(name: str, cypher: str, sql: str, **params) -> None:
    SUITE[name] = (cypher, params, sql)


add("g01_region_customers", "MATCH (c:Customer)-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region) WHERE r.name = $r RETURN n.name AS nation, count(c) AS customers ORDER BY customers DESC, nation LIMIT 10",
    "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", r="ASIA")
add("g02_node_scan", "MATCH (p:Part) WHERE p.size > 40 AND p.brand STARTS WITH 'Brand#1' RETURN p.id AS id, p.name AS name, p.price AS price",
    "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part WHERE p_size > 40 AND p_brand LIKE 'Brand#1%'")
add("g03_inline_props", "MATCH (c:Customer {segment: 'BUILDING'})-[:LIVES_IN]->(:Nation {name: $n}) RETURN c.id AS id, c.name AS name",
    "SELECT c_custkey AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name = 'NATION_3'", n="NATION_3")
add("g04_edge_props", "MATCH (o:Order)-[l:CONTAINS]->(p:Part) WHERE l.quantity >= 45 AND l.flag = 'R' RETURN p.brand AS brand, count(*) AS n, sum(l.quantity) AS quantity ORDER BY brand",
    "SELECT p_brand AS brand, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45 AND l_returnflag = 'R' GROUP BY 1")
add("g05_pricing_summary", "MATCH (:Order)-[l:CONTAINS]->(:Part) WHERE l.shipped <= datetime('1998-09-02') RETURN l.flag AS flag, l.status AS status, sum(l.quantity) AS quantity, round(avg(l.discount), 6) AS discount, count(*) AS n ORDER BY flag, status",
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
add("g06_fk_traverse", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE c.balance < 0 RETURN c.id AS id, count(o) AS orders, round(sum(o.total), 2) AS total",
    "SELECT c_custkey AS id, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1")
add("g07_four_hops", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE r.name = 'EUROPE' AND p.size = 15 RETURN n.name AS nation, count(*) AS n, round(sum(l.price * (1 - l.discount)), 2) AS revenue",
    "SELECT n_name AS nation, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'EUROPE' AND p_size = 15 GROUP BY 1")
add("g09_optional_anchored_where", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:LIVES_IN]-(s:Supplier) WHERE n.id < 10 AND s.balance > 0 RETURN n.id AS id, count(s) AS suppliers",
    "SELECT n_nationkey AS id, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_nationkey < 10 AND s_acctbal > 0 GROUP BY 1")
add("g10_multi_source_type", "MATCH (x)-[:LIVES_IN]->(n:Nation) RETURN n.name AS nation, labels(x)[0] AS kind, count(*) AS n",
    "SELECT n_name AS nation, kind, count(*) AS n FROM (SELECT c_nationkey AS k, 'Customer' AS kind FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1, 2")
add("g12_undirected", "MATCH (a:Nation)-[t:TOP_TRADE]-(b:Nation) RETURN a.id AS a, b.id AS b, t.items AS items",
    f"WITH {TRADE_SQL} SELECT src AS a, dst AS b, items FROM top_trade UNION ALL SELECT dst, src, items FROM top_trade WHERE src <> dst")
add("g13_uniqueness_two_hops", "MATCH (a:Nation)-[:TOP_TRADE]-(b:Nation)-[:TOP_TRADE]-(c:Nation) RETURN count(*) AS n",
    f"WITH {TRADE_SQL}, e AS (SELECT src, dst, src AS a, dst AS b FROM top_trade UNION ALL SELECT src, dst, dst, src FROM top_trade WHERE src <> dst) SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a WHERE NOT (x.src = y.src AND x.dst = y.dst)")
add("g14_vlp_range", "MATCH (a:Nation)-[:TOP_TRADE*1..3]->(b:Nation) WHERE a.id = 4 RETURN b.id AS b, count(*) AS n",
    f"WITH RECURSIVE {TRADE_SQL}, w AS (SELECT src, dst, [src * 100 + dst] AS es, 1 AS h FROM top_trade WHERE src = 4 UNION ALL SELECT w.src, t.dst, list_append(w.es, t.src * 100 + t.dst), h + 1 FROM w JOIN top_trade t ON w.dst = t.src WHERE h < 3 AND NOT list_contains(w.es, t.src * 100 + t.dst)) SELECT dst AS b, count(*) AS n FROM w GROUP BY 1")
add("g15_vlp_chain", "MATCH p = (a:Turn)-[:NEXT_TURN*2..4]->(b:Turn) WHERE a.turn = 0 RETURN b.role AS role, length(p) AS hops, count(*) AS n",
    "SELECT b.role AS role, b.turn AS hops, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id WHERE a.turn = 0 AND b.turn BETWEEN 2 AND 4 GROUP BY 1, 2")
add("g16_vlp_exact", "MATCH (a:Turn)-[:NEXT_TURN*3]->(b:Turn) RETURN a.role AS a, b.role AS b, count(*) AS n",
    "SELECT a.role AS a, b.role AS b, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 3 GROUP BY 1, 2")
add("g17_vlp_zero", "MATCH (a:Turn)-[:NEXT_TURN*0..1]->(b:Turn) RETURN b.role AS role, count(*) AS n",
    "SELECT b.role AS role, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 0 AND 1 GROUP BY 1")
add("g18_shortest_path", "MATCH p = shortestPath((a:Nation)-[:TOP_TRADE*1..6]->(b:Nation)) WHERE a.id <> b.id RETURN a.id AS a, b.id AS b, length(p) AS hops",
    f"WITH RECURSIVE {TRADE_SQL}, w AS (SELECT DISTINCT src AS a, dst AS b, 1 AS h FROM top_trade UNION SELECT w.a, t.dst, h + 1 FROM w JOIN top_trade t ON w.b = t.src WHERE h < 6) SELECT a, b, CAST(min(h) AS BIGINT) AS hops FROM w WHERE a <> b GROUP BY 1, 2")
add("g19_all_shortest", "MATCH p = allShortestPaths((a:Nation)-[:TOP_TRADE*1..6]->(b:Nation)) WHERE a.id <> b.id RETURN a.id AS a, b.id AS b, count(*) AS paths",
    f"WITH RECURSIVE {TRADE_SQL}, w AS (SELECT src AS a, dst AS b, 1 AS h FROM top_trade WHERE src <> dst UNION ALL SELECT w.a, t.dst, h + 1 FROM w JOIN top_trade t ON w.b = t.src WHERE h < 6 AND t.src <> t.dst), m AS (SELECT a, b, min(h) AS h FROM w WHERE a <> b GROUP BY 1, 2) SELECT w.a, w.b, count(*) AS paths FROM w JOIN m ON w.a = m.a AND w.b = m.b AND w.h = m.h GROUP BY 1, 2")
add("g20_exists_pattern", "MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status: 'P'}) AND c.balance > 9000 RETURN c.id AS id",
    "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
add("g21_not_exists", "MATCH (p:Part) WHERE NOT EXISTS { (o:Order)-[l:CONTAINS]->(p) WHERE l.quantity > 48 } RETURN count(p) AS n",
    "SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
add("g22_pattern_in_or", "MATCH (n:Nation) WHERE n.id < 3 OR (n)-[:IN_REGION]->(:Region {name: 'AFRICA'}) RETURN n.id AS id",
    "SELECT n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 3 OR r_name = 'AFRICA'")
add("g23_pattern_count", "MATCH (n:Nation) RETURN n.id AS id, size((n)<-[:LIVES_IN]-(:Customer)) AS customers",
    "SELECT n_nationkey AS id, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
add("g24_pattern_comprehension", "MATCH (r:Region) RETURN r.name AS region, size([(r)<-[:IN_REGION]-(n:Nation) WHERE n.id > 5 | n.name]) AS nations, sum([(r)<-[:IN_REGION]-(m:Nation) | m.id]) AS ids",
    "SELECT r_name AS region, count(*) FILTER (n_nationkey > 5) AS nations, CAST(sum(n_nationkey) AS BIGINT) AS ids FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
add("g25_with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS orders, max(o.total) AS top WHERE orders > 14 RETURN c.name AS name, orders, top",
    "SELECT c_name AS name, count(*) AS orders, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name HAVING count(*) > 14")
add("g26_with_match", "MATCH (c:Customer) WITH c ORDER BY c.balance DESC, c.id LIMIT 20 MATCH (c)-[:PLACED]->(o:Order) RETURN c.id AS id, count(o) AS orders",
    "SELECT c_custkey AS id, count(*) AS orders FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("g27_unwind", "UNWIND range(1, 5) AS x UNWIND [x, x * 10] AS y RETURN x, y", "SELECT x, unnest([x, x * 10]) AS y FROM range(1, 6) t(x)")
add("g28_unwind_collected", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) WITH r, collect(n.name) AS names UNWIND names AS name RETURN r.name AS region, name",
    "SELECT r_name AS region, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey")
add("g29_union", "MATCH (c:Customer) WHERE c.balance < -900 RETURN c.name AS name UNION MATCH (s:Supplier) WHERE s.balance < 0 RETURN s.name AS name",
    "SELECT c_name AS name FROM customer WHERE c_acctbal < -900 UNION SELECT s_name FROM supplier WHERE s_acctbal < 0")
add("g30_union_all", "MATCH (n:Nation) RETURN n.id AS id UNION ALL MATCH (r:Region) RETURN r.id AS id", "SELECT n_nationkey AS id FROM nation UNION ALL SELECT r_regionkey FROM region")
add("g31_distinct", "MATCH (:Order)-[l:CONTAINS]->(p:Part) RETURN DISTINCT p.brand AS brand, l.flag AS flag", "SELECT DISTINCT p_brand AS brand, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey")
add("g32_order_skip_limit", "MATCH (o:Order) RETURN o.id AS id, o.total AS total ORDER BY total DESC, id SKIP 10 LIMIT 25", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 25 OFFSET 10")
add("g33_case", "MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN 'small' WHEN p.size < 30 THEN 'medium' ELSE 'large' END AS kind, CASE p.brand WHEN 'Brand#1' THEN 1 ELSE 0 END AS first, count(*) AS n",
    "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind, CAST(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END AS BIGINT) AS first, count(*) AS n FROM part GROUP BY 1, 2")
add("g34_strings", "MATCH (p:Part) WHERE p.name CONTAINS 'red' AND p.name ENDS WITH 'ring' RETURN p.id AS id, toUpper(p.name) AS up, substring(p.name, 1, 3) AS sub, split(p.name, ' ')[0] AS word, replace(p.name, 'red', 'RED') AS swapped, size(p.name) AS n, left(p.name, 2) AS l, right(p.name, 2) AS r, reverse(p.name) AS back",
    "SELECT p_partkey AS id, upper(p_name) AS up, substr(p_name, 2, 3) AS sub, split_part(p_name, ' ', 1) AS word, replace(p_name, 'red', 'RED') AS swapped, length(p_name) AS n, left(p_name, 2) AS l, right(p_name, 2) AS r, reverse(p_name) AS back FROM part WHERE p_name LIKE '%red%' AND p_name LIKE '%ring'")
add("g36_temporal", "MATCH (o:Order) WHERE o.date >= datetime('1996-01-01') AND o.date < datetime('1996-01-01') + duration({months: 3}) RETURN o.date.year AS y, month(o.date) AS m, quarter(o.date) AS q, dayOfWeek(o.date) AS d, count(*) AS n",
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, isodow(o_orderdate) AS d, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01' GROUP BY 1, 2, 3, 4")
add("g37_lists", "UNWIND range(0, 4) AS i WITH i, [5, 3, 9, 1, 7] AS l RETURN i, l[i] AS at, l[-1] AS last, size(l[1..3]) AS part, head(tail(l)) AS second, reduce(s = 0, x IN l | s + x) AS total, size([x IN l WHERE x > i | x * 2]) AS more, any(x IN l WHERE x = i) AS has, all(x IN l WHERE x > i) AS every, none(x IN l WHERE x > 8) AS no, single(x IN l WHERE x = 9) AS one",
    "SELECT i, l[i + 1] AS at, CAST(7 AS BIGINT) AS last, CAST(2 AS BIGINT) AS part, CAST(3 AS BIGINT) AS second, CAST(25 AS BIGINT) AS total, CAST(len([x for x in l if x > i]) AS BIGINT) AS more, list_contains(l, i) AS has, len([x for x in l if x <= i]) = 0 AS every, false AS no, true AS one FROM (SELECT i, [CAST(5 AS BIGINT), 3, 9, 1, 7] AS l FROM range(0, 5) t(i))")
add("g38_nulls", "UNWIND [1, null, 3] AS x RETURN x, coalesce(x, 0) AS c, x IS NULL AS missing, nullIf(x, 3) AS n", "SELECT x, coalesce(x, 0) AS c, x IS NULL AS missing, nullif(x, 3) AS n FROM (SELECT unnest([CAST(1 AS BIGINT), NULL, 3]) AS x)")
add("g39_aggregates", "MATCH (o:Order) RETURN o.priority AS priority, count(*) AS n, count(DISTINCT o.status) AS kinds, round(avg(o.total), 2) AS mean, min(o.total) AS lo, max(o.total) AS hi, round(stDev(o.total), 2) AS sd, round(percentileCont(o.total, 0.5), 2) AS mid, percentileDisc(o.total, 0.9) AS p90, size(collect(DISTINCT o.status)) AS held",
    "SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds, round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(stddev_samp(o_totalprice), 2) AS sd, round(quantile_cont(o_totalprice, 0.5), 2) AS mid, quantile_disc(o_totalprice, 0.9) AS p90, count(DISTINCT o_orderstatus) AS held FROM orders GROUP BY 1")
add("g40_aggregate_in_expression", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.segment AS segment, 2 * count(o) + 1 AS score, round(sum(o.total) / count(o), 2) AS mean",
    "SELECT c_mktsegment AS segment, 2 * count(*) + 1 AS score, round(sum(o_totalprice) / count(*), 2) AS mean FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
add("g41_empty_aggregate", "MATCH (c:Customer) WHERE c.id < 0 RETURN count(c) AS n, sum(c.balance) AS total, avg(c.balance) AS mean", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean")
add("g42_polymorphic", "MATCH (u:User)-[e:click|purchase]->(x:Event) RETURN type(e) AS kind, count(*) AS n, count(DISTINCT u) AS users, round(sum(e.value), 2) AS total",
    "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
add("g43_virtual_node", "MATCH (u:User)-[:DID]->(e:Event) WHERE e.value > 50 RETURN u.id AS id, count(e) AS n, max(e.value) AS top", "SELECT user_id AS id, count(*) AS n, max(value) AS top FROM events WHERE value > 50 GROUP BY 1")
add("g44_virtual_scan", "MATCH (u:User) RETURN count(u) AS n, min(u.id) AS lo", "SELECT count(DISTINCT user_id) AS n, min(user_id) AS lo FROM events")
add("g46_cartesian_theta", "MATCH (a:Nation), (b:Nation) WHERE a.id < b.id AND a.name < b.name RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_name < b.n_name")
add("g47_whole_group", "MATCH (n:Nation)<-[:LIVES_IN]-(c:Customer) WITH n, count(c) AS k ORDER BY k DESC, n.id LIMIT 5 RETURN n.id AS id, n.name AS name, k", "SELECT n_nationkey AS id, n_name AS name, count(*) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5")
add("g48_property_expression", "MATCH (c:Customer) WHERE c.rich RETURN c.segment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
add("g49_in_lists", "MATCH (n:Nation) WHERE n.id IN [1, 3, 5] OR n.name IN $names RETURN n.id AS id UNION ALL MATCH (n:Nation) WHERE n.id IN [] RETURN n.id AS id", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey IN (1, 3, 5)", names=["nowhere"])
add("g50_regex", "MATCH (p:Part) WHERE p.name =~ '(red|blue) .*t' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE regexp_full_match(p_name, '(red|blue) .*t')")
add("g51_vector_search", "CALL db.index.vector.queryNodes('vectors', 10, $v) YIELD node, score RETURN node.id AS id, round(score, 6) AS score",
    "SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(str(float(i % 5 - 2)) for i in range(64)) + "]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), [" + ", ".join(str(float(i % 5 - 2)) for i in range(64)) + "]) DESC, vec_id LIMIT 10", v=[float(i % 5 - 2) for i in range(64)])
add("g52_fulltext_exact", "CALL db.index.fulltext.queryNodes('exact', 'red ring', 100000) YIELD node, score RETURN node.id AS id, score", "SELECT p_partkey AS id, CAST(1 AS DOUBLE) AS score FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'ring')")
add("g53_labels_procedure", "CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Customer', 'Document', 'Event', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'Turn', 'User', 'Vector']) AS label")
add("g54_conversion", "UNWIND ['12', '3.7', 'x', 'true'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b", "SELECT s, CAST(trunc(TRY_CAST(s AS DOUBLE)) AS BIGINT) AS i, TRY_CAST(s AS DOUBLE) AS f, CASE WHEN s = 'true' THEN true END AS b FROM (SELECT unnest(['12', '3.7', 'x', 'true']) AS s)")
add("g55_composite_hop", "MATCH (a:Turn)-[:NEXT_TURN]->(b:Turn) WHERE a.role = 'user' RETURN b.role AS role, count(*) AS n", f"WITH {TURNS_SQL} SELECT b.role AS role, count(*) AS n FROM turns t JOIN conversations a ON a.conv_id = t.conv_id AND a.turn = t.turn JOIN conversations b ON b.conv_id = t.conv_id AND b.turn = t.next_turn WHERE a.role = 'user' GROUP BY 1")
add("g56_pagerank", "CALL pagerank(graph: 'star', nodeLabels: 'Nation', relationshipTypes: 'TOP_TRADE', maxIterations: 3, dampingFactor: 0.85) YIELD node_id, pagerank RETURN node_id AS id, round(pagerank, 6) AS rank",
    f"WITH {TRADE_SQL}, l AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM top_trade), r1 AS (SELECT dst AS id, 0.15 + 0.85 * sum(0.04 / deg) AS r FROM l GROUP BY 1), r2 AS (SELECT dst AS id, 0.15 + 0.85 * sum(r / deg) AS r FROM l JOIN r1 ON src = id GROUP BY 1), r3 AS (SELECT dst AS id, 0.15 + 0.85 * sum(r / deg) AS r FROM l JOIN r2 ON src = id GROUP BY 1) SELECT id, round(r, 6) AS rank FROM r3")
add("g57_order_nulls", "UNWIND [3, null, 1] AS x WITH x ORDER BY x DESC LIMIT 2 RETURN x", "SELECT x FROM (SELECT unnest([CAST(3 AS BIGINT), NULL, 1]) AS x) ORDER BY x DESC NULLS FIRST LIMIT 2")
add("g58_native_functions", "MATCH (p:Part) RETURN spark.approx_percentile(p.size, 0.5, 10000) AS mid, spark.max_by(p.price, p.id) AS dearest, ch.argMin(p.price, p.id) AS cheapest", "SELECT quantile_disc(p_size, 0.5) AS mid, max_by(p_retailprice, p_partkey) AS dearest, min_by(p_retailprice, p_partkey) AS cheapest FROM part")
add("g59_optional_match_whole", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.total > 400000 RETURN c.id AS id, count(o) AS big",
    "SELECT c_custkey AS id, count(o_orderkey) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY 1")
add("g60_multi_type_whole", "MATCH (o:Order)-[e:CONTAINS|SUPPLIED_BY]->(x) RETURN type(e) AS kind, count(*) AS n, sum(e.quantity) AS quantity",
    "SELECT kind, count(*) AS n, sum(l_quantity) AS quantity FROM (SELECT 'CONTAINS' AS kind, * FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', * FROM lineitem) GROUP BY 1")
add("g61_math_whole", "MATCH (p:Part) RETURN p.id AS id, abs(-p.size) AS a, p.size / 4 AS whole, p.size % 7 AS rest, round(p.price) AS r, ceil(p.price) AS c, floor(p.price) AS f, sign(p.size - 20) AS s, p.size ^ 2 AS sq, round(sqrt(p.size), 6) AS root",
    "SELECT p_partkey AS id, abs(-p_size) AS a, CAST(p_size // 4 AS BIGINT) AS whole, CAST(p_size % 7 AS BIGINT) AS rest, floor(p_retailprice + 0.5) AS r, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, CAST(sign(p_size - 20) AS DOUBLE) AS s, CAST(p_size AS DOUBLE) ^ 2 AS sq, round(sqrt(p_size), 6) AS root FROM part")
add("g62_coupled_row_whole", "MATCH (s:Supplier)<-[:SUPPLIED_BY]-(o:Order)-[:CONTAINS]->(p:Part) RETURN count(*) AS n, count(DISTINCT s) AS suppliers",
    "SELECT count(*) AS n, count(DISTINCT a.l_suppkey) AS suppliers FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
# paths with filters in WHERE at their start, their end and both
add("g63_walk_where_both_ends", "MATCH (a:Nation)-[:TOP_TRADE*1..3]->(b:Nation) WHERE a.name = $a AND b.name <> $b RETURN b.name AS b, count(*) AS n",
    f"WITH RECURSIVE {TRADE_SQL}, w AS (SELECT src, dst, [src * 100 + dst] AS es, 1 AS h FROM top_trade JOIN nation ON n_nationkey = src WHERE n_name = 'NATION_7' UNION ALL SELECT w.src, t.dst, list_append(w.es, t.src * 100 + t.dst), h + 1 FROM w JOIN top_trade t ON w.dst = t.src WHERE h < 3 AND NOT list_contains(w.es, t.src * 100 + t.dst)) SELECT n_name AS b, count(*) AS n FROM w JOIN nation ON n_nationkey = dst WHERE n_name <> 'NATION_1' GROUP BY 1", a="NATION_7", b="NATION_1")
add("g64_shortest_where_both_ends", "MATCH p = shortestPath((a:Nation)-[:TOP_TRADE*1..6]->(b:Nation)) WHERE a.name STARTS WITH $a AND b.name IN $b AND a.id <> b.id RETURN a.id AS a, b.id AS b, length(p) AS hops",
    f"WITH RECURSIVE {TRADE_SQL}, w AS (SELECT DISTINCT src AS a, dst AS b, 1 AS h FROM top_trade JOIN nation ON n_nationkey = src WHERE n_name LIKE 'NATION_1%' UNION SELECT w.a, t.dst, h + 1 FROM w JOIN top_trade t ON w.b = t.src WHERE h < 6) SELECT a, b, CAST(min(h) AS BIGINT) AS hops FROM w JOIN nation ON n_nationkey = b WHERE a <> b AND n_name IN ('NATION_3', 'NATION_9', 'NATION_19') GROUP BY 1, 2", a="NATION_1", b=["NATION_3", "NATION_9", "NATION_19"])
add("g65_walk_to_known_end", "MATCH (a:Nation)-[:TOP_TRADE*1..2]->(b:Nation) WHERE b.name = $b RETURN a.id AS a, count(*) AS n",
    f"WITH {TRADE_SQL}, x AS (SELECT src AS a, dst AS b FROM top_trade UNION ALL SELECT s.src, t.dst FROM top_trade s JOIN top_trade t ON s.dst = t.src WHERE NOT (s.src = t.src AND s.dst = t.dst)) SELECT a, count(*) AS n FROM x JOIN nation ON n_nationkey = b WHERE n_name = 'NATION_19' GROUP BY 1", b="NATION_19")
add("g66_closed_pattern", "MATCH (a:Nation)-[:TOP_TRADE*2..3]->(a) RETURN a.id AS a, count(*) AS n",
    f"WITH {TRADE_SQL}, e AS (SELECT src, dst, src * 100 + dst AS k FROM top_trade) SELECT a, count(*) AS n FROM (SELECT x.src AS a FROM e x JOIN e y ON x.dst = y.src WHERE y.dst = x.src AND x.k <> y.k UNION ALL SELECT x.src FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src WHERE z.dst = x.src AND x.k <> y.k AND y.k <> z.k AND x.k <> z.k) GROUP BY 1")
add("g67_undirected_walk", "MATCH (a:Nation)-[:TOP_TRADE*2]-(b:Nation) RETURN a.id AS a, b.id AS b, count(*) AS n",
    f"WITH {TRADE_SQL}, e AS (SELECT src AS a, dst AS b, src * 100 + dst AS k FROM top_trade UNION ALL SELECT dst, src, src * 100 + dst FROM top_trade WHERE src <> dst) SELECT x.a AS a, y.b AS b, count(*) AS n FROM e x JOIN e y ON x.b = y.a AND x.k <> y.k GROUP BY 1, 2")
add("g68_walk_over_two_types", "MATCH (c:Customer)-[:LIVES_IN|IN_REGION*2]->(r:Region) RETURN r.name AS region, count(*) AS n",
    "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
add("g69_walk_over_foreign_key", "MATCH (c:Customer)-[:PLACED*1]->(o:Order) WHERE o.status = 'P' RETURN c.segment AS segment, count(*) AS n",
    "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1")
add("g70_polymorphic_walk", "MATCH (u:User)-[e:view|purchase*1..2]->(x:Event) RETURN count(*) AS n, count(DISTINCT u) AS users", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type IN ('view', 'purchase')")
add("g71_walk_then_hop", "MATCH (a:Turn)-[:NEXT_TURN*2]->(b:Turn)-[:NEXT_TURN]->(c:Turn) WHERE a.role = 'user' RETURN c.role AS role, count(*) AS n",
    "SELECT c.role AS role, count(*) AS n FROM conversations a JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 3 WHERE a.role = 'user' GROUP BY 1")
add("g72_optional_walk", "MATCH (a:Turn) WHERE a.role = 'user' OPTIONAL MATCH (a)-[:NEXT_TURN*1..2]->(b:Turn) WHERE b.role = 'assistant' RETURN a.turn AS turn, count(b) AS n",
    "SELECT a.turn AS turn, count(b.turn) AS n FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 2 AND b.role = 'assistant' WHERE a.role = 'user' GROUP BY 1")
add("g73_pagerank_two_labels", "CALL pagerank(nodeLabels: 'Nation, Region', relationshipTypes: 'IN_REGION, TOP_TRADE', maxIterations: 2, dampingFactor: 0.85) YIELD node_id, label, pagerank RETURN node_id AS id, label, round(pagerank, 6) AS rank",
    f"WITH {TRADE_SQL}, l0 AS (SELECT 'N' || src AS src, 'N' || dst AS dst FROM top_trade UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), l AS (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM l0), r1 AS (SELECT dst AS id, 0.15 + 0.85 * sum(1.0 / 30 / deg) AS r FROM l GROUP BY 1), r2 AS (SELECT dst AS id, 0.15 + 0.85 * sum(r / deg) AS r FROM l JOIN r1 ON src = id GROUP BY 1) SELECT CAST(substr(id, 2) AS INTEGER) AS id, CASE WHEN id LIKE 'N%' THEN 'Nation' ELSE 'Region' END AS label, round(r, 6) AS rank FROM r2")
add("g74_with_star", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH *, size(n.name) AS letters WHERE letters > 8 RETURN r.name AS region, n.name AS nation, letters",
    "SELECT r_name AS region, n_name AS nation, length(n_name) AS letters FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(n_name) > 8")
add("g75_whole_entity", "MATCH (r:Region) RETURN r", 'SELECT r_regionkey AS "r.id", r_name AS "r.name" FROM region')
add("g76_untyped_hop", "MATCH (n:Nation)-[e]->(x) RETURN type(e) AS kind, labels(x)[0] AS label, count(*) AS n",
    f"WITH {TRADE_SQL} SELECT 'IN_REGION' AS kind, 'Region' AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'TOP_TRADE', 'Nation', count(*) FROM top_trade")
add("g77_label_predicate", "MATCH (x)-[:LIVES_IN]->(n:Nation) WHERE x:Supplier RETURN n.id AS id, count(*) AS n", "SELECT s_nationkey AS id, count(*) AS n FROM supplier GROUP BY 1")
add("g78_fulltext_standard", "CALL db.index.fulltext.queryNodes('words', 'red', null) YIELD node RETURN node.id AS id", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')")
add("g79_exists_property", "MATCH (n:Nation) WHERE exists(n.name) RETURN n.id AS id, CASE n.id % 4 WHEN 0 THEN 'four' ELSE 'other' END AS by", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 0 THEN 'four' ELSE 'other' END AS by FROM nation WHERE n_name IS NOT NULL")
# functions over whole tables
add("g81_trigonometry", "MATCH (p:Part) WITH p.id AS id, p.size AS x RETURN id, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 4) AS t, round(asin(x / 100.0), 6) AS sa, round(acos(x / 100.0), 6) AS ca, round(atan(x), 6) AS ta, round(atan2(x, 3), 6) AS t2, round(exp(x / 10.0), 4) AS ex, round(log(x), 6) AS ln, round(log10(x), 6) AS lg, round(pi(), 6) AS p, round(e(), 6) AS e, pow(x, 2) AS sq",
    "SELECT p_partkey AS id, round(sin(x), 6) AS s, round(cos(x), 6) AS c, round(tan(x), 4) AS t, round(asin(x / 100.0), 6) AS sa, round(acos(x / 100.0), 6) AS ca, round(atan(x), 6) AS ta, round(atan2(x, 3), 6) AS t2, round(exp(x / 10.0), 4) AS ex, round(ln(x), 6) AS ln, round(log10(x), 6) AS lg, round(pi(), 6) AS p, round(exp(1), 6) AS e, CAST(x AS DOUBLE) ** 2 AS sq FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part)")
add("g82_more_strings", "MATCH (p:Part) RETURN p.id AS id, toLower(p.brand) AS low, trim('  ' + p.brand + ' ') AS t, lTrim('  ' + p.brand) AS l, rTrim(p.brand + '  ') AS r, toString(p.size) AS s, startsWith(p.name, 'b') AS b, endsWith(p.name, 't') AS z, contains(p.name, 'an') AS an, isEmpty(p.name) AS none, normalize(p.brand) AS nf, valueType(p.size) AS k, valueType(p.price) AS f, last(split(p.name, ' ')) AS word",
    "SELECT p_partkey AS id, lower(p_brand) AS low, p_brand AS t, p_brand AS l, p_brand AS r, CAST(p_size AS VARCHAR) AS s, p_name LIKE 'b%' AS b, p_name LIKE '%t' AS z, contains(p_name, 'an') AS an, length(p_name) = 0 AS none, p_brand AS nf, 'INTEGER' AS k, 'FLOAT' AS f, split_part(p_name, ' ', -1) AS word FROM part")
add("g83_more_temporal", "MATCH (o:Order) RETURN o.id AS id, year(o.date) AS y, day(o.date) AS d, hour(o.date) AS h, minute(o.date) AS m, second(o.date) AS s, dayOfYear(o.date) AS doy, week(o.date) AS w, toUnixTimestampMillis(o.date) AS ms, timestamp(o.date) AS ts, toString(date(o.date)) AS day, localdatetime('2020-02-03T04:05:06') = localdatetime('2020-02-03 04:05:06') AS same, size(localtime()) AS clock, rand() < 1 AS sure",
    "SELECT o_orderkey AS id, year(o_orderdate) AS y, day(o_orderdate) AS d, hour(o_orderdate) AS h, minute(o_orderdate) AS m, second(o_orderdate) AS s, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w, epoch_ms(o_orderdate) AS ms, CAST(epoch(o_orderdate) AS BIGINT) AS ts, strftime(o_orderdate, '%Y-%m-%d') AS day, true AS same, CAST(12 AS BIGINT) AS clock, true AS sure FROM orders")
add("g84_vector_functions", "MATCH (v:Vector) WITH v.id AS id, v.embedding AS e RETURN id, round(gds.similarity.cosine(e, $v), 5) AS c, round(vector.similarity.cosine(e, $v), 5) AS vc, round(gds.similarity.euclidean(e, $v), 5) AS u, round(gds.similarity.euclideanDistance(e, $v), 5) AS d",
    "SELECT vec_id AS id, round(list_cosine_similarity(e, q), 5) AS c, round(list_cosine_similarity(e, q), 5) AS vc, round(1 / (1 + list_distance(e, q)), 5) AS u, round(list_distance(e, q), 5) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, [" + ", ".join(str(float(i % 3 - 1)) for i in range(64)) + "] AS q FROM embeddings)", v=[float(i % 3 - 1) for i in range(64)])
add("g85_array_functions", "UNWIND range(0, 5) AS i WITH i, [i, 2, 7] AS l RETURN i, arrayFilter(x -> x > 1, l) AS f, arrayMap(x -> x * 2, l) AS m, size(keys({a: 1, b: i})) AS k, {a: i}.a AS a, tail([i]) AS t, head(l) AS h",
    "SELECT i, [x for x in l if x > 1] AS f, [x * 2 for x in l] AS m, CAST(2 AS BIGINT) AS k, i AS a, CAST([] AS BIGINT[]) AS t, i AS h FROM (SELECT i, [i, CAST(2 AS BIGINT), CAST(7 AS BIGINT)] AS l FROM range(0, 6) r(i))")
add("g86_more_aggregates", "MATCH (p:Part) RETURN p.brand AS brand, round(stDevP(p.price), 4) AS sd, countIf(p.size > 25) AS big, anyLast(p.brand) AS some, percentileDisc(p.size, 0.5) AS mid, round(ch.avgWeighted(p.price, p.size), 4) AS w, ch.uniqExact(p.size) AS kinds, round(ch.varPop(p.price), 2) AS v",
    "SELECT p_brand AS brand, round(stddev_pop(p_retailprice), 4) AS sd, count(*) FILTER (p_size > 25) AS big, p_brand AS some, quantile_disc(p_size, 0.5) AS mid, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS w, count(DISTINCT p_size) AS kinds, round(var_pop(p_retailprice), 2) AS v FROM part GROUP BY 1")
add("g87_id_predicate", "MATCH (n:Nation) WHERE id(n) IN [3, 7] RETURN id(n) AS id, n.name AS name", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey IN (3, 7)")
add("g88_weighted_path", "MATCH (a:Nation)-[t:TOP_TRADE]->(b:Nation) WITH a.id AS source, b.id AS target, 1.0 AS weight MATCH p = shortestPath((x:Nation)-[*]->(y:Nation)) WHERE x.name = $a RETURN y.id AS y, cost(p) AS c, length(p) AS hops",
    f"WITH RECURSIVE {TRADE_SQL}, w AS (SELECT DISTINCT dst AS b, 1 AS h FROM top_trade JOIN nation ON n_nationkey = src WHERE n_name = 'NATION_7' UNION SELECT t.dst, h + 1 FROM w JOIN top_trade t ON w.b = t.src WHERE h < 25) SELECT b AS y, CAST(min(h) AS DOUBLE) AS c, CAST(min(h) AS BIGINT) AS hops FROM w WHERE b <> 7 GROUP BY 1", a="NATION_7")


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    cypher, params, _ = SUITE[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return star(spark, sf_dir).cypher(cypher, params)

    return run


QUERIES = {name: runner(name) for name in SUITE}
ORACLES = {name: sql for name, (_, _, sql) in SUITE.items()}
