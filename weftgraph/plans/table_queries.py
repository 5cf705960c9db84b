"""Cypher queries over the star-schema graph, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table_graph
from .query import Query, cypher

#: Name: (Cypher, SQL). Sums of doubles are rounded on both sides, see rounded().
TEXTS: dict[str, tuple[str, str]] = {
    "cy_flagship": (
        "MATCH (r:Region)-[:OWNS]->(n:Nation)-[:OWNS]->(c:Customer) WHERE c.acctbal > 0 RETURN r.name AS region, count(c) AS customers ORDER BY customers DESC, region",
        "SELECT r_name AS region, count(*) AS customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY r_name",
    ),
    "cy_scan_label": ("MATCH (n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation"),
    "cy_inline_prop": ("MATCH (c:Customer {mktsegment: 'BUILDING'}) RETURN c.id AS id", "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "cy_label_disj": ("MATCH (p:Customer|Supplier|Party) RETURN p.label AS label, p.name AS name", "SELECT 'Customer' AS label, c_name AS name FROM customer UNION ALL SELECT 'Supplier', s_name FROM supplier"),
    "cy_unlabelled": (
        "MATCH (n) RETURN n.label AS label, count(n) AS nodes",
        " UNION ALL ".join(f"SELECT '{a}' AS label, count(*) AS nodes FROM {b}" for a, b in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"), ("Doc", "documents"), ("Turn", "conversations"), ("Page", "pages"))),
    ),
    "cy_out": ("MATCH (r:Region)-[:OWNS]->(n:Nation) RETURN r.name AS region, n.name AS nation", "SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey"),
    "cy_in": ("MATCH (o:Order)<-[:DEFINES]-(c:Customer) WHERE c.mktsegment = 'MACHINERY' RETURN o.id AS id, c.name AS customer", "SELECT o_orderkey AS id, c_name AS customer FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'"),
    "cy_undirected": (
        "MATCH (n:Nation)-[:OWNS]-(x) RETURN n.name AS nation, x.label AS label, count(x) AS neighbours",
        "SELECT n_name AS nation, 'Region' AS label, 1::BIGINT AS neighbours FROM nation UNION ALL SELECT n_name, 'Customer', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "cy_untyped": (
        "MATCH (c:Customer)-[]->(x) RETURN x.label AS label, count(x) AS edges",
        "SELECT 'Order' AS label, 2 * count(*) AS edges FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'Event', count(*) FROM events JOIN customer ON user_id = c_custkey UNION ALL SELECT 'Nation', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "cy_multihop": (
        "MATCH (n:Nation)-[:OWNS]->(c:Customer)-[:OWNS]->(o:Order)-[:REFERENCES]->(p:Part) WHERE p.size < 5 RETURN n.name AS nation, count(p) AS parts, count(DISTINCT c.id) AS customers",
        "SELECT n_name AS nation, count(*) AS parts, count(DISTINCT c_custkey) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 5 GROUP BY n_name",
    ),
    "cy_var_1_3": (
        "MATCH (t:Turn)-[:NEXT*1..3]->(u:Turn) WHERE t.turn = 0 RETURN t.name AS a, u.name AS b",
        "SELECT t.conv_id || ':' || t.turn AS a, u.conv_id || ':' || u.turn AS b FROM conversations t JOIN conversations u ON t.conv_id = u.conv_id AND u.turn BETWEEN t.turn + 1 AND t.turn + 3 WHERE t.turn = 0",
    ),
    "cy_var_star": (
        "MATCH (r:Region)-[:OWNS*]->(o:Order) RETURN r.name AS region, count(o) AS orders",
        "SELECT r_name AS region, count(*) AS orders FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    ),
    "cy_var_in": (
        "MATCH (o:Order)<-[:OWNS*2..3]-(p:Place) WHERE o.totalprice > 300000 RETURN o.id AS id, p.name AS place",
        "SELECT o_orderkey AS id, unnest([n_name, r_name]) AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 300000",
    ),
    "cy_var_zero": (
        "MATCH (n:Nation)-[:HAS_PARENT*0..1]->(p:Place) RETURN n.name AS nation, p.name AS place",
        "SELECT n_name AS nation, n_name AS place FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "cy_where_cmp": (
        "MATCH (c:Customer) WHERE c.acctbal >= 1000 AND c.acctbal <= 2000 AND c.mktsegment <> 'BUILDING' RETURN c.id AS id",
        "SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 1000 AND c_acctbal <= 2000 AND c_mktsegment <> 'BUILDING'",
    ),
    "cy_where_str": (
        "MATCH (p:Part) WHERE p.name STARTS WITH 'c' AND p.name ENDS WITH 't' OR p.name CONTAINS 'old w' RETURN p.id AS id, p.name AS name",
        "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE 'c%' AND p_name LIKE '%t' OR p_name LIKE '%old w%'",
    ),
    "cy_where_bool": (
        "MATCH (o:Order) WHERE NOT (o.status = 'F' OR o.totalprice < 100000) RETURN o.status AS status, count(*) AS n",
        "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000) GROUP BY 1",
    ),
    "cy_where_in": ("MATCH (e:Event) WHERE e.event_type IN ['purchase', 'error'] RETURN e.event_type AS kind, count(e) AS n", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1"),
    "cy_null_prop": ("MATCH (r:Region) WHERE r.acctbal IS NULL RETURN r.name AS name, r.acctbal AS missing", "SELECT r_name AS name, NULL::DOUBLE AS missing FROM region"),
    "cy_return_name": ("MATCH (r:Region) RETURN r.name", 'SELECT r_name AS "r.name" FROM region'),
    "cy_distinct": ("MATCH (c:Customer)-[:PERFORMED]->(e:Event) RETURN DISTINCT c.mktsegment AS segment, e.event_type AS kind", "SELECT DISTINCT c_mktsegment AS segment, event_type AS kind FROM customer JOIN events ON user_id = c_custkey"),
    "cy_order_skip_limit": ("MATCH (o:Order) RETURN o.id AS id, o.totalprice AS price ORDER BY price DESC, id SKIP 10 LIMIT 25", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY price DESC, id LIMIT 25 OFFSET 10"),
    "cy_topk": ("MATCH (p:Part) RETURN p.id AS id, p.price AS price ORDER BY p.price DESC, p.id LIMIT 10", "SELECT p_partkey AS id, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10"),
    "cy_group_count": ("MATCH (c:Customer)-[:OWNS]->(o:Order) RETURN c.mktsegment AS segment, o.priority AS priority, count(o) AS orders", "SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"),
    "cy_min_max": ("MATCH (o:Order) RETURN o.status AS status, min(o.totalprice) AS low, max(o.totalprice) AS high", "SELECT o_orderstatus AS status, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1"),
    "cy_sum_int": ("MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS sizes", "SELECT p_brand AS brand, sum(p_size)::BIGINT AS sizes FROM part GROUP BY 1"),
    "cy_agg_empty": ("MATCH (p:Part) WHERE p.size < 0 RETURN count(p) AS n, sum(p.size) AS total, max(p.size) AS top", "SELECT count(*) AS n, coalesce(sum(p_size), 0)::BIGINT AS total, max(p_size) AS top FROM part WHERE p_size < 0"),
    "cy_comma": (
        "MATCH (s:Supplier)-[:SUPPLIES]->(p:Part), (o:Order)-[:REFERENCES]->(p) WHERE o.totalprice > 350000 RETURN s.id AS supplier, count(*) AS n",
        "SELECT l.l_suppkey AS supplier, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) l JOIN supplier ON s_suppkey = l.l_suppkey JOIN part ON p_partkey = l.l_partkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) r ON r.l_partkey = l.l_partkey JOIN orders ON o_orderkey = r.l_orderkey WHERE o_totalprice > 350000 GROUP BY 1",
    ),
    "edge_distinct_refs": ("MATCH (s:Supplier)-[:SUPPLIES]->(p:Part) RETURN s.name AS supplier, count(p) AS parts", "SELECT s_name AS supplier, count(DISTINCT l_partkey) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_name"),
    "edge_reverse": ("MATCH (p:Part)<-[:SUPPLIES]-(s:Supplier) RETURN p.id AS part, count(s) AS suppliers", "SELECT p_partkey AS part, count(DISTINCT l_suppkey) AS suppliers FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1"),
    "edge_unique_use": (
        "MATCH (a:Customer)<-[:OWNS]-(n:Nation)-[:OWNS]->(b:Customer) WHERE a.acctbal > 9000 AND b.acctbal > 9000 RETURN n.name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM nation JOIN customer a ON a.c_nationkey = n_nationkey JOIN customer b ON b.c_nationkey = n_nationkey AND a.c_custkey <> b.c_custkey WHERE a.c_acctbal > 9000 AND b.c_acctbal > 9000 GROUP BY 1",
    ),
    "edge_type_case": ("MATCH (r:Region)-[:owns]->(n:Nation) RETURN n.name AS name", "SELECT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey"),
}


def _text(name: str):
    return lambda spark, d: cypher(table_graph(spark, d), TEXTS[name][0])


def rounded(text: str, *columns: str):
    def run(spark, d):
        df = cypher(table_graph(spark, d), text)
        return df.withColumns({c: F.round(F.col(c), 2) for c in columns})

    return run


def listed(spark, d):
    df = cypher(table_graph(spark, d), "MATCH (n:Nation)-[:HAS_PARENT]->(r:Region) RETURN r.name AS region, collect(n.name) AS nations")
    return df.withColumn("nations", F.array_join(F.array_sort("nations"), ","))


def node_cells(spark, d):
    df = cypher(table_graph(spark, d), "MATCH (r:Region)-[:OWNS]->(n:Nation) RETURN n, [r] AS rs, n { .name, .label, up: r.name } AS m")
    return df.select(F.concat_ws("/", "n.category", "n.id", "n.label", "n.name").alias("node"), F.col("rs")[0]["name"].alias("region"), F.concat_ws("/", "m.name", "m.label", "m.up").alias("projected"))


def rendered(spark, d):
    return Query.parse("MATCH (r:Region) RETURN r.name AS name, r.size AS size").run(table_graph(spark, d)).json_rows()


def catalog_relationships(spark, d):
    return table_graph(spark, d).catalog()[1]


QUERIES = {name: _text(name) for name in TEXTS} | {
    "cy_sum": rounded("MATCH (c:Customer)-[:OWNS]->(o:Order) RETURN c.mktsegment AS segment, sum(o.totalprice) AS total", "total"),
    "cy_avg": rounded("MATCH (c:Customer) RETURN c.mktsegment AS segment, avg(c.acctbal) AS mean", "mean"),
    "cy_collect": listed,
    "cy_node": node_cells,
    "json_rows": rendered,
    "schema_catalog": catalog_relationships,
}

ORACLES = {name: sql for name, (_, sql) in TEXTS.items()} | {
    "cy_sum": "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "cy_avg": "SELECT c_mktsegment AS segment, round(avg(c_acctbal), 2) AS mean FROM customer GROUP BY 1",
    "cy_collect": "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "cy_node": "SELECT 'Nation/' || n_nationkey || '/Nation/' || n_name AS node, r_name AS region, n_name || '/Nation/' || r_name AS projected FROM nation JOIN region ON n_regionkey = r_regionkey",
    "json_rows": """SELECT '{"name":"' || r_name || '","size":null}' AS json FROM region""",
    "schema_catalog": "SELECT * FROM (VALUES ('OWNS', 'Region', 'Nation'), ('OWNS', 'Nation', 'Customer'), ('OWNS', 'Customer', 'Order'), ('HAS_PARENT', 'Nation', 'Region'), ('HAS_PARENT', 'Customer', 'Nation'), ('HAS_PARENT', 'Order', 'Customer'), ('SUPPLIES', 'Supplier', 'Part'), ('REFERENCES', 'Order', 'Part'), ('DEFINES', 'Customer', 'Order'), ('PERFORMED', 'Customer', 'Event'), ('NEXT', 'Turn', 'Turn'), ('NEXT_EVENT', 'Event', 'Event')) t(type, from_category, to_category)",
}
