import json

import pytest

from weftgraph.errors import CypherExecutionError, CypherSyntaxError, QueryError, StaleNodeError
from weftgraph.graph import EdgeTable, NodeTable, PropertyGraph
from weftgraph.plans.parser import parse
from weftgraph.plans.query import Query


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame([(1, "Ann", 30, "Bee"), (2, "Bob", None, "Bee"), (3, "Cy", 25, "Ant")], "id long, name string, age int, kind string")
    towns = spark.createDataFrame([("x", "Xville"), ("y", "Yton")], "code string, name string")
    lives = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "src long, dst string")
    knows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 1)], "src long, dst long")
    from pyspark.sql import functions as F

    kinds = {"Bee": lambda: F.col("kind") == "Bee", "Ant": lambda: F.col("kind") == "Ant", "Person": None}
    nodes = [NodeTable("Person", people, "id", kinds, {"name": "name", "age": "age"}, "kind"), NodeTable("Town", towns, "code", {"Town": None}, {"name": "name"})]
    return PropertyGraph(nodes, [EdgeTable("LIVES", "Person", "Town", lives), EdgeTable("KNOWS", "Person", "Person", knows)])


def rows(graph, text):
    return sorted(map(tuple, Query.parse(text).run(graph).rows), key=str)


def test_labels(graph):
    assert rows(graph, "MATCH (b:Bee) RETURN b.name") == [("Ann",), ("Bob",)]
    assert rows(graph, "MATCH (b:Bee|Ant|Bee) RETURN b.kind AS k, count(*) AS n") == [("Ant", 1), ("Bee", 2)]
    assert rows(graph, "MATCH (n:Nothing) RETURN n.name") == []
    assert Query.parse("MATCH (n:Nothing) RETURN n.name, n").run(graph).columns == ["n.name", "n"]
    assert rows(graph, "MATCH (n:bee) RETURN n.name") == []
    assert len(rows(graph, "MATCH (n) RETURN n.label, n.name")) == 5


def test_edges(graph):
    assert rows(graph, "MATCH (p)-[:lives]->(t:Town {name: 'Xville'}) RETURN p.name") == [("Ann",), ("Bob",)]
    assert rows(graph, "MATCH (t:Town)<-[:LIVES]-(p:Ant) RETURN t.name") == [("Yton",)]
    assert rows(graph, "MATCH (a {name: 'Ann'})-[:KNOWS]-(b) RETURN b.name") == [("Ann",), ("Bob",), ("Cy",)]
    assert rows(graph, "MATCH (a:Person {name: 'Cy'})-[]->(b) RETURN b.name") == [("Ann",), ("Yton",)]
    assert rows(graph, "MATCH (a)-[:KNOWS]->(a) RETURN a.name") == [("Ann",)]
    assert rows(graph, "MATCH (t:Town)-[:LIVES]->(x) RETURN x.name") == []


def test_relationships_are_used_once(graph):
    assert rows(graph, "MATCH (a:Bee)-[:LIVES]->(t)<-[:LIVES]-(b) RETURN a.name, b.name") == [("Ann", "Bob"), ("Bob", "Ann")]


def brute_paths(edges, start, low, high):
    out, work = [], [(start, ())]
    while work:
        at, used = work.pop()
        if low <= len(used) and (high is None or len(used) <= high):
            out.append(at)
        if high is None or len(used) < high:
            work += [(b, (*used, (a, b))) for a, b in edges if a == at and (a, b) not in used]
    return sorted(out)


@pytest.mark.parametrize("low, high, text", [(1, None, "*"), (2, 3, "*2..3"), (0, 2, "*0..2"), (1, 8, "*1..8"), (2, 2, "*2"), (1, 3, "*..3")])
def test_repeated_hops_against_brute_force(graph, low, high, text):
    edges = [(1, 2), (2, 3), (3, 1), (1, 1)]
    names = {1: "Ann", 2: "Bob", 3: "Cy"}
    got = [r[0] for r in rows(graph, f"MATCH (a:Person {{name: 'Ann'}})-[:KNOWS{text}]->(b) RETURN b.name")]
    assert got == sorted(names[x] for x in brute_paths(edges, 1, low, high))


def test_predicates_and_nulls(graph):
    assert rows(graph, "MATCH (p:Person) WHERE p.age > 26 OR p.name ENDS WITH 'y' RETURN p.name") == [("Ann",), ("Cy",)]
    assert rows(graph, "MATCH (p:Person) WHERE NOT p.age > 26 RETURN p.name") == [("Cy",)]
    assert rows(graph, "MATCH (p:Person) WHERE p.age IN [25, 99] AND p.nope IS NULL RETURN p.name, p.nope") == [("Cy", None)]
    assert [r[0] for r in Query.parse("MATCH (p:Person) RETURN p.age ORDER BY p.age").run(graph).rows] == [25, 30, None]
    assert [r[0] for r in Query.parse("MATCH (p:Person) RETURN p.age AS a ORDER BY a DESC SKIP 1 LIMIT 1").run(graph).rows] == [30]


def test_aggregates(graph):
    assert rows(graph, "MATCH (p:Person) RETURN count(*) AS n, count(p.age) AS k, sum(p.age) AS s, avg(p.age) AS a, min(p.age) AS lo, max(p.age) AS hi") == [(3, 2, 55, 27.5, 25, 30)]
    assert rows(graph, "MATCH (p:Person) WHERE p.age > 100 RETURN count(p) AS n, sum(p.age) AS s") == [(0, 0)]
    assert [(r[0], sorted(r[1])) for r in rows(graph, "MATCH (p)-[:LIVES]->(t) RETURN t.name AS t, collect(p.age) AS ages")] == [("Xville", [30]), ("Yton", [25])]
    assert rows(graph, "MATCH (p)-[:LIVES]->(t) RETURN DISTINCT t.name") == [("Xville",), ("Yton",)]


def test_errors():
    for text in ("MATCH (c RETURN c", "CREATE (n)", "MATCH (n) RETURN", "MATCH (n) RETURN n.name LIMIT x", "MATCH (n)-[:A->(m) RETURN n", "MATCH (n) RETURN n SET n.x = 1", "MATCH (n) RETURN frob(n)", "MATCH (n) WHERE n.a = 'x RETURN n", "MATCH (a)-[*3..1]->(b) RETURN a"):
        with pytest.raises(CypherSyntaxError, match="Cypher syntax error"):
            parse(text)


def test_execution_errors(graph):
    query = Query.parse("MATCH (a)-[:BOGUS]->(b) RETURN a")
    with pytest.raises(CypherExecutionError, match="Cypher execution error"):
        query.run(graph)
    with pytest.raises(QueryError):
        Query.parse("MATCH (a:Bee) RETURN z.name").run(graph)


def test_results(graph):
    result = Query.parse("MATCH (t:Town) RETURN t.name AS town, t { .name, .label } AS m, [t] AS l ORDER BY town").run(graph)
    assert result.columns == ["town", "m", "l"] and len(result) == 2 and not result.empty
    assert next(iter(result))[0] == "Xville" and [r[0] for r in result] == ["Xville", "Yton"]
    assert result.rows[0][1].asDict() == {"name": "Xville", "label": "Town"}
    assert "2 row(s)" in result.render() and result.render().splitlines()[0].startswith("town")
    small = Query.parse("MATCH (t:Town {code: 1}) RETURN t.name AS n").run(graph)
    assert small.empty and small.columns == ["n"] and small.render("json") == "[]"
    assert json.loads(Query.parse("MATCH (t:Town {name: 'Yton'}) RETURN t.name, t.age").run(graph).render("json")) == [{"t.name": "Yton", "t.age": None}]
    with pytest.raises(ValueError, match="unknown query format"):
        result.render("xml")


def test_stale_nodes(graph):
    nodes = Query.parse("MATCH (t:Town) RETURN t").run(graph)
    names = Query.parse("MATCH (t:Town) RETURN t.name").run(graph)
    assert nodes.rows and names.rows
    town = graph.nodes[1]
    try:
        graph.nodes[1] = NodeTable("Town", town.df.where("code = 'x'"), "code", town.labels, town.props)
        graph.version += 1
        with pytest.raises(StaleNodeError):
            nodes.rows
        assert len(nodes) == 2 and names.rows and "2 row(s)" in nodes.render()
    finally:
        graph.nodes[1] = town


def test_schema(graph):
    assert {r[0] for r in graph.catalog()[0].collect()} == {"Ant", "Bee", "Person", "Town"}
    found = json.loads(Query.schema(graph, "json"))
    assert {r["type"] for r in found["relationship_types"]} == {"LIVES", "KNOWS"} and "LIVES" in Query.schema(graph, "other")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS age", "uuid() AS junk").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    g = PropertyGraph([NodeTable("P", df, "id", {"P": None}, {"age": "age", "junk": "junk"})], [])
    plan = Query.parse("MATCH (p:P) WHERE p.age > 5 RETURN p.age").run(g).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,5)" in plan and "junk" not in plan


def run(graph, text):
    return sorted(map(tuple, Query.parse(text).run(graph).rows), key=str)


def small_graph(spark, edges, key=None):
    columns = "src long, dst long" + (", way string" if key else "")
    nodes = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(8)], "id long, age long, name string")
    return PropertyGraph([NodeTable("N", nodes, "id", {"N": None}, {"id": "id", "age": "age", "name": "name"})], [EdgeTable("E", "N", "N", spark.createDataFrame(edges, columns), key=key)])


def test_average_of_distinct_values(spark):
    g = small_graph(spark, [(0, 1)])
    assert run(g, "MATCH (n:N) RETURN avg(DISTINCT n.age) AS a, avg(n.age) AS b") == [(1.0, 0.875)]
    assert run(g, "MATCH (n:N) WHERE n.age > 9 RETURN avg(DISTINCT n.age) AS a") == [(None,)]


def test_parallel_edges_with_a_key_are_two_relationships(spark):
    edges = [(0, 1, "road"), (0, 1, "rail")]
    text = "MATCH (a:N)-[:E]->(b:N)<-[:E]-(c:N) RETURN a.id, b.id, c.id"
    assert run(small_graph(spark, edges, "way"), text) == [(0, 1, 0), (0, 1, 0)]
    assert run(small_graph(spark, [e[:2] for e in edges]), text) == []


def test_reachable_ends_equal_those_of_paths(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 3), (5, 6)]
    g = small_graph(spark, edges)
    for low in ("*", "*0..", "*1.."):
        listed = {r for r in run(g, f"MATCH (a:N)-[:E{low}]->(b:N) RETURN a.id, b.id")}
        assert set(run(g, f"MATCH (a:N)-[:E{low}]->(b:N) RETURN DISTINCT a.id, b.id")) == listed
    assert run(g, "MATCH (a:N)-[:E*]->(b:N) RETURN a.id, count(DISTINCT b.id)") == [(0, 4), (1, 4), (2, 4), (3, 1), (5, 1)]


def test_where_reaches_the_first_frontier(spark, monkeypatch):
    from weftgraph.plans import compiler

    g = small_graph(spark, [(i, i + 1) for i in range(7)])
    counts = []

    def counted(df):
        counts.append(df.count())
        return df

    monkeypatch.setattr(compiler, "cut", counted)
    seen = []
    for text in ("MATCH (a:N)-[:E*]->(b:N) WHERE a.name = 'n5' AND b.age >= 0 RETURN a.id, b.id", "MATCH (a:N {name: 'n5'})-[:E*]->(b:N) RETURN a.id, b.id"):
        counts.clear()
        assert run(g, text) == [(5, 6), (5, 7)]
        seen.append(list(counts))
    assert seen[0] == seen[1] and seen[0][0] == 1


def test_tables_are_opened_when_needed(spark):
    def never():
        raise AssertionError("opened")

    ants = spark.createDataFrame([(1,)], "id long")
    g = PropertyGraph([NodeTable("Ant", ants, "id", {"Ant": None}, {"id": "id"}), NodeTable("Bee", never, "id", {"Bee": None}, {"id": "id"})], [EdgeTable("STINGS", "Bee", "Ant", never)], session=spark)
    assert run(g, "MATCH (a:Ant) RETURN a.id") == [(1,)]


def test_keys_of_several_types_meet(spark):
    a = NodeTable("A", spark.createDataFrame([(1,)], "id long"), "id", {"A": None, "Both": None}, {"id": "id"})
    b = NodeTable("B", spark.createDataFrame([("x",)], "id string"), "id", {"B": None, "Both": None}, {})
    g = PropertyGraph([a, b], [EdgeTable("L", "A", "A", spark.createDataFrame([(1, 1)], "src long, dst long"))])
    assert run(g, "MATCH (x:Both), (x:A)-[:L]->(y:A) RETURN y.id") == [(1,)]
