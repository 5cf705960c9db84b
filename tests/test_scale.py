"""What keeps the code-graph queries within bounds on large tables, on small ones."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.shared import cut
from weftgraph.graph import EdgeTable, NodeTable, PropertyGraph
from weftgraph.operators import aliases, incremental, linearize, resolve, search, tools
from weftgraph.plans import catalogue, code_queries, compiler
from weftgraph.plans.query import cypher
from weftgraph.sources.codegraph import CodeGraph
from weftgraph.sources.facts import facts
from weftgraph.sources.tables import read


def test_files_of_one_partition_are_read_in_several_tasks(spark):
    files = spark.range(0, 200, 1, 1).select(F.concat(F.lit("file:///w/f"), "id", F.lit(".rb")).alias("uri"), F.concat(F.lit("class C"), "id", F.lit("; end\n")).alias("source"))
    read = facts(files)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert read.count() == 200 and read.select("path").distinct().count() == 200


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Small tables with keys that repeat or are missing."""
    d = tmp_path_factory.mktemp("odd")
    put = lambda name, kinds, rows: spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    put("part", "p_partkey long, p_brand string, p_size int", [(k, f"Brand#{k % 3}", k % 50 + 1) for k in range(60)] + [(4, "Brand#1", 5), (7, "Brand#9", 7), (None, "Brand#1", 5), (70, None, None)])
    put("supplier", "s_suppkey long", [(k,) for k in range(9)] + [(2,), (None,)])
    put("nation", "n_nationkey int", [(k,) for k in range(5)] + [(1,), (None,)])
    put("customer", "c_custkey long", [(k,) for k in range(120)])
    put("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(o, o % 61, o % 9, o % 5) for o in range(200)] * 2 + [(1, None, 1, 1), (2, 1, None, 2), (3, 1, 1, None)])
    put("events", "event_id long, user_id long, event_type string", [(1, 1, "error")])
    return str(d)


@pytest.mark.parametrize("name", ["pm", "sm", "members", "anc", "docs"])
def test_shorter_ways_give_the_same_tables(spark, odd, name):
    t = catalogue.Code(spark, odd)
    sources = {x: read(spark, odd, x) for x in catalogue.TABLES if x != "region"}
    count = lambda df: {tuple(r): n for *r, n in map(tuple, df.groupBy(*df.columns).count().collect())}
    got = t.sql(catalogue.SPARK[name]) if name == "sm" else t.table(name)
    assert got.count() and count(got) == count(spark.sql(catalogue.text(f"SELECT * FROM {name}"), **sources))


def test_a_query_writes_only_the_tables_that_it_needs(spark, odd):
    made = lambda: {k[2] for k in catalogue._written if k[1] == where}
    where = odd + "/."
    assert code_queries.QUERIES["code_documents"](spark, where).count() and made() == {"docs", "pm"}
    where = odd + "/./."
    assert code_queries.QUERIES["members"](spark, where).count() >= 0 and made() == {"decls", "members", "pm"}


class _Unopened(CodeGraph):
    definitions = property(lambda self: pytest.fail("definitions aren't needed"))


def test_no_definitions_are_opened_for_names_and_kinds(spark, odd):
    t = catalogue.Code(spark, odd)
    g = _Unopened.__new__(_Unopened)
    for k, v in {"documents": t.table("docs"), "declarations": t.decls, "ancestors": t.anc}.items():
        object.__setattr__(g, k, v)
    assert cypher(g.property_graph(), "MATCH (a:Namespace)-[:HAS_DESCENDANT]->(b) RETURN a.name AS name, count(b) AS n").count()


def test_edges_of_repeated_hops_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(compiler, "cut", lambda df: made.append(df.columns) or cut(df))
    nodes = NodeTable("N", spark.range(6), "id", {"N": None}, {"id": "id"})
    edges = EdgeTable("E", "N", "N", spark.range(5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    found = cypher(PropertyGraph([nodes], [edges]), "MATCH (a:N)-[:E*1..]->(b:N) RETURN DISTINCT a.id AS a, b.id AS b")
    assert found.count() == 15 and made.count(["src", "dst"]) == 1


def test_pairs_meet_before_they_are_made_distinct(spark):
    anc = spark.createDataFrame([("A", 0, "complete", "A"), ("A", 1, "complete", "B"), ("A", 1, "complete", "B")], "name string, pos int, tag string, ancestor string")
    found = search.descendants(anc)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and "Exchange" not in plan[: plan.index("HashAggregate")] and plan.rindex("HashAggregate") < plan.index("Exchange")


def test_edges_of_a_closure_are_not_written(spark, odd, monkeypatch):
    made = []
    monkeypatch.setattr(incremental, "cut", lambda df: made.append(df.columns) or cut(df))
    found = incremental.invalidated(catalogue.Code(spark, odd).graph, spark.createDataFrame([("file:///w/lib/B1.rb",)], "uri string"))
    assert found.count() and ["name", "next"] not in made


def test_only_definitions_of_a_page_are_grouped(spark, odd, monkeypatch):
    grouped = []
    monkeypatch.setattr(tools, "locations", lambda df, real=tools.locations: grouped.append(df.select("declaration").distinct().count()) or real(df))
    t = catalogue.Code(spark, odd)
    assert tools.search_declarations(t.decls, t.defs, "P", "class", limit=3).count() == 3 and grouped == [3]


def test_kinds_of_alias_targets_are_looked_up_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(aliases, "cut", lambda df: made.append(df._jdf.queryExecution().optimizedPlan().toString().count("kind#") > 0) or cut(df))
    defs = cut(spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("D", "K"), ("E", "F"), ("F", "E"), ("G", "None"), ("H", None)], "declaration string, target string").selectExpr("declaration", "target", "'ConstantAlias' AS kind", "0 AS ord"))
    spark.createDataFrame([(x, "ConstantAlias") for x in "ABCDEFGH"] + [("K", "Class")], "name string, kind string").write.parquet(f"{tmp_path}/decls")
    found = {r["name"]: r["resolved"] for r in aliases.resolve_aliases(defs, spark.read.parquet(f"{tmp_path}/decls")).collect()}
    assert found == {"A": "K", "B": "K", "C": "K", "D": "K", "E": None, "F": None, "G": None, "H": None}
    assert sum(made) <= 2  # the targets' kinds and the aliases; no round reads kinds


def test_names_found_in_a_scope_are_not_sought_along_chains(spark):
    asks = spark.createDataFrame([(["M", "M::C"], x) for x in ("X", "Y", "Z", "C", "::T", "Y::X", "No")] + [([], "T"), (["M"], "T")], "nesting array<string>, path string")
    members = spark.createDataFrame([("M", "C", "M::C"), ("M::C", "X", "M::C::X"), ("M", "Y", "M::Y"), ("S", "Y", "S::Y"), ("S", "Z", "S::Z"), ("Object", "T", "T"), ("M::Y", "X", "M::Y::X")], "owner string, member string, name string")
    chain = [("M::C", "M::C"), ("M::C", "S"), ("M::C", "Object"), ("M", "M"), ("Object", "Object"), ("M::Y", "M::Y")]
    anc = spark.createDataFrame([(a, k, "complete", b) for k, (a, b) in enumerate(chain)], "name string, pos int, tag string, ancestor string")
    kinds = spark.createDataFrame([("M", "Module", "complete"), ("M::C", "Class", "complete")], "name string, kind string, state string")
    found = resolve.lookup_names(asks, members, anc, kinds, spark.createDataFrame([], "name string, resolved string"))
    got = {(" ".join(r["nesting"]), r["path"]): r["found"] for r in found.collect()}
    deep = "M M::C"
    assert got == {(deep, "X"): "M::C::X", (deep, "Y"): "M::Y", (deep, "Z"): "S::Z", (deep, "C"): "M::C", (deep, "::T"): "T", (deep, "Y::X"): "M::Y::X", ("", "T"): "T", ("M", "T"): "T"}


def test_a_round_of_chains_is_one_join(spark):
    waiting = spark.createDataFrame([("A", "Class", "B", [(1, "include", "M"), (0, "prepend", "N")]), ("C", "Class", "A", []), ("D", "Module", None, [])], "name string, kind string, superclass string, mixins array<struct<ord: int, k: string, m: string>>")
    chains = spark.createDataFrame([("B", ["B"], "complete"), ("M", ["M"], "partial"), ("N", ["N"], "complete")], "name string, chain array<string>, state string")
    step = linearize._round(waiting, chains)
    assert step._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert {r["name"]: (r["chain"], r["state"]) for r in step.collect()} == {"A": (["N", "A", "M", "B"], "partial"), "C": (None, None), "D": (["D"], "complete")}
