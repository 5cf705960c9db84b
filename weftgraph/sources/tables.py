"""The star-schema tables as a property graph."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import EdgeTable, NodeTable, PropertyGraph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(name: str, source, key: str, props: dict[str, str], group: str | None = None) -> NodeTable:
    return NodeTable(name, source, key, {name: None} | ({group: None} if group else {}), props)


def _edge(kind: str, src: str, dst: str, source, a: str, b: str) -> EdgeTable:
    return EdgeTable(kind, src, dst, lambda: source().select(F.col(a).alias("src"), F.col(b).alias("dst")))


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The tables as nodes, their keys as edges. A table is opened when a query needs it."""
    t = {n: cache(lambda n=n: read(spark, sf_dir, n)) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")}

    @cache
    def turns():
        return t["conversations"]().withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))

    nodes = [
        _node("Region", t["region"], "r_regionkey", {"name": "r_name"}, "Place"),
        _node("Nation", t["nation"], "n_nationkey", {"name": "n_name"}, "Place"),
        _node("Customer", t["customer"], "c_custkey", {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment", "id": "c_custkey"}, "Party"),
        _node("Supplier", t["supplier"], "s_suppkey", {"name": "s_name", "acctbal": "s_acctbal", "id": "s_suppkey"}, "Party"),
        _node("Part", t["part"], "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice", "id": "p_partkey"}),
        _node("Order", t["orders"], "o_orderkey", {"status": "o_orderstatus", "totalprice": "o_totalprice", "priority": "o_orderpriority", "orderdate": "o_orderdate", "id": "o_orderkey"}),
        _node("Event", t["events"], "event_id", {"event_type": "event_type", "value": "value", "ts": "ts", "props": "props", "id": "event_id"}),
        _node("Doc", t["documents"], "doc_id", {"lang": "lang", "source": "source", "n_chars": "n_chars", "id": "doc_id"}),
        _node("Turn", turns, "turn_id", {"role": "role", "turn": "turn", "conv": "conv_id", "name": "turn_id"}),
        _node("Page", t["pages"], "page_id", {"url": "url", "id": "page_id"}),
    ]

    def supplies():
        return t["lineitem"]().select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()

    def refers():
        return t["lineitem"]().select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()

    def follows():
        after = turns().select(F.col("turn_id").alias("a"), F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("n"))
        return after.join(turns().select("conv_id", "turn", F.col("turn_id").alias("b")), (F.col("c") == F.col("conv_id")) & (F.col("n") == F.col("turn")))

    def chain():
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return t["events"]().select(F.col("event_id").alias("a"), F.lead("event_id").over(order).alias("b")).where("b IS NOT NULL")

    edges = [
        _edge("OWNS", "Region", "Nation", t["nation"], "n_regionkey", "n_nationkey"),
        _edge("OWNS", "Nation", "Customer", t["customer"], "c_nationkey", "c_custkey"),
        _edge("OWNS", "Customer", "Order", t["orders"], "o_custkey", "o_orderkey"),
        _edge("HAS_PARENT", "Nation", "Region", t["nation"], "n_nationkey", "n_regionkey"),
        _edge("HAS_PARENT", "Customer", "Nation", t["customer"], "c_custkey", "c_nationkey"),
        _edge("HAS_PARENT", "Order", "Customer", t["orders"], "o_orderkey", "o_custkey"),
        _edge("SUPPLIES", "Supplier", "Part", supplies, "a", "b"),
        _edge("REFERENCES", "Order", "Part", refers, "a", "b"),
        _edge("DEFINES", "Customer", "Order", t["orders"], "o_custkey", "o_orderkey"),
        _edge("PERFORMED", "Customer", "Event", t["events"], "user_id", "event_id"),
        _edge("NEXT", "Turn", "Turn", follows, "a", "b"),
        _edge("NEXT_EVENT", "Event", "Event", chain, "a", "b"),
    ]
    return PropertyGraph(nodes, edges, session=spark)
