"""Code graphs: the tables and their property-graph view."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import unqualified, uri_name, uri_path
from ..functions.shared import cut
from ..graph import EdgeTable, NodeTable, PropertyGraph

SCHEMAS = {
    "documents": "uri string, content_hash long",
    "definitions": "id long, uri string, kind string, declaration string, ord int, start int, end int, line int, str string, old_str string, target string, visibility string, deprecated boolean, comments array<string>, params array<struct<kind: string, name: string>>, superclass string, mixins array<struct<kind: string, target: string>>, parent long",
    "declarations": "name string, kind string, owner string, singleton string",
    "members": "owner string, member string, name string",
    "ancestors": "name string, state string, pos int, tag string, ancestor string",
    "constant_references": "uri string, start int, end int, line int, column int, path string, declaration string",
    "method_references": "uri string, start int, end int, message string, receiver string, declaration string",
    "diagnostics": "rule string, uri string, start int, end int, line int, message string",
}
NAMESPACES = ("Class", "Module", "SingletonClass", "<TODO>")
DECLARATION_LABELS = ("Class", "Module", "SingletonClass", "Constant", "ConstantAlias", "Method", "GlobalVariable", "InstanceVariable", "ClassVariable")


@dataclass(frozen=True)
class CodeGraph:
    documents: DataFrame
    definitions: DataFrame
    declarations: DataFrame
    members: DataFrame
    ancestors: DataFrame
    constant_references: DataFrame
    method_references: DataFrame
    diagnostics: DataFrame
    version: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    @property
    def descendants(self) -> DataFrame:
        from ..operators.search import descendants

        return descendants(self.ancestors)

    def changed(self, **tables: DataFrame) -> CodeGraph:
        return replace(self, version=self.version + 1, **tables)

    @classmethod
    def empty(cls, spark: SparkSession) -> CodeGraph:
        return cls(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})

    def property_graph(self) -> PropertyGraph:
        """The graph that Cypher queries run on: Document, Definition and Declaration nodes, eleven relationship types. Each table is made when a query needs it."""
        from ..operators.aliases import resolve_aliases, visibility

        linked = lambda: self.definitions.where("declaration IS NOT NULL")

        def spaces() -> DataFrame:
            return self.declarations.where(F.col("kind").isin(*NAMESPACES)).select(F.col("name").alias("dst"))

        def documents() -> DataFrame:
            return self.documents.select("uri", uri_path("uri").alias("path"), uri_name("uri").alias("name"))

        def declarations() -> DataFrame:
            return self.declarations.select("name", "kind", unqualified("name").alias("unqualified_name"))

        def counted(df: DataFrame) -> DataFrame:
            counts = linked().groupBy(F.col("declaration").alias("name")).agg(F.count("*").alias("definition_count"))
            return df.join(counts, "name", "left").withColumn("definition_count", F.coalesce("definition_count", F.lit(0)))

        def seen(df: DataFrame) -> DataFrame:
            return df.join(visibility(self.declarations, self.definitions), "name", "left")

        def definitions() -> DataFrame:
            return self.definitions.select("id", "kind", F.coalesce("declaration", F.lit("")).alias("name"), F.col("uri").alias("file"), "line")

        @cache
        def followed() -> DataFrame | None:
            if not self.definitions.where("kind = 'ConstantAlias'").limit(1).count():
                return None
            return cut(resolve_aliases(self.definitions, self.declarations).where("resolved IS NOT NULL").select(F.col("name").alias("dst"), "resolved"))

        def to_namespace(df: DataFrame) -> DataFrame:
            """(src, dst) with aliases followed to a namespace."""
            real = followed()
            if real is not None:
                df = df.join(real, "dst", "left").select("src", F.coalesce("resolved", "dst").alias("dst"))
            return df.join(spaces(), "dst", "left_semi").distinct().select("src", "dst")

        def mixed(kind: str) -> DataFrame:
            each = linked().select(F.col("declaration").alias("src"), F.explode("mixins").alias("x"))
            return to_namespace(each.where(F.col("x.kind") == kind).select("src", F.col("x.target").alias("dst")))

        def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
            return df.select(F.col(a).alias("src"), F.col(b).alias("dst"))

        of_kind = lambda *k: lambda: F.col("kind").isin(*k)
        labels = {k: of_kind(k) for k in DECLARATION_LABELS} | {"Namespace": of_kind(*NAMESPACES), "Declaration": None, "Todo": of_kind("<TODO>")}
        nodes = [
            NodeTable("Document", documents, "uri", {"Document": None}, {"uri": "uri", "path": "path", "name": "name"}),
            NodeTable("Definition", definitions, "id", {"Definition": None}, {"name": "name", "file": "file", "line": "line"}, "kind"),
            NodeTable("Declaration", declarations, "name", labels, {p: p for p in ("name", "unqualified_name", "visibility", "definition_count")}, "kind", {"definition_count": counted, "visibility": seen}),
        ]
        chain = lambda: self.ancestors.where("tag = 'complete' AND name <> ancestor")
        among = lambda kind, source: EdgeTable(kind, "Declaration", "Declaration", source)
        edges = [
            EdgeTable("DEFINES", "Document", "Definition", lambda: pairs(self.definitions, "uri", "id")),
            EdgeTable("DECLARES", "Definition", "Declaration", lambda: pairs(linked(), "id", "declaration")),
            EdgeTable("CONTAINS", "Definition", "Definition", lambda: pairs(self.definitions.where("parent IS NOT NULL"), "parent", "id")),
            among("HAS_PARENT", lambda: to_namespace(pairs(linked().where("superclass IS NOT NULL"), "declaration", "superclass"))),
            *(among(t, lambda k=k: mixed(k)) for t, k in (("INCLUDES", "include"), ("PREPENDS", "prepend"), ("EXTENDS", "extend"))),
            among("OWNS", lambda: pairs(self.members, "owner", "name")),
            among("HAS_ANCESTOR", lambda: pairs(chain(), "name", "ancestor")),
            among("HAS_DESCENDANT", lambda: pairs(self.descendants, "name", "descendant")),
            EdgeTable("REFERENCES", "Document", "Declaration", lambda: pairs(self.constant_references.where("declaration IS NOT NULL"), "uri", "declaration").distinct()),
        ]
        return PropertyGraph(nodes, edges, self.version, session=self.spark)
