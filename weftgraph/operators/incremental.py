"""Changes of documents: upserts, deletes, what they invalidate, and the streaming form.

The facts of each file are a table keyed by its URI. A change drops the old file's facts, adds the
new one's, and the graph is resolved again from the facts: files are read only if their hash
changed. invalidated() tells which declarations and references a change can affect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut, empty, small
from ..sources.codegraph import CodeGraph
from ..sources.facts import facts as read_facts
from .resolve import resolve


def changed_only(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Of changes(uri, source, deleted), those that differ from documents(uri, content_hash): new, of another hash, or deleted and there."""
    hashed = changes.withColumn("new_hash", F.xxhash64("source"))
    joined = hashed.join(documents.select("uri", "content_hash"), "uri", "left")
    there = F.col("content_hash").isNotNull()
    return joined.where(F.when(F.col("deleted"), there).otherwise(~there | (F.col("content_hash") != F.col("new_hash")))).select("uri", "source", "deleted", "new_hash")


def latest(changes: DataFrame, order: str = "seq") -> DataFrame:
    """The last change of each URI by an order column."""
    rest = [c for c in changes.columns if c not in ("uri", order)]
    return changes.groupBy("uri").agg(F.max(F.struct(order, *rest)).alias("c")).select("uri", f"c.{order}", *[f"c.{c}" for c in rest])


def upsert(table: DataFrame, uris: DataFrame, new: DataFrame) -> DataFrame:
    """table without the rows of uris(uri), with new rows: the merge of a per-document table."""
    return table.join(uris.select("uri").distinct(), "uri", "left_anti").unionByName(new)


def invalidated(graph: CodeGraph, uris: DataFrame) -> DataFrame:
    """(item, name): declarations that lose or change definitions with these documents, all that descends from
    them or that they own, transitively, and the documents whose references point there."""
    touched = graph.definitions.join(uris.select("uri").distinct(), "uri", "left_semi").where("declaration IS NOT NULL").select(F.col("declaration").alias("name")).distinct()
    seen = cut(touched)
    frontier = seen
    down = graph.ancestors.where("tag = 'complete' AND name <> ancestor").select(F.col("ancestor").alias("name"), F.col("name").alias("next"))
    owned = graph.declarations.where("owner <> name").select(F.col("owner").alias("name"), F.col("name").alias("next"))
    # Edges are neither written nor made distinct: there are many times more of them than names, and one that repeats does no harm.
    edges = down.unionAll(owned)
    while not empty(frontier):
        frontier = cut(edges.join(small(frontier), "name").select(F.col("next").alias("name")).distinct().join(seen, "name", "left_anti"))
        seen = seen.unionAll(frontier)
    refs = graph.constant_references.join(seen.select(F.col("name").alias("declaration")), "declaration", "left_semi").select(F.lit("references").alias("item"), F.col("uri").alias("name")).distinct()
    return seen.select(F.lit("declaration").alias("item"), "name").unionAll(refs)


@dataclass
class Workspace:
    """Facts of all files and the graph they make; the version grows with each change that counts."""

    facts: DataFrame
    graph: CodeGraph

    @classmethod
    def index(cls, sources: DataFrame) -> Workspace:
        facts = cut(read_facts(sources))
        documents = cut(sources.select("uri", F.xxhash64("source").alias("content_hash")))
        return cls(facts, resolve(facts, documents))

    def apply(self, changes: DataFrame) -> Workspace:
        """After changes(uri, source, deleted). Unchanged contents change nothing, not even the version."""
        real = cut(changed_only(self.graph.documents, changes))
        if empty(real):
            return self
        kept = real.where("NOT deleted")
        facts = cut(upsert(self.facts, real, read_facts(kept.select("uri", "source"))))
        documents = cut(upsert(self.graph.documents, real, kept.select("uri", F.col("new_hash").alias("content_hash"))))
        new = resolve(facts, documents)
        return Workspace(facts, new.changed().__class__(**{**new.__dict__, "version": self.graph.version + 1}))

    def delete(self, uri: str) -> Workspace:
        spark = self.facts.sparkSession
        return self.apply(spark.createDataFrame([(uri, None, True)], "uri string, source string, deleted boolean"))
