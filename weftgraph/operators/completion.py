"""Completion candidates: ranked frames, united, then the first of each member name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from .aliases import CONSTANTS, callable_methods

KEYWORDS = (
    "BEGIN END __ENCODING__ __FILE__ __LINE__ alias and begin break case class def defined? do else elsif end ensure false for if in module next "
    "nil not or redo rescue retry return self super then true undef unless until when while yield"
).split()


def first_of_each(ranked: DataFrame) -> DataFrame:
    """One row for each member of ranked(member, name, kind, rank, ...): that of the least rank."""
    rest = [c for c in ranked.columns if c != "member"]
    return ranked.groupBy("member").agg(F.min(F.struct("rank", *[c for c in rest if c != "rank"])).alias("best")).select("member", *[f"best.{c}" for c in rest])


def along(name: str, step: int, ancestors: DataFrame, members: DataFrame, declarations: DataFrame, kinds: tuple[str, ...], before: str | None = None) -> DataFrame:
    """(member, name, kind, rank, owner): members of the kinds in the chain of a name, ranked by step and position; before: up to an ancestor."""
    chain = ancestors.where((F.col("name") == name) & (F.col("tag") == "complete")).select("pos", F.col("ancestor").alias("owner"))
    if before:
        stop = chain.where(F.col("owner") == before).agg(F.min("pos").alias("stop"))
        chain = chain.crossJoin(stop).where("stop IS NULL OR pos < stop").drop("stop")
    held = chain.join(members.withColumnRenamed("name", "declaration"), "owner")
    typed = held.join(declarations.select(F.col("name").alias("declaration"), "kind"), "declaration").where(F.col("kind").isin(*kinds))
    return typed.select("member", F.col("declaration").alias("name"), "kind", F.struct(F.lit(step).alias("step"), "pos").alias("rank"), "owner")


def expression(self_name: str, nesting: list[str], ancestors: DataFrame, members: DataFrame, declarations: DataFrame) -> DataFrame:
    """What can be written bare: constants of the innermost scope's chain, of the outer scopes, of Object for modules; class
    variables; globals; methods and instance variables of self's chain; keywords. (member, name, kind)"""
    spark = declarations.sparkSession
    inner = nesting[-1] if nesting else "Object"
    parts = [along(inner, 0, ancestors, members, declarations, CONSTANTS)]
    module = declarations.where((F.col("name") == inner) & F.col("kind").isin("Module", "<TODO>")).limit(1).count() > 0
    if module:
        parts.append(along("Object", 1, ancestors, members, declarations, CONSTANTS))
    for k, outer in enumerate(reversed(nesting[:-1])):
        own = members.where(F.col("owner") == outer).withColumnRenamed("name", "declaration")
        typed = own.join(declarations.select(F.col("name").alias("declaration"), "kind"), "declaration").where(F.col("kind").isin(*CONSTANTS))
        parts.append(typed.select("member", F.col("declaration").alias("name"), "kind", F.struct(F.lit(2).alias("step"), F.lit(k).alias("pos")).alias("rank"), "owner"))
    lexical = next((n for n in reversed(nesting) if not n.endswith(">")), None)
    if lexical:
        parts.append(along(lexical, 3, ancestors, members, declarations, ("ClassVariable",)))
    globals_ = members.where("owner = 'Object'").withColumnRenamed("name", "declaration").join(declarations.where("kind IN ('GlobalVariable', 'GlobalVariableAlias')").select(F.col("name").alias("declaration"), "kind"), "declaration")
    parts.append(globals_.select("member", F.col("declaration").alias("name"), "kind", F.struct(F.lit(4).alias("step"), F.lit(0).alias("pos")).alias("rank"), "owner"))
    parts.append(along(self_name, 5, ancestors, members, declarations, ("Method", "InstanceVariable")))
    words = spark.createDataFrame([(w,) for w in KEYWORDS], "member string").select("member", F.col("member").alias("name"), F.lit("Keyword").alias("kind"), F.struct(F.lit(6).alias("step"), F.lit(0).alias("pos")).alias("rank"), F.lit(None).cast("string").alias("owner"))
    return first_of_each(reduce(DataFrame.unionAll, [*parts, words])).select("member", "name", "kind")


def namespace_access(name: str, singleton: str | None, caller: str | None, ancestors: DataFrame, members: DataFrame, declarations: DataFrame, visibilities: DataFrame, descendants: DataFrame) -> DataFrame:
    """What can follow 'Name::': constants up to Object that aren't private, then the singleton's visible methods."""
    constants = along(name, 0, ancestors, members, declarations, CONSTANTS, before="Object")
    if callable(visibilities):
        constants = cut(constants)
        shown = visibilities(constants.select("name"))
    else:
        shown = visibilities.select("name", "visibility")
    constants = constants.join(shown, "name", "left").where("coalesce(visibility, 'public') <> 'private'").drop("visibility")
    parts = [constants.select("member", "name", "kind", "rank")]
    if singleton:
        parts.append(call(singleton, caller, ancestors, members, declarations, visibilities, descendants, step=1))
    return first_of_each(reduce(DataFrame.unionAll, parts)).select("member", "name", "kind")


def call(receiver: str, caller: str | None, ancestors: DataFrame, members: DataFrame, declarations: DataFrame, visibilities: DataFrame, descendants: DataFrame, step: int = 0) -> DataFrame:
    """Methods that the caller may call on the receiver: (member, name, kind, rank).

    The first of each name counts before visibility is looked at, so a private method hides an inherited public one.
    visibilities: a table, or what makes it for a table of names.
    """
    first = cut(first_of_each(along(receiver, step, ancestors, members, declarations, ("Method",))))
    seen = visibilities(first.select("name")) if callable(visibilities) else visibilities
    descendants = descendants.where(F.col("descendant").isin([x for x in (receiver, caller) if x is not None]))
    asks = first.join(seen, "name", "left").select("member", "name", "kind", "rank", "visibility", F.col("owner").alias("defined_in"), F.lit(receiver).alias("receiver"), F.lit(caller).cast("string").alias("caller"))
    return callable_methods(asks, descendants).where("visible").select("member", "name", "kind", "rank")


def argument(method: str, definitions: DataFrame, *rest) -> DataFrame:
    """What can be written as an argument: everything bare, and the method's keyword parameters as 'name:'."""
    own = definitions.where((F.col("declaration") == method) & (F.col("kind") == "Method"))
    first = own.agg(F.min_by("params", "ord").alias("params")).select(F.explode("params").alias("p")).where("p.kind IN ('required_keyword', 'optional_keyword')")
    keywords = first.select(F.concat("p.name", F.lit(":")).alias("member"), F.lit(method).alias("name"), F.lit("KeywordParameter").alias("kind")).distinct()
    return expression(*rest).unionAll(keywords)
