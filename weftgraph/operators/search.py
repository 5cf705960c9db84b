"""Finding declarations: by query, by name, by membership, along ancestors.

Tables: declarations(name, kind, owner), members(owner, member, name), ancestors(name, pos, tag,
ancestor) with tag 'complete' or 'partial' and pos from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fuzzy_score, strip_top


def declaration_search(declarations: DataFrame, queries: list[str], mode: str = "fuzzy") -> DataFrame:
    """Declarations whose name meets any of the queries, each once; an empty query meets all."""
    if mode not in ("fuzzy", "exact"):
        raise ValueError(f"invalid match mode {mode!r}; use fuzzy or exact")
    if any(not q for q in queries):
        return declarations
    if not queries:
        return declarations.limit(0)
    tests = [F.col("name").contains(q) if mode == "exact" else fuzzy_score("name", q) > 0 for q in queries]
    return declarations.where(reduce(Column.__or__, tests))


def lookup(declarations: DataFrame, name: str) -> DataFrame:
    """The declaration of a fully qualified name; one leading '::' is accepted."""
    return declarations.where(F.col("name") == strip_top(F.lit(name)))


def member(members: DataFrame, owner: str, name: str) -> DataFrame:
    return members.where((F.col("owner") == owner) & (F.col("member") == name))


def members_in_ancestors(asks: DataFrame, declarations: DataFrame, members: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(name, member, only_inherited, found, error) for asks(name, member, only_inherited).

    found is the member's declaration in the first complete ancestor that has one; with
    only_inherited the search begins after the declaration itself in its chain.
    """
    own = ancestors.where("tag = 'complete'")
    self_pos = own.where("name = ancestor").select("name", F.col("pos").alias("self_pos"))
    reach = asks.join(own, "name").join(self_pos, "name", "left").where("NOT only_inherited OR pos > coalesce(self_pos, -1)")
    held = members.select(F.col("owner").alias("ancestor"), "member", F.col("name").alias("found"))
    hits = reach.join(held, ["ancestor", "member"]).groupBy("name", "member", "only_inherited").agg(F.min_by("found", "pos").alias("found"))
    known = declarations.select("name", F.lit(True).alias("known"))
    spaces = ancestors.select("name").distinct().withColumn("space", F.lit(True))
    out = asks.join(hits, ["name", "member", "only_inherited"], "left").join(known, "name", "left").join(spaces, "name", "left")
    error = F.when(F.col("found").isNotNull(), F.lit(None)).when(F.col("known").isNull(), "DeclarationNotFound").when(F.col("space").isNull(), "NotNamespace").otherwise("MemberNotFound")
    return out.select("name", "member", "only_inherited", "found", error.alias("error"))


def ancestors_of(ancestors: DataFrame, names: DataFrame) -> DataFrame:
    """(name, chain): the complete ancestors of names(name) in their order, joined by blanks."""
    own = ancestors.where("tag = 'complete'").join(names.select("name").distinct(), "name", "left_semi")
    return own.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ancestor"))), lambda x: x["ancestor"]), " ").alias("chain"))


def has_ancestor(ancestors: DataFrame, names: list[str]) -> DataFrame:
    """(name, has): whether any of the names is in the chain."""
    test = F.max(F.coalesce((F.col("tag") == "complete") & F.col("ancestor").isin(names), F.lit(False)))
    return ancestors.groupBy("name").agg(test.alias("has"))


def descendants(ancestors: DataFrame) -> DataFrame:
    """(name, descendant): the inverse of the chains, with each declaration its own descendant.

    Pairs meet before they are made distinct: hardly any repeats, so a task would only hold all that it reads to find none.
    """
    return ancestors.where("tag = 'complete'").select(F.col("ancestor").alias("name"), F.col("name").alias("descendant")).repartition("name", "descendant").distinct()


def require_paths(documents: DataFrame, load_paths: DataFrame) -> DataFrame:
    """(require_path, uri, idx): how each document under a load path(idx, path) is required; of equal paths the first load path's."""
    from ..functions.names import require_path, uri_path

    own = documents.select("uri", uri_path("uri").alias("file")).where(F.col("file").endswith(".rb"))
    # Each folder that the file is in, so that it meets the load paths by equality.
    folders = F.expr("transform(sequence(1, size(split(file, '/')) - 1), i -> array_join(slice(split(file, '/'), 1, i), '/'))")
    roots = load_paths.select("idx", "path", F.regexp_replace("path", "/+$", "").alias("folder"))
    pairs = own.withColumn("folder", F.explode(folders)).join(roots, "folder")
    pairs = pairs.select(require_path(F.col("file"), F.col("path")).alias("require_path"), "uri", "idx")
    return pairs.groupBy("require_path").agg(F.min_by("uri", F.struct("idx", "uri")).alias("uri"), F.min("idx").alias("idx"))


def resolve_require(documents: DataFrame, load_paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, uri) for wanted(path): the document of the first load path that has it, null if none does."""
    bare = wanted.withColumn("require_path", F.regexp_replace("path", "(\\.rb)+$", ""))
    return bare.join(require_paths(documents, load_paths), "require_path", "left").select("path", "uri")


def page(df: DataFrame, offset: int = 0, limit: int = 50, most: int = 100, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """A page in the order of `by`, with the total of all rows: offset at least 0, limit 50 unless over 0, at most `most`."""
    limit = min(limit if limit > 0 else 50, most)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.crossJoin(F.broadcast(total)).orderBy(*by).offset(max(0, offset)).limit(limit)
