"""Answers of the tool endpoints, as DataFrames, and their error records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import comment_text, uri_path
from ..functions.shared import cut, small
from .search import declaration_search, page


class ToolError(Exception):
    def __init__(self, error: str, message: str = "", suggestion: str = "") -> None:
        super().__init__(message or error)
        self.record = {k: v for k, v in (("error", error), ("message", message), ("suggestion", suggestion)) if v}


def locations(definitions: DataFrame) -> DataFrame:
    """(name, locations): 'path:line' of a declaration's definitions, in order."""
    place = F.struct("ord", F.concat(uri_path("uri"), F.lit(":"), "line").alias("at"))
    return definitions.where("declaration IS NOT NULL").groupBy(F.col("declaration").alias("name")).agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["at"]).alias("locations"))


def _of(definitions: DataFrame, names: DataFrame) -> DataFrame:
    """The definitions of a page of names(name), so that no others are grouped."""
    return definitions.join(small(names).withColumnRenamed("name", "declaration"), "declaration", "left_semi")


def search_declarations(declarations: DataFrame, definitions: DataFrame, query: str, kind: str | None = None, match_mode: str = "fuzzy", limit: int = 50, offset: int = 0) -> DataFrame:
    """(name, kind, locations, total)."""
    if match_mode not in ("fuzzy", "exact"):
        raise ToolError("invalid_match_mode", f"{match_mode} is not fuzzy or exact")
    found = declaration_search(declarations, [query], match_mode).select("name", "kind")
    if kind:
        found = found.where(F.lower("kind") == kind.lower())
    shown = cut(page(found, offset, limit, 100))
    return shown.join(locations(_of(definitions, shown.select("name"))), "name", "left").select("name", "kind", "locations", "total").orderBy("name")


def get_declaration(name: str, declarations: DataFrame, definitions: DataFrame, ancestors: DataFrame, members: DataFrame) -> DataFrame:
    """One row: name, kind, definitions(path, line, comments), ancestors, members(name, kind, location)."""
    own = declarations.where(F.col("name") == name)
    if not own.limit(1).count():
        raise ToolError("not_found", f"no declaration {name}", "search for part of the name")
    defs = definitions.where(F.col("declaration") == name).agg(F.array_sort(F.collect_list(F.struct("ord", uri_path("uri").alias("path"), "line", F.transform("comments", comment_text).alias("comments")))).alias("definitions"))
    chain = ancestors.where((F.col("name") == name) & (F.col("tag") == "complete")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ancestor"))), lambda x: x["ancestor"]).alias("ancestors"))
    held = members.where(F.col("owner") == name).select(F.col("name").alias("m")).join(declarations.select(F.col("name").alias("m"), F.col("kind").alias("k")), "m")
    held = cut(held)
    held = held.join(locations(_of(definitions, held.select(F.col("m").alias("name")))).withColumnRenamed("name", "m"), "m", "left")
    listed = held.agg(F.array_sort(F.collect_list(F.struct(F.col("m").alias("name"), F.col("k").alias("kind"), F.try_element_at("locations", F.lit(1)).alias("location")))).alias("members"))
    return own.select("name", "kind").crossJoin(defs).crossJoin(chain).crossJoin(listed)


def codebase_stats(documents: DataFrame, declarations: DataFrame, definitions: DataFrame, constants: DataFrame, methods: DataFrame) -> DataFrame:
    """One row of counts, with declarations by kind as a map."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    kinds = declarations.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("breakdown_by_kind"))
    out = n(documents, "files").crossJoin(n(declarations, "declarations")).crossJoin(n(definitions, "definitions"))
    return out.crossJoin(n(constants, "constant_references")).crossJoin(n(methods, "method_references")).crossJoin(kinds)


def get_descendants(name: str, declarations: DataFrame, descendants: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """(name, kind, total)."""
    own = declarations.where(F.col("name") == name).select("kind").first()
    if own is None:
        raise ToolError("not_found", f"no declaration {name}")
    if own["kind"] not in ("Class", "Module", "SingletonClass"):
        raise ToolError("invalid_kind", f"{name} is a {own['kind']}")
    below = descendants.where(F.col("name") == name).select(F.col("descendant").alias("name"))
    return page(declarations.select("name", "kind").join(below, "name", "left_semi"), offset, limit, 500)


def find_constant_references(name: str, references: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """(path, line, column, total)."""
    own = references.where(F.col("declaration") == name).select(uri_path("uri").alias("path"), "line", "column")
    return page(own, offset, limit, 200, ("path", "line", "column"))


def get_file_declarations(path: str, workspace: str, definitions: DataFrame) -> DataFrame:
    """(name, kind, line) of the definitions in a file that have a declaration."""
    full = path if path.startswith("/") else f"{workspace.rstrip('/')}/{path}"
    own = definitions.where((uri_path("uri") == full) & F.col("declaration").isNotNull())
    return own.orderBy("start", "id").select(F.col("declaration").alias("name"), "kind", "line")
