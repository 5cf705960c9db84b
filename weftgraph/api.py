"""A code graph as one object with the operators as methods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aliases, completion, lint, reports, resolve, search
from .operators.incremental import Workspace
from .plans.query import Query, Result
from .sources.codegraph import CodeGraph
from .sources.files import list_files


@dataclass
class Graph:
    """Every method gives a DataFrame unless said otherwise. apply() and delete() give a new graph."""

    tables: CodeGraph
    workspace: Workspace | None = None

    @classmethod
    def index(cls, sources: DataFrame) -> Graph:
        """From sources(uri, source)."""
        own = Workspace.index(sources)
        return cls(own.graph, own)

    @classmethod
    def index_paths(cls, spark: SparkSession, paths: list[str], exclude: list[str] = ()) -> tuple[Graph, list[dict]]:
        """(the graph of the files under the paths, errors for paths that aren't there)."""
        files, errors = list_files(spark, paths, exclude)
        return cls.index(files.select("uri", "source")), errors

    def apply(self, changes: DataFrame) -> Graph:
        """After changes(uri, source, deleted)."""
        if self.workspace is None:
            raise ValueError("a graph without its sources can't be changed")
        own = self.workspace.apply(changes)
        return self if own is self.workspace else Graph(own.graph, own)

    def delete(self, uri: str) -> Graph:
        return self.apply(self.tables.documents.sparkSession.createDataFrame([(uri, None, True)], "uri string, source string, deleted boolean"))

    def query(self, text: str) -> Result:
        """The result of a Cypher query."""
        return Query.parse(text).run(self.tables.property_graph())

    def search(self, *queries: str, mode: str = "fuzzy") -> DataFrame:
        return search.declaration_search(self.tables.declarations, list(queries), mode)

    def __getitem__(self, name: str) -> DataFrame:
        return search.lookup(self.tables.declarations, name)

    def member(self, owner: str, name: str) -> DataFrame:
        return search.member(self.tables.members, owner, name)

    def members(self, owner: str) -> DataFrame:
        return self.tables.members.where(F.col("owner") == owner)

    def owner(self, name: str) -> DataFrame:
        """(name, kind, owner) of a declaration's owner."""
        own = self[name].select(F.col("owner").alias("name"))
        return self.tables.declarations.join(own, "name", "left_semi").select("name", "kind", "owner")

    def singleton(self, name: str) -> DataFrame:
        """(name, kind, owner) of a declaration's singleton class."""
        own = self[name].select(F.col("singleton").alias("name"))
        return self.tables.declarations.join(own, "name", "left_semi").select("name", "kind", "owner")

    def attached(self, singleton: str) -> DataFrame:
        """(name, kind, owner) of what a singleton class belongs to."""
        return self.tables.declarations.where(F.col("singleton") == singleton).select("name", "kind", "owner")

    def ancestors(self, name: str) -> DataFrame:
        return self.tables.ancestors.where(F.col("name") == name).orderBy("pos")

    def descendants(self, name: str) -> DataFrame:
        return self.tables.descendants.where(F.col("name") == name).select("descendant")

    def has_ancestor(self, *names: str) -> DataFrame:
        return search.has_ancestor(self.tables.ancestors, list(names))

    def find_member(self, name: str, member: str, only_inherited: bool = False) -> DataFrame:
        asks = self.tables.members.sparkSession.createDataFrame([(name, member, only_inherited)], "name string, member string, only_inherited boolean")
        return search.members_in_ancestors(asks, self.tables.declarations, self.tables.members, self.tables.ancestors)

    def resolve_constant(self, name: str, nesting: list[str] = ()) -> DataFrame:
        """(nesting, path, found) of a name as it stands in scopes, outermost first; no row if nothing is found."""
        t = self.tables
        asks = t.members.sparkSession.createDataFrame([(list(nesting), name)], "nesting array<string>, path string")
        states = t.ancestors.select("name", "state").distinct()
        known = aliases.resolve_aliases(t.definitions, t.declarations).where("resolved IS NOT NULL")
        return resolve.lookup_names(asks, t.members, t.ancestors, t.declarations.select("name", "kind").join(states, "name", "left"), known)

    def references(self, name: str) -> DataFrame:
        return self.tables.constant_references.where(F.col("declaration") == name)

    def unresolved(self) -> DataFrame:
        """Constant references that no declaration was found for."""
        return self.tables.constant_references.where("declaration IS NULL")

    def calls(self, message: str) -> DataFrame:
        """Method references of a name, with the declaration of the receiver where that is a constant."""
        return self.tables.method_references.where(F.col("message") == message)

    def definitions(self, name: str) -> DataFrame:
        return self.tables.definitions.where(F.col("declaration") == name).orderBy("ord")

    def visibility(self) -> DataFrame:
        t = self.tables
        return aliases.visibility(t.declarations, t.definitions, aliases.resolve_method_aliases(t.definitions, t.members, t.ancestors, t.declarations))

    def complete(self, self_name: str, nesting: list[str]) -> DataFrame:
        return completion.expression(self_name, nesting, self.tables.ancestors, self.tables.members, self.tables.declarations)

    def dead_code(self) -> DataFrame:
        return reports.dead_code(self.tables.declarations, self.tables.definitions, self.tables.constant_references)

    def integrity(self) -> DataFrame:
        return reports.integrity(self.tables.declarations)

    def orphans(self) -> DataFrame:
        return reports.orphans(self.tables.definitions)

    def stats(self) -> DataFrame:
        return reports.statistics(self.tables.declarations, self.tables.definitions)

    def dot(self, built_ins: bool = False) -> DataFrame:
        return reports.dot_lines(self.tables.declarations, self.tables.definitions, built_ins)

    def require_paths(self, load_paths: list[str]) -> DataFrame:
        return search.require_paths(self.tables.documents, self._loads(load_paths))

    def resolve_require(self, path: str, load_paths: list[str]) -> DataFrame:
        wanted = self.tables.documents.sparkSession.createDataFrame([(path,)], "path string")
        return search.resolve_require(self.tables.documents, self._loads(load_paths), wanted)

    def _loads(self, load_paths: list[str]) -> DataFrame:
        return self.tables.documents.sparkSession.createDataFrame(list(enumerate(load_paths)), "idx int, path string")

    def lint(self, config: lint.Config, workspace: str, dependencies: tuple[str, ...] = (), rules: list[lint.Rule] = ()) -> DataFrame:
        """What is left of the diagnostics and of what custom rules find."""
        found = self.tables.diagnostics.select("rule", "uri", "start", "end", "line", "message")
        for rule in rules:
            found = found.unionByName(rule.lint(self.tables).select(*found.columns))
        return lint.lint(found, config, workspace, dependencies, lint.RULES | {r.name: r.severity for r in rules})
