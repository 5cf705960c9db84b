"""Parse once, run on any graph; results with columns, rows and renderings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StaleNodeError
from ..graph import PropertyGraph
from .compiler import Compiler
from .parser import Tree, parse

FORMATS = ("table", "json")
HANDLE = ["category", "id", "label", "name"]


class Result:
    """A query's rows. Columns are known without running it; rows are fetched once."""

    def __init__(self, df: DataFrame, graph: PropertyGraph) -> None:
        self.df, self.graph, self.version = df, graph, graph.version
        self._rows: list[list[Any]] | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def rows(self) -> list[list[Any]]:
        if self._rows is None:
            self._rows = [list(r) for r in self.df.collect()]
        self._alive(self._rows)
        return self._rows

    def __iter__(self) -> Iterator[list[Any]]:
        for r in self.df.toLocalIterator():
            row = list(r)
            self._alive([row])
            yield row

    def __len__(self) -> int:
        return len(self._rows) if self._rows is not None else self.df.count()

    @property
    def empty(self) -> bool:
        return not self.df.limit(1).count()

    def _handles(self, value: Any) -> Iterator[Row]:
        if isinstance(value, Row):
            if list(value.asDict()) == HANDLE:
                yield value
            else:
                for v in value:
                    yield from self._handles(v)
        elif isinstance(value, list):
            for v in value:
                yield from self._handles(v)

    def _alive(self, rows: list[list[Any]]) -> None:
        """Nodes in the rows must still be in the graph, if it has changed since."""
        if self.graph.version == self.version:
            return
        asked: dict[str, set[str]] = {}
        for row in rows:
            for h in self._handles(row):
                asked.setdefault(h["category"], set()).add(h["id"])
        for name, ids in asked.items():
            t = self.graph.table(name)
            there = {r[0] for r in t.df.select(F.col(t.key).cast("string")).where(F.col(t.key).cast("string").isin(*ids)).collect()}
            if ids - there:
                raise StaleNodeError(f"{name} {sorted(ids - there)[0]} is no longer in the graph")

    def json_rows(self) -> DataFrame:
        """(json): one object for each row, nulls kept."""
        return self.df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.columns]), {"ignoreNullFields": "false"}).alias("json"))

    def render(self, form: str = "table") -> str:
        if form not in FORMATS:
            raise ValueError(f"unknown query format {form!r}; known are {', '.join(FORMATS)}")
        if form == "json":
            return "[" + ",".join(r["json"] for r in self.json_rows().collect()) + "]"
        cells = [[_text(v) for v in r] for r in (self._rows if self._rows is not None else self.df.collect())]
        return aligned(self.columns, cells)


def aligned(columns: list[str], cells: list[list[str]]) -> str:
    """A table of text with a footer that counts its rows."""
    width = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(columns)]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in [columns, *cells]]
    lines.insert(1, "-+-".join("-" * w for w in width))
    return "\n".join([*lines, "", f"{len(cells)} row(s)"])


def _text(value: Any) -> str:
    if isinstance(value, Row):
        return f"{value['label']}({value['name']})" if list(value.asDict()) == HANDLE else json.dumps(value.asDict(True), ensure_ascii=False, default=str)
    if isinstance(value, list):
        return "[" + ", ".join(map(_text, value)) + "]"
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


class Query:
    """A parsed query."""

    def __init__(self, tree: Tree, text: str) -> None:
        self.tree, self.text = tree, text

    @classmethod
    def parse(cls, text: str) -> Query:
        return cls(parse(text), text)

    def run(self, graph: PropertyGraph) -> Result:
        return Result(Compiler(graph, self.tree).compile(), graph)

    @staticmethod
    def schema(graph: PropertyGraph, form: str = "table") -> str:
        """The catalog of labels, relationship types and properties; any format but json is a table."""
        labels, rels, props = ([[str(x) for x in r] for r in df.collect()] for df in graph.catalog())
        heads = (["label", "category"], ["type", "from", "to"], ["property", "category", "type"])
        if form == "json":
            names = ("labels", "relationship_types", "properties")
            return json.dumps({n: [dict(zip(h, r)) for r in rows] for n, h, rows in zip(names, heads, (labels, rels, props))})
        return "\n\n".join(aligned(h, rows) for h, rows in zip(heads, (labels, rels, props)))


def cypher(graph: PropertyGraph, text: str) -> DataFrame:
    return Query.parse(text).run(graph).df


__all__ = ["Query", "Result", "cypher", "aligned", "T"]
