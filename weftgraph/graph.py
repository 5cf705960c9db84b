"""Property graphs over DataFrames: node tables, edge tables, the schema catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one table.

    source: the table, or what makes it once a query asks for it. key: the column that identifies a
    node in the table. labels: each label's condition on the table's columns, None for all rows.
    kind: the label that a node displays. props: property name to column name. joined: for a property
    that isn't in the table, what adds its column; only queries that mention it pay for it.
    """

    name: str
    source: DataFrame | Callable[[], DataFrame]
    key: str
    labels: dict[str, Callable[[], Column] | None]
    props: dict[str, str]
    kind: str | None = None
    joined: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    @cached_property
    def base(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()

    @cached_property
    def df(self) -> DataFrame:
        return self.having(self.props)

    def having(self, props: Iterable[str]) -> DataFrame:
        """The table with at least the columns of some properties."""
        out = self.base
        for p, join in self.joined.items():
            if p in props:
                out = join(out)
        return out

    def has_label(self, labels: tuple[str, ...]) -> bool:
        return not labels or any(x in self.labels for x in labels)

    def with_label(self, labels: tuple[str, ...], props: Iterable[str] | None = None) -> DataFrame | None:
        """The nodes with one of the labels (all for none given), None if the table can have none of them; with all properties, or at least those given."""
        df = self.df if props is None else self.having(props)
        if not labels:
            return df
        own = [self.labels[x] for x in dict.fromkeys(labels) if x in self.labels]
        if not own:
            return None
        if any(c is None for c in own):
            return df
        test = own[0]()
        for c in own[1:]:
            test = test | c()
        return df.where(test)


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one type from one node table to another: columns src and dst with the tables' keys.

    source: the table, or what makes it once a query asks for it. key: a column that tells apart
    edges between the same nodes; without one, these are one relationship.
    """

    type: str
    src: str
    dst: str
    source: DataFrame | Callable[[], DataFrame]
    about: str = ""
    key: str | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.source if isinstance(self.source, DataFrame) else self.source()


@dataclass
class PropertyGraph:
    nodes: list[NodeTable]
    edges: list[EdgeTable]
    version: int = 0
    about: dict[str, str] = field(default_factory=dict)
    session: SparkSession | None = None

    @property
    def spark(self) -> SparkSession:
        return self.session or self.nodes[0].df.sparkSession

    def table(self, name: str) -> NodeTable:
        return next(t for t in self.nodes if t.name == name)

    def relationship_types(self) -> list[str]:
        return list(dict.fromkeys(e.type for e in self.edges))

    def scan(self, labels: tuple[str, ...] = ()) -> DataFrame:
        """(category, key, label) of the nodes with one of the labels."""
        found = None
        for t in self.nodes:
            df = t.with_label(labels, ())
            if df is not None:
                kind = F.col(t.kind) if t.kind else F.lit(t.name)
                part = df.select(F.lit(t.name).alias("category"), F.col(t.key).cast("string").alias("key"), kind.alias("label"))
                found = part if found is None else found.unionAll(part)
        return found if found is not None else self.spark.createDataFrame([], "category string, key string, label string")

    def catalog(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(labels, relationship types, properties) as three DataFrames."""
        spark = self.spark
        labels = sorted({(x, t.name) for t in self.nodes for x in t.labels})
        rels = sorted({(e.type, e.src, e.dst) for e in self.edges})
        props = sorted({(p, t.name, dict(t.df.dtypes)[c]) for t in self.nodes for p, c in t.props.items()})
        return (
            spark.createDataFrame(labels, "label string, category string"),
            spark.createDataFrame(rels, "type string, from_category string, to_category string"),
            spark.createDataFrame(props, "property string, category string, kind string"),
        )
