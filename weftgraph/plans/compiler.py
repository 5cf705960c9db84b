"""Syntax tree and graph to a DataFrame.

Node patterns are assigned to node tables and relationships to edge tables in all ways that the
schema allows; each assignment is a chain of equi-joins on native keys that carries only the
properties the query mentions, and the assignments are united. Filters are stated once, on top:
Catalyst moves them to the scans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CypherExecutionError
from ..functions.shared import cut, empty
from ..graph import EdgeTable, NodeTable, PropertyGraph
from . import parser as P

#: Bounds up to which repeated hops are unrolled; beyond, a frontier is extended until it is empty.
UNROLL = 6


@dataclass
class Scope:
    """What an expression can refer to: node variables and the properties that are carried."""

    graph: PropertyGraph
    variables: set[str]


def references(e, out: dict[str, set[str]]) -> dict[str, set[str]]:
    """Properties by variable; '' stands for the node itself."""
    if isinstance(e, P.Prop):
        out.setdefault(e.var, set()).add(e.name)
    elif isinstance(e, P.Var):
        out.setdefault(e.name, set()).add("")
    elif isinstance(e, P.ListOf):
        for x in e.items:
            references(x, out)
    elif isinstance(e, P.MapOf):
        for _, x in e.items:
            references(x, out)
    elif isinstance(e, P.Call):
        references(e.arg, out)
    elif isinstance(e, P.Binary):
        references(e.left, out)
        references(e.right, out)
    elif isinstance(e, P.Unary):
        references(e.arg, out)
    return out


def aggregates(e) -> bool:
    if isinstance(e, P.Call):
        return True
    if isinstance(e, P.Binary):
        return aggregates(e.left) or aggregates(e.right)
    if isinstance(e, (P.Unary,)):
        return aggregates(e.arg)
    if isinstance(e, (P.ListOf, P.MapOf)):
        return any(aggregates(x[1] if isinstance(e, P.MapOf) else x) for x in e.items)
    return False


def conjuncts(e) -> list:
    if isinstance(e, P.Binary) and e.op == "and":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


def set_like(e) -> bool:
    """Does an aggregate give the same whether rows repeat or not?"""
    if isinstance(e, P.Call):
        return e.name in ("min", "max") or e.distinct
    if isinstance(e, P.Binary):
        return set_like(e.left) and set_like(e.right)
    if isinstance(e, P.Unary):
        return set_like(e.arg)
    if isinstance(e, (P.ListOf, P.MapOf)):
        return all(set_like(x[1] if isinstance(e, P.MapOf) else x) for x in e.items)
    return True


def field(var: str, prop: str) -> Column:
    return F.col(f"`{var}.{prop}`")


def handle(var: str) -> Column:
    """A node as a cell: its category, key, label and name."""
    return F.struct(
        field(var, ":table").alias("category"), field(var, ":key").cast("string").alias("id"),
        field(var, ":label").alias("label"), field(var, ":name").cast("string").alias("name"),
    )


def column(e, variables: set[str]) -> Column:
    if isinstance(e, P.Literal):
        return F.lit(e.value)
    if isinstance(e, P.Prop):
        if e.var not in variables:
            raise CypherExecutionError(f"variable {e.var} is not defined")
        return field(e.var, e.name)
    if isinstance(e, P.Var):
        if e.name not in variables:
            raise CypherExecutionError(f"variable {e.name} is not defined")
        return handle(e.name)
    if isinstance(e, P.ListOf):
        return F.array(*[column(x, variables) for x in e.items])
    if isinstance(e, P.MapOf):
        return F.struct(*[column(x, variables).alias(k) for k, x in e.items])
    if isinstance(e, P.Unary):
        x = column(e.arg, variables)
        return {"not": lambda: ~x, "null": x.isNull, "not null": x.isNotNull, "-": lambda: -x}[e.op]()
    if isinstance(e, P.Binary):
        if e.op == "in":
            x = column(e.left, variables)
            if isinstance(e.right, P.ListOf) and all(isinstance(i, P.Literal) for i in e.right.items):
                return x.isin([i.value for i in e.right.items])
            return F.array_contains(column(e.right, variables), x)
        a, b = column(e.left, variables), column(e.right, variables)
        if isinstance(e.left, P.Var) and isinstance(e.right, P.Var):
            a, b = F.struct(a["category"], a["id"]), F.struct(b["category"], b["id"])
        return {
            "or": lambda: a | b, "and": lambda: a & b, "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b,
            ">": lambda: a > b, ">=": lambda: a >= b, "contains": lambda: a.contains(b), "starts": lambda: a.startswith(b), "ends": lambda: a.endswith(b),
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b,
        }[e.op]()
    if isinstance(e, P.Call):
        return aggregate(e, variables)
    raise CypherExecutionError(f"can't evaluate {e}")


def aggregate(e: P.Call, variables: set[str]) -> Column:
    if e.arg is None:
        return F.count(F.lit(1))
    x = column(e.arg, variables)
    if e.name == "count":
        return F.countDistinct(x) if e.distinct else F.count(x)
    if e.name == "collect":
        return F.collect_set(x) if e.distinct else F.collect_list(x)
    if e.name == "sum":
        total = F.sum_distinct(x) if e.distinct else F.sum(x)
        return F.coalesce(total, F.lit(0))
    if e.name == "avg":
        return F.try_divide(F.sum_distinct(x), F.countDistinct(x)).cast("double") if e.distinct else F.avg(x)
    return {"min": F.min, "max": F.max}[e.name](x)


class Compiler:
    def __init__(self, graph: PropertyGraph, tree: P.Tree) -> None:
        self.graph, self.tree = graph, tree
        self.names = count()
        exprs = [i.expr for i in tree.items] + [o[0] for o in tree.order] + [tree.where]
        self.wanted: dict[str, set[str]] = {}
        for e in exprs:
            references(e, self.wanted)
        for path in tree.paths:
            for n in path.nodes:
                self.wanted.setdefault(n.var, set()).update(k for k, _ in n.props)
        # What WHERE says of one variable, and the rest.
        self.about: dict[str, list] = {}
        self.rest: list = []
        bound = {n.var for p in tree.paths for n in p.nodes}
        for e in conjuncts(tree.where):
            of = list(references(e, {}))
            if len(of) == 1 and of[0] in bound and not aggregates(e):
                self.about.setdefault(of[0], []).append(e)
            else:
                self.rest.append(e)
        some = any(aggregates(i.expr) for i in tree.items)
        #: Do repeated matches change nothing, so that it is enough to know which nodes can be reached?
        self.as_set = all(set_like(i.expr) for i in tree.items) if some else tree.distinct
        known = {t.upper() for t in graph.relationship_types()}
        for path in tree.paths:
            for r in path.rels:
                for t in r.types:
                    if t.upper() not in known:
                        raise CypherExecutionError(f"unknown relationship type {t}")

    # Node and edge tables

    def node(self, var: str, table: NodeTable, df: DataFrame) -> DataFrame:
        """The columns of a bound node: its key, and what the query mentions."""
        props = self.wanted.get(var, set())
        kind = F.col(table.kind) if table.kind else F.lit(table.name)
        out = [F.col(table.key).alias(f"{var}.:key"), F.lit(table.name).alias(f"{var}.:table")]
        if "" in props:
            name = F.col(table.props["name"]) if "name" in table.props else F.col(table.key).cast("string")
            out += [kind.alias(f"{var}.:label"), name.alias(f"{var}.:name")]
        for p in sorted(props - {""}):
            if p in ("label", "kind") and p not in table.props:
                out.append(kind.alias(f"{var}.{p}"))
            elif p in table.props:
                out.append(F.col(table.props[p]).alias(f"{var}.{p}"))
            else:
                out.append(F.lit(None).cast(self.kind_of(p)).alias(f"{var}.{p}"))
        return df.select(*out)

    def kind_of(self, prop: str) -> str:
        """The type of a property that a table lacks: what other tables have, else string."""
        for t in self.graph.nodes:
            if prop in t.props:
                return t.df.schema[t.props[prop]].dataType.simpleString()
        return "string"

    def hops(self, rel: P.Rel) -> list[tuple[EdgeTable, bool]]:
        """(edge table, whether it is followed backwards)."""
        types = {t.upper() for t in rel.types}
        own = [e for e in self.graph.edges if not types or e.type.upper() in types]
        ways = {"out": [False], "in": [True], "both": [False, True]}[rel.direction]
        return [(e, w) for e in own for w in ways]

    def edge(self, e: EdgeTable, back: bool, rel: P.Rel) -> DataFrame:
        a, b = ("dst", "src") if back else ("src", "dst")
        df = e.df.where(F.col("src") != F.col("dst")) if back and rel.direction == "both" and e.src == e.dst else e.df
        mark = F.struct(F.lit(e.type).alias("t"), F.lit(e.src + ">" + e.dst).alias("w"), F.col("src").cast("string").alias("s"), F.col("dst").cast("string").alias("d"), (F.col(e.key) if e.key else F.lit(None)).cast("string").alias("k"))
        return df.select(F.col(a).alias("@from"), F.col(b).alias("@to"), mark.alias("@edge"))

    # Patterns

    def bound(self, node: P.Node, tables: set[str] | None = None) -> list[tuple[NodeTable, DataFrame]]:
        """The nodes that a pattern can stand for, by table; tables: those that the schema leaves."""
        out = []
        for t in self.graph.nodes:
            if tables is not None and t.name not in tables or not t.has_label(node.labels):
                continue
            own = self.node(node.var, t, t.with_label(node.labels, self.wanted.get(node.var, set())))
            for k, e in node.props:
                own = own.where(field(node.var, k) == column(e, set()))
            for e in self.about.get(node.var, []):
                own = own.where(column(e, {node.var}))
            out.append((t, own))
        return out

    def possible(self, path: P.Path) -> list[set[str]]:
        """The tables that each node of a path can be in, so that no others are opened."""
        may = [{t.name for t in self.graph.nodes if t.has_label(n.labels)} for n in path.nodes]

        def ends(rel: P.Rel, sources: set[str]) -> set[str]:
            steps = [((e.dst, e.src) if back else (e.src, e.dst)) for e, back in self.hops(rel)]
            if rel.low is None:
                return {b for a, b in steps if a in sources}
            reach, new = set(sources) if rel.low == 0 else set(), set(sources)
            while new:
                new = {b for a, b in steps if a in new} - reach
                reach |= new
            return reach

        for k, rel in enumerate(path.rels):
            may[k + 1] &= ends(rel, may[k])
        for k in range(len(path.rels) - 1, -1, -1):
            may[k] = {t for t in may[k] if ends(path.rels[k], {t}) & may[k + 1]}
        return may

    def path(self, path: P.Path) -> DataFrame | None:
        """All matches of a path, one column set for each of its variables."""
        options = [self.bound(n, may) for n, may in zip(path.nodes, self.possible(path))]
        branches: list[tuple[str, DataFrame, list[tuple[str, bool]]]] = [(t.name, df, []) for t, df in options[0]]
        for k, rel in enumerate(path.rels):
            target = path.nodes[k + 1]
            again = target.var in {n.var for n in path.nodes[: k + 1]}
            later: list[tuple[str, DataFrame, list[tuple[str, bool]]]] = []
            for name, df, marks in branches:
                if rel.low is not None:
                    steps = self.repeated(rel, name, df.select(field(path.nodes[k].var, ":key").alias("@from")).distinct(), {t.name for t, _ in options[k + 1]})
                else:
                    steps = [(e.src if back else e.dst, self.edge(e, back, rel)) for e, back in self.hops(rel) if (e.dst if back else e.src) == name]
                for to, edges in steps:
                    for t, own in options[k + 1]:
                        if t.name != to:
                            continue
                        later.append((to, *self.extend(df, marks, path.nodes[k].var, target.var, edges, own, again, rel)))
            branches = later
        return self.unite([df for _, df, _ in branches]) if branches else None

    def extend(self, df, marks, var, target, edges, own, again, rel) -> tuple[DataFrame, list[tuple[str, bool]]]:
        mark = f"@{next(self.names)}"
        single = rel.low is None
        edges = edges.withColumnRenamed("@edge", mark).withColumnRenamed("@from", f"{mark}f").withColumnRenamed("@to", f"{mark}t")
        joined = df.join(edges, field(var, ":key") == F.col(f"`{mark}f`"))
        if again:
            joined = joined.where(F.col(f"`{mark}t`") == field(target, ":key"))
        else:
            joined = joined.join(own, F.col(f"`{mark}t`") == field(target, ":key"))
        # No relationship is used twice in a match.
        for other, one in marks:
            a, b = F.col(f"`{other}`"), F.col(f"`{mark}`")
            if one and single:
                joined = joined.where(a != b)
            else:
                joined = joined.where(~F.arrays_overlap(F.array(a) if one else a, F.array(b) if single else b))
        return joined.drop(f"{mark}f", f"{mark}t"), [*marks, (mark, single)]

    def repeated(self, rel: P.Rel, start: str, sources: DataFrame, targets: set[str]) -> list[tuple[str, DataFrame]]:
        """Paths of low to high hops from the sources, each relationship used once: (end table, (@from, @to, @edge))."""
        hops = self.hops(rel)
        low, high = rel.low or 0, rel.high
        found: dict[str, list[DataFrame]] = {}
        nothing = "array<struct<t: string, w: string, s: string, d: string, k: string>>"
        if self.as_set and high is None and low <= 1 and rel.direction != "both" and self.alone(rel):
            return self.reachable(hops, low, start, sources, targets, nothing)
        frontier = {start: sources.select("@from", F.col("@from").alias("@to"), F.array().cast(nothing).alias("@edge"))}
        if low == 0:
            found.setdefault(start, []).append(frontier[start])
        depth = 0
        unroll = high is not None and high <= UNROLL
        while frontier and (high is None or depth < high):
            depth += 1
            later: dict[str, list[DataFrame]] = {}
            for name, df in frontier.items():
                for e, back in hops:
                    if (e.dst if back else e.src) != name:
                        continue
                    step = self.edge(e, back, rel).toDF("~from", "~to", "~edge")
                    joined = df.join(step, F.col("@to") == F.col("~from")).where(~F.array_contains("@edge", F.col("~edge")))
                    later.setdefault(e.src if back else e.dst, []).append(joined.select("@from", F.col("~to").alias("@to"), F.array_append("@edge", F.col("~edge")).alias("@edge")))
            frontier = {name: reduce(DataFrame.unionAll, dfs) for name, dfs in later.items()}
            if not unroll:
                frontier = {name: cut(df) for name, df in frontier.items()}
                frontier = {name: df for name, df in frontier.items() if not empty(df)}
            if depth >= low:
                for name, df in frontier.items():
                    if name in targets:
                        found.setdefault(name, []).append(df)
        return [(name, reduce(DataFrame.unionAll, dfs)) for name, dfs in found.items()]

    def alone(self, rel: P.Rel) -> bool:
        """Is there no other relationship in the query that could use the same edges?"""
        own = {id(e) for e, _ in self.hops(rel)}
        others = [r for p in self.tree.paths for r in p.rels if r is not rel]
        return all(not own & {id(e) for e, _ in self.hops(r)} for r in others)

    def reachable(self, hops, low: int, start: str, sources: DataFrame, targets: set[str], nothing: str) -> list[tuple[str, DataFrame]]:
        """As repeated(), but each pair of ends once: directed ways that use an edge twice reach nothing that others don't."""
        edges = cache(lambda k: cut(hops[k][0].df.select("src", "dst")))  # made once, not in each round
        frontier = {start: cut(sources.select("@from", F.col("@from").alias("@to")))}
        seen: dict[str, DataFrame] = {start: frontier[start]} if low == 0 else {}
        while frontier:
            later: dict[str, list[DataFrame]] = {}
            for name, df in frontier.items():
                for k, (e, back) in enumerate(hops):
                    if (e.dst if back else e.src) == name:
                        a, b = ("dst", "src") if back else ("src", "dst")
                        step = edges(k).select(F.col(a).alias("~from"), F.col(b).alias("~to"))
                        later.setdefault(e.src if back else e.dst, []).append(df.join(step, F.col("@to") == F.col("~from")).select("@from", F.col("~to").alias("@to")))
            frontier = {}
            for name, dfs in later.items():
                new = reduce(DataFrame.unionAll, dfs).distinct()
                if name in seen:
                    new = new.join(seen[name], ["@from", "@to"], "left_anti")
                new = cut(new)
                if not empty(new):
                    frontier[name] = new
                    seen[name] = seen[name].unionAll(new) if name in seen else new
        return [(name, df.withColumn("@edge", F.array().cast(nothing))) for name, df in seen.items() if name in targets]

    def unite(self, parts: list[DataFrame]) -> DataFrame:
        keep = [c for c in parts[0].columns if not c.startswith("@")]
        parts = [p.select(*[f"`{c}`" for c in keep]) for p in parts]
        if len(parts) == 1:
            return parts[0]
        for c in keep:
            kinds = {p.schema[c].dataType.simpleString() for p in parts}
            if len(kinds) > 1:
                parts = [p.withColumn(c, F.col(f"`{c}`").cast("string")) for p in parts]
        return reduce(DataFrame.unionAll, parts)

    # The query

    def nothing(self) -> DataFrame:
        variables = list(dict.fromkeys(n.var for p in self.tree.paths for n in p.nodes))
        columns = []
        for v in variables:
            columns += [F.lit(None).cast("string").alias(f"{v}.{x}") for x in (":key", ":table", ":label", ":name")]
            columns += [F.lit(None).cast(self.kind_of(p)).alias(f"{v}.{p}") for p in sorted(self.wanted.get(v, set()) - {""})]
        return self.graph.spark.range(0).select(*columns)

    def match(self) -> DataFrame:
        df: DataFrame | None = None
        seen: set[str] = set()
        for path in self.tree.paths:
            own = self.path(path)
            if own is None:
                return self.nothing()
            variables = {n.var for n in path.nodes}
            if df is None:
                df = own
            else:
                shared = sorted(seen & variables)
                if not shared:
                    df = df.crossJoin(own)
                else:
                    drop = [c for c in own.columns if c.split(".", 1)[0] in shared]
                    right = own.select(*[F.col(f"`{c}`").alias("~" + c if c in drop else c) for c in own.columns])
                    # Keys of several tables together are strings.
                    alike = {v: df.schema[f"{v}.:key"].dataType == own.schema[f"{v}.:key"].dataType for v in shared}
                    same = lambda v, x: (lambda c: c if x != ":key" or alike[v] else c.cast("string"))
                    on = [same(v, x)(field(v, x)).eqNullSafe(same(v, x)(F.col(f"`~{v}.{x}`"))) for v in shared for x in (":table", ":key")]
                    df = df.join(right, reduce(Column.__and__, on)).drop(*["~" + c for c in drop])
            seen |= variables
        assert df is not None
        return df

    def compile(self) -> DataFrame:
        tree = self.tree
        variables = {n.var for p in tree.paths for n in p.nodes}
        df = self.match()
        for e in self.rest:
            df = df.where(column(e, variables))
        names = [i.name for i in tree.items]
        if len(set(names)) < len(names):
            raise CypherExecutionError("two columns have the same name")
        inner = [f"#{k}" for k in range(len(names))]
        by_name = dict(zip(names, inner))
        order: list[tuple[Column, bool]] = []
        extra: list[Column] = []
        for k, (e, down) in enumerate(tree.order):
            same = next((n for n, i in zip(inner, tree.items) if i.expr == e), None)
            if same is None and isinstance(e, P.Var) and e.name in by_name:
                same = by_name[e.name]
            if same is None:
                if tree.distinct or any(aggregates(i.expr) for i in tree.items):
                    raise CypherExecutionError("ORDER BY needs a returned expression here")
                extra.append(column(e, variables).alias(f"#o{k}"))
                same = f"#o{k}"
            order.append((F.col(f"`{same}`"), down))
        exprs = [column(i.expr, variables).alias(n) for i, n in zip(tree.items, inner)]
        if any(aggregates(i.expr) for i in tree.items):
            keys = [x for x, i in zip(exprs, tree.items) if not aggregates(i.expr)]
            sums = [x for x, i in zip(exprs, tree.items) if aggregates(i.expr)]
            df = df.groupBy(*keys).agg(*sums)
        else:
            df = df.select(*exprs, *extra)
        if tree.distinct:
            df = df.select(*[f"`{n}`" for n in inner]).distinct()
        if order:
            df = df.orderBy(*[c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in order])
        if tree.skip:
            df = df.offset(tree.skip)
        if tree.limit is not None:
            df = df.limit(tree.limit)
        return df.select(*[F.col(f"`{n}`").alias(i.name) for n, i in zip(inner, tree.items)])
