"""Ancestor chains: method resolution order from superclasses and mixins.

Namespaces whose superclass and mixins all have chains are computed together, round by round; the
fold over the mixins is a SQL higher-order function, so no row leaves the JVM.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut, empty

_FOLD = """aggregate(mixins,
  named_struct('p', cast(array() as array<string>), 'i', cast(array() as array<string>)),
  (acc, x) -> CASE WHEN x.k = 'prepend' THEN
      CASE WHEN exists(x.c, e -> NOT array_contains(acc.p, e))
           THEN named_struct('p', concat(x.c, filter(acc.p, e -> NOT array_contains(x.c, e))), 'i', acc.i) ELSE acc END
    ELSE named_struct('p', acc.p, 'i', concat(filter(x.c, e -> NOT array_contains(acc.p, e)
           AND NOT array_contains(acc.i, e) AND NOT array_contains(parents, e)), acc.i)) END,
  acc -> concat(acc.p, array(name), acc.i, parents))"""


def _round(waiting: DataFrame, chains: DataFrame) -> DataFrame:
    """waiting(name, kind, superclass, mixins array<struct<ord, k, m>>) with chain and state for those whose needs are all in chains.

    The superclass stands among the needs as one of kind 'up', so that a round is one join and one exchange by name.
    """
    every = "concat(transform(mixins, x -> named_struct('ord', x.ord, 'k', x.k, 'need', x.m)), IF(superclass IS NULL, array(), array(named_struct('ord', CAST(NULL AS INT), 'k', 'up', 'need', superclass))))"
    each = waiting.select("name", "kind", "superclass", "mixins", F.explode_outer(F.expr(every)).alias("x")).select("name", "kind", "superclass", "mixins", "x.ord", "x.k", "x.need")
    found = each.join(chains.select(F.col("name").alias("need"), F.col("chain").alias("c"), F.col("state").alias("s")), "need", "left")
    got = F.collect_list(F.when(F.col("c").isNotNull(), F.struct("ord", "k", "c", "s")))
    own = found.groupBy("name").agg(
        F.first("kind").alias("kind"), F.first("superclass").alias("superclass"), F.first("mixins").alias("wanted"),
        F.count_if(F.col("need").isNotNull() & F.col("c").isNull()).alias("open"), F.array_sort(got).alias("got"),
    )
    own = own.withColumn("parents", F.coalesce(F.expr("get(filter(got, x -> x.k = 'up'), 0).c"), F.array().cast("array<string>"))).withColumn("mixins", F.expr("filter(got, x -> x.k <> 'up')"))
    # A module that mixes itself in has itself in its chain once.
    chain = F.array_distinct(F.expr(_FOLD))
    states = F.transform("got", lambda x: x["s"])
    state = F.when(F.array_contains(states, "cyclic"), "cyclic").when(F.array_contains(states, "partial"), "partial").otherwise("complete")
    made = F.col("open") == 0
    return own.select("name", "kind", "superclass", F.col("wanted").alias("mixins"), F.when(made, chain).alias("chain"), F.when(made, state).alias("state"))


def linearize(namespaces: DataFrame, mixins: DataFrame) -> DataFrame:
    """(name, state, chain) of namespaces(name, kind, superclass) and mixins(name, ord, kind, target).

    kind of a mixin: include or prepend. superclass: a name; null for modules and the root; a name
    that isn't among the namespaces stays in the chain as a partial entry '?Name', and so does a
    mixin's. Where a chain comes back to a namespace that it is being made for, a class gives
    Object and a module nothing at that place, and everything else is merged as usual; all
    namespaces on or behind such a cycle are cyclic, but one that only mixes itself in is not.
    Mixins without a target and namespaces without a name don't count; a name that repeats is one
    namespace, with a superclass if one of its rows has one (the last by name).

    Each round is a job that gives a chain to every namespace all of whose needs have one, so there
    are as many rounds as the longest chain of needs. Only namespaces that lie on cycles are
    walked one by one, those of a connected set of cycles in one task.
    """
    namespaces = namespaces.where("name IS NOT NULL").groupBy("name").agg(F.max(F.struct("superclass", "kind")).alias("s")).select("name", "s.kind", "s.superclass")
    mixed = mixins.where("target IS NOT NULL AND name <> target").select("name", "ord", F.col("kind").alias("k"), F.col("target").alias("m"))
    named = namespaces.join(mixed.groupBy("name").agg(F.collect_list(F.struct("ord", "k", "m")).alias("mixins")), "name", "left")
    named = cut(named.withColumn("mixins", F.coalesce("mixins", F.expr("cast(array() as array<struct<ord: int, k: string, m: string>>)"))))
    known = named.select(F.col("name").alias("k"))
    targets = _needs(named).select(F.col("need").alias("superclass")).distinct()
    missing = targets.join(known, F.col("superclass") == F.col("k"), "left_anti")
    holes = missing.select(F.col("superclass").alias("name"), F.array(F.concat(F.lit("?"), F.col("superclass"))).alias("chain"), F.lit("partial").alias("state"))
    chains, waiting = _rounds(cut(holes), named)
    if not empty(waiting):
        # What the namespaces on cycles need is itself on cycles, or has a chain; then the rounds go on.
        core = _core(waiting)
        chains = cut(chains.unionAll(_cyclic(core, chains)))
        chains, waiting = _rounds(chains, waiting.join(core.select("name"), "name", "left_anti"))
    # The holes themselves aren't declarations; a partial class gets the root's chain.
    out = chains.join(named.select("name", "kind", F.col("superclass").alias("up")), "name")
    root = out.where("name = 'Object'").select(F.col("chain").alias("root"))
    hole = F.col("kind").eqNullSafe("Class") & F.array_contains("chain", F.concat(F.lit("?"), F.col("up")))
    out = out.join(F.broadcast(root), how="left")
    whole = F.when(hole & F.col("root").isNotNull(), F.array_distinct(F.concat("chain", "root"))).otherwise(F.col("chain"))
    return out.select("name", "state", whole.alias("chain"))


def _needs(df: DataFrame) -> DataFrame:
    """(name, need) of namespaces with mixins."""
    return df.select("name", F.explode(F.expr("array_compact(array_append(transform(mixins, x -> x.m), superclass))")).alias("need"))


def _rounds(chains: DataFrame, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains with those that could be made, the namespaces that still wait)."""
    left = -1
    while True:
        step = cut(_round(waiting, chains))
        chains = chains.unionAll(step.where("chain IS NOT NULL").select("name", "chain", "state"))
        waiting = step.where("chain IS NULL").select("name", "kind", "superclass", "mixins")
        before, left = left, waiting.count()
        if left in (0, before):
            return chains, waiting


def _core(waiting: DataFrame) -> DataFrame:
    """Of namespaces on or behind cycles those that one of them needs, again and again: what lies on cycles or between them."""
    left = -1
    while True:
        needed = _needs(waiting).select(F.col("need").alias("name")).distinct()
        waiting = cut(waiting.join(needed, "name", "left_semi"))
        before, left = left, waiting.count()
        if left == before:
            return waiting


def _cyclic(core: DataFrame, chains: DataFrame) -> DataFrame:
    """(name, chain, state) of namespaces on cycles: each is walked from itself, and what is being walked isn't entered again."""
    names = core.select(F.col("name").alias("need"))
    edges = cut(_needs(core).join(names, "need", "left_semi"))
    both = edges.unionAll(edges.select(F.col("need").alias("name"), F.col("name").alias("need")))
    labels = cut(core.select("name", F.col("name").alias("label")))
    while True:  # connected sets of cycles, by the least name
        seen = both.join(labels.select(F.col("name").alias("need"), F.col("label").alias("via")), "need").groupBy("name").agg(F.min("via").alias("via"))
        step = cut(labels.join(seen, "name", "left").select("name", F.col("label").alias("old"), F.least("label", F.coalesce("via", "label")).alias("label")))
        labels = step.select("name", "label")
        if not step.where("old <> label").limit(1).count():
            break
    outside = _needs(core).join(names, "need", "left_anti").join(chains.select(F.col("name").alias("need"), "chain", "state"), "need")
    outside = outside.groupBy("name").agg(F.collect_list(F.struct("need", "chain", "state")).alias("outside"))
    rows = core.join(labels, "name").join(outside, "name", "left")

    def walk_all(table: pa.Table) -> pa.Table:
        spaces = {r["name"]: r for r in table.to_pylist()}
        done = {o["need"]: (o["chain"], o["state"]) for r in spaces.values() for o in r["outside"] or []}
        out = [(n, walk(n, spaces, done, frozenset())[0], "cyclic") for n in spaces]
        return pa.table({"name": [r[0] for r in out], "chain": pa.array([r[1] for r in out], pa.list_(pa.string())), "state": [r[2] for r in out]})

    return rows.groupBy("label").applyInArrow(walk_all, "name string, chain array<string>, state string")


def walk(name: str, spaces: dict, done: dict, path: frozenset) -> tuple[list[str], str]:
    """(chain, state) of a namespace; path: those that are being walked."""
    if name in done:
        return done[name]
    own = spaces[name]
    if name in path:
        return (["Object"] if own["kind"] == "Class" else []), "cyclic"
    path = path | {name}
    parents = walk(own["superclass"], spaces, done, path)[0] if own["superclass"] else []
    mixed = [(m["k"], walk(m["m"], spaces, done, path)[0]) for m in sorted(own["mixins"], key=lambda m: m["ord"])]
    return fold(name, mixed, parents), "cyclic"


def fold(name: str, mixins: list[tuple[str, list[str]]], parents: list[str]) -> list[str]:
    """Chain of a name: prepends, itself, includes, parents."""
    first: list[str] = []
    then: list[str] = []
    for kind, chain in mixins:
        if kind == "prepend":
            if any(e not in first for e in chain):
                first = chain + [e for e in first if e not in chain]
        else:
            then = [e for e in chain if e not in first and e not in then and e not in parents] + then
    return list(dict.fromkeys([*first, name, *then, *parents]))


def chain_rows(chains: DataFrame) -> DataFrame:
    """ancestors(name, state, pos, tag, ancestor) of linearize's chains."""
    flat = chains.select("name", "state", F.posexplode("chain").alias("pos", "entry"))
    partial = F.col("entry").startswith("?")
    return flat.select("name", "state", "pos", F.when(partial, "partial").otherwise("complete").alias("tag"), F.when(partial, F.expr("substring(entry, 2)")).otherwise(F.col("entry")).alias("ancestor"))
