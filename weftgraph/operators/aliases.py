"""Following aliases of constants and of methods, and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import cut, empty, small


def alias_targets(definitions: DataFrame) -> DataFrame:
    """(name, target, ord): the resolved targets of constant aliases, distinct, in the order of their definitions."""
    own = definitions.where("kind = 'ConstantAlias' AND target IS NOT NULL AND declaration IS NOT NULL")
    first = own.groupBy(F.col("declaration").alias("name"), "target").agg(F.min("ord").alias("at"))
    return first.select("name", "target", (F.row_number().over(Window.partitionBy("name").orderBy("at")) - 1).alias("ord"))


def resolve_aliases(definitions: DataFrame, declarations: DataFrame) -> DataFrame:
    """(name, resolved) for each constant alias: its first target, followed to what is no alias; null for a cycle or an unresolved target."""
    kinds = declarations.select(F.col("name").alias("next"), (F.col("kind") == "ConstantAlias").alias("is_alias"))
    first = alias_targets(definitions).where("ord = 0").select(F.col("name").alias("at"), F.col("target").alias("next"))
    # What the targets are is looked up once: the rounds join aliases only.
    first = cut(first.join(kinds, "next", "left").select("at", "next", "is_alias"))
    aliases = definitions.where("kind = 'ConstantAlias' AND declaration IS NOT NULL").select(F.col("declaration").alias("name")).distinct()
    work = cut(aliases.select("name", F.col("name").alias("at"), F.array("name").alias("seen")))
    done = None
    while not empty(work):
        step = work.join(first, "at", "left").select("name", F.col("next").alias("at"), "seen", "is_alias")
        over = F.col("at").isNull() | F.array_contains("seen", F.col("at")) | ~F.coalesce("is_alias", F.lit(False))
        good = F.when(F.col("at").isNotNull() & ~F.array_contains("seen", F.col("at")) & F.col("is_alias").isNotNull(), F.col("at"))
        step = cut(step.withColumn("over", F.coalesce(over, F.lit(True))))
        ended = step.where("over").select("name", good.alias("resolved"))
        done = ended if done is None else done.unionAll(ended)
        work = step.where("NOT over").select("name", "at", F.array_append("seen", F.col("at")).alias("seen"))
    return done if done is not None else aliases.withColumn("resolved", F.lit(None).cast("string"))


def resolve_method_aliases(definitions: DataFrame, members: DataFrame, ancestors: DataFrame, declarations: DataFrame) -> DataFrame:
    """(id, outcome, target) of each method alias: Resolved with the method, or Cycle, TargetNotFound, UnresolvedOwner.

    The old name is looked up along the ancestors of the owner of the alias' declaration; a target
    with a definition that is no alias ends the walk, else it goes on with the target's alias of
    the smallest id.
    """
    alias = definitions.where("kind = 'AliasMethod'").select("id", "declaration", F.col("old_str").alias("old"))
    owners = declarations.select(F.col("name").alias("declaration"), "owner", "kind")
    chain = ancestors.where("tag = 'complete'").select(F.col("name").alias("owner"), "pos", "ancestor")
    held = members.select(F.col("owner").alias("ancestor"), F.col("member").alias("old"), F.col("name").alias("target"))
    own = alias.join(owners.drop("kind"), "declaration", "left")
    target = own.join(chain, "owner").join(held, ["ancestor", "old"]).groupBy("id").agg(F.min_by("target", "pos").alias("target"))
    real = definitions.where("kind <> 'AliasMethod' AND kind <> 'MethodVisibility' AND declaration IS NOT NULL").select(F.col("declaration").alias("target")).distinct().withColumn("real", F.lit(True))
    following = alias.groupBy(F.col("declaration").alias("target")).agg(F.min("id").alias("next"))
    hop = own.join(target, "id", "left").join(real, "target", "left").join(following, "target", "left")
    hop = cut(hop.select(F.col("id").alias("at"), "owner", "target", "real", "next"))
    work = cut(alias.select("id", F.col("id").alias("at"), F.array("id").alias("seen")))
    done = None
    while not empty(work):
        step = work.join(hop, "at")
        outcome = (
            F.when(F.col("owner").isNull(), "UnresolvedOwner").when(F.col("target").isNull(), "TargetNotFound")
            .when(F.col("real"), "Resolved").when(F.col("next").isNull(), "TargetNotFound").when(F.array_contains("seen", F.col("next")), "Cycle")
        )
        step = cut(step.withColumn("outcome", outcome))
        ended = step.where("outcome IS NOT NULL").select("id", "outcome", F.when(F.col("outcome") == "Resolved", F.col("target")).alias("target"))
        done = ended if done is None else done.unionAll(ended)
        work = step.where("outcome IS NULL").select("id", F.col("next").alias("at"), F.array_append("seen", F.col("next")).alias("seen"))
    return done if done is not None else alias.select("id", F.lit("").alias("outcome"), F.lit("").alias("target"))


CONSTANTS = ("Class", "Module", "Constant", "ConstantAlias", "<TODO>")
METHOD_DEFINITIONS = ("Method", "AttrAccessor", "AttrReader", "AttrWriter", "MethodVisibility")


def visibility(declarations: DataFrame, definitions: DataFrame, method_aliases: DataFrame | None = None) -> DataFrame:
    """(name, visibility).

    Constants: what their last visibility statement says, else public. Methods: the last definition
    that carries one; module_function is private on the instance's side and public on the
    singleton's; a method with aliases only has its target's; else public. Others have none.
    """
    stated = definitions.where("visibility IS NOT NULL").select(F.col("declaration").alias("name"), F.col("kind").alias("how"), F.col("visibility").alias("v"), "ord")
    const = stated.where("how = 'ConstantVisibility'").groupBy("name").agg(F.max_by("v", "ord").alias("const_v"))
    meth = stated.where(F.col("how").isin(*METHOD_DEFINITIONS)).groupBy("name").agg(F.max_by("v", "ord").alias("method_v"))
    out = declarations.select("name", "kind", "owner").join(const, "name", "left").join(meth, "name", "left")
    singleton = F.col("owner").endswith(">")
    method = F.when(F.col("method_v") == "module_function", F.when(singleton, "public").otherwise("private")).otherwise(F.col("method_v"))
    out = out.withColumn("own", F.when(F.col("kind").isin(*CONSTANTS), F.coalesce("const_v", F.lit("public"))).when(F.col("kind") == "Method", method))
    if method_aliases is not None:
        first = definitions.where("kind = 'AliasMethod'").select("id", "declaration").join(method_aliases, "id").groupBy("declaration").agg(F.min_by("target", "id").alias("target"))
        via = first.join(out.select(F.col("name").alias("target"), F.col("own").alias("via")), "target").select(F.col("declaration").alias("name"), "via")
        out = out.join(via, "name", "left")
    else:
        out = out.withColumn("via", F.lit(None).cast("string"))
    shown = F.when(F.col("kind") == "Method", F.coalesce("own", "via", F.lit("public"))).otherwise(F.col("own"))
    return out.select("name", shown.alias("visibility"))


def visibility_of(names: DataFrame, declarations: DataFrame, definitions: DataFrame) -> DataFrame:
    """visibility() of names(name), a cut table, from their definitions only."""
    own = small(names.distinct())
    return visibility(declarations.join(own, "name", "left_semi"), definitions.join(own.withColumnRenamed("name", "declaration"), "declaration", "left_semi"))


def callable_methods(asks: DataFrame, descendants: DataFrame) -> DataFrame:
    """asks(method, visibility, defined_in, receiver, caller) with visible: whether the caller may call it on the receiver.

    Public: always. Private and module_function: only on the caller itself. Protected: if caller
    and receiver both descend from where it is defined. Unknown: yes.
    """
    under = lambda who: descendants.select(F.col("name").alias("defined_in"), F.col("descendant").alias(who), F.lit(True).alias(f"{who}_in"))
    out = asks.join(under("receiver"), ["defined_in", "receiver"], "left").join(under("caller"), ["defined_in", "caller"], "left")
    test = (
        F.when(F.col("visibility").isin("private", "module_function"), F.coalesce(F.col("caller") == F.col("receiver"), F.lit(False)))
        .when(F.col("visibility") == "protected", F.coalesce("receiver_in", F.lit(False)) & F.coalesce("caller_in", F.lit(False)))
        .otherwise(F.lit(True))
    )
    return out.select(*asks.columns, test.alias("visible"))
