"""Dead code, integrity, orphans, statistics, and the Graphviz export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import html
from ..functions.shared import cut, empty

#: Hops after which a chain of singleton classes counts as endless.
MOST_HOPS = 128
BUILT_IN = "weft:built-in"
TRACKED = ("Class", "Module", "Constant", "ConstantAlias", "<TODO>")


def dead_code(declarations: DataFrame, definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(name, kind): constants that nothing refers to directly, with a definition, none of them built in."""
    own = declarations.where(F.col("kind").isin(*TRACKED)).select("name", "kind")
    used = references.where("declaration IS NOT NULL").select(F.col("declaration").alias("name"))
    defined = definitions.where("declaration IS NOT NULL").select(F.col("declaration").alias("name"), "uri")
    live = own.join(used, "name", "left_anti").join(defined, "name", "left_semi")
    return live.join(defined.where(F.col("uri") == BUILT_IN), "name", "left_anti")


def integrity(declarations: DataFrame) -> DataFrame:
    """(name, error) of declarations(name, kind, owner): the first failed check of each."""
    own = declarations.select("name", "kind", "owner")
    up = declarations.select(F.col("name").alias("owner"), F.col("kind").alias("owner_kind"))
    joined = cut(own.join(up, "owner", "left"))
    ends = _singletons_end(joined)
    space = F.col("owner_kind").isin("Class", "Module", "SingletonClass", "<TODO>")
    error = (
        F.when((F.col("owner") == F.col("name")) & ~F.col("name").isin("Object", "BasicObject"), "UnexpectedSelfOwnership")
        .when(F.col("owner_kind").isNull(), "OwnerDoesNotExist").when(~space, "OwnerIsNotNamespace")
        .when(F.col("endless"), "SingletonClassChainDoesNotTerminate")
    )
    return joined.join(ends, "name", "left").select("name", error.alias("error")).where("error IS NOT NULL")


def _singletons_end(joined: DataFrame) -> DataFrame:
    """(name, endless) of singleton classes whose owners don't lead to another namespace, by pointer doubling."""
    at = joined.where("kind = 'SingletonClass'").select("name", "owner", (F.col("owner_kind") == "SingletonClass").alias("more"))
    hops = cut(at.where("coalesce(more, false)").select("name", F.col("owner").alias("to")))
    reach = 1
    while reach < MOST_HOPS and not empty(hops):
        step = hops.select(F.col("name").alias("to"), F.col("to").alias("far"))
        hops = cut(hops.join(step, "to").select("name", F.col("far").alias("to")))
        reach *= 2
    return hops.select("name", F.lit(True).alias("endless"))


def orphans(definitions: DataFrame) -> DataFrame:
    """(kind, name, location) of definitions that no declaration holds, in the order of kind, file and offset."""
    own = definitions.where("declaration IS NULL").orderBy("kind", "uri", "start", "id")
    return own.select("kind", F.coalesce("str", F.lit("")).alias("name"), F.concat("uri", F.lit("#L"), "line").alias("location"))


def orphan_names(definitions: DataFrame) -> DataFrame:
    """(id, name): the full path of each orphan, its own name after those of the definitions around it.

    Methods and variables stand after '#', constants after '::'. There are as many joins as the deepest nesting.
    """
    own = definitions.select("id", "parent", F.coalesce("str", F.lit("")).alias("str"), "kind", "declaration")
    around = cut(own.select(F.col("id").alias("at"), F.col("parent").alias("up"), F.col("str").alias("outer"), F.col("declaration").alias("known")))
    sign = F.when(F.col("kind").isin("Class", "Module", "SingletonClass", "Constant", "ConstantAlias", "ConstantVisibility"), F.lit("::")).otherwise(F.lit("#"))
    work, done = cut(own.where("declaration IS NULL").select("id", "parent", F.col("str").alias("name"), sign.alias("sign"))), None
    while not empty(work):
        ended = work.where("parent IS NULL").select("id", "name")
        done = ended if done is None else done.unionAll(ended)
        step = work.where("parent IS NOT NULL").join(around, F.col("parent") == F.col("at"), "left")
        # What is declared has its full name already.
        joined = F.concat_ws("", F.coalesce("known", "outer"), "sign", "name")
        work = cut(step.select("id", F.when(F.col("known").isNull(), F.col("up")).alias("parent"), joined.alias("name"), F.lit("::").alias("sign")))
    return done if done is not None else own.where("false").select("id", F.col("str").alias("name"))


def reference_counts(references: DataFrame) -> DataFrame:
    """(path, n, resolved): how often each name is used, and how many of these uses are resolved."""
    return references.groupBy("path").agg(F.count("*").alias("n"), F.count("declaration").alias("resolved"))


def write_orphans(definitions: DataFrame, path: str) -> None:
    """The orphan report as tab-separated text."""
    orphans(definitions).write.mode("overwrite").option("sep", "\t").csv(path)


def statistics(declarations: DataFrame, definitions: DataFrame) -> DataFrame:
    """(measure, kind, value): counts and shares in percent, one decimal; kind is '' for totals."""
    per = definitions.groupBy(F.col("declaration").alias("name")).agg(F.count("*").alias("n"), F.max(F.size("comments") > 0).alias("doc"), F.sum(F.aggregate("comments", F.lit(0), lambda a, x: a + F.octet_length(x))).alias("bytes"))
    own = cut(declarations.select("name", "kind").join(per, "name", "left"))
    share = lambda a, b: F.when(b > 0, F.round(100 * a / b, 1)).otherwise(0.0).cast("double")
    count = F.count(F.lit(1))
    totals = own.agg(
        count.cast("double").alias("declarations"), share(F.count_if(F.coalesce("doc", F.lit(False))), count).alias("documented_percent"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("double").alias("documentation_bytes"), share(F.count_if(F.coalesce("n", F.lit(0)) > 1), count).alias("multi_definition_percent"),
    )
    linked = F.count_if(F.col("declaration").isNotNull())
    defs = definitions.agg(count.cast("double").alias("definitions"), linked.cast("double").alias("linked_definitions"), share(count - linked, count).alias("orphan_percent"))
    out = None
    for df in (totals, defs):
        part = df.unpivot([], df.columns, "measure", "value").select("measure", F.lit("").alias("kind"), "value")
        out = part if out is None else out.unionAll(part)
    by = own.groupBy("kind").agg(count.cast("double").alias("value")).select(F.lit("declarations_of_kind").alias("measure"), "kind", "value")
    lost = definitions.groupBy("kind").agg(count.cast("double").alias("value"), F.count_if(F.col("declaration").isNull()).cast("double").alias("lost"))
    return out.unionAll(by).unionAll(lost.select(F.lit("definitions_of_kind"), "kind", "value")).unionAll(lost.where("lost > 0").select(F.lit("orphans_of_kind"), "kind", "lost"))


def dot_lines(declarations: DataFrame, definitions: DataFrame, built_ins: bool = False) -> DataFrame:
    """(line) of a Graphviz graph of documents, definitions and declarations, in a fixed order."""
    shown = definitions if built_ins else definitions.where(F.col("uri") != BUILT_IN)
    names = declarations if built_ins else declarations.join(shown.select(F.col("declaration").alias("name")), "name", "left_semi")
    node = lambda tag, key, label, shape: F.concat(F.lit('  "'), F.lit(tag), html(key), F.lit('" [label="'), html(label), F.lit(f'", shape={shape}];'))
    edge = lambda a, x, b, y, label: F.concat(F.lit(f'  "{a}'), html(x), F.lit(f'" -> "{b}'), html(y), F.lit(f'" [label="{label}"];'))
    d = lambda c: F.col(c).cast("string")
    parts = [
        (0, declarations.sparkSession.range(1).select(F.lit("digraph code {").alias("line"))),
        (1, shown.select("uri").distinct().select(node("doc:", F.col("uri"), F.col("uri"), "note").alias("line"))),
        (2, shown.select(node("def:", d("id"), F.concat("kind", F.lit(" "), F.coalesce("str", F.lit(""))), "box").alias("line"))),
        (3, names.select(node("decl:", F.col("name"), F.concat("kind", F.lit(" "), "name"), "ellipse").alias("line"))),
        (4, shown.select(edge("doc:", F.col("uri"), "def:", d("id"), "defines").alias("line"))),
        (5, shown.where("declaration IS NOT NULL").select(edge("def:", d("id"), "decl:", F.col("declaration"), "declares").alias("line"))),
        (6, names.join(names.select(F.col("name").alias("owner")), "owner", "left_semi").where("owner <> name").select(edge("decl:", F.col("owner"), "decl:", F.col("name"), "owns").alias("line"))),
        (7, declarations.sparkSession.range(1).select(F.lit("}").alias("line"))),
    ]
    out = None
    for k, df in parts:
        part = df.select(F.lit(k).alias("part"), "line")
        out = part if out is None else out.unionAll(part)
    return out.orderBy("part", "line").select("line")
