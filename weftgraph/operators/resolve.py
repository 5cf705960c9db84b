"""Facts to a code graph: which declaration each definition and reference belongs to.

Names, owners and ancestor chains depend on each other, so they are found in passes, each a few
joins over all that is known, until a pass finds nothing new. What then lacks a parent gets a
placeholder, and the passes go on. Every pass is cut in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import constant_name, singleton_name
from ..functions.shared import cut, empty, small
from ..sources.codegraph import CodeGraph
from ..sources.facts import facts as read_facts
from .linearize import chain_rows, linearize
from .reports import BUILT_IN

CONSTANT_KINDS = ("Class", "Module", "Constant", "ConstantAlias")
SPACES = ("Class", "Module", "SingletonClass", "<TODO>")
BUILT_INS = [("BasicObject", "Class", "Object", None), ("Kernel", "Module", "Object", None), ("Object", "Class", "Object", "BasicObject"), ("Module", "Class", "Object", "Object"), ("Class", "Class", "Object", "Module")]


def built_ins(spark: SparkSession) -> DataFrame:
    """(name, kind, owner, superclass) of what every graph begins with."""
    return spark.createDataFrame(BUILT_INS, "name string, kind string, owner string, superclass string")


def lookup_names(asks: DataFrame, members: DataFrame, ancestors: DataFrame, kinds: DataFrame, aliases: DataFrame) -> DataFrame:
    """(nesting, path, found) of asks(nesting array<string> outermost first, path) that can be resolved.

    The first part is looked for in the lexical scopes, innermost first and in each only among its
    own members; then along the innermost scope's ancestors; then, outside classes or if the chain
    is incomplete, along Object's. Each further part is looked for along the ancestors of what the
    part before it stands for. members: (owner, member, name); kinds: (name, kind, state);
    aliases: (name, resolved).
    """
    own = asks.distinct().withColumn("parts", F.filter(F.split("path", "::"), lambda x: x != "")).withColumn("top", F.col("path").startswith("::"))
    # A number stands for the nesting and the path while members are looked for.
    own = cut(own.withColumn("inner", F.try_element_at("nesting", F.lit(-1))).withColumn("member", F.col("parts")[0]).withColumn("ask", F.monotonically_increasing_id()))
    chain = ancestors.where("tag = 'complete'").select("name", "pos", F.col("ancestor").alias("owner"))
    held = members.select("owner", "member", F.col("name").alias("found"))
    scopes = own.where("NOT top").select("ask", "member", F.posexplode(F.reverse("nesting")).alias("pos", "owner"))
    near = cut(scopes.join(held, ["owner", "member"]).groupBy("ask").agg(F.min_by("found", "pos").alias("found")))
    # Only what no scope has goes on along the chains, which are many times longer.
    open_ = cut(own.select("ask", "member", "inner", "top").join(near, "ask", "left_anti"))
    inner = open_.where("NOT top AND inner IS NOT NULL").join(chain, F.col("inner") == F.col("name")).select("ask", "member", "pos", "owner", F.lit(2).alias("step"))
    loose = open_.join(kinds.select(F.col("name").alias("inner"), "kind", "state"), "inner", "left").where("top OR inner IS NULL OR kind IN ('Module', '<TODO>') OR coalesce(state, 'partial') <> 'complete'")
    last = loose.crossJoin(F.broadcast(chain.where("name = 'Object'").select("pos", "owner"))).select("ask", "member", "pos", "owner", F.lit(3).alias("step"))
    asked = open_.select("member").distinct()
    far = inner.unionAll(last).join(held.join(small(cut(asked)), "member", "left_semi"), ["owner", "member"])
    best = near.unionAll(far.groupBy("ask").agg(F.min_by("found", F.struct("step", "pos")).alias("found")))
    out = own.select("ask", "nesting", "path", "parts").join(best, "ask").drop("ask")
    longest = own.agg(F.max(F.size("parts")).alias("n")).first()["n"] or 1
    for k in range(1, longest):
        now = out.join(aliases.select(F.col("name").alias("found"), "resolved"), "found", "left").withColumn("at", F.coalesce("resolved", "found")).withColumn("member", F.get("parts", F.lit(k)))
        more = now.where("member IS NOT NULL").join(chain, F.col("at") == F.col("name")).drop("found").join(held, ["owner", "member"])
        step = more.groupBy("nesting", "path", "parts").agg(F.min_by("found", "pos").alias("found"))
        out = cut(out.where(F.size("parts") <= k).select("nesting", "path", "parts", "found").unionAll(step))
    return out.select("nesting", "path", "found")


def _nested(defs: DataFrame, spaces: DataFrame) -> DataFrame:
    """defs with nesting, for those whose scopes are all resolved; spaces: (id, name)."""
    each = defs.select("id", F.posexplode("scope").alias("k", "sid")).join(spaces.select(F.col("id").alias("sid"), "name"), "sid")
    lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("ns")).select("id", F.transform("ns", lambda x: x["name"]).alias("ns"))
    out = defs.join(lists, "id", "left").withColumn("nesting", F.coalesce("ns", F.array().cast("array<string>"))).drop("ns")
    return out.where(F.size("nesting") == F.size("scope"))


def _placed(nested: DataFrame, found: DataFrame) -> DataFrame:
    """(id, name, owner) of constant-like definitions whose owner is known."""
    parts = F.split(F.regexp_replace("path", "^::", ""), "::")
    own = nested.withColumn("last", F.element_at(parts, -1)).withColumn("head", F.when(F.size(parts) > 1, F.regexp_extract("path", "^(.*)::[^:]+$", 1)))
    own = own.join(found.select("nesting", F.col("path").alias("head"), F.col("found").alias("held")), ["nesting", "head"], "left")
    top = F.col("path").startswith("::") & F.col("head").isNull()
    owner = F.when(top, F.lit("Object")).when(F.col("head").isNotNull(), F.col("held")).otherwise(F.coalesce(F.try_element_at("nesting", F.lit(-1)), F.lit("Object")))
    constants = own.where(F.col("kind").isin(*CONSTANT_KINDS)).withColumn("owner", owner).where("owner IS NOT NULL")
    constants = constants.select("id", constant_name(F.col("owner"), F.col("last")).alias("name"), "owner")
    singles = nested.where("kind = 'SingletonClass'").join(found, ["nesting", "path"], "left")
    attached = F.when(F.col("path") == "self", F.try_element_at("nesting", F.lit(-1))).otherwise(F.col("found"))
    singles = singles.withColumn("owner", attached).where("owner IS NOT NULL").select("id", singleton_name(F.col("owner")).alias("name"), "owner")
    return constants.unionAll(singles)


def _merged(defs: DataFrame, placed: DataFrame) -> DataFrame:
    """(name, kind, owner): definitions of one name are one declaration; a constant whose definitions may all be promoted gives way to a namespace."""
    own = defs.join(placed, "id").select("name", "owner", "kind", "promotable", F.struct(F.size("scope"), "uri", "start").alias("at"))
    space = F.col("kind").isin("Class", "Module", "SingletonClass")
    by = own.groupBy("name").agg(
        F.min_by("owner", "at").alias("owner"), F.min_by("kind", "at").alias("first"), F.min(F.when(space, F.struct("at", "kind"))).alias("space"),
        F.min(F.when(~space, F.coalesce(F.col("promotable") & (F.col("kind") == "Constant"), F.lit(False)))).alias("soft"),
    )
    return by.select("name", F.when(F.col("space").isNotNull() & F.coalesce("soft", F.lit(True)), F.col("space.kind")).otherwise(F.col("first")).alias("kind"), "owner")


def _alias_ends(defs: DataFrame, placed: DataFrame, nested: DataFrame, found: DataFrame) -> DataFrame:
    """(name, resolved): constant aliases followed to the end; unresolved and cyclic ones are left out."""
    own = nested.where("kind = 'ConstantAlias'").join(placed.select("id", "name"), "id")
    first = own.join(found.select("nesting", F.col("path").alias("target"), F.col("found").alias("to")), ["nesting", "target"])
    first = cut(first.groupBy("name").agg(F.min_by("to", F.struct("uri", "start")).alias("to")))
    work, done = first.select("name", "to", F.array("name", "to").alias("seen")), None
    while True:
        step = first.select(F.col("name").alias("to"), F.col("to").alias("far"))
        longer = cut(work.join(step, "to", "left"))
        ended = longer.where("far IS NULL").select("name", F.col("to").alias("resolved"))
        done = ended if done is None else done.unionAll(ended)
        work = longer.where("far IS NOT NULL AND NOT array_contains(seen, far)").select("name", F.col("far").alias("to"), F.array_append("seen", F.col("far")).alias("seen"))
        if empty(work):
            return done


def resolve(facts: DataFrame, documents: DataFrame | None = None) -> CodeGraph:
    """The code graph of FACTS."""
    spark = facts.sparkSession
    facts = cut(facts)
    defs = facts.where("fact = 'definition'")
    shaped = defs.where(F.col("kind").isin(*CONSTANT_KINDS, "SingletonClass"))
    base = cut(built_ins(spark))
    # The first guess at the namespaces' names is lexical.
    guess = F.when(F.size("lexical") == 0, F.regexp_replace("path", "^::", "")).otherwise(F.concat(F.element_at("lexical", -1), F.lit("::"), "path"))
    single = F.when(F.col("path") == "self", F.try_element_at("lexical", F.lit(-1))).otherwise(F.col("path"))
    spaces = cut(shaped.select("id", F.when(F.col("kind") == "SingletonClass", singleton_name(single)).otherwise(guess).alias("name")))
    todo = spark.createDataFrame([], "name string, kind string, owner string")
    found = spark.createDataFrame([], "nesting array<string>, path string, found string")
    none = spark.createDataFrame([], "name string, resolved string")
    known, filled, memo = None, False, {}
    aliased = not empty(defs.where("kind = 'ConstantAlias'"))
    while True:
        nested = cut(_nested(defs, spaces))
        placed = cut(_placed(nested.where(F.col("kind").isin(*CONSTANT_KINDS, "SingletonClass")), found))
        decls = _merged(shaped, placed).unionAll(todo)
        decls = cut(base.select("name", "kind", "owner").join(decls.select("name"), "name", "left_anti").unionAll(decls.join(base.select("name"), "name", "left_anti")).unionAll(base.select("name", "kind", "owner").join(decls.select("name"), "name", "left_semi")))
        aliases = cut(_alias_ends(defs, placed, nested, found)) if aliased else none
        real = lambda c: F.coalesce("resolved", c)
        follow = lambda df, c: df.join(aliases.withColumnRenamed("name", c), c, "left").withColumn(c, real(F.col(c))).drop("resolved")
        inside = nested.join(placed.select("id", "name"), "id").where(F.col("kind").isin("Class", "Module", "SingletonClass"))
        ups = inside.where("superclass IS NOT NULL").join(found.select("nesting", F.col("path").alias("superclass"), F.col("found")), ["nesting", "superclass"], "left")
        ups = follow(ups.withColumn("up", F.coalesce("found", "superclass")).drop("found"), "up").groupBy("name").agg(F.min_by("up", F.struct(F.size("scope"), "uri", "start")).alias("up"))
        mixed = inside.select("id", "name", "uri", "start", "nesting", F.posexplode("mixins").alias("k", "m")).select("name", "uri", "start", "nesting", "k", "m.kind", F.col("m.target").alias("path"))
        mixed = follow(mixed.join(found, ["nesting", "path"], "left").withColumn("to", F.coalesce("found", "path")).drop("found"), "to")
        ord_ = F.row_number().over(Window.partitionBy("name").orderBy("uri", "start", "k")).cast("int")
        mixed = cut(mixed.select("name", ord_.alias("ord"), "kind", F.col("to").alias("target")))
        chains, ancestors, singles = _chains(decls, base, ups, mixed, inside, nested, found, memo)
        members = decls.where("kind <> 'SingletonClass' AND NOT (name = 'Object' AND owner = 'Object')").select("owner", F.element_at(F.split("name", "::"), -1).alias("member"), "name")
        kinds = decls.select("name", "kind").join(chains.select("name", "state"), "name", "left")
        uses = facts.where("fact = 'constant' OR fact = 'call' AND receiver IS NOT NULL").withColumn("path", F.when(F.col("fact") == "call", F.col("receiver")).otherwise(F.col("path")))
        asks = _asks(nested, _nested(uses, placed.select("id", "name")))
        found = cut(lookup_names(asks, members, ancestors, kinds, aliases))
        spaces = placed.select("id", "name")
        now = (_digest(placed), _digest(found))
        if now != known:
            known = now
            continue
        if filled:
            break
        filled = True
        heads = nested.where(F.col("kind").isin(*CONSTANT_KINDS)).join(placed, "id", "left_anti").select(F.regexp_extract("path", "^:*(.*)::[^:]+$", 1).alias("name"))
        todo = cut(heads.where("name <> ''").select(F.split("name", "::")[0].alias("name")).distinct().join(decls.select("name"), "name", "left_anti").select("name", F.lit("<TODO>").alias("kind"), F.lit("Object").alias("owner")))
        if not todo.limit(1).count():
            break
        known = None
    return _assemble(facts, documents, nested, placed, decls, singles, chains, ancestors, members, found, aliases)


def _digest(df: DataFrame) -> tuple:
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _asks(nested: DataFrame, refs: DataFrame) -> DataFrame:
    """(nesting, path): every name that is to be resolved."""
    head = nested.where(F.col("kind").isin(*CONSTANT_KINDS)).select("nesting", F.regexp_extract("path", "^(.*)::[^:]+$", 1).alias("path"))
    parts = [
        head, nested.where("kind = 'SingletonClass' AND path <> 'self'").select("nesting", "path"), nested.select("nesting", F.col("superclass").alias("path")),
        nested.select("nesting", F.col("target").alias("path")), nested.select("nesting", F.explode("mixins").alias("m")).select("nesting", F.col("m.target").alias("path")),
        nested.where("receiver IS NOT NULL AND receiver <> 'self'").select("nesting", F.col("receiver").alias("path")), refs.select("nesting", "path"),
    ]
    return reduce(DataFrame.unionAll, parts).where("path IS NOT NULL AND path <> ''").distinct()


def _chains(decls, base, ups, mixed, inside, nested, found, memo: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains, their rows, the singleton classes (name, owner) that exist); memo: the chains of the pass before."""
    spaces = decls.where(F.col("kind").isin("Class", "Module", "<TODO>")).join(ups, "name", "left").join(base.select("name", F.col("superclass").alias("given")), "name", "left")
    up = F.when(F.col("kind") == "Class", F.when(F.col("name") == "BasicObject", F.lit(None)).otherwise(F.coalesce("up", "given", F.lit("Object"))))
    spaces = cut(spaces.select("name", "kind", up.alias("superclass")))
    spark = decls.sparkSession
    kernel = spark.createDataFrame([("Object", 0, "include", "Kernel")], "name string, ord int, kind string, target string")
    plain = mixed.where("kind <> 'extend'").unionAll(kernel)
    opened = decls.where("kind = 'SingletonClass'").select(F.col("owner").alias("of"))
    receivers = nested.where("kind IN ('Method', 'MethodVisibility', 'InstanceVariable') AND singleton").join(found.select("nesting", F.col("path").alias("receiver"), "found"), ["nesting", "receiver"], "left")
    via = receivers.select(F.coalesce("found", F.try_element_at("nesting", F.lit(-1))).alias("of")).where("of IS NOT NULL")
    extended = mixed.where("kind = 'extend'").select(F.col("name").alias("of"))
    wanted = cut(opened.unionAll(via).unionAll(extended).distinct())
    while True:  # a class' singleton inherits from its superclass' singleton
        more = wanted.join(spaces.select(F.col("name").alias("of"), "superclass"), "of").where("superclass IS NOT NULL").select(F.col("superclass").alias("of")).join(spaces.select(F.col("name").alias("of")), "of", "left_semi")
        new = cut(more.join(wanted, "of", "left_anti").distinct())
        if not new.limit(1).count():
            break
        wanted = cut(wanted.unionAll(new))
    kinds = spaces.unionAll(decls.where("kind = 'SingletonClass'").select("name", "kind", F.lit(None).cast("string")))
    singles = wanted.join(kinds.select(F.col("name").alias("of"), "kind", "superclass"), "of")
    parent = F.when(F.col("kind").isin("Module", "<TODO>"), F.lit("Module")).when(F.col("superclass").isNotNull(), singleton_name(F.col("superclass"))).otherwise(F.lit("Class"))
    singles = cut(singles.select(singleton_name(F.col("of")).alias("name"), F.lit("Class").alias("kind"), parent.alias("superclass"), "of"))
    missing = singles.select("name", "kind", F.when(F.col("superclass").endswith(">") & ~F.col("superclass").isin("Class", "Module"), F.col("superclass")).otherwise(F.col("superclass")).alias("superclass"))
    extends = mixed.where("kind = 'extend'").select(singleton_name(F.col("name")).alias("name"), "ord", F.lit("include").alias("kind"), "target")
    every, mixins = cut(spaces.unionAll(missing)), cut(plain.select("name", "ord", "kind", "target").unionAll(extends))
    # Most passes leave superclasses and mixins as they were, and so the chains.
    marks = (_digest(every), _digest(mixins))
    if memo.get("of") != marks:
        memo["of"], memo["chains"] = marks, cut(linearize(every, mixins))
        memo["rows"] = cut(chain_rows(memo["chains"]))
    return memo["chains"], memo["rows"], singles.select("name", F.col("of").alias("owner"))


def _assemble(facts, documents, nested, placed, decls, singles, chains, ancestors, members, found, aliases) -> CodeGraph:
    defs = nested.join(placed.select("id", F.col("name").alias("declaration")), "id", "left")
    receiver = found.select("nesting", F.col("path").alias("receiver"), F.col("found").alias("of"))
    rest = defs.where(~F.col("kind").isin(*CONSTANT_KINDS, "SingletonClass")).join(receiver, ["nesting", "receiver"], "left")
    scope = F.try_element_at("nesting", F.lit(-1))
    outer = F.try_element_at(F.filter("nesting", lambda n: ~n.endswith(">")), F.lit(-1))
    space = F.coalesce(scope, F.lit("Object"))
    attached = F.when(F.col("receiver").isNotNull() & (F.col("receiver") != "self"), F.col("of")).otherwise(space)
    method = F.when(F.col("singleton"), F.when(attached.isNotNull(), singleton_name(attached))).otherwise(space)
    owner = (
        F.when(F.col("kind").startswith("GlobalVariable"), F.lit("Object")).when(F.col("kind") == "ClassVariable", outer)
        .when(F.col("kind").isin("ConstantVisibility"), space).when((F.col("kind") == "InstanceVariable") & F.col("singleton") & scope.isNotNull(), singleton_name(space)).otherwise(method)
    )
    rest = cut(rest.withColumn("owner", owner))
    bare = F.col("kind") == "GlobalVariable"
    named = rest.withColumn("declared", F.when(bare, F.col("path")).when(F.col("kind") == "ConstantVisibility", constant_name(F.col("owner"), F.col("path"))).otherwise(F.concat("owner", F.lit("#"), "path")))
    held = named.where("owner IS NOT NULL AND kind NOT IN ('MethodVisibility', 'ConstantVisibility')")
    shown = F.when(F.col("kind").isin("AttrAccessor", "AttrReader", "AttrWriter", "AliasMethod"), F.lit("Method")).otherwise(F.col("kind"))
    others = held.select(F.col("declared").alias("name"), shown.alias("kind"), "owner", "path").dropDuplicates(["name"])
    chain = ancestors.where("tag = 'complete'").select(F.col("name").alias("owner"), F.col("ancestor"))
    marks = named.where("kind = 'MethodVisibility'")
    there = marks.select("id", "owner", "path").join(chain, "owner").join(others.where("kind = 'Method'").select(F.col("owner").alias("ancestor"), "path"), ["ancestor", "path"]).select("id").distinct()
    constants = named.where("kind = 'ConstantVisibility'").join(members.select("owner", F.col("member").alias("path")), ["owner", "path"], "left_semi").select("id")
    good = cut(held.select("id").unionAll(there).unionAll(constants))
    inherited = marks.join(there, "id", "left_semi").select(F.col("declared").alias("name"), F.lit("Method").alias("kind"), "owner", "path").dropDuplicates(["name"]).join(others.select("name"), "name", "left_anti")
    everything = cut(others.unionAll(inherited))
    rest = named.join(good, "id", "left_semi").select("id", F.col("declared").alias("declaration")).unionAll(placed.select("id", F.col("name").alias("declaration")))
    single = singles.select("name", F.lit("SingletonClass").alias("kind"), "owner").join(decls.select("name"), "name", "left_anti")
    all_decls = decls.unionAll(single).unionAll(everything.select("name", "kind", "owner"))
    all_decls = all_decls.join(singles.select(F.col("owner").alias("name"), F.col("name").alias("singleton")), "name", "left")
    every = nested.join(rest, "id", "left")
    to = found.select("nesting", F.col("path").alias("target"), F.col("found").alias("to"))
    every = every.join(to, ["nesting", "target"], "left").join(found.select("nesting", F.col("path").alias("superclass"), F.col("found").alias("up")), ["nesting", "superclass"], "left")
    mixed = every.select("id", "nesting", F.posexplode("mixins").alias("k", "m")).select("id", "nesting", "k", F.col("m.kind").alias("mk"), F.col("m.target").alias("path")).join(found, ["nesting", "path"])
    mixed = mixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.col("mk").alias("kind"), F.col("found").alias("target")))).alias("ms"))
    every = every.drop("mixins").join(mixed, "id", "left")
    order = F.row_number().over(Window.partitionBy("declaration").orderBy("uri", "start", "id")) - 1
    definitions = every.select(
        "id", "uri", "kind", "declaration", F.when(F.col("declaration").isNotNull(), order).cast("int").alias("ord"), "start", "end", "line", F.col("path").alias("str"), F.col("old").alias("old_str"),
        F.col("to").alias("target"), "visibility", "deprecated", "comments", "params", F.col("up").alias("superclass"),
        F.coalesce(F.transform("ms", lambda x: F.struct(x["kind"].alias("kind"), x["target"].alias("target"))), F.array().cast("array<struct<kind: string, target: string>>")).alias("mixins"),
        F.try_element_at("scope", F.lit(-1)).alias("parent"),
    )
    refs = facts.where("fact = 'constant'")
    refs = _nested(refs, placed.select("id", "name")).join(found, ["nesting", "path"], "left").select("uri", "start", "end", "line", F.lit(None).cast("int").alias("column"), "path", F.col("found").alias("declaration"))
    calls = _nested(facts.where("fact = 'call'"), placed.select("id", "name")).join(receiver, ["nesting", "receiver"], "left")
    calls = calls.select("uri", "start", "end", F.col("path").alias("message"), "receiver", F.col("of").alias("declaration"))
    lost = named.join(good, "id", "left_anti").where("kind IN ('MethodVisibility', 'ConstantVisibility')")
    rule = F.when(F.col("kind") == "MethodVisibility", "UndefinedMethodVisibilityTarget").otherwise("UndefinedConstantVisibilityTarget")
    diagnostics = facts.where("fact = 'diagnostic'").select(F.col("kind").alias("rule"), "uri", "start", "end", "line", F.col("path").alias("message"))
    diagnostics = diagnostics.unionAll(lost.select(rule, "uri", "start", "end", "line", F.concat(F.lit("undefined: "), "path")))
    all_members = members.unionAll(everything.select("owner", F.col("path").alias("member"), "name"))
    documents = documents if documents is not None else facts.select("uri", F.lit(None).cast("long").alias("content_hash")).distinct()
    return CodeGraph(
        documents, cut(definitions), cut(all_decls.select("name", "kind", "owner", "singleton")), cut(all_members), ancestors, cut(refs), cut(calls), cut(diagnostics)
    )


def index(sources: DataFrame) -> CodeGraph:
    """The code graph of sources(uri, source)."""
    documents = cut(sources.select("uri", F.xxhash64("source").alias("content_hash")))
    return resolve(read_facts(sources), documents)


__all__ = ["resolve", "index", "lookup_names", "built_ins", "BUILT_IN"]
