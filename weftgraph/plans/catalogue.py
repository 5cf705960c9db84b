"""A code base made from the star-schema tables, as SQL that Spark and DuckDB read alike.

Parts are classes P1, P2, ... in a module of their brand, each a subclass of the part at a quarter of
its number; suppliers are modules that classes include; lines are methods and references;
customers are constant aliases that lead to each other, to classes, nowhere, or round in circles.
Ancestor chains have a closed form (powers of four), so that they can be had without the resolver.
"""

from __future__ import annotations

import re
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..operators.reports import BUILT_IN
from ..sources.codegraph import SCHEMAS, CodeGraph
from ..sources.tables import read

TABLES = ("region", "nation", "customer", "supplier", "part", "lineitem", "events")
_LEVELS = ", ".join(f"({i}, {4**i})" for i in range(16))
_NONE = "CAST(NULL AS STRING)"


def _decl(name: str, kind: str, owner: str, rest: str = "", singleton: str = _NONE) -> str:
    return f"SELECT {name} AS name, '{kind}' AS kind, {owner} AS owner, {singleton} AS singleton {rest}"


def _def(id_: str, uri: str, kind: str, decl: str, rest: str, at: str = "k * 100", ord_: str = "0", str_: str = _NONE, old: str = _NONE, target: str = _NONE, vis: str = _NONE, said: str = "0", keys: str = "false", up: str = _NONE, parent: str = "CAST(NULL AS BIGINT)") -> str:
    return (
        f"SELECT CAST({id_} AS BIGINT) AS id, {uri} AS uri, '{kind}' AS kind, {decl} AS declaration, {ord_} AS ord, CAST({at} AS INT) AS start_at, CAST({at} + 5 AS INT) AS end_at, CAST({at} AS INT) AS line, {str_} AS str, "
        f"{old} AS old_str, {target} AS target, {vis} AS visibility, CAST({said} AS INT) AS said, {keys} AS keys, {up} AS superclass, CAST({parent} AS BIGINT) AS parent {rest}"
    )


_FILE, _SINGLE = "'file:///w/lib/' || brand || '.rb'", "cls || '::<P' || k || '>'"
_MODS = "'file:///w/lib/mods.rb'"
_UNION = " UNION ALL "

#: Name to text, in order of dependence; tables in braces.
CTES: dict[str, str] = {
    "p": "SELECT p_partkey + 1 AS k, p_partkey, 'B' || substr(p_brand, 7) AS brand, 'B' || substr(p_brand, 7) || '::P' || (p_partkey + 1) AS cls, p_size AS size FROM {part}",
    "s": "SELECT s_suppkey + 1 AS k, 'S' || (s_suppkey + 1) AS name FROM {supplier}",
    "n": "SELECT CAST(n_nationkey AS BIGINT) + 1 AS k FROM {nation}",
    "lv": f"SELECT * FROM (VALUES {_LEVELS}) t(i, w)",
    "l": "SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk, l_linenumber AS no, l_orderkey AS ok FROM {lineitem}",
    "pm": "SELECT DISTINCT p.k, p.cls, p.brand, p.size, l.no FROM l JOIN p ON l.pk = p.p_partkey",
    "sm": "SELECT DISTINCT s.k, s.name, l.no FROM l JOIN s ON l.sk + 1 = s.k WHERE l.no <= 3",
    "br": "SELECT DISTINCT brand, CAST(substr(brand, 2) AS BIGINT) AS k FROM p",
    "c": "SELECT c_custkey + 1 AS k FROM {customer}",
    "decls": _UNION.join([
        _decl("'BasicObject'", "Class", "'Object'"), _decl("'Kernel'", "Module", "'Object'"), _decl("'Object'", "Class", "'Object'"),
        _decl("brand", "Module", "'Object'", "FROM br"), _decl("cls", "Class", "brand", "FROM p", f"CASE WHEN size <= 5 THEN {_SINGLE} END"),
        _decl(_SINGLE, "SingletonClass", "cls", "FROM p WHERE size <= 5"), _decl("name", "Module", "'Object'", "FROM s"), _decl("'W' || k", "Module", "'Object'", "FROM n"), _decl("'K' || k", "Module", "'Object'", "FROM n"),
        _decl("cls || '#m' || no || '()'", "Method", "cls", "FROM pm"), _decl("name || '#s' || no || '()'", "Method", "name", "FROM sm"), _decl(f"{_SINGLE} || '#make()'", "Method", _SINGLE, "FROM p WHERE size <= 5"),
        _decl("cls || '#@size'", "InstanceVariable", "cls", "FROM p WHERE size % 2 = 0"), _decl("cls || '::SIZE'", "Constant", "cls", "FROM p WHERE size >= 40"), _decl("'$g' || k", "GlobalVariable", "'Object'", "FROM n"),
        _decl("cls || '#al()'", "Method", "cls", "FROM p WHERE size % 5 = 0"), _decl("cls || '#al2()'", "Method", "cls", "FROM p WHERE size % 10 = 0"), _decl("cls || '#cy()'", "Method", "cls", "FROM p WHERE size = 7"), _decl("cls || '#cy2()'", "Method", "cls", "FROM p WHERE size = 7"),
        _decl("'A' || k", "ConstantAlias", "'Object'", "FROM c"), _decl("'Lost' || k", "Class", "'Ghost'", "FROM n"), _decl("'Own' || k", "Class", "'Own' || k", "FROM n"), _decl("'Odd' || k", "Class", "cls || '::SIZE'", "FROM p WHERE size = 50"),
        _decl("'X' || k", "SingletonClass", "'Y' || k", "FROM n"), _decl("'Y' || k", "SingletonClass", "'X' || k", "FROM n"),
    ]),
    "members": "SELECT d.owner, regexp_replace(d.name, '^.*(::|#)', '') AS member, d.name FROM decls d JOIN (SELECT DISTINCT name FROM decls) o ON o.name = d.owner WHERE d.kind <> 'SingletonClass' AND d.name <> 'Object' AND d.owner <> d.name",
    "mix": "SELECT p.cls AS name, 0 AS ord, 'include' AS kind, s.name AS target FROM p JOIN s ON p.k = s.k UNION ALL SELECT p.cls, 1, 'prepend', 'W' || n.k FROM p JOIN n ON p.k = n.k UNION ALL SELECT s.name, 0, 'include', 'K' || n.k FROM s JOIN n ON s.k = n.k UNION ALL SELECT cls, 2, 'extend', CASE WHEN k % 2 = 0 THEN 'K1' ELSE 'A5' END FROM p WHERE size <= 5",
    "up": "SELECT p.k, p.cls, a.cls AS acls, a.k AS ak, lv.i FROM p JOIN lv ON p.k >= lv.w JOIN p a ON a.k = CAST(floor(p.k / lv.w) AS BIGINT)",
    "anc": "SELECT name, 'complete' AS state, pos, 'complete' AS tag, ancestor FROM (" + _UNION.join([
        "SELECT cls AS name, 4 * i AS pos, 'W' || n.k AS ancestor FROM up JOIN n ON n.k = ak", "SELECT cls, 4 * i + 1, acls FROM up", "SELECT cls, 4 * i + 2, s.name FROM up JOIN s ON s.k = ak", "SELECT cls, 4 * i + 3, 'K' || n.k FROM up JOIN s ON s.k = ak JOIN n ON n.k = ak",
        "SELECT cls, 100 + v.j, v.r FROM p CROSS JOIN (VALUES (0, 'Object'), (1, 'Kernel'), (2, 'BasicObject')) v(j, r)", "SELECT 'Object', v.j, v.r FROM (VALUES (0, 'Object'), (1, 'Kernel'), (2, 'BasicObject')) v(j, r)",
        "SELECT 'Kernel', 0, 'Kernel'", "SELECT 'BasicObject', 0, 'BasicObject'", "SELECT s.name, 0, s.name FROM s", "SELECT s.name, 1, 'K' || n.k FROM s JOIN n ON s.k = n.k", "SELECT 'W' || k, 0, 'W' || k FROM n", "SELECT 'K' || k, 0, 'K' || k FROM n", "SELECT brand, 0, brand FROM br",
    ]) + ") t",
    "ca": "SELECT c.k, CASE WHEN c.k % 5 = 0 THEN q.cls WHEN c.k % 13 = 0 THEN NULL WHEN c.k % 97 = 0 THEN 'A' || (c.k - 1) ELSE 'A' || (c.k + 1) END AS target FROM c LEFT JOIN p q ON q.k = c.k % 100 + 1",
    "defs": _UNION.join([
        *(_def(str(i), f"'{BUILT_IN}'", kind, f"'{x}'", "", str(i), str_=f"'{x}'") for i, kind, x in ((1, "Class", "Object"), (2, "Module", "Kernel"), (3, "Class", "BasicObject"))),
        _def("1000000000 + p.k", "'file:///w/lib/' || p.brand || '.rb'", "Class", "p.cls", "FROM p LEFT JOIN p u ON u.k = CAST(floor(p.k / 4) AS BIGINT)", "p.k * 100", str_="'P' || p.k", said="p.k % 3", up="u.cls"),
        _def("2000000000 + k", "'file:///w/ext/reopen.rb'", "Class", "cls", "FROM p WHERE k % 5 = 0", ord_="1", str_="'P' || k"),
        _def("2500000000 + k", _FILE, "SingletonClass", _SINGLE, "FROM p WHERE size <= 5", "k * 100 + 60", str_="'<P' || k || '>'", parent="1000000000 + k"),
        _def("3000000000 + k * 10 + no", _FILE, "Method", "cls || '#m' || no || '()'", "FROM pm", "k * 100 + no", str_="'m' || no || '()'", vis="CASE no % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'public' WHEN 2 THEN 'protected' END", keys="no = 3", parent="1000000000 + k"),
        _def("3500000000 + k * 10 + no", _FILE, "MethodVisibility", "cls || '#m' || no || '()'", "FROM pm WHERE no = 1 AND k % 3 = 0", "k * 100 + 80", "1", "'m' || no || '()'", vis="'private'", parent="1000000000 + k"),
        _def("4000000000 + k", _FILE, "Method", f"{_SINGLE} || '#make()'", "FROM p WHERE size <= 5", "k * 100 + 61", str_="'make()'", vis="'module_function'", parent="2500000000 + k"),
        _def("5000000000 + k * 10 + no", _MODS, "Method", "name || '#s' || no || '()'", "FROM sm", "k * 100 + no", str_="'s' || no || '()'", vis="'public'", parent="5500000000 + k"),
        _def("5500000000 + k", _MODS, "Module", "name", "FROM s", str_="name"), _def("5600000000 + k", _MODS, "Module", "'W' || k", "FROM n", str_="'W' || k"), _def("5700000000 + k", _MODS, "Module", "'K' || k", "FROM n", str_="'K' || k"),
        _def("5800000000 + k", _FILE, "Module", "brand", "FROM br", str_="brand"),
        _def("6000000000 + k", _FILE, "Constant", "cls || '::SIZE'", "FROM p WHERE size >= 40", "k * 100 + 70", str_="'SIZE'", parent="1000000000 + k"),
        _def("6500000000 + k", _FILE, "ConstantVisibility", "cls || '::SIZE'", "FROM p WHERE size >= 40 AND k % 2 = 0", "k * 100 + 71", "1", "'SIZE'", vis="'private'", parent="1000000000 + k"),
        _def("7000000000 + k", _FILE, "InstanceVariable", "cls || '#@size'", "FROM p WHERE size % 2 = 0", "k * 100 + 72", str_="'@size'", parent="1000000000 + k"), _def("7500000000 + k", _MODS, "GlobalVariable", "'$g' || k", "FROM n", str_="'$g' || k"),
        *(_def(f"{i}00000000 + k", _FILE, "AliasMethod", f"cls || '#{a}()'", f"FROM p WHERE {w}", f"k * 100 + {i}", str_=f"'{a}()'", old=f"'{b}()'", parent="1000000000 + k") for i, a, b, w in ((80, "al", "m1", "size % 5 = 0"), (81, "al2", "al", "size % 10 = 0"), (82, "cy", "cy2", "size = 7"), (83, "cy2", "cy", "size = 7"))),
        _def("8500000000 + k", "'file:///w/lib/alias.rb'", "ConstantAlias", "'A' || k", "FROM ca", str_="'A' || k", target="target"), _def("9000000000 + k", "'file:///w/lib/orphan.rb'", "Method", _NONE, "FROM n", str_="'lost' || k || '()'"),
    ]),
    "refs": "SELECT 'file:///w/app/o' || (l.ok % 200) || '.rb' AS uri, CAST(l.ok * 10 + l.no AS INT) AS start_at, CAST(l.ok * 10 + l.no + 3 AS INT) AS end_at, CAST(l.ok AS INT) AS line, l.no AS col, p.cls AS path, CASE WHEN p.k % 7 = 0 THEN NULL ELSE p.cls END AS declaration FROM l JOIN p ON l.pk = p.p_partkey WHERE l.no = 1",
    "docs": "SELECT DISTINCT uri FROM defs UNION SELECT uri FROM refs",
    "diags": "SELECT CASE event_type WHEN 'error' THEN 'ParseError' WHEN 'click' THEN 'ParseWarning' WHEN 'purchase' THEN 'DynamicAncestor' ELSE 'Style' END AS rule, CASE user_id % 5 WHEN 0 THEN 'file:///w/vendor/v.rb' WHEN 1 THEN 'untitled:1' WHEN 2 THEN 'file:///gems/g.rb' WHEN 3 THEN 'file:///w/lib/a.rb' ELSE 'file:///w/app/b.rb' END AS uri, CAST(event_id AS INT) AS start_at, CAST(event_id + 1 AS INT) AS end_at, CAST(user_id AS INT) AS line, 'event ' || event_id AS message FROM {events}",
}


#: The same tables where Spark has a shorter way to them; the twins keep the texts above.
SPARK: dict[str, str] = CTES | {
    # Lines are told apart only as far as the table needs it.
    "pm": "SELECT p.k, p.cls, p.brand, p.size, l.no FROM (SELECT DISTINCT l_partkey AS pk, l_linenumber AS no FROM {lineitem}) l JOIN (SELECT DISTINCT * FROM p) p ON l.pk = p.p_partkey",
    "sm": "SELECT s.k, s.name, l.no FROM (SELECT DISTINCT l_suppkey AS sk, l_linenumber AS no FROM {lineitem} WHERE l_linenumber <= 3) l JOIN (SELECT DISTINCT * FROM s) s ON l.sk + 1 = s.k",
    # Every owner but Ghost, and those of the singleton classes X and Y, is declared by its own row's making.
    "members": "SELECT owner, regexp_replace(name, '^.*(::|#)', '') AS member, name FROM decls WHERE kind <> 'SingletonClass' AND name <> 'Object' AND owner <> name AND owner <> 'Ghost'",
    # All that a part brings into chains stands with it, so that each level of each part is joined once.
    "own": """SELECT p.k, concat(array(named_struct('at', 1, 'name', p.cls)), array_repeat(named_struct('at', 0, 'name', 'W' || p.k), coalesce(m.times, 0)),
        transform(coalesce(q.names, array()), x -> named_struct('at', 2, 'name', x)), array_repeat(named_struct('at', 3, 'name', 'K' || p.k), coalesce(m.times * size(q.names), 0))) AS around
        FROM p LEFT JOIN (SELECT k, collect_list(name) AS names FROM s GROUP BY k) q ON q.k = p.k LEFT JOIN (SELECT k, CAST(count(*) AS INT) AS times FROM n GROUP BY k) m ON m.k = p.k""",
    "anc": _UNION.join([
        "SELECT name, 'complete' AS state, 4 * i + e.at AS pos, 'complete' AS tag, e.name AS ancestor FROM (SELECT u.name, u.i, explode(own.around) AS e FROM (SELECT p.cls AS name, lv.i, CAST(floor(p.k / lv.w) AS BIGINT) AS ak FROM p JOIN lv ON p.k >= lv.w) u JOIN own ON own.k = u.ak)",
        "SELECT name, 'complete', pos, 'complete', ancestor FROM (" + CTES["anc"][CTES["anc"].index("SELECT cls, 100 + v.j") :].replace("SELECT cls, 100 + v.j, v.r", "SELECT cls AS name, 100 + v.j AS pos, v.r AS ancestor", 1),
    ]),
}
SPARK["docs"] = f"SELECT DISTINCT uri FROM ({CTES['defs']}) t UNION SELECT uri FROM ({CTES['refs']}) t"
#: Tables that are written when they are first asked for, and read wherever another one or a query names them.
WRITTEN = ("pm", "decls", "members", "anc", "mix", "refs", "diags", "defs", "docs")


def spark_text(body: str) -> str:
    """body with those of Spark's tables before it that it needs; in braces what is read."""
    found: dict[str, str] = {}

    def reach(part: str) -> None:
        for k in SPARK:
            if k not in found and re.search(rf"\b(?:FROM|JOIN) {k}\b", part):
                found[k] = f"SELECT * FROM {{{k}}}" if k in WRITTEN else SPARK[k]
                reach(found[k])

    reach(body)
    return f"WITH {', '.join(f'{k} AS ({found[k]})' for k in SPARK if k in found)} {body}" if found else body


def text(body: str, *more: str, recursive: bool = False) -> str:
    """body with the tables as common table expressions before it, and more of these (name AS (...))."""
    parts = [*(f"{k} AS ({v})" for k, v in CTES.items()), *more]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def duck(body: str, *more: str, recursive: bool = False) -> str:
    """The same for DuckDB."""
    found = text(body, *more, recursive=recursive)
    for t in TABLES:
        found = found.replace("{" + t + "}", t)
    return found


#: Folders of the tables that were written, by application, source and name.
_written: dict[tuple[str, str, str], str] = {}


class Code:
    """The tables of the code base as DataFrames, each made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A table, written to the shared folder when it is first asked for in an application."""
        path = _written.get(key := (self.spark.sparkContext.applicationId, self.sf_dir, name))
        if path is None:
            path = _written[key] = f"{shared_dir(self.spark)}/code-{uuid.uuid4().hex}"
            self.sql(SPARK[name]).write.parquet(path)
        return self.spark.read.parquet(path)

    def sql(self, body: str) -> DataFrame:
        whole = spark_text(body)
        own = {t: self.table(t) for t in WRITTEN if "{" + t + "}" in whole}
        return self.spark.sql(whole, **own, **{t: read(self.spark, self.sf_dir, t) for t in TABLES if "{" + t + "}" in whole})

    decls = cached_property(lambda self: self.table("decls"))
    members = cached_property(lambda self: self.table("members"))
    anc = cached_property(lambda self: self.table("anc"))
    mix = cached_property(lambda self: self.table("mix"))
    refs = cached_property(lambda self: self.table("refs").withColumnsRenamed({"start_at": "start", "end_at": "end", "col": "column"}))
    diags = cached_property(lambda self: self.table("diags").withColumnsRenamed({"start_at": "start", "end_at": "end"}))

    @cached_property
    def defs(self) -> DataFrame:
        mixed = self.mix.groupBy(F.col("name").alias("declaration")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "target"))), lambda x: F.struct(x["kind"].alias("kind"), x["target"].alias("target"))).alias("ms"))
        param = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"))
        params = F.when(F.col("keys"), F.array(param("required_positional", "who"), param("required_keyword", "loud"), param("optional_keyword", "times"))).otherwise(F.array().cast("array<struct<kind: string, name: string>>"))
        out = self.table("defs").withColumnsRenamed({"start_at": "start", "end_at": "end"}).withColumn("comments", F.array_repeat(F.lit("# Said."), F.col("said"))).withColumn("params", params)
        first = F.col("kind").isin("Class", "Module") & (F.col("ord") == 0)
        out = out.join(mixed, "declaration", "left").withColumn("mixins", F.when(first & F.col("ms").isNotNull(), F.col("ms")).otherwise(F.array().cast("array<struct<kind: string, target: string>>")))
        return out.withColumn("deprecated", F.lit(False)).drop("ms", "keys", "said")

    @property
    def graph(self) -> CodeGraph:
        return CodeTables(self)

    def one(self, body: str) -> str:
        """The only value of a query."""
        return self.sql(body).first()[0]


class CodeTables(CodeGraph):
    """The code base as a graph whose tables are made when they are asked for, as most queries need few of them."""

    def __init__(self, code: Code) -> None:
        object.__setattr__(self, "code", code)

    spark = property(lambda self: self.code.spark)
    documents = property(lambda self: self.code.table("docs").withColumn("content_hash", F.xxhash64("uri")))
    definitions = property(lambda self: self.code.defs)
    declarations = property(lambda self: self.code.decls)
    members = property(lambda self: self.code.members)
    ancestors = property(lambda self: self.code.anc)
    constant_references = property(lambda self: self.code.refs)
    method_references = property(lambda self: self.code.refs.select("uri", "start", "end", F.lit("run").alias("message"), F.col("path").alias("receiver"), "declaration"))
    diagnostics = property(lambda self: self.code.diags)

    def changed(self, **tables: DataFrame) -> CodeGraph:
        return CodeGraph(**{k: getattr(self, k) for k in SCHEMAS}).changed(**tables)
