"""Queries of the code-graph operators over a code base made from the tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.names import column_of, line_of, name_depth, relative_to, signature, unqualified
from ..operators import aliases, completion, incremental, linearize, lint, reports, resolve, search, tools
from ..sources.tables import read
from .catalogue import Code, duck
from .query import cypher

BUILT = reports.BUILT_IN
_CONST = "('Class', 'Module', 'Constant', 'ConstantAlias', '<TODO>')"
#: A class far down, its brand, and one with a singleton that has a method.
DEEP, BRAND = "(SELECT cls FROM p WHERE k = 86)", "(SELECT brand FROM p WHERE k = 86)"
MADE = "(SELECT min(cls) FROM p WHERE size <= 5)"
THIRD = "(SELECT min(cls) FROM pm WHERE no = 3)"


def code(f):
    return lambda spark, d: f(spark, Code(spark, d))


def graph(query: str):
    return lambda spark, d: cypher(Code(spark, d).graph.property_graph(), query)


VIS = """vis AS (SELECT d.name, CASE WHEN d.kind IN ('Class', 'Module', 'Constant', 'ConstantAlias') THEN coalesce(arg_max(f.visibility, f.ord) FILTER (f.kind = 'ConstantVisibility'), 'public')
  WHEN d.kind = 'Method' THEN coalesce(CASE arg_max(f.visibility, f.ord) FILTER (f.kind IN ('Method', 'MethodVisibility') AND f.visibility IS NOT NULL) WHEN 'module_function' THEN CASE WHEN d.owner LIKE '%>' THEN 'public' ELSE 'private' END
  ELSE arg_max(f.visibility, f.ord) FILTER (f.kind IN ('Method', 'MethodVisibility') AND f.visibility IS NOT NULL) END, 'public') END AS visibility
  FROM decls d LEFT JOIN defs f ON f.declaration = d.name GROUP BY d.name, d.kind, d.owner)"""
ASKS = """SELECT cls AS name, 'm1()' AS member, k % 2 = 0 AS only_inherited FROM p UNION ALL SELECT cls, 's2()', false FROM p UNION ALL SELECT cls, 'none()', false FROM p WHERE k % 10 = 0
  UNION ALL SELECT 'Nope' || k, 'x', false FROM n UNION ALL SELECT cls || '::SIZE', 'x', true FROM p WHERE size >= 40"""
#: Uses of constants in a class: (nesting, path) to be resolved. Paths of classes nearby, their constants, a global module, and nothing.
USES = """SELECT brand AS outer_, cls AS inner_, 'P' || k AS path FROM p UNION ALL SELECT brand, cls, 'SIZE' FROM p UNION ALL SELECT brand, cls, 'S1' FROM p WHERE k % 5 = 0
  UNION ALL SELECT brand, cls, 'Nothing' FROM p WHERE k % 7 = 0 UNION ALL SELECT brand, cls, '::' || cls FROM p WHERE k % 3 = 0"""
CONFIG = '[linter.rules.DynamicAncestor]\nexclude = ["lib/**/*.rb"]\n[linter.rules.Style]\nseverity = "error"\n[linter.rules.ParseWarning]\nenabled = true\n'


def _requires(spark, d):
    docs = read(spark, d, "documents").select(F.concat(F.lit("file:///w/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id"), F.lit(".rb")).alias("uri"))
    return docs, spark.createDataFrame([(0, "/w/src1/"), (1, "/w/src1/en"), (2, "/w/src2")], "idx int, path string")


def _asked_requires(spark, d):
    wanted = read(spark, d, "documents").select(F.concat("lang", F.lit("/d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(".rb")).otherwise(F.lit(""))).alias("path"))
    return search.resolve_require(*_requires(spark, d), wanted)


def _offsets(spark, d):
    docs = read(spark, d, "documents").where("text IS NOT NULL")
    at = docs.select("doc_id", "text", F.explode(F.array(*[F.floor(F.octet_length("text") * k / 4) for k in range(5)])).alias("offset"))
    return at.select("doc_id", "offset", line_of("text", F.col("offset")).cast("long").alias("line"), column_of("text", F.col("offset")).cast("long").alias("col"))


def _upserted(spark, d):
    base = read(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("uri"), "event_type", "value")
    gone = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("u"), "c_custkey").alias("uri"))
    new = read(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.concat(F.lit("u"), "c_custkey").alias("uri"), F.lit("reset").alias("event_type"), F.col("c_acctbal").alias("value"))
    return incremental.upsert(base, gone, new)


def _customers(spark, d):
    """Customers as constants, events as references to them."""
    name = lambda c: F.concat(F.lit("u"), c)
    decls = read(spark, d, "customer").select(name("c_custkey").alias("name"), F.lit("Class").alias("kind"))
    defs = read(spark, d, "customer").select(name("c_custkey").alias("declaration"), F.when(F.col("c_nationkey") == 0, F.lit(BUILT)).otherwise(F.lit("file:///c.rb")).alias("uri"))
    return reports.dead_code(decls, defs, read(spark, d, "events").select(name("user_id").alias("declaration")))


def _closure(spark, t):
    uris = t.sql("SELECT DISTINCT 'file:///w/lib/' || brand || '.rb' AS uri FROM p WHERE k = 86")
    return incremental.invalidated(t.graph, uris)


def _lint(spark, t):
    return lint.lint(t.diags, lint.Config.parse(CONFIG), "/w", ("/w/vendor",), lint.RULES | {"Style": "hint"})


def _chains(spark, t):
    spaces = t.sql("SELECT p.cls AS name, 'Class' AS kind, coalesce(u.cls, 'Object') AS superclass FROM p LEFT JOIN p u ON u.k = CAST(floor(p.k / 4) AS BIGINT) UNION ALL SELECT 'Object', 'Class', 'BasicObject' UNION ALL SELECT 'BasicObject', 'Class', CAST(NULL AS STRING)").unionAll(t.decls.where("kind = 'Module'").select("name", "kind", F.lit(None).cast("string")))
    mixed = t.mix.where("kind <> 'extend'").select("name", "ord", "kind", "target").unionAll(spark.createDataFrame([("Object", 0, "include", "Kernel")], "name string, ord int, kind string, target string"))
    return linearize.linearize(spaces, mixed).select("name", "state", F.array_join("chain", " ").alias("chain"))


def _constants(spark, t):
    asks = t.sql("SELECT * FROM (" + USES + ") u").select(F.array("outer_", "inner_").alias("nesting"), "path")
    kinds = t.decls.select("name", "kind", F.lit("complete").alias("state"))
    found = resolve.lookup_names(asks, t.members, t.anc, kinds, aliases.resolve_aliases(t.defs, t.decls).where("resolved IS NOT NULL"))
    return found.select(F.array_join("nesting", " ").alias("nesting"), "path", F.col("found").alias("hit"))


def _complete(spark, t, how):
    deep, brand, third, made = (t.one("SELECT " + x) for x in (DEEP, BRAND, THIRD, MADE))
    below = search.descendants(t.anc)
    seen = lambda names: aliases.visibility_of(names, t.decls, t.defs)
    if how == "call":
        return completion.call(deep, None, t.anc, t.members, t.decls, seen, below).select("member", "name")
    if how == "call_inside":
        return completion.call(deep, deep, t.anc, t.members, t.decls, seen, below).select("member", "name")
    if how == "expr":
        return completion.expression(deep, [brand, deep], t.anc, t.members, t.decls)
    if how == "arg":
        return completion.argument(third + "#m3()", t.defs, deep, [brand, deep], t.anc, t.members, t.decls)
    single = made + "::<" + made.rsplit("::", 1)[1] + ">"
    chain = t.anc.unionByName(spark.createDataFrame([(single, "complete", 0, "complete", single)], t.anc.schema))
    return completion.namespace_access(made, single, None, chain, t.members, t.decls, seen, search.descendants(chain))


def _flat_declaration(spark, t):
    name = t.one("SELECT " + DEEP)
    out = tools.get_declaration(name, t.decls, t.defs, t.anc, t.members)
    at = F.transform("definitions", lambda x: F.concat(x["path"], F.lit(":"), x["line"], F.lit(":"), F.size(x["comments"])))
    held = F.transform("members", lambda x: F.concat(x["name"], F.lit("="), x["kind"], F.lit("@"), F.coalesce(x["location"], F.lit("-"))))
    return out.select("name", "kind", F.array_join(at, " ").alias("definitions"), F.array_join("ancestors", " ").alias("ancestors"), F.array_join(held, " ").alias("members"))


QUERIES = {
    "search_fuzzy": lambda spark, d: search.declaration_search(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ["cwt"]),
    "search_exact": lambda spark, d: search.declaration_search(read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), ["widget", "ld w"], "exact"),
    "search_multi": code(lambda spark, t: search.declaration_search(t.decls, ["p77", "#M3()"]).select("name")),
    "search_empty": code(lambda spark, t: search.declaration_search(t.decls, ["Dog", ""]).select("name")),
    "lookup_fqn": code(lambda spark, t: search.lookup(t.decls, "::S5").select("name", "kind", "owner")),
    "members": code(lambda spark, t: search.member(t.members, "S1", "s1()")),
    "member_in_ancestors": code(lambda spark, t: search.members_in_ancestors(t.sql("SELECT * FROM (" + ASKS + ") a"), t.decls, t.members, t.anc)),
    "ancestors_chain": code(lambda spark, t: search.ancestors_of(t.anc, t.sql("SELECT cls AS name FROM p WHERE k % 2 = 0"))),
    "descendants_set": code(lambda spark, t: search.descendants(t.anc)),
    "has_ancestor": code(lambda spark, t: search.has_ancestor(t.anc, ["S1", "W2"])),
    "alias_const": code(lambda spark, t: aliases.resolve_aliases(t.defs, t.decls)),
    "alias_targets": code(lambda spark, t: aliases.alias_targets(t.defs)),
    "alias_method": code(lambda spark, t: aliases.resolve_method_aliases(t.defs, t.members, t.anc, t.decls)),
    "visibility": code(lambda spark, t: aliases.visibility(t.decls, t.defs)),
    "dead_code": code(lambda spark, t: reports.dead_code(t.decls, t.defs, t.refs)),
    "dead_customers": _customers,
    "require_paths": lambda spark, d: search.require_paths(*_requires(spark, d)),
    "resolve_require": _asked_requires,
    "resolve_constant": code(_constants),
    "complete_ns": code(lambda spark, t: _complete(spark, t, "ns")),
    "complete_call": code(lambda spark, t: _complete(spark, t, "call")),
    "complete_call_inside": code(lambda spark, t: _complete(spark, t, "call_inside")),
    "complete_expr": code(lambda spark, t: _complete(spark, t, "expr")),
    "complete_arg": code(lambda spark, t: _complete(spark, t, "arg")),
    "linearize": code(_chains),
    "integrity": code(lambda spark, t: reports.integrity(t.decls)),
    "orphans": code(lambda spark, t: reports.orphans(t.defs)),
    "stats": code(lambda spark, t: reports.statistics(t.decls, t.defs)),
    "dot_lines": code(lambda spark, t: reports.dot_lines(t.decls, t.defs)),
    "lint_filter": code(_lint),
    "lint_summary": code(lambda spark, t: lint.summary(_lint(spark, t))),
    "tool_search_page": code(lambda spark, t: tools.search_declarations(t.decls, t.defs, "1", "class", limit=30, offset=5).withColumn("locations", F.array_join("locations", ","))),
    "tool_declaration": code(_flat_declaration),
    "tool_stats": code(lambda spark, t: tools.codebase_stats(t.graph.documents, t.decls, t.defs, t.refs, t.graph.method_references).withColumn("breakdown_by_kind", F.array_join(F.transform(F.array_sort(F.map_entries("breakdown_by_kind")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " "))),
    "tool_refs_page": code(lambda spark, t: tools.find_constant_references(t.refs.agg(F.min("declaration")).first()[0], t.refs, limit=3, offset=1)),
    "tool_descendants": code(lambda spark, t: tools.get_descendants(t.one("SELECT cls FROM p WHERE k = 1"), t.decls, search.descendants(t.anc), limit=500)),
    "tool_file": code(lambda spark, t: tools.get_file_declarations("lib/mods.rb", "/w", t.defs)),
    "upsert_delete": _upserted,
    "invalidate_closure": code(_closure),
    "line_of_offset": _offsets,
    "name_depth": code(lambda spark, t: t.sql("SELECT cls, brand, 'P' || k AS inner_ FROM p").select(F.col("cls").alias("name"), name_depth(F.lit("SIZE"), F.array("brand", "inner_")).alias("own"), name_depth("cls", F.array("brand")).alias("path"))),
    "signatures": code(lambda spark, t: t.defs.where("kind = 'Method'").select("id", signature("params").alias("s")).select("id", F.array_join("s.required_positional", ",").alias("required"), F.array_join(F.concat("s.required_keyword", "s.optional_keyword"), ",").alias("keywords"), F.size("s.block").alias("blocks"))),
    "orphan_names": code(lambda spark, t: reports.orphan_names(t.defs.withColumn("declaration", F.when(~F.col("kind").isin("Method", "SingletonClass"), F.col("declaration"))))),
    "reference_counts": code(lambda spark, t: reports.reference_counts(t.refs)),
    "page_names": lambda spark, d: read(spark, d, "pages").select("page_id", relative_to(F.regexp_replace("url", "^[a-z]+:/", ""), "/example.com").alias("path"), unqualified("url").alias("last")),
    "code_defines": graph("MATCH (d:Document)-[:DEFINES]->(x:Definition) RETURN d.name AS file, x.kind AS kind, count(x) AS n"),
    "code_declares": graph("MATCH (x:Definition)-[:DECLARES]->(d:Class) RETURN d.name AS name, x.file AS file, x.line AS line"),
    "code_contains": graph("MATCH (a:Definition)-[:CONTAINS]->(b:Definition) RETURN a.name AS outer, b.kind AS kind, count(b) AS n"),
    "code_has_parent": graph("MATCH (a:Class)-[:HAS_PARENT]->(b:Class) RETURN a.name AS name, b.name AS parent"),
    "code_mixins": graph("MATCH (a)-[:INCLUDES]->(b:Module) RETURN a.name AS name, b.name AS target"),
    "code_prepends": graph("MATCH (a:Class)-[:PREPENDS]->(b:Module) RETURN a.name AS name, b.name AS target"),
    "code_extends": graph("MATCH (a:Class)-[:EXTENDS]->(b:Namespace) RETURN a.name AS name, b.name AS target"),
    "code_owns": graph("MATCH (c:Class)-[:OWNS]->(m:Method) RETURN c.name AS owner, m.unqualified_name AS method, m.visibility AS visibility"),
    "code_has_ancestor": graph("MATCH (a:Class)-[:HAS_ANCESTOR]->(b) RETURN a.name AS name, count(b) AS n"),
    "code_has_descendant": graph("MATCH (a:Namespace)-[:HAS_DESCENDANT]->(b) RETURN a.name AS name, count(b) AS n"),
    "code_references": graph("MATCH (d:Document)-[:REFERENCES]->(x) RETURN d.name AS file, x.name AS name"),
    "code_properties": graph("MATCH (d:Declaration) RETURN d.name AS name, d.kind AS kind, d.unqualified_name AS short, d.definition_count AS n, d.visibility AS visibility"),
    "code_documents": graph("MATCH (d:Document) RETURN d.uri AS uri, d.path AS path, d.name AS name"),
    "code_reach": graph("MATCH (b:Module)-[:OWNS]->(a:Class)<-[:HAS_PARENT*1..]-(x:Class) WHERE a.definition_count > 1 RETURN DISTINCT b.name AS brand, x.name AS name"),
}

_TREE = "SELECT m.member, m.name, d.kind, {step} AS step, a.pos FROM anc a JOIN members m ON m.owner = a.ancestor JOIN decls d ON d.name = m.name WHERE a.name = {of} AND d.kind IN ({kinds})"
_NAMES = "'Class', 'Module', 'Constant', 'ConstantAlias', '<TODO>'"
_EXPR = "cand AS (" + " UNION ALL ".join([
    _TREE.format(step=0, of=DEEP, kinds=_NAMES),
    f"SELECT m.member, m.name, d.kind, 2, 0 FROM members m JOIN decls d USING (name) WHERE m.owner = {BRAND} AND d.kind IN ({_NAMES})",
    "SELECT m.member, m.name, d.kind, 4, 0 FROM members m JOIN decls d USING (name) WHERE d.kind = 'GlobalVariable' AND m.owner = 'Object'",
    _TREE.format(step=5, of=DEEP, kinds="'Method', 'InstanceVariable'"),
    "SELECT w, w, 'Keyword', 6, 0 FROM (VALUES " + ", ".join(f"('{w}')" for w in completion.KEYWORDS) + ") k(w)",
]) + "), best AS (SELECT member, arg_min(name, (step, pos, name)) AS name, arg_min(kind, (step, pos, name)) AS kind FROM cand GROUP BY member)"
_FIRST = "first AS (SELECT m.member, arg_min(m.name, a.pos) AS name FROM anc a JOIN members m ON m.owner = a.ancestor JOIN decls d ON d.name = m.name AND d.kind = 'Method' WHERE a.name = " + DEEP + " GROUP BY m.member)"
_ENDS = "replace(replace({x}, '<', '&lt;'), '>', '&gt;')"
_ESC = lambda x: _ENDS.format(x=x)
_LINT = """lint AS (SELECT rule, CASE rule WHEN 'ParseError' THEN 'error' WHEN 'ParseWarning' THEN 'warning' WHEN 'DynamicAncestor' THEN 'hint' ELSE 'error' END AS severity, CASE WHEN starts_with(uri, 'file:///w/') THEN substr(uri, 11) ELSE uri END AS path, line, start_at AS start, end_at AS "end", message
  FROM diags WHERE (uri NOT LIKE 'file:%' OR uri LIKE 'file:///w/%') AND uri NOT LIKE 'file:///w/vendor/%' AND NOT (rule = 'DynamicAncestor' AND uri LIKE 'file:///w/lib/%.rb'))"""
ORACLES = {
    "search_fuzzy": "SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches(p_name, '(?is)c.*w.*t')",
    "search_exact": "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'widget') OR contains(p_name, 'ld w')",
    "search_multi": duck("SELECT name FROM decls WHERE regexp_matches(name, '(?is)p.*7.*7') OR regexp_matches(name, '(?is)#.*m.*3.*[(].*[)]')"),
    "search_empty": duck("SELECT name FROM decls"),
    "lookup_fqn": duck("SELECT name, kind, owner FROM decls WHERE name = 'S5'"),
    "members": duck("SELECT * FROM members WHERE owner = 'S1' AND member = 's1()'"),
    "member_in_ancestors": duck(
        """SELECT k.name, k.member, k.only_inherited, h.found, CASE WHEN h.found IS NOT NULL THEN NULL WHEN k.name NOT IN (SELECT name FROM decls) THEN 'DeclarationNotFound' WHEN k.name NOT IN (SELECT name FROM anc) THEN 'NotNamespace' ELSE 'MemberNotFound' END AS error
        FROM asks k LEFT JOIN hits h ON h.name = k.name AND h.member = k.member AND h.only_inherited = k.only_inherited""",
        f"asks AS ({ASKS})",
        """hits AS (SELECT k.name, k.member, k.only_inherited, arg_min(m.name, a.pos) AS found FROM asks k JOIN anc a ON a.name = k.name JOIN members m ON m.owner = a.ancestor AND m.member = k.member LEFT JOIN anc o ON o.name = k.name AND o.ancestor = k.name
        WHERE NOT k.only_inherited OR a.pos > o.pos GROUP BY ALL)""",
    ),
    "ancestors_chain": duck("SELECT a.name, string_agg(ancestor, ' ' ORDER BY pos) AS chain FROM anc a JOIN p ON p.cls = a.name AND p.k % 2 = 0 GROUP BY a.name"),
    "descendants_set": duck("SELECT DISTINCT ancestor AS name, name AS descendant FROM anc"),
    "has_ancestor": duck("SELECT name, bool_or(ancestor IN ('S1', 'W2')) AS has FROM anc GROUP BY name"),
    "alias_const": duck(
        "SELECT a.name, max(CASE WHEN d.kind <> 'ConstantAlias' THEN w.at END) AS resolved FROM (SELECT DISTINCT name FROM w) a JOIN w ON w.name = a.name LEFT JOIN decls d ON d.name = w.at GROUP BY a.name",
        """w AS (SELECT declaration AS name, target AS at, [declaration] AS seen FROM defs WHERE kind = 'ConstantAlias'
        UNION ALL SELECT w.name, f.target, list_append(w.seen, w.at) FROM w JOIN defs f ON f.declaration = w.at AND f.kind = 'ConstantAlias' WHERE NOT list_contains(w.seen, w.at))""", recursive=True,
    ),
    "alias_targets": duck("SELECT declaration AS name, target, 0 AS ord FROM defs WHERE kind = 'ConstantAlias' AND target IS NOT NULL"),
    "alias_method": duck(
        """SELECT f.id, CASE WHEN f.old_str LIKE 'cy%' THEN 'Cycle' WHEN e.found IS NULL THEN 'TargetNotFound' ELSE 'Resolved' END AS outcome, CASE WHEN f.old_str NOT LIKE 'cy%' THEN e.found END AS target
        FROM defs f JOIN decls d ON d.name = f.declaration LEFT JOIN ends e ON e.name = d.owner WHERE f.kind = 'AliasMethod'""",
        "ends AS (SELECT a.name, arg_min(m.name, a.pos) AS found FROM anc a JOIN members m ON m.owner = a.ancestor AND m.member = 'm1()' GROUP BY a.name)",
    ),
    "visibility": duck("SELECT name, visibility FROM vis", VIS),
    "dead_code": duck(f"SELECT DISTINCT d.name, d.kind FROM decls d JOIN defs f ON f.declaration = d.name WHERE d.kind IN {_CONST} AND d.name NOT IN (SELECT declaration FROM refs WHERE declaration IS NOT NULL) AND d.name NOT IN (SELECT declaration FROM defs WHERE uri = '{BUILT}' AND declaration IS NOT NULL)"),
    "dead_customers": "SELECT 'u' || c_custkey AS name, 'Class' AS kind FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) AND c_nationkey <> 0",
    "require_paths": """WITH docs AS (SELECT 'file:///w/' || source || '/' || lang || '/d' || doc_id || '.rb' AS uri, '/w/' || source || '/' || lang || '/d' || doc_id AS p FROM documents), loads(idx, root) AS (VALUES (0, '/w/src1/'), (1, '/w/src1/en/'), (2, '/w/src2/')),
      r AS (SELECT substr(p, length(root) + 1) AS require_path, uri, idx FROM docs JOIN loads ON starts_with(p, root)) SELECT require_path, arg_min(uri, (idx, uri)) AS uri, min(idx) AS idx FROM r GROUP BY 1""",
    "resolve_require": """SELECT lang || '/d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.rb' ELSE '' END AS path, CASE WHEN source IN ('src1', 'src2') THEN 'file:///w/' || source || '/' || lang || '/d' || doc_id || '.rb' END AS uri FROM documents""",
    "resolve_constant": duck(
        "SELECT outer_ || ' ' || inner_ AS nesting, path, CASE WHEN path LIKE '::%' THEN substr(path, 3) WHEN path LIKE 'P%' THEN inner_ WHEN path = 'S1' THEN 'S1' ELSE e.found END AS hit FROM (SELECT DISTINCT * FROM uses) u LEFT JOIN ends e ON e.name = u.inner_ AND e.member = u.path WHERE hit IS NOT NULL",
        f"uses AS ({USES})", "ends AS (SELECT a.name, m.member, arg_min(m.name, a.pos) AS found FROM anc a JOIN members m ON m.owner = a.ancestor AND m.member = 'SIZE' GROUP BY ALL)",
    ),
    "complete_ns": duck(
        f"SELECT 'SIZE' AS member, x.name, 'Constant' AS kind FROM (SELECT arg_min(m.name, a.pos) AS name FROM anc a JOIN members m ON m.owner = a.ancestor AND m.member = 'SIZE' WHERE a.name = {MADE} AND a.pos < 100 AND m.name IN (SELECT name FROM vis WHERE visibility <> 'private')) x WHERE x.name IS NOT NULL UNION ALL SELECT 'make()', d.name, 'Method' FROM decls d WHERE d.kind = 'Method' AND d.owner LIKE {MADE} || '::<%'", VIS,
    ),
    "complete_call": duck("SELECT member, name FROM first JOIN vis USING (name) WHERE visibility = 'public'", VIS, _FIRST),
    "complete_call_inside": duck("SELECT member, name FROM first", _FIRST),
    "complete_expr": duck("SELECT * FROM best", _EXPR),
    "complete_arg": duck(f"SELECT * FROM best UNION ALL SELECT unnest(['loud:', 'times:']), {THIRD} || '#m3()', 'KeywordParameter'", _EXPR),
    "linearize": duck("SELECT name, 'complete' AS state, string_agg(ancestor, ' ' ORDER BY pos) AS chain FROM anc GROUP BY name"),
    "integrity": duck("SELECT d.name, CASE WHEN d.owner = d.name AND d.name NOT IN ('Object', 'BasicObject') THEN 'UnexpectedSelfOwnership' WHEN o.kind IS NULL THEN 'OwnerDoesNotExist' WHEN o.kind NOT IN ('Class', 'Module', 'SingletonClass') THEN 'OwnerIsNotNamespace' WHEN regexp_matches(d.name, '^[XY][0-9]+$') THEN 'SingletonClassChainDoesNotTerminate' END AS error FROM decls d LEFT JOIN decls o ON o.name = d.owner WHERE error IS NOT NULL"),
    "orphans": duck("SELECT kind, str AS name, uri || '#L' || line AS location FROM defs WHERE declaration IS NULL"),
    "stats": duck(
        """SELECT 'declarations' AS measure, '' AS kind, count(*)::DOUBLE AS value FROM per UNION ALL SELECT 'documented_percent', '', round(100.0::DOUBLE * count(*) FILTER (said > 0) / count(*), 1) FROM per UNION ALL SELECT 'documentation_bytes', '', sum(7 * said)::DOUBLE FROM per
        UNION ALL SELECT 'multi_definition_percent', '', round(100.0::DOUBLE * count(*) FILTER (n > 1) / count(*), 1) FROM per UNION ALL SELECT 'definitions', '', count(*)::DOUBLE FROM defs UNION ALL SELECT 'linked_definitions', '', count(declaration)::DOUBLE FROM defs
        UNION ALL SELECT 'orphan_percent', '', round(100.0::DOUBLE * (count(*) - count(declaration)) / count(*), 1) FROM defs UNION ALL SELECT 'declarations_of_kind', kind, count(*)::DOUBLE FROM decls GROUP BY kind
        UNION ALL SELECT 'definitions_of_kind', kind, count(*)::DOUBLE FROM defs GROUP BY kind UNION ALL SELECT 'orphans_of_kind', kind, count(*)::DOUBLE FROM defs WHERE declaration IS NULL GROUP BY kind""",
        "per AS (SELECT d.name, count(f.id) AS n, coalesce(sum(f.said), 0) AS said FROM decls d LEFT JOIN defs f ON f.declaration = d.name GROUP BY 1)",
    ),
    "dot_lines": duck(
        f"""SELECT 'digraph code {{' AS line UNION ALL SELECT '}}' UNION ALL SELECT DISTINCT '  "doc:' || uri || '" [label="' || uri || '", shape=note];' FROM shown
        UNION ALL SELECT '  "def:' || id || '" [label="' || {_ESC("kind || ' ' || coalesce(str, '')")} || '", shape=box];' FROM shown UNION ALL SELECT '  "decl:' || {_ESC("name")} || '" [label="' || {_ESC("kind || ' ' || name")} || '", shape=ellipse];' FROM names
        UNION ALL SELECT '  "doc:' || uri || '" -> "def:' || id || '" [label="defines"];' FROM shown UNION ALL SELECT '  "def:' || id || '" -> "decl:' || {_ESC("declaration")} || '" [label="declares"];' FROM shown WHERE declaration IS NOT NULL
        UNION ALL SELECT '  "decl:' || {_ESC("a.owner")} || '" -> "decl:' || {_ESC("a.name")} || '" [label="owns"];' FROM names a WHERE a.owner IN (SELECT name FROM names) AND a.owner <> a.name""",
        f"shown AS (SELECT * FROM defs WHERE uri <> '{BUILT}')", "names AS (SELECT * FROM decls WHERE name IN (SELECT declaration FROM shown WHERE declaration IS NOT NULL))",
    ),
    "lint_filter": duck("SELECT * FROM lint", _LINT),
    "lint_summary": duck("SELECT severity, count(*) AS n FROM lint GROUP BY 1", _LINT),
    "tool_search_page": duck(
        "SELECT d.name, d.kind, l.locations, d.total FROM (SELECT name, kind, count(*) OVER () AS total FROM decls WHERE contains(name, '1') AND kind = 'Class' ORDER BY name LIMIT 30 OFFSET 5) d LEFT JOIN (SELECT declaration AS name, string_agg(replace(uri, 'file://', '') || ':' || line, ',' ORDER BY ord) AS locations FROM defs GROUP BY 1) l USING (name)"
    ),
    "tool_declaration": duck(
        f"""SELECT d.name, d.kind, (SELECT string_agg(replace(uri, 'file://', '') || ':' || line || ':' || said, ' ' ORDER BY ord) FROM defs WHERE declaration = {DEEP}) AS definitions, (SELECT string_agg(ancestor, ' ' ORDER BY pos) FROM anc WHERE name = {DEEP}) AS ancestors,
        (SELECT string_agg(m.name || '=' || e.kind || '@' || coalesce(replace(f.uri, 'file://', '') || ':' || f.line, '-'), ' ' ORDER BY m.name) FROM members m JOIN decls e USING (name) LEFT JOIN defs f ON f.declaration = m.name AND f.ord = 0 WHERE m.owner = {DEEP}) AS members FROM decls d WHERE d.name = {DEEP}"""
    ),
    "tool_stats": duck(
        "SELECT (SELECT count(*) FROM docs) AS files, (SELECT count(*) FROM decls) AS declarations, (SELECT count(*) FROM defs) AS definitions, (SELECT count(*) FROM refs) AS constant_references, (SELECT count(*) FROM refs) AS method_references, (SELECT string_agg(kind || '=' || n, ' ' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM decls GROUP BY 1)) AS breakdown_by_kind"
    ),
    "tool_refs_page": duck('SELECT replace(uri, \'file://\', \'\') AS path, line, col AS "column", count(*) OVER () AS total FROM refs WHERE declaration = (SELECT min(declaration) FROM refs) ORDER BY 1, 2, 3 LIMIT 3 OFFSET 1'),
    "tool_descendants": duck("SELECT name, kind, total FROM (SELECT d.name, d.kind, count(*) OVER () AS total FROM decls d WHERE d.name IN (SELECT a.name FROM anc a JOIN p ON p.k = 1 AND a.ancestor = p.cls)) ORDER BY name LIMIT 500"),
    "tool_file": duck("SELECT declaration AS name, kind, line FROM defs WHERE uri = 'file:///w/lib/mods.rb' AND declaration IS NOT NULL"),
    "upsert_delete": "SELECT 'u' || user_id AS uri, event_type, value FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'u' || c_custkey, 'reset', c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    "invalidate_closure": duck(
        "SELECT 'declaration' AS item, name FROM x UNION ALL SELECT DISTINCT 'references', uri FROM refs WHERE declaration IN (SELECT name FROM x)",
        "e AS (SELECT ancestor AS name, name AS next FROM anc WHERE name <> ancestor UNION SELECT owner, name FROM decls WHERE owner <> name)",
        f"x AS (SELECT DISTINCT declaration AS name FROM defs WHERE uri = 'file:///w/lib/' || {BRAND} || '.rb' AND declaration IS NOT NULL UNION SELECT e.next FROM x JOIN e ON e.name = x.name)", recursive=True,
    ),
    "line_of_offset": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM d),
      st AS (SELECT doc_id, coalesce(sum(octet_length(encode(ln)) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t), o AS (SELECT doc_id, k, floor(size * k / 4)::BIGINT AS at FROM d CROSS JOIN range(5) r(k))
      SELECT o.doc_id, o.at AS "offset", count(*) AS line, o.at - max(start) + 1 AS col FROM o JOIN st ON st.doc_id = o.doc_id AND st.start <= o.at GROUP BY o.doc_id, o.k, o.at""",
    "name_depth": duck("SELECT cls AS name, 1 * (1 + 1 * (1 + 1 * (1 + 0))) AS own, len(string_split(cls, '::')) * (1 + len(string_split(brand, '::')) * (1 + 0)) AS path FROM p"),
    "signatures": duck("SELECT id, CASE WHEN keys THEN 'who' ELSE '' END AS required, CASE WHEN keys THEN 'loud,times' ELSE '' END AS keywords, 0 AS blocks FROM defs WHERE kind = 'Method'"),
    "orphan_names": duck(
        """SELECT f.id, CASE WHEN f.parent IS NULL THEN f.str WHEN a.kind = 'SingletonClass' THEN b.declaration || '::' || a.str || '#' || f.str WHEN f.kind = 'SingletonClass' THEN a.declaration || '::' || f.str ELSE a.declaration || '#' || f.str END AS name
        FROM defs f LEFT JOIN defs a ON a.id = f.parent LEFT JOIN defs b ON b.id = a.parent WHERE f.kind IN ('Method', 'SingletonClass')"""
    ),
    "reference_counts": duck("SELECT path, count(*) AS n, count(declaration) AS resolved FROM refs GROUP BY path"),
    "page_names": "SELECT page_id, CASE WHEN starts_with(p, '/example.com/') THEN substr(p, 14) ELSE p END AS path, list_extract(string_split(list_extract(string_split(url, '::'), -1), '#'), -1) AS last FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+:/', '') AS p FROM pages)",
    "code_defines": duck("SELECT regexp_replace(uri, '^.*/', '') AS file, kind, count(*) AS n FROM defs GROUP BY 1, 2"),
    "code_declares": duck("SELECT f.declaration AS name, f.uri AS file, f.line FROM defs f JOIN decls d ON d.name = f.declaration WHERE d.kind = 'Class'"),
    "code_contains": duck("SELECT coalesce(a.declaration, '') AS outer, b.kind, count(*) AS n FROM defs a JOIN defs b ON b.parent = a.id GROUP BY 1, 2"),
    "code_has_parent": duck("SELECT declaration AS name, superclass AS parent FROM defs WHERE superclass IS NOT NULL"),
    "code_mixins": duck("SELECT name, target FROM mix WHERE kind = 'include'"),
    "code_prepends": duck("SELECT name, target FROM mix WHERE kind = 'prepend'"),
    "code_extends": duck("SELECT name, CASE WHEN target = 'A5' THEN (SELECT cls FROM p WHERE k = 6) ELSE target END AS target FROM mix WHERE kind = 'extend'"),
    "code_owns": duck("SELECT d.owner, regexp_replace(d.name, '^.*#', '') AS method, v.visibility FROM decls d JOIN vis v USING (name) WHERE d.kind = 'Method' AND d.owner LIKE '%::P%' AND d.owner NOT LIKE '%>'", VIS),
    "code_has_ancestor": duck("SELECT a.name, count(*) AS n FROM anc a JOIN decls d ON d.name = a.name AND d.kind = 'Class' WHERE a.ancestor <> a.name GROUP BY 1"),
    "code_has_descendant": duck("SELECT ancestor AS name, count(*) AS n FROM anc GROUP BY 1"),
    "code_references": duck("SELECT DISTINCT regexp_replace(uri, '^.*/', '') AS file, declaration AS name FROM refs WHERE declaration IS NOT NULL"),
    "code_properties": duck("SELECT d.name, d.kind, regexp_replace(d.name, '^.*(::|#)', '') AS short, (SELECT count(*) FROM defs f WHERE f.declaration = d.name) AS n, v.visibility FROM decls d JOIN vis v USING (name)", VIS),
    "code_documents": duck("SELECT uri, CASE WHEN starts_with(uri, 'file://') THEN substr(uri, 8) ELSE uri END AS path, regexp_replace(uri, '^.*/', '') AS name FROM docs"),
    "code_reach": duck("SELECT DISTINCT d.owner AS brand, u.cls AS name FROM up u JOIN decls d ON d.name = u.acls WHERE u.ak % 5 = 0 AND u.i > 0"),
}
