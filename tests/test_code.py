import json

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import names
from weftgraph.operators import lint, reports, search, tools
from weftgraph.operators.incremental import Workspace, latest
from weftgraph.plans.query import Query
from weftgraph.sources.files import language_of_id, list_files, workspace_paths
from weftgraph.sources.ruby import Reader, blank

ZOO = """# The zoo.
module Walkable
  def walk(a, b = 1, *rest, key:, opt: 2, **kw, &blk); end
end

class Animal
  LIMIT = 3
  attr_reader :name
  def speak
    @mood = "x # not a comment"
    Walkable.track(LIMIT)
  end
  private
  def hide; end
  alias hush hide
end

module Farm
  class Dog < Animal
    include Walkable
    extend Walkable
    def self.breed
      if true
        1
      end
    end
    private_constant :NOPE
    private :bark
  end
  Pup = Dog
  class << Dog
    def sit; end
  end
end

class Farm::Cat < Missing
  prepend Walkable
end
class Ghost::Town; end
$debug = 1
"""


@pytest.fixture(scope="module")
def workspace(spark):
    return Workspace.index(spark.createDataFrame([("file:///w/zoo.rb", ZOO), ("file:///w/b.rb", "class Animal\n  def late; end\nend\n")], "uri string, source string"))


def kinds(source):
    return [(r["kind"], r["path"]) for r in Reader("u", source).read() if r["fact"] == "definition"]


def test_reader():
    assert kinds("class A < B\n  def x=(v) = 1\n  def self.y; end\nend") == [("Class", "A"), ("Method", "x=()"), ("Method", "y()")]
    assert kinds("X = Class.new(Y) do\n  def z; end\nend\nA, B = 1\nC = D") == [("Class", "X"), ("Method", "z()"), ("Constant", "A"), ("Constant", "B"), ("ConstantAlias", "C")]
    assert kinds("alias $a $b\nalias_method :p, :q\nattr_accessor :m, :n\n@@c ||= 1") == [("GlobalVariableAlias", "$a"), ("AliasMethod", "p()"), ("AttrAccessor", "m()"), ("AttrAccessor", "n()"), ("ClassVariable", "@@c")]
    assert kinds("=begin\nclass No\n=end\nS = <<~EOS\n class Nor\nEOS\n'class Neither'") == [("Constant", "S")]
    row = next(r for r in Reader("u", ZOO).read() if r["path"] == "walk()")
    assert [p["kind"] for p in row["params"]] == ["required_positional", "optional_positional", "rest_positional", "required_keyword", "optional_keyword", "rest_keyword", "block"]
    assert [r["kind"] for r in Reader("u", "class A\nclass << foo\nend\nend\nend\nclass B < x\nend").read() if r["fact"] == "diagnostic"] == ["DynamicSingletonDefinition", "ParseError", "DynamicAncestor"]
    assert len(blank(ZOO)) == len(ZOO)
    mixins = next(r for r in Reader("u", "class A\ninclude B, C\nend").read() if r["path"] == "A")["mixins"]
    assert [m["target"] for m in mixins] == ["C", "B"]
    assert [r["visibility"] for r in Reader("u", "def a; end\nclass A\ndef b; end\nprivate\ndef c; end\npublic def d; end\nend").read() if r["kind"] == "Method"] == ["private", "public", "private", "public"]


def test_resolution(workspace):
    g = workspace.graph
    decls = {r.name: (r.kind, r.owner) for r in g.declarations.collect()}
    assert decls["Farm::Dog"] == ("Class", "Farm") and decls["Farm::Cat"] == ("Class", "Farm") and decls["Farm::Pup"][0] == "ConstantAlias"
    assert decls["Ghost"] == ("<TODO>", "Object") and decls["Ghost::Town"] == ("Class", "Ghost")
    assert decls["Animal#@mood"][1] == "Animal" and decls["$debug"] == ("GlobalVariable", "Object")
    assert decls["Farm::Dog::<Dog>#breed()"][1] == "Farm::Dog::<Dog>" and decls["Farm::Dog::<Dog>#sit()"][0] == "Method"
    chain = {}
    for r in g.ancestors.orderBy("name", "pos").collect():
        chain.setdefault(r.name, []).append(r.ancestor if r.tag == "complete" else "?" + r.ancestor)
    root = ["Object", "Kernel", "BasicObject"]
    assert chain["Farm::Dog"] == ["Farm::Dog", "Walkable", "Animal", *root]
    assert chain["Farm::Cat"] == ["Walkable", "Farm::Cat", "?Missing", *root]
    assert chain["Farm::Dog::<Dog>"][:4] == ["Farm::Dog::<Dog>", "Walkable", "Animal::<Animal>", "Object::<Object>"]
    refs = {r.path: r.declaration for r in g.constant_references.collect()}
    assert refs["LIMIT"] == "Animal::LIMIT" and refs["Missing"] is None and refs["Walkable"] == "Walkable"
    found = {(r.rule, r.message) for r in g.diagnostics.collect()}
    assert ("UndefinedConstantVisibilityTarget", "undefined: NOPE") in found and ("UndefinedMethodVisibilityTarget", "undefined: bark()") in found
    assert {r.uri for r in g.definitions.where("declaration = 'Animal'").collect()} == {"file:///w/zoo.rb", "file:///w/b.rb"}
    assert reports.integrity(g.declarations).count() == 0


def test_cypher_over_code(workspace):
    g = workspace.graph.property_graph()
    run = lambda q: sorted(map(tuple, Query.parse(q).run(g).rows))
    assert run("MATCH (c:Class)-[:HAS_PARENT]->(p:Class) RETURN c.name, p.name") == [("Farm::Dog", "Animal")]
    assert run("MATCH (c {name: 'Farm::Dog'})-[:INCLUDES]->(m) RETURN m.name") == [("Walkable",)]
    assert run("MATCH (d:Document {name: 'b.rb'})-[:DEFINES]->(x)-[:DECLARES]->(c:Class) RETURN d.path, x.line, c.definition_count") == [("/w/b.rb", 1, 2)]
    assert ("hide()", "private") in run("MATCH (c:Class {name: 'Animal'})-[:OWNS]->(m:Method) RETURN m.unqualified_name, m.visibility")
    assert ("Animal",) not in run("MATCH (c {name: 'Animal'})-[:HAS_ANCESTOR]->(a) RETURN a.name")
    assert run("MATCH (c:Class {name: 'Animal'})-[:HAS_DESCENDANT]->(a) RETURN a.name") == [("Animal",), ("Farm::Dog",)]
    assert ("Ghost",) in run("MATCH (n:Namespace) RETURN n.name")
    assert len(g.relationship_types()) == 11


def tables(w):
    return {n: sorted(map(str, getattr(w.graph, n).collect())) for n in ("declarations", "members", "ancestors", "definitions")}


def test_incremental_equals_fresh(spark, workspace):
    new = ("file:///w/c.rb", "class Extra < Animal\nend\n")
    changes = spark.createDataFrame([(*new, False), ("file:///w/b.rb", None, True), ("file:///w/never.rb", None, True)], "uri string, source string, deleted boolean")
    changed = workspace.apply(changes)
    fresh = Workspace.index(spark.createDataFrame([("file:///w/zoo.rb", ZOO), new], "uri string, source string"))
    assert changed.graph.version == 1 and tables(changed) == tables(fresh)
    assert "Animal#late()" not in {r.name for r in changed.graph.declarations.collect()}
    assert changed.apply(changes) is changed and changed.delete("file:///w/b.rb") is changed


def test_stream(spark, workspace, tmp_path):
    from weftgraph.streaming.changes import follow, read_changes

    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(json.dumps(x) for x in ({"uri": "file:///a.rb", "source": "class Old; end", "seq": 1}, {"uri": "file:///a.rb", "source": "class New; end", "seq": 2})))
    seen = []
    follow(read_changes(spark, str(feed)), workspace, str(tmp_path / "ck"), lambda w, n: seen.append(w), once=True).awaitTermination()
    names_ = {r.name for r in seen[-1].graph.declarations.collect()}
    assert "New" in names_ and "Old" not in names_ and len(seen) == 1


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "uri string, seq int, v string")
    assert sorted(map(tuple, latest(df).collect())) == [("a", 3, "y"), ("b", 2, "z")]


def test_config():
    c = lint.Config.parse('[graph]\nexclude = ["a/**"]\n[linter.rules.ParseError]\nenabled = false\n')
    assert c.exclude == ("a/**",) and not c.rules["ParseError"].enabled and lint.unknown_rules(c, ["X"]) == ["ParseError"]
    for bad in ("[other]", "[graph]\nx = 1", "[linter.rules.A]\nseverity = 'loud'", "[graph]\nexclude = 'a'", "= 1", "[linter.rules.A]\nenabled = 1"):
        with pytest.raises(lint.ConfigError):
            lint.Config.parse(bad)


def test_custom_rule(spark, workspace, tmp_path):
    (tmp_path / "r.py").write_text("from weftgraph.operators.lint import Rule\nclass NeedsWag(Rule):\n    name = 'NeedsWag'\n    def lint(self, g):\n        return self.at_definitions(g, self.missing_method(g, self.child_classes(g, 'Animal'), 'wag()'), '{} lacks wag')\n")
    (rule,) = lint.load_rules(str(tmp_path / "*.py"))
    found = rule.lint(workspace.graph).collect()
    assert [(r.rule, r.message) for r in found] == [("NeedsWag", "Dog lacks wag")]


def test_files(spark, tmp_path):
    (tmp_path / "lib" / "gen").mkdir(parents=True)
    for p, text in (("lib/a.rb", "class A; end"), ("lib/gen/b.rb", "x"), ("lib/c.txt", "no"), ("lib/d.rbs", "class D\nend")):
        (tmp_path / p).write_text(text)
    files, errors = list_files(spark, [str(tmp_path), str(tmp_path / "nope")], ["lib/gen/**", "[bad"])
    assert sorted((r.uri.rsplit("/", 1)[1], r.language) for r in files.collect()) == [("a.rb", "ruby"), ("d.rbs", "rbs")]
    assert [e["path"] for e in errors] == [str(tmp_path / "nope")] and workspace_paths(str(tmp_path)) == [str(tmp_path / "lib")]
    with pytest.raises(ValueError):
        language_of_id("python")


def test_names(spark):
    df = spark.createDataFrame([("A::B#c", "file:///x%20y/z.rb", "é\nab")], "n string, u string, t string")
    row = df.select(
        names.unqualified("n"), names.uri_path("u"), names.uri_name("u"), names.line_of("t", F.lit(4)), names.column_of("t", F.lit(4)), names.fuzzy_score("n", "ac"), names.fuzzy_score("n", "cA"),
        names.require_path(F.lit("/l/a.rb.rb"), F.lit("/l/")), names.strip_top(F.lit("::::A")), names.html(F.lit('<a&"')),
    ).first()
    assert tuple(row) == ("c", "/x y/z.rb", "z.rb", 2, 2, 2, 0, "a", "::A", "&lt;a&amp;&quot;")
    for glob, good, bad in (("a/*.rb", "a/b.rb", "a/b/c.rb"), ("**/*.rb", "a/b/c.rb", "a.rbs"), ("{a,b}/?.rb", "b/x.rb", "c/x.rb"), ("[!a]x", "bx", "ax")):
        import re

        assert re.match(names.glob_pattern(glob), good) and not re.match(names.glob_pattern(glob), bad)


def test_pages(spark, workspace):
    g = workspace.graph
    df = search.page(g.declarations.select("name"), -5, 0, 3)
    assert df.count() == 3 and df.first()["total"] == g.declarations.count()
    with pytest.raises(tools.ToolError) as e:
        tools.get_descendants("Nope", g.declarations, g.descendants)
    assert e.value.record["error"] == "not_found"
    one = tools.get_declaration("Animal", g.declarations, g.definitions, g.ancestors, g.members).first()
    assert one.ancestors[0] == "Animal" and len(one.definitions) == 2 and "Animal#speak()" in [m.name for m in one.members]
    assert tools.codebase_stats(g.documents, g.declarations, g.definitions, g.constant_references, g.method_references).first()["files"] == 2
