from weftgraph.sources.rbs import SignatureReader
from weftgraph.sources.facts import read_file

TEXT = '''# Animals.
# Many.
%a{deprecated: use Beast}
class Animal[T] < Base::Thing[T]
  include Loud[T]
  extend Enumerable[T]
  LIMIT: Integer
  attr_reader name: String
  private attr_accessor self.count: Integer
  def feed: (String food, ?Integer n, *Symbol rest, key: Integer, ?opt: (Integer | String), **untyped kw) { (T) -> void } -> bool
          | [U] (Integer) -> U
  def self.make: () -> instance
  def self?.both: (?) -> untyped
  private
  def hidden: () -> void
  alias eat feed
  alias self.build self.make
  type json = Integer | String
  @name: String
end
interface _Each
  def each: () -> void
end
module Zoo::Deep : Object
  def x=: (Integer) -> Integer
  def ==: (untyped other) -> bool
end
$debug: bool
class Other = Animal
'''


def rows(text, uri="file:///a.rbs"):
    return SignatureReader(uri, text).read()


def test_declarations():
    defs = [(r["kind"], r["path"]) for r in rows(TEXT) if r["fact"] == "definition"]
    assert defs == [
        ("Class", "Animal"), ("Constant", "LIMIT"), ("Method", "name()"), ("Method", "count()"), ("Method", "count=()"), ("Method", "feed()"), ("Method", "make()"), ("Method", "both()"), ("Method", "both()"),
        ("Method", "hidden()"), ("AliasMethod", "eat()"), ("AliasMethod", "build()"), ("Module", "Zoo::Deep"), ("Method", "x=()"), ("Method", "==()"), ("GlobalVariable", "$debug"),
    ]
    assert not [r for r in rows(TEXT) if r["fact"] == "diagnostic"]


def test_attributes_of_declarations():
    by = {}
    for r in rows(TEXT):
        if r["fact"] == "definition":
            by.setdefault(r["path"], []).append(r)
    animal = by["Animal"][0]
    assert animal["superclass"] == "Base::Thing" and animal["deprecated"] and animal["comments"] == ["# Animals.", "# Many."]
    assert animal["mixins"] == [{"kind": "include", "target": "Loud"}, {"kind": "extend", "target": "Enumerable"}]
    assert by["LIMIT"][0]["promotable"] and by["LIMIT"][0]["scope"] == [animal["id"]] and not by["feed()"][0]["deprecated"]
    assert [(p["kind"], p["name"]) for p in by["feed()"][0]["params"]] == [
        ("required_positional", "food"), ("optional_positional", "n"), ("rest_positional", "rest"), ("required_keyword", "key"), ("optional_keyword", "opt"), ("rest_keyword", "kw"), ("block", "block"),
        ("overload", "1"), ("required_positional", "arg0"),
    ]
    assert [(r["singleton"], r["visibility"]) for r in by["both()"]] == [(True, "public"), (False, "private")]
    assert by["hidden()"][0]["visibility"] == "private" and by["count()"][0]["visibility"] == "private" and by["count()"][0]["singleton"] and by["x=()"][0]["visibility"] == "public"
    assert by["eat()"][0]["old"] == "feed()" and by["build()"][0]["singleton"]
    refs = {r["path"] for r in rows(TEXT) if r["fact"] == "constant"}
    assert refs == {"Base", "Base::Thing", "Loud", "Enumerable", "Zoo"}


def test_files_are_read_by_their_ending():
    assert [r["kind"] for r in read_file("file:///a.rbs", "A: Integer")] == ["Constant"]
    assert [r["path"] for r in read_file("file:///a.rb", "class A; end")] == ["A"]
    assert [r["kind"] for r in rows("class A\n  what is this\n") if r["fact"] == "diagnostic"] == ["ParseError", "ParseError"]
    assert rows("") == [] and rows("end")[0]["kind"] == "ParseError"


def test_signatures_and_sources_make_one_graph(spark):
    from weftgraph.operators.resolve import index

    files = [("file:///a.rb", "class Animal\n  def feed; end\nend\n"), ("file:///a.rbs", "class Animal < Base\n  def feed: () -> void\n  def sleep: () -> void\nend\nclass Base\nend\n")]
    g = index(spark.createDataFrame(files, "uri string, source string"))
    assert {r.name for r in g.members.where("owner = 'Animal'").collect()} == {"Animal#feed()", "Animal#sleep()"}
    assert [r.ancestor for r in g.ancestors.where("name = 'Animal'").orderBy("pos").collect()][:2] == ["Animal", "Base"]
    assert g.definitions.where("declaration = 'Animal#feed()'").count() == 2
