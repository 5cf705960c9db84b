import pytest

from weftgraph import cli
from weftgraph.api import Graph

ANIMALS = "class Animal\n  LIMIT = 3\n  def speak; end\n  private\n  def hide; end\nend\nmodule Farm\n  class Dog < Animal\n    def self.breed; Animal.find(LIMIT); end\n  end\n  Pup = Dog\nend\n"
TYPES = "class Farm::Cat < Animal\n  def purr: () -> void\nend\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    (root / "animals.rb").write_text(ANIMALS)
    (root / "types.rbs").write_text(TYPES)
    return root


@pytest.fixture(scope="module")
def graph(spark, folder):
    found, errors = Graph.index_paths(spark, [str(folder), str(folder / "nowhere")])
    assert [e["path"] for e in errors] == [str(folder / "nowhere")]
    return found


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_methods(graph):
    assert names(graph["::Farm::Dog"]) == ["Farm::Dog"] and names(graph.search("fdog")) == ["Farm::Dog", "Farm::Dog::<Dog>", "Farm::Dog::<Dog>#breed()"]
    assert names(graph.owner("Farm::Dog")) == ["Farm"] and names(graph.singleton("Farm::Dog")) == ["Farm::Dog::<Dog>"] and names(graph.attached("Farm::Dog::<Dog>")) == ["Farm::Dog"]
    assert names(graph.members("Animal"), "member") == ["LIMIT", "hide()", "speak()"] and names(graph.member("Farm::Cat", "purr()")) == ["Farm::Cat#purr()"]
    assert [r.ancestor for r in graph.ancestors("Farm::Cat").collect()][:2] == ["Farm::Cat", "Animal"]
    assert names(graph.descendants("Animal"), "descendant") == ["Animal", "Farm::Cat", "Farm::Dog"]
    assert graph.find_member("Farm::Dog", "speak()").first().found == "Animal#speak()"
    assert graph.resolve_constant("LIMIT", ["Farm", "Farm::Dog"]).first().found == "Animal::LIMIT" and graph.resolve_constant("Nope").count() == 0
    assert graph.resolve_constant("Pup::LIMIT", ["Farm"]).first().found == "Animal::LIMIT"
    assert {r.receiver: r.declaration for r in graph.calls("find").collect()} == {"Animal": "Animal"}
    assert graph.references("Animal").count() >= 2 and graph.definitions("Animal").count() == 1 and graph.integrity().count() == 0
    assert {r.name: r.visibility for r in graph.visibility().collect()}["Animal#hide()"] == "private"
    assert graph.query("MATCH (c:Class)-[:HAS_PARENT]->(p:Class {name: 'Animal'}) RETURN c.name ORDER BY c.name").rows == [["Farm::Cat"], ["Farm::Dog"]] or len(graph.query("MATCH (c:Class)-[:HAS_PARENT]->(p:Class {name: 'Animal'}) RETURN c.name").rows) == 2


def test_changes(graph, folder):
    uri = graph.tables.documents.where("uri LIKE '%types.rbs'").first().uri
    after = graph.delete(uri)
    assert "Farm::Cat" not in names(after.tables.declarations) and after.delete(uri) is after
    with pytest.raises(ValueError, match="without its sources"):
        Graph(graph.tables).delete(uri)


def test_command_line(spark, folder, capsys):
    assert cli.main(["query", "MATCH (", "--path", str(folder)], spark) == 2 and cli.main(["query"], spark) == 2
    assert cli.main(["index", "--stop-after", "listing", "--path", str(folder)], spark) == 0
    assert cli.main(["index", "--stop-after", "indexing", "--path", str(folder / "nowhere")], spark) == 1
    out = capsys.readouterr()
    assert "2 files" in out.out and "0 facts" in out.out and "no such file" in out.err
    assert cli.main(["query", "MATCH (c:Class {name: 'Farm::Dog'}) RETURN c.name AS name", "--format", "json", "--path", str(folder)], spark) == 0
    assert '[{"name":"Farm::Dog"}]' in capsys.readouterr().out
