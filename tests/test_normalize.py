"""Fragments to a model: every order of files gives one result, and the command line answers from it."""

import itertools
import json

import pytest

from lodestone import __main__ as cli
from lodestone.operators import normalize
from lodestone.sources import fragments


def evidence(type_, detail, **more):
    return {"type": type_, "detail": detail, **more}


PARTS = {
    "a.json": {"schema_version": "1.0", "provenance": {"extractors": [{"name": "build_graph", "version": "1"}], "coverage": {"t:a": {"L0": True, "L2": "3/9"}, "t:b": {"L0": True}}},
               "targets": [{"id": "t:a", "name": "A", "type": "library", "tags": ["x"]}, {"id": "t:b", "name": "B", "external": False}],
               "relationships": [{"source": "t:a", "target": "t:b", "evidence": [evidence("link", "l")]}]},
    "b.json": {"provenance": {"extractors": [{"name": "cpp_facts", "version": "1"}], "coverage": {"t:a": {"L2": "5/9"}}},
               "targets": [{"id": "t:a", "name": "Alpha", "path": "src/a", "tags": ["y", "x"], "external": True, "components": [{"id": "c1", "name": "ns", "level": "namespace", "code": [{"id": "k1", "name": "K", "level": "class"}]}]}],
               "relationships": [{"source": "t:a", "target": "t:b", "kind": "uses", "evidence": [evidence("include", "h", count=3), evidence("link", "l")]}]},
    "c.json": {"provenance": {"extractors": [{"name": "unheard", "version": "1"}]}, "targets": [{"id": "t:b", "name": "Bee"}, {"id": "t:c", "name": "C"}],
               "relationships": [{"source": "t:a", "target": "t:b", "evidence": [evidence("include", "h", count=2)]}, {"source": "t:b", "target": "t:c", "evidence": [evidence("link", "m")]}],
               "deployment": {"nodes": [{"id": "n", "ports": ["80"]}, {"id": "n", "name": "web", "ports": ["443"]}], "edges": [{"source": "n", "target": "m", "kind": "calls"}]}},
}


@pytest.fixture
def folder(tmp_path):
    for name, part in PARTS.items():
        (tmp_path / name).write_text(json.dumps(part))
    (tmp_path / "z.json").write_text("{broken")
    return str(tmp_path)


def test_model_of_fragments(spark, folder):
    facts = normalize.normalize(fragments.read_fragments(spark, folder))
    rows = {r.id: r for r in facts.targets.collect()}
    assert (rows["t:a"].name, rows["t:a"].path, rows["t:a"].tags, rows["t:a"].external) == ("A", None, ["x", "y"], True)
    assert rows["t:b"].name == "B" and rows["t:c"].name == "C" and len(rows) == 3
    edge = facts.edges.where("target = 't:b'").first()
    assert (edge.weight, edge.kind, edge.confidence, [(e.type, e["count"]) for e in edge.evidence]) == (10, "uses", "medium", [("include", 5), ("link", None)])
    assert {(r.id, r.layer): r.value for r in facts.coverage.collect()} == {("t:a", "L0"): "true", ("t:a", "L2"): "5/9", ("t:b", "L0"): "true"}
    assert sorted((r.field, r.kept, r.dropped) for r in facts.conflicts.collect()) == [("name", "A", "Alpha"), ("name", "B", "Bee")]
    assert {(r.id, r.parent) for r in facts.components.collect()} == {("c1", None), ("k1", "c1")}
    node = facts.deploy_nodes.first()
    assert (node["name"], node.ports) == ("web", ["443", "80"]) and facts.deploy_edges.count() == 1
    assert {r.id for r in normalize.element_ids(facts).collect()} == {"t:a", "t:b", "t:c", "c1", "k1"}


def test_row_order_does_not_matter(spark, folder):
    whole = fragments.read_fragments(spark, folder).where("fragment <> 'z.json'")
    results = set()
    for order in itertools.permutations(PARTS):
        parts = [whole.where(f"fragment = '{name}'") for name in order]
        facts = normalize.normalize(parts[0].unionByName(parts[1]).unionByName(parts[2]))
        results.add((str(sorted(facts.targets.drop("tags").collect())), str(sorted(map(str, facts.edges.collect())))))
    assert len(results) == 1


def test_command_line(spark, folder, tmp_path_factory, capsys):
    assert cli.main(["query", folder, "dependents", "t:c", "--transitive"]) == 0
    out = capsys.readouterr().out
    assert "t:a" in out and "2 in all" in out
    assert cli.main(["query", folder, "dependents", "nothing"]) == 2
    rules = tmp_path_factory.mktemp("rules")
    (rules / "layering.yaml").write_text("forbidden: [{from: 't:a', to: 't:b'}]")
    (rules / "mapping.yaml").write_text("group: [{container: Core, members_glob: 't:*'}]")
    assert cli.main(["layering", folder, "--layering", str(rules / "layering.yaml")]) in (0, 3)
    assert cli.main(["diagram", folder, "--rules", str(rules / "mapping.yaml")]) == 0
    assert "core = container" in capsys.readouterr().out
