"""Hand-drawn models and the context view."""

import json

import pytest

from lodestone.sources import drawing

DRAWN = '''workspace "Toy" "By hand {" {
    !include shared.dsl
    # a comment { with a brace
    model {
        operator = person "Operator" "Runs the system"
        toy = softwareSystem "Toy System" "The system" { // opens }
            web = container "Web {Front} \\"end\\"" "UI" "React" {
                -> api "calls"
            }
            /* group "No" { */
            group "Backend" {
                api = container "API Service" "Handles" "C#"
                component "Loose Part"
            }
            properties {
                "a" "b"
            }
            late = container "Late"
        }
        mail = softwareSystem "Mail"
        operator -> toy "Uses"
        toy->mail
    }
    views {
        systemContext toy "Context" {
            include *
        }
    }
    styles { element "Person" { shape Person } }
}
'''


def elements(rows):
    return {r[2]: (r[1], r[3], r[4], r[5], r[6]) for r in rows if r[1] in drawing.ELEMENTS}


def test_blocks_strings_and_comments():
    rows = list(drawing.diagram("w.dsl", DRAWN))
    assert elements(rows) == {
        "operator": ("person", "Operator", "Runs the system", "", ""),
        "toy": ("softwareSystem", "Toy System", "The system", "", ""),
        "web": ("container", 'Web {Front} "end"', "UI", "React", "Toy System"),
        "api": ("container", "API Service", "Handles", "C#", "Backend"),
        "loose-part": ("component", "Loose Part", "", "", "Backend"),
        "late": ("container", "Late", "", "", "Toy System"),
        "mail": ("softwareSystem", "Mail", "", "", ""),
    }
    assert [(r[2], r[3], r[4]) for r in rows if r[1] == "relation"] == [("web", "api", "calls"), ("operator", "toy", "Uses"), ("toy", "mail", "")]
    assert [(r[1], r[3]) for r in rows if r[1] == "group"] == [("group", "Backend")]
    text = {r[1]: r[4] for r in rows if r[1] in drawing.VERBATIM}
    assert "systemContext toy" in text["views"] and text["views"].rstrip().endswith("}") and text["styles"].strip() == 'element "Person" { shape Person }'
    assert list(drawing.diagram("x", "")) == [] and len(list(drawing.diagram("x", 'a = person "A" {{{ }'))) == 1
    deep = "x {" * 20_000 + 'p = person "P"' + "}" * 20_000
    assert [r[2] for r in drawing.diagram("x", deep)] == ["p"]


def test_workspaces_as_json():
    parts = [{"id": "3", "name": "Web", "technology": "React"}, {"id": "4", "name": "API", "group": "Backend", "components": [{"id": "5", "name": "Part"}]}]
    whole = {"model": {"people": [{"id": "1", "name": "Operator", "description": "Runs", "relationships": [{"destinationId": "2"}]}], "softwareSystems": [{"id": "2", "name": "Toy", "containers": parts}]}, "views": {"b": 1, "a": 2}, "configuration": {"styles": {"s": 1}}}
    rows = list(drawing.workspace("w.json", json.dumps(whole)))
    assert {k: v[4] for k, v in elements(rows).items()} == {"1": "", "2": "", "3": "Toy", "4": "Backend", "5": "Backend"}
    assert [(r[2], r[3]) for r in rows if r[1] == "relation"] == [("1", "2")]
    assert [(r[1], r[4]) for r in rows if r[1] in drawing.VERBATIM] == [("views", '{\n  "a": 2,\n  "b": 1\n}'), ("styles", '{\n  "s": 1\n}')]


def test_seeds_and_the_context_view(spark):
    files = spark.createDataFrame([("w.dsl", DRAWN)], "path string, text string")
    rows = drawing.drawn(files).cache()
    names, groups, seed = drawing.seed_rules(rows, "w.dsl")
    assert {r["key"]: r["name"] for r in names.collect()}["api"] == "API Service"
    assert sorted(r[0] for r in groups.collect()) == ["Backend", "Toy System"]
    assert tuple(seed.first()) == ("w.dsl", True, "pending")
    nodes = spark.createDataFrame([("infra:db", "db", "infra", "PostgreSQL", True), ("infra:in", "in", "infra", None, False), ("infra:bus", None, "infra", "queue", True)], "id string, name string, kind string, technology string, external boolean")
    calls = spark.createDataFrame([("deploy:image:api", "infra:db", "calls"), ("deploy:image:api", "infra:bus", "packages"), ("other", "infra:bus", "calls")], "source string, target string, kind string")
    found, edges = drawing.context_view(rows, nodes, calls, system="toy")
    assert sorted((r["id"], r["label"], r["external"]) for r in found.collect()) == [("dsl:person:operator", "Operator", False), ("dsl:system:mail", "Mail", True), ("infra:bus", "infra:bus", True), ("infra:db", "db", True), ("system", "Toy System", False)]
    assert sorted((r["source"], r["target"], r["label"]) for r in edges.collect() if r["kind"] == "uses") == [("dsl:person:operator", "system", "Uses"), ("system", "dsl:system:mail", None)]
    assert [(r["source"], r["target"]) for r in edges.collect() if r["kind"] == "calls"] == [("system", "infra:db")]
    with pytest.raises(ValueError):
        drawing.context_view(rows.limit(0), nodes.limit(0), calls)
