"""Operators on small fixtures where the tables show too little."""

import difflib
from types import SimpleNamespace

from lodestone.operators import ownership
from lodestone.plans import model


def test_sole_provider_looks_at_all_containers(spark):
    targets = spark.createDataFrame([(x, "container:" + x) for x in ("asia", "a", "b", "c", "d")], "id string, container_id string")
    rows = [("a", "asia", 2, ["link"]), ("b", "asia", 2, ["link"]), ("d", "asia", 2, ["link", "interop"]), ("a", "b", 2, ["link"]), ("a", "c", 2, ["include"]), ("b", "c", 2, ["include", "symbol_use"]), ("d", "c", 2, ["include"])]
    edges = spark.createDataFrame([(s, t, w, [(x,) for x in types]) for s, t, w, types in rows], "source string, target string, weight long, evidence array<struct<type string>>")
    got = model.sole_provider(SimpleNamespace(edges=edges, targets=targets)).collect()
    assert [(r.type, r.provider, r.sources, r.weight) for r in got] == [("include", "container:c", 3, 6)]


def test_bindings_by_the_greatest_of_three_signals(spark):
    humans = [("h1", ["orderprocessor"], ["order", "processor"]), ("h2", ["billingsvc", "bill"], ["src", "billing"]), ("h3", ["zzz"], ["qq"]), ("h4", ["orderproc"], ["src"]), ("h5", ["gateway"], []), ("h6", [""], [])]
    targets = [("t1", ["orderprocessor"], ["src"]), ("t2", ["billingservice"], ["other"]), ("t3", ["gatway", "gw"], ["src", "x", "y"]), ("t4", ["orderprocessors"], ["src", "billing", "core"]), ("t5", ["getaway"], ["order", "processor", "z"])]

    def score(h, t):
        tokens = len(set(h[2]) & set(t[2])) / max(1, len(set(h[2]) | set(t[2])))
        ratio = max(difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a in h[1] for b in t[1])
        return round(max(1.0 if set(h[1]) & set(t[1]) else 0.0, round(0.85 * tokens, 6), round(0.7 * ratio, 6)), 3)

    want = []
    for h in humans:
        low, target = min((-score(h, t), t[0]) for t in targets)
        want.append((h[0], target, -low) if -low >= 0.4 else (h[0], None, 0.0))
    made = [spark.createDataFrame(rows, f"{key} string, slugs array<string>, tokens array<string>") for rows, key in ((humans, "human"), (targets, "target"))]
    assert sorted(map(tuple, ownership.propose_bindings(*made).collect())) == want


def test_name_similarity_of_the_whole_table(spark):
    from lodestone.plans import registry

    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_type").collect()
    want = {r.p_partkey: round(difflib.SequenceMatcher(None, r.p_name.lower(), r.p_type.lower()).ratio(), 6) for r in parts}
    assert {r.p_partkey: r.ratio for r in registry.QUERIES["name_similarity"](spark, sf).collect()} == want
