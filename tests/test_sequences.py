"""Sequences across ranges, and scenarios mined from tests."""

import random

from pyspark.sql import functions as F

from lodestone.operators import scenarios, sequences
from lodestone.sources import code
from lodestone.sources.files import parsed


def test_neighbours_across_ranges(spark):
    """One key with most rows, dealt over many ranges; repeats, nulls, and keys of one row."""
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", k, rng.choice("aab") if rng.random() < 0.9 else None) for k in range(3000)] + [(None, 1, "a"), (None, 2, "b")]
    table = spark.createDataFrame(rows, "key string, at int, value string").repartition(7)
    want, last = {}, {}
    for key, at, value in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[key, at] = last.get(key)
        last[key] = value
    got = {(r["key"], r["at"]): r["_previous"] for r in sequences.previous(table, ["key"], ["at"], "value").collect()}
    assert got == want
    changes, last = [], {}
    for key, at, value in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        if value is not None:
            if key in last and last[key] != value:
                changes.append((key or "", at, last[key], value))
            last[key] = value
    hops = sequences.hops(table, ["key"], ["at"], "value")
    assert sorted((r[0] or "", *r[1:]) for r in hops.collect()) == changes
    numbers = sequences.numbered(table.where("key IS NOT NULL").drop("value"), ["key"], ["at"])
    by = {}
    for key, at, index in numbers.collect():
        by.setdefault(key, []).append((index, at))
    assert all([i for i, _ in sorted(v)] == list(range(1, len(v) + 1)) and [a for _, a in sorted(v)] == sorted(a for _, a in v) for v in by.values()) and sum(map(len, by.values())) == 3000
    assert sequences.hops(table.limit(0), ["key"], ["at"], "value").count() == 0


def test_scenarios_keep_real_edges_only(spark):
    texts = [
        ("t/FlowTests.cs", "await orders.PlaceOrder();\n await payments . Charge(1);\n payments.Check(); helper.Go();\n await shipping.Ship();"),
        ("t/None_test.cpp", "orders.a(); orders.b(); other.c();"),
        ("t/Flow.cs", "orders.PlaceOrder(); payments.Charge();"),
        ("t/Big-Flow Test.v2.cs", "shipping.x(); orders.y(); payments.z(); orders.y(); payments.z();"),
    ]
    files = spark.createDataFrame(texts, "path string, text string")
    targets = spark.createDataFrame([("p1", "orders", "c-orders"), ("p2", "payments", "c-payments"), ("p3", "shipping", "c-shipping")], "id string, name string, container_id string")
    edges = spark.createDataFrame([("c-orders", "c-payments")], "source_container string, target_container string")
    calls = parsed(files, code.test_calls, code.CALLS)
    got = sorted(map(tuple, scenarios.mined(calls, targets, edges).select("path", "key", "index", "from", "to", "description").collect()))
    step = ("c-orders", "c-payments")
    assert got == [
        ("t/Big-Flow Test.v2.cs", "test-big-flow-test-v2", 1, *step, "Observed in test Big-Flow Test.v2.cs"),
        ("t/Big-Flow Test.v2.cs", "test-big-flow-test-v2", 2, *step, "Observed in test Big-Flow Test.v2.cs"),
        ("t/FlowTests.cs", "test-flowtests", 1, *step, "Observed in test FlowTests.cs"),
    ]
    assert scenarios.mined(calls.where(F.lit(False)), targets, edges).count() == 0
