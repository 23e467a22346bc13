"""Column expressions over an edge's evidence: ``array<struct<type, detail, count, visibility>>``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weights, evidence layers and their order, and the kinds in display order.
DECLARED, PACKAGE, INCLUDE_CAP, INTEROP, PRIVATE_CUT = 5, 1, 10, 5, 2
LAYER_OF = {"link": "L0", "project_ref": "L0", "package_ref": "L1", "include": "L2", "symbol_use": "L3", "interop": "interop", "runtime": "runtime"}
LAYERS = ("L0", "L1", "L2", "L3", "interop", "runtime")
KINDS = ("link", "project_ref", "package_ref", "include", "symbol_use", "interop", "runtime")
CORROBORATING = ("link", "project_ref", "include", "symbol_use")


def item_weight(type_: Column, count: Column) -> Column:
    """Weight of one evidence item: a missing count is 1, a count of 0 is 0."""
    n = F.coalesce(count, F.lit(1)).cast("long")
    return (
        F.when(type_.isin("link", "project_ref"), DECLARED)
        .when(type_ == "package_ref", PACKAGE)
        .when(type_ == "include", F.least(n, F.lit(INCLUDE_CAP)))
        .when(type_ == "symbol_use", n)
        .when(type_ == "interop", INTEROP)
        .otherwise(0)
        .cast("long")
    )


def weight(evidence: Column) -> Column:
    return F.aggregate(evidence, F.lit(0).cast("long"), lambda total, e: total + item_weight(e["type"], e["count"]))


def declared(evidence: Column) -> Column:
    return F.coalesce(F.exists(evidence, lambda e: e["type"].isin("link", "project_ref")), F.lit(False))


def types(evidence: Column) -> Column:
    return F.array_distinct(F.transform(evidence, lambda e: e["type"]))


def confidence(evidence: Column) -> Column:
    """Three corroborating types are high; declared without use, or a lone type, low; the rest medium."""
    present = types(evidence)
    corroborating = F.size(F.array_intersect(present, F.array(*map(F.lit, CORROBORATING))))
    used = F.arrays_overlap(present, F.array(F.lit("include"), F.lit("symbol_use")))
    return F.when(corroborating >= 3, "high").when(declared(evidence) & ~used, "low").when(corroborating <= 1, "low").otherwise("medium")


def strength(evidence: Column) -> Column:
    present = types(evidence)
    return F.concat_ws(" + ", F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.array_contains(present, k)))


def layer(type_: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LAYER_OF.items() for x in pair))
    return table[type_]


def layers(evidence: Column) -> Column:
    """Layers that produce an edge; one without any known layer counts as L0."""
    found = F.array_distinct(F.filter(F.transform(evidence, lambda e: layer(e["type"])), lambda x: x.isNotNull()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("L0")))


def layer_rank(type_: Column) -> Column:
    """0 for L0 to 3 for L3; interop and runtime rank with the first, for no ceiling drops them."""
    return F.when(layer(type_).isin("L1"), 1).when(layer(type_) == "L2", 2).when(layer(type_) == "L3", 3).otherwise(0)


def private_items(evidence: Column) -> Column:
    return F.size(F.filter(evidence, lambda e: e["visibility"] == "private")).cast("long")


def first_kind(evidence: Column, rules: list[tuple[str, str]]) -> Column:
    """Kind of the first rule, in order, whose text occurs in any detail."""
    out = F.lit(None).cast("string")
    for needle, kind in reversed(rules):
        out = F.when(F.exists(evidence, lambda e: F.coalesce(e["detail"].contains(needle), F.lit(False))), kind).otherwise(out)
    return out


def derived(edges):
    """``edges`` with weight, declaration, confidence and strength computed from the evidence."""
    e = F.col("evidence")
    return edges.withColumns({"weight": weight(e), "is_declared_dependency": declared(e), "confidence": confidence(e), "evidence_strength": strength(e)})


def coverage_rank(value: Column) -> Column:
    """``true`` over "n/m" by n over other text over ``false``; a struct, so comparisons are in that order."""
    n = F.try_to_number(F.split_part(value, F.lit("/"), F.lit(1)), F.lit("999999999999")).cast("long")
    share = value.rlike(r"^\d+/\d+$")
    tier = F.when(value == "true", 3).when(share, 2).when(value == "false", 0).otherwise(1)
    return F.struct(tier.alias("tier"), F.when(share, n).otherwise(F.lit(0).cast("long")).alias("n"))


def covered(value: Column) -> Column:
    """``true``, or "n/m" with n over 0; text such as "partial" and a missing value are not covered."""
    rank = coverage_rank(value)
    return F.coalesce((rank["tier"] == 3) | ((rank["tier"] == 2) & (rank["n"] > 0)), F.lit(False))
