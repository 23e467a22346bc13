"""Comparison of partitions, and the statistics of the comparison tables."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.operators.ranking import before
from lodestone.session import materialise


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of each pair of clusters, over the entities of both partitions (``entity, label``)."""
    return a.select("entity", F.col("label").alias("a")).join(b.select("entity", F.col("label").alias("b")), "entity").groupBy("a", "b").agg(F.count("*").alias("n"))


def _pairs(n):
    return n * (n - 1) / 2


def adjusted_rand(table: DataFrame) -> DataFrame:
    """Adjusted Rand index times 100; null with fewer than two entities, 100 or 0 where it is degenerate."""
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("index"), F.sum("n").alias("n"))
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("rows"))
    columns = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("columns"))
    joined = cells.join(F.broadcast(rows)).join(F.broadcast(columns))
    expected = F.col("rows") * F.col("columns") / _pairs(F.col("n"))
    most = (F.col("rows") + F.col("columns")) / 2
    value = F.when(F.col("n") < 2, None).when(most == expected, F.when(F.col("index") == most, 100.0).otherwise(0.0)).otherwise(100 * (F.col("index") - expected) / (most - expected))
    return joined.select("n", F.round(value, 4).alias("ari"))


def mutual_information(table: DataFrame) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies)."""
    whole = F.broadcast(table.agg(F.sum("n").alias("_n")))
    by_a, by_b = (table.groupBy(c).agg(F.sum("n").alias(f"_{c}")) for c in ("a", "b"))
    joined = table.join(by_a, "a").join(by_b, "b").join(whole)
    p, a, b = (F.col(c) / F.col("_n") for c in ("n", "_a", "_b"))
    cells = joined.select((p * F.log(p / (a * b))).alias("i"), (-p * F.log(a)).alias("ha"), (-p * F.log(b)).alias("hb"))
    sums = cells.agg(F.sum("i").alias("i"), F.sum("ha").alias("ha"), F.sum("hb").alias("hb"))
    return sums.select(F.round(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("i") / (F.col("ha") + F.col("hb"))), 6).alias("nmi"))


def cohen_kappa(table: DataFrame) -> DataFrame:
    """Agreement beyond chance of two labellings with the same labels; 1 where chance alone agrees fully."""
    rows = table.groupBy("a").agg(F.sum("n").alias("ra"))
    columns = table.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("rb"))
    chance = rows.join(columns, "a").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("c"))
    same = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("s"))
    po, pe = F.col("s") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return same.join(F.broadcast(chance)).select(F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def aligned(table: DataFrame, most: int = 1_000_000) -> dict[str, str]:
    """Greedy one-to-one matching of clusters by overlap, ties by name; raises on tables of more than ``most`` cells."""
    cells = table.limit(most + 1).collect()
    if len(cells) > most:
        raise ValueError(f"a contingency table of more than {most} cells")
    out: dict[str, str] = {}
    taken: set[str] = set()
    for row in sorted(cells, key=lambda r: (-r["n"], str(r["a"]), str(r["b"]))):
        if row["a"] not in out and row["b"] not in taken:
            out[row["a"]] = row["b"]
            taken.add(row["b"])
    return out


def rank_biserial(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank effect size of paired values; null without any difference."""
    gaps = pairs.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = average_ranks(gaps, "m")
    return ranked.agg(F.round(F.sum(F.signum("d") * F.col("rank")) / F.sum("rank"), 6).alias("effect"))


def nested_share(table: DataFrame) -> DataFrame:
    """Share in percent of the clusters of ``a`` that lie inside one cluster of ``b``."""
    inside = table.groupBy("a").agg(F.count("*").alias("parts"))
    return inside.agg(F.round(100 * F.count_if(F.col("parts") == 1) / F.count("*"), 4).alias("nested"))


def turbo_mq(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Sum over the clusters of inner / (inner + half of the outer edges); each outer edge counts for both."""
    p = partition.select("entity", "label")
    lifted = edges.join(p.withColumnRenamed("label", "a"), F.col("source") == F.col("entity")).drop("entity").join(p.withColumnRenamed("label", "b"), F.col("target") == F.col("entity"))
    sides = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("inner")))).otherwise(F.array(F.struct(F.col("a").alias("c"), F.lit(0).alias("inner")), F.struct(F.col("b").alias("c"), F.lit(0).alias("inner")))))
    by = lifted.select(sides.alias("x")).groupBy("x.c").agg(F.sum("x.inner").alias("inner"), F.sum(1 - F.col("x.inner")).alias("outer"))
    return by.agg(F.round(F.coalesce(F.sum(F.col("inner") / (F.col("inner") + 0.5 * F.col("outer"))), F.lit(0.0)), 3).alias("mq"), F.coalesce(F.sum("inner"), F.lit(0)).alias("inner"), F.coalesce((F.sum("outer") / 2).cast("long"), F.lit(0)).alias("outer"))


def edge_scores(recovered: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 and Jaccard of two edge sets; two empty sets agree fully."""
    both = recovered.select(*keys).distinct().withColumn("r", F.lit(1)).join(reference.select(*keys).distinct().withColumn("t", F.lit(1)), keys, "full_outer")
    c = both.agg(F.count_if(F.col("r").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count("r").alias("nr"), F.count("t").alias("nt"))
    empty = (F.col("nr") == 0) & (F.col("nt") == 0)
    precision = F.when(empty, 1.0).when(F.col("nr") == 0, 0.0).otherwise(F.col("tp") / F.col("nr"))
    recall = F.when(empty, 1.0).when(F.col("nt") == 0, 0.0).otherwise(F.col("tp") / F.col("nt"))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    jaccard = F.when(empty, 1.0).otherwise(F.col("tp") / (F.col("nr") + F.col("nt") - F.col("tp")))
    return c.select(F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(jaccard, 6).alias("jaccard"))


def average_ranks(rows: DataFrame, value: str, partition: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Column ``rank``: position in order, ties share the mean of theirs.

    Within groups a window ranks; over all rows the values are counted first, placed by ranges, and
    joined back, so no task holds the whole order.
    """
    if partition:
        order = Window.partitionBy(*partition).orderBy(F.desc(value) if descending else F.asc(value))
        return rows.withColumn("rank", F.rank().over(order) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2)
    placed = before(rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n")), ["_v"], F.col("_n"))
    first = F.col("_total") - F.col("_before") - F.col("_n") if descending else F.col("_before")
    ranks = placed.select("_v", (first + 1 + (F.col("_n") - 1) / 2).alias("rank"))
    return rows.join(ranks, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null with fewer than three pairs."""
    ranked = average_ranks(average_ranks(pairs, x).withColumnRenamed("rank", "rx"), y).withColumnRenamed("rank", "ry")
    return ranked.agg(F.round(F.when(F.count("*") >= 3, F.corr("rx", "ry")), 6).alias("rho"), F.count("*").alias("n"))


def cliffs_delta(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """(#greater - #less) / (n m), by the ranks of the joint order instead of all pairs."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("a")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("a")))
    by = both.groupBy("v").agg(F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    placed = before(by, ["v"], F.col("nb"))
    more = F.col("_total") - F.col("_before") - F.col("nb")
    return placed.select("na", "nb", (F.col("na") * (F.col("_before") - more)).alias("d")).agg(F.round(F.sum("d") / (F.sum("na") * F.sum("nb")), 6).alias("delta"))


# The statistics below are over a few numbers on the driver.


def wilson(k: float, n: float, z: float = 1.96) -> tuple[float, float] | None:
    """Wilson interval of a share, to four places; none for n = 0."""
    if not n:
        return None
    p, z2 = k / n, z * z
    centre, half = p + z2 / (2 * n), z * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return round((centre - half) / (1 + z2 / n), 4), round((centre + half) / (1 + z2 / n), 4)


def mcnemar_exact(b: int, c: int) -> float | None:
    """Two-sided exact binomial test of discordant counts; none without any."""
    n = b + c
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n else None


def holm(p_values: dict[str, float]) -> dict[str, float]:
    """Step-down adjusted p-values."""
    out, worst = {}, 0.0
    for k, name in enumerate(sorted(p_values, key=lambda x: (p_values[x], x))):
        worst = max(worst, min(1.0, (len(p_values) - k) * p_values[name]))
        out[name] = worst
    return out


def assignment(cost: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Least-cost matching of the rows to different columns (or all columns to rows, if fewer), by shortest augmenting paths."""
    matrix = np.asarray(cost, float)
    if not matrix.size:
        return []
    turned = matrix.shape[0] > matrix.shape[1]
    if turned:
        matrix = matrix.T
    rows, columns = matrix.shape
    u, v, owner = np.zeros(rows), np.zeros(columns), np.full(columns, -1)
    for row in range(rows):
        least, came, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        at, column = row, -1
        reached = 0.0
        while at >= 0:
            reduced = reached + matrix[at] - u[at] - v
            better = ~done & (reduced < least)
            least[better], came[better] = reduced[better], column
            column = int(np.where(done, np.inf, least).argmin())
            reached = least[column]
            done[column] = True
            at = owner[column]
        u[row] += reached
        for k in np.flatnonzero(done):
            if k != column and owner[k] >= 0:
                u[owner[k]] += reached - least[k]
            v[k] -= reached - least[k]
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    pairs = [(int(r), int(c)) for c, r in enumerate(owner) if r >= 0]
    return sorted((c, r) for r, c in pairs) if turned else sorted(pairs)


def mojo_fm(a: dict[str, str], b: dict[str, str]) -> float | None:
    """MoJoFM of partition ``a`` against ``b``: 100 (1 - mno(a, b) / max mno(., b)), published definition.

    Moves and joins from a to b: members not of their cluster's chosen group move, and clusters that
    chose the same group join. The choice is a maximum overlap per cluster, with as many different
    groups as possible among the maxima (bipartite matching).
    """
    common = sorted(set(a) & set(b))
    if not common:
        return None

    def distance(left: dict[str, str]) -> int:
        table: dict[str, dict[str, int]] = {}
        for x in common:
            table.setdefault(left[x], {}).setdefault(b[x], 0)
            table[left[x]][b[x]] += 1
        best = {c: [g for g, n in row.items() if n == max(row.values())] for c, row in table.items()}
        owner: dict[str, str] = {}

        def augment(c: str, seen: set[str]) -> bool:
            for g in best[c]:
                if g not in seen:
                    seen.add(g)
                    if g not in owner or augment(owner[g], seen):
                        owner[g] = c
                        return True
            return False

        for c in sorted(best):
            augment(c, set())
        return len(common) - sum(max(row.values()) for row in table.values()) + len(table) - len(owner)

    groups: dict[str, int] = {}
    for x in common:
        groups[b[x]] = groups.get(b[x], 0) + 1
    # The farthest partition splits every group over as many clusters as there are in the largest.
    counts: list[int] = sorted(groups.values())
    distinct = 0
    for size in counts:
        distinct += distinct < size
    most = len(common) - distinct
    return 100.0 if most <= 0 else round(100 * (1 - distance(a) / most), 4)


def a2a(a: dict[str, str], b: dict[str, str]) -> float:
    """Architecture-to-architecture similarity, published definition, in percent.

    100 (1 - mto / (aco(a) + aco(b))): entities added, removed and moved, and clusters added and
    removed, with clusters matched by the largest total overlap; aco counts clusters and twice the
    entities, added and moved, that build an architecture from none.
    """
    if not a and not b:
        return 100.0
    rows, columns = sorted(set(a.values())), sorted(set(b.values()))
    common = set(a) & set(b)
    overlap = [[0] * len(columns) for _ in rows]
    at, to = {c: k for k, c in enumerate(rows)}, {c: k for k, c in enumerate(columns)}
    for x in common:
        overlap[at[a[x]]][to[b[x]]] += 1
    stay = sum(overlap[r][c] for r, c in assignment([[-n for n in row] for row in overlap])) if rows and columns else 0
    moved = len(common) - stay
    changed = len(set(a) ^ set(b))
    mto = abs(len(rows) - len(columns)) + 2 * changed + moved
    aco = len(rows) + 2 * len(a) + len(columns) + 2 * len(b)
    return round(100 * (1 - mto / aco), 4)


# Critical values of the Studentised range over the root of 2, at 0.05, for 2 to 12 techniques.
NEMENYI = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164, 11: 3.219, 12: 3.268}


def critical_difference(scores: DataFrame) -> tuple[DataFrame, float | None, int]:
    """Average ranks of techniques over the systems that all have (``system, technique, value``), and the difference that counts."""
    n_techniques = scores.select("technique").distinct().count()
    whole = scores.where("value IS NOT NULL").groupBy("system").agg(F.count_distinct("technique").alias("k")).where(F.col("k") == n_techniques).select("system")
    ranked = average_ranks(scores.join(whole, "system", "left_semi"), "value", ["system"], descending=True)
    n = whole.count()
    difference = round(NEMENYI[n_techniques] * math.sqrt(n_techniques * (n_techniques + 1) / (6 * n)), 3) if n and n_techniques in NEMENYI else None
    return ranked.groupBy("technique").agg(F.round(F.avg("rank"), 3).alias("rank")), difference, n


def rank_verdicts(ranks: DataFrame, difference: float | None, focus: str) -> DataFrame:
    """``technique, rank_diff, significant`` of each technique against one; none without a difference that counts."""
    own = F.broadcast(ranks.where(F.col("technique") == focus).select(F.col("rank").alias("_own")))
    gap = F.round(F.col("rank") - F.col("_own"), 3)
    rows = ranks.where(F.col("technique") != focus).join(own).select("technique", gap.alias("rank_diff"), (F.abs(gap) > F.lit(difference)).alias("significant"))
    return rows.where(F.lit(difference is not None))


def rand_index(table: DataFrame) -> DataFrame:
    """Share of the pairs of entities on which two labellings agree, from their contingency table."""
    pairs = lambda n: n * (n - 1) / 2
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    a = table.groupBy("a").agg(F.sum("n").alias("x")).agg(F.sum(pairs(F.col("x"))).alias("ra"))
    b = table.groupBy("b").agg(F.sum("n").alias("x")).agg(F.sum(pairs(F.col("x"))).alias("rb"))
    total = pairs(F.col("n"))
    value = (total + 2 * F.col("both") - F.col("ra") - F.col("rb")) / total
    return cells.join(F.broadcast(a)).join(F.broadcast(b)).select(F.round(F.when(total > 0, value).otherwise(1.0), 6).alias("rand"))


def aligned_kappa(table: DataFrame) -> DataFrame:
    """Kappa after the labels of ``a`` took the names of those of ``b`` that they overlap most (``aligned``)."""
    names = list(aligned(table).items())
    if not names:
        return cohen_kappa(table)
    known = table.sparkSession.createDataFrame(names, "a string, _b string")
    renamed = table.withColumn("a", F.col("a").cast("string")).join(known, "a", "left").select(F.coalesce("_b", F.concat(F.lit("\u0001"), "a")).alias("a"), F.col("b").cast("string").alias("b"), "n")
    return cohen_kappa(renamed)


def diagnosis(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``units, clusters, ratio, largest, mq`` of a clustering (``entity, label``): how coarse it is, and how modular."""
    sizes = entities.groupBy("label").agg(F.count("*").alias("n"))
    shape = sizes.agg(F.sum("n").alias("units"), F.count("*").alias("clusters"), F.max("n").alias("_top"))
    rows = shape.select("units", "clusters", F.round(F.col("units") / F.col("clusters"), 3).alias("ratio"), F.round(F.col("_top") / F.col("units"), 4).alias("largest"))
    return rows.join(F.broadcast(turbo_mq(edges, entities).select("mq")))


def scored(clustering: DataFrame, reference: DataFrame) -> DataFrame:
    """``n, ari, only_clustering, only_reference, blank``: agreement over common entities, and how many were left out.

    Entities with white space can't stand in the text form of a partition; they are dropped and counted.
    """
    blank = lambda t: t.where(F.col("entity").rlike(r"\s"))
    clean = lambda t: t.where(~F.col("entity").rlike(r"\s"))
    a, b = clean(clustering), clean(reference)
    alone = lambda x, y, name: x.join(y.select("entity"), "entity", "left_anti").agg(F.count("*").alias(name))
    dropped = blank(clustering).select("entity").union(blank(reference).select("entity")).agg(F.count_distinct("entity").alias("blank"))
    row = adjusted_rand(contingency(a, b))
    for part in (alone(a, b, "only_clustering"), alone(b, a, "only_reference"), dropped):
        row = row.join(F.broadcast(part))
    return row


def parse_partition(content: str, nodes: set[str]) -> dict[str, str]:
    """Entity to label of a reply: a map of entities, a map of lists, or a list of clusters; unknown entities go."""
    start = min((k for k in (content.find("{"), content.find("[")) if k >= 0), default=-1)
    if start < 0:
        return {}
    try:
        data, _ = json.JSONDecoder().raw_decode(content[start:])
    except ValueError:
        return {}
    pairs: list[tuple[str, str]] = []
    if isinstance(data, dict) and isinstance(data.get("clusters"), list):
        data = data["clusters"]
    if isinstance(data, list):
        pairs = [(m, str(c.get("name", k))) for k, c in enumerate(data) if isinstance(c, dict) for m in c.get("members") or []]
    else:
        for key, value in data.items():
            pairs += [(m, key) for m in value] if isinstance(value, list) else [(key, str(value))]
    return {m: label for m, label in pairs if m in nodes}


def comparison(clusterings: dict[str, DataFrame], reference: DataFrame) -> DataFrame:
    """``technique, n, ari`` of each clustering over the entities that all of them and the reference have; entities with white space go."""
    shared = reference.where(~F.col("entity").rlike(r"\s")).select("entity").distinct()
    for table in clusterings.values():
        shared = shared.join(table.select("entity"), "entity", "left_semi")
    shared = materialise(shared, "entities")
    out = None
    for name in sorted(clusterings):
        own = clusterings[name].join(shared, "entity", "left_semi")
        row = adjusted_rand(contingency(own, reference.join(shared, "entity", "left_semi"))).select(F.lit(name).alias("technique"), "n", "ari")
        out = row if out is None else out.unionByName(row)
    return out


def churn_stability(before: dict[str, str], after: dict[str, str]) -> float | None:
    """MoJoFM of a clustering after entities were removed against itself before, over the survivors."""
    kept = set(before) & set(after)
    return mojo_fm({x: after[x] for x in kept}, {x: before[x] for x in kept})


def separating_interval(values: dict[str, float], good: dict[str, bool]) -> tuple[float, float] | None:
    """Thresholds that tell good from bad systems by one number, (highest bad, lowest good); none where they mix."""
    low, high = max((v for s, v in values.items() if not good[s]), default=-math.inf), min((v for s, v in values.items() if good[s]), default=math.inf)
    return (low, high) if low < high else None


def leave_one_out(values: dict[str, float], good: dict[str, bool]) -> dict[str, tuple[float, float] | None]:
    """The separating interval without each system in turn."""
    return {left: separating_interval({s: v for s, v in values.items() if s != left}, good) for left in sorted(values)}


def bootstrap_rho(x: list[float], y: list[float], seed: int = 20260904, reps: int = 2000) -> tuple[float, float] | None:
    """Interval of 95 % of a rank correlation under resampling; none with fewer than three pairs."""
    if len(x) < 3:
        return None
    rng, found = np.random.default_rng(seed), []

    def ranks(v: np.ndarray) -> np.ndarray:
        _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        return (np.cumsum(counts) - (counts - 1) / 2)[inverse]

    for _ in range(reps):
        at = rng.integers(0, len(x), len(x))
        a, b = ranks(np.asarray(x, float)[at]), ranks(np.asarray(y, float)[at])
        if a.std() and b.std():
            found.append(float(np.corrcoef(a, b)[0, 1]))
    return (round(float(np.quantile(found, 0.025)), 4), round(float(np.quantile(found, 0.975)), 4)) if found else None
