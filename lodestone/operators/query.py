"""The query primitives over a model: one façade, every answer with its parameters and coverage.

Identifiers are resolved by ranked lookups, answers are DataFrames; only the small envelope (the
resolution, totals, coverage) is computed on the driver.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from lodestone.functions.texts import question_route
from lodestone.operators import govern, graph, lift

LIMIT, MOST_PATHS = 100, 10


@dataclass
class Answer:
    primitive: str
    params: dict
    rows: DataFrame | None
    total: int = 0
    truncated: bool = False
    error: str | None = None
    candidates: list[str] = field(default_factory=list)
    coverage: float = 0.0
    advisory: bool = False
    model_hash: str = ""


class Model:
    """Targets, edges and coverage of one repository."""

    def __init__(self, targets: DataFrame, edges: DataFrame, coverage: DataFrame, rules: DataFrame | None = None):
        self.targets, self.edges, self.coverage, self.rules = targets, edges, coverage, rules

    @cached_property
    def hash(self) -> str:
        """Hash of the targets and edges, whatever the order of their rows."""
        parts = []
        for table in (self.targets, self.edges):
            line = F.xxhash64(F.to_json(F.struct(*sorted(table.columns))))
            parts += table.agg(F.count("*"), F.coalesce(F.sum(line.cast("decimal(38,0)")), F.lit(0))).first()
        return hashlib.sha256(" ".join(map(str, parts)).encode()).hexdigest()

    def resolve(self, ident: str) -> tuple[str, list[str], list[str]]:
        """Kind, target ids and candidates of a name.

        In order: target id, container id, a target's unique name, a unique match without case; else
        unknown, with at most ten ids that contain the text. The matches, not the model, are collected.
        """
        ident = (ident or "").strip()
        low, t = ident.lower(), self.targets
        name = F.coalesce("name", F.lit(""))
        rank = (
            F.when(F.col("id") == ident, 1).when(F.col("container_id") == ident, 2).when(name == ident, 3)
            .when((F.lower("id") == low) | (F.lower(name) == low), 4)
            .when(F.lower("id").contains(low) | F.lower(name).contains(low), 5)
        )
        hits = t.select("id", rank.alias("rank")).where("rank IS NOT NULL")
        best = hits.agg(F.min("rank").alias("rank"), F.count_if(F.col("rank") == 3).alias("named"), F.count_if(F.col("rank") == 4).alias("folded")).first()
        if not ident or best["rank"] is None:
            return "unknown", [], []
        if best["rank"] <= 2 or best["rank"] == 3 and best["named"] == 1 or best["rank"] == 4 and best["folded"] == 1:
            ids = [r["id"] for r in hits.where(F.col("rank") == best["rank"]).orderBy("id").collect()]
            return "container" if best["rank"] == 2 else "target", ids, []
        return "unknown", [], [r["id"] for r in hits.orderBy("id").limit(10).collect()]

    def _answer(self, primitive: str, params: dict, rows: DataFrame | None, order: list, limit: int) -> Answer:
        row = govern.coverage_l0(self.targets, self.coverage).first()
        if rows is None:
            return Answer(primitive, params, None, coverage=row["coverage"], advisory=row["advisory"], model_hash=self.hash)
        total = rows.count()
        return Answer(primitive, params, rows.orderBy(*order).limit(limit), total, total > limit, coverage=row["coverage"], advisory=row["advisory"], model_hash=self.hash)

    def _seeds(self, primitive: str, params: dict, ident: str) -> tuple[DataFrame | None, Answer | None]:
        # A container's members stay where they are; only a single target's id comes to the driver.
        if ident and not self.targets.where(F.col("id") == ident.strip()).isEmpty():
            return self.targets.where(F.col("id") == ident.strip()).select("id").distinct(), None
        members = self.targets.where(F.col("container_id") == (ident or "").strip()).select("id").distinct()
        if ident and not members.isEmpty():
            return members, None
        _, ids, candidates = self.resolve(ident)
        if ids:
            return self.edges.sparkSession.createDataFrame([(i,) for i in ids], "id string"), None
        answer = self._answer(primitive, params, None, [], 0)
        answer.error, answer.candidates = "unknown_element", candidates
        return None, answer

    def _related(self, primitive: str, ident: str, transitive: bool, limit: int, near: str, far: str) -> Answer:
        params = {"id": ident, "transitive": transitive, "limit": limit}
        seeds, failed = self._seeds(primitive, params, ident)
        if failed:
            return failed
        if transitive:
            # Of several seeds the nearest tells the path, of equally near ones the first in order.
            nearest = F.min(F.struct("depth", "path")).alias("x")
            found = graph.reach(self.edges, seeds, near, far, paths=True).groupBy("node").agg(nearest).select("node", "x.depth", "x.path").join(seeds.withColumnRenamed("id", "node"), "node", "left_anti")
            return self._answer(primitive, params, found, ["depth", "node"], limit)
        own = seeds.withColumnRenamed("id", "_s")
        direct = self.edges.join(own, F.col(near) == F.col("_s"), "left_semi").join(own, F.col(far) == F.col("_s"), "left_anti")
        return self._answer(primitive, params, direct.groupBy(F.col(far).alias("node")).agg(F.sum("weight").alias("weight")), [F.desc("weight"), "node"], limit)

    def dependents(self, ident: str, transitive: bool = False, limit: int = LIMIT) -> Answer:
        return self._related("dependents", ident, transitive, limit, "target", "source")

    def dependencies(self, ident: str, transitive: bool = False, limit: int = LIMIT) -> Answer:
        return self._related("dependencies", ident, transitive, limit, "source", "target")

    def blast_radius(self, ident: str, limit: int = LIMIT) -> Answer:
        params = {"id": ident, "limit": limit}
        seeds, failed = self._seeds("blast_radius", params, ident)
        if failed:
            return failed
        both = graph.reach(self.edges, seeds, "target", "source").withColumn("direction", F.lit("dependents")).unionByName(graph.reach(self.edges, seeds).withColumn("direction", F.lit("dependencies")))
        found = both.groupBy("direction", "node").agg(F.min("depth").alias("depth")).join(seeds.withColumnRenamed("id", "node"), "node", "left_anti")
        return self._answer("blast_radius", params, found.join(self.targets.select(F.col("id").alias("node"), "container_id"), "node", "left"), ["direction", "depth", "node"], limit)

    def paths_between(self, ident: str, to: str, most: int = MOST_PATHS) -> Answer:
        """Shortest paths between any two seeds of both ends, the shortest overall; one more than shown is sought."""
        params = {"id": ident, "to": to, "max_paths": most}
        seeds, failed = self._seeds("paths_between", params, ident)
        ends, failed_end = self._seeds("paths_between", params, to) if not failed else (None, None)
        if failed or failed_end:
            return failed or failed_end
        spark, super_ = self.edges.sparkSession, "\u0001"
        overlap = seeds.join(ends, "id", "left_semi")
        if not overlap.isEmpty():
            return self._answer("paths_between", params, overlap.select(F.col("id").alias("path"), F.lit(0).alias("hops")), ["path"], most)
        steps = self.edges.select("source", "target").union(seeds.select(F.lit(super_ + "s"), "id")).union(ends.select("id", F.lit(super_ + "e")))
        found = graph.shortest_paths(steps, super_ + "s", super_ + "e", most + 1)
        clean = found.select(F.regexp_replace(F.regexp_replace("path", f"^{super_}s > ", ""), f" > {super_}e$", "").alias("path"), (F.col("hops") - 2).alias("hops"))
        rows = [tuple(r) for r in clean.collect()]
        return self._answer("paths_between", params, spark.createDataFrame(rows, "path string, hops int"), ["path"], most)

    def cycles_of(self, ident: str) -> Answer:
        params = {"id": ident}
        seeds, failed = self._seeds("cycles_of", params, ident)
        if failed:
            return failed
        found = graph.cycles(self.edges).withColumn("altitude", F.lit("target"))
        lifted = lift.container_edges(self.edges, self.targets)
        upper = graph.strong_components(lifted, "source_container", "target_container").withColumn("altitude", F.lit("container"))
        own = seeds.join(self.targets, "id").select(F.explode(F.array("id", "container_id")).alias("node")).distinct()
        every = found.unionByName(upper)
        hit = every.join(own, "node", "left_semi").select("altitude", "component").distinct()
        return self._answer("cycles_of", params, every.join(hit, ["altitude", "component"]).select("altitude", "component", "node"), ["altitude", "component", "node"], 10**6)

    def conformance_of(self, ident: str, to: str) -> Answer:
        params = {"id": ident, "to": to}
        seeds, failed = self._seeds("conformance_of", params, ident)
        ends, failed_end = self._seeds("conformance_of", params, to) if not failed else (None, None)
        if failed or failed_end:
            return failed or failed_end
        hits = self.edges.join(seeds.select(F.col("id").alias("source")), "source", "left_semi").join(ends.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", "weight")
        named = self.targets.select("id", F.explode(F.array("id", "container_id")).alias("token"))
        if self.rules is None:
            ruled = hits.withColumn("rule", F.lit(None).cast("string"))
        else:
            a = named.select(F.col("id").alias("source"), F.col("token").alias("from"))
            b = named.select(F.col("id").alias("target"), F.col("token").alias("to"))
            forbidden = hits.join(a, "source").join(b, "target").join(self.rules, ["from", "to"]).groupBy("source", "target").agg(F.min("rule").alias("rule"))
            ruled = hits.join(forbidden, ["source", "target"], "left")
        return self._answer("conformance_of", params, ruled, ["source", "target"], 10**6)

    def explain_of(self, ident: str, to: str | None = None) -> Answer:
        """An edge's evidence, or a target's edges out and in; a loop appears only as out."""
        params = {"id": ident, "to": to}
        if to is not None:
            return self._answer("explain_of", params, self.edges.where((F.col("source") == ident) & (F.col("target") == to)).select("source", "target", F.explode("evidence").alias("e")).select("source", "target", "e.*"), ["type", "detail"], 10**6)
        out = self.edges.where(F.col("source") == ident).select(F.lit("out").alias("side"), F.col("target").alias("other"), "weight", "evidence_strength")
        into = self.edges.where((F.col("target") == ident) & (F.col("source") != ident)).select(F.lit("in").alias("side"), F.col("source").alias("other"), "weight", "evidence_strength")
        return self._answer("explain_of", params, out.unionByName(into), ["side", "other"], 10**6)

    def dispatch(self, primitive: str, ident: str | None = None, to: str | None = None, transitive: bool = False, limit: int = LIMIT) -> Answer:
        """One primitive by name; unknown names and missing arguments are errors."""
        if primitive not in ("dependents", "dependencies", "blast_radius", "paths_between", "cycles_of", "conformance_of", "explain_of"):
            raise ValueError(f"unknown primitive {primitive}")
        if not ident or primitive in ("paths_between", "conformance_of") and not to:
            raise ValueError(f"{primitive} needs more arguments")
        if primitive in ("dependents", "dependencies"):
            return getattr(self, primitive)(ident, transitive, limit)
        if primitive == "blast_radius":
            return self.blast_radius(ident, limit)
        return getattr(self, primitive)(ident) if primitive == "cycles_of" else getattr(self, primitive)(ident, to)

    def mentioned(self, question: str) -> list[str]:
        """Known names in a question, longest first, each stretch of text claimed once."""
        names = self.targets.select(F.explode(F.array("id", "name", "container_id")).alias("n")).where("n <> ''").distinct()
        # Names inside the question: there are no more than it has stretches of text.
        found = names.where(F.lit(question.lower()).contains(F.lower("n"))).orderBy(F.desc(F.length("n")), "n").collect()
        text, out = question, []
        for row in found:
            for m in re.finditer(rf"(?<![^\W_]){re.escape(row['n'])}(?![^\W_])", text, re.I):
                out.append((m.start(), row["n"]))
                text = text[: m.start()] + "\0" * len(m[0]) + text[m.end() :]
        return list(dict.fromkeys(n for _, n in sorted(out)))

    def ask(self, question: str) -> Answer:
        """A question routed by its keywords to a primitive over the names in it."""
        primitive, names = question_route(question), self.mentioned(question)
        if primitive is None or not names:
            return Answer("ask", {"q": question}, None, error="not_understood", candidates=names)
        if primitive in ("paths_between", "conformance_of") and len(names) < 2:
            return Answer("ask", {"q": question}, None, error="needs_two_elements", candidates=names)
        return self.dispatch(primitive, names[0], names[1] if len(names) > 1 else None, transitive=bool(re.search(r"transitiv|indirect|all", question, re.I)))


def cited(edges: DataFrame) -> DataFrame:
    """Edges as an answer cites them: ends, weight, confidence, and the types of their evidence."""
    return edges.select("source", "target", "weight", "confidence", "evidence_strength", F.size("evidence").cast("long").alias("n_items"))


def ids_in(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``id``: the targets that any text column of an answer names, lists of texts included."""
    texts = [F.array(F.col(f"`{name}`")) if kind == "string" else F.col(f"`{name}`") for name, kind in rows.dtypes if kind in ("string", "array<string>")]
    named = [rows.select(F.explode(column).alias("id")) for column in texts]
    if not named:
        return targets.select("id").limit(0)
    every = named[0]
    for more in named[1:]:
        every = every.union(more)
    return targets.select("id").join(every.distinct(), "id", "left_semi")
