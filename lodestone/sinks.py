"""Sinks: canonical JSON, graph text, diagram source, traces and review tables."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions.texts import canonical_json, unique_names
from lodestone.sources import rsf


def write_lines(lines: DataFrame, path: str) -> None:
    """Sorted text lines; range-partitioned, so that the parts in order are the whole in order."""
    lines.orderBy("line").write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, targets: DataFrame, path: str, include_external: bool = False) -> None:
    """``depend`` and ``contain`` lines, and a record of what they hold."""
    write_lines(rsf.depend_lines(edges, targets, include_external), f"{path}/graph")
    write_lines(rsf.contain_lines(targets, include_external), f"{path}/clusters")
    counts = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("source") == F.col("target")).alias("loops"))
    counts.join(F.broadcast(targets.agg(F.count("*").alias("targets"), F.count_if("external").alias("external")))).write.mode("overwrite").json(f"{path}/provenance")


def write_facts(targets: DataFrame, edges: DataFrame, path: str) -> None:
    """The model as JSON lines in the order of its keys."""
    targets.orderBy("id").write.mode("overwrite").json(f"{path}/targets")
    edges.orderBy("source", "target").write.mode("overwrite").json(f"{path}/edges")


def write_answer(rows: DataFrame, primitive: str, params: dict, model_hash: str, root: str) -> str:
    """An answer under the hash of its primitive, parameters and model; returns its folder."""
    key = hashlib.sha256(canonical_json({"primitive": primitive, "params": params, "model": model_hash}).encode()).hexdigest()
    rows.write.mode("overwrite").json(f"{root}/{primitive}-{key[:16]}")
    return f"{root}/{primitive}-{key[:16]}"


def record(spark: SparkSession, path: str, event: str, at: str, **fields) -> None:
    """Append one event to a trace."""
    line = json.dumps({"ts": at, "event": event, **fields}, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").write.mode("append").text(path)


def read_trace(spark: SparkSession, path: str, schema: str = "ts string, event string") -> DataFrame:
    """Events of a trace; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_review(names: DataFrame, path: str) -> None:
    """Proposed names as tab-separated text with a header."""
    names.orderBy("id").write.mode("overwrite").option("header", "true").option("sep", "\t").csv(path)


def diagram(containers: DataFrame, edges: DataFrame, most: int = 500) -> str:
    """Diagram source of a container view: elements in order of their ids, then relationships.

    A view is small by its budget; one over ``most`` containers is refused, never cut.
    """
    rows = containers.orderBy("container_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a view of more than {most} containers")
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    names = {r["id"]: r["name"] for r in unique_names(containers, "container_id").collect()}
    lines = [f"{names[r['container_id']]} = container {quote(r['container_id'].removeprefix('container:'))} {{ tags {quote('external' if r['boundary'] else 'internal')} }}" for r in rows]
    # Between so few containers there are no more than their square.
    inner = edges.where(F.col("source_container").isin(list(names)) & F.col("target_container").isin(list(names)))
    for e in inner.orderBy("source_container", "target_container").collect():
        lines.append(f"{names[e['source_container']]} -> {names[e['target_container']]} {quote('declared' if e['is_declared'] else 'uses')} {{ tags {quote('weight:' + str(e['weight']))} }}")
    return "\n".join(lines) + "\n"


def by_environment(nodes: DataFrame) -> DataFrame:
    """Deployment nodes grouped by environment; one without any is in ``default``."""
    return nodes.groupBy(F.coalesce("env", F.lit("default")).alias("env")).agg(F.array_sort(F.collect_set("id")).alias("nodes"))


def intent_warnings(intents: list[dict], budget: int, n_containers: int) -> list[str]:
    """What is odd about requested views, in their order."""
    out = []
    keys = {i.get("key") for i in intents}
    for k, intent in enumerate(intents):
        name = intent.get("key") or f"#{k}"
        if not intent.get("key"):
            out.append(f"{name}: no key")
        if intent.get("type") not in ("container", "component", "deployment", "filtered", "dynamic"):
            out.append(f"{name}: unknown type")
        if intent.get("type") == "filtered" and intent.get("base") not in keys:
            out.append(f"{name}: undefined base")
        if not intent.get("include"):
            out.append(f"{name}: nothing included")
    if n_containers > budget:
        out.append(f"{n_containers} containers over the budget of {budget}")
    return out


def view_name(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "-", text).strip("-").lower()


def proposal_text(proposal: DataFrame, most: int = 100_000) -> str:
    """A grouping proposal (``signal, name, id``) as a draft of mapping rules; one over ``most`` rows is refused."""
    rows = proposal.orderBy("signal", "name", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a proposal of more than {most} rows")
    groups: dict[tuple[str, str], list[str]] = {}
    for r in rows:
        groups.setdefault((r["signal"], r["name"]), []).append(r["id"])
    body = {"version": 1, "group": [{"container": name, "members": ids, "provenance": signal} for (signal, name), ids in groups.items()]}
    return "# A draft: check before use.\n" + yaml.safe_dump(body, sort_keys=True, allow_unicode=True, default_flow_style=False)


def view_text(intents: list[dict], system: str = "system") -> str:
    """Diagram source of requested views in their order; those of unknown type are left out."""
    quote = lambda value: json.dumps(str(value), ensure_ascii=False)
    listed = lambda value: [value] if isinstance(value, str) else list(value or [])
    lines = ["// Made from view intents."]
    for intent in intents:
        kind, key = intent.get("type"), quote(intent.get("key", ""))
        if kind == "filtered":
            mode = "exclude" if intent.get("mode") == "exclude" else "include"
            lines.append(f"filtered {quote(intent.get('base', ''))} {mode} {quote(','.join(listed(intent.get(mode))))} {key}")
        elif kind in ("systemContext", "container", "component", "deployment", "dynamic"):
            scope = [quote(intent["environment"])] if kind == "deployment" and "environment" in intent else []
            lines.append(" ".join([kind, str(intent.get("scope", system)), *scope, key, "{"]))
            lines += [f"  {word} {item}" for word in ("include", "exclude") for item in listed(intent.get(word))]
            lines += ["  autoLayout", "}"]
    return "\n".join(lines) + "\n"


@dataclass
class RunReport:
    """Seconds of the stages and steps of a run, with notes; events go to a sink, whose failures don't count."""

    stages: dict[str, float] = field(default_factory=dict)
    steps: dict[str, dict[str, float]] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    sink: Callable[[dict], None] | None = None

    def _tell(self, **event) -> None:
        try:
            if self.sink is not None:
                self.sink(event)
        except Exception as error:  # noqa: BLE001 (an observer never breaks a run)
            self.notes.append(f"sink: {error}")

    @contextmanager
    def stage(self, name: str, step: str | None = None):
        self._tell(event="start", stage=name, step=step)
        began = time.monotonic()
        try:
            yield
        finally:
            seconds = round(time.monotonic() - began, 3)
            where = self.stages if step is None else self.steps.setdefault(name, {})
            where[name if step is None else step] = seconds
            self._tell(event="finish", stage=name, step=step, seconds=seconds)

    def text(self) -> str:
        return canonical_json({"stages": self.stages, "steps": self.steps, "notes": self.notes})
