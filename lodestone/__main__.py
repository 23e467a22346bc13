"""Command line: ``python -m lodestone VERB FACTS ...`` over a folder of fragments or stored facts."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone import config, sinks
from lodestone.functions import texts
from lodestone.operators import curate, govern, lift, normalize, propose, query, risk
from lodestone.session import clear
from lodestone.sources import fragments


def _load(spark: SparkSession, path: str, rules: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets with containers, edges and coverage of a folder of fragments, curated by the rules if any."""
    facts = normalize.normalize(fragments.read_fragments(spark, path))
    targets = facts.targets.withColumn("documented", texts.has_text(F.col("responsibilities")))
    text = spark.read.option("wholetext", "true").text(rules).first()[0] if rules else None
    if text is None:
        return targets.withColumn("container_id", F.col("id")), facts.edges, facts.coverage
    targets, edges = curate.curate(targets, facts.edges, config.mapping_rules(text))
    return targets, edges, facts.coverage


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("verb", choices=["normalize", "query", "ask", "drift", "layering", "risk", "propose", "export", "diagram"])
    parser.add_argument("facts", help="folder of fragments (JSON)")
    parser.add_argument("words", nargs="*", help="query: PRIMITIVE ID [ID]; ask: the question; drift: the baseline's folder")
    parser.add_argument("--rules", help="mapping rules (YAML)")
    parser.add_argument("--layering", help="layering rules (YAML)")
    parser.add_argument("--out", help="folder for normalize and export")
    parser.add_argument("--transitive", action="store_true")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        return _answer(spark, args)
    finally:
        # Everything has been shown or written, so no intermediate table is needed any more.
        clear(spark)


def _answer(spark: SparkSession, args: argparse.Namespace) -> int:
    targets, edges, coverage = _load(spark, args.facts, args.rules)
    forbidden = config.layering_rules(spark, spark.read.option("wholetext", "true").text(args.layering).first()[0]) if args.layering else None
    lifted = lift.container_edges(edges, targets)
    if args.verb in ("query", "ask"):
        model = query.Model(targets, edges, coverage, forbidden)
        answer = model.ask(" ".join(args.words)) if args.verb == "ask" else model.dispatch(args.words[0], *args.words[1:3], transitive=args.transitive)
        if answer.error:
            print(f"{answer.error}: {', '.join(answer.candidates)}")
            return 2
        answer.rows.show(query.LIMIT, truncate=False)
        print(f"{answer.total} in all; L0 coverage {answer.coverage:.2f}{', advisory' if answer.advisory else ''}")
    elif args.verb == "drift":
        was, was_edges, _ = _load(spark, args.words[0], args.rules)
        govern.drift_targets(was, targets, coverage).orderBy("status", "id").show(1000, truncate=False)
        govern.drift_edges(was_edges, edges, coverage).orderBy("status", "source", "target").show(1000, truncate=False)
    elif args.verb == "layering":
        found = govern.check_layering(edges, targets, coverage, forbidden)
        found.orderBy("rule").show(1000, truncate=False)
        advisory = govern.coverage_l0(targets, coverage).first()["advisory"]
        return 3 if not advisory and not found.where("status = 'VIOLATION'").isEmpty() else 0
    elif args.verb == "risk":
        risk.hubs(lifted, lift.containers(targets)).orderBy(F.desc("severity"), "node").show(truncate=False)
        risk.interop_seams(edges, targets).show(truncate=False)
    elif args.verb == "propose":
        propose.proposal(targets, edges).orderBy("signal", "name", "id").show(1000, truncate=False)
    elif args.verb == "diagram":
        print(sinks.diagram(lift.containers(targets), lifted), end="")
    elif args.verb == "export":
        sinks.write_graph(edges, targets, args.out)
    else:
        sinks.write_facts(targets, edges, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
