"""Graph queries over a graph that grows with the data: parts, and which part follows which in an order.

An order's line items in the order of their numbers give steps from part to part; equal steps add up.
Of each part the step taken most often (ties to the smaller part) gives the sparser ``next`` graph, in
which chains run together into cycles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.operators import graph, lift
from lodestone.operators.components import connected_components
from lodestone.session import materialise
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

STEPS_SQL = """
steps AS (
  SELECT source, target, count(*) AS weight FROM (
    SELECT l_partkey AS source, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem) WHERE target IS NOT NULL GROUP BY ALL),
next AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS r FROM steps WHERE source <> target) WHERE r = 1)"""


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = f"WITH RECURSIVE {STEPS_SQL}{sql}"
        return function

    return register


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # As many parts as the rows need, so that a task's memory does not grow with them.
    parts = lineitem.count() // 250_000 + 4
    lines = lineitem.repartition(parts, "l_orderkey").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(order).alias("target"))
    return materialise(lines.where("target IS NOT NULL").repartition(parts, "source", "target").groupBy("source", "target").agg(F.count("*").alias("weight")), "steps")


def next_of(steps: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("weight")).alias("w"), "target")).alias("x")
    return materialise(steps.where("source <> target").groupBy("source").agg(best).select("source", "x.target"), "next")


@query(" SELECT source, target, weight FROM steps")
def part_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps_of(spark, sf_dir)


@query(", ends AS (SELECT source AS a, target AS b FROM next UNION SELECT target, source FROM next), touch(a, b) AS (SELECT a, a FROM ends UNION SELECT t.a, e.b FROM touch t JOIN ends e ON t.b = e.a) SELECT a AS node, min(b) AS component FROM touch GROUP BY a")
def part_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(next_of(steps_of(spark, sf_dir)), "source", "target", local=graph.LOCAL)


_STRONG = ", touch(a, b) AS (SELECT source, target FROM next UNION SELECT t.a, e.target FROM touch t JOIN next e ON t.b = e.source), comp AS (SELECT x.a AS node, min(x.b) AS component FROM touch x JOIN touch y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1)"


@query(f"{_STRONG} SELECT node, component FROM comp")
def part_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(next_of(steps_of(spark, sf_dir)))


@query(f"{_STRONG}, loops AS (SELECT source AS node FROM steps WHERE source = target) SELECT component, count(*) AS size FROM (SELECT node, component FROM comp UNION ALL SELECT node, node FROM loops WHERE node NOT IN (SELECT node FROM comp)) GROUP BY component")
def part_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the cycles of the next graph and of the steps from a part to itself."""
    steps = steps_of(spark, sf_dir)
    edges = next_of(steps).unionByName(steps.where("source = target").select("source", "target"))
    return graph.cycles(edges).groupBy("component").agg(F.count("*").alias("size"))


_REACHED = """, walk(node, depth) AS (SELECT min(source), 0 FROM steps UNION SELECT s.target, w.depth + 1 FROM walk w JOIN steps s ON s.source = w.node WHERE w.depth < 12)
    SELECT (SELECT min(source) FROM steps) AS seed, node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node HAVING min(depth) > 0"""


@query(_REACHED)
def part_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from the first part to all others."""
    steps = steps_of(spark, sf_dir)
    return graph.reach(steps, steps.agg(F.min("source").alias("id")))


@query(""", walk(node, path, depth) AS (SELECT min(source), [min(source)], 0 FROM next UNION ALL SELECT n.target, list_append(w.path, n.target), w.depth + 1 FROM walk w JOIN next n ON n.source = w.node WHERE NOT list_contains(w.path, n.target))
    SELECT node, CAST(depth AS INTEGER) AS depth, list_aggregate(path, 'string_agg', ' > ') AS path FROM walk WHERE depth > 0""")
def part_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next parts lead from the first one, with the way there."""
    following = next_of(steps_of(spark, sf_dir))
    found = graph.reach(following, following.agg(F.min("source").alias("id")), paths=True)
    return found.select("node", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), " > ").alias("path"))


_PATHS = """, depths(node, depth) AS (SELECT min(source), 0 FROM steps UNION SELECT s.target, d.depth + 1 FROM depths d JOIN steps s ON s.source = d.node WHERE d.depth < 8),
    near AS (SELECT node, min(depth) AS depth FROM depths GROUP BY node), goal AS (SELECT max(target) AS node FROM steps),
    back(node, path, depth) AS (
      SELECT node, CAST(node AS VARCHAR), depth FROM near WHERE node = (SELECT node FROM goal)
      UNION ALL SELECT s.source, s.source || ' > ' || b.path, b.depth - 1 FROM back b JOIN steps s ON s.target = b.node JOIN near n ON n.node = s.source AND n.depth = b.depth - 1)
    SELECT path, CAST((SELECT depth FROM near WHERE node = (SELECT node FROM goal)) AS INTEGER) AS hops FROM back WHERE depth = 0 ORDER BY path LIMIT 10"""


@query(_PATHS)
def part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of the shortest paths from the first part to the last."""
    return _paths(spark, sf_dir)


def _paths(spark: SparkSession, sf_dir: str, local: int | None = None) -> DataFrame:
    steps = steps_of(spark, sf_dir).select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    ends = steps.agg(F.min(F.col("source").cast("long")).alias("first"), F.max(F.col("target").cast("long")).alias("last")).first()
    return graph.shortest_paths(steps, str(ends["first"]), str(ends["last"]), local=local)


@query(""", ends AS (SELECT source AS node, target AS outs, CAST(NULL AS BIGINT) AS ins, weight FROM steps WHERE source <> target UNION ALL SELECT target, CAST(NULL AS BIGINT), source, weight FROM steps WHERE source <> target)
    SELECT node, count(outs) AS efferent, count(ins) AS afferent, count(DISTINCT coalesce(outs, ins)) AS neighbours, CAST(sum(weight) AS BIGINT) AS weight FROM ends GROUP BY node""")
def part_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_of(spark, sf_dir)
    pairs = steps.where("source <> target").select(F.col("source").alias("source_container"), F.col("target").alias("target_container"), "weight")
    return lift.degree(pairs, rows=steps.count())


@query(""" SELECT a.p_brand AS source_container, b.p_brand AS target_container, CAST(sum(weight) AS BIGINT) AS weight, bool_or(weight > 1) AS is_declared, count(*) AS n_edges, CASE WHEN max(weight) > 1 THEN 'medium' ELSE 'low' END AS confidence
    FROM steps JOIN part a ON a.p_partkey = source JOIN part b ON b.p_partkey = target WHERE a.p_brand <> b.p_brand GROUP BY ALL""")
def part_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps lifted to brands; those taken more than once count as declared and of medium confidence."""
    often = F.col("weight") > 1
    edges = steps_of(spark, sf_dir).select("source", "target", "weight", often.alias("is_declared_dependency"), F.when(often, "medium").otherwise("low").alias("confidence"))
    targets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("container_id"))
    return lift.container_edges(edges, targets)


# The same questions with every step distributed, as for graphs that no task holds.

_TOUCHED = ", ends AS (SELECT source AS a, target AS b FROM {0} WHERE source <> target UNION SELECT target, source FROM {0} WHERE source <> target), touch(a, b) AS (SELECT a, a FROM ends UNION SELECT t.a, e.b FROM touch t JOIN ends e ON t.b = e.a) SELECT a AS node, min(b) AS component FROM touch GROUP BY a"
# The first node's component by two walks, and the pairs that reach each other among all other nodes.
_STRONG_STEPS = """, hop AS (SELECT source, target FROM steps WHERE source <> target), top AS (SELECT min(source) AS node FROM hop),
fore(node) AS (SELECT node FROM top UNION SELECT target FROM fore JOIN hop ON source = node), back(node) AS (SELECT node FROM top UNION SELECT source FROM back JOIN hop ON target = node),
core AS (SELECT node FROM fore JOIN back USING (node)), rest AS (SELECT source, target FROM hop WHERE source NOT IN (SELECT node FROM core) AND target NOT IN (SELECT node FROM core)),
touch(a, b) AS (SELECT source, target FROM rest UNION SELECT t.a, e.target FROM touch t JOIN rest e ON t.b = e.source),
comp AS (SELECT x.a AS node, min(x.b) AS component FROM touch x JOIN touch y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1
  UNION ALL SELECT node, (SELECT min(node) FROM core) FROM core WHERE (SELECT count(*) FROM core) > 1)"""


@query(_TOUCHED.format("next"))
def far_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the next graph."""
    return connected_components(next_of(steps_of(spark, sf_dir)), "source", "target")


@query(f"{_STRONG} SELECT node, component FROM comp")
def far_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of the next graph: long chains into small cycles."""
    return graph.strong_components(next_of(steps_of(spark, sf_dir)), local=0)


@query(f"{_STRONG_STEPS} SELECT node, component FROM comp")
def far_strong_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong components of all steps."""
    return graph.strong_components(steps_of(spark, sf_dir), local=0)


@query(f"{_STRONG_STEPS}, loops AS (SELECT source AS node FROM steps WHERE source = target) SELECT component, count(*) AS size FROM (SELECT node, component FROM comp UNION ALL SELECT node, node FROM loops WHERE node NOT IN (SELECT node FROM comp)) GROUP BY component")
def far_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all cycles of the steps."""
    return graph.cycles(steps_of(spark, sf_dir), local=0).groupBy("component").agg(F.count("*").alias("size"))


@query(_REACHED)
def far_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_of(spark, sf_dir)
    return graph.reach(steps, steps.agg(F.min("source").alias("id")), local=0)


@query(_PATHS)
def far_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir, 0)
