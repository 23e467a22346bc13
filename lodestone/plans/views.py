"""The dependency-graph model as views over the star-schema tables, in Spark and in SQL.

Nations are targets and regions containers. An edge leads from a customer's nation to a supplier's;
of each nation the two partners with the highest affinity stay. Flags and status of the line items
give the evidence type, order priorities the detail, order years the fragment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions.evidence import KINDS
from lodestone.operators import merge
from lodestone.session import materialise
from lodestone.sources.tables import table

_TYPE = "CASE WHEN rf = 'A' AND ls = 'F' THEN 0 WHEN rf = 'R' AND ls = 'F' THEN 1 WHEN rf = 'A' THEN 2 WHEN ls = 'F' THEN 4 WHEN rf = 'N' THEN 3 ELSE 5 END"
#: The same, but only some nations call across languages, so that others have build files and code alone as evidence.
TYPE_FEW_SEAMS = f"CASE WHEN rf = 'R' AND ls = 'O' AND s % 5 <> 1 THEN 4 ELSE {_TYPE} END"
#: The same, but only the nations of one region are called across languages.
TYPE_ONE_SIDE = f"CASE WHEN rf = 'R' AND ls = 'O' AND t % 5 <> 2 THEN 4 ELSE {_TYPE} END"


class Facts:
    """Views of the orders of some years. ``types`` gives the evidence type of line items, in SQL."""

    def __init__(self, spark: SparkSession, sf_dir: str, first: int = 1900, last: int = 2100, types: str = _TYPE):
        self.spark, self.sf_dir, self.first, self.last, self.types = spark, sf_dir, first, last, types
        self._built: dict[str, DataFrame] = {}

    def years(self, first: int, last: int) -> Facts:
        """The model of fewer years, from the same counts."""
        out = Facts(self.spark, self.sf_dir, first, last, self.types)
        out._built["counts"] = self.counts
        return out

    def read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    @property
    def counts(self) -> DataFrame:
        """Line counts by nations, flags, priority and year: the one pass over the line items.

        Its size depends on these keys alone, not on the data, so it is written once and read after.
        """

        def build() -> DataFrame:
            orders = self.read("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("detail"), F.year("o_orderdate").alias("year"))
            lines = self.read("lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"))
            customers = self.read("customer").select("c_custkey", F.col("c_nationkey").alias("s"))
            suppliers = self.read("supplier").select("s_suppkey", F.col("s_nationkey").alias("t"))
            placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
            joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            return materialise(joined.groupBy("s", "t", "rf", "ls", "detail", "year").agg(F.count("*").alias("n")), "counts")

        return self._once("counts", build)

    @property
    def cube(self) -> DataFrame:
        return self.counts.where(F.col("year").between(self.first, self.last))

    @property
    def top(self) -> DataFrame:
        def build() -> DataFrame:
            pairs = self.cube.groupBy("s", "t").agg(F.sum("n").alias("n"))
            total = pairs.groupBy("t").agg(F.sum("n").alias("total"))
            ranked = pairs.where("s <> t").join(total, "t").selectExpr("s", "t", "row_number() OVER (PARTITION BY s ORDER BY (n * 1000000) div total DESC, t) AS r")
            return ranked.where("r <= 2").select("s", "t")

        return self._once("top", build)

    @property
    def items(self) -> DataFrame:
        """Evidence items of each fragment, from all line items of an edge."""

        def build() -> DataFrame:
            kept = self.cube.join(self.top, ["s", "t"]).withColumn("ti", F.expr(self.types))
            by = kept.groupBy("s", "t", "ti", "detail", "year").agg(F.sum("n").alias("n"))
            return by.select(
                F.concat(F.lit("cxx:lib:NATION_"), "s").alias("source"),
                F.concat(F.lit("cxx:lib:NATION_"), "t").alias("target"),
                F.get(F.array(*map(F.lit, KINDS)), F.col("ti")).alias("type"),
                "detail",
                F.expr("CASE ti WHEN 3 THEN n WHEN 4 THEN n % 3 END").alias("count"),
                F.expr("CASE WHEN (s + ti) % 5 = 0 AND year % 2 = 1 THEN NULL WHEN (s + t + ti + year) % 3 = 0 THEN 'private' WHEN (s + t + ti + year) % 3 = 1 THEN 'interface' ELSE 'public' END").alias("visibility"),
                F.col("year").alias("fragment"),
            )

        return self._once("items", build)

    @property
    def merged(self) -> DataFrame:
        return self._once("merged", lambda: merge.merge_evidence(self.items))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: merge.edges_of(self.merged))

    @property
    def targets(self) -> DataFrame:
        region = F.regexp_replace(F.lower("r_name"), " ", "-")
        k = F.col("n_nationkey")
        tags = F.array(F.concat(F.lit("module-category:"), (k % 6).cast("string")), F.concat(F.lit("slnfolder:"), region))
        return self.read("nation").join(F.broadcast(self.read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.concat(F.lit("cxx:lib:"), "n_name").alias("id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("src/"), region, F.lit("/"), F.lower("n_name")).alias("path"),
            (k % 11 == 10).alias("external"),
            F.when(k % 9 == 4, F.array_append(tags, F.lit("needs-curation"))).otherwise(tags).alias("tags"),
            F.concat(F.lit("container:"), region).alias("container_id"),
            (k % 3 == 1).alias("documented"),
            k.alias("key"),
        )

    @property
    def coverage(self) -> DataFrame:
        """Coverage of each target and layer; a share is of the filled among a nation's orders."""
        orders = self.read("orders").join(self.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        filled = orders.groupBy(F.col("c_nationkey").alias("key")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
        layers = F.explode(F.array(*(F.lit(x) for x in ("L0", "L1", "L2", "L3", "interop"))))
        rows = self.read("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).join(filled, "key", "left").withColumn("layer", layers)
        value = F.expr("CASE WHEN layer = 'L0' AND key % 5 = 0 THEN 'false' WHEN layer = 'L0' AND key % 7 = 3 THEN 'partial' WHEN key % 6 = 1 THEN concat(coalesce(f, 0), '/', coalesce(n, 0)) WHEN layer = 'L3' AND key % 4 = 2 THEN 'false' ELSE 'true' END")
        return rows.select(F.concat(F.lit("cxx:lib:"), "name").alias("id"), "layer", value.alias("value"))

    @property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(LAYERING, "rule string, from string, to string")


LAYERING = [
    ("r1", "container:africa", "container:asia"),
    ("r2", "container:europe", "cxx:lib:NATION_3"),
    ("r3", "container:america", "container:africa"),
    ("r4", "cxx:lib:NATION_1", "cxx:lib:NATION_2"),
    ("r5", "container:asia", "container:middle-east"),
    ("r6", "cxx:lib:NATION_7", "cxx:lib:NATION_8"),
]


def facts_sql(p: str = "", first: int = 1900, last: int = 2100, types: str = _TYPE) -> str:
    """The same views as common table expressions, their names prefixed with ``p``."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"""
{p}cube AS (
  SELECT c_nationkey AS s, s_nationkey AS t, l_returnflag AS rf, l_linestatus AS ls, o_orderpriority AS detail, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE year(o_orderdate) BETWEEN {first} AND {last} GROUP BY ALL),
{p}pairs AS (SELECT s, t, CAST(sum(n) AS BIGINT) AS n FROM {p}cube GROUP BY s, t),
{p}total AS (SELECT t, CAST(sum(n) AS BIGINT) AS total FROM {p}pairs GROUP BY t),
{p}top AS (
  SELECT s, t FROM (
    SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY (n * 1000000) // total DESC, t) AS r FROM {p}pairs JOIN {p}total USING (t) WHERE s <> t
  ) WHERE r <= 2),
{p}items AS (
  SELECT 'cxx:lib:NATION_' || s AS source, 'cxx:lib:NATION_' || t AS target, ([{kinds}])[ti + 1] AS type, detail,
    CASE ti WHEN 3 THEN n WHEN 4 THEN n % 3 END AS count,
    CASE WHEN (s + ti) % 5 = 0 AND year % 2 = 1 THEN NULL WHEN (s + t + ti + year) % 3 = 0 THEN 'private' WHEN (s + t + ti + year) % 3 = 1 THEN 'interface' ELSE 'public' END AS visibility,
    year AS fragment
  FROM (SELECT s, t, {types} AS ti, detail, year, CAST(sum(n) AS BIGINT) AS n FROM {p}cube JOIN {p}top USING (s, t) GROUP BY ALL)),
{p}merged AS (
  SELECT source, target, type, detail, CAST(sum(count) AS BIGINT) AS count, arg_min(visibility, fragment) FILTER (WHERE visibility IS NOT NULL) AS visibility
  FROM {p}items GROUP BY source, target, type, detail),
{p}weighed AS (
  SELECT *, CAST(CASE WHEN type IN ('link', 'project_ref') THEN 5 WHEN type = 'package_ref' THEN 1 WHEN type = 'include' THEN least(coalesce(count, 1), 10) WHEN type = 'symbol_use' THEN coalesce(count, 1) WHEN type = 'interop' THEN 5 ELSE 0 END AS BIGINT) AS w,
    CASE type WHEN 'link' THEN 'L0' WHEN 'project_ref' THEN 'L0' WHEN 'package_ref' THEN 'L1' WHEN 'include' THEN 'L2' WHEN 'symbol_use' THEN 'L3' ELSE type END AS layer
  FROM {p}merged),
{p}edges AS (
  SELECT source, target, CAST(sum(w) AS BIGINT) AS weight, bool_or(type IN ('link', 'project_ref')) AS is_declared_dependency,
    CASE WHEN count(DISTINCT type) FILTER (WHERE type IN ('link', 'project_ref', 'include', 'symbol_use')) >= 3 THEN 'high'
      WHEN bool_or(type IN ('link', 'project_ref')) AND NOT bool_or(type IN ('include', 'symbol_use')) THEN 'low'
      WHEN count(DISTINCT type) FILTER (WHERE type IN ('link', 'project_ref', 'include', 'symbol_use')) <= 1 THEN 'low' ELSE 'medium' END AS confidence,
    string_agg(DISTINCT type, ' + ' ORDER BY list_position([{kinds}], type)) AS evidence_strength,
    count(*) AS n_items, count(*) FILTER (WHERE visibility = 'private') AS n_private, list_sort(list(DISTINCT layer)) AS layers, bool_or(visibility = 'public') AS has_public
  FROM {p}weighed GROUP BY source, target),
{p}targets AS (
  SELECT 'cxx:lib:' || n_name AS id, n_name AS name, 'src/' || region || '/' || lower(n_name) AS path, n_nationkey % 11 = 10 AS external,
    CASE WHEN n_nationkey % 9 = 4 THEN ['module-category:' || (n_nationkey % 6), 'slnfolder:' || region, 'needs-curation'] ELSE ['module-category:' || (n_nationkey % 6), 'slnfolder:' || region] END AS tags,
    'container:' || region AS container_id, n_nationkey % 3 = 1 AS documented, n_nationkey AS key
  FROM nation JOIN (SELECT r_regionkey, replace(lower(r_name), ' ', '-') AS region FROM region) ON n_regionkey = r_regionkey),
{p}coverage AS (
  SELECT 'cxx:lib:' || n_name AS id, layer,
    CASE WHEN layer = 'L0' AND n_nationkey % 5 = 0 THEN 'false' WHEN layer = 'L0' AND n_nationkey % 7 = 3 THEN 'partial' WHEN n_nationkey % 6 = 1 THEN coalesce(f, 0) || '/' || coalesce(n, 0) WHEN layer = 'L3' AND n_nationkey % 4 = 2 THEN 'false' ELSE 'true' END AS value
  FROM nation CROSS JOIN (SELECT unnest(['L0', 'L1', 'L2', 'L3', 'interop']) AS layer)
  LEFT JOIN (SELECT c_nationkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey) ON c_nationkey = n_nationkey),
{p}covered AS (
  SELECT id, layer, value = 'true' OR (regexp_full_match(value, '\\d+/\\d+') AND coalesce(TRY_CAST(split_part(value, '/', 1) AS BIGINT), 0) > 0) AS ok FROM {p}coverage),
{p}lifted AS (
  SELECT e.*, a.container_id AS source_container, b.container_id AS target_container FROM {p}edges e JOIN {p}targets a ON e.source = a.id JOIN {p}targets b ON e.target = b.id),
{p}cross_edges AS (
  SELECT source_container, target_container, CAST(sum(weight) AS BIGINT) AS weight, bool_or(is_declared_dependency) AS is_declared, count(*) AS n_edges,
    arg_min(confidence, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS confidence
  FROM {p}lifted WHERE source_container <> target_container GROUP BY source_container, target_container)"""


RULES_SQL = "rules(rule, \"from\", \"to\") AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LAYERING) + ")"
