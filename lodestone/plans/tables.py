"""Queries whose operators apply to the tables themselves: partitions, ranks, texts, steps, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lodestone.functions import identifiers as ids, texts
from lodestone.operators import ownership, partition, summaries
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


_TABLE = """WITH a AS (SELECT o_orderkey AS entity, o_orderpriority AS label FROM orders), b AS (SELECT o_orderkey AS entity, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS label FROM orders WHERE o_orderkey % 7 > 0),
cells AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM a JOIN b USING (entity) GROUP BY ALL)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    a = orders.select(F.col("o_orderkey").alias("entity"), F.col("o_orderpriority").alias("label"))
    b = orders.where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("entity"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("label"))
    return partition.contingency(a, b)


@query(f"{_TABLE} SELECT a, b, n FROM cells")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(
    f"""{_TABLE}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY a)) AS r,
    (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY b)) AS c, (SELECT sum(n) FROM cells) AS n)
    SELECT CAST(n AS BIGINT) AS n, round(100 * (i - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 4) AS ari FROM s"""
)
def contingency_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.adjusted_rand(_cells(spark, sf_dir))


@query(
    f"""{_TABLE}, p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM cells)
    SELECT round(2 * sum(p * ln(p / (pa * pb))) / (sum(-p * ln(pa)) + sum(-p * ln(pb))), 6) AS nmi FROM p"""
)
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.mutual_information(_cells(spark, sf_dir))


_RATED = "WITH cells AS (SELECT event_type AS a, CASE WHEN event_id % 4 = 0 THEN 'click' ELSE event_type END AS b, count(*) AS n FROM events GROUP BY ALL)"


@query(f"{_RATED}, s AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same FROM cells), c AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, sum(n) AS n FROM cells GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM cells GROUP BY b) y ON x.a = y.b) SELECT round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM s, c")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("event_id") % 4 == 0, "click").otherwise(F.col("event_type"))
    return partition.cohen_kappa(table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("a"), b.alias("b")).agg(F.count("*").alias("n")))


@query("WITH d AS (SELECT l_quantity - l_linenumber * 5 AS d FROM lineitem WHERE l_quantity <> l_linenumber * 5), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS k FROM d) SELECT round(sum(sign(d) * k) / sum(k), 6) AS effect FROM r")
def rank_biserial(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_linenumber") * 5).alias("b"))
    return partition.rank_biserial(pairs, "a", "b")


@query("WITH cells AS (SELECT p_name AS a, p_type AS b FROM part GROUP BY ALL) SELECT round(100 * count(*) FILTER (WHERE k = 1) / count(*), 4) AS nested FROM (SELECT a, count(*) AS k FROM cells GROUP BY a)")
def nested_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("label"))
    b = part.select(F.col("p_partkey").alias("entity"), F.col("p_type").alias("label"))
    return partition.nested_share(partition.contingency(a, b))


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS source, l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey),
    l AS (SELECT source % 10 AS a, target % 10 AS b FROM e), s AS (SELECT a AS c, 1 AS i FROM l WHERE a = b UNION ALL SELECT a, 0 FROM l WHERE a <> b UNION ALL SELECT b, 0 FROM l WHERE a <> b),
    g AS (SELECT c, sum(i) AS i, sum(1 - i) AS o FROM s GROUP BY c) SELECT round(sum(i / (i + 0.5 * o)), 3)::DOUBLE AS mq, CAST(sum(i) AS BIGINT) AS inner, CAST(sum(o) / 2 AS BIGINT) AS outer FROM g"""
)
def turbo_mq(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("target"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source"))
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("source <> target").select("source", "target").distinct()
    entities = edges.select(F.explode(F.array("source", "target")).alias("entity")).distinct().withColumn("label", F.col("entity") % 10)
    return partition.turbo_mq(edges, entities)


@query("WITH p AS (SELECT p_size AS x, p_retailprice AS y FROM part), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM p) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice")


@query("SELECT c_mktsegment AS segment, c_custkey AS id, rank() OVER (PARTITION BY c_mktsegment ORDER BY k DESC) + (count(*) OVER (PARTITION BY c_mktsegment, k) - 1) / 2 AS rank FROM (SELECT *, CAST(floor(c_acctbal / 500) AS BIGINT) AS k FROM customer)")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 500).alias("k"))
    return partition.average_ranks(rows, "k", ["segment"], descending=True).drop("k")


@query("SELECT round((sum(CASE WHEN a.p_size > b.p_size THEN 1 ELSE 0 END) - sum(CASE WHEN a.p_size < b.p_size THEN 1 ELSE 0 END)) / count(*), 6) AS delta FROM part a CROSS JOIN part b WHERE a.p_type = 'ECONOMY' AND b.p_type = 'SMALL'")
def cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_type", F.col("p_size").alias("value"))
    return partition.cliffs_delta(part.where("p_type = 'ECONOMY'"), part.where("p_type = 'SMALL'"))


@query("SELECT event_type AS run, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS spread, min(value) AS low, max(value) AS high, count(value) AS n FROM events GROUP BY event_type")
def rerun_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"))
    return by.agg(F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_pop("value"), 2).alias("spread"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


@query("SELECT p_brand AS system, round(median(p_retailprice), 2) AS median FROM part GROUP BY p_brand")
def median_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("system")).agg(F.round(F.median("p_retailprice"), 2).alias("median"))


@query("SELECT event_type AS category, count(*) FILTER (WHERE user_id % 3 = 0) AS t0, count(*) FILTER (WHERE user_id % 3 = 1) AS t1, count(*) FILTER (WHERE user_id % 3 = 2) AS t2 FROM events GROUP BY event_type")
def pivot_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("technique"))
    return cells.groupBy("category").pivot("technique", ["t0", "t1", "t2"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT event_type AS mode, CASE WHEN value > 50 THEN 'large' ELSE 'small' END AS operator, count(*) AS n FROM events GROUP BY GROUPING SETS ((1, 2), (1))")
def outcome_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(F.col("value") > 50, "large").otherwise("small").alias("operator"))
    return rows.groupingSets([["mode", "operator"], ["mode"]], "mode", "operator").agg(F.count("*").alias("n"))


_OWNERS = """WITH dirs AS (SELECT regexp_replace(url, '^https?://([^/?#]+).*$', '\\1') AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, page_id FROM pages),
files AS (SELECT page_id, host || rtrim(path, '/') AS path FROM dirs), owners AS (SELECT DISTINCT host AS owner FROM dirs UNION SELECT DISTINCT host || '/' || split_part(path, '/', 2) FROM dirs WHERE length(split_part(path, '/', 2)) = 2)"""


def _owner_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    host, path = F.regexp_replace("url", "^https?://([^/?#]+).*$", "$1"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    files = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_replace(path, "/+$", "").alias("p"))
    first = F.split_part("p", F.lit("/"), F.lit(2))
    owners = files.select(F.col("host").alias("owner")).union(files.where(F.length(first) == 2).select(F.concat("host", F.lit("/"), first))).distinct()
    return files.select("page_id", F.concat("host", "p").alias("path")), owners


@query(f"{_OWNERS} SELECT page_id, owner FROM (SELECT page_id, owner, row_number() OVER (PARTITION BY page_id ORDER BY length(owner) DESC) AS r FROM files JOIN owners ON path = owner OR starts_with(path, owner || '/')) WHERE r = 1")
def prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, owners = _owner_tables(spark, sf_dir)
    return ownership.longest_prefix(files, owners).select("page_id", "owner")


@query(f"{_OWNERS} SELECT owner, count(*) AS files, CAST(sum(n) AS BIGINT) AS size FROM (SELECT files.page_id, owner, row_number() OVER (PARTITION BY files.page_id ORDER BY length(owner) DESC) AS r, length(html) AS n FROM files JOIN owners ON path = owner OR starts_with(path, owner || '/') JOIN pages USING (page_id)) WHERE r = 1 GROUP BY owner")
def measure_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, owners = _owner_tables(spark, sf_dir)
    sizes = table(spark, sf_dir, "pages").select("page_id", F.length("html").cast("long").alias("n"))
    return ownership.longest_prefix(files, owners).join(sizes, "page_id").groupBy("owner").agg(F.count("*").alias("files"), F.sum("n").alias("size"))


@query("SELECT link, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages) GROUP BY link HAVING count(DISTINCT page_id) > 1")
def hyperlink_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("link")).distinct()
    return links.groupBy("link").agg(F.count("*").alias("pages")).where("pages > 1")


@query(
    """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), w AS (SELECT * FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 9 DAYS)
    SELECT event_type AS container, count(*) AS commits, count(DISTINCT user_id) AS authors, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_touch FROM w GROUP BY event_type"""
)
def churn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    anchor = events.agg(F.max("ts").alias("head"))
    recent = events.join(F.broadcast(anchor), F.col("ts") >= F.col("head") - F.expr("INTERVAL 9 DAYS"))
    return recent.groupBy(F.col("event_type").alias("container")).agg(F.count("*").alias("commits"), F.count_distinct("user_id").alias("authors"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_touch"))


@query("SELECT event_type AS kind, json_extract_string(props, '$.k')[1:1] AS first_digit, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.left(k, F.lit(1)).alias("first_digit")).agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, role AS "from", next AS "to", CAST(count(*) AS BIGINT) AS steps, min(turn) AS first_turn,
    CASE WHEN role = 'user' AND next = 'assistant' THEN 'ok' WHEN next = 'system' OR role = 'system' THEN 'unresolved' ELSE 'unevidenced' END AS status
    FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL GROUP BY ALL"""
)
def scenario_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    steps = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("from"), F.lead("role").over(order).alias("to")).where("to IS NOT NULL")
    status = F.when((F.col("from") == "user") & (F.col("to") == "assistant"), "ok").when((F.col("to") == "system") | (F.col("from") == "system"), "unresolved").otherwise("unevidenced")
    return steps.groupBy("conv_id", "from", "to").agg(F.count("*").alias("steps"), F.min("turn").alias("first_turn")).withColumn("status", status)


@query("SELECT conv_id, CAST(count(*) - 1 AS BIGINT) AS steps FROM conversations GROUP BY conv_id HAVING count(*) - 1 BETWEEN 2 AND 9")
def scenario_quality_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") - 1).alias("steps")).where("steps BETWEEN 2 AND 9")


@query("SELECT p_type AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(max(p_name)), '[^0-9a-z]+'), lambda t: length(t) > 1 AND NOT regexp_full_match(t, '\\d+'))))::VARCHAR AS tokens FROM part GROUP BY p_type")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("id")).agg(F.max("p_name").alias("name"))
    return last.select("id", F.concat(F.lit("["), F.array_join(F.array_sort(ids.path_tokens(F.col("name"))), ", "), F.lit("]")).alias("tokens"))


@query("SELECT n_name AS name, regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g') AS slug, CASE WHEN contains(n_name, ' ') THEN 'spaced' WHEN contains(n_name, '_') THEN 'snake' ELSE 'other' END AS style FROM nation UNION ALL SELECT r_name, regexp_replace(lower(r_name), '[^0-9a-z]', '', 'g'), CASE WHEN contains(r_name, ' ') THEN 'spaced' ELSE 'other' END FROM region")
def naming_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name"))
    return names.select("name", ids.norm_slug(F.col("name")).alias("slug"), ids.convention(F.col("name")).alias("style"))


@query("SELECT doc_id, contains(lower(text), 'license') AS license, contains(lower(text), 'token') AS token FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def forbidden_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", low.contains("license").alias("license"), low.contains("token").alias("token"))
    return rows.where("license OR token")


@query("SELECT doc_id, md5(replace(regexp_replace(text, '[0-9]{3,}', '[redacted]', 'g'), 'token', '[redacted]')) AS digest FROM documents")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.redact(F.col("text"), ["[0-9]{3,}"], ["token"])).alias("digest"))


@query("SELECT p_brand AS package, CASE WHEN contains(p_brand, '#1') THEN 'first' WHEN contains(p_brand, '#2') THEN 'second' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY ALL")
def package_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = summaries.package_family(F.col("p_brand"), [("#1", "first"), ("#2", "second")], "other")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("package"), family.alias("family")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_totalprice < 1000 THEN '<1000' WHEN o_totalprice < 100000 THEN '1000-100000' WHEN o_totalprice < 300000 THEN '100000-300000' ELSE '>=300000' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def numeric_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = summaries.bucket(F.col("o_totalprice"), [1000, 100000, 300000])
    return table(spark, sf_dir, "orders").groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{_TABLE}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY a)) AS r, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY b)) AS c, (SELECT sum(n) FROM cells) AS n) SELECT round((n * (n - 1) / 2 + 2 * i - r - c) / (n * (n - 1) / 2), 6)::DOUBLE AS rand FROM s")
def rand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.rand_index(_cells(spark, sf_dir))


@query(
    """WITH a AS (SELECT c_custkey || CASE WHEN c_custkey % 9 = 0 THEN ' x' ELSE '' END AS entity, c_mktsegment AS label FROM customer WHERE c_custkey % 4 > 0), b AS (SELECT c_custkey || CASE WHEN c_custkey % 9 = 0 THEN ' x' ELSE '' END AS entity, CASE WHEN c_custkey % 5 = 0 THEN 'Z' ELSE c_mktsegment END AS label FROM customer WHERE c_custkey % 3 > 0),
    cells AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM a JOIN b USING (entity) WHERE NOT contains(entity, ' ') GROUP BY ALL),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY a)) AS r, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM cells GROUP BY b)) AS c, (SELECT sum(n) FROM cells) AS n)
    SELECT CAST(n AS BIGINT) AS n, round(100 * (i - r * c / (n * (n - 1) / 2)) / ((r + c) / 2 - r * c / (n * (n - 1) / 2)), 4) AS ari,
      (SELECT count(*) FROM a WHERE NOT contains(entity, ' ') AND entity NOT IN (SELECT entity FROM b)) AS only_clustering, (SELECT count(*) FROM b WHERE NOT contains(entity, ' ') AND entity NOT IN (SELECT entity FROM a)) AS only_reference,
      (SELECT count(DISTINCT entity) FROM (SELECT entity FROM a UNION ALL SELECT entity FROM b) WHERE contains(entity, ' ')) AS blank FROM s"""
)
def scored_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 9 == 0, " x").otherwise("")).alias("entity")
    rows = table(spark, sf_dir, "customer").select("c_custkey", key, F.col("c_mktsegment").alias("label"))
    return partition.scored(rows.where("c_custkey % 4 > 0"), rows.where("c_custkey % 3 > 0").withColumn("label", F.when(F.col("c_custkey") % 5 == 0, "Z").otherwise(F.col("label"))))


@query(
    """WITH e AS (SELECT DISTINCT o_custkey AS source, l_suppkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <> l_suppkey), n AS (SELECT source AS entity FROM e UNION SELECT target FROM e), z AS (SELECT entity % 10 AS label, count(*) AS n FROM n GROUP BY 1),
    l AS (SELECT source % 10 AS a, target % 10 AS b FROM e), s AS (SELECT a AS c, 1 AS i FROM l WHERE a = b UNION ALL SELECT a, 0 FROM l WHERE a <> b UNION ALL SELECT b, 0 FROM l WHERE a <> b), g AS (SELECT c, sum(i) AS i, sum(1 - i) AS o FROM s GROUP BY c)
    SELECT CAST((SELECT sum(n) FROM z) AS BIGINT) AS units, (SELECT count(*) FROM z) AS clusters, round((SELECT sum(n) / count(*) FROM z), 3) AS ratio, round((SELECT max(n) / sum(n) FROM z), 4) AS largest, round(sum(i / (i + 0.5 * o)), 3)::DOUBLE AS mq FROM g"""
)
def partition_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("target"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source"))
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("source <> target").select("source", "target").distinct()
    entities = edges.select(F.explode(F.array("source", "target")).alias("entity")).distinct().withColumn("label", F.col("entity") % 10)
    return partition.diagnosis(edges, entities)


@query(
    """WITH s AS (SELECT p_type AS system, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS technique, avg(p_retailprice) AS value FROM part GROUP BY ALL), whole AS (SELECT system FROM s GROUP BY system HAVING count(*) = 3),
    r AS (SELECT technique, rank() OVER (PARTITION BY system ORDER BY value DESC) + (count(*) OVER (PARTITION BY system, value) - 1) / 2 AS k FROM s WHERE system IN (SELECT system FROM whole)), m AS (SELECT technique, round(avg(k), 3) AS rank FROM r GROUP BY technique), cd AS (SELECT round(2.343 * sqrt(12 / (6 * count(*))), 3) AS d FROM whole)
    SELECT m.technique, round(m.rank - o.rank, 3) AS rank_diff, abs(round(m.rank - o.rank, 3)) > d AS significant FROM m, m o, cd WHERE o.technique = 'a' AND m.technique <> 'a'"""
)
def rank_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    technique = F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "b").otherwise("c")
    scores = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("system"), technique.alias("technique")).agg(F.avg("p_retailprice").alias("value"))
    ranks, difference, _ = partition.critical_difference(scores)
    return partition.rank_verdicts(ranks, difference, "a")


@query(
    """WITH h AS (SELECT s_suppkey AS human, regexp_replace(lower(s_name), '[^0-9a-z]', '', 'g') AS slug FROM supplier), t AS (SELECT c_custkey AS target, 'supplier' || regexp_replace(lower(c_name), '[^0-9]', '', 'g') AS slug FROM customer)
    SELECT human, min(target) AS target, CAST(1.0 AS DOUBLE) AS score FROM h JOIN t USING (slug) GROUP BY human"""
)
def reconcile_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    humans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("human"), ids.norm_slug(F.col("s_name")).alias("slug"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.concat(F.lit("supplier"), F.regexp_replace(F.lower("c_name"), "[^0-9]", "")).alias("slug"))
    return ownership.best_bindings(humans, targets)


@query()
def propose_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best nation of each region by slug, tokens or ratio of names; SQL has no such ratio."""

    def named(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.col(name).alias(key), F.array(ids.norm_slug(F.col(name))).alias("slugs"), ids.path_tokens(F.col(name)).alias("tokens"))

    return ownership.propose_bindings(named(table(spark, sf_dir, "region"), "human", "r_name"), named(table(spark, sf_dir, "nation"), "target", "n_name"))


@query("SELECT sha256(string_agg(digest, chr(10) ORDER BY block)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM (SELECT s_suppkey // 1000 AS block, sha256(string_agg(s_suppkey || ':' || s_name, chr(10) ORDER BY s_suppkey)) AS digest, count(*) AS n FROM supplier GROUP BY 1)")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of a table in the order of its key: of blocks of a thousand rows first, then of their digests."""

    def digest(lines):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n"), 256)

    row = F.concat(F.col("s_suppkey").cast("string"), F.lit(":"), "s_name").alias("line")
    blocks = table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 1000").alias("block")).agg(digest(F.struct("s_suppkey", row)).alias("digest"), F.count("*").alias("n"))
    return blocks.agg(digest(F.struct("block", F.col("digest").alias("line"))).alias("hash"), F.sum("n").alias("n"))


@query("WITH RECURSIVE chain(id, parent, depth) AS (SELECT c_custkey, c_custkey // 3, 1 FROM customer UNION ALL SELECT id, parent // 3, depth + 1 FROM chain WHERE parent > 0 AND depth < 20) SELECT id, CAST(max(depth) AS INTEGER) AS depth, string_agg(parent::VARCHAR, '/' ORDER BY depth DESC) AS chain FROM chain GROUP BY id")
def folder_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    children = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.expr("c_custkey div 3").alias("parent"))
    return ownership.ancestor_chains(customers, children, top=0)


@query()
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of matching blocks of each part's name and type; SQL has no such function."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(texts.name_similarity(F.col("p_name"), F.col("p_type")), 6).alias("ratio"))


@query(
    r"""WITH lines AS (SELECT page_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM (SELECT page_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT page_id, string_split(html, chr(10)) AS l FROM pages))),
    parts AS (SELECT page_id, unnest(p) AS part, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, string_split(html, '<!--') AS p FROM pages)),
    segments AS (
      SELECT page_id, i, 1 AS k, CASE WHEN i = 1 THEN 'code' ELSE 'comment' END AS kind, CASE WHEN i > 1 AND contains(part, '-->') THEN split_part(part, '-->', 1) ELSE part END AS s FROM parts
      UNION ALL SELECT page_id, i, 2, 'code', substr(part, strpos(part, '-->') + 3) FROM parts WHERE i > 1 AND contains(part, '-->')),
    placed AS (SELECT *, coalesce(sum(len(string_split(s, chr(10))) - 1) OVER (PARTITION BY page_id ORDER BY i, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM segments),
    pieces AS (SELECT page_id, kind, before + unnest(range(1, len(l) + 1)) AS no, unnest(l) AS piece FROM (SELECT page_id, kind, before, string_split(s, chr(10)) AS l FROM placed)),
    marks AS (SELECT page_id, no, bool_or(kind = 'code' AND regexp_replace(piece, '\s', '', 'g') <> '') AS code, bool_or(kind = 'comment') AS comment FROM pieces GROUP BY page_id, no),
    judged AS (SELECT l.page_id, regexp_replace(line, '\s', '', 'g') = '' AS blank, m.code, m.comment, contains(line, 'TODO') OR contains(line, 'FIXME') AS todo FROM lines l JOIN marks m ON m.page_id = l.page_id AND m.no = l.no)
    SELECT page_id, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND NOT code AND comment) AS comment, count(*) FILTER (WHERE NOT blank AND code) AS code, count(*) FILTER (WHERE todo) AS todo FROM judged GROUP BY page_id
    UNION ALL SELECT page_id, 0, 0, 0, 0 FROM pages WHERE page_id NOT IN (SELECT page_id FROM judged)"""
)
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank, comment and code lines of each page's source; the block state makes it a fold over lines."""
    return table(spark, sf_dir, "pages").select("page_id", texts.line_counts(F.col("html"), "xml").alias("c")).select("page_id", "c.*")
