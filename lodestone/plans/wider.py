"""Queries over the model for summaries, what-if changes, conformance, and plans of changes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.operators import govern, graph, lift, mutations, risk, score, simulate, summaries
from lodestone.plans import tables
from lodestone.plans.model import _CURVE, _DEGREE, _SCC, _SCORES, _SNAPSHOTS, _two, query
from lodestone.plans.review import _UPPER
from lodestone.plans.views import RULES_SQL, Facts
from lodestone.sources.tables import table


@query("SELECT layer, bool_or(ok) AS covers FROM covered WHERE id IN (SELECT id FROM targets WHERE NOT external) GROUP BY layer")
def covers_layer(f: Facts) -> DataFrame:
    return summaries.covers_layer(f.targets, f.coverage)


@query("SELECT source_container, target_container, weight FROM cross_edges WHERE source_container IN (SELECT node FROM ucomp) AND target_container IN (SELECT node FROM ucomp)", extra=_UPPER)
def cited_edges(f: Facts) -> DataFrame:
    lifted = lift.container_edges(f.edges, f.targets)
    return summaries.cited_edges(lifted, graph.strong_components(lifted, "source_container", "target_container"))


@query(
    """SELECT count(*) AS elements, count(*) FILTER (WHERE score >= 0.7) AS high, count(*) FILTER (WHERE score >= 0.5 AND score < 0.7) AS medium, count(*) FILTER (WHERE score < 0.5) AS low, round(avg(score), 4) AS mean, count(*) FILTER (WHERE score >= 0.5) AS retained, count(*) FILTER (WHERE score < 0.5) AS abstained,
    (SELECT round(coalesce(sum(a), 0), 6) FROM (SELECT (coverage - lag(coverage) OVER (ORDER BY coverage)) * (risk + lag(risk) OVER (ORDER BY coverage)) / 2 AS a FROM curve)) AS aurc FROM scores""",
    extra=_SCORES + _CURVE,
)
def model_summary(f: Facts) -> DataFrame:
    return summaries.model_summary(score.element_scores(f.targets, f.edges))


@query("SELECT container_id, arg_min(stratum, list_position(['L0', 'interop', 'L1', 'L2', 'L3', 'runtime', 'none'], stratum)) AS stratum FROM scores GROUP BY container_id", extra=_SCORES)
def container_strata(f: Facts) -> DataFrame:
    return summaries.container_strata(score.element_scores(f.targets, f.edges))


@query(
    """, outs AS (SELECT source AS id, count(*) AS n FROM edges GROUP BY source), part AS (SELECT DISTINCT id FROM coverage WHERE value NOT IN ('true', 'false'))
    SELECT coalesce(stratum, 'total') AS stratum, count(*) AS elements, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges, count(*) FILTER (WHERE score < 0.5) AS abstained, count(part.id) AS partial, round(avg(score), 4) AS mean
    FROM scores LEFT JOIN outs ON outs.id = scores.id LEFT JOIN part ON part.id = scores.id GROUP BY ROLLUP (stratum)""",
    extra=_SCORES,
)
def scorecard(f: Facts) -> DataFrame:
    return summaries.scorecard(score.element_scores(f.targets, f.edges), f.edges, f.coverage)


@tables.query("SELECT p_brand AS container_id, array_to_string(list_sort(list(DISTINCT name))[1:8], ',') AS packages FROM (SELECT p_brand, split_part(p_name, ' ', 2) AS name FROM part) GROUP BY p_brand")
def technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "part").select(F.col("p_brand").alias("container_id"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("package"))
    return summaries.technologies(packages).select("container_id", F.array_join("packages", ",").alias("packages"))


@tables.query("SELECT container_id, signal FROM (SELECT p_brand AS container_id, p_type AS signal, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part WHERE p_size % 9 > 0 GROUP BY p_brand, p_type) WHERE r = 1")
def dominant_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("container_id"), F.when(F.col("p_size") % 9 > 0, F.col("p_type")).alias("signal"))
    return summaries.dominant_signal(members)


@tables.query("SELECT source AS container_id, CASE WHEN grouping(language) = 1 THEN 'all' ELSE coalesce(language, 'unknown') END AS language, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS code FROM (SELECT source, lang AS language, n_chars FROM documents) GROUP BY GROUPING SETS ((source, language), (source))")
def language_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.language_rollup(table(spark, sf_dir, "documents").select(F.col("source").alias("container_id"), F.col("lang").alias("language"), F.col("n_chars").alias("code")))


@query("SELECT id, CASE WHEN key % 3 = 0 THEN key * 7 ELSE key END AS key, CASE WHEN key % 3 = 0 THEN 'm' || key END AS note FROM targets")
def annotated_targets(f: Facts) -> DataFrame:
    measured = f.targets.where("key % 3 = 0").select("id", (F.col("key") * 7).alias("key"), F.expr("concat('m', key)").alias("note"))
    return summaries.annotated(f.targets, measured, ["key", "note"]).select("id", "key", "note")


@query("SELECT id, array_to_string(list_sort(list_concat(list_filter(tags, lambda t: NOT contains(t, ':')), ['type:lib'], CASE WHEN external THEN ['external'] ELSE [] END)), ',') AS tags FROM targets")
def element_tags(f: Facts) -> DataFrame:
    return f.targets.select("id", F.array_join(summaries.element_tags(F.col("external"), F.col("tags"), F.lit("lib")), ",").alias("tags"))


@query(
    """, marked AS (SELECT container_id, min(CASE WHEN list_contains(tags, 'module-category:0') THEN 'module-category:0' ELSE 'module-category:5' END) AS reason FROM targets WHERE list_contains(tags, 'module-category:0') OR list_contains(tags, 'module-category:5') GROUP BY container_id)
    SELECT container_id, reason, 'high' AS confidence FROM marked UNION ALL SELECT DISTINCT container_id, 'unused', 'low' FROM targets WHERE NOT external AND container_id NOT IN (SELECT target_container FROM cross_edges) AND container_id NOT IN (SELECT container_id FROM marked)"""
)
def entry_containers(f: Facts) -> DataFrame:
    return summaries.entries(f.targets, f.edges, ("module-category:0", "module-category:5"))


@query(
    """, fan AS (SELECT target AS id, count(*) AS n FROM edges GROUP BY target), seam AS (SELECT DISTINCT unnest([source, target]) AS id FROM edges WHERE list_contains(layers, 'interop'))
    SELECT container_id, id, CAST(r AS INTEGER) AS rank FROM (SELECT container_id, t.id, row_number() OVER (PARTITION BY container_id ORDER BY coalesce(fan.n, 0) + CASE WHEN seam.id IS NULL THEN 0 ELSE 5 END DESC, key * 3 % 7 DESC, t.id) AS r FROM targets t LEFT JOIN fan ON fan.id = t.id LEFT JOIN seam ON seam.id = t.id) WHERE r <= 3"""
)
def salient_members(f: Facts) -> DataFrame:
    return summaries.salient_members(f.targets, f.edges, f.targets.select("id", (F.col("key") * 3 % 7).alias("size")), 3)


@tables.query(
    """WITH w AS (SELECT event_type AS container_id, count(*) AS commits FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 9 DAYS GROUP BY event_type), d AS (SELECT event_type AS container_id, count(DISTINCT user_id) AS degree FROM events WHERE event_type <> 'view' GROUP BY event_type)
    SELECT container_id, commits, coalesce(degree, 0) AS degree, round(commits / max(commits) OVER () * coalesce(degree, 0) / max(coalesce(degree, 0)) OVER (), 4) AS hotspot FROM w LEFT JOIN d USING (container_id)"""
)
def churn_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    coupling = events.where("event_type <> 'view'").groupBy(F.col("event_type").alias("container_id")).agg(F.count_distinct("user_id").alias("degree"))
    return summaries.churn(events.select(F.col("event_type").alias("container_id"), "ts"), coupling, days=9)


@query(
    """, ceil(ceiling, k) AS (VALUES ('L0', 0), ('L1', 1), ('L2', 2), ('L3', 3)),
    kept AS (SELECT source, target, ceiling, greatest(0, sum(w) - 2 * count(*) FILTER (WHERE visibility = 'private')) AS weight FROM weighed CROSS JOIN ceil WHERE CASE layer WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 ELSE 0 END <= k GROUP BY ALL)
    SELECT ceiling, threshold, count(*) AS edges, count(DISTINCT (a.container_id, b.container_id)) AS container_pairs FROM kept JOIN targets a ON a.id = source JOIN targets b ON b.id = target CROSS JOIN (SELECT unnest([0, 1, 3, 5, 8]) AS threshold) WHERE a.container_id <> b.container_id AND weight >= threshold GROUP BY ceiling, threshold"""
)
def ablation_axes(f: Facts) -> DataFrame:
    return summaries.sweep(f.edges, f.targets)


@query(
    """, x AS (SELECT source AS id, target_container AS uses, CAST(NULL AS VARCHAR) AS used_by FROM lifted WHERE source_container <> target_container UNION ALL SELECT target, NULL, source_container FROM lifted WHERE source_container <> target_container)
    SELECT id, coalesce(string_agg(DISTINCT uses, ',' ORDER BY uses), '') AS uses, coalesce(string_agg(DISTINCT used_by, ',' ORDER BY used_by), '') AS used_by FROM x GROUP BY id"""
)
def context_both_ways(f: Facts) -> DataFrame:
    return summaries.context(f.edges, f.targets).select("id", F.array_join("uses", ",").alias("uses"), F.array_join("used_by", ",").alias("used_by"))


@query(
    """, near AS (SELECT unnest([source, target]) AS id, n_items FROM edges), n AS (SELECT id, sum(n_items) AS n FROM near GROUP BY id), j AS (SELECT t.*, coalesce(n, 0) < 2 OR NOT documented AND list_contains(tags, 'needs-curation') AS weak, key % 4 = 2 AS low FROM targets t LEFT JOIN n USING (id))
    SELECT id, CASE WHEN weak THEN 'weak' ELSE 'strong' END AS evidence, weak OR low AS review, len(tags) + CASE WHEN (weak OR low) AND NOT list_contains(tags, 'needs-curation') THEN 1 ELSE 0 END AS n_tags FROM j"""
)
def review_flags(f: Facts) -> DataFrame:
    stated = f.targets.select("id", F.when(F.col("key") % 4 == 2, "low").otherwise("high").alias("confidence"))
    return summaries.crosschecked(f.targets, f.edges, stated).select("id", "evidence", "review", F.size("tags").cast("long").alias("n_tags"))


@query(
    """, own AS (SELECT container_id, count(*) AS members, bool_and(external) AS boundary FROM targets GROUP BY container_id),
    conf AS (SELECT container_id, round_even(avg(score), 4) AS confidence, count(*) FILTER (WHERE score < 0.5) AS abstained, arg_min(stratum, list_position(['L0', 'interop', 'L1', 'L2', 'L3', 'runtime', 'none'], stratum)) AS stratum FROM scores GROUP BY container_id),
    sig AS (SELECT container_id, signal FROM (SELECT container_id, tags[1] AS signal, row_number() OVER (PARTITION BY container_id ORDER BY count(*) DESC, tags[1]) AS r FROM targets GROUP BY container_id, tags[1]) WHERE r = 1),
    lang AS (SELECT container_id, CAST(sum(key) AS BIGINT) AS code, arg_min(l, (-c, l)) AS language FROM (SELECT container_id, 'l' || (key % 3) AS l, sum(key) AS key, sum(key) AS c FROM targets GROUP BY ALL) GROUP BY container_id),
    seen AS (SELECT container_id, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END), 4) AS coverage FROM targets JOIN covered USING (id) WHERE layer = 'L0' AND NOT external GROUP BY container_id),
    rsk AS (SELECT container_id, count(*) AS risks, max(key)::DOUBLE AS worst FROM targets WHERE key % 2 = 1 GROUP BY container_id),
    pack AS (SELECT container_id, array_to_string(list_sort(list(DISTINCT name))[1:8], ',') AS packages FROM targets GROUP BY container_id)
    SELECT container_id, members, boundary, efferent, afferent, weight, confidence, abstained, stratum, packages, signal, code, language, coverage, risks, worst
    FROM own LEFT JOIN degrees ON node = container_id LEFT JOIN conf USING (container_id) LEFT JOIN pack USING (container_id) LEFT JOIN sig USING (container_id) LEFT JOIN lang USING (container_id) LEFT JOIN seen USING (container_id) LEFT JOIN rsk USING (container_id)""",
    extra=_SCORES + _DEGREE,
)
def datasheets(f: Facts) -> DataFrame:
    t = f.targets.withColumn("signal", F.get("tags", F.lit(0)))
    packages = t.select("container_id", F.col("name").alias("package"))
    measured = t.select("container_id", F.expr("concat('l', key % 3)").alias("language"), F.col("key").cast("long").alias("code"))
    risks = t.where("key % 2 = 1").select("container_id", F.col("key").cast("double").alias("severity"))
    return summaries.datasheets(t, f.edges, f.coverage, packages, measured, risks).withColumn("packages", F.array_join("packages", ","))


_AFTER = """, moved AS (SELECT id, {case} AS c FROM targets), cut AS (SELECT * FROM edges WHERE {keep}), now(s, t, weight) AS (SELECT a.c, b.c, CAST(sum(weight) AS BIGINT) FROM cut JOIN moved a ON a.id = source JOIN moved b ON b.id = target WHERE a.c <> b.c GROUP BY ALL),
was(s, t, weight) AS (SELECT source_container, target_container, weight FROM cross_edges),
r1(a, b) AS (SELECT s, t FROM was UNION SELECT r.a, e.t FROM r1 r JOIN was e ON r.b = e.s), r2(a, b) AS (SELECT s, t FROM now UNION SELECT r.a, e.t FROM r2 r JOIN now e ON r.b = e.s),
c1 AS (SELECT count(DISTINCT component) AS cycles FROM (SELECT x.a, min(x.b) AS component FROM r1 x JOIN r1 y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1)), c2 AS (SELECT count(DISTINCT component) AS cycles FROM (SELECT x.a, min(x.b) AS component FROM r2 x JOIN r2 y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1)),
v1 AS (SELECT count(DISTINCT rule) AS violations FROM rules r JOIN targets a ON r."from" IN (a.id, a.container_id) JOIN targets b ON r."to" IN (b.id, b.container_id) JOIN edges e ON e.source = a.id AND e.target = b.id),
v2 AS (SELECT count(DISTINCT rule) AS violations FROM rules r JOIN moved a ON r."from" IN (a.id, a.c) JOIN moved b ON r."to" IN (b.id, b.c) JOIN cut e ON e.source = a.id AND e.target = b.id),
m AS (SELECT 'was' AS side, (SELECT count(*) FROM was) AS edges, (SELECT sum(weight) FROM was) AS weight, count(*) AS containers, max(ins) AS max_fan_in, max(outs) AS max_fan_out, (SELECT cycles FROM c1) AS cycles, (SELECT violations FROM v1) AS violations FROM (SELECT node, count(i) AS ins, count(o) AS outs FROM (SELECT s AS node, t AS o, NULL AS i FROM was UNION ALL SELECT t, NULL, s FROM was) GROUP BY node)
  UNION ALL SELECT 'now', (SELECT count(*) FROM now), (SELECT sum(weight) FROM now), count(*), max(ins), max(outs), (SELECT cycles FROM c2), (SELECT violations FROM v2) FROM (SELECT node, count(i) AS ins, count(o) AS outs FROM (SELECT s AS node, t AS o, NULL AS i FROM now UNION ALL SELECT t, NULL, s FROM now) GROUP BY node)),
long AS (SELECT side, unnest(['edges', 'weight', 'containers', 'max_fan_in', 'max_fan_out', 'cycles', 'violations']) AS metric, unnest([edges::DOUBLE, weight::DOUBLE, containers::DOUBLE, max_fan_in::DOUBLE, max_fan_out::DOUBLE, cycles::DOUBLE, violations::DOUBLE]) AS v FROM m)
SELECT metric, max(v) FILTER (WHERE side = 'was') AS before, max(v) FILTER (WHERE side = 'now') AS after, max(v) FILTER (WHERE side = 'now') - max(v) FILTER (WHERE side = 'was') AS delta FROM long GROUP BY metric"""
_R = ", " + RULES_SQL


@query(_AFTER.format(case="CASE WHEN id IN ('cxx:lib:NATION_3', 'cxx:lib:NATION_7') THEN 'container:new' ELSE container_id END", keep="TRUE"), extra=_R)
def simulate_extract(f: Facts) -> DataFrame:
    return simulate.simulate(f.targets, f.edges, f.coverage, f.rules, "extract", members=["cxx:lib:NATION_3", "cxx:lib:NATION_7"], name="container:new")


@query(_AFTER.format(case="CASE WHEN id = 'cxx:lib:NATION_4' THEN 'container:asia' ELSE container_id END", keep="TRUE"), extra=_R)
def simulate_move(f: Facts) -> DataFrame:
    return simulate.simulate(f.targets, f.edges, f.coverage, f.rules, "move", members=["cxx:lib:NATION_4"], name="container:asia")


@query(_AFTER.format(case="CASE WHEN container_id IN ('container:africa', 'container:asia') THEN 'container:both' ELSE container_id END", keep="TRUE"), extra=_R)
def simulate_merge(f: Facts) -> DataFrame:
    return simulate.simulate(f.targets, f.edges, f.coverage, f.rules, "merge", members=["container:africa", "container:asia"], name="container:both")


@query(_AFTER.format(case="container_id", keep="(source, target) <> (SELECT (source, target) FROM edges ORDER BY source, target LIMIT 1)"), extra=_R)
def simulate_cut(f: Facts) -> DataFrame:
    first = f.edges.orderBy("source", "target").first()
    return simulate.simulate(f.targets, f.edges, f.coverage, f.rules, "cut", source=first["source"], target=first["target"])


@query(
    """, hub AS (SELECT node FROM degrees WHERE neighbours >= 4), weak AS (SELECT component, source, target, row_number() OVER (PARTITION BY component ORDER BY weight, source, target) AS r FROM (SELECT a.component, e.* FROM edges e JOIN comp a ON a.node = e.source JOIN comp b ON b.node = e.target AND b.component = a.component)),
    busy AS (SELECT target_container AS c, target AS id, row_number() OVER (PARTITION BY target_container ORDER BY count(*) DESC, target) AS r FROM lifted WHERE source_container <> target_container GROUP BY target_container, target)
    SELECT component AS finding, 'cut' AS op, source AS subject, target AS other FROM weak WHERE r = 1 UNION ALL SELECT c, 'extract', id, NULL FROM busy WHERE r = 1 AND c IN (SELECT node FROM hub) AND c IN (SELECT container_id FROM targets GROUP BY container_id HAVING count(*) >= 2)""",
    extra=_SCC + _DEGREE,
)
def whatif_scenarios(f: Facts) -> DataFrame:
    hubs = risk.hubs(lift.container_edges(f.edges, f.targets), lift.containers(f.targets), least_share=0.0)
    return simulate.scenarios(f.targets, f.edges, hubs)


@query("""SELECT rule AS element, 0.9::DOUBLE AS severity, count(DISTINCT (e.source, e.target)) AS n_edges FROM rules r JOIN targets a ON r."from" IN (a.id, a.container_id) JOIN targets b ON r."to" IN (b.id, b.container_id) JOIN edges e ON e.source = a.id AND e.target = b.id GROUP BY rule""", extra=_R)
def layering_findings(f: Facts) -> DataFrame:
    return simulate.layering_findings(f.edges, f.targets, f.coverage, f.rules).withColumn("severity", F.col("severity").cast("double"))


_OWN = ", own AS (SELECT id FROM targets JOIN covered USING (id) WHERE NOT external AND layer = 'L0' AND ok)"
_DRIFT = """, drift AS (SELECT source, target, 'new' AS status FROM b_edges ANTI JOIN a_edges USING (source, target) UNION ALL
    SELECT g.source, g.target, CASE WHEN bool_and(coalesce(x.ok, FALSE) AND coalesce(y.ok, FALSE)) THEN 'removed' ELSE 'coverage-gap' END
    FROM (SELECT source, target, unnest(layers) AS layer FROM a_edges ANTI JOIN b_edges USING (source, target)) g LEFT JOIN covered x ON x.id = g.source AND x.layer = g.layer LEFT JOIN covered y ON y.id = g.target AND y.layer = g.layer GROUP BY g.source, g.target)"""


@query("SELECT source, target, status FROM drift WHERE source IN (SELECT id FROM own) AND target IN (SELECT id FROM own)", extra=_SNAPSHOTS + _OWN + _DRIFT)
def scoped_findings(f: Facts) -> DataFrame:
    a, b = _two(f)
    return simulate.scoped(govern.drift_edges(a.edges, b.edges, f.coverage), f.targets, f.coverage).select("source", "target", "status")


@query("SELECT CASE WHEN source < 'cxx:lib:NATION_2' THEN 'real' ELSE 'unlabelled' END AS label, status, count(*) AS findings FROM drift WHERE source IN (SELECT id FROM own) AND target IN (SELECT id FROM own) GROUP BY ALL", extra=_SNAPSHOTS + _OWN + _DRIFT)
def release_pair(f: Facts) -> DataFrame:
    a, b = _two(f)
    labels = a.edges.select("source", "target").union(b.edges.select("source", "target")).distinct().where("source < 'cxx:lib:NATION_2'").withColumn("label", F.lit("real"))
    return simulate.evaluate_pair(a.edges, b.edges, f.targets, f.coverage, labels)


@query(
    """SELECT *, violations > 0 AND NOT advisory AS blocked FROM (SELECT (SELECT count(DISTINCT rule) FROM rules r JOIN targets a ON r."from" IN (a.id, a.container_id) JOIN targets b ON r."to" IN (b.id, b.container_id) JOIN edges e ON e.source = a.id AND e.target = b.id) AS violations, (SELECT count(*) FROM drift WHERE status = 'new') AS new_edges,
    (SELECT avg(CASE WHEN value NOT IN ('false', '') THEN 1.0::DOUBLE ELSE 0 END) < 0.8 FROM targets JOIN coverage USING (id) WHERE layer = 'L0' AND NOT external) AS advisory)""",
    extra=_SNAPSHOTS + _DRIFT + _R,
)
def run_gate(f: Facts) -> DataFrame:
    a, b = _two(f)
    return simulate.gate(govern.check_layering(f.edges, f.targets, f.coverage, f.rules), govern.drift_edges(a.edges, b.edges, f.coverage), govern.coverage_l0(f.targets, f.coverage))


@query("SELECT 0.9::DOUBLE AS before, avg(CASE WHEN value NOT IN ('false', '') THEN 1.0::DOUBLE ELSE 0 END) AS now, avg(CASE WHEN value NOT IN ('false', '') THEN 1.0::DOUBLE ELSE 0 END) < 0.8 AS dropped FROM targets JOIN coverage USING (id) WHERE layer = 'L0' AND NOT external")
def coverage_dropped(f: Facts) -> DataFrame:
    was = f.spark.createDataFrame([(0.9,)], "coverage double")
    return simulate.dropped_below(was, govern.coverage_l0(f.targets, f.coverage))


@query(
    """, adrs AS (SELECT 'adr-' || a.key AS id, a.name AS x, replace(b.container_id, 'container:', '') AS y, b.container_id AS yc, a.id AS xid FROM targets a JOIN targets b ON b.key = (a.key + 1) % 25 WHERE a.key % 2 = 0),
    n AS (SELECT p.*, EXISTS (SELECT 1 FROM edges e JOIN targets t ON t.id = e.target WHERE e.source = p.xid AND t.container_id = p.yc) AS hit, coalesce((SELECT ok FROM covered c WHERE c.id = p.xid AND layer = 'L0'), FALSE) AS ok FROM adrs p)
    SELECT id, replace(x, '_', '') AS "from", y AS "to", CASE WHEN hit THEN 'VIOLATED' WHEN ok THEN 'HELD' ELSE 'UNVERIFIED' END AS verdict FROM n
    UNION ALL SELECT 'adr-' || key, CASE WHEN key % 3 = 0 THEN replace(name, '_', '') END, CASE WHEN key % 3 = 0 THEN 'the moon' END, 'NOT-A-CONSTRAINT' FROM targets WHERE key % 2 = 1"""
)
def decision_conformance(f: Facts) -> DataFrame:
    other = f.targets.select(((F.col("key") + 24) % 25).alias("key"), F.regexp_replace("container_id", "container:", "").alias("y"))
    title = F.when(F.col("key") % 2 == 0, F.concat("name", F.lit(" must not depend on "), "y", F.lit("."))).when(F.col("key") % 3 == 0, F.concat("name", F.lit(" must never call the moon"))).otherwise(F.lit("Use one language"))
    records = f.targets.join(other, "key").select(F.expr("concat('adr-', key)").alias("id"), title.alias("title"), F.lit("Context only.").alias("body"))
    return simulate.conformance(records, f.targets, f.edges, f.coverage)


@tables.query("SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS \"from\", split_part(p_name, ' ', 2) AS \"to\" FROM part WHERE p_size % 3 = 0")
def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    title = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("No direct dependency from "), a, F.lit(" to "), b, F.lit("."))).otherwise(F.col("p_name"))
    return simulate.rule_candidates(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("title")))


@tables.query("WITH a AS (SELECT c_custkey AS file, md5(c_name) AS h FROM customer WHERE c_custkey % 5 > 0), b AS (SELECT c_custkey AS file, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE md5(c_name) END AS h FROM customer WHERE c_custkey % 6 > 0) SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.h IS NULL THEN 'only-b' WHEN b.h IS NULL THEN 'only-a' WHEN a.h = b.h THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b ON a.file = b.file")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), F.md5("c_name").alias("hash"))
    return simulate.compare_runs(rows.where("file % 5 > 0"), rows.where("file % 6 > 0").withColumn("hash", F.when(F.col("file") % 7 == 0, "x").otherwise(F.col("hash"))))


@query("SELECT DISTINCT a.key % 4 AS source_label, b.key % 4 AS target_label FROM edges JOIN targets a ON a.id = source JOIN targets b ON b.id = target WHERE a.key % 4 <> b.key % 4")
def reference_edges(f: Facts) -> DataFrame:
    return simulate.reference_edges(f.edges, f.targets.select(F.col("id").alias("entity"), (F.col("key") % 4).alias("label")))


@query("SELECT DISTINCT least(source, target) AS kept, greatest(source, target) AS merged FROM lifted WHERE source_container = target_container AND source NOT IN (SELECT id FROM targets WHERE external) AND target NOT IN (SELECT id FROM targets WHERE external)")
def mergeable_pairs(f: Facts) -> DataFrame:
    return mutations.mergeable_pairs(f.targets, f.edges)


@query("SELECT source, target FROM edges WHERE is_declared_dependency")
def removable_edges(f: Facts) -> DataFrame:
    return mutations.removable_edges(f.edges)


@query("SELECT id FROM targets WHERE NOT external AND id IN (SELECT unnest([source, target]) FROM edges)")
def removable_targets(f: Facts) -> DataFrame:
    return mutations.removable_targets(f.targets, f.edges)


@query("SELECT id, id || '_renamed' AS new_id FROM targets WHERE NOT external")
def renamable_targets(f: Facts) -> DataFrame:
    return mutations.renamable_targets(f.targets)


@query("SELECT 'synthetic:lib:added_' || i AS id, 'added_' || i AS name, container_id FROM (SELECT container_id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM targets) JOIN range(5) t(i) ON k = i * n // 5")
def planned_additions(f: Facts) -> DataFrame:
    return mutations.additions(f.targets, 5)


@query("SELECT source, target FROM edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)", extra=", gone AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM targets) WHERE k IN (SELECT CAST(floor(i * 25 / 8) AS BIGINT) FROM range(8) t(i)))")
def starved_share(f: Facts) -> DataFrame:
    return mutations.starved_share(f.edges, f.coverage, f.targets, 0.3)[0].select("source", "target")


@query("SELECT id AS entity, CASE WHEN external THEN 'path:' || regexp_replace(path, '/[^/]*$', '') ELSE 'module-category:' || (key % 6) END AS label FROM targets")
def accepted_proposal(f: Facts) -> DataFrame:
    return mutations.accepted_proposal(f.targets, f.edges)


@query("SELECT id AS entity, CAST(key % 6 AS VARCHAR) AS label FROM targets")
def role_clusters(f: Facts) -> DataFrame:
    return mutations.by_role(f.targets, "module-category:")


@tables.query("SELECT o_orderstatus AS status, CASE WHEN o_totalprice < 1000 THEN '<1000' WHEN o_totalprice < 200000 THEN '1000-200000' ELSE '>=200000' END AS price, count(*) AS n FROM orders GROUP BY ALL")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mutations.exported(table(spark, sf_dir, "orders"), {"o_orderstatus": "status", "o_totalprice": "price"}, {"o_totalprice": [1000, 200000]})
    return rows.groupBy("status", "price").agg(F.count("*").alias("n"))


@tables.query("SELECT DISTINCT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def export_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return mutations.violations(rows, {"o_orderkey": [], "o_orderstatus": ["F", "O"]})


@query("SELECT id, replace(regexp_replace(name, '[0-9]+', '[redacted]', 'g'), 'NATION', '[redacted]') AS name FROM targets")
def element_payloads(f: Facts) -> DataFrame:
    return mutations.allowed_payloads(mutations.element_payload(f.targets, ["name"], ["[0-9]+"], ["NATION"]).where("id IS NOT NULL"), ["secret"])


@query("SELECT DISTINCT id, 'gone:' || key AS cite FROM targets WHERE key % 3 = 0")
def unknown_citations(f: Facts) -> DataFrame:
    cites = F.array(F.col("id"), F.col("container_id"), F.when(F.col("key") % 3 == 0, F.expr("concat('gone:', key)")).otherwise(F.col("id")))
    return mutations.unknown_citations(f.targets.select("id", cites.alias("cites")), f.targets)
