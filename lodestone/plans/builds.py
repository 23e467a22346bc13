"""Queries over claims on files, calls in tests, and files met by tiers: parts as files, brands as targets, events as calls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodestone.operators import claims, lift, scenarios
from lodestone.plans.views import Facts, facts_sql
from lodestone.session import materialise
from lodestone.sources import drawing
from lodestone.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A part is a file under its type and the words of its name. Its brand claims it where it is small, and so does the
#: next brand where it is large; large parts also say where their brand's makefile is, and of which kind it is.
FILES_SQL = """
parts AS (SELECT lower(p_type) || '/' || replace(p_name, ' ', '/') || '/p' || p_partkey || '.c' AS file, 'lib' || p_brand AS target, 'libBrand#' || (CAST(substr(p_brand, 7) AS INTEGER) % 25 + 1) AS next, p_size FROM part),
folders AS (SELECT file, target, next, p_size, string_split(file, '/')[:-2] AS f FROM parts),
claims AS (SELECT file, target FROM parts WHERE p_size <= 20 UNION SELECT file, next FROM parts WHERE p_size BETWEEN 15 AND 30),
declared AS (SELECT DISTINCT target, array_to_string(f[:p_size - 47], '/') AS dir, CASE p_size WHEN 48 THEN 'static_lib' WHEN 49 THEN 'executable' ELSE 'shared_lib' END AS type, p_size = 49 AS prim FROM folders WHERE p_size >= 48),
targets AS (SELECT target, arg_min(dir, (-length(dir), dir, type)) AS dir, arg_min(type, (-length(dir), dir, type)) AS type, bool_or(prim) AS prim FROM declared GROUP BY target),
places AS (SELECT DISTINCT dir FROM declared UNION SELECT DISTINCT array_to_string(f[:1], '/') FROM folders WHERE p_size = 1),
ranked AS (
  SELECT file, c.target, row_number() OVER (PARTITION BY file ORDER BY NOT (array_to_string(string_split(file, '/')[:-2], '/') = dir OR (dir <> '' AND starts_with(file, dir || '/'))), length(dir) DESC, NOT prim, c.target) AS r, count(*) OVER (PARTITION BY file) AS n
  FROM claims c JOIN targets USING (target)),
free AS (SELECT file, f FROM folders WHERE file NOT IN (SELECT file FROM ranked)),
near AS (SELECT file, arg_max(dir, length(dir)) AS dir FROM (SELECT file, unnest(list_concat([''], list_transform(range(1, len(f) + 1), lambda k: array_to_string(f[:k], '/')))) AS dir FROM free) JOIN places USING (dir) GROUP BY file),
owned AS (
  SELECT file, target, 'claim' AS how, n AS n_claims FROM ranked WHERE r = 1
  UNION ALL SELECT file, (SELECT min(target) FROM targets t WHERE t.dir = near.dir AND prim), 'nearest', 0 FROM near WHERE dir IN (SELECT dir FROM targets WHERE prim)),
links AS (SELECT DISTINCT p.target AS source, p.next AS target FROM parts p JOIN targets a ON a.target = p.target JOIN targets b ON b.target = p.next AND b.type <> 'executable' WHERE p_size <= 10 AND p.target <> p.next)"""


def query(sql: str, views: str = FILES_SQL):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = f"WITH RECURSIVE {views}\n{sql}"
        return function

    return register


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.substring("p_brand", 7, 9).cast("int")
    file = F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/p"), F.col("p_partkey").cast("string"), F.lit(".c"))
    return table(spark, sf_dir, "part").select(file.alias("file"), F.concat(F.lit("lib"), "p_brand").alias("target"), F.concat(F.lit("libBrand#"), (brand % 25 + 1).cast("string")).alias("next"), "p_size")


def _above(levels: Column) -> Column:
    return F.array_join(F.slice(F.split("file", "/"), F.lit(1), F.least(levels, F.size(F.split("file", "/")) - 1)), "/")


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, owners and links of the parts."""
    parts = _parts(spark, sf_dir)
    claimed = parts.where("p_size <= 20").select("file", "target").unionByName(parts.where("p_size BETWEEN 15 AND 30").select("file", F.col("next").alias("target")))
    kind = F.when(F.col("p_size") == 48, "static_lib").when(F.col("p_size") == 49, "executable").otherwise("shared_lib")
    declared = parts.where("p_size >= 48").select("target", _above(F.col("p_size") - 47).alias("dir"), kind.alias("type"), (F.col("p_size") == 49).alias("primary")).distinct()
    targets = materialise(claims.canonical(declared), "targets")
    places = declared.select("dir").unionByName(parts.where("p_size = 1").select(_above(F.lit(1)).alias("dir")))
    owned = claims.exclusive(parts, claimed, targets, places)
    return targets, owned, claims.link_edges(parts.where("p_size <= 10").select("target", F.col("next").alias("ref")), targets)


@query("SELECT file, target, how, n_claims FROM owned")
def file_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file's one owner among overlapping claims."""
    return _model(spark, sf_dir)[1]


@query("SELECT target, dir, type, prim AS \"primary\", (SELECT count(*) FROM owned o WHERE o.target = t.target) AS n_files FROM targets t WHERE target IN (SELECT target FROM owned) OR target IN (SELECT source FROM links) OR target IN (SELECT target FROM links)")
def owning_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that own a file or lie on a link, with their files counted."""
    targets, owned, links = _model(spark, sf_dir)
    owned = materialise(owned, "owned")
    counts = owned.groupBy("target").agg(F.count("*").alias("n"))
    return claims.alive(targets, owned, links).join(counts, "target", "left").select("target", "dir", "type", "primary", F.coalesce("n", F.lit(0)).alias("n_files"))


@query("SELECT source, target FROM links")
def makefile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of targets to libraries of the model."""
    return _model(spark, sf_dir)[2]


#: A user's events are the calls of one test; an event calls the nation that its properties number, if there is one.
CALLS_SQL = (
    facts_sql()
    + """,
called AS (SELECT 'flow/User' || user_id || 'Tests.cs' AS path, ts, event_id, container_id FROM events JOIN targets ON id = 'cxx:lib:NATION_' || json_extract_string(props, '$.k')),
turns AS (SELECT *, lag(container_id) OVER (PARTITION BY path ORDER BY ts, event_id) AS before FROM called),
steps AS (SELECT path, ts, event_id, before, container_id FROM turns WHERE before <> container_id AND (before, container_id) IN (SELECT (source_container, target_container) FROM cross_edges))"""
)


@query("SELECT path, 'test-' || lower(regexp_extract(path, '/(.*)\\.cs', 1)) AS key, 'Test-derived: ' || regexp_extract(path, '/(.*)\\.cs', 1) AS name, CAST(row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS INTEGER) AS index, before AS \"from\", container_id AS \"to\", 'Observed in test ' || regexp_extract(path, '/(.*)', 1) AS description FROM steps", CALLS_SQL)
def mined_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario steps mined from the ordered calls of tests, over edges of the model only."""
    facts = Facts(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    receiver = F.concat(F.lit("cxx:lib:NATION_"), F.get_json_object("props", "$.k"))
    calls = events.select(F.concat(F.lit("flow/User"), F.col("user_id").cast("string"), F.lit("Tests.cs")).alias("path"), F.struct("ts", "event_id").alias("position"), receiver.alias("receiver"))
    return scenarios.mined(calls, facts.targets, lift.container_edges(facts.edges, facts.targets))


#: Every supplier has a drawing: its nation as the system, itself in a group, a part without an identifier, and a buyer.
DRAWN_SQL = """
makers AS (SELECT 's' || s_suppkey || '.dsl' AS path, s_suppkey AS k, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
drawn AS (
  SELECT path, 'person' AS kind, 'u' || k AS key, 'Buyer of ' || s_name AS name, 'Pays {' AS description, '' AS technology, '' AS parent FROM makers
  UNION ALL SELECT path, 'softwareSystem', 'sys', n_name, '', '', '' FROM makers
  UNION ALL SELECT path, 'group', 'makers', 'Makers', '', '', n_name FROM makers
  UNION ALL SELECT path, 'container', 'c', s_name || ' {"' || k || '"}', 'Makes }', 'T', 'Makers' FROM makers
  UNION ALL SELECT path, 'component', 'loose-' || k, 'Loose ' || k, '', '', n_name FROM makers
  UNION ALL SELECT path, 'relation', 'u' || k, 'sys', 'Uses', '', n_name FROM makers
  UNION ALL SELECT path, 'views', '', '', 'systemContext sys { include * }', '', '' FROM makers)"""
_DRAWING = """workspace "x" {{
  // c {{ "
  !include a.dsl
  model {{
    u{0} = person "Buyer of {1}" "Pays {{"
    sys = softwareSystem "{2}" {{
      group "Makers" {{ # c = container "no"
        c = container "{1} {{\\"{0}\\"}}" "Makes }}" "T"
      }}
      component "Loose {0}"
      u{0} -> sys "Uses"
    }}
  }}
  views {{
systemContext sys {{ include * }}
  }}
}}"""


@query("SELECT * FROM drawn", DRAWN_SQL)
def drawn_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, groups and relations of drawings, with what is around them."""
    makers = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    fields = {"{0}": key, "{1}": F.col("s_name"), "{2}": F.col("n_name")}
    pieces = [fields.get(x) if x in fields else F.lit(x.replace("{{", "{").replace("}}", "}")) for x in re.split(r"(?<!\{)(\{[012]\})", _DRAWING)]
    texts = makers.select(F.concat(F.lit("s"), key, F.lit(".dsl")).alias("path"), F.concat(*pieces).alias("text"))
    return drawing.drawn(texts).drop("position")
