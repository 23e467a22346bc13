"""Queries over seeded changes of the model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.operators import seeded
from lodestone.plans.model import query
from lodestone.plans.views import RULES_SQL, TYPE_FEW_SEAMS, Facts

INSTANCES = 4


def _spread(name: str, candidates: str, order: str, columns: str) -> str:
    """SQL of ``INSTANCES`` candidates at even distances."""
    picks = ", ".join(f"{i} * n // {INSTANCES}" for i in range(INSTANCES))
    return f"{name} AS (SELECT {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () AS n FROM ({candidates})) WHERE r IN ({picks}))"


_PLAN = (
    ", "
    + RULES_SQL
    + """,
fp AS (SELECT id FROM targets WHERE NOT external),
own AS (SELECT source, target FROM edges WHERE is_declared_dependency AND source IN (SELECT id FROM fp) AND target IN (SELECT id FROM fp)),
used AS (SELECT source AS id FROM own UNION SELECT target FROM own),
noisy AS (SELECT source AS id FROM merged WHERE type IN ('interop', 'runtime') UNION SELECT target FROM merged WHERE type IN ('interop', 'runtime')),
clean AS (SELECT id FROM fp WHERE id NOT IN (SELECT id FROM noisy)),
needed AS (SELECT id, count(source) AS n FROM fp LEFT JOIN own ON target = id GROUP BY id),
"""
    + ",\n".join(
        [
            _spread("p_add", "SELECT x.id AS a, y.id AS b FROM fp x, fp y WHERE x.id <> y.id AND NOT EXISTS (SELECT 1 FROM own WHERE (source = x.id AND target = y.id) OR (source = y.id AND target = x.id)) AND (x.id IN (SELECT id FROM used) OR y.id IN (SELECT id FROM used))", "a, b", "a, b"),
            _spread("p_cut", "SELECT source AS a, target AS b FROM own", "a, b", "a, b"),
            _spread("p_gone", "SELECT id AS a FROM clean WHERE id IN (SELECT id FROM used)", "a", "a"),
            _spread("p_merge", "SELECT id AS a, (SELECT id FROM needed n WHERE n.id <> c.id ORDER BY n.n DESC, n.id LIMIT 1) AS b FROM clean c WHERE id IN (SELECT target FROM own)", "a", "a, b"),
        ]
    )
    + f""",
plan AS (SELECT row_number() OVER (ORDER BY operator, a, b) - 1 AS variant, operator, a, b FROM (
  SELECT 'add_forbidden_dep' AS operator, a, b FROM p_add UNION ALL SELECT 'remove_dep', a, b FROM p_cut UNION ALL SELECT 'add_target', 'synthetic:lib:added_' || (k + 1), CAST(NULL AS VARCHAR) FROM range({INSTANCES}) AS g(k)
  UNION ALL SELECT 'remove_target', a, CAST(NULL AS VARCHAR) FROM p_gone UNION ALL SELECT 'rename_target', a, a || '_renamed' FROM p_gone UNION ALL SELECT 'merge_targets', a, b FROM p_merge))"""
)

_OUTCOMES = (
    _PLAN
    + """,
vt AS (SELECT variant, CASE WHEN operator = 'rename_target' AND id = a THEN b ELSE id END AS id, container_id, external FROM targets, plan WHERE NOT (operator IN ('remove_target', 'merge_targets') AND id = a)
  UNION ALL SELECT variant, a, 'container:added', FALSE FROM plan WHERE operator = 'add_target'),
ve AS (SELECT variant, source, target, bool_or(d) AS d FROM (
    SELECT variant, CASE WHEN operator = 'rename_target' AND source = a THEN b ELSE source END AS source, CASE WHEN operator IN ('rename_target', 'merge_targets') AND target = a THEN b ELSE target END AS target, is_declared_dependency AS d
    FROM edges, plan WHERE NOT (operator = 'remove_dep' AND source = a AND target = b) AND NOT (operator = 'remove_target' AND a IN (source, target)) AND NOT (operator = 'merge_targets' AND (source = a OR (source = b AND target = a)))
    UNION ALL SELECT variant, a, b, TRUE FROM plan WHERE operator = 'add_forbidden_dep') GROUP BY ALL),
bo AS (SELECT variant, source, target FROM own, plan),
vo AS (SELECT variant, source, target FROM ve WHERE d AND (variant, source) IN (SELECT (variant, id) FROM vt WHERE NOT external) AND (variant, target) IN (SELECT (variant, id) FROM vt WHERE NOT external)),
l0 AS (SELECT id FROM covered WHERE layer = 'L0' AND ok),
dt AS (SELECT v.variant, v.id, 'new' AS status FROM vt v WHERE NOT external AND id NOT IN (SELECT id FROM fp)
  UNION ALL SELECT variant, fp.id, CASE WHEN fp.id IN (SELECT id FROM l0) THEN 'removed' ELSE 'gap' END FROM fp, plan WHERE (variant, fp.id) NOT IN (SELECT (variant, id) FROM vt WHERE NOT external)),
sure AS (SELECT source, target, bool_and((source, layer) IN (SELECT (id, layer) FROM covered WHERE ok) AND (target, layer) IN (SELECT (id, layer) FROM covered WHERE ok)) AS ok FROM (SELECT source, target, unnest(layers) AS layer FROM edges) GROUP BY ALL),
de AS (SELECT *, 'new' AS status FROM (SELECT * FROM vo EXCEPT SELECT * FROM bo) UNION ALL SELECT g.*, CASE WHEN ok THEN 'removed' ELSE 'gap' END FROM (SELECT * FROM bo EXCEPT SELECT * FROM vo) g JOIN sure USING (source, target)),
touch AS (SELECT variant, operator, a, b, source, target FROM own, plan WHERE operator IN ('remove_target', 'rename_target', 'merge_targets') AND a IN (source, target)),
want AS (
  SELECT variant, 'new_target' AS kind, a AS x, CAST(NULL AS VARCHAR) AS y FROM plan WHERE operator = 'add_target' UNION SELECT variant, 'new_target', b, CAST(NULL AS VARCHAR) FROM plan WHERE operator = 'rename_target'
  UNION SELECT variant, 'removed_target', a, CAST(NULL AS VARCHAR) FROM plan WHERE operator IN ('remove_target', 'rename_target', 'merge_targets')
  UNION SELECT variant, 'removed_edge', a, b FROM plan WHERE operator = 'remove_dep' UNION SELECT variant, 'removed_edge', source, target FROM touch
  UNION SELECT variant, 'new_edge', a, b FROM plan WHERE operator = 'add_forbidden_dep'
  UNION SELECT variant, 'new_edge', if(source = a, b, source), if(target = a, b, target) FROM touch WHERE operator = 'rename_target'
  UNION SELECT variant, 'new_edge', source, b FROM touch WHERE operator = 'merge_targets' AND target = a AND source NOT IN (a, b) AND (source, b) NOT IN (SELECT (source, target) FROM own)
  UNION SELECT variant, 'rename', a, b FROM plan WHERE operator = 'rename_target' UNION SELECT variant, 'violation', a, b FROM plan WHERE operator = 'add_forbidden_dep'),
allrules AS (SELECT rule, "from", "to" FROM rules UNION ALL SELECT 'seeded-' || variant, a, b FROM plan WHERE operator = 'add_forbidden_dep'),
was AS (SELECT DISTINCT rule FROM allrules r JOIN targets a ON r."from" IN (a.id, a.container_id) JOIN targets b ON r."to" IN (b.id, b.container_id) JOIN edges e ON e.source = a.id AND e.target = b.id),
hit AS (SELECT e.variant, r."from" AS x, r."to" AS y, bool_or((e.variant, e.source, e.target) IN (SELECT (variant, x, y) FROM want WHERE kind = 'new_edge')) AS meant
  FROM ve e JOIN vt a ON a.variant = e.variant AND a.id = e.source JOIN vt b ON b.variant = e.variant AND b.id = e.target JOIN allrules r ON r."from" IN (a.id, a.container_id) AND r."to" IN (b.id, b.container_id)
  WHERE rule NOT IN (SELECT rule FROM was) GROUP BY ALL),
renames AS (SELECT o.variant, o.id AS x, n.id AS y FROM dt o JOIN dt n ON n.variant = o.variant AND n.status = 'new' AND o.status = 'removed' AND string_split(o.id, '/')[-1] = string_split(n.id, '/')[-1]
  UNION SELECT variant, max(id) FILTER (WHERE status = 'removed'), max(id) FILTER (WHERE status = 'new') FROM dt GROUP BY variant HAVING count(*) FILTER (WHERE status = 'removed') = 1 AND count(*) FILTER (WHERE status = 'new') = 1),
found AS (
  SELECT variant, status || '_target' AS kind, id AS x, CAST(NULL AS VARCHAR) AS y FROM dt WHERE status <> 'gap' UNION SELECT variant, status || '_edge', source, target FROM de WHERE status <> 'gap' UNION SELECT variant, 'rename', x, y FROM renames
  UNION SELECT variant, 'violation', x, y FROM hit WHERE NOT meant OR (variant, x, y) IN (SELECT (variant, x, y) FROM want WHERE kind = 'violation')),
gaps AS (SELECT variant, 'removed_target' AS kind, id AS x, CAST(NULL AS VARCHAR) AS y FROM dt WHERE status = 'gap' UNION SELECT variant, 'removed_edge', source, target FROM de WHERE status = 'gap'),
judged AS (
  SELECT w.*, CASE WHEN f.kind IS NOT NULL THEN 'detected' WHEN g.kind IS NOT NULL THEN 'gap' ELSE 'silent' END AS outcome FROM want w
    LEFT JOIN found f ON f.variant = w.variant AND f.kind = w.kind AND f.x = w.x AND f.y IS NOT DISTINCT FROM w.y LEFT JOIN gaps g ON g.variant = w.variant AND g.kind = w.kind AND g.x = w.x AND g.y IS NOT DISTINCT FROM w.y
  UNION ALL SELECT *, 'alarm' FROM (SELECT * FROM found EXCEPT SELECT * FROM want))"""
)


@query("SELECT variant, operator, a, b FROM plan", extra=_PLAN, types=TYPE_FEW_SEAMS)
def seeded_plan(f: Facts) -> DataFrame:
    """Changes of each operator, spread over its candidates."""
    return seeded.plan(f.targets, f.edges, INSTANCES)


def _judged(f: Facts) -> tuple[DataFrame, DataFrame]:
    changes = seeded.plan(f.targets, f.edges, INSTANCES)
    return seeded.outcomes(f.targets, f.edges, f.coverage, f.rules, changes), changes


@query("SELECT variant, operator, kind, x, y, outcome FROM judged JOIN plan USING (variant)", extra=_OUTCOMES, types=TYPE_FEW_SEAMS)
def seeded_outcomes(f: Facts) -> DataFrame:
    """Every finding of every variant, all variants applied at once."""
    return _judged(f)[0]


@query("SELECT operator, kind, " + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("detected", "gap", "silent", "alarm")) + " FROM judged JOIN plan USING (variant) GROUP BY ALL", extra=_OUTCOMES, types=TYPE_FEW_SEAMS)
def seeded_tally(f: Facts) -> DataFrame:
    return seeded.tally(_judged(f)[0])


@query(
    """, per AS (SELECT variant, bool_and(outcome IN ('alarm', 'detected')) AS complete, bool_and(outcome <> 'alarm') AS clean, count(*) FILTER (WHERE kind = 'rename' AND outcome = 'detected') AS renamed, count(*) FILTER (WHERE kind = 'rename' AND outcome = 'alarm') AS suspected FROM judged GROUP BY variant)
    SELECT operator, count(*) AS variants, count(*) FILTER (WHERE complete) AS complete, count(*) FILTER (WHERE clean) AS clean, count(*) FILTER (WHERE CASE WHEN operator = 'rename_target' THEN renamed > 0 ELSE suspected = 0 END) AS renames_right FROM per JOIN plan USING (variant) GROUP BY operator""",
    extra=_OUTCOMES,
    types=TYPE_FEW_SEAMS,
)
def seeded_runs(f: Facts) -> DataFrame:
    return seeded.runs(*_judged(f))


@query("SELECT variant, 0 AS findings FROM plan WHERE operator = 'rename_target'", extra=_PLAN, types=TYPE_FEW_SEAMS)
def seeded_aliases(f: Facts) -> DataFrame:
    """A rename that is known as an alias shows no drift."""
    return seeded.aliased(f.targets, f.edges, f.coverage, seeded.plan(f.targets, f.edges, INSTANCES))
