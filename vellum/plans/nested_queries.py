"""Queries on nested records (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators.flatten import NODES, nested_items
from vellum.sources.tables import table


def _items(spark: SparkSession, sf_dir: str, nodes: tuple[str, ...] = NODES) -> DataFrame:
    return nested_items(table(spark, sf_dir, "evaluation_results"), table(spark, sf_dir, "result_lines"), nodes)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("src", "record_id", "node", "parent_idx", "idx")


def p6_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, ("ground_truth", "prediction")).select("src", "record_id", "node", "idx", "event_type", "trigger")


def p6_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, ("ground_truth.arguments", "prediction.arguments")).select("src", "record_id", "node", "parent_idx", "idx", "event_type", "role", "argument")


def p6_repair_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, ("repair_steps",)).select("src", "record_id", "idx", "step")


_SQL_NODES = """
WITH ev AS (
  SELECT result_id AS record_id, 'ground_truth' AS node, unnest(ground_truth) AS e, generate_subscripts(ground_truth, 1) - 1 AS idx FROM evaluation_results
  UNION ALL
  SELECT result_id, 'prediction', unnest(prediction), generate_subscripts(prediction, 1) - 1 FROM evaluation_results),
ar AS (SELECT record_id, node || '.arguments' AS node, idx AS parent_idx, e.event_type AS event_type, unnest(e.arguments) AS a, generate_subscripts(e.arguments, 1) - 1 AS idx FROM ev WHERE e IS NOT NULL),
st AS (SELECT result_id AS record_id, unnest(parse_diagnostics.repair_steps) AS step, generate_subscripts(parse_diagnostics.repair_steps, 1) - 1 AS idx FROM evaluation_results),
pl AS (SELECT line_id AS record_id, CAST(payload AS JSON) AS j FROM result_lines),
lv AS (
  SELECT record_id, 'ground_truth' AS node, CASE WHEN json_type(j, '$.ground_truth') IN ('ARRAY','OBJECT') THEN json_extract(j, '$.ground_truth') ELSE json_extract(j, '$.gold') END AS v FROM pl
  UNION ALL
  SELECT record_id, 'prediction', CASE WHEN json_type(j, '$.prediction') IN ('ARRAY','OBJECT') THEN json_extract(j, '$.prediction') ELSE json_extract(j, '$.pred') END FROM pl),
lw AS (SELECT record_id, node, CAST(CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.events') ELSE v END AS JSON[]) AS v FROM lv WHERE json_type(v) IN ('ARRAY','OBJECT')),
le AS (SELECT record_id, node, unnest(v) AS e, generate_subscripts(v, 1) - 1 AS idx FROM lw),
lo AS (SELECT * FROM le WHERE json_type(e) = 'OBJECT'),
lb AS (SELECT record_id, node || '.arguments' AS node, idx AS parent_idx, e ->> '$.event_type' AS event_type, CAST(json_extract(e, '$.arguments') AS JSON[]) AS v FROM lo WHERE json_type(e, '$.arguments') = 'ARRAY'),
la AS (SELECT record_id, node, parent_idx, event_type, unnest(v) AS a, generate_subscripts(v, 1) - 1 AS idx FROM lb),
lt AS (SELECT record_id, CAST(CASE WHEN json_type(j, '$.parse_diagnostics.repair_steps') = 'ARRAY' THEN json_extract(j, '$.parse_diagnostics.repair_steps') ELSE json_extract(j, '$.repair_steps') END AS JSON[]) AS v FROM pl
       WHERE json_type(j, '$.parse_diagnostics.repair_steps') = 'ARRAY' OR json_type(j, '$.repair_steps') = 'ARRAY'),
ls AS (SELECT record_id, unnest(v) AS s, generate_subscripts(v, 1) - 1 AS idx FROM lt)
"""

_SQL_FOUND = (
    _SQL_NODES
    + """
SELECT 'evaluation_results' AS src, record_id, node, CAST(-1 AS INT) AS parent_idx, CAST(idx AS INT) AS idx FROM ev WHERE e IS NOT NULL
UNION ALL SELECT 'evaluation_results', record_id, node, CAST(parent_idx AS INT), CAST(idx AS INT) FROM ar WHERE a IS NOT NULL
UNION ALL SELECT 'evaluation_results', record_id, 'repair_steps', CAST(-1 AS INT), CAST(idx AS INT) FROM st WHERE step IS NOT NULL
UNION ALL SELECT 'result_lines', record_id, node, CAST(-1 AS INT), CAST(idx AS INT) FROM lo
UNION ALL SELECT 'result_lines', record_id, node, CAST(parent_idx AS INT), CAST(idx AS INT) FROM la WHERE json_type(a) = 'OBJECT'
UNION ALL SELECT 'result_lines', record_id, 'repair_steps', CAST(-1 AS INT), CAST(idx AS INT) FROM ls WHERE json_type(s) <> 'NULL'
"""
)
_SQL_EVENTS = (
    _SQL_NODES
    + """
SELECT 'evaluation_results' AS src, record_id, node, CAST(idx AS INT) AS idx, e.event_type AS event_type, e."trigger" AS "trigger" FROM ev WHERE e IS NOT NULL
UNION ALL SELECT 'result_lines', record_id, node, CAST(idx AS INT), e ->> '$.event_type', e ->> '$.trigger' FROM lo
"""
)
_SQL_STEPS = (
    _SQL_NODES
    + """
SELECT 'evaluation_results' AS src, record_id, CAST(idx AS INT) AS idx, step FROM st WHERE step IS NOT NULL
UNION ALL SELECT 'result_lines', record_id, CAST(idx AS INT), s ->> '$' FROM ls WHERE json_type(s) <> 'NULL'
"""
)

QUERIES = {"p6_found": p6_found, "p6_events": p6_events, "p6_arguments": p6_arguments, "p6_repair_steps": p6_repair_steps}
ORACLES = {"p6_found": _SQL_FOUND, "p6_events": _SQL_EVENTS, "p6_repair_steps": _SQL_STEPS}
