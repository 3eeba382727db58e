"""Registered queries of the core: name -> (callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloam.operators.snapshot_diff import snapshot_changes
from codeloam.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query(
    "p1_found",
    """
    WITH r AS (
      SELECT delivery_no, regexp_replace(trim(target, E' \\t\\r\\n'), '^\\./', '') AS target, loaded_at, snapshot_id,
        list_sort(list_filter([{'k': e.key, 'v': round(e.value, 4)} FOR e IN map_entries(coalesce(enriched, MAP {}))], lambda e: e.v <> 0)) AS vec,
        list_sort(list_distinct(coalesce(vuln_types, []))) AS kinds,
        lower(regexp_replace(complexity, '\\s+', '', 'g')) AS growth
      FROM shape_snapshot WHERE target IS NOT NULL),
    v AS (SELECT DISTINCT ON (delivery_no, target) * FROM r ORDER BY delivery_no, target, loaded_at DESC NULLS LAST, snapshot_id DESC),
    s AS (SELECT delivery_no AS cur, lag(delivery_no) OVER (ORDER BY delivery_no) AS prev FROM (SELECT DISTINCT delivery_no FROM snapshot_delivery)),
    a AS (SELECT s.cur, v.target, vec, kinds, growth FROM s JOIN v ON v.delivery_no = s.cur WHERE s.prev IS NOT NULL),
    b AS (SELECT s.cur, v.target, vec, kinds, growth FROM s JOIN v ON v.delivery_no = s.prev)
    SELECT coalesce(a.cur, b.cur)::INT AS delivery_no, coalesce(a.target, b.target) AS target,
      CASE WHEN b.target IS NULL THEN 'added' WHEN a.target IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
    FROM a FULL OUTER JOIN b ON a.cur = b.cur AND a.target = b.target
    WHERE a.target IS NULL OR b.target IS NULL OR a.vec IS DISTINCT FROM b.vec OR a.kinds IS DISTINCT FROM b.kinds OR a.growth IS DISTINCT FROM b.growth
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "shape_snapshot"), table(spark, sf_dir, "snapshot_delivery"))
