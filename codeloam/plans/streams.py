"""Queries that run a stream over all files of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.plans.core import query
from codeloam.streaming import snapshots as st


@query(
    "stream_snapshot_changes",
    """
    WITH r AS (SELECT DISTINCT regexp_replace(trim(target, E' \\t\\r\\n'), '^\\./', '') AS target, delivery_no, loaded_at,
        list_sort(list_filter([{'k': e.key, 'v': round(e.value, 4)} FOR e IN map_entries(coalesce(enriched, MAP {}))], lambda e: e.v <> 0)) AS vec, list_sort(list_distinct(coalesce(vuln_types, []))) AS kinds,
        coalesce(lower(regexp_replace(complexity, '\\s+', '', 'g')), '<null>') AS growth FROM shape_snapshot WHERE target IS NOT NULL),
    o AS (SELECT *, lag(vec) OVER w AS pv, lag(kinds) OVER w AS pk, lag(growth) OVER w AS pg, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY target ORDER BY delivery_no, loaded_at))
    SELECT target, delivery_no, loaded_at, CASE WHEN n = 1 THEN 'added' ELSE 'changed' END AS change_kind FROM o WHERE n = 1 OR pv IS DISTINCT FROM vec OR pk IS DISTINCT FROM kinds OR pg IS DISTINCT FROM growth
    """,
)
def stream_snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of each target against its last state, kept across micro-batches."""
    out = st.drained(st.changes(st.table_stream(spark, d, "shape_snapshot")), "append")
    return out.withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz"))


@query("stream_finding_windows", "SELECT date_trunc('day', found_at) AS day, detector, count(*) AS findings, max(loaded_at) AS last_loaded FROM finding WHERE found_at IS NOT NULL GROUP BY ALL")
def stream_finding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Findings by day and detector, from a windowed stream."""
    out = st.drained(st.windows(st.table_stream(spark, d, "finding")), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "detector", "findings", "last_loaded")
