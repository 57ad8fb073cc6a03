"""Incremental runs as file streams, each ended when the given files are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import incremental
from ._base import Plans

P = Plans()
QUERIES, ORACLE = P.queries, P.oracle


@P.add("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_upsert(spark, sf_dir):
    root = incremental.work_dir(spark, "upsert")
    incremental.run_upserts(spark, f"{sf_dir}/events.parquet", root, ["user_id"], ["ts", "event_id"])
    return incremental.snapshot(spark, root).select("user_id", "event_id", "event_type")


@P.add(
    """SELECT event_type, CAST(ts AS DATE)::TIMESTAMP AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, day"""
)
def stream_daily_totals(spark, sf_dir):
    root = incremental.work_dir(spark, "totals")
    out = incremental.windowed_totals(spark, f"{sf_dir}/events.parquet", root, "1 day")
    return out.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))
