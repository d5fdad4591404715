"""The daily rollup of track events: build, merge, rebuild."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import present
from tidewell.functions.times import as_datetime, between, day_key

# Fixed value: the key of a rollup row.
KEY = ["project_id", "day", "name", "distinct_id"]


def daily_rollup(track: DataFrame) -> DataFrame:
    """(project_id, day, name, distinct_id) -> events; rows without a full key are left out."""
    return (
        track.filter(
            (F.col("project_id") > 0)
            & F.col("ts").isNotNull()
            & present(F.col("name"))
            & present(F.col("distinct_id"))
        )
        .groupBy("project_id", day_key(F.col("ts")).alias("day"), "name", "distinct_id")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def merge_rollup(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored counts plus new counts per key."""
    return (
        stored.select(*KEY, "events")
        .unionByName(delta.select(*KEY, "events"))
        .groupBy(*KEY)
        .agg(F.sum("events").alias("events"))
    )


def rebuild_rollup(daily: DataFrame, track: DataFrame, project_id: int, before: str | datetime) -> DataFrame:
    """After raw rows before `before` are deleted: drop the project's older days and recount the
    cutoff day, which may be partial, from the raw rows that are left. Other projects stay."""
    before = as_datetime(before)
    cutoff = f"{before:%Y-%m-%d}"
    start = datetime.combine(before.date(), time.min)
    own = F.col("project_id") == project_id
    kept = daily.filter(~own | (F.col("day") > cutoff))
    cutoff_day = between(track.filter(own), start, start + timedelta(days=1), end_open=True)
    return kept.select(*KEY, "events").unionByName(daily_rollup(cutoff_day))
