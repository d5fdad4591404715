"""New and total users."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.text import present
from tidewell.functions.times import day_key, moment, ordered


def first_seen(logs: DataFrame, track: DataFrame) -> DataFrame:
    """First time of each user over all logs and track events, of all time.

    The minimum is combined before the only shuffle, so one row per user and task crosses it.
    """
    rows = logs.select("distinct_id", "ts").unionByName(track.select("distinct_id", "ts"))
    return (
        rows.filter(present(F.col("distinct_id")))
        .groupBy("distinct_id")
        .agg(F.min("ts").alias("first_ts"))
    )


def user_growth(seen: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    """New users per day of [start, end]; days without new users are absent."""
    start, end = ordered(start, end)
    return (
        seen.filter(F.col("first_ts").between(moment(start), moment(end)))
        .groupBy(day_key(F.col("first_ts")).alias("day"))
        .agg(F.count(F.lit(1)).alias("new_users"))
        .orderBy("day")
    )


def total_users(seen: DataFrame) -> DataFrame:
    return seen.agg(F.count(F.lit(1)).alias("total_users"))


def cumulative(growth: DataFrame) -> DataFrame:
    """Running total over the daily rows (one per day, so a single task is enough)."""
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return growth.withColumn("cumulative_users", F.sum("new_users").over(upto))
