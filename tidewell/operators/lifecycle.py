"""Retention, purge and storage estimates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.skew import BROADCAST_ROWS, lookup_join
from tidewell.functions.times import MONTH, as_datetime, days_back, moment

# Days that day counters, dimension counters and month counters are kept.
DAY_DAYS, DIM_DAYS, MONTH_DAYS = 180, 90, 558
# Row overhead in bytes and sample bounds of the storage estimate.
LOG_OVERHEAD, EVENT_OVERHEAD = 120, 96
DEFAULT_SAMPLE, MAX_SAMPLE = 200, 2000
MAX_LONG = (1 << 63) - 1


def expired(project_id: int, before: str | datetime) -> Column:
    return (F.col("project_id") == project_id) & (F.col("ts") < moment(before))


def delete_before(df: DataFrame, project_id: int, before: str | datetime) -> DataFrame:
    """The rows left after deleting one project's rows before a moment."""
    return df.filter(~expired(project_id, before))


def count_before(df: DataFrame, project_id: int, before: str | datetime) -> DataFrame:
    """How many rows that deletes."""
    return df.filter(expired(project_id, before)).agg(F.count(F.lit(1)).alias("deleted"))


def _with_cutoff(
    df: DataFrame, policies: DataFrame, days: str, now: str | datetime, max_rows: int
) -> DataFrame:
    keep = policies.filter("enabled").select(
        "project_id",
        F.when(
            F.col(days) > 0,
            F.timestamp_micros(F.unix_micros(moment(now)) - F.col(days).cast("bigint") * 86_400_000_000),
        ).alias("_cutoff"),
    )
    return lookup_join(df, keep, ["project_id"], "left", None, max_rows)


def apply_retention(
    df: DataFrame, policies: DataFrame, days: str, now: str | datetime, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows each project's policy keeps. `days` names the policy column of this table; 0 days, a
    disabled policy or no policy keeps everything."""
    marked = _with_cutoff(df, policies, days, now, max_rows)
    return marked.filter(F.col("_cutoff").isNull() | (F.col("ts") >= F.col("_cutoff"))).drop("_cutoff")


def retention_report(
    df: DataFrame, policies: DataFrame, days: str, now: str | datetime, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(project_id, deleted, kept) of the same policies, without changing anything."""
    gone = F.coalesce(F.col("ts") < F.col("_cutoff"), F.lit(False))
    return (
        _with_cutoff(df, policies, days, now, max_rows)
        .groupBy("project_id")
        .agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))
    )


def expire_daily(df: DataFrame, now: str | datetime, days: int = DAY_DAYS) -> DataFrame:
    """Day counters (column `day`) not older than `days`; use DIM_DAYS for dimension counters."""
    return df.filter(F.col("day") >= f"{days_back(now, days):%Y-%m-%d}")


def expire_monthly(df: DataFrame, now: str | datetime, days: int = MONTH_DAYS) -> DataFrame:
    first = F.date_format(F.lit(days_back(now, days).date()), MONTH)
    return df.filter(F.col("month") >= first)


def purge_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """Every table without the project's rows. On stored tables drop the project_id= folders."""
    return {name: df.filter(F.col("project_id") != project_id) for name, df in tables.items()}


def row_bytes(kind: str) -> Column:
    """Payload bytes plus the fixed overhead of a row."""

    def size(name: str) -> Column:
        return F.octet_length(F.coalesce(F.col(name), F.lit("")))

    if kind == "logs":
        return size("message") + size("fields") + LOG_OVERHEAD
    return size("data") + EVENT_OVERHEAD


def storage_of(df: DataFrame, kind: str, sample_size: int = 0) -> DataFrame:
    """(kind, count, sample_size, avg_row_bytes, est_bytes) of one project's table.

    The average is over the newest rows only (a top-N over two columns); the count reads none.
    """
    newest = DEFAULT_SAMPLE if sample_size <= 0 else min(sample_size, MAX_SAMPLE)
    sampled = (
        df.select("ts", "id", row_bytes(kind).alias("b"))
        .orderBy(F.desc("ts"), F.desc("id"))
        .limit(newest)
        .agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("sample_size"),
            F.coalesce(F.round(F.avg("b")), F.lit(0.0)).cast("bigint").alias("avg_row_bytes"),
        )
    )
    counted = df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("count"))
    return counted.join(F.broadcast(sampled), "kind").withColumn(
        "est_bytes",
        F.coalesce(F.try_multiply("count", "avg_row_bytes"), F.lit(MAX_LONG)),
    )


def storage_estimate(logs: DataFrame, events: DataFrame, sample_size: int = 500) -> DataFrame:
    """Both tables, and a `total` row."""
    parts = storage_of(logs, "logs", sample_size).unionByName(storage_of(events, "events", sample_size))
    total = parts.agg(
        F.lit("total").alias("kind"),
        F.sum("count").alias("count"),
        F.sum("sample_size").alias("sample_size"),
        F.lit(None).cast("bigint").alias("avg_row_bytes"),
        F.try_sum("est_bytes").alias("est_bytes"),
    )
    return parts.unionByName(total.withColumn("est_bytes", F.coalesce("est_bytes", F.lit(MAX_LONG))))


def boundary_day(before: str | datetime) -> str:
    """The one day that a delete rewrites; older days are dropped as whole folders."""
    return f"{as_datetime(before):%Y-%m-%d}"
