"""Retention, purge and storage estimates over the events table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidewell.functions.times import day_key, month_key
from tidewell.operators import active, distribution, lifecycle
from tidewell.plans.analytics import ACTIVITY, ENRICHED, PAIRS, _activity, _enriched
from tidewell.plans.model_sql import day, errors, logs, track
from tidewell.plans.registry import query
from tidewell.session import run_dir
from tidewell.sources import facts, stored_rollup, tables

NOW = "2024-01-31 00:00:00"
BEFORE = "2024-01-12 07:30:00"

COUNTS = "COUNT(*) FILTER (project_id = 2 AND ts < TIMESTAMP '2024-01-12 07:30:00')"


@query("delete_before", f"""WITH {track(3)} SELECT CAST(project_id AS INTEGER) AS project_id, COUNT(*) AS n
      FROM track_events WHERE NOT (project_id = 2 AND ts < TIMESTAMP '{BEFORE}') GROUP BY project_id""")
def _(spark, sf):
    left = lifecycle.delete_before(tables.track_events(spark, sf, 3), 2, BEFORE)
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("delete_before_count", f"WITH {track(3)} SELECT {COUNTS} AS deleted FROM track_events")
def _(spark, sf):
    return lifecycle.count_before(tables.track_events(spark, sf, 3), 2, BEFORE)


def _policies(spark):
    """Project 1 keeps 20 / 10 / all days, project 2 is disabled, project 3 keeps 5 days of track events."""
    return spark.createDataFrame(
        [(1, True, 20, 10, 0), (2, False, 1, 1, 1), (3, True, 0, 0, 5)],
        "project_id int, enabled boolean, logs_days int, events_days int, track_events_days int",
    )


def _kept(table: str, rule: str) -> str:
    return f"""SELECT '{table}' AS source, CAST(project_id AS INTEGER) AS project_id, COUNT(*) FILTER ({rule}) AS deleted,
        COUNT(*) FILTER (NOT ({rule})) AS kept FROM {table} GROUP BY project_id"""


@query(
    "apply_retention",
    f"""WITH {logs(3)}, {errors(3)}, {track(3)}
      {_kept('logs', "project_id = 1 AND ts < TIMESTAMP '2024-01-11'")} UNION ALL
      {_kept('error_events', "project_id = 1 AND ts < TIMESTAMP '2024-01-21'")} UNION ALL
      {_kept('track_events', "project_id = 3 AND ts < TIMESTAMP '2024-01-26'")}""",
)
def _(spark, sf):
    sources = {
        "logs": (tables.track_logs(spark, sf, 3), "logs_days"),
        "error_events": (tables.error_events(spark, sf, 3), "events_days"),
        "track_events": (tables.track_events(spark, sf, 3), "track_events_days"),
    }
    policies = _policies(spark)
    out = None
    for name, (rows, days) in sources.items():
        part = lifecycle.retention_report(rows, policies, days, NOW).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "enforce_retention",
    f"""WITH {logs(3)}, {track(3)}, left_logs AS (SELECT * FROM logs WHERE NOT (project_id = 1 AND ts < TIMESTAMP '2024-01-11')),
        left_track AS (SELECT * FROM track_events WHERE NOT (project_id = 3 AND ts < TIMESTAMP '2024-01-26 12:00:00')
          AND NOT (project_id = 1 AND ts < TIMESTAMP '2024-01-16 12:00:00'))
      SELECT 'logs' AS source, CAST(project_id AS INTEGER) AS project_id, {day('ts')} AS day, COUNT(*) AS n FROM left_logs GROUP BY ALL
      UNION ALL SELECT 'track_events', CAST(project_id AS INTEGER), {day('ts')}, COUNT(*) FROM left_track GROUP BY ALL
      UNION ALL SELECT 'rollup', CAST(project_id AS INTEGER), {day('ts')}, COUNT(*) FROM left_track GROUP BY ALL
      UNION ALL SELECT 'deleted', 3, '', COUNT(*) FROM track_events WHERE project_id = 3 AND ts < TIMESTAMP '2024-01-26 12:00:00'""",
)
def _(spark, sf):
    """Policies on stored tables, with a cutoff inside a day; facts and rollup agree afterwards."""
    path = run_dir(spark, "retention")
    at = {name: f"{path}/{name}" for name in ("logs", "track_events")}
    facts.write_facts(tables.track_logs(spark, sf, 3), at["logs"])
    facts.write_facts(tables.track_events(spark, sf, 3), at["track_events"])
    for project in (1, 2, 3):
        stored_rollup.refresh_rollup(spark, at["track_events"], f"{path}/daily", project, date(2024, 1, 1), date(2024, 1, 31))
    policies = [
        spark.createDataFrame([(1, True, 20, 0), (2, False, 1, 1)], "project_id int, enabled boolean, logs_days int, track_events_days int"),
        spark.createDataFrame([(1, True, 0, 15), (3, True, 0, 5)], "project_id int, enabled boolean, logs_days int, track_events_days int"),
    ]
    named = {name: (place, f"{name}_days") for name, place in at.items()}
    done = [stored_rollup.enforce_retention(spark, named, f"{path}/daily", p, now) for p, now in zip(policies, (NOW, "2024-01-31 12:00:00"))]
    daily = stored_rollup.read_rollup(spark, f"{path}/daily").groupBy("project_id", "day").agg(F.sum("events").alias("n"))
    shown = daily.select(F.lit("rollup").alias("source"), "project_id", "day", "n")
    for name, place in at.items():
        counts = facts.read_facts(spark, place).groupBy("project_id", "day").agg(F.count(F.lit(1)).alias("n"))
        shown = shown.unionByName(counts.select(F.lit(name).alias("source"), "project_id", "day", "n"))
    deleted = done[1].filter("source = 'track_events' AND project_id = 3")
    return shown.unionByName(deleted.select(F.lit("deleted").alias("source"), "project_id", F.lit("").alias("day"), F.col("deleted").alias("n")))


@query(
    "apply_retention_rows",
    f"""WITH {track(3)} SELECT ingest_id FROM track_events WHERE NOT (project_id = 3 AND ts < TIMESTAMP '2024-01-26')""",
)
def _(spark, sf):
    rows = lifecycle.apply_retention(tables.track_events(spark, sf, 3), _policies(spark), "track_events_days", NOW)
    return rows.select("ingest_id")


@query(
    "expire_metrics",
    f"""{ACTIVITY} SELECT {day('ts')} AS day, COUNT(*) AS n FROM activity
      WHERE {day('ts')} >= '2024-01-16' GROUP BY 1""",
)
def _(spark, sf):
    days = _activity(spark, sf).groupBy(day_key(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return lifecycle.expire_daily(days, "2024-07-14 12:00:00")


@query(
    "expire_metrics_dims",
    f"""{ENRICHED}, {PAIRS} SELECT {day('ts')} AS day, dim, key, COUNT(*) AS count FROM pairs
      WHERE {day('ts')} >= '2024-01-16' GROUP BY ALL""",
)
def _(spark, sf):
    daily = distribution.daily_dims(distribution.fan_out_dims(_enriched(spark, sf)))
    return lifecycle.expire_daily(daily, "2024-04-15 12:00:00", lifecycle.DIM_DAYS)


@query(
    "expire_metrics_months",
    f"{ACTIVITY} SELECT strftime(ts, '%Y-%m') AS month, COUNT(*) AS n FROM activity WHERE strftime(ts, '%Y-%m') >= '2024-01' GROUP BY 1",
)
def _(spark, sf):
    months = _activity(spark, sf).groupBy(month_key(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return lifecycle.expire_monthly(months, "2025-07-20 00:00:00")


def _estimate(kind: str, table: str, size: str) -> str:
    return f"""SELECT '{kind}' AS kind, (SELECT COUNT(*) FROM {table}) AS count, COUNT(*) AS sample_size,
        CAST(round(AVG(b)) AS BIGINT) AS avg_row_bytes FROM (
          SELECT {size} AS b FROM {table} WHERE project_id = 1 ORDER BY ts DESC, id DESC LIMIT 500)"""


@query(
    "storage_estimate",
    f"""WITH {logs()}, {errors()}, parts AS (
        SELECT *, count * avg_row_bytes AS est_bytes FROM (
          {_estimate('logs', 'logs', 'strlen(message) + strlen(fields) + 120')} UNION ALL
          {_estimate('events', 'error_events', 'strlen(data) + 96')}))
      SELECT * FROM parts UNION ALL
      SELECT 'total', CAST(SUM(count) AS BIGINT), CAST(SUM(sample_size) AS BIGINT), NULL, CAST(SUM(est_bytes) AS BIGINT) FROM parts""",
)
def _(spark, sf):
    return lifecycle.storage_estimate(tables.track_logs(spark, sf), tables.error_events(spark, sf))


@query(
    "purge_project",
    f"""WITH {logs(3)}, {errors(3)}, {track(3)}, rows AS (
        SELECT 'logs' AS source, project_id FROM logs UNION ALL SELECT 'events', project_id FROM error_events
        UNION ALL SELECT 'track_events', project_id FROM track_events)
      SELECT source, CAST(project_id AS INTEGER) AS project_id, COUNT(*) AS n FROM rows WHERE project_id <> 2 GROUP BY ALL""",
)
def _(spark, sf):
    left = lifecycle.purge_project(
        {
            "logs": tables.track_logs(spark, sf, 3),
            "events": tables.error_events(spark, sf, 3),
            "track_events": tables.track_events(spark, sf, 3),
        },
        2,
    )
    out = None
    for name, rows in left.items():
        part = rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
