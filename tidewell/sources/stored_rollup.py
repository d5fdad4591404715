"""A stored daily rollup beside a fact table, with a list of the days that it covers, and readers that use both.

A day is recounted as a whole from its facts and its folder is replaced, so a refresh after late rows, deletes or a
failure gives the same counts. A day counts as covered only after that. Readers take covered whole days from the rollup
and read raw day folders for the others: the edge days of a range, and days nobody has counted yet.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.functions.times import as_datetime, between
from tidewell.operators.rollup import daily_rollup
from tidewell.operators.top_events import combined_top
from tidewell.sources.facts import _folder, delete_facts, drop_days, overwrite_days, read_facts

TRACK = schemas.TRACK_EVENTS


def _days(first: date, last: date) -> list[str]:
    return [f"{first + timedelta(days=i):%Y-%m-%d}" for i in range((last - first).days + 1)]


def _marker(rollup: str, project_id: int, day: str = "") -> str:
    return f"{rollup}_coverage/project_id={project_id}{'/' + day if day else ''}"


def covered_days(spark: SparkSession, rollup: str, project_id: int) -> set[str]:
    """The days of a project that the rollup holds completely: empty files named by day."""
    folder, fs = _folder(spark, _marker(rollup, project_id))
    return {s.getPath().getName() for s in fs.listStatus(folder)} if fs.exists(folder) else set()


def _set_covered(spark: SparkSession, rollup: str, project_id: int, days: list[str], covered: bool) -> None:
    for day in days:
        marker, fs = _folder(spark, _marker(rollup, project_id, day))
        if covered:
            fs.create(marker, True).close()
        else:
            fs.delete(marker, False)


def refresh_rollup(spark: SparkSession, facts: str, rollup: str, project_id: int, first: date, last: date) -> None:
    """Recount the days first to last of one project and mark them as covered; other days stay untouched."""
    days = _days(first, last)
    _set_covered(spark, rollup, project_id, days, False)
    rows = read_facts(spark, facts, project_id, schema=TRACK).filter(F.col("day").isin(days))
    for day in days:  # a day may have lost all its rows
        folder, fs = _folder(spark, f"{rollup}/project_id={project_id}/day={day}")
        fs.delete(folder, True)
    overwrite_days(daily_rollup(rows), rollup)
    spark.catalog.refreshByPath(rollup)
    _set_covered(spark, rollup, project_id, days, True)


def read_rollup(spark: SparkSession, rollup: str) -> DataFrame:
    """All covered and uncovered rows of a stored rollup; empty before the first refresh."""
    try:
        return spark.read.schema(schemas.TRACK_DAILY).parquet(rollup)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.TRACK_DAILY)


def top_events_stored(
    spark: SparkSession,
    facts: str,
    rollup: str,
    project_id: int,
    start: str | datetime,
    end: str | datetime,
    limit: int | None = None,
    q: str = "",
) -> DataFrame:
    """Exact top events of [start, end]: the rollup for covered whole days, raw day folders for all other days."""
    start, end = as_datetime(start), as_datetime(end)
    days = _days(start.date(), end.date())
    whole = [d for d in days if datetime.fromisoformat(d) >= start and datetime.combine(date.fromisoformat(d), time.max) <= end]
    counted = sorted(set(whole) & covered_days(spark, rollup, project_id))
    raw_days = sorted(set(days) - set(counted))
    raw = between(read_facts(spark, facts, project_id, schema=TRACK).filter(F.col("day").isin(raw_days)), start, end)
    daily = read_rollup(spark, rollup).filter((F.col("project_id") == project_id) & F.col("day").isin(counted))
    return combined_top(raw, daily, limit, q)


def enforce_retention(
    spark: SparkSession, tables: dict[str, tuple[str, str]], rollup: str, policies: DataFrame, now: str | datetime
) -> DataFrame:
    """Delete what the policies no longer keep from stored fact tables, and bring the rollup in line: (source, project_id, deleted).

    ``tables`` gives path and policy column by name. One policy after the other: whole days go as folders, only the
    cutoff day is rewritten. After track events are deleted, older days of the rollup go and the cutoff day is
    recounted. A run that failed is simply run again.
    """
    done = []
    for policy in policies.filter("enabled").toLocalIterator():  # one row per project
        for name, (path, column) in tables.items():
            if policy[column] <= 0:
                continue
            project, before = policy["project_id"], as_datetime(now) - timedelta(days=policy[column])
            done.append((name, project, delete_facts(spark, path, project, before)))
            if name == "track_events":
                old = drop_days(spark, rollup, project, f"{before:%Y-%m-%d}")
                gone = [d for d in covered_days(spark, rollup, project) if d < f"{before:%Y-%m-%d}"]
                _set_covered(spark, rollup, project, sorted({*old, *gone}), False)
                refresh_rollup(spark, path, rollup, project, before.date(), before.date())
    spark.catalog.refreshByPath(rollup)
    return spark.createDataFrame(done, "source string, project_id int, deleted bigint")
