"""Retention: of the users active on a day, how many are active k days later."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.times import DAY, between, day_calendar, whole_days
from tidewell.operators.active import daily_sketches

# The offsets in days if none is asked for.
DEFAULT_OFFSETS = [1, 7, 30]
# A word of the bitmap has 2^6 days.
WORD_BITS = 6


def clean_offsets(offsets: list[int] | None, most: int | None = None, furthest: int | None = None) -> list[int]:
    """Distinct positive offsets; more than ``most`` of them or one beyond ``furthest`` is an error, if these are given."""
    kept = sorted({k for k in offsets or [] if k > 0})
    if most is not None and len(kept) > most:
        raise ValueError(f"at most {most} offsets can be asked for, not {len(kept)}")
    if furthest is not None and kept and kept[-1] > furthest:
        raise ValueError(f"an offset is at most {furthest} days, not {kept[-1]}")
    return kept or DEFAULT_OFFSETS


def _word(number: int, position: Column) -> Column:
    """One 64-day word of a user's activity bitmap."""
    bit = F.when(
        F.shiftright(position, WORD_BITS) == number,
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int")),
    ).otherwise(F.lit(0).cast("bigint"))
    return F.bit_or(bit)


def user_days(rows: DataFrame, first: date, days: int) -> DataFrame:
    """One row per user with `words`: a bitmap of the active days counted from `first`.

    A user's rows shrink to a few 64-bit numbers before the shuffle, however many there are.
    """
    position = F.datediff(F.to_date("ts"), F.lit(first))
    last = first + timedelta(days=days - 1)
    inside = between(rows, f"{first} 00:00:00", f"{last} 23:59:59.999999").filter(F.col("distinct_id").isNotNull())
    words = [_word(w, position).alias(f"w{w}") for w in range((days + 63) // 64)]
    grouped = inside.groupBy("distinct_id").agg(*words)
    return grouped.select("distinct_id", F.array(*[F.col(f"w{w}") for w in range(len(words))]).alias("words"))


def _is_active(words: Column, position: Column) -> Column:
    word = F.get(words, F.shiftright(position, WORD_BITS))
    bit = F.pmod(position, F.lit(64)).cast("int")
    return F.call_function("bit_get", word, bit) == 1


def retention(
    rows: DataFrame, start: str | datetime, end: str | datetime, offsets: list[int] | None = None
) -> DataFrame:
    """(cohort, day, cohort_size, active, rate): one row per cohort day and offset.

    The cohort of a day is every user active on it. Each user carries its days as a bitmap, so
    a cohort day finds its later days without a join.
    """
    wanted = clean_offsets(offsets)
    first, last = whole_days(start, end)
    cohort_days = (last - first).days + 1
    users = user_days(rows, first, cohort_days + max(wanted))
    each_day = users.select(
        "words",
        F.explode(
            F.filter(
                F.sequence(F.lit(0), F.lit(cohort_days - 1)), lambda d: _is_active(F.col("words"), d)
            )
        ).alias("d"),
    )
    counts = each_day.groupBy("d").agg(
        F.count(F.lit(1)).alias("size"),
        *[F.count_if(_is_active(F.col("words"), F.col("d") + k)).alias(f"k{k}") for k in wanted],
    )
    counts = counts.withColumn("cohort", F.date_format(F.date_add(F.lit(first), F.col("d")), DAY))
    return _points(day_calendar(rows.sparkSession, first, last), counts, wanted)


def _points(calendar: DataFrame, counts: DataFrame, wanted: list[int]) -> DataFrame:
    joined = calendar.withColumnRenamed("day", "cohort").join(counts, "cohort", "left")
    size = F.coalesce("size", F.lit(0))
    points = F.array(
        *[F.struct(F.lit(k).alias("day"), F.coalesce(f"k{k}", F.lit(0)).alias("active")) for k in wanted]
    )
    return joined.select("cohort", size.alias("cohort_size"), F.inline(points)).withColumn(
        "rate", F.when(F.col("cohort_size") > 0, F.col("active") / F.col("cohort_size")).otherwise(0.0)
    )


def retention_approx(
    rows: DataFrame, start: str | datetime, end: str | datetime, offsets: list[int] | None = None
) -> DataFrame:
    """The same from daily sketches: size(A) + size(B) - size(A or B), not below 0."""
    wanted = clean_offsets(offsets)
    first, last = whole_days(start, end)
    sketches = daily_sketches(rows)
    cohorts = sketches.filter(F.col("day").between(str(first), str(last)))
    pairs = cohorts.select(
        F.col("day").alias("cohort"),
        F.col("sketch").alias("a"),
        F.explode(F.array(*[F.lit(k) for k in wanted])).alias("k"),
    ).withColumn("day", F.date_format(F.date_add(F.to_date("cohort"), F.col("k")), DAY))
    later = sketches.filter(F.col("day") <= str(last + timedelta(days=max(wanted)))).withColumnRenamed("sketch", "b")
    both = pairs.join(later, "day", "left").select(
        "cohort",
        "k",
        F.hll_sketch_estimate("a").alias("size"),
        F.coalesce(
            F.greatest(
                F.hll_sketch_estimate("a") + F.hll_sketch_estimate("b")
                - F.hll_sketch_estimate(F.hll_union("a", "b")),
                F.lit(0),
            ),
            F.lit(0),
        ).alias("n"),
    )
    counts = both.groupBy("cohort").agg(
        F.first("size").alias("size"),
        *[F.max(F.when(F.col("k") == k, F.col("n"))).alias(f"k{k}") for k in wanted],
    )
    return _points(day_calendar(rows.sparkSession, first, last), counts, wanted)
