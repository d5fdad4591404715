"""Joins and group keys that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import written_once

# A broadcast side stays below this many rows (rule, policy, label and range tables).
BROADCAST_ROWS = 500_000
# A hash window may hold this many rows of one key; all hotter keys take another way to the same result.
WINDOW_ROWS = 1_000_000
SALTS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counts at most max_rows + 1 rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    condition: Column | None = None,
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a table that is usually small; `lookup` columns must not clash beyond `on`.

    Broadcast while the lookup is below `max_rows`. Beyond that, each lookup row is copied once
    per salt and the rows are spread over the salts, so that a hot key is joined by `salts` tasks.
    The salt is a hash of the row, so a recomputed task gives the same split.
    """
    if is_small(lookup, max_rows):
        keys = on
        side = F.broadcast(lookup)
    else:
        salt = F.pmod(F.xxhash64(*[rows[c] for c in rows.columns if _hashable(rows, c)]), F.lit(salts))
        rows = rows.withColumn("_salt", salt)
        side = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        keys = [*on, "_salt"]
    if condition is None:
        return rows.join(side, keys, how).drop("_salt")
    renamed = side.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in side.columns])
    match = condition
    for key in keys:
        match = match & (F.col(key) == F.col(f"_r_{key}"))
    return rows.join(renamed, match, how).drop("_salt", *[f"_r_{k}" for k in keys])


def _hashable(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType.typeName()
    return kind not in ("map", "variant")


def hot_keys(rows: DataFrame, key: str, min_rows: int = WINDOW_ROWS) -> DataFrame:
    """All keys with more than `min_rows` rows, written once; they stay a frame, however many there are.

    The count is combined before its shuffle.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_rows)
    return written_once(counts.select(key))


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a frame of narrow rows if it is counted to be small; otherwise the join shuffles."""
    return F.broadcast(df) if is_small(df, max_rows) else df
