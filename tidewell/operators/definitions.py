"""Declared events and properties: labels, conformance, saved analyses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.skew import BROADCAST_ROWS, lookup_join
from tidewell.operators.custom import custom_events, custom_series, parse_request, property_text


def label_events(rows: DataFrame, definitions: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add display_name (the raw name if undeclared) and category by `name`."""
    declared = definitions.select("name", "display_name", "category")
    joined = lookup_join(rows, declared, ["name"], "left", None, max_rows)
    return joined.withColumn("display_name", F.coalesce("display_name", "name"))


def enum_conformance(logs: DataFrame, key: str, declared: list[str]) -> DataFrame:
    """Counts per value of an enum property; undeclared values are shown as `unknown`."""
    value = property_text(key)
    shown = F.when(value.isin(declared), value).otherwise("unknown")
    return logs.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("events"))


def number_conformance(logs: DataFrame, key: str) -> DataFrame:
    """Numeric values of a number property, and how many were ignored as non-numeric."""
    value = property_text(key)
    number = value.try_cast("double")
    return logs.agg(
        F.count(number).alias("numeric_values"),
        F.count_if(value.isNotNull() & number.isNull()).alias("ignored_values"),
        F.sum(number).alias("sum_value"),
    )


def run_saved_view(views: DataFrame, view_id: int, logs: DataFrame, now: str | datetime) -> DataFrame:
    """Run the analysis stored as JSON in one row of `views`."""
    row = views.filter(F.col("id") == view_id).select("query").first()
    if row is None:
        raise KeyError(f"no saved view {view_id}")
    ask = parse_request(row["query"], now)
    return custom_series(custom_events(logs, ask), ask)
