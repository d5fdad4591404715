"""Reading values out of parsed JSON payloads (VARIANT columns)."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import normal, strip


def _quoted(key: str) -> str:
    return '["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def value_at(doc: Column, *keys: str | int) -> Column:
    """The value below object keys (text) and array positions (numbers), or null."""
    path = "$" + "".join(f"[{k}]" if isinstance(k, int) else _quoted(k) for k in keys)
    return F.try_variant_get(doc, path, "variant")


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def text_of(value: Column) -> Column:
    """The value if it is a JSON string, else null: numbers and objects do not count as text."""
    return F.when(is_text(value), value.cast("string"))


def text_at(doc: Column, *keys: str | int) -> Column:
    return text_of(value_at(doc, *keys))


def members(doc: Column, *names: str) -> Column:
    """The named members of an object as a struct of values, read in one pass."""
    shape = ", ".join(f"`{n}`: variant" for n in names)
    return F.try_variant_get(doc, "$", f"struct<{shape}>")


def field_at(doc: Column, path: str) -> Column:
    """Value at a dotted path, where a number is an object key or an array position.

    Null when any part is missing; a JSON null that is present stays a non-null VARIANT.
    """
    parts = [p.strip() for p in path.strip().split(".")]
    if not path.strip() or "" in parts:
        return F.lit(None).cast("variant")
    readings = [[p, int(p)] if re.fullmatch(r"\+?\d+", p) else [p] for p in parts]
    return F.coalesce(*[value_at(doc, *keys) for keys in itertools.product(*readings)])


def plain_text(value: Column) -> Column:
    """Text of a value: strings as they are, JSON null as empty, the rest as JSON."""
    return F.when(F.is_variant_null(value), F.lit("")).otherwise(value.cast("string"))


def normal_text(value: Column) -> Column:
    return normal(plain_text(value))


def tag_at(tags: Column, key: str) -> Column:
    """A tag from an object of tags or from a list of [key, value] pairs, trimmed.

    An object only gives string values; a pair gives any value as text.
    """
    from_object = text_at(tags, key)
    pairs = F.try_variant_get(tags, "$", "array<variant>")
    first = F.get(
        F.filter(
            pairs,
            lambda p: (F.try_variant_get(p, "$[0]", "string") == key)
            & F.try_variant_get(p, "$[1]", "variant").isNotNull(),
        ),
        F.lit(0),
    )
    from_pairs = F.try_variant_get(first, "$[1]", "string")
    return strip(F.coalesce(from_object, from_pairs))


def read_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns behind a one-element generator.

    A plain projection may be copied into every filter that reads it, so that each row is parsed
    several times. A generator is evaluated once per row and filters stay above it.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def moment_of(value: Column, fallback: Column) -> Column:
    """A timestamp from RFC 3339 text or from seconds since 1970, else the fallback."""
    # Fixed value: the RFC 3339 form.
    rfc3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"
    kind = F.schema_of_variant(value)
    text = value.cast("string")
    seconds = F.try_variant_get(value, "$", "double")
    return F.coalesce(
        F.when((kind == "STRING") & text.rlike(rfc3339), F.try_to_timestamp(text)),
        F.when(
            (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"),
            F.timestamp_micros(F.round(seconds * 1000000).cast("bigint")),
        ),
        fallback,
    )
