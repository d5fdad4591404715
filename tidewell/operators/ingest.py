"""From raw payloads and queue messages to table rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import identity
from tidewell.functions.payload import members, moment_of, read_once, text_at, text_of
from tidewell.functions.text import blank_to_null, canonical_uuid, name_uuid, present, strip, uuid_form

# The message types.
EVENT, ENVELOPE, LOG = "event", "envelope", "log"


class Split(NamedTuple):
    """Rows to keep, and rejected rows with a `reason`. Nothing is dropped silently."""

    rows: DataFrame
    rejects: DataFrame


def split_by_reason(df: DataFrame, reason: Column) -> Split:
    marked = df.withColumn("reason", reason)
    return Split(marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull()))


def decode_batch(df: DataFrame, body: str = "body") -> Split:
    """A body is one JSON object or a non-empty array of objects: one output row per item.

    Adds `item_no` and `item` (VARIANT). A body is taken whole or rejected whole.
    """
    text = strip(F.col(body))
    doc = F.try_parse_json(text)
    items = F.when(text.startswith("["), F.try_variant_get("_doc", "$", "array<variant>")).otherwise(F.array("_doc"))
    kinds = F.transform("_items", F.schema_of_variant)
    reason = (
        F.when(text.isNull() | (text == ""), "empty body")
        .when(F.col("_doc").isNull(), "bad json")
        .when(F.size("_items") == 0, "empty array")
        .when(F.exists(kinds, lambda k: ~k.startswith("OBJECT")), "item is not an object")
    )
    split = split_by_reason(read_once(df, _doc=doc).withColumn("_items", items), reason)
    rows = split.rows.select(*df.columns, F.posexplode("_items").alias("item_no", "item"))
    return Split(rows, split.rejects.select(*df.columns, "reason"))


def mark_messages(df: DataFrame, value: str = "value") -> DataFrame:
    """Queue messages `{type, project_id, received, payload, meta}` with a VARIANT payload, and why one is unusable.

    Other columns of `df` (such as message_id) stay. Undecodable messages, unknown types and bad project ids have a
    `reason`; they would fail again on a retry.
    """
    kept = [c for c in df.columns if c != value]
    message = members(F.try_parse_json(value), "type", "project_id", "received", "payload", "meta")
    parsed = read_once(df, _m=message).select(
        *kept,
        value,
        text_of(F.col("_m.type")).alias("type"),
        text_of(F.col("_m.project_id")).try_cast("int").alias("project_id"),
        moment_of(F.col("_m.received"), F.lit(None).cast("timestamp")).alias("received"),
        F.col("_m.payload").alias("payload"),
        text_at(F.col("_m.meta"), "client_ip").alias("client_ip"),
        text_at(F.col("_m.meta"), "user_agent").alias("user_agent"),
        F.col("_m").isNull().alias("_bad"),
    )
    reason = (
        F.when(F.col("_bad"), "undecodable message")
        .when(F.col("type").isNull() | ~F.col("type").isin(EVENT, ENVELOPE, LOG), "unknown type")
        .when(F.col("project_id").isNull() | (F.col("project_id") <= 0), "bad project id")
        .when(
            F.col("payload").isNull() | members(F.col("payload"), "timestamp").isNull(),
            "undecodable payload",
        )
    )
    return parsed.withColumn("reason", reason).drop("_bad")


def decode_messages(df: DataFrame, value: str = "value") -> Split:
    """The usable messages of mark_messages, and the rejected ones with their reason."""
    kept = [c for c in df.columns if c != value]
    split = split_by_reason(mark_messages(df, value), F.col("reason"))
    return Split(split.rows.drop(value), split.rejects.select(*kept, value, "type", "reason"))


def log_payloads(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The fields of a log payload as columns; `fields` is JSON text, null when absent."""
    names = ["level", "message", "timestamp", "device_id", "trace_id", "span_id", "user", "fields"]
    part = {name: F.col(f"_p.{name}") for name in names}
    texts = {name: text_of(part[name]) for name in ("level", "message", "device_id", "trace_id", "span_id")}
    return (
        read_once(df, _p=members(F.col(payload), *names))
        .withColumns(
            {
                **texts,
                "ts": moment_of(part["timestamp"], F.lit(None).cast("timestamp")),
                "user_id": identity.user_id(part["user"]),
                "fields_device_id": text_at(part["fields"], "device_id"),
                "fields": F.to_json(part["fields"]),
            }
        )
        .drop("_p", payload)
    )


def mark_logs(df: DataFrame) -> DataFrame:
    """A blank message is a `reason` for rejection, a blank level is `info`, a missing time is the arrival time."""
    return df.withColumns(
        {
            "level": F.when(blank_to_null(F.col("level")).isNull(), "info").otherwise(F.col("level")),
            "ts": F.coalesce("ts", "received"),
            "reason": F.when(blank_to_null(F.col("message")).isNull(), "blank message"),
        }
    )


def normalize_logs(df: DataFrame) -> Split:
    """The usable rows of mark_logs, and the rejected ones with their reason."""
    return split_by_reason(mark_logs(df), F.col("reason"))


def track_to_log(df: DataFrame) -> Split:
    """Track events (name, properties) as log rows of level `event`; blank names are rejected."""
    mapped = df.withColumns(
        {
            "level": F.lit("event"),
            "message": strip(F.coalesce("name", F.lit(""))),
            "fields": F.col("properties"),
            "ts": F.coalesce("ts", "received"),
        }
    ).drop("name", "properties")
    return split_by_reason(mapped, F.when(F.col("message") == "", "blank name"))


def log_identity(user: Column, device: Column, field_device: Column) -> tuple[Column, Column]:
    """(distinct id, device id) of a log: user, else device, else the device named in its fields.

    The device in the fields only counts, for both columns, when neither user nor device is set.
    """
    device = strip(F.coalesce(device, F.lit("")))
    spare = F.when(~present(user) & (device == ""), strip(field_device))
    device = F.coalesce(spare, device)
    return F.when(present(user), user).otherwise(device), device


def build_log_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Decoded log payloads that have a time, as rows of `logs` (see log_rows)."""
    return log_rows(df.filter(F.col("ts").isNotNull()), keep)


def log_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Decoded log payloads (see log_payloads) in the columns of `logs`; the columns in ``keep`` stay too.

    The ingest id is the id of the queue message, so a redelivery carries the same one.
    """
    distinct, device = log_identity(F.col("user_id"), F.col("device_id"), F.col("fields_device_id"))

    def trimmed(name: str) -> Column:
        return strip(F.coalesce(name, F.lit(""))).alias(name)

    return df.select(
        "project_id",
        "ts",
        F.col("message_id").alias("ingest_id"),
        trimmed("level"),
        distinct.alias("distinct_id"),
        device.alias("device_id"),
        trimmed("trace_id"),
        trimmed("span_id"),
        "message",
        F.coalesce("fields", F.lit("null")).alias("fields"),
        *keep,
    )


def derive_track_events(logs: DataFrame) -> DataFrame:
    """Log rows of level `event` with a name and a user, as rows of `track_events`."""
    name, who = blank_to_null(F.col("message")), blank_to_null(F.col("distinct_id"))
    return logs.filter((strip(F.col("level")) == "event") & name.isNotNull() & who.isNotNull()).select(
        "project_id",
        "ts",
        "ingest_id",
        name.alias("name"),
        who.alias("distinct_id"),
        strip(F.col("device_id")).alias("device_id"),
    )


def with_event_id(payload: Column, sent: Column, event_id: Column) -> Column:
    """The payload as JSON text. An id that is missing or not a UUID (`sent` is null) is replaced
    by the row's id; a UUID keeps the spelling the client used."""
    others = F.map_filter(F.try_variant_get(payload, "$", "map<string,variant>"), lambda k, _: k != "event_id")
    merged = F.map_concat(others, F.create_map(F.lit("event_id"), event_id.cast("variant")))
    return F.when(sent.isNotNull(), F.to_json(payload)).otherwise(F.to_json(F.to_variant_object(merged)))


def normalize_error_events(
    df: DataFrame, payload: str = "payload", missing_id: Column | None = None, keep: Sequence[str] = ("client_ip",)
) -> DataFrame:
    """Raw error events (VARIANT payload, project_id, received) as rows of `events`; columns in ``keep`` stay, if there.

    `missing_id` gives the id of an event sent without one. The default is random; pass an id
    derived from the message to keep it stable when a task or a message is repeated.
    """
    names = [
        "event_id", "timestamp", "level", "platform", "release", "environment",
        "message", "exception", "user", "tags", "contexts", "extra",
    ]
    part = {name: F.col(f"_p.{name}") for name in names}
    kept = [c for c in keep if c in df.columns]
    raw_id = text_of(part["event_id"])
    missing = F.expr("uuid()") if missing_id is None else missing_id
    read = read_once(df, _p=members(F.col(payload), *names)).select(
        raw_id.alias("_raw_id"),
        uuid_form(raw_id).alias("_sent"),
        missing.alias("_missing"),
        "project_id",
        moment_of(part["timestamp"], F.col("received")).alias("ts"),
        *[
            F.coalesce(text_of(part[name]), F.lit("")).alias(name)
            for name in ("level", "platform", "release", "environment")
        ],
        identity.user_id(part["user"]).alias("_user"),
        identity.device_id(part["tags"], part["contexts"], part["extra"]).alias("device_id"),
        identity.named_version(part["contexts"], "os").alias("os"),
        identity.named_version(part["contexts"], "browser").alias("browser"),
        identity.stored_user_id(part["user"]).alias("user_id"),
        identity.title(part["message"], part["exception"]).alias("title"),
        payload,
        *kept,
    )
    named = read.withColumn("id", canonical_uuid(F.col("_raw_id"), F.col("_sent"), F.col("_missing")))
    return named.select(
        "id", "project_id", "ts", "level",
        identity.distinct_id(F.col("_user"), F.col("device_id")).alias("distinct_id"),
        identity.distinct_source(F.col("_user"), F.col("device_id")).alias("distinct_source"),
        "device_id", "os", "browser", "platform", F.col("release").alias("release_tag"), "environment",
        "user_id", "title",
        with_event_id(F.col(payload), F.col("_sent"), F.col("id")).alias("data"),
        *kept,
    )


def message_uuid(*parts: str) -> Column:
    """A stable id from the columns that identify a message."""
    return name_uuid(F.concat_ws("|", *parts))


