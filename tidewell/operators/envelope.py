"""Error envelopes: a header line, then items of a header line and a payload."""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.payload import read_once
from tidewell.functions.text import name_uuid
from tidewell.operators.ingest import Split

# Executors get this module's functions with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The reasons a text is not an envelope.
EMPTY_HEADER, NO_ITEMS, BAD_LENGTH, SHORT_BODY, BAD_HEADER = (
    "empty header", "no items", "invalid item length", "body shorter than item length", "bad header",
)


def _object(line: bytes) -> dict:
    value = json.loads(line)
    if not isinstance(value, dict):
        raise ValueError
    return value


def _cut_line(body: bytes) -> tuple[bytes, bytes]:
    line, _, rest = body.partition(b"\n")
    return line.replace(b"\r", b"").strip(), rest


def _cut_payload(body: bytes, header: dict) -> tuple[bytes, bytes]:
    """A payload of `length` bytes (then optional line ends), or the next line."""
    if "length" not in header:
        return _cut_line(body)
    length = header["length"]
    if isinstance(length, bool) or not isinstance(length, (int, float)) or int(length) < 0:
        raise LookupError(BAD_LENGTH)
    size = int(length)
    if len(body) < size:
        raise LookupError(SHORT_BODY)
    return body[:size], body[size:].lstrip(b"\r\n") if size else body


def read_envelope(text: str) -> dict:
    """The envelope id, its item count, and its first event item that is a JSON object."""
    found = {"event_id": None, "items": 0, "event": None, "error": None}
    try:
        line, rest = _cut_line(text.encode())
        if not line:
            raise LookupError(EMPTY_HEADER)
        sent_id = _object(line).get("event_id")
        found["event_id"] = sent_id if isinstance(sent_id, str) and sent_id else None
        while rest:
            line, rest = _cut_line(rest)
            if not line:
                continue
            header = _object(line)
            payload, rest = _cut_payload(rest, header)
            found["items"] += 1
            if header.get("type") == "event" and found["event"] is None:
                try:
                    _object(payload)
                    found["event"] = payload.decode()
                except ValueError:
                    pass
        if not found["items"]:
            raise LookupError(NO_ITEMS)
    except LookupError as problem:
        found["error"] = problem.args[0]
    except ValueError:
        found["error"] = BAD_HEADER
    return found


def _read_envelopes(bodies: pd.Series) -> pd.DataFrame:
    rows = [read_envelope(body or "") for body in bodies]
    return pd.DataFrame(rows, columns=["event_id", "items", "event", "error"]).astype({"items": "int32"})


def parse_envelopes(df: DataFrame, body: str = "body") -> Split:
    """Add event_id, items and event (JSON text, null without a usable event item)."""
    read = F.pandas_udf(_read_envelopes, "event_id string, items int, event string, error string")
    parsed = read_once(df, _e=read(body))
    rows = parsed.filter(F.col("_e.error").isNull()).select(*df.columns, "_e.event_id", "_e.items", "_e.event")
    rejects = parsed.filter(F.col("_e.error").isNotNull()).select(*df.columns, F.col("_e.error").alias("reason"))
    return Split(rows, rejects)


def envelope_messages(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """Parsed envelopes as (type, payload): the event, or the whole text when there is none.

    An envelope without an id gets one from its text, so that a retry keeps it; an event without
    an id takes the envelope's.
    """
    eid = F.coalesce("event_id", name_uuid(F.col(body)))
    doc = F.try_parse_json("event")
    has_id = F.schema_of_variant(F.try_variant_get(doc, "$.event_id", "variant")) == "STRING"
    inner = F.regexp_replace(F.col("event"), r"^\s*\{\s*", "")
    lead = F.regexp_replace(F.to_json(F.struct(eid.alias("event_id"))), r"\}$", "")
    filled = F.when(inner.rlike(r"^\}"), F.concat(lead, inner)).otherwise(F.concat(lead, F.lit(","), inner))
    raw = F.to_json(F.struct(eid.alias("event_id"), F.col(body).alias("raw")))
    return envelopes.withColumns(
        {
            "type": F.when(F.col("event").isNotNull(), "event").otherwise("envelope"),
            "payload": F.when(F.col("event").isNull(), raw)
            .when(F.coalesce(has_id, F.lit(False)), F.col("event"))
            .otherwise(filled),
        }
    )
