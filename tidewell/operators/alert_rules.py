"""Alert inputs, rules, and which rule matches which input."""

from __future__ import annotations

import itertools
import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions.payload import normal_text, read_once
from tidewell.functions.skew import BROADCAST_ROWS, lookup_join
from tidewell.functions.text import blank_to_null, normal, once, present, strip

# Executors get this module's functions with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sources, and the defaults of a rule's repeat settings (seconds and counts).
LOGS, EVENTS, BOTH = "logs", "events", "both"
WINDOW, THRESHOLD, BASE_BACKOFF, MAX_BACKOFF = 60, 1, 60, 3600
MISSING = "<missing>"
# So many different paths of a rule table become literals in the plan; any others are read by a path column.
LITERAL_PATHS = 100

# An input: `fields` is JSON text, `ids` a map of ids that are added to the fields.
INPUT = ["row_id", "project_id", "source", "ts", "level", "message", "fields", "ids"]
PLACE = "head string, single boolean, paths array<string>"
COMPILED = (
    "rule_id int, project_id int, rule_name string, rule_source string, levels array<string>, "
    f"event_names array<string>, keywords array<string>, checks array<struct<{PLACE}, op string, "
    "value string, options array<string>>>, window bigint, threshold bigint, base bigint, "
    f"ceiling bigint, by_message boolean, keys array<struct<name string, {PLACE}>>, targets string"
)


def _ids(**columns: str | Column) -> Column:
    pairs = [(F.lit(key), F.col(c) if isinstance(c, str) else c) for key, c in columns.items()]
    return F.create_map(*[part for key, value in pairs for part in (key, value.cast("string"))])


def with_fields(inputs: DataFrame) -> DataFrame:
    """Adds the parsed fields (`doc`) and the filled ids (`extra`) of inputs."""
    filled = F.map_filter("ids", lambda _, v: present(v))
    return read_once(inputs, doc=F.try_parse_json("fields"), extra=filled)


def _members(doc: Column) -> Column:
    """The members of an object as a map; empty for anything else."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    return F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), none)


def inputs_from_logs(logs: DataFrame, row_id: str = "id") -> DataFrame:
    ids = _ids(
        ingest_id="ingest_id", distinct_id="distinct_id", device_id="device_id",
        trace_id="trace_id", span_id="span_id",
    )
    return logs.select(
        F.col(row_id).cast("string").alias("row_id"), "project_id", F.lit(LOGS).alias("source"),
        "ts", "level", "message", "fields", ids.alias("ids"),
    )


def inputs_from_events(events: DataFrame) -> DataFrame:
    ids = _ids(
        event_id="id", distinct_id="distinct_id", device_id="device_id", os="os", platform="platform",
        release="release_tag", environment="environment", user_id="user_id",
    )
    return events.select(
        F.col("id").cast("string").alias("row_id"), "project_id", F.lit(EVENTS).alias("source"),
        "ts", "level", F.col("title").alias("message"), F.col("data").alias("fields"), ids.alias("ids"),
    )


def inputs_from_signals(signals: DataFrame) -> DataFrame:
    """Signals (see operators.monitors): `labels` is a map, `fields` is JSON text."""
    fields = _members(F.try_parse_json("fields"))
    labels = F.create_map(F.lit("labels"), F.to_variant_object("labels"))
    with_labels = F.when(
        F.size("labels") > 0, F.map_concat(F.map_filter(fields, lambda k, _: k != "labels"), labels)
    ).otherwise(fields)
    source = normal(F.col("source"))
    return signals.select(
        "row_id",
        "project_id",
        F.when(source.isin(LOGS, EVENTS), source).otherwise(BOTH).alias("source"),
        F.col("occurred_at").alias("ts"),
        strip(F.col("severity")).alias("level"),
        F.coalesce(blank_to_null(F.col("message")), strip(F.col("title"))).alias("message"),
        F.to_json(F.to_variant_object(with_labels)).alias("fields"),
        _ids(source_type=strip(F.col("source_type")), signal_status=strip(F.col("status"))).alias("ids"),
    )


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _low(value: object) -> str:
    return _text(value).strip().lower()


def _place(path: object) -> dict:
    """A dotted path as the JSON paths it can mean; a number is a key or an array position."""
    parts = [p.strip() for p in _text(path).strip().split(".")]
    if "" in parts:
        return {"head": "", "single": False, "paths": []}
    spell = [
        ["[" + json.dumps(p, ensure_ascii=False) + "]"] + ([f"[{int(p)}]"] if re.fullmatch(r"\+?\d+", p) else [])
        for p in parts
    ]
    return {
        "head": parts[0],
        "single": len(parts) == 1,
        "paths": ["$" + "".join(keys) for keys in itertools.product(*spell)],
    }


def _json_object(text: object) -> dict:
    try:
        value = json.loads(text) if isinstance(text, str) else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _names(value: object) -> list[str] | None:
    return [low for low in map(_low, value) if low] if isinstance(value, list) and value else None


def _positive(value: object, default: int) -> int:
    return int(value) if isinstance(value, (int, float)) and value > 0 else default


def compile_rule(rule: dict) -> dict:
    """Read one rule's JSON and fill the defaults; unreadable JSON reads as empty."""
    match, repeat = _json_object(rule["match"]), _json_object(rule["repeat"])
    base = _positive(repeat.get("baseBackoffSec"), BASE_BACKOFF)
    checks = [c for c in match.get("fieldsAll") or [] if isinstance(c, dict)]
    keys = sorted(_text(p) for p in repeat.get("dedupeFields") or [])
    return {
        "rule_id": rule["id"],
        "project_id": rule["project_id"],
        "rule_name": rule["name"],
        "rule_source": rule["source"],
        "levels": _names(match.get("levels")),
        "event_names": _names(match.get("eventNames")),
        "keywords": _names(match.get("messageKeywords")),
        "checks": [
            {
                **_place(c.get("path")),
                "op": c.get("op"),
                "value": _low(c.get("value")),
                "options": [_low(v) for v in c.get("values") or []],
            }
            for c in checks
        ],
        "window": _positive(repeat.get("windowSec"), WINDOW),
        "threshold": _positive(repeat.get("threshold"), THRESHOLD),
        "base": base,
        "ceiling": max(_positive(repeat.get("maxBackoffSec"), MAX_BACKOFF), base),
        "by_message": repeat.get("dedupeByMessage") is not False,
        "keys": [{"name": k, **_place(k)} for k in keys],
        "targets": rule["targets"],
    }


def compile_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules with their JSON read into columns."""
    names = StructType.fromDDL(COMPILED).fieldNames()

    def compile_part(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([compile_rule(r) for r in part.to_dict("records")], columns=names)

    columns = ["id", "project_id", "name", "source", "match", "repeat", "targets"]
    return rules.filter("enabled").select(*columns).mapInPandas(compile_part, COMPILED)


def routed() -> Column:
    """An input goes to rules of its source and to `both`; an input of `both` goes to all."""
    source, wanted = F.col("source"), F.col("rule_source")
    return (
        F.when(source.isin(LOGS, EVENTS), wanted.isin(BOTH) | (wanted == source))
        .otherwise(wanted.isin(LOGS, EVENTS, BOTH))
    )


def literal_paths(compiled: DataFrame) -> list[str]:
    """The paths that compiled rules read, if they are few."""
    places = F.concat(F.flatten("checks.paths"), F.flatten("keys.paths"))
    found = compiled.select(F.explode(places).alias("path")).distinct().limit(LITERAL_PATHS + 1).collect()
    return sorted(row.path for row in found) if len(found) <= LITERAL_PATHS else []


def _at(path: Column, known: list[str]) -> Column:
    """The value of the fields at a path. A path that is a column is parsed for every row, a literal one only once."""
    value = F.try_variant_get("doc", path, "variant")
    for text in known:
        value = F.when(path == text, F.try_variant_get("doc", text, "variant")).otherwise(value)
    return value


def _value(place: Column, known: list[str]) -> tuple[Column, Column]:
    """(added id, value in the fields) at a place; an added id hides the field of its name."""
    added = F.try_element_at("extra", place["head"])
    values = F.transform(place["paths"], lambda p: _at(p, known))
    return added, F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _found(place: Column, known: list[str]) -> Column:
    added, value = _value(place, known)
    return F.when(added.isNotNull(), place["single"]).otherwise(value.isNotNull())


def _normal_value(place: Column, known: list[str]) -> Column:
    """Trimmed lower-case text at a place, null if there is nothing."""
    added, value = _value(place, known)
    return F.when(added.isNotNull(), F.when(place["single"], normal(added))).otherwise(
        F.when(value.isNotNull(), normal_text(value))
    )


def _check_passes(check: Column, known: list[str]) -> Column:
    def judge(text: Column) -> Column:
        passes = (
            F.when(check["op"] == "eq", text == check["value"])
            .when(check["op"] == "contains", text.contains(check["value"]))
            .when(check["op"] == "in", (text != "") & F.array_contains(check["options"], text))
        )
        return F.coalesce(passes, F.lit(False))

    return F.when(check["op"] == "exists", _found(check, known)).otherwise(once(_normal_value(check, known), judge))


def text_matches() -> Column:
    """Levels, event names and message keywords; an absent part passes."""
    level, message = F.col("_level"), F.col("_message")

    def listed(names: str, value: Column) -> Column:
        return F.col(names).isNull() | ((value != "") & F.array_contains(names, value))

    keyword = F.col("keywords").isNull() | F.exists("keywords", lambda k: message.contains(k))
    is_event = F.col("event_names").isNull() | (level == "event")
    return listed("levels", level) & is_event & listed("event_names", message) & keyword


def field_matches(known: list[str]) -> Column:
    return F.forall("checks", lambda check: _check_passes(check, known))


def dedupe_text(known: list[str]) -> Column:
    """The text behind the dedupe key of a matched input."""
    message = F.when(F.col("by_message"), F.concat(F.lit("msg="), F.col("_message")))
    fields = F.transform(
        "keys",
        lambda k: F.concat(F.lit("f."), k["name"], F.lit("="), F.coalesce(_normal_value(k, known), F.lit(MISSING))),
    )
    return F.concat_ws(
        "|",
        F.concat(F.lit("rule="), F.col("rule_id").cast("string")),
        F.concat(F.lit("src="), F.col("source")),
        F.concat(F.lit("lvl="), strip(F.coalesce("level", F.lit("")))),
        message,
        fields,
    )


def route_inputs(inputs: DataFrame, compiled: DataFrame, condition: Column, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inputs with the rules of their project that pass `condition`.

    The rule table is small and broadcast, so the inputs are scanned once and never shuffled; a
    rule table beyond the limit is joined by project with salts.
    """
    prepared = inputs.withColumns({"_level": normal(F.col("level")), "_message": normal(F.col("message"))})
    return lookup_join(prepared, compiled, ["project_id"], "inner", condition, max_rows)


def match_rules(inputs: DataFrame, compiled: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input and matching rule, with the rule's settings and `key_hash`.

    Levels, names and keywords are tried first, so the fields are parsed only where those pass.
    """
    candidates = route_inputs(inputs, compiled, routed() & text_matches(), max_rows)
    known = literal_paths(compiled)
    matched = with_fields(candidates).filter(field_matches(known))
    return matched.withColumn("key_hash", F.sha2(dedupe_text(known), 256)).drop(
        "_level", "_message", "levels", "event_names", "keywords", "checks", "keys", "by_message", "rule_source", "targets"
    )


def preview_rows(inputs: DataFrame, compiled: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per input and rule it is routed to, with `matched` and, for matches, `key_hash`."""
    rows = with_fields(route_inputs(inputs, compiled, routed(), max_rows))
    known = literal_paths(compiled)
    key = F.when(F.col("matched"), F.sha2(dedupe_text(known), 256))
    return read_once(rows, matched=text_matches() & field_matches(known)).withColumn("key_hash", key).drop(
        "_level", "_message", "levels", "event_names", "keywords", "checks", "keys", "by_message", "rule_source", "targets"
    )


def fields_json() -> Column:
    """Fields of an input (see with_fields) with its added ids, as JSON text with sorted keys."""
    added = F.transform_values("extra", lambda _, v: v.cast("variant"))
    kept = F.map_filter(_members(F.col("doc")), lambda k, _: ~F.map_contains_key("extra", k))
    merged = F.map_concat(kept, added)
    return F.to_json(F.to_variant_object(merged))


def with_notification(matched: DataFrame, prefix: str = "[alert]") -> DataFrame:
    """Adds title and content. Their wording and order, which receivers read."""
    head = F.format_string(
        "project_id=%d source=%s level=%s message=%s",
        F.col("project_id"), F.col("source"),
        strip(F.coalesce("level", F.lit(""))), strip(F.coalesce("message", F.lit(""))),
    )
    fields = fields_json()
    content = F.when(fields != "{}", F.concat(head, F.lit("\nfields="), fields)).otherwise(head)
    title = F.concat(F.lit(f"{prefix} Rule "), F.col("rule_name"), F.lit(" triggered"))
    return matched.withColumns({"title": title, "content": content})
