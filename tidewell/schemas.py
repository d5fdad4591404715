"""Column layouts of the stored tables and of the JSON payloads."""

from __future__ import annotations

# Table columns, as Spark DDL.
LOGS = (
    "id string, project_id int, ts timestamp, ingest_id string, level string, distinct_id string, "
    "device_id string, trace_id string, span_id string, message string, fields string"
)
ERROR_EVENTS = (
    "id string, project_id int, ts timestamp, level string, distinct_id string, device_id string, "
    "os string, browser string, platform string, release_tag string, environment string, "
    "user_id string, title string, data string"
)
TRACK_EVENTS = (
    "project_id int, ts timestamp, ingest_id string, name string, distinct_id string, device_id string"
)
TRACK_DAILY = "project_id int, day string, name string, distinct_id string, events bigint"
MESSAGE = (
    "type string, project_id string, received timestamp, message_id string, payload string, "
    "meta struct<client_ip: string, user_agent: string>"
)
RULES = (
    "id int, project_id int, name string, enabled boolean, source string, "
    "match string, repeat string, targets string"
)
STATES = (
    "rule_id int, key_hash string, occurrences bigint, backoff_exp int, "
    "last_seen timestamp, last_sent timestamp, next_allowed timestamp"
)
DELIVERIES = (
    "id bigint, project_id int, rule_id int, channel_type string, target string, title string, "
    "content string, status string, attempts int, next_attempt_at timestamp, last_error string, "
    "created_at timestamp, updated_at timestamp"
)

# The JSON shapes of a rule.
RULE_MATCH = (
    "levels array<string>, eventNames array<string>, messageKeywords array<string>, "
    "fieldsAll array<struct<path: string, op: string, value: variant, values: array<variant>>>"
)
RULE_REPEAT = (
    "windowSec bigint, threshold bigint, baseBackoffSec bigint, maxBackoffSec bigint, "
    "dedupeByMessage boolean, dedupeFields array<string>"
)
RULE_TARGETS = (
    "emailGroupIds array<int>, emailContactIds array<int>, smsGroupIds array<int>, "
    "smsContactIds array<int>, wecomBotIds array<int>, webhookEndpointIds array<int>, "
    "channels array<struct<type: string, config: variant>>"
)
