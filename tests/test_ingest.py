"""Payloads, identity, envelopes, dedupe: literals in, literals out."""

import datetime as dt
import itertools
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.functions import identity
from tidewell.functions.payload import field_at, moment_of, plain_text, read_once, value_at
from tidewell.functions.text import canonical_uuid, name_uuid, uuid_form
from tidewell.operators import dedupe, envelope, ingest


def docs(spark, *payloads):
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return read_once(spark.createDataFrame(rows, "n int, body string"), doc=F.try_parse_json("body"))


def values(df, column):
    return [r[0] for r in df.select("n", column.alias("v")).orderBy("n").select("v").collect()]


def part(name):
    return value_at(F.col("doc"), name)


def test_decode_batch(spark):
    bodies = spark.createDataFrame(
        [(i, b) for i, b in enumerate([" ", "[]", "{", None, '[{"message":"a"},{"message":"b"}]', ' {"message":"a"}', "[1]"])],
        "n int, body string",
    )
    rows, rejects = ingest.decode_batch(bodies)
    found = rows.selectExpr("n", "item_no", "variant_get(item, '$.message', 'string') m").collect()
    assert sorted(map(tuple, found)) == [(4, 0, "a"), (4, 1, "b"), (5, 0, "a")]
    reasons = {r["n"]: r["reason"] for r in rejects.collect()}
    assert reasons == {
        0: "empty body", 1: "empty array", 2: "bad json", 3: "empty body", 6: "item is not an object",
    }


GONE = object()


def filled(**parts):
    return {k: v for k, v in parts.items() if v is not GONE}


def test_user_id_is_the_first_filled_name(spark):
    """Every way to leave out, blank or fill the three names, against the rule written in Python."""
    users = [
        filled(id=i, username=n, email=m)
        for i, n, m in itertools.product([GONE, "\t ", " 4711 "], [GONE, "", "mia "], [GONE, " ", " mia@site.example"])
    ]
    others = [["mia"], "mia", 12, None, {"id": 4711, "email": "n@site.example"}, {"id": {"x": 1}}]
    want = [next((u[k].strip() for k in ("id", "username", "email") if u.get(k, "").strip()), "") for u in users]
    df = docs(spark, *({"user": u} for u in [*users, *others]), {"usr": {"id": "x"}})
    assert values(df, identity.user_id(part("user"))) == [*want, "", "", "", "", "n@site.example", "", ""]
    stored = [next((u[k] for k in ("id", "username", "email") if k in u and u[k] != ""), "") for u in users]
    assert values(df, identity.stored_user_id(part("user")))[: len(users)] == stored


def test_device_id_is_the_first_filled_place(spark):
    """Tags before the device context before the extras; tags may be a map of texts or a list of pairs of any value."""
    maps = [(GONE, None), ({"device_id": "  "}, None), ({"device_id": 88}, None), ({"device_id": " tablet-9"}, "tablet-9"), ({"os": "x"}, None)]
    pairs = [([["colour", "red"]], None), ([["colour", "red"], ["device_id", 4.5]], "4.5"), ([["device_id"], [], "device_id"], None)]
    contexts = [(GONE, None), ({"device": {"id": " phone-3\n"}}, "phone-3"), ({"device": "phone"}, None)]
    extras = [(GONE, None), ({"device_id": "kiosk-1 "}, "kiosk-1"), ([], None)]
    payloads, want = [], []
    for (tags, one), (context, two), (extra, three) in itertools.product(maps + pairs, contexts, extras):
        payloads.append(filled(tags=tags, contexts=context, extra=extra))
        want.append(one or two or three or "")
    device = identity.device_id(part("tags"), part("contexts"), part("extra"))
    assert values(docs(spark, *payloads), device) == want


@pytest.mark.parametrize("what", ["os", "browser"])
def test_named_version(spark, what):
    names, versions = [GONE, "  ", " Plan 9 ", 3], [GONE, "", " 4.2", 7]
    contexts = [{what: filled(name=n, version=v)} for n, v in itertools.product(names, versions)]

    def expected(c):
        name, version = (x.strip() if isinstance(x, str) else "" for x in (c.get("name"), c.get("version")))
        return f"{name} {version}".strip() if name else ""

    want = [expected(c[what]) for c in contexts]
    df = docs(spark, *({"contexts": c} for c in contexts), {"contexts": [what]}, {"contexts": {what: "Plan 9"}}, {})
    assert values(df, identity.named_version(part("contexts"), what)) == [*want, "", "", ""]


def test_timestamps(spark):
    df = docs(
        spark, {"t": "2025-01-01T00:00:00Z"}, {"t": "2025-01-01T02:00:00.123+02:00"}, {"t": 1735689600.5},
        {"t": 1735689600}, {"t": "bad"}, {"t": "2025-01-01"}, {},
    )
    fallback = F.lit("2020-01-01 00:00:00").cast("timestamp")
    day = dt.datetime(2025, 1, 1)
    missing = dt.datetime(2020, 1, 1)
    assert values(df, moment_of(part("t"), fallback).cast("timestamp_ntz")) == [
        day, day.replace(microsecond=123000), day.replace(microsecond=500000), day, missing, missing, missing,
    ]


def test_ids(spark):
    plain = "9b70e619d7b355b1b743756ebd573b4e"
    dashed = "9b70e619-d7b3-55b1-b743-756ebd573b4e"
    sent = ["not-a-uuid", plain, dashed.upper(), "urn:uuid:" + dashed, "{" + dashed + "}", "é/1", "", None]
    df = spark.createDataFrame(list(enumerate(sent)), "n int, raw string").withColumn("form", uuid_form(F.col("raw")))
    found = values(df, canonical_uuid(F.col("raw"), F.col("form"), F.lit("new")))
    assert found == [dashed] * 5 + [str(uuid.uuid5(uuid.UUID(int=0), "é/1")), "new", "new"]


def test_name_uuid_equals_the_standard(spark):
    names = [f"name-{i}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(names)), "n int, name string")
    assert values(df, name_uuid(F.col("name"))) == [str(uuid.uuid5(uuid.UUID(int=0), n)) for n in names]


def test_error_event_rows(spark):
    df = docs(
        spark,
        {"event_id": "not-a-uuid", "message": "", "exception": {"values": [{"type": "Boom", "value": "bad"}]}},
        {"event_id": "9B70E619D7B355B1B743756EBD573B4E", "message": "m"},
        {"exception": {"values": [{"value": "only"}]}},
        {"exception": {"values": []}},
    ).withColumns({"project_id": F.lit(1), "received": F.lit("2025-01-01").cast("timestamp")})
    rows = ingest.normalize_error_events(df, "doc", F.lit("00000000-0000-4000-8000-000000000000")).collect()
    assert [r["title"] for r in rows] == ["Boom: bad", "m", "only", ""]
    uuid5 = "9b70e619-d7b3-55b1-b743-756ebd573b4e"
    assert [r["id"] for r in rows[:2]] == [uuid5, uuid5]
    assert json.loads(rows[0]["data"])["event_id"] == uuid5
    assert json.loads(rows[1]["data"])["event_id"] == "9B70E619D7B355B1B743756EBD573B4E"
    assert json.loads(rows[2]["data"])["event_id"] == "00000000-0000-4000-8000-000000000000"


def test_log_identity(spark):
    payloads = [
        {"message": "a", "user": {"id": "u1"}, "device_id": "d1", "fields": {"device_id": "d2"}},
        {"message": "b", "device_id": " d1 ", "fields": {"device_id": "d2"}},
        {"message": "c", "fields": {"device_id": " d2 "}},
        {"message": "d", "user": {"id": "u1"}, "fields": {"device_id": "d2"}},
        {"message": "e", "fields": {"device_id": 5}},
    ]
    df = docs(spark, *payloads).withColumns(
        {"project_id": F.lit(1), "received": F.lit("2025-01-01").cast("timestamp"), "message_id": F.col("n").cast("string")}
    )
    rows = ingest.build_log_rows(ingest.normalize_logs(ingest.log_payloads(df, "doc")).rows)
    found = {r["message"]: (r["distinct_id"], r["device_id"]) for r in rows.collect()}
    assert found == {"a": ("u1", "d1"), "b": ("d1", "d1"), "c": ("d2", "d2"), "d": ("u1", ""), "e": ("", "")}


def sealed(*items, head='{"event_id":"parcel-77"}', end="\n"):
    """An envelope: items are (header fields, payload); a length of True is filled in, in bytes."""
    lines = [head]
    for header, payload in items:
        size = {"length": len(payload.encode())} if header.get("length") is True else {}
        lines += [json.dumps({**header, **size}), payload]
    return "\n".join(lines) + end


NOTE = '{"message":"Grüße\\naus Köln"}'
SPREAD = '{\n  "message": "over lines"\n}'
ENVELOPES = {
    "one event on a line": (sealed(({"type": "event"}, NOTE)), 1, "Grüße\naus Köln"),
    "no line end at the end": (sealed(({"type": "event"}, NOTE), end=""), 1, "Grüße\naus Köln"),
    "length counts bytes": (sealed(({"type": "event", "length": True}, NOTE), ({"type": "log"}, "x")), 2, "Grüße\naus Köln"),
    "length spans lines": (sealed(({"type": "event", "length": True}, SPREAD)), 1, "over lines"),
    "event behind others": (sealed(({"type": "client_report"}, "17"), ({"type": "event"}, NOTE)), 2, "Grüße\naus Köln"),
    "first event that is an object": (sealed(({"type": "event"}, "17"), ({"type": "event"}, '{"message":"z"}')), 2, "z"),
    "no event at all": (sealed(({"type": "session"}, '{"sid":1}')), 1, None),
}
BROKEN = {
    "length is a word": (sealed(({"type": "event", "length": "ten"}, NOTE)), envelope.BAD_LENGTH),
    "length is negative": (sealed(({"type": "event", "length": -8}, NOTE)), envelope.BAD_LENGTH),
    "body ends early": (sealed(({"type": "event", "length": 900}, NOTE)), envelope.SHORT_BODY),
    "blank header line": (sealed(({"type": "event"}, NOTE), head="  "), envelope.EMPTY_HEADER),
    "header only": (sealed(), envelope.NO_ITEMS),
    "header is no JSON": (sealed(({"type": "event"}, NOTE), head="event_id=parcel-77"), envelope.BAD_HEADER),
}


@pytest.mark.parametrize("name", ENVELOPES)
def test_envelope(name):
    text, items, message = ENVELOPES[name]
    found = envelope.read_envelope(text)
    assert found["error"] is None and found["items"] == items
    assert (found["event"] and json.loads(found["event"]).get("message")) == message


@pytest.mark.parametrize("name", BROKEN)
def test_broken_envelope(name):
    text, error = BROKEN[name]
    assert envelope.read_envelope(text)["error"] == error


def test_envelope_without_event_is_kept_whole(spark):
    text = ENVELOPES["no event at all"][0].replace("parcel-77", "").replace('"event_id":""', "")
    row = envelope.envelope_messages(envelope.parse_envelopes(spark.createDataFrame([(text,)], "body string")).rows).first()
    payload = json.loads(row["payload"])
    assert (row["type"], payload["raw"], payload["event_id"]) == ("envelope", text, str(uuid.uuid5(uuid.UUID(int=0), text)))


def test_envelope_event_takes_the_envelope_id(spark):
    bodies = [
        sealed(({"type": "event"}, "{}")),
        sealed(({"type": "event"}, '{"event_id":"letter-5","n":1}')),
        sealed(({"type": "event"}, '{"n":1}'), head='{"event_id":"say \\"hi\\""}'),
    ]
    rows = envelope.envelope_messages(envelope.parse_envelopes(spark.createDataFrame([(b,) for b in bodies], "body string")).rows)
    assert [json.loads(r["payload"])["event_id"] for r in rows.collect()] == ["parcel-77", "letter-5", 'say "hi"']


def test_first_write_wins(spark):
    rows = [(1, "a", 0, "x"), (1, "a", 1, "y"), (2, "a", 0, "z"), (1, None, 0, "n1"), (1, None, 1, "n2")]
    df = spark.createDataFrame(rows, "project_id int, ingest_id string, arrival int, v string")
    assert sorted(r["v"] for r in dedupe.dedupe_ingest(df, ["arrival"]).collect()) == ["n1", "n2", "x", "z"]


def test_only_new_rows(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, None)], "project_id int, ingest_id string")
    stored = spark.createDataFrame([(1, "a"), (1, "a"), (1, None)], "project_id int, ingest_id string")
    found = {tuple(r) for r in dedupe.new_rows_only(batch, stored, dedupe.INGEST_KEY).collect()}
    assert found == {(1, "b"), (2, "a"), (1, None)}


def test_paths(spark):
    df = docs(spark, {"exception": {"values": [{"type": "TypeError"}]}, "a": None, "o": {"0": "key"}, "s": {"x": [1, {"y": 2}]}})
    doc = F.col("doc")

    def look(path):
        return values(df, plain_text(field_at(doc, path)))[0]

    assert look("exception.values.0.type") == "TypeError"
    assert look("exception.values.1.type") is None
    assert look("a") == ""
    assert look("o.0") == "key"
    assert look("s.x") == '[1,{"y":2}]'
    assert look("s.-1") is None
    assert look("s..x") is None
    assert values(df, field_at(doc, "a").isNotNull()) == [True]
    assert values(df, field_at(doc, "a.b").isNotNull()) == [False]
