"""Stored rollups with coverage, retention on stored tables, and address lookup."""

import datetime as dt
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.operators import addresses
from tidewell.session import run_dir
from tidewell.sources import facts, stored_rollup


def stored(spark, rows):
    """(project, day, hour, name, user)"""
    path = run_dir(spark, "s")
    data = [(p, dt.datetime(2025, 1, d, h), f"{i}", n, u, "") for i, (p, d, h, n, u) in enumerate(rows)]
    facts.write_facts(spark.createDataFrame(data, schemas.TRACK_EVENTS), f"{path}/track")
    return f"{path}/track", f"{path}/daily"


ROWS = [(1, d, h, n, u) for d in range(1, 8) for h in (3, 13) for n, u in (("view", f"u{d % 3}"), ("buy", f"u{h}"))]


def tops(rows):
    return [(r["name"], r["events"], r["users"]) for r in rows.collect()]


def test_hybrid_reads_raw_days_only_where_needed(spark):
    track, daily = stored(spark, ROWS + [(2, 3, 5, "view", "x")])
    stored_rollup.refresh_rollup(spark, track, daily, 1, dt.date(2025, 1, 1), dt.date(2025, 1, 4))
    found = stored_rollup.top_events_stored(spark, track, daily, 1, "2025-01-01 12:00:00", "2025-01-06 12:00:00")
    assert tops(found) == [("buy", 10, 2), ("view", 10, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = [line.replace(" ", "") for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("IN(2025-01-01,2025-01-" in f for f in filters) and any("IN(2025-01-02,2025-01-03,2025-01-04)" in f for f in filters)
    whole = stored_rollup.top_events_stored(spark, track, daily, 1, "2025-01-02", "2025-01-04 23:59:59.999999")
    assert tops(whole) == [("buy", 6, 2), ("view", 6, 3)]


def test_refresh_counts_late_and_deleted_rows(spark):
    track, daily = stored(spark, ROWS)
    stored_rollup.refresh_rollup(spark, track, daily, 1, dt.date(2025, 1, 1), dt.date(2025, 1, 7))
    assert stored_rollup.read_rollup(spark, daily).agg(F.sum("events")).first()[0] == len(ROWS)
    late = spark.createDataFrame([(1, dt.datetime(2025, 1, 2, 9), "l", "view", "late", "")], schemas.TRACK_EVENTS)
    facts.write_facts(late, track)
    for _ in range(2):  # a second refresh changes nothing
        stored_rollup.refresh_rollup(spark, track, daily, 1, dt.date(2025, 1, 2), dt.date(2025, 1, 2))
        assert stored_rollup.read_rollup(spark, daily).agg(F.sum("events")).first()[0] == len(ROWS) + 1
    facts.drop_days(spark, track, 1, "2025-01-04")
    spark.catalog.refreshByPath(track)
    stored_rollup.refresh_rollup(spark, track, daily, 1, dt.date(2025, 1, 1), dt.date(2025, 1, 3))
    assert stored_rollup.read_rollup(spark, daily).agg(F.min("day")).first()[0] == "2025-01-04"


def test_retention_and_rollup_agree(spark):
    track, daily = stored(spark, ROWS + [(2, 1, 3, "view", "x")])
    for project in (1, 2):
        stored_rollup.refresh_rollup(spark, track, daily, project, dt.date(2025, 1, 1), dt.date(2025, 1, 7))
    policies = spark.createDataFrame([(1, True, 3), (2, True, 0)], "project_id int, enabled boolean, track_events_days int")
    for deleted in (14, 0):
        done = stored_rollup.enforce_retention(spark, {"track_events": (track, "track_events_days")}, daily, policies, "2025-01-07 12:00:00")
        assert [tuple(r) for r in done.collect()] == [("track_events", 1, deleted)]
        left = facts.read_facts(spark, track).groupBy("project_id", "day", "name", "distinct_id").count()
        rollup = stored_rollup.read_rollup(spark, daily).select("project_id", "day", "name", "distinct_id", "events")
        assert {tuple(r) for r in rollup.collect()} == {tuple(r) for r in left.collect()}
    assert min(stored_rollup.covered_days(spark, daily, 1)) == "2025-01-04"
    assert stored_rollup.top_events_stored(spark, track, daily, 1, "2025-01-04", "2025-01-07 23:59:59.999999").count() == 2


def spelled(rng, number):
    """One of the usual spellings of a 128-bit address."""
    address = ipaddress.IPv6Address(number)
    return rng.choice([str(address), address.exploded, str(address).upper(), f" {address} "])


def test_addresses_are_read_in_every_spelling():
    assert {addresses.digits(t) for t in ("2f00::1ab", "2F00:0:0:0::01ab", " 2f00:0000:0000:0000:0000:0000:0000:01AB\t")} == {"2f00" + "0" * 25 + "1ab"}
    mapped = "0" * 20 + "ffff0a0000ff"
    assert {addresses.digits(t) for t in ("10.0.0.255", "::ffff:10.0.0.255", "::FFFF:a00:ff")} == {mapped}
    bad = [None, "", "nowhere", ":", "1::2::3", "12345::", "1:2:3:4:5:6:7", "1.2.3", "1.2.3.256", "01.2.3.4", "[::1]", "fe80::1%eth0"]
    assert {addresses.digits(t) for t in bad} == {None}


def test_blocks_cover_a_range_exactly():
    rng = random.Random(3)
    for _ in range(200):
        a, b = sorted(rng.getrandbits(rng.choice([8, 40, 128])) for _ in range(2))
        spans = [(int(p.ljust(32, "0"), 16), int(p.ljust(32, "f"), 16)) for p in addresses.blocks(a, b)]
        assert spans[0][0] == a and spans[-1][1] == b and all(x[1] + 1 == y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("max_rows", [500_000, 0])
def test_smallest_range_wins(spark, max_rows):
    rng = random.Random(4)
    spans = [(0, 2**128 - 1, "all")]
    for i in range(60):
        low = rng.getrandbits(128)
        spans.append((low, min(low + rng.getrandbits(rng.choice([20, 100, 124])), 2**128 - 1), f"r{i}"))
        spans.append((0xFFFF00000000 + (i << 24), 0xFFFF00000000 + (i << 24) + rng.randrange(1 << 24), f"v{i}"))
    points = [rng.choice([a, b, rng.randint(a, b)]) for a, b, _ in spans for _ in range(5)] + [spans[1][0]] * 200
    texts = [str(ipaddress.IPv4Address(p - 0xFFFF00000000)) if 0xFFFF00000000 <= p < 2**48 else spelled(rng, p) for p in points]
    ranges = spark.createDataFrame([(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(b)), n) for a, b, n in spans], "lo string, hi string, place string")
    rows = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "nowhere")], "n int, client_ip string").repartition(3)
    found = {r.n: r.place for r in addresses.locate(rows, ranges, max_rows=max_rows).collect()}
    want = {i: min((b - a, f"{a:032x}", n) for a, b, n in spans if a <= p <= b)[2] for i, p in enumerate(points)}
    assert found == {**want, -1: None, -2: None}
