"""Place lookup for IPv4 and IPv6 addresses: longest match over 128-bit ranges.

Distinct addresses are read as 32 hex digits; IPv4 lies in the mapped block of IPv6. Each range is cut into the fewest blocks that begin
with the same digits, which turns the range join into an equality join on a prefix for each prefix length that occurs.
Each distinct address is read and looked up once, so an address that many rows share is no hot key of the lookup, and
the result is joined back as a balanced lookup. Of ranges that contain each other the smallest one wins.
"""

from __future__ import annotations

import ipaddress
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.skew import BROADCAST_ROWS, lookup_join
from tidewell.session import written_once

# Executors get this module's functions with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 32
#: Fixed value: the block of IPv6 that holds IPv4.
MAPPED = 0xFFFF << 32


def digits(text: str | None) -> str | None:
    """An IPv4 or IPv6 address as 32 hex digits; null for anything else. Zones and brackets are not accepted."""
    try:
        address = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None
    if address.version == 6 and address.scope_id is not None:
        return None
    return f"{int(address) + (MAPPED if address.version == 4 else 0):032x}"


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.assign(_ip=part["_text"].map(digits))


def blocks(low: int, high: int) -> Iterator[str]:
    """The fewest prefixes of hex digits that cover low to high and nothing else."""
    while low <= high:
        free = DIGITS  # digits at the end that may take any value
        while free and (low % 16**free or low + 16**free - 1 > high):
            free -= 1
        yield f"{low:032x}"[: DIGITS - free]
        low += 16**free


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of ranges: (_n, _prefix, _width). A range without two addresses in order has none."""
    for part in parts:
        rows = []
        for n, low, high in zip(part["_n"], part["lo"].map(digits), part["hi"].map(digits)):
            if low and high and low <= high:
                a, b = int(low, 16), int(high, 16)
                rows += [(n, prefix, f"{b - a:032x}") for prefix in blocks(a, b)]
        yield pd.DataFrame(rows, columns=["_n", "_prefix", "_width"])


def locate(rows: DataFrame, ranges: DataFrame, ip: str = "client_ip", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows with the further columns of the smallest range (lo, hi: address texts) that holds their address."""
    places = [c for c in ranges.columns if c not in ("lo", "hi")]
    # A range is named by its bounds: the same whenever a task is repeated.
    keyed = ranges.where("lo IS NOT NULL AND hi IS NOT NULL").withColumn("_n", F.concat_ws("-", "lo", "hi")).dropDuplicates(["_n"])
    cut = written_once(keyed.select("_n", "lo", "hi").mapInPandas(_cut, "_n string, _prefix string, _width string"))
    lengths = sorted(r[0] for r in cut.select(F.length("_prefix")).distinct().collect())  # 33 at most
    prefixes = F.explode(F.array(*[F.substring("_ip", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>"))
    asked = rows.select(F.col(ip).alias("_text")).where("_text IS NOT NULL").distinct()
    hit = asked.mapInPandas(_read, "_text string, _ip string").select("_text", prefixes.alias("_prefix")).join(cut, "_prefix")
    best = hit.groupBy("_text").agg(F.min(F.struct("_width", "_n")).alias("_b")).select("_text", F.col("_b._n").alias("_n"))
    found = written_once(best.join(keyed.select("_n", *places), "_n").drop("_n"))
    return lookup_join(rows.withColumn("_text", F.col(ip)), found, ["_text"], "left", None, max_rows).drop("_text")
