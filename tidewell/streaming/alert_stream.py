"""Alert decisions on a stream, with the state of each key in the state store."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.alert_state import KEY, SECOND, SETTINGS

# Executors get this module's functions with the task and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENT = "rule_id int, key_hash string, tick bigint, backoff_exp bigint, next_allowed bigint"
STATE = "occurrences bigint, backoff_exp bigint, last_seen bigint, next_allowed bigint"
# A key is forgotten this long (processing time) after its window and its backoff are over.
IDLE_MS = 7 * 86_400_000


def idle_ms(window: int, last: int, allowed: int) -> int:
    """How long a key's state can still matter, and a margin for late rows; window in seconds, moments in microseconds."""
    return max(window * 1000, -(-(allowed - last) // 1000), 0) + IDLE_MS


def decide(moments: dict[int, int], settings: tuple[int, int, int, int], state: tuple[int, int, int, int]):
    """Walk one key's matches, counted per microsecond, from a state: (new state, sends).

    A moment older than the last one seen counts as seen now: it cannot end a session.
    """
    window, threshold, base, ceiling = settings
    occurrences, exponent, last, allowed = state
    sends = []
    for tick in sorted(moments):
        if last and tick - last > window * SECOND:
            occurrences, exponent, allowed = 0, 0, 0
        occurrences += moments[tick]
        last = max(last, tick)
        if occurrences >= threshold and tick >= allowed:
            allowed = tick + min(base * 2**exponent, ceiling) * SECOND
            sends.append((tick, exponent, allowed))
            exponent += 1
    return (occurrences, exponent, last, allowed), sends


def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count equal moments of a key where they are read, so that a hot key sends few rows to its state."""
    for part in parts:
        yield part.groupby([*KEY, *SETTINGS, "tick"], as_index=False, sort=False).agg(n=("n", "sum"))


def _step(
    key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, forget_idle: bool
) -> Iterator[pd.DataFrame]:
    """The rows of a key arrive in parts and are reduced to a count per moment as they come."""
    if state.hasTimedOut:
        state.remove()
        return
    moments: Counter[int] = Counter()
    settings = None
    for part in parts:
        if settings is None:
            settings = tuple(int(part[name].iloc[0]) for name in ("window", "threshold", "base", "ceiling"))
        for tick, n in zip(part["tick"].to_numpy(), part["n"].to_numpy()):
            moments[int(tick)] += int(n)
    before = tuple(state.get) if state.exists else (0, 0, 0, 0)
    after, sends = decide(moments, settings, before)
    state.update(after)
    if forget_idle:
        state.setTimeoutDuration(idle_ms(settings[0], after[2], after[3]))
    yield pd.DataFrame(
        [(key[0], key[1], *sent) for sent in sends],
        columns=["rule_id", "key_hash", "tick", "backoff_exp", "next_allowed"],
    )


def alert_stream(matched: DataFrame, forget_idle: bool = False) -> DataFrame:
    """Sends of a stream of matched inputs (see operators.alert_rules.match_rules).

    A stream that runs for ever should forget idle keys. Such a stream keeps looking for idle
    keys, so it must not be run with the availableNow trigger, which would never end.
    """
    rows = matched.selectExpr(*KEY, *SETTINGS, "unix_micros(ts) AS tick", "1L AS n")
    rows = rows.mapInPandas(combine, rows.schema)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_idle else GroupStateTimeout.NoTimeout
    step = partial(_step, forget_idle=forget_idle)
    return rows.groupBy(*KEY).applyInPandasWithState(step, SENT, STATE, "append", timeout)
