"""A sliding-window rate limit: at a call, over a table, and over a stream whose events come late.

A request is allowed if fewer than `limit` requests of its key were allowed within the window before it; one that isn't
allowed takes no place and is told after how many seconds to try again. What is kept of a key is the times of at most
`limit` allowed requests. A limit of 0 or less lets all through. A table and a stream decide in order of time, ties by id, so they agree however events arrive:
the stream holds an event until the watermark has passed it, and Spark leaves out those that come later still.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from threading import Lock

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.sources.staging import ship


@dataclass(frozen=True)
class Rate:
    limit: int
    window: float

    def decide(self, held: deque[float], now: float) -> int | None:
        """None if a request at this time is allowed, which takes a place in held, else the seconds to wait."""
        if self.limit <= 0:
            return None
        while held and held[0] < now - self.window:
            held.popleft()
        if len(held) < self.limit:
            held.append(now)
            return None
        return max(1, int(held[0] + self.window - now))


class Limiter:
    """The limit of a service, by any key; keys that have been quiet for a window are forgotten."""

    def __init__(self, rate: Rate) -> None:
        self.rate, self.held, self.lock, self.swept = rate, {}, Lock(), 0.0

    def ask(self, key: tuple, now: float) -> int | None:
        with self.lock:
            if now - self.swept > self.rate.window:
                self.held = {k: v for k, v in self.held.items() if v and v[-1] >= now - self.rate.window}
                self.swept = now
            return self.rate.decide(self.held.setdefault(key, deque()), now)


def limited(events: DataFrame, rate: Rate, keys: list[str], time: str = "ts", ident: str = "event_id") -> DataFrame:
    """(keys, ident, allowed, retry_after) of a table of events: a pass over each key's events in order, which keeps `limit` times."""
    ship(events.sparkSession.sparkContext)
    kinds = dict(events.dtypes)
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("__at")
    rows = events.select(*keys, ident, seconds).where("__at IS NOT NULL")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ident]) + ", allowed boolean, retry_after long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, deque()
        for b in batches:
            waits = []
            for *own, at in zip(*(b.column(k).to_pylist() for k in [*range(len(keys)), b.num_columns - 1])):
                if own != key:
                    key, held = own, deque()
                waits.append(rate.decide(held, at))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([w is None for w in waits], pa.bool_()), pa.array([w or 0 for w in waits], pa.int64())], names=[*b.schema.names[:-1], "allowed", "retry_after"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "__at", ident).mapInArrow(run, schema)


def limited_stream(events: DataFrame, rate: Rate, keys: list[str], time: str = "ts", ident: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """As `limited`, of a stream: a row for each event once the watermark has passed it.

    A key's state is its undecided events, as many as come within the watermark's delay, and the times of at most `limit`
    requests; a key without undecided events is forgotten when its last time is out of the window.
    """
    ship(events.sparkSession.sparkContext)
    kinds = dict(events.dtypes)
    rows = events.withWatermark(time, late).select(*keys, ident, time)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, ident]) + ", allowed boolean, retry_after long"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = json.loads(state.get[0]) if state.exists else ([], [])
        for frame in frames:
            at = frame[time].astype("datetime64[us]").astype("int64") / 1e6
            waiting += [[a, i] for a, i in zip(at.tolist(), frame[ident].tolist())]
        passed = state.getCurrentWatermarkMs() / 1000
        ready = sorted(x for x in waiting if x[0] <= passed)
        waiting, held = [x for x in waiting if x[0] > passed], deque(held)
        waits = [rate.decide(held, at) for at, _ in ready]
        if waiting or held and held[-1] >= passed - rate.window:
            state.update((json.dumps([waiting, list(held)]),))
            due = min(x[0] for x in waiting) if waiting else held[-1] + rate.window
            state.setTimeoutTimestamp(int(max(due, passed) * 1000) + 1)
        elif state.exists:
            state.remove()
        if ready:
            own = {k: [v] * len(ready) for k, v in zip(keys, key)}
            yield pd.DataFrame(own | {ident: [i for _, i in ready], "allowed": [w is None for w in waits], "retry_after": [w or 0 for w in waits]})

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
