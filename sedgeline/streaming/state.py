"""Keyed state over event streams.

Each processor keeps a few values for a key (of many keys at once where they are dealt to buckets), so state grows with keys
and not with events.  The batch functions of
:mod:`sedgeline.operators.control` give the same results over a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JOB = "job_key long, status string, attempts int, run_at timestamp, events long"
METER = "user_id long, request_id long, outcome string"
BATCH = "key long, opened timestamp, events long"
BUCKETS = 256  # of keys whose open batches are one row of state


def _ordered(rows: Iterator[pd.DataFrame], columns: list[str], by: int) -> pd.DataFrame:
    """A key's rows of a micro-batch, the needed columns only, sorted by the first ``by`` of them."""
    return pd.concat([r[columns] for r in rows], ignore_index=True).sort_values(columns[:by], ignore_index=True)


class JobMachine(StatefulProcessor):
    """Latest state of each job from its events (``claim``, ``done``, ``error``, ``cancel``), in order of time."""

    def __init__(self, max_attempts: int = 3):
        self.max_attempts = max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, attempts int, run_at timestamp, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        status, attempts, run_at, events = self.state.get() if self.state.exists() else ("pending", 0, None, 0)
        batch = _ordered(rows, ["ts", "event_id", "action"], 2)
        for at, action in zip(batch["ts"].dt.to_pydatetime(), batch["action"].to_numpy(), strict=True):  # each transition depends on the one before
            status, attempts, run_at = step(status, attempts, run_at, action, at, self.max_attempts)
        events += len(batch)
        self.state.update((status, attempts, run_at, events))
        yield pd.DataFrame({"job_key": [key[0]], "status": [status], "attempts": [attempts], "run_at": [run_at], "events": [events]})

    def close(self) -> None:
        pass


def step(status: str, attempts: int, run_at: datetime | None, action: str, at: datetime, most: int) -> tuple[str, int, datetime | None]:
    """One transition; events that a state does not know leave it as it is."""
    if action == "claim" and status == "pending":
        return "running", attempts + 1, at
    if status == "cancelling" and action in ("done", "error"):
        return "cancelled", attempts, run_at
    if status == "running" and action == "done":
        return "completed", attempts, run_at
    if status == "running" and action == "error":
        return ("failed", attempts, run_at) if attempts >= most else ("pending", attempts, at + pd.Timedelta(minutes=2 ** max(0, attempts - 1)).to_pytimedelta())
    if action == "cancel":
        return {"pending": "cancelled", "running": "cancelling"}.get(status, status), attempts, run_at
    return status, attempts, run_at


class Meter(StatefulProcessor):
    """Outcome of each request under a limit a calendar day and one a month; refused ones don't count."""

    def __init__(self, per_day: int, per_month: int):
        self.per_day, self.per_month = per_day, per_month

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("use", "day string, in_day int, month string, in_month int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        day, in_day, month, in_month = self.state.get() if self.state.exists() else ("", 0, "", 0)
        batch = _ordered(rows, ["created_at", "request_id"], 2)
        days = batch["created_at"].to_numpy().astype("datetime64[D]")
        outcomes = np.full(len(batch), "day_limit", dtype=object)
        cuts = np.flatnonzero(np.concatenate(([True], days[1:] != days[:-1]))).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(batch)], strict=True):  # a turn for each day: its first ones are allowed
            now_day = str(days[i])
            in_day, in_month = in_day if now_day == day else 0, in_month if now_day[:7] == month else 0
            day, month = now_day, now_day[:7]
            free = max(0, min(self.per_day - in_day, self.per_month - in_month, j - i))
            outcomes[i : i + free] = "allowed"
            in_day, in_month = in_day + free, in_month + free
            if in_month >= self.per_month:
                outcomes[i + free : j] = "month_limit"
        self.state.update((day, in_day, month, in_month))
        yield pd.DataFrame({"user_id": key[0], "request_id": batch["request_id"].to_numpy(), "outcome": outcomes})

    def close(self) -> None:
        pass


class Debounce(StatefulProcessor):
    """Batches that a key's first event opens and that close after a fixed time, by event-time timer.

    Keys are dealt to buckets, and a bucket has one row of state with its open batches and one timer, for the first that
    ends: a call for each bucket instead of one for each key and batch, whose cost would be most of the work."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "keys array<long>, opened array<long>, events array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        still = self._still_open()
        parts = [(r["none"].to_numpy(np.bool_), r["key"].to_numpy(np.int64), r["at"].to_numpy().astype("datetime64[s]").astype(np.int64)) for r in rows]
        none, keys, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((times, keys, none))
        none, keys, times = none[order], keys[order], times[order] * 1000
        cuts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (none[1:] != none[:-1])))).tolist()
        closed = []
        for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            k = None if none[i] else int(keys[i])
            opened, events = still.get(k, (None, 0))
            own, at = times[i:j], 0
            while at < len(own):  # a turn for each batch
                if opened is not None and own[at] >= opened + self.millis:
                    closed.append((k, opened, events))
                    opened, events = None, 0
                if opened is None:
                    opened = int(own[at])
                upto = int(np.searchsorted(own, opened + self.millis, side="left"))
                events, at = events + upto - at, upto
            still[k] = (opened, events)
        self._keep(still)
        if closed:
            yield _batches(closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        still, now = self._still_open(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        closed = [(k, *batch) for k, batch in still.items() if batch[0] + self.millis <= now]
        if closed:
            self._keep({k: batch for k, batch in still.items() if batch[0] + self.millis > now})
            yield _batches(closed)

    def _still_open(self) -> dict[int | None, tuple[int, int]]:
        keys, opened, events = self.open.get() if self.open.exists() else ((), (), ())
        return {k: (o, n) for k, o, n in zip(keys, opened, events, strict=True)}

    def _keep(self, still: dict[int | None, tuple[int, int]]) -> None:
        if not still:
            self.open.clear()
            return
        self.open.update((list(still), [o for o, _ in still.values()], [n for _, n in still.values()]))
        self.handle.registerTimer(min(o for o, _ in still.values()) + self.millis)

    def close(self) -> None:
        pass


def _batches(closed: list[tuple[int | None, int, int]]) -> pd.DataFrame:
    keys, opened, events = zip(*closed, strict=True)
    return pd.DataFrame({"key": pd.array(keys, "Int64"), "opened": pd.to_datetime(opened, unit="ms"), "events": events})


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode=time_mode)


def job_states(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """From ``job_key, event_id, ts, action``: each job's state after every micro-batch (update mode)."""
    return _keyed(events, "job_key", JobMachine(max_attempts), JOB)


def metered(requests: DataFrame, per_day: int, per_month: int) -> DataFrame:
    return _keyed(requests, "user_id", Meter(per_day, per_month), METER)


def debounced(events: DataFrame, seconds: int, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """From ``key, at``: closed batches.  Batches close when the watermark passes their end.  Events without a time count
    in none."""
    rows = events.withWatermark("at", delay).where("at IS NOT NULL")
    key = F.col("key").cast("long")
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), key.isNull().alias("none"), F.coalesce(key, F.lit(0)).alias("key"), "at")
    return _keyed(dealt, "bucket", Debounce(seconds), BATCH, "EventTime")


def windowed(events: DataFrame, key: str, at: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by sliding or tumbling window with a watermark.  A Spark-native extra."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), "events")


def sessions(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Counts by session.  A Spark-native extra."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
