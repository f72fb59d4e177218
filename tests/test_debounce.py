import random
from datetime import datetime, timedelta

import pandas as pd

from sedgeline.operators import control
from sedgeline.streaming import run, state


class Handle:
    """A bucket's state and the timers that were asked for."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Now:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.at

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_a_bucket_asks_for_one_timer_and_gives_its_batches_at_once():
    handle, machine = Handle(), state.Debounce(10)
    machine.init(handle)
    seconds = [(1, 0), (1, 5), (1, 10), (1, 30), (2, 4), (2, 13), (2, 14), (3, 29)]
    rows = pd.DataFrame({"none": False, "key": [k for k, _ in seconds], "at": pd.to_datetime([s for _, s in seconds], unit="s")})
    shown = lambda frames: [list(zip(f["key"], f["opened"].astype("datetime64[s]").astype(int), f["events"], strict=True)) for f in frames]
    assert shown(machine.handleInputRows((0,), iter([rows]), None)) == [[(1, 0, 2), (1, 10, 1), (2, 4, 2)]]
    assert handle.timers == [24_000] and len(handle.value[0]) == 3
    assert shown(machine.handleExpiredTimer((0,), Now(39_000), Now(24_000))) == [[(2, 14, 1), (3, 29, 1)]]
    assert handle.timers == [24_000, 40_000]
    assert shown(machine.handleExpiredTimer((0,), Now(40_000), Now(40_000))) == [[(1, 30, 1)]] and handle.value is None


def test_a_stream_in_parts_gives_the_batches_of_the_whole(spark, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = sorted(((start + timedelta(minutes=rng.randrange(6000)), rng.choice([None, *range(40), 2**60 + 1])) for _ in range(1200)), key=lambda r: r[0])
    for i, part in enumerate((rows[:500], rows[500:], [(start + timedelta(days=30), 99)])):
        spark.createDataFrame(part, "at timestamp, key long").coalesce(1).write.parquet(f"{tmp_path}/{i}")
    stream = run.read(spark, f"{tmp_path}/*/*.parquet", spark.read.parquet(f"{tmp_path}/0").schema)
    shown = lambda df: sorted((str(r.key), r.opened, r.events) for r in df.collect())
    made = shown(run.drain(state.debounced(stream, 3600, buckets=8), "update"))
    assert made == shown(control.debounce(spark.createDataFrame(rows, "at timestamp, key long"), "key", "at", 3600))
