from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sedgeline.operators import control, merge
from sedgeline.streaming.state import step


def test_job_steps():
    at = datetime(2024, 1, 1)
    assert step("pending", 0, None, "claim", at, 3) == ("running", 1, at)
    assert step("running", 1, at, "error", at, 3) == ("pending", 1, at + timedelta(minutes=1))
    assert step("running", 2, at, "error", at, 3) == ("pending", 2, at + timedelta(minutes=2))
    assert step("running", 3, at, "error", at, 3)[0] == "failed" and step("running", 3, at, "done", at, 3)[0] == "completed"
    assert step("pending", 0, None, "cancel", at, 3)[0] == "cancelled" and step("running", 1, at, "cancel", at, 3)[0] == "cancelling" and step("cancelling", 1, at, "error", at, 3)[0] == "cancelled"
    assert step("completed", 1, at, "claim", at, 3)[0] == "completed"


def test_run_limit(spark):
    cases = {(20, 20, 50_000): 0, (20, 0, 0): 8, (20, 0, 43_200): 10, (48, 0, 40_000): 23, (100, 99, 80_000): 1, (10, 9, 86_399): 1, (5, 0, 36_000): 3}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "l int, c int, s int, want long")
    assert df.where(~(control.run_limit(F.col("l"), F.col("c"), F.col("s")) == F.col("want"))).count() == 0


def test_meter_matches_a_loop(spark):
    rows = [(i, i % 3, datetime(2024, 1, 30) + timedelta(hours=i)) for i in range(200)]
    got = {r.request_id: r.outcome for r in control.metered(spark.createDataFrame(rows, "request_id long, user_id long, created_at timestamp_ntz"), 3, 10).collect()}
    used, want = {}, {}
    for i, u, t in rows:
        d, m = (u, t.date()), (u, t.year, t.month)
        want[i] = "month_limit" if used.get(m, 0) >= 10 else "day_limit" if used.get(d, 0) >= 3 else "allowed"
        if want[i] == "allowed":
            used[d], used[m] = used.get(d, 0) + 1, used.get(m, 0) + 1
    assert got == want


def test_upsert_is_idempotent_and_keeps_what_does_not_come_in(spark):
    now, later = F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz")
    stored = spark.createDataFrame([(1, "a", "h1", True, None), (1, "b", "h2", False, None)], "feed_id int, identifier string, content_hash string, starred boolean, date timestamp_ntz")
    stored = stored.withColumn("created_at", now).withColumn("updated_at", now)
    incoming = spark.createDataFrame([(1, "a", "h9", 1), (1, "c", "h3", 2), (1, "c", "h4", 3), (1, "", "h5", 4), (1, "b", "h2", 5)], "feed_id int, identifier string, content_hash string, seq int")
    incoming = merge.last_of_batch(incoming, "seq").drop("seq").withColumn("date", now)
    once = merge.upsert(stored, incoming, later)
    rows = {r.identifier: r for r in once.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["c"].content_hash == "h4" and rows["a"].starred is True and rows["a"].updated_at == datetime(2024, 1, 3) and rows["b"].updated_at == datetime(2024, 1, 2) and rows["b"].date is None
    assert {r.action for r in merge.classify(once, incoming).collect()} == {"unchanged"}


def test_debounce_opens_fixed_windows(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("k", t0 + timedelta(seconds=s)) for s in (0, 119, 120, 200, 400)]
    got = sorted(r.events for r in control.debounce(spark.createDataFrame(rows, "k string, at timestamp"), "k", "at").collect())
    assert got == [1, 2, 2]
