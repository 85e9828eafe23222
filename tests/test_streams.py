"""Stateful streams against their batch forms, over several micro-batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from marginalia.operators import admission
from marginalia.streaming import jobs, stateful

START = dt.datetime(2024, 1, 1)


def stream(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return jobs.source(spark, f"{path}/in", spark.createDataFrame([], schema), 1)


def run(spark, df, path, name="out"):
    with stateful.rocksdb(spark):
        jobs.run_once(df, f"{path}/state-{name}", to=f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def test_admission_is_one_stream_equal_to_the_batch_form(spark, tmp_path):
    """Hot addresses, guests, administrators, users over several days; a second start of the same stream adds nothing."""
    r, schema = random.Random(3), "ip string, event_id long, ts timestamp, user_id long, is_admin boolean, tokens long"
    at, rows = START, []
    for i in range(600):
        at += dt.timedelta(seconds=r.choice([0, 1, 5, 400]))
        user = r.choice([None, 1, 1, 1, 2, 3])
        rows.append((r.choice(["a", "a", "a", "b", None]), i, at, user, user == 2, r.choice([10, 300])))
    path = str(tmp_path)
    reasons = stateful.admitted(stream(spark, path, [rows[:250], rows[250:251], rows[251:]], schema), 60_000, 4, 2_000)
    got = {x.event_id: x.reason for x in run(spark, reasons, path).collect()}
    want = {x.event_id: x.reason for x in admission.admitted(spark.createDataFrame(rows, schema), 60_000, 4, 2_000).collect()}
    assert got == want and {"rate", "admin", "ok", "budget"} == set(want.values())
    assert run(spark, reasons, path).count() == 600


def test_tasks_expire_once_each(spark, tmp_path):
    """Between batches, within one, by the watermark; a task that changes in time lives on."""
    hour, schema = dt.timedelta(hours=1), "task_id long, kind string, event_id long, ts timestamp"
    first = [(1, "essay", 1, START), (2, "essay", 2, START), (2, "essay", 3, START + 3 * hour), (3, "paper", 4, START + 2 * hour), (4, "essay", 5, START + 3 * hour)]
    second = [(3, "paper", 6, START + 4 * hour), (4, "essay", 7, START + 4 * hour), (9, "essay", 8, START + 6 * hour)]
    third = [(1, "essay", 9, START + 7 * hour), (9, "essay", 10, START + 7 * hour), (8, "essay", 11, START + 8 * hour), (8, "essay", 12, START + 8 * hour + dt.timedelta(minutes=1))]
    path = str(tmp_path)
    life = F.when(F.col("kind") == "paper", 2 * 3_600_000).otherwise(3_600_000)
    got = run(spark, stateful.expiries(stream(spark, path, [first, second, third, third[-1:]], schema), life), path).collect()
    found = sorted((x.task_id, (x.changed - START) / hour) for x in got)
    assert found == [(1, 0), (2, 0), (2, 3), (3, 4), (4, 4)]


def test_depths_count_late_rows_where_they_arrive(spark, tmp_path):
    minute, schema = dt.timedelta(minutes=1), "queue string, event_id long, ts timestamp, delta int"
    first = [("a", 1, START + 10 * minute, 1), ("a", 2, START + 11 * minute, 1), ("b", 3, START + 11 * minute, 1), ("a", 4, START + 9 * minute, 1)]
    second = [("a", 5, START + 5 * minute, 1), ("a", 6, START + 12 * minute, -1), ("a", 7, START + 1440 * minute, 1)]
    path = str(tmp_path)
    got = run(spark, stateful.depths(stream(spark, path, [first, second], schema), 2), path).collect()
    assert sorted((x.event_id, x.pending, x.rejected) for x in got) == [(1, 1, False), (2, 2, True), (3, 0, False), (4, 0, False), (5, 3, True), (6, 4, False), (7, 0, False)]


def test_windows_of_many_keys_equal_those_of_each(spark):
    """Found together, over three batches with late rows and windows that end in between."""
    import numpy as np

    r, state, each = random.Random(5), ([], [], []), {}
    for batch in range(3):
        rows = sorted((batch * 5_000 + r.randrange(-500, 6_000), r.choice("aaaaabcdefgh") + r.choice(["", "x"])) for _ in range(400))
        ms, keys = np.array([m for m, _ in rows]), np.array([k for _, k in rows], object)
        hits, state = admission.window_hits_by_key(keys, ms, state, 700, batch * 5_000 - 500)
        for k in set(keys):
            want, _, start, n = admission.window_hits(ms[keys == k], *each.get(k, (None, 0)), 700)
            each[k] = start, n
            assert hits[keys == k].tolist() == want.tolist()
        assert {k: (s, n) for k, s, n in zip(*state)} == {k: v for k, v in each.items() if v[0] + 700 >= batch * 5_000 - 500}


def test_a_step_folds_many_keys(spark, tmp_path):
    """3,000 addresses and users in 8 buckets, equal to the batch forms."""
    schema = "ip string, event_id long, ts timestamp, user_id long, is_admin boolean, tokens long"
    rows = [(f"{i % 3_000}", i, START + dt.timedelta(seconds=20 * i), i % 3_000, False, 30_000) for i in range(12_000)]
    path, whole = str(tmp_path), spark.createDataFrame(rows, schema)
    halves = stream(spark, path, [rows[:6_000], rows[6_000:]], schema)
    got = {x.event_id: x.reason for x in run(spark, stateful.admitted(halves, 86_400_000, 2, 50_000, buckets=8), path).collect()}
    assert got == {x.event_id: x.reason for x in admission.admitted(whole, 86_400_000, 2, 50_000).collect()}
    rates = {x.event_id: x.rate_ok for x in run(spark, jobs.rate_limited(halves, 86_400_000, 2, buckets=8), path, "rates").collect()}
    assert rates == {x.event_id: x.rate_ok for x in admission.rate_limited(whole, 86_400_000, 2).collect()}
