"""Folds dealt over parts: one key with most of the rows lies in several of them and comes out as by a plain loop."""

import datetime as dt
import random
import re

import pytest

from marginalia.operators import admission, papers, runs

UTC = dt.timezone.utc


@pytest.fixture
def many_parts(spark, monkeypatch):
    """Seven partitions and Arrow batches of 37 rows; gives the parts that were written."""
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    seen, write = [], runs.in_parts
    monkeypatch.setattr(runs, "in_parts", lambda *a: seen.append(write(*a)) or seen[-1])
    yield seen
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("step", "window", "most"), [(1, 100, 3), (50, 60_000, 20), (7000, 60_000, 5), (60_000, 10**9, 4)])
def test_a_hot_address(spark, many_parts, step, window, most):
    r, at, rows = random.Random(step), dt.datetime(2024, 1, 1, tzinfo=UTC), []
    for i in range(1500):
        at += dt.timedelta(milliseconds=r.choice([0, 0, 1, step, 3 * step]))
        rows.append((r.choice([*["hot"] * 18, "b", None, f"c{r.randrange(99)}"]), i, at))
    state, want = {}, {}
    for ip, i, ts in sorted(rows, key=lambda x: (x[2], x[1])):
        ms = round(ts.timestamp() * 1000)
        start, n = state.get(ip, (None, 0))
        start, n = (ms, 1) if start is None or ms - start > window else (start, n + 1)
        state[ip] = start, n
        want[i] = n <= most, None if n <= most else -((ms - start - window) // 1000)
    got = admission.rate_limited(spark.createDataFrame(rows, "ip string, event_id long, ts timestamp"), window, most)
    assert {x.event_id: (x.rate_ok, x.retry_after) for x in got.collect()} == want
    hot = spark.createDataFrame([(x[1],) for x in rows if x[0] == "hot"], "event_id long")
    assert many_parts[0].join(hot, "event_id").select("part").distinct().count() > 4


@pytest.mark.parametrize(("step", "numbered", "tall"), [(1, 0.3, 0.01), (8, 0.02, 0.1), (30, 0.002, 0), (30, 0, 0.1), (60, 0, 0.01)])
def test_a_hot_page(spark, many_parts, step, numbered, tall):
    r, rows, at = random.Random(step), [], {}
    for i in range(1200):
        page = r.choice([*[7] * 18, None, r.randrange(20, 60)])
        at[page] = at.get(page, -100) + r.choice([0, 0, step, step, 3 * step])
        height = r.randrange(40, 500) if r.random() < tall else r.choice([0, 5, 20])
        rows.append((page, at[page], r.randrange(300), height, f"{i % 9}. q{i}" if r.random() < numbered else r.choice([f" t{i} ", "x", "  "]), r.choice([0.1, 0.5, 1.0])))
    pages, want = {}, []
    for page, y, x, height, text, sure in rows:
        if sure >= 0.3 and text.strip():
            pages.setdefault(page, []).append((y, x, height, text.strip()))
    for page, blocks in pages.items():
        grp, bottom = 0, None
        for y, x, height, text in sorted(blocks):
            fresh = not grp or (re.match(r"\d+[.、\s]", text) and x < 200) or abs(y - bottom) >= 50
            grp, bottom = (grp + 1, y + height) if fresh else (grp, max(bottom, y + height))
            want.append((page, y, x, text, grp))
    got = papers.grouped_blocks(spark.createDataFrame(rows, "page long, y int, x int, height int, text string, confidence double"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert many_parts[0].where("page = 7").select("part").distinct().count() > 4


def test_empty_tables(spark):
    assert admission.rate_limited(spark.createDataFrame([], "ip string, event_id long, ts timestamp")).count() == 0
    assert papers.grouped_blocks(spark.createDataFrame([], "page long, y int, x int, height int, text string, confidence double")).count() == 0


def test_budget_of_a_busy_user_and_of_guests(spark):
    """Nine tenths of the rows are one user's, over hours and days; guests always pass and have no sum."""
    r, at, rows = random.Random(5), dt.datetime(2024, 1, 1, tzinfo=UTC), []
    for i in range(600):
        at += dt.timedelta(minutes=r.choice([0, 0, 7, 90]))
        rows.append((i, at, r.choice([*[1] * 18, 2, None]), r.choice([5, 70])))
    used, want = {}, {}
    for i, ts, user, tokens in sorted(rows, key=lambda x: (x[1], x[0])):
        key = user, ts.date()
        first = key not in used
        used[key] = used.get(key, 0) + tokens
        want[i] = (None, True) if user is None else (used[key], first or used[key] <= 400)
    got = admission.budgeted(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, tokens long"), 400)
    assert {x.event_id: (x.used, x.budget_ok) for x in got.collect()} == want
