"""Registered streaming jobs: the given events come through a file source in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.tables import merged, scratch
from marginalia.streaming import jobs, stateful

from .domain import SQL_FMT, Domain, said, sql
from .registry import query
from .requests import _LATEST, _OVERLOAD, _RATED, _SPENT, LIMIT, MOST, WINDOW_MS

FILES = 4  # of a micro-batch


def _replayed(d: Domain, rows: DataFrame, order: str, signal: DataFrame | None = None, late: str | None = None) -> DataFrame:
    """rows as a stream in three micro-batches, thirds of the time that they cover: files are read in the order in which they were written.

    late: a condition on rows that come with the last batch, whatever their time. signal: rows that come after all others.
    """
    path = scratch(d.spark, "stream-input")
    begin, end = rows.agg(F.min(F.unix_micros(order)), F.max(F.unix_micros(order))).first()
    low, high = (begin + k * (end - begin) // 3 for k in (1, 2)) if begin is not None else (0, 0)
    part = F.when(F.unix_micros(order) <= low, 0).when(F.unix_micros(order) <= high, 1).otherwise(2)
    part = part if late is None else F.when(F.expr(late), 2).otherwise(part)
    for k in range(3):
        rows.where(part == k).repartition(FILES).write.mode("append").parquet(path)
    if signal is not None:
        for _ in range(2 * FILES):  # two micro-batches: one moves the watermark, one brings out what it closes
            signal.coalesce(1).write.mode("append").parquet(path)
    return jobs.source(d.spark, path, rows, FILES)


@query(sql("SELECT strftime(ts, '%Y-%m-%d') AS day, endpoint, count(*) AS n FROM requests GROUP BY 1, 2"))
def stream_daily_counts(d: Domain) -> DataFrame:
    """Closed days alone come out; a signal from three days after the last event closes them."""
    rows, out = d.requests(), scratch(d.spark, "daily")
    signal = rows.orderBy(F.desc("ts")).limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("interval 3 days")})
    counts = jobs.daily_counts(_replayed(d, rows, "ts", signal), "endpoint", counted=F.col("event_id") >= 0)
    jobs.run_once(counts, scratch(d.spark, "stream-state"), to=out)
    return d.spark.read.schema(counts.schema).parquet(out)


@query(sql(f"SELECT task_id, kind, status, strftime(updated_at, {SQL_FMT}) AS updated_at FROM c", _LATEST))
def stream_upsert(d: Domain) -> DataFrame:
    path, rows = scratch(d.spark, "tasks"), d.transitions()
    jobs.run_once(_replayed(d, rows, "updated_at"), scratch(d.spark, "stream-state"), each=jobs.upsert_into(path, ["task_id", "kind"], ["updated_at", "event_id"]))
    return merged(d.spark, path, rows.schema).select("task_id", "kind", "status", said("updated_at").alias("updated_at"))


@query(sql(f"SELECT event_id, hits <= {MOST} AS rate_ok FROM r", _RATED))
def stream_rate_limit(d: Domain) -> DataFrame:
    out = scratch(d.spark, "rated")
    rated = jobs.rate_limited(_replayed(d, d.requests(), "ts"), WINDOW_MS, MOST)
    jobs.run_once(rated, scratch(d.spark, "stream-state"), to=out)
    return d.spark.read.schema("event_id long, rate_ok boolean").parquet(out).select("event_id", F.col("rate_ok"))


@query(sql(f"SELECT event_id, CASE WHEN NOT rate_ok THEN 'rate' WHEN is_admin THEN 'admin' WHEN used <= {LIMIT} OR k = 1 THEN 'ok' ELSE 'budget' END AS reason FROM (SELECT requests.*, hits <= {MOST} AS rate_ok FROM requests JOIN r USING (event_id)) q "
    f"LEFT JOIN (SELECT event_id, {_SPENT} AS used, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM requests JOIN (SELECT event_id FROM r WHERE hits <= {MOST}) USING (event_id) WHERE NOT is_admin) b USING (event_id)", _RATED))  # fmt: skip
def stream_admission(d: Domain) -> DataFrame:
    """One stream of two chained processors: the rate by address, then the budget by user of what the first lets through and is no administrator's."""
    out = scratch(d.spark, "admitted")
    reasons = stateful.admitted(_replayed(d, d.requests(), "ts"), WINDOW_MS, MOST, LIMIT)
    with stateful.rocksdb(d.spark):
        jobs.run_once(reasons, scratch(d.spark, "stream-state"), to=out)
    return d.spark.read.schema(reasons.schema).parquet(out).select("event_id", "reason")


def _task_changes(d: Domain) -> DataFrame:
    return d.transitions().withColumnRenamed("updated_at", "ts")


@query(sql("""SELECT task_id, kind, strftime(updated_at, {}) AS changed FROM (SELECT *, lead(updated_at) OVER (PARTITION BY task_id, kind ORDER BY updated_at, event_id) AS next FROM transitions)
    WHERE epoch_us(coalesce(next, (SELECT max(ts) FROM events))) // 1000 - epoch_us(updated_at) // 1000 > CASE kind WHEN 'paper' THEN 48 ELSE 24 END * 3600000""".format(SQL_FMT)))
def stream_expired(d: Domain) -> DataFrame:
    """States of tasks that outlive their time, each by a timer; the signal at the end moves the watermark to the last event's time."""
    rows, out = _task_changes(d), scratch(d.spark, "expired")
    signal = rows.orderBy(F.desc("ts")).limit(1).withColumns({"task_id": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr("interval 1 hour")})
    hours = F.when(F.col("kind") == "paper", 48).otherwise(24)
    over = stateful.expiries(_replayed(d, rows, "ts", signal), hours * 3_600_000)
    with stateful.rocksdb(d.spark):
        jobs.run_once(over, scratch(d.spark, "stream-state"), to=out)
    return d.spark.read.schema(over.schema).parquet(out).where("task_id >= 0").select("task_id", "kind", said("changed").alias("changed"))


@query(_OVERLOAD)
def stream_overload(d: Domain) -> DataFrame:
    """Depths of the queues by a counter for each queue and day; equal to the batch form's."""
    out, delta = scratch(d.spark, "depths"), F.when(F.col("status").isin("queued", "processing"), 1).otherwise(-1)
    rows = _task_changes(d).select(F.col("kind").alias("queue"), "ts", "event_id", delta.alias("delta"))
    found = stateful.depths(_replayed(d, rows, "ts"), 20)
    with stateful.rocksdb(d.spark):
        jobs.run_once(found, scratch(d.spark, "stream-state"), to=out)
    return d.spark.read.schema(found.schema).parquet(out)


@query(sql("""SELECT event_id, event_id % 50 = 0 AND ts < (SELECT max(ts) FROM requests WHERE event_id % 50 <> 0 AND epoch_us(ts) <= b.high) - INTERVAL 60 MINUTE AS is_late
    FROM requests, (SELECT min(epoch_us(ts)) + 2 * (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 AS high FROM requests) b"""))
def stream_late(d: Domain) -> DataFrame:
    """Every fiftieth event comes with the last micro-batch; those an hour behind the batches before go to a table of their own."""
    on_time, late, rows = scratch(d.spark, "on-time"), scratch(d.spark, "late"), d.requests()
    jobs.run_once(_replayed(d, rows, "ts", late="event_id % 50 = 0"), scratch(d.spark, "stream-state"), each=jobs.with_late(on_time, late, "ts", 60))
    read = lambda path, is_late: d.spark.read.schema(rows.schema).parquet(path).select("event_id", F.lit(is_late).alias("is_late"))
    return read(on_time, False).unionByName(read(late, True))


@query(sql("SELECT DISTINCT event_id, endpoint FROM requests"))
def stream_distinct(d: Domain) -> DataFrame:
    """Events of which each third comes twice, each once."""
    rows, out = d.requests(), scratch(d.spark, "distinct")
    twice = rows.unionByName(rows.where("event_id % 3 = 0"))
    jobs.run_once(jobs.distinct_ids(_replayed(d, twice, "ts"), "event_id").select("event_id", "endpoint"), scratch(d.spark, "stream-state"), to=out)
    return d.spark.read.schema("event_id long, endpoint string").parquet(out)
