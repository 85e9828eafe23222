"""Structured Streaming forms: daily counts, upserts, late rows and rate limits, each equal to its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marginalia.operators.admission import window_hits_by_key
from marginalia.operators.runs import key_text
from marginalia.sources.tables import latest, merge


def daily_counts(stream: DataFrame, by: str, ts: str = "ts", late: str = "1 hour", counted: Column | None = None) -> DataFrame:
    """Rows by day and `by`; a day comes out, once, when the watermark has passed it, and its state is dropped.

    counted: which rows count; the others, such as a source's time signals, move the watermark alone.
    """
    n = F.count("*") if counted is None else F.count_if(counted)  # a filter would be pushed below the watermark
    days = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), by).agg(n.alias("n"))
    return days.where("n > 0").select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), by, "n")


def distinct_ids(stream: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = 16):
    """A foreachBatch function that keeps the last row of each key in the table of buckets at path.

    A batch writes the buckets that it touches as one more state; a replayed batch changes nothing.
    """

    def apply(batch: DataFrame, _: int) -> None:
        merge(latest(batch, keys, order), path, keys, order, buckets)

    return apply


def with_late(on_time: str, late: str, ts: str, minutes: int, run: str = "first"):
    """A foreachBatch function that writes rows to on_time, or to late when they are `minutes` behind the batches before.

    Each batch has a folder of its own, overwritten when it is replayed, and one row with its greatest time beside it.
    run: a name that stays as long as the stream's checkpoint does; with a new checkpoint, numbers begin again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks, path = spark.createDataFrame([], "number long, seen timestamp"), f"{on_time}-seen/run={run}"
        if number:
            marks = spark.read.schema("seen timestamp, number long").parquet(path)
        seen = marks.where(F.col("number") < number).agg(F.max("seen")).first()[0]
        is_late = F.lit(False) if seen is None else F.coalesce(F.col(ts) < F.lit(seen) - F.expr(f"interval {minutes} minutes"), F.lit(False))
        batch.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/run={run}/number={number}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{late}/run={run}/number={number}")
        batch.agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{path}/number={number}")

    return apply


def rate_limited(stream: DataFrame, window_ms: int = 60_000, most: int = 20, key: str = "ip", buckets: int = 256) -> DataFrame:
    """event_id and rate_ok of each request; the state of a key is two numbers, dropped when its window is over.

    Keys go through in buckets, by hash, so that a step in Python folds many of them at once. Rows of a key are taken in
    order of time within each micro-batch, as in the batch form over the whole; what a task holds of a bucket is bounded by
    the source's files for each micro-batch. buckets: stays as long as the stream's checkpoint does.
    """
    import pandas as pd

    def step(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows, watermark = pd.concat(list(frames)).sort_values(["ms", "event_id"]), state.getCurrentWatermarkMs()
        hits, after = window_hits_by_key(rows["key"].to_numpy(object), rows["ms"].to_numpy(), state.get if state.exists else ([], [], []), window_ms, watermark)
        state.update(after)
        state.setTimeoutTimestamp(max([x + window_ms for x in after[1]] + [watermark]) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "rate_ok": hits <= most})

    rows = stream.withWatermark("ts", "1 hour").select(bucket(F.col(key), buckets).alias("bucket"), key_text(F.col(key)).alias("key"), "event_id", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("bucket").applyInPandasWithState(step, "event_id long, rate_ok boolean", "keys array<string>, starts array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def run_once(stream: DataFrame, checkpoint: str, *, to: str | None = None, each=None) -> None:
    """Process what is there now, into Parquet files that a replay doesn't double, or by a function of each micro-batch."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", to)
    writer.start().awaitTermination()


def source(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the Parquet files at path, so many in a micro-batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
