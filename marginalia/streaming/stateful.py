"""Streams whose state has timers: admission in one query, expiry of tasks, queue depths.

Each is a stateful processor by key; its state lies in the RocksDB store, so it isn't bounded by memory. What a task holds
of a key is the rows of one micro-batch, bounded by the source's files for each. Rows of a key are taken in order of time
within a micro-batch; a row of an earlier time than one of an earlier micro-batch counts where it arrives. Rows older than
the watermark are dropped before they reach a processor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from marginalia.operators.runs import key_text
from marginalia.streaming import jobs

DAY_MS = 86_400_000
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB, which processors with timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class _Processor(StatefulProcessor):
    schema: str

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def get(self, otherwise: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else otherwise

    def wake_at(self, ms: int, timers) -> None:
        """One timer, in place of those there are, at ms or at the first time that is still ahead."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(ms, timers.getCurrentWatermarkInMs() + 1))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        # At once: where a generator runs on, the state may be the next key's.
        return iter(list(self.step(key, rows, timerValues)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        return iter(list(self.over(key)))

    def over(self, key) -> Iterator:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ordered(frames):
    """A key's rows of a micro-batch by time, and their times in milliseconds."""
    import pandas as pd

    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    return rows, rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") // 1000


class Rate(_Processor):
    """State of a bucket of addresses: for each one, the window's start and its requests so far; it goes when the window is over."""

    schema = "keys array<string>, starts array<long>, counts array<long>"

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def step(self, key, rows: Iterator, timers) -> Iterator:
        from marginalia.operators.admission import window_hits_by_key

        rows, ms = _ordered(rows)
        hits, after = window_hits_by_key(rows["ip"].to_numpy(object), ms, self.get(([], [], [])), self.window_ms, timers.getCurrentWatermarkInMs())
        self.state.update(after)
        self.wake_at(max(after[1], default=0) + self.window_ms + 1, timers)
        yield rows.drop(columns=["bucket", "ip"], errors="ignore").assign(rate_ok=hits <= self.most)


class Budget(_Processor):
    """State of a bucket of users: for each user and day, the day's tokens; it goes when the day is over. Requests that need no budget pass, without a state."""

    schema = "users array<string>, days array<long>, used array<long>"

    def __init__(self, limit: int):
        self.limit = limit

    def step(self, key, rows: Iterator, timers) -> Iterator:
        import numpy as np
        import pandas as pd

        if key[0] < 0:
            for frame in rows:
                yield frame[["event_id", "ts"]].assign(reason=np.where(~frame["rate_ok"].astype(bool), "rate", np.where(frame["is_admin"].astype(bool), "admin", "ok")))
            return
        rows, ms = _ordered(rows)
        used = {(user, day): n for user, day, n in zip(*self.get(([], [], [])))}
        code, own = pd.MultiIndex.from_arrays([rows["spender"], ms // DAY_MS]).factorize()
        before = np.array([used.get(k, 0) for k in own], np.int64)
        spent = pd.Series(rows["tokens"].to_numpy()).groupby(code).cumsum().to_numpy() + before[code]
        first = ~pd.Series(code).duplicated().to_numpy() & np.array([k not in used for k in own])[code]
        used.update(zip(own, (before + np.bincount(code, rows["tokens"].to_numpy(), len(own)).astype(np.int64)).tolist()))
        watermark = timers.getCurrentWatermarkInMs()
        left = [(user, int(day), n) for (user, day), n in used.items() if (day + 1) * DAY_MS > watermark]
        self.state.update(tuple(map(list, zip(*left))) if left else ([], [], []))
        self.wake_at((max((day for _, day, _ in left), default=0) + 1) * DAY_MS, timers)
        yield rows[["event_id", "ts"]].assign(reason=np.where(first | (spent <= self.limit), "ok", "budget"))


def admitted(stream: DataFrame, window_ms: int, most: int, limit: int, late: str = "1 hour", spread: int = 64, buckets: int = 256) -> DataFrame:
    """event_id, ts and reason of each request, by two chained processors: the rate by address, then the budget by user.

    Addresses and users go through in buckets, by hash, so that a step in Python folds many of them at once; `buckets` and
    `spread` stay as long as the stream's checkpoint does. The second one's state sees only what the first lets through, is no administrator's
    and has a user; all other rows pass it under `spread` keys of their own, so that guests are no hot key.
    """
    rows = stream.withWatermark("ts", late).select(jobs.bucket(F.col("ip"), buckets).alias("bucket"), key_text(F.col("ip")).alias("ip"), "event_id", "ts", "user_id", "is_admin", "tokens")
    user = stream.schema["user_id"].dataType.simpleString()
    rated = rows.groupBy("bucket").transformWithStateInPandas(
        Rate(window_ms, most), f"event_id long, ts timestamp, user_id {user}, is_admin boolean, tokens long, rate_ok boolean", "append", "eventtime", eventTimeColumnName="ts"
    )
    spends = F.col("rate_ok") & ~F.col("is_admin")
    keyed = rated.withColumn("spender", F.when(spends, F.col("user_id").cast("string")))
    keyed = keyed.withColumn("bucket", F.when(F.col("spender").isNull(), -1 - F.pmod("event_id", F.lit(spread))).otherwise(jobs.bucket(F.col("spender"), buckets)))
    return keyed.groupBy("bucket").transformWithStateInPandas(Budget(limit), "event_id long, ts timestamp, reason string", "append", "eventtime", eventTimeColumnName="ts")


class Expiry(_Processor):
    """State: when the task changed last and how long it lives; a row comes out when that time is over."""

    schema = "changed timestamp, life long"

    def step(self, key, rows: Iterator, timers) -> Iterator:
        import numpy as np
        import pandas as pd

        rows, ms = _ordered(rows)
        at, life = rows["ts"].tolist(), rows["life"].tolist()
        if self.state.exists():
            changed, lives = self.state.get()
            at, life, ms = [changed, *at], [lives, *life], np.r_[pd.Timestamp(changed).value // 1_000_000, ms]
            if ms[-1] < ms[0]:  # all came late: what is known stays
                return
        over = np.flatnonzero(ms[1:] - ms[:-1] > np.array(life[:-1]))
        self.state.update((at[-1], life[-1]))
        self.wake_at(int(ms[-1]) + life[-1] + 1, timers)
        if len(over):
            yield pd.DataFrame({"task_id": key[0], "kind": key[1], "changed": [at[i] for i in over]})

    def over(self, key) -> Iterator:
        import pandas as pd

        changed, _ = self.state.get()
        self.state.clear()
        yield pd.DataFrame({"task_id": [key[0]], "kind": [key[1]], "changed": [changed]})


def expiries(stream: DataFrame, life: Column, late: str = "1 hour") -> DataFrame:
    """(task_id, kind, changed) of each state of a task that has outlived `life` milliseconds without another change, once.

    stream: task_id, kind, event_id, ts. A state comes out as soon as the watermark has passed its end, or with the first change after it.
    """
    rows = stream.withWatermark("ts", late).select(F.col("task_id").cast("string").alias("task_id"), "kind", "event_id", "ts", life.cast("long").alias("life"))
    id_type = stream.schema["task_id"].dataType.simpleString()
    over = rows.groupBy("task_id", "kind").transformWithStateInPandas(Expiry(), "task_id string, kind string, changed timestamp", "append", "eventtime")
    return over.withColumn("task_id", F.col("task_id").cast(id_type))


class Depth(_Processor):
    """State: what is pending in a queue of a day; it goes when the day is over and its late rows are."""

    schema = "pending long"

    def __init__(self, depth: int):
        self.depth = depth

    def step(self, key, rows: Iterator, timers) -> Iterator:
        import numpy as np

        rows, ms = _ordered(rows)
        delta = rows["delta"].to_numpy()
        after = np.cumsum(delta) + self.get((0,))[0]
        self.state.update((int(after[-1]),))
        self.wake_at((int(ms[-1]) // DAY_MS + 1) * DAY_MS, timers)
        yield rows[["event_id"]].assign(pending=after - delta, rejected=(delta > 0) & (after - delta >= self.depth))


def depths(stream: DataFrame, depth: int = 200, late: str = "1 hour") -> DataFrame:
    """event_id, what was pending in its queue of the day before it, and whether it is an arrival that is rejected.

    stream: queue, ts, event_id, delta (1 for an arrival, -1 for a task that ends).
    """
    rows = stream.withWatermark("ts", late).select("queue", F.to_date("ts").alias("day"), "ts", "event_id", F.col("delta").cast("long").alias("delta"))
    return rows.groupBy("queue", "day").transformWithStateInPandas(Depth(depth), "event_id long, pending long, rejected boolean", "append", "eventtime")
