"""Tables as Parquet folders: reading with a schema, evolving it, writing whole states, upserts and patches."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, its zone-less timestamps as timestamps of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(zoned) if zoned else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or a temporary one in local runs."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="marginalia-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def states(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the whole states that lie at path, oldest first; one whose write has not been completed isn't there yet."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(at) if x.isDirectory()]
    whole = [(int(n[6:]), p) for n, p in found if n.startswith("state-") and n[6:].isdigit()]
    return sorted((k, p) for k, p in whole if fs.exists(_fs(spark, f"{p}/_SUCCESS")[1]))


def _blank(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def load(spark: SparkSession, path: str, schema: T.StructType, corrupt: str = "raise") -> DataFrame:
    """The newest state of the table at path, or a plain Parquet folder there; an empty one where nothing is there.

    corrupt: what unreadable files do, `raise` or, by the word "skip", count as empty.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", corrupt == "skip")
    own = states(spark, path)
    if own:
        return reader.parquet(own[-1][1])
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return _blank(spark, schema)
        raise


def save(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> None:
    """Replace the table at path: a new state is written beside those before it and counts from its success mark on.

    Nothing is moved or deleted until then, so a crash at any step leaves the state before. The newest `keep` states
    stay, for readers that have begun. One writer at a time.
    """
    spark = df.sparkSession
    before = states(spark, path)
    writer = df.write.mode("overwrite")  # over the rest of an attempt that broke off
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/state-{before[-1][0] + 1 if before else 0}")
    for _, old in before[: 1 - keep or None]:
        fs, at = _fs(spark, old)
        fs.delete(at, True)


def merge(batch: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 16) -> None:
    """Put batch's rows in by key into a table of hash buckets; the last by order stays. Only buckets that batch touches are written.

    Each state holds the buckets that its batch has touched; putting a batch in again changes nothing. One writer at a time.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")
    touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # `buckets` at most
    if not touched:
        return
    before = states(spark, path)
    both = latest(merged(spark, path, batch.schema, touched).unionByName(batch), keys, order).select("*", bucket)
    both.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state-{before[-1][0] + 1 if before else 0}")


def merged(spark: SparkSession, path: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """What merge() has put in at path: the newest state of each bucket, or of some."""
    newest: dict[int, str] = {}
    for _, state in states(spark, path):
        fs, at = _fs(spark, state)
        names = [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(at)]
        newest |= {int(n.removeprefix("bucket=")): p for n, p in names if n.startswith("bucket=")}
    paths = [p for k, p in sorted(newest.items()) if buckets is None or k in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else _blank(spark, schema)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16) -> None:
    """Write the table of merge() as one state and delete those before it; for a time without readers."""
    before = states(spark, path)
    rows = merged(spark, path, schema).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state-{before[-1][0] + 1 if before else 0}")
    for _, old in before:
        fs, at = _fs(spark, old)
        fs.delete(at, True)


def evolve(df: DataFrame, added: dict[str, Column]) -> DataFrame:
    """df with each column that it lacks, filled with its default; columns it has stay as they are."""
    return df.withColumns({n: c for n, c in added.items() if n not in df.columns})


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns: a maximum of a struct by key. Map sides combine, so a key of very many
    rows is one row for each task; Spark plans it as a sort-based aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = F.max(F.struct(*order, *rest)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_top.{c}") for c in [*order, *rest]]).select(df.columns)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """base with batch's rows put in by key; between rows of a key the last by order stays. Applying it twice changes nothing."""
    return latest(base.unionByName(batch, allowMissingColumns=True), keys, order)


def patch(base: DataFrame, changes: DataFrame, key: str, allowed: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """base with the allowed columns of changes where those aren't null; stamp is now on rows that changed."""
    own = [c for c in changes.columns if c in allowed]
    marked = changes.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in own])
    hit = reduce(lambda a, b: a | b, [F.col(f"_new_{c}").isNotNull() for c in own], F.lit(False))
    out = base.join(marked, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in own} | {stamp: F.when(hit, now).otherwise(F.col(stamp))})
    return out.select(base.columns)


def new_only(batch: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows of batch whose key neither base nor an earlier row of batch has; the order within batch is that of `id`."""
    return first_of(batch, [key], [F.col("id")]).join(base.select(key), key, "left_anti").select(batch.columns)


def prefer(sources: list[DataFrame], key: str) -> DataFrame:
    """One row for each key, from the first source that has it."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    return first_of(reduce(DataFrame.unionByName, ranked), [key], [F.col("_rank")]).drop("_rank")
