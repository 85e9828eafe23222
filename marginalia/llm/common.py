"""What the operators share: reading tables, tables kept in the shared folder, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the six ASCII characters.
SPACE = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local runs that set none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("marginalia.scratch.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("marginalia.scratch.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends there, and a lost executor loses nothing. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what kept() wrote, once nothing that is still to run reads it."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bitmap(keys: DataFrame, most: int = 30):
    """A Bloom filter over the long column of keys, about 16 bits a key, at most 2 ** most bits (128 MB); for marked().

    Beyond that bound more keys are marked that aren't there. Every use therefore settles the marked rows by a join.
    """
    import numpy as np

    bits = min(most, max(16, (16 * keys.count()).bit_length()))
    key, mask = F.col(keys.columns[0]), (1 << bits) - 1
    at = keys.select(F.explode(F.array(key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 64 - bits))).alias("at"))
    chunk = F.shiftright("at", 20).alias("chunk")

    def run(table):
        import pyarrow as pa

        ones = np.zeros(1 << 20, np.uint8)
        ones[table.column("at").to_numpy() & ((1 << 20) - 1)] = 1
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "words": pa.array([np.packbits(ones, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(max(1 << bits, 1 << 20) >> 6, np.uint64)
    for r in at.distinct().select("at", chunk).groupBy("chunk").applyInArrow(run, "chunk long, words binary").collect():
        out[r["chunk"] << 14 : (r["chunk"] + 1) << 14] = np.frombuffer(r["words"], np.uint64)
    return out[: 1 << (bits - 6)]


def marked(key, words):
    """Which of the longs in key are in the bitmap, or look as if they were."""
    import numpy as np

    h, bits = key.view(np.uint64), int(len(words)).bit_length() + 5
    out = np.ones(len(h), bool)
    for shift in (0, 64 - bits):
        at = (h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        out &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def rank(column):
    """Ranks of an Arrow column's values, equal values alike, nulls after all others: for sorts by ids of any type."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.rank(column, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times within body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words between the six white-space characters; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def text_batches(batches: Iterator, column: str = "text"):
    """(batch, list of UTF-8 byte strings) for each Arrow batch; null is empty. At the end freed memory is given back."""
    import pyarrow as pa

    for batch in batches:
        raw = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        yield batch, [b"" if x is None else x for x in raw.to_pylist()]
    batch = raw = None
    give_back()


def give_back() -> None:
    """Return what this process has freed to the system: a Python worker goes on to other stages and counts in the executor's memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def arrays(df: DataFrame) -> dict:
    """The numeric columns of a bounded DataFrame as numpy arrays; each Arrow batch comes to the driver as a few byte strings, not as rows."""
    import numpy as np

    kinds = {"bigint": np.int64, "int": np.int32, "double": np.float64, "float": np.float32}
    names = df.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).tobytes()], pa.binary()) for c in batch.columns], names)

    rows = df.mapInArrow(run, ", ".join(f"{c} binary" for c in names)).collect()
    return {c: np.frombuffer(b"".join(r[c] for r in rows), kinds[t]) for c, t in df.dtypes}
