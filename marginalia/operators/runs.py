"""Folds along a key's rows in their order, dealt over tasks.

Rows are range-partitioned by key and order, so a key of any size lies in several parts. Each part is folded alone. Only
the first key of a part can have begun in the part before: its rows are open, and the part says how what it hands on
follows from what it is handed. These sayings, one for each part, are composed in order; open rows are settled after that.
The parts are written once, because a range partition drawn again need not have the same bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.sources.tables import scratch

#: What a part says of itself: its first and last key, whether these are one run of rows, and numbers of its fold.
SAYING = "struct<first: string, last: string, one: boolean, numbers: array<bigint>, lists: array<array<bigint>>>"


def in_parts(rows: DataFrame, order: list[str], fold: Callable[[Iterator, int], Iterator], schema: str, name: str) -> DataFrame:
    """What fold(batches, part) gives for each part of rows in order, written and read back; schema's last column is `saying`."""
    from pyspark import TaskContext

    def run(batches):
        return fold(batches, TaskContext.get().partitionId())

    path = scratch(rows.sparkSession, name)
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    found.write.parquet(path)
    return rows.sparkSession.read.schema(found.schema).parquet(path)


def handed(parts: DataFrame, follow: Callable[[list, list, list | None], list], width: int) -> DataFrame:
    """(part, handed): what each part is handed by the one before, null where its first key begins with it.

    follow(numbers, lists, handed) gives what a part of one run hands on; a part of more runs hands on the first `width` of
    its numbers. There is one saying for each part, so one task reads them in order, a batch at a time.
    """

    def run(batches):
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            out = []
            for said in batch.column(1).to_pylist():
                given = state if last is not None and said["first"] == last[0] else None
                out.append(given)
                state = follow(said["numbers"], said["lists"], given) if said["one"] else said["numbers"][:width]
                last = (said["last"],)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["part", "handed"])

    sayings = parts.where("saying is not null").select("part", "saying")
    return sayings.repartition(1).sortWithinPartitions("part").mapInArrow(run, "part int, handed array<bigint>")


def key_text(key: Column) -> Column:
    """A key as a string that tells null from all others, so that parts can compare their keys."""
    return F.when(key.isNull(), "").otherwise(F.concat(F.lit("="), key.cast("string")))
