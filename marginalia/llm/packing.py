"""Mixture-controlled packing: deficit round-robin over source queues in closed form.

Each source is a queue of its documents' tokens. A window takes its quantum from every queue; with shares in units of
1 / 2**20, what the first i queues have given after w windows is floor(w * size * A[i] / 2**20), A being the shares'
running sums. So a queue's deficit, the part of its due not yet served, is always under one token, is known for every
window without stepping through those before, and is carried across windows and from any partition into the next. Where
a queue would run dry, the schedule begins a new phase in which the queues that are left share anew; phases are two or three times as many
as queues, whatever the windows. Documents are cut where a window's quantum ends. Only the last sequence can have padding.

Targets are wanted token proportions by source, or `alpha`: each source's share is then in proportion to its tokens to
the power alpha, so that below 1 small sources have more of the early windows than their size, until they are empty.

A document's place in its queue is the tokens of its source in earlier partitions (sums by source and partition, joined
by key) plus those before it in its own. The token table is written once and read from there.

Defined cases: a null text is empty and gives the closing id alone. Null and empty sources are each a queue of their
own. Sources past max_queues, by tokens, share one last queue, so that the schedule is bounded; none is dropped. Repeated rows and null
doc_ids are documents like others, one set of pieces for each row. No documents, no sequences. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .tokens import default_path, shared

UNITS = 1 << 20


@dataclass(frozen=True)
class Phase:
    """Windows first .. first + count - 1 of `size` tokens; of their tokens, share[i] / units go to the first i queues."""

    first: int
    count: int
    size: int
    units: int
    share: tuple[int, ...]
    served: tuple[int, ...]  # by queue, before this phase


def _shares(weights: list[int], least: int) -> list[int]:
    """Whole units that sum to UNITS, at least `least` for each positive weight; what these have too much comes from all others in proportion."""
    import numpy as np

    shift = max(0, max(weights).bit_length() - 40)  # so that products stay within 63 bits
    w = np.array([x and max(1, x >> shift) for x in weights], np.int64)
    live = w > 0
    if least * live.sum() > UNITS // 2:
        raise ValueError("more queues than half a window's tokens")
    free, total, low = UNITS, int(w.sum()), np.zeros(len(w), bool)
    while (more := live & ~low & (w * free < least * total)).any():
        low |= more
        free -= least * int(more.sum())
        total -= int(w[more].sum())
    out = np.where(low, least, w * free // max(1, total))
    out[out.argmax()] += UNITS - out.sum()
    return out.tolist()


def schedule(tokens: list[int], size: int, targets: list[float] | None = None) -> list[Phase]:
    """Phases that serve queues of so many tokens to the last one; targets: wanted proportions, else those of the tokens.

    A share is at least one token a window, and a queue leaves when it is empty: then the others' shares grow alike.
    """
    left, phases, first = list(tokens), [], 0
    if targets is not None:  # as whole numbers, the largest 2 ** 40
        high = Fraction(max(targets, default=0)) or Fraction(1)
        wanted = [max(1, int(Fraction(t) / high * 2**40)) for t in targets]
    least = -(-UNITS // size)
    while sum(left) >= size:
        weights = list(left) if targets is None else [w if n else 0 for w, n in zip(wanted, left)]
        units = _shares(weights, least)
        # a queue gives under w * size * units / UNITS + 1 tokens in w windows
        count = min(((n - 1) * UNITS // (size * u) for n, u in zip(left, units) if u), default=0)
        served = tuple(t - n for t, n in zip(tokens, left))
        if count > 0:
            running = [0]
            for u in units:
                running.append(running[-1] + u)
            bounds = [count * size * a // UNITS for a in running]
            phases.append(Phase(first, count, size, UNITS, tuple(running), served))
            left = [n - (b - a) for n, a, b in zip(left, bounds, bounds[1:])]
        else:  # one window: queues that would run dry give what they have, the rest fill up in turn
            due = [min(n, -(-size * u // UNITS)) for n, u in zip(left, units)]
            over = sum(due) - size
            for i in sorted(range(len(due)), key=lambda i: left[i]):
                if over > 0 and left[i] > due[i]:
                    cut = min(over, due[i])
                    due[i] -= cut
                    over -= cut
            room = size - sum(due)
            for i in range(len(due)):
                more = min(left[i] - due[i], max(0, room))
                due[i] += more
                room -= more
            over = sum(due) - size
            for i in range(len(due) - 1, -1, -1):
                cut = min(max(0, over), due[i])
                due[i] -= cut
                over -= cut
            count = 1
            phases.append(_plain(first, size, due, served))
            left = [n - d for n, d in zip(left, due)]
        first += count
    if sum(left):
        phases.append(_plain(first, sum(left), left, tuple(t - n for t, n in zip(tokens, left))))
    return phases


def _plain(first: int, size: int, due: list[int], served: tuple[int, ...]) -> Phase:
    running = [0]
    for d in due:
        running.append(running[-1] + d)
    return Phase(first, 1, size, size, tuple(running), served)


def pieces(phases: list[Phase], queue: int, begin: int, n: int):
    """(start, length, window, offset) of the pieces of a queue's tokens begin .. begin + n - 1, as numpy arrays."""
    import numpy as np

    parts, at, end = [], begin, begin + n
    first = max(0, bisect.bisect_right(phases, begin, key=lambda p: p.served[queue]) - 1)
    for k in range(first, len(phases)):
        p = phases[k]
        low, high = p.share[queue], p.share[queue + 1]
        gives = p.count * p.size * high // p.units - p.count * p.size * low // p.units
        base = p.served[queue]
        if at >= base + gives or not gives:
            continue
        if at >= end:
            break
        stop = min(end, base + gives)
        unit = p.size * (high - low)
        w0 = max(0, (at - base - 1) * p.units // unit - 1)
        w1 = min(p.count, (stop - base + 1) * p.units // unit + 3)
        w = np.arange(w0, w1 + 1, dtype=np.int64)
        head, tail = _floor(w, p.size, low, p.units), _floor(w, p.size, high, p.units)
        mark = base + tail - head  # tokens given by the end of window w - 1
        a, b = np.maximum(mark[:-1], at), np.minimum(mark[1:], stop)
        own = b > a
        offset = (head[1:] - head[:-1]) + (a - mark[:-1])
        parts.append((a[own] - begin, (b - a)[own], p.first + w[:-1][own], offset[own]))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts))


def _floor(w, size: int, share: int, units: int):
    """floor(w * size * share / units) without overflow."""
    if units % size == 0:
        return w * share // (units // size)
    return w * (size * share // units) + w * (size * share % units) // units


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, path: str, close: int) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids as 16-bit bytes with the closing id, `before` the tokens of the same source earlier in the partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words, sums, part = shared(path), {}, TaskContext.get().partitionId()
        end = close.to_bytes(2, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):  # few texts at a time: the ids of one batch may be large
                some = batch.slice(lo, 512)
                ids = [x + end for x in words.encode([x or "" for x in some.column(2).to_pylist()])]
                before = []
                for s, x in zip(some.column(1).to_pylist(), ids):
                    before.append(sums.get(s, 0))
                    sums[s] = before[-1] + len(x) // 2
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([part] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "before", "n", "ids"],
                )

    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, part long, before long, n long, ids binary")


def pack(docs: DataFrame, *, path: str | None = None, close: int = 2, size: int = 4096, targets: dict[str | None, float] | None = None, alpha: float = 1.0, max_queues: int = 1000) -> DataFrame:
    """One row for each piece: doc_id, where it lies in its document and in its sequence, the CRC of its ids, and its source.

    targets: wanted token proportion by source (others get the least share until the named ones are empty); without
    them, tokens ** alpha.
    """
    from pyspark.sql import Window

    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = kept(tokenized(docs, path, close), "tokens")
    sums = kept(held.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("n"))
    big = [(r["source"], r["n"]) for r in totals.orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(max_queues).collect()]
    number = {s: i for i, (s, _) in enumerate(big)}
    rest = (totals.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in big)
    tokens = [n for _, n in big] + [rest]
    wanted = [n**alpha for n in tokens] if targets is None else [targets.get(s, 0) for s, _ in big] + [0]
    phases = schedule(tokens, size, None if targets is None and alpha == 1 else wanted)

    # The queue of a source; those past the first share the last one, ordered by source.
    queue = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, i in number.items() if s is not None for x in (s, i)]), F.col("source")), F.lit(len(big))) if any(s is not None for s in number) else F.lit(len(big))
    queue = F.when(F.col("source").isNull(), number.get(None, len(big))).otherwise(queue).cast("int")
    within = sums.withColumn("lead", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    leads = totals.withColumn("queue", queue)
    leads = leads.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy(F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    leads = within.alias("a").join(leads.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.part", "b.queue", (F.col("a.lead") + F.col("b.base")).alias("lead"))
    placed = held.alias("h").join(leads.alias("l"), (F.col("h.part") == F.col("l.part")) & F.col("h.source").eqNullSafe(F.col("l.source")))
    placed = placed.select("h.doc_id", "h.source", "l.queue", (F.col("l.lead") + F.col("h.before")).alias("begin"), "h.ids")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows, out, starts = [], [], 0
            queues, begins = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for k, ids in enumerate(batch.column(4)):
                wide = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start, length, window, offset = pieces(phases, queues[k], begins[k], len(wide))
                raw = memoryview(wide).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), length.tolist())]
                rows.append(np.full(len(start), k, np.int64))
                out.append((start, length, np.array(crc, np.int64), np.full(len(start), len(wide), np.int64), window, offset))
                starts += len(start)
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.concatenate(x)) for x in zip(*out))],
                    ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    out = placed.mapInArrow(run, f"doc_id {kind}, source string, {PIECE}")
    return out.select("doc_id", *[c for c in out.columns if c not in ("doc_id", "source")], "source")
