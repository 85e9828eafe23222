"""Periodic runs of words, found from string synchronising sets at dyadic scales.

A run is a stretch of words with smallest period q, at least max(least, repeats * q) words long, that no neighbouring
word extends. At scale t, positions are chosen by the hashes of the t-word blocks around them: a position is in the set
if its block, or the one t further on, has the least hash among those between, blocks of period t / 3 or less left out.
The choice depends on the 2t words from the position on alone, so inside a run of period q every chosen position returns
q words later with an equal context. Pairs of equal contexts at most 3t apart propose periods from 1.5t on; each is then
extended by comparing the words themselves. Since a run of period q >= 1.5t that holds no such pair would have t / 3 or
less for a period, none is missed, whatever the hashes. Periods under 12, and with them the highly periodic regions that
the sets of small scales leave out, are found directly by comparing each word with the one so many words on.

Many texts are laid end to end, each with an end mark of its own, so no run crosses texts and numpy works on all at once.
A pair of equal contexts is at least t / 3 apart from the next, so the work is n log n in words at every scale.

Defined cases: a null or blank text has no words and no runs; a null doc_id is a row like any other; repeated rows come
out once each; a very long text is one batch of its own, in memory of some 100 bytes a word; an empty table gives an
empty one. Of runs of equal exponent the one that starts first is the greatest, then the one of the smaller period.
Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: The smallest scale: its periods begin at 12, shorter ones are compared directly.
FIRST = 8


def _stretches(w, d: int, least: int):
    """(start, length) of the maximal stretches of w with period d (smallest or not) and least words or more."""
    import numpy as np

    at = np.flatnonzero(w[:-d] == w[d:])
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    lo, hi = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1
    use = hi - lo + d >= least
    return lo[use], (hi - lo + d)[use]


def _covered(n: int, start, stop):
    """Which of n positions lie in one of the spans."""
    import numpy as np

    if not len(start):
        return np.zeros(n, bool)
    steps = np.bincount(start, minlength=n + 1)[: n + 1] - np.bincount(stop, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def _window_min(x, width: int):
    """Minimum of each `width` values from a position on."""
    import numpy as np

    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def synchronising(w, t: int, periodic):
    """(positions, contexts): the synchronising set at scale t and the hash of the 2t words from each position on.

    periodic: which positions begin a block of t words whose period is t / 3 or less.
    """
    import numpy as np

    # Prefix hashes modulo 2 ** 64: equal blocks have equal hashes, which is all that is needed of them.
    with np.errstate(over="ignore"):
        base, seed = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
        powers = np.empty(len(w) + 1, np.uint64)
        powers[0] = 1
        powers[1:] = base
        powers = np.multiply.accumulate(powers)
        mixed = (w.astype(np.uint64) + np.uint64(1)) * seed
        mixed ^= mixed >> np.uint64(29)
        prefix = np.r_[np.zeros(1, np.uint64), np.add.accumulate(mixed * powers[: len(w)])]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        back = np.empty(len(w) + 1, np.uint64)
        back[0] = 1
        back[1:] = inverse
        back = np.multiply.accumulate(back)

        def block(length):
            h = (prefix[length:] - prefix[:-length]) * back[: len(w) - length + 1]
            h ^= h >> np.uint64(32)
            h *= seed
            return h ^ (h >> np.uint64(29))

        ids, context = block(t), block(2 * t)
    top = np.uint64(2**64 - 1)
    ids = np.where(periodic[: len(ids)], top, np.minimum(ids, top - np.uint64(1)))
    low = _window_min(ids, t + 1)  # as many as there are contexts
    chosen = np.flatnonzero((low != top) & ((ids[: len(low)] == low) | (ids[t : t + len(low)] == low)))
    return chosen, context[chosen]


def _proposed(w, t: int, at, context):
    """(position, period) for pairs of equal contexts 1.5t to 3t apart."""
    import numpy as np

    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    found, k, live = [], 1, np.arange(max(0, len(at) - 1))
    while len(live):
        live = live[live + k < len(at)]
        apart = at[live + k] - at[live]
        same = (context[live + k] == context[live]) & (apart < 3 * t)
        live, apart = live[same], apart[same]
        use = 2 * apart >= 3 * t
        found.append((at[live][use], apart[use]))
        k += 1  # later equal contexts lie further off, so positions without one at k have none beyond
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[x for x, _ in found]]), np.concatenate([none, *[x for _, x in found]])


def _extended(w, t: int, at, period):
    """(start, length, period) of the maximal stretches around proposals. Each position is compared once for a period: a
    proposal goes on to the next one of its period, and only the first of a chain looks back."""
    import numpy as np

    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    n, chunk = len(w), max(32, t // 4)
    same = period[1:] == period[:-1]
    limit = np.minimum(np.r_[np.where(same, at[1:], n), n], n - period)

    def walk(frm, d, far, sign):
        """Steps from frm on (or back) while words d apart are equal, at most far."""
        done, live = np.zeros(len(frm), np.int64), np.arange(len(frm))
        step = np.arange(chunk)
        while len(live):
            k = done[live][:, None] + step
            ok = k < far[live][:, None]
            x = np.where(ok, frm[live][:, None] + sign * k, 0)
            ok &= w[x] == w[np.where(ok, x + d[live][:, None], 0)]
            run = np.where(ok.all(axis=1), chunk, ok.argmin(axis=1))
            done[live] += run
            live = live[run == chunk]
        return done

    end = at + walk(at, period, limit - at, 1)
    first = np.r_[True, ~(same & (end[:-1] >= at[1:]))] if len(at) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    tails = np.r_[heads[1:], len(at)][: len(heads)] - 1
    start = at[heads] - walk(at[heads] - 1, period[heads], at[heads], -1)
    return start, end[tails] + period[heads] - start, period[heads]


def runs(w, sizes, least: int = 24, repeats: int = 3):
    """(start, length, period) of all runs of the integers w, sorted by start and period; repeats is 3 or more.

    w holds texts end to end, of the given sizes; each ends with a value that is nowhere else in w and counts in its size.
    """
    import numpy as np

    if repeats < 3:
        raise ValueError("three repeats or more: fewer need denser sets")
    s, e, p = [], [], []
    for d in range(1, 3 * FIRST // 2):
        if d < len(w):
            lo, length = _stretches(w, d, max(min(FIRST, least), 3 * d))
            s, e, p = [*s, lo], [*e, length], [*p, np.full(len(lo), d)]
    bounds, t = np.r_[0, np.cumsum(sizes)], FIRST
    while True:
        long = np.flatnonzero(sizes > 9 * t // 2)  # three periods of 1.5t and the end mark
        if not len(long):
            break
        where = np.concatenate([np.arange(a, b) for a, b in zip(bounds[long].tolist(), bounds[long + 1].tolist())])
        own = w[where]
        # Blocks of a short period: all of them lie in stretches that are known by now.
        ks, kl, kp = (np.concatenate(x) for x in (s, e, p))
        low = (3 * kp <= t) & (kl >= t)
        dense = _covered(len(w), ks[low], (ks + kl - t + 1)[low])[where]
        lo, length, d = _extended(own, t, *_proposed(own, t, *synchronising(own, t, dense)))
        enough = length >= 3 * d
        s, e, p = [*s, where[lo[enough]]], [*e, length[enough]], [*p, d[enough]]
        t *= 2
    s, e, p = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (s, e, p))
    order = np.lexsort((p, e, s))
    s, e, p = s[order], e[order], p[order]
    # Of one stretch only the smallest period counts: those of three periods or more that have others are multiples of it.
    keep = (np.r_[True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])] if len(s) else np.zeros(0, bool)) & (e >= np.maximum(least, repeats * p))
    s, e, p = s[keep], e[keep], p[keep]
    order = np.lexsort((p, s))
    return s[order], e[order], p[order]


def greatest(found):
    """The (start, length, period) of greatest exact exponent, of ties the first."""
    best = None
    for x in found:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    return best


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3, batch_words: int = 1 << 20) -> DataFrame:
    """For each row doc_id, n_runs, the greatest run's start, length and period (null without a run), runs as an array of
    (start, length, period) by start, then period, and collapsed: the words joined by one space, without those that any
    run repeats after its first period."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def settle(ids, texts):
        import numpy as np
        import pyarrow as pa

        words = [x.split() for x in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        sizes, begin = counts + 1, np.r_[0, np.cumsum(counts + 1)[:-1]]
        codes = pa.array([x for ws in words for x in ws], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        w = np.full(int(sizes.sum()), -1, np.int64)
        ends = begin + counts
        inner = np.ones(len(w), bool)
        inner[ends] = False
        w[inner] = codes
        w[ends] = len(codes) + np.arange(len(ends))  # each end mark is a value of its own
        s, length, p = runs(w, sizes, least, repeats)
        dropped = _covered(len(w), s + p, s + length)
        doc = np.searchsorted(begin, s, "right") - 1
        lists: dict[int, list] = {}
        for k, x in zip(doc.tolist(), zip((s - begin[doc]).tolist(), length.tolist(), p.tolist())):
            lists.setdefault(k, []).append(x)
        tops = [greatest(lists[k]) if k in lists else (None,) * 3 for k in range(len(words))]
        kept = [b" ".join(ws) if k not in lists else b" ".join([x for x, no in zip(ws, dropped[b : b + len(ws)].tolist()) if not no]) for k, (ws, b) in enumerate(zip(words, begin.tolist()))]
        found = [[dict(zip(("start", "length", "period"), x)) for x in lists.get(k, ())] for k in range(len(words))]
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        numbers = [pa.array([x[i] for x in tops], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(x) for x in found], pa.int64()), *numbers, pa.array(found, pa.list_(run)), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"],
        )

    def run(batches):
        import numpy as np

        for batch, texts in text_batches(batches):
            # About six bytes a word; a longer text is a part of its own.
            part = np.cumsum([len(x) for x in texts]) // (6 * batch_words) if texts else np.zeros(0)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield settle(batch.column(0).slice(a, b - a), texts[a:b])

    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repeated_tail(docs: DataFrame) -> DataFrame:
    """docs, those whose crc32(doc_id) ends in the digit 0 with words from a on made periodic: word i becomes word a + (i - a) % p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    g = F.floor(h / 10)

    def tail(ws):
        n = F.size(ws)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(ws, lambda x, i: F.when(i < a, x).otherwise(F.element_at(ws, (a + (i - a) % p + 1).cast("int")))), " ")

    changed = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, tail(ws)).otherwise("")), 1)
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")))
