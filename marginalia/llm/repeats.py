"""Exact repeats: every byte inside a 100-byte string that also starts earlier is removed, over the whole corpus.

Comparing all strings takes a row for each byte. Instead each 100-byte string is filed under its anchor, the 32-byte
gram in it of the least hash (leftmost of equals): equal strings have equal anchors, and neighbouring strings share one,
so a span of strings is one row. Three passes over the texts, each sending less than the one before:

1. anchors are counted; those that occur once hold no repeat.
2. Spans of repeated anchors go out as hashes. Equal spans (by polynomial hash and an independent 128-bit digest of their
   bytes) are ranked by place, all but the first are repeats.
3. Anchors that are left with several different spans are what must be sorted. These spans go out with their bytes, and
   strings at the same distance from the same anchor are suffixes to sort: a mergesort whose comparisons find the common
   extension by binary search on prefix polynomial hashes, seven steps for 100 bytes. Neighbours that come out equal are
   compared byte by byte, so a hash collision can't remove anything. An anchor of more than `hot` different spans
   (the rim of a passage that very many documents share) is dealt out string by string instead of span by span; its
   strings are sorted and compared alike, in as many shards as there are different strings.

Which anchors pass reaches the scans as bitmaps whose size goes with the number of anchors up to a bound; a false mark
costs a row and changes nothing. Only texts in which something is removed meet the repeats in a join.

Order is by doc_id (of any type that sorts), then start; defined cases: a null text is empty; null doc_ids come after all
others and count as one document, as do rows that share a doc_id, so between such rows only the start decides; repeated
rows come out alike, once each. Texts under 100 bytes lose nothing; very long ones are worked on in parts that overlap.
Extra columns are ignored. Repeats are put down to rows by doc_id and a hash of id and text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, forget, kept, marked, rank, text_batches

WIDTH, GRAM = 100, 32
GRAMS = WIDTH - GRAM + 1
CHUNK = 1 << 19  # positions worked on at once; their numbers fit in the low 20 bits of a key
SOME = 2000
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
WORD = (1 << 64) - 1


def powers(n: int, base: int):
    """base ** i and its inverse, modulo 2 ** 64, for i under n."""
    import numpy as np

    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out


class Prefix:
    """Polynomial hashes of any stretch of a buffer, from those of its prefixes."""

    tables: dict = {}

    def __init__(self, buffer, base: int = BASES[0]):
        import numpy as np

        n = len(buffer) + 1
        if len(Prefix.tables.get(base, ((),))[0]) < n:
            Prefix.tables[base] = powers(max(n, 1 << 16), base)
        power, self.inverse = (x[:n] for x in Prefix.tables[base])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: n - 1], out=self.sums[1:])

    def __call__(self, begin, end):
        return (self.sums[end] - self.sums[begin]) * self.inverse[begin]


def mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def spans(buffer, valid):
    """(first string, last string, anchor's place, anchor's hash, span's hash) of each span; valid: by start, whether a string lies in one text."""
    import numpy as np

    n = len(buffer) - WIDTH + 1
    prefix = Prefix(buffer)
    i = np.arange(len(buffer) - GRAM + 1)
    gram = mix(prefix(i, i + GRAM))
    low = (gram & np.uint64(WORD ^ 0xFFFFF)) | i.astype(np.uint64)
    step = 1
    while 2 * step <= GRAMS:  # least key of 2, 4, 8 .. grams
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n], low[GRAMS - step : GRAMS - step + n])
    at = (low & np.uint64(0xFFFFF)).astype(np.int64)
    at[~valid[:n]] = -1
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
    first, last = cut[:-1], cut[1:] - 1
    own = at[first] >= 0
    first, last = first[own], last[own]
    place = at[first]
    whole = mix(prefix(first, last + WIDTH)) + (place - first).astype(np.uint64) * np.uint64(BASES[1]) + (last - first).astype(np.uint64) * np.uint64(BASES[0])
    return first, last, place, gram[place].view(np.int64), mix(whole).view(np.int64)


def chunks(texts: list[bytes]):
    """(buffer, valid, text's number by position, place in its text by position) of few texts, or of a part of a long one."""
    import numpy as np

    some: list[tuple[int, int, bytes]] = []
    size = 0

    def done():
        buffer = np.frombuffer(b"".join(x for _, _, x in some), np.uint8)
        length = np.array([len(x) for _, _, x in some])
        end = np.repeat(np.cumsum(length), length)
        at = np.arange(len(buffer))
        place = at - np.repeat(np.cumsum(length) - length, length) + np.repeat([o for _, o, _ in some], length)
        return buffer, at + WIDTH <= end, np.repeat([k for k, _, _ in some], length), place

    for k, text in enumerate(texts):
        for lo in range(0, max(1, len(text) - WIDTH + 1), CHUNK - WIDTH):  # the strings that start in a part are whole in it
            part = text[lo : lo + CHUNK - WIDTH + WIDTH - 1]
            if len(part) < WIDTH:
                continue
            if size + len(part) > CHUNK and some:
                yield done()
                some, size = [], 0
            some.append((k, lo, part))
            size += len(part)
    if some:
        yield done()


def _anchors(docs: DataFrame) -> DataFrame:
    """(a, occurs): each distinct anchor of a batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, texts in text_batches(batches):
            got = [spans(buffer, valid)[3] for buffer, valid, _, _ in chunks(texts)]
            if got:
                a, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n.astype(np.int32))], ["a", "occurs"])

    return docs.select("text").mapInArrow(run, "a long, occurs int")


class Spans:
    """The spans of some texts whose anchors are in a bitmap, by anchor, hash and place; `later`: a repeat of another one here."""

    def __init__(self, texts: list[bytes], doc, words):
        import numpy as np

        parts = []
        for buffer, valid, text, at in chunks(texts):
            first, last, place, a, s = spans(buffer, valid)
            own = marked(a, words)
            if own.any():
                first, last, place, a, s = (x[own] for x in (first, last, place, a, s))
                raw, content = buffer.tobytes(), np.empty(len(first), object)
                content[:] = [raw[f : e + WIDTH] for f, e in zip(first.tolist(), last.tolist())]
                parts.append((a, s, text[first], at[first], at[last], at[place], content))
        self.columns = tuple(np.concatenate(x) for x in zip(*parts)) if parts else None
        if parts:
            self.collapse(doc)

    def collapse(self, doc):
        """Sort, and mark what repeats another one."""
        import numpy as np

        a, s, text, start, *_ = self.columns
        order = np.lexsort((start, doc[text], s, a))
        self.columns = a, s, text, start, _, _, content = tuple(x[order] for x in self.columns)
        lead = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
        lead = np.repeat(lead, np.diff(np.r_[lead, len(a)]))
        self.later = ((doc[text] != doc[text[lead]]) | (start != start[lead])) & (content == content[lead])

    def take(self, which):
        self.columns, self.later = tuple(x[which] for x in self.columns), self.later[which]

    def singly(self, hot, doc):
        """Deal the spans of hot anchors out as strings, each its own anchor; (text, first, last) of those that repeat one here."""
        import numpy as np

        wide = np.flatnonzero(marked(self.columns[0], hot))
        if not len(wide):
            return (np.zeros(0, np.int64),) * 3
        a, s, text, start, last, place, content = (x[wide] for x in self.columns)
        n = last - start + 1
        span = np.repeat(np.arange(len(wide)), n)
        j = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        length = np.array([len(x) for x in content])
        raw = b"".join(content)
        at = np.repeat(np.cumsum(length) - length, n) + j
        h = mix(Prefix(np.frombuffer(raw, np.uint8))(at, at + WIDTH))
        distance = (place[span] - start[span] - j).astype(np.uint64)
        anchor = mix(h + a[span].view(np.uint64) * np.uint64(BASES[0]) + distance * np.uint64(BASES[1])).view(np.int64)
        each = np.empty(len(span), object)
        each[:] = [raw[k : k + WIDTH] for k in at.tolist()]
        string = start[span] + j
        self.take(np.setdiff1d(np.arange(len(self.later)), wide))
        more = anchor, h.view(np.int64), text[span], string, string, string, each
        self.columns = tuple(np.concatenate(x) for x in zip(self.columns, more))
        self.collapse(doc)
        text, string = self.columns[2][self.later], self.columns[3][self.later]
        self.take(~self.later)
        return runs_of(text, string)


def runs_of(text, string):
    """(text, first, last) of the runs of neighbouring strings."""
    import numpy as np

    order = np.lexsort((string, text))
    text, string = text[order], string[order]
    cut = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (string[1:] != string[:-1] + 1)]) if len(text) else np.zeros(0, np.int64)
    return text[cut], string[cut], string[np.r_[cut[1:], len(text)] - 1] if len(text) else string


def _batches(batches):
    """(batch, texts, ranks of the ids) of few texts at a time: the spans' bytes are several times the texts."""
    for whole, raws in text_batches(batches):
        for lo in range(0, len(raws), SOME):
            batch = whole.slice(lo, SOME)
            yield batch, raws[lo : lo + SOME], rank(batch.column(0))


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")


def _hashed(docs: DataFrame, repeated) -> DataFrame:
    """Spans of repeated anchors as hashes (a, s, v, w), those that repeat one of their batch marked `later`."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch, texts, doc in _batches(batches):
            got = Spans(texts, doc, shared.value)
            if not got.columns:
                continue
            a, s, text, start, last, _, content = got.columns
            digest = b"".join(b"\0" * 16 if late else xxhash.xxh3_128_digest(c) for late, c in zip(got.later.tolist(), content))
            v = np.frombuffer(digest, "<i8").reshape(-1, 2)
            own = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, (a, s, v[:, 0].copy(), v[:, 1].copy(), start.astype(np.int32), last.astype(np.int32), got.later))],
                ["doc_id", "rid", "a", "s", "v", "w", "start", "last", "later"],
            )

    return _identified(docs).mapInArrow(run, f"doc_id {kind}, rid long, a long, s long, v long, w long, start int, last int, later boolean")


def _with_bytes(docs: DataFrame, several, hot) -> DataFrame:
    """Different spans of anchors that have several, with their bytes; strings where the anchor is hot, repeats of the batch without bytes."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast((several, hot))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        several, hot = shared.value
        for batch, texts, doc in _batches(batches):
            got = Spans(texts, doc, several)
            if not got.columns:
                continue
            got.take(~got.later)
            again = got.singly(hot, doc) if hot is not None else (np.zeros(0, np.int64),) * 3
            a, s, text, start, last, place, content = got.columns
            if len(again[0]):
                none, spread = np.zeros(len(again[0]), np.int64), (again[0] << 32) + again[1]
                more = spread, none, *again, none, np.full(len(none), None, object)
                a, s, text, start, last, place, content = (np.concatenate(x) for x in zip(got.columns, more))
            own = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), batch.column(1).take(own), pa.array(a), pa.array(s), *(pa.array(x.astype(np.int32)) for x in (start, last, place)), pa.array(content, pa.binary())],
                ["doc_id", "rid", "a", "s", "start", "last", "place", "bytes"],
            )

    return _identified(docs).mapInArrow(run, f"doc_id {kind}, rid long, a long, s long, start int, last int, place int, bytes binary")


def common(prefix: Prefix, p, q, most: int = WIDTH):
    """Bytes that the strings at p and q have in common, by binary search on their prefixes' hashes."""
    import numpy as np

    out = np.full(len(p), most, np.int64)
    open_ = np.flatnonzero(prefix(p, p + most) != prefix(q, q + most))  # most comparisons here are of equal strings
    p, q = p[open_], q[open_]
    low, high = np.zeros(len(p), np.int64), np.full(len(p), most - 1, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = prefix(p, p + mid) == prefix(q, q + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    out[open_] = low
    return out


def before(buffer, prefix: Prefix, p, q):
    """Whether the string at p sorts before that at q; and whether they are equal."""
    import numpy as np

    n = common(prefix, p, q)
    equal = n == WIDTH
    k = np.where(equal, 0, n)
    return buffer[p + k] < buffer[q + k], equal


def suffix_sort(buffer, prefix: Prefix, at, group):
    """Order of the strings at `at` within each group (of neighbours): a stable mergesort of all groups at once."""
    import numpy as np

    n = len(at)
    order = np.arange(n)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, n])
    lo, place = np.repeat(begin, size), np.arange(n) - np.repeat(begin, size)
    top = np.repeat(begin + size, size)
    width = 1
    while n and width < size.max():
        live = np.flatnonzero(top - lo > width)
        run = lo[live] + place[live] // (2 * width) * (2 * width)  # two runs that merge
        left = place[live] // width % 2 == 0
        mid, end = np.minimum(run + width, top[live]), np.minimum(run + 2 * width, top[live])
        a, b = np.where(left, mid, run), np.where(left, end, mid)  # look for the element's rank in the other run
        start, me = a.copy(), at[order[live]]
        while (a < b).any():
            open_ = a < b
            m = np.where(open_, (a + b) // 2, run)
            less, equal = before(buffer, prefix, at[order[m]], me)
            past = (less | equal & ~left) & open_  # elements of a left run come before equal ones
            a, b = np.where(past, m + 1, a), np.where(open_ & ~past, m, b)
        to = np.where(left, live, live - (mid - run)) + (a - start)
        merged = order.copy()
        merged[to] = order[live]
        order, width = merged, 2 * width
    return order


def repeats_of(a, s, doc, start, last, place, content):
    """(row, first string, last string) of the runs of strings that repeat one of another span of their anchor, whole spans too."""
    import numpy as np

    o = np.lexsort((start, doc, s, a))
    inverse = o
    a, s, doc, start, last, place, content = (x[o] for x in (a, s, doc, start, last, place, content))
    lead = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
    lead = np.repeat(lead, np.diff(np.r_[lead, len(a)]))
    later = (content == content[lead]) & ((doc != doc[lead]) | (start != start[lead]))

    # One span of each kind is left (and those that tie with it, or that a collision put there); anchors of one kind hold no more.
    keep = np.flatnonzero(~later)
    many = np.repeat(np.diff(np.r_[g := np.flatnonzero(np.r_[True, a[keep][1:] != a[keep][:-1]]), len(keep)]) > 1, np.diff(np.r_[g, len(keep)]))
    keep = keep[many]
    rows, begins, ends = [np.flatnonzero(later)], [start[later]], [last[later]]
    if len(keep):
        length = np.array([len(x) for x in content[keep]])
        buffer = np.frombuffer(b"".join(content[keep]), np.uint8)
        base = np.cumsum(length) - length
        n = last[keep] - start[keep] + 1
        span = np.repeat(np.arange(len(keep)), n)
        j = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        own, at, string = keep[span], base[span] + j, start[keep][span] + j
        distance = place[own] - string
        prefix = Prefix(buffer)
        o2 = np.lexsort((distance, a[own]))
        own, at, string, distance = (x[o2] for x in (own, at, string, distance))
        fresh = np.r_[True, (a[own][1:] != a[own][:-1]) | (distance[1:] != distance[:-1])]
        some = ~(fresh & np.r_[fresh[1:], True])  # not alone in its group
        group = np.cumsum(fresh)[some]
        own, at, string = own[some], at[some], string[some]
        order = suffix_sort(buffer, prefix, at, group)
        own, at, string, group = own[order], at[order], string[order], group[order]
        equal = np.r_[False, (group[1:] == group[:-1]) & (common(prefix, at[1:], at[:-1]) == WIDTH)][: len(at)]
        check = np.flatnonzero(equal)
        window = np.arange(WIDTH)
        for lo in range(0, len(check), 100_000):  # collision verification
            c = check[lo : lo + 100_000]
            equal[c] = (buffer[at[c][:, None] + window] == buffer[at[c - 1][:, None] + window]).all(axis=1)
        klass = np.cumsum(~equal)
        o3 = np.lexsort((string, doc[own], klass))
        own, string, klass = own[o3], string[o3], klass[o3]
        lead = np.flatnonzero(np.r_[True, klass[1:] != klass[:-1]])
        lead = np.repeat(lead, np.diff(np.r_[lead, len(klass)]))
        again = (doc[own] != doc[own[lead]]) | (string != string[lead])
        for out, got in zip((rows, begins, ends), runs_of(own[again], string[again])):
            out.append(got)
    return inverse[np.concatenate(rows)], np.concatenate(begins), np.concatenate(ends)


def _sorted(rows: DataFrame, shards: int) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(table):
        import numpy as np
        import pyarrow as pa

        known = table.filter(table.column("bytes").is_null()).select(["doc_id", "rid", "start", "last"])
        table = table.filter(table.column("bytes").is_valid())
        a, s, start, last, place = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "s", "start", "last", "place"))
        content = np.empty(len(a), object)
        content[:] = table.column("bytes").to_pylist()
        row, begin, end = repeats_of(a, s, rank(table.column("doc_id")), start, last, place, content)
        own = table.select(["doc_id", "rid"]).take(pa.array(row))
        own = own.append_column("start", pa.array(begin.astype(np.int32))).append_column("last", pa.array(end.astype(np.int32)))
        return pa.concat_tables([known, own.cast(known.schema)])

    return rows.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInArrow(run, f"doc_id {kind}, rid long, start int, last int")


def repeats(docs: DataFrame, hot: int = 20_000, shard_rows: int = 25_000) -> DataFrame:
    """(doc_id, rid, start, last): runs of strings that also start earlier; rid is the row's hash of id and text.

    hot, shard_rows: how the sort's work is dealt out; no result depends on them.
    """
    spark = docs.sparkSession
    repeated = kept(_anchors(docs).groupBy("a").agg(F.sum("occurs").alias("occurs")).where("occurs > 1").select("a"), "repeat-anchors")
    hashed = _hashed(docs, bitmap(repeated))
    forget(repeated)
    place = Window.partitionBy("a", "s", "v", "w").orderBy(F.asc_nulls_last("doc_id"), "start")
    ranked = hashed.where("not later").withColumn("later", F.rank().over(place) > 1)
    columns = ["doc_id", "rid", "a", "start", "last", "later"]
    found = kept(hashed.where("later").select(columns).union(ranked.select(columns)), "repeat-spans")

    kinds = kept(found.where("not later").groupBy("a").count().where("count > 1"), "repeat-kinds")
    wide = kinds.where(F.col("count") > hot)
    total, strings = kinds.agg(F.sum(F.when(F.col("count") <= hot, F.col("count"))), F.sum(F.when(F.col("count") > hot, F.col("count")))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ((total or 0) + (strings or 0) * GRAMS) // shard_rows + 1)
    spread = _with_bytes(docs, bitmap(kinds.select("a")), bitmap(wide.select("a")) if strings else None)
    forget(kinds)
    return found.where("later").select("doc_id", "rid", "start", "last").union(_sorted(spread, shards))


OUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batch, texts: list[bytes], runs: list, keep_text: bool):
    """The result for each text, without its runs of strings; kept_text only on demand."""
    import pyarrow as pa

    out: list[list] = [[], [], [], [], []]
    for raw, own in zip(texts, runs):
        left, removed, n, end = [], 0, 0, 0
        for s, e in sorted((r["start"], r["last"] + WIDTH) for r in own or ()):
            if s > end or not n:
                n += 1
                left.append(raw[end:s])
                removed += e - s
            else:
                removed += max(0, e - end)
            end = max(end, e)
        left.append(raw[end:])
        text = b"".join(left)
        for column, v in zip(out, (len(raw), removed, n, hashlib.sha256(text).hexdigest(), text)):
            column.append(v)
    n = len(out) if keep_text else len(out) - 1
    columns = (pa.array(c, t) for c, t in zip(out[:n], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))
    return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: n + 1])


def without_repeats(docs: DataFrame, keep_text: bool = True, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept_text (bytes) for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = kept(repeats(docs, **settings).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "last")).alias("runs")), "repeat-runs")  # bounded by a text's length
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("rid")))

    def whole(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in text_batches([batch.filter(pa.array(~marked(batch.column(1).to_numpy(), shared.value)))]):
                yield _cut(part, texts, [None] * len(texts), keep_text)

    def touched(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(marked(batch.column(1).to_numpy(), shared.value)))

    def cut(batches):
        for batch, texts in text_batches(batches):
            yield _cut(batch, texts, batch.column(2).to_pylist(), keep_text)

    rows = _identified(docs)
    some = rows.mapInArrow(touched, rows.schema).alias("a")
    same = (F.col("a.rid") == F.col("b.rid")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    joined = some.join(found.alias("b"), same, "left").select("a.doc_id", "a.text", "b.runs")
    schema = f"doc_id {kind}, {OUT}" + (", kept_text binary" if keep_text else "")
    return rows.mapInArrow(whole, schema).union(joined.mapInArrow(cut, schema))
