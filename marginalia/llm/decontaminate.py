"""Benchmark decontamination: template windows of benchmark items found in documents, re-parameterised ones too.

Numbers, names and units become typed placeholders. Every window of `width` template words is hashed, as a template if
at least half of them are plain words. Other windows are hashed by their actual words, so that they are found verbatim,
and once more as the template that goes on from there until it holds as many plain words as a window needs, if the text
has them. Items shorter than a window are one window of their own length; those of fewer than two words have none. Windows of documents that miss a bitmap of the
benchmark's hashes (its size is a parameter, whatever the tables' sizes) stop in the scan; the rest meet the items in
an equi-join of hash and template. What a placeholder stood for is judged along one alignment of a document and an
item: a value of the item stands for the document's value at most of its places. A window counts if its values are
such, or the item's own, or if it has no placeholder.

Defined cases: a null or blank text matches nothing. Documents are told apart by id and text together, so rows of null
id are judged each on its own and come out with a null doc_id; repeated rows come out once. A null item text is
ignored; a null item_id is an item. Ties don't arise: all items that reach the share are returned. Very long texts are
read whole. Extra columns are ignored, or pass through clean() whatever their names.
"""

from __future__ import annotations

import re
import string
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

# Words that name a unit.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules newton newtons".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
WITH_UNIT = re.compile(r"[+-]?\d[\d.,]*([a-z°%]+)")
MARKS = string.punctuation + "“”‘’„«»…–—¿¡"
NUM, NAME, UNIT = "<num>", "<name>", "<unit>"
PLACEHOLDERS = frozenset((NUM, NAME, UNIT))
PRIME = 0x9E3779B97F4A7C15


def template(word: str, first: bool) -> tuple[str, str]:
    """(template word, what it stands for); both empty for marks alone. first: the word opens a sentence."""
    core = word.strip(MARKS)
    if not core:
        return "", ""
    low = core.lower()
    if NUMBER.fullmatch(core) or (m := WITH_UNIT.fullmatch(low)) and m[1] in UNITS:
        return NUM, low
    if low in UNITS:
        return UNIT, low
    if not first and len(core) > 1 and core[0].isupper() and core[1:].islower():
        return NAME, low
    return low, low


class Words:
    """Template words of the distinct words seen, by number, for the first and for later places of a sentence."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def numbers(self, text: str):
        import numpy as np

        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in text.split()], np.int64)

    def tables(self):
        """hashes (when first, when later, of the word itself), plain when first, plain when later, empty, ends a sentence."""
        import numpy as np
        import xxhash

        n = len(self.number)
        hashes, plain = np.zeros((3, n), np.uint64), np.zeros((2, n), bool)
        empty, ends = np.zeros(n, bool), np.zeros(n, bool)
        for w, i in self.number.items():
            later, low = template(w, False)
            first = template(w, True)[0] if later == NAME else later
            empty[i] = not later
            hashes[2, i] = xxhash.xxh64_intdigest(low)
            ends[i] = w.rstrip("\"'”’»)")[-1:] in (".", "!", "?", ":")
            for k, t in enumerate((first, later)):
                hashes[k, i] = xxhash.xxh64_intdigest(t)
                plain[k, i] = t not in PLACEHOLDERS
        return hashes, plain, empty, ends


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(PRIME)
    return h ^ (h >> np.uint64(29))


def windows(ids, tables, width: int, wide: int):
    """(hash, begin, size, is exact) of each window of so many template words, and the places of the words that aren't empty.

    Windows with too few plain words are exact, those of `wide` words also go on to enough plain words if there are some.
    """
    import numpy as np

    hashes, plain, empty, ends = tables
    place = np.flatnonzero(~empty[ids])
    first = np.r_[True, ends[ids[:-1]]] if len(ids) else np.zeros(0, bool)
    later, own = (~first[place]).astype(np.int64), ids[place]
    n = len(own) - width + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return (none.astype(np.uint64), none, none, none.astype(bool)), place, later
    h, ok = hashes[later, own], plain[later, own]
    out, told = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(width):
        out = out * np.uint64(PRIME) + h[j : j + n]
        told += ok[j : j + n]
    begin, size, exact = np.arange(n), np.full(n, width), 2 * told < width
    low = np.flatnonzero(exact)
    if len(low):
        actual, k = np.zeros(len(low), np.uint64), (width + 1) // 2
        for j in range(width):
            actual = actual * np.uint64(PRIME) + hashes[2, own[low + j]]
        out[low] = actual
        at = np.flatnonzero(ok)
        if width == wide and len(at) >= k:
            last = np.r_[0, np.cumsum(ok)][low] + k - 1
            low, last = low[last < len(at)], last[last < len(at)]
            # sums of h[j] * PRIME ** (q - j): differences of sums of h[j] * PRIME ** -j, whatever the length
            up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(h) - 1, x, np.uint64)], dtype=np.uint64) for x in (PRIME, pow(PRIME, -1, 1 << 64)))
            sums, q = np.r_[np.uint64(0), np.cumsum(h * down, dtype=np.uint64)], at[last]
            out = np.r_[out, (sums[q + 1] - sums[low]) * up[q]]
            begin, size, exact = np.r_[begin, low], np.r_[size, q + 1 - low], np.r_[exact, np.zeros(len(low), bool)]
    return (_mixed(out), begin, size, exact), place, later


def in_bitmap(h, bitmap, bits: int):
    import numpy as np

    ok = np.ones(len(h), bool)
    for shift in (0, 64 - bits):
        at = (h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        ok &= (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


MATCH = "h long, pos long, words string, slots array<string>, places array<long>, exact boolean"


def _scan(rows: DataFrame, key: str, widths: list[int], bitmap=None, bits: int = 0, whole: int = 0, wide: int = 8) -> DataFrame:
    """(key, h, pos, words, slots, places of the slots, is exact) of the windows, of those in the bitmap if there is one.

    whole: also one window of its own length for texts of fewer words (two at least) than so many.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            seen = Words()
            numbers = [seen.numbers(x) for x in texts]
            tables = seen.tables()
            out: list[list] = [[], [], [], [], [], [], []]
            for k, ids in enumerate(numbers):
                own = widths
                if whole:
                    n = int((~tables[2][ids]).sum())
                    own = [n] if 2 <= n < whole else widths
                for width in own:
                    (h, begin, size, exact), place, later = windows(ids, tables, width, wide)
                    take = np.arange(len(h)) if bitmap is None else np.flatnonzero(in_bitmap(h, bitmap, bits))
                    if not len(take):
                        continue
                    words = texts[k].split()
                    for i in take.tolist():
                        p, value = int(begin[i]), int(h[i])
                        pairs = [template(words[place[j]], not later[j]) for j in range(p, p + int(size[i]))]
                        slots = [] if exact[i] else [(p + j, t + v) for j, (t, v) in enumerate(pairs) if t in PLACEHOLDERS]
                        said = " ".join(pair[int(exact[i])] for pair in pairs)
                        for column, value in zip(out, (k, value - (1 << 64) * (value >> 63), p, said, [v for _, v in slots], [at for at, _ in slots], bool(exact[i]))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.string())), pa.array(out[5], pa.list_(pa.int64())), pa.array(out[6], pa.bool_())],
                [key, "h", "pos", "words", "slots", "places", "exact"],
            )

    return rows.select(key, "text").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {MATCH}")


def agreeing(line: list[dict]) -> tuple[int, int]:
    """How many windows (pos, own, slots, places) of an alignment count, and how many of them are verbatim.

    A value of the item stands for what it meets at more than half of its places, for none if there is no such value.
    """
    met = {at: pair for w in line for at, *pair in zip(w["places"], w["own"], w["slots"])}
    places, pairs = Counter(own for own, _ in met.values()), Counter(map(tuple, met.values()))
    count, verbatim = set(), set()
    for w in line:
        if w["own"] == w["slots"]:
            verbatim.add(w["pos"])
        if all(a == b or 2 * pairs[a, b] > places[a] for a, b in zip(w["own"], w["slots"])):
            count.add(w["pos"])
    return len(count), len(verbatim)


def _judged(met: DataFrame) -> DataFrame:
    """(key, item_id, n, verbatim) of each alignment; it has no more windows than the item."""
    lines = met.groupBy("key", "item_id", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_list(F.struct("pos", "own", "slots", "places")).alias("line"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts = [agreeing(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(2))], ["key", "item_id", "n", "verbatim"])

    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("key", "item_id"))
    return lines.select("key", "item_id", "line").mapInArrow(run, f"{kinds}, n long, verbatim long")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 8, least_windows: int = 6, share: float = 0.5, bits: int = 22) -> DataFrame:
    """(rid, doc_id, item_id, n_windows, item_windows, verbatim) of the documents that hold an item.

    An item is held if its agreeing windows number least_windows, or `share` of its templates (of its exact windows if it
    has none) if that is fewer; verbatim if its verbatim windows alone do. rid is the row's hash of id and text. bits: 2 ** bits is the size of the bitmap.
    """
    import numpy as np

    spark = docs.sparkSession
    items = kept(_scan(benchmark.where("text is not null").select("item_id", "text"), "item_id", [width], whole=width, wide=width), "benchmark-windows")
    lengths = [r[0] for r in items.select(F.size(F.split("words", " ")).alias("n")).distinct().where(F.col("n") <= width).collect()]  # width of them at most
    mask = (1 << bits) - 1
    at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("h", 64 - bits)))
    one = F.expr("shiftleft(1L, cast(at & 63L as int))")
    set_bits = items.select(at.alias("at")).distinct().groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect()  # 2 ** (bits - 6) rows at most
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    for r in set_bits:
        bitmap[r["word"]] = r["bits"] & (2**64 - 1)
    shared = spark.sparkContext.broadcast(bitmap)

    with_rid = docs.select("doc_id", "text", F.struct("doc_id", F.xxhash64("doc_id", "text").alias("rid")).alias("key"))
    found = kept(_scan_shared(with_rid, sorted(lengths), shared, bits, width).distinct(), "benchmark-hits")
    size = items.groupBy(F.col("item_id").alias("of_item")).agg(F.countDistinct("pos").alias("item_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("pos"))).alias("told"))
    need = F.least(F.lit(least_windows), F.ceil(F.when(F.col("told") > 0, F.col("told")).otherwise(F.col("item_windows")) * share))
    size = size.withColumn("need", need)
    wanted = items.select("item_id", "h", "words", F.col("pos").alias("at"), F.col("slots").alias("own"))
    lines = _judged(_within_reach(found, items, size).join(wanted, ["h", "words"]))
    sums = lines.groupBy("key", "item_id").agg(F.sum("n").alias("n_windows"), F.sum("verbatim").alias("verbatim"))
    return (
        sums.join(size, F.col("item_id").eqNullSafe(F.col("of_item"))).where(F.col("n_windows") >= F.col("need"))
        .select("key.rid", "key.doc_id", "item_id", "n_windows", "item_windows", (F.col("verbatim") >= F.col("need")).alias("verbatim"))
    )


def _within_reach(found: DataFrame, items: DataFrame, size: DataFrame) -> DataFrame:
    """The windows of documents that can still make an item reach its share.

    A window that many items share is one row here: it carries the least need of its items and the most times that one of
    them has it. A document whose windows together stay below that need holds none of these items, and its row goes before
    it would meet each of them.
    """
    own = items.groupBy("h", "words", "item_id").agg(F.count("*").alias("times"))
    own = own.join(size.select("of_item", "need"), F.col("item_id").eqNullSafe(F.col("of_item")))
    classes = own.groupBy("h", "words").agg(F.max("times").alias("times"), F.min("need").alias("need"))
    met = found.join(classes, ["h", "words"]).withColumn("sum", F.sum("times").over(Window.partitionBy("key")))  # of one text
    return met.where(F.col("sum") >= F.col("need")).select(found.columns)


def _scan_shared(rows: DataFrame, widths: list[int], shared, bits: int, wide: int) -> DataFrame:
    """_scan with the bitmap taken from a broadcast within each task."""

    class Lazy:
        def __getitem__(self, at):
            return shared.value[at]

    return _scan(rows, "key", widths, Lazy(), bits, wide=wide)


def without_window(benchmark: DataFrame, width: int = 8) -> DataFrame:
    """Items (item_id, text) that can't be found: texts of fewer than two words."""
    rows = benchmark.select("item_id", "text").where("text is not null").withColumn("key", F.xxhash64("item_id", "text"))
    return rows.join(_scan(rows, "key", [width], whole=width, wide=width).select("key").distinct(), "key", "left_anti").select("item_id", "text")


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without those that hold a benchmark item; columns pass through, whatever their names."""
    bad = kept(contaminated(docs, benchmark, **settings).select("rid", "doc_id").distinct(), "contaminated")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("rid"))
    same = (F.col("a.rid") == F.col("b.rid")) & F.col("a.id").eqNullSafe(F.col("b.doc_id"))
    return whole.alias("a").join(bad.alias("b"), same, "left_anti").select("row.*")
