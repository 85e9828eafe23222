"""Quality by perplexity: an interpolated modified Kneser-Ney model of byte 5-grams, trained on trusted text.

Symbols are the bytes of the text as they are, 256 of them. Counts are summed by n-gram; continuation counts, the three
discounts of each order, context totals and the interpolated probabilities come from joins of these count tables, sharded
by context or by suffix. A document is scored by its n-grams: each one has the probability of the longest order that has
seen it, weighed by what the contexts in between leave. Where the finished tables have at most `broadcast_rows` rows (24
bytes each), they are broadcast and each task looks its n-grams up. Larger ones stay in shards: the corpus's distinct
n-grams meet the tables in joins, and documents then join their n-grams' probabilities; the result is the same.

Perplexities are compared within a language. A short text tells little, so its log perplexity is drawn to the language's
median as if `prior` more symbols of that had been read. The threshold of a language is the `quantile` of its trusted
documents of the half that the model never reads; languages with none use that of all of that half.

All trusted documents of the other half train the model; quantiles use all of theirs. Defined cases: null and empty texts have no symbols, their perplexity is null and they are kept (there
is no evidence against them); a null lang is a language of its own; null doc_ids are never trusted; a document labelled
both ways isn't trusted; repeated rows come out once each; a perplexity equal to the threshold is kept; very long texts
are scored whole; without trusted documents everything is kept. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrays, bitmap, forget, kept, marked, text_batches
from .symbols import ngram_keys, summed

SIZE, BITS, ORDER = 256, 8, 5
#: What a context may leave nothing for still has this probability.
FLOOR = 1e-12


def _keys(texts: list[bytes]):
    """(n-gram of each symbol, where the texts that aren't empty begin, their numbers); byte 0 stands before a text."""
    import numpy as np

    sizes = np.array([len(x) for x in texts], np.int64)
    own = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[own]
    return ngram_keys(np.frombuffer(b"".join(texts), np.uint8), begin, ORDER, SIZE), begin, own


def _counted(rows: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for _, texts in text_batches(batches):
            for lo in range(0, len(texts), 1000):
                key, n = np.unique(_keys(texts[lo : lo + 1000])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return summed(rows.select("text").mapInArrow(run, "key long, n long"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of one order, from how many n-grams were seen once to four times."""
    got = {r["n"]: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    t = [got.get(k, 0) for k in range(5)]
    if not (t[1] and t[2]):
        return 0.5, 0.5, 0.5
    y = t[1] / (t[1] + 2 * t[2])
    return tuple(min(k, max(0.0, k - (k + 1) * y * t[k + 1] / t[k])) if t[k] else 0.5 for k in (1, 2, 3))


def model(trusted: DataFrame) -> list[DataFrame]:
    """By order 1 to 5 the seen n-grams: (key, p, context, back), p being the last symbol's probability and back the weight
    that the n-gram's context leaves to the shorter context."""
    counts = [kept(_counted(trusted), "kn-counts")]
    for _ in range(ORDER - 1):  # continuation counts: in how many types the n-gram follows a symbol
        longer = counts[0]
        mask = SIZE ** (ORDER - len(counts)) - 1
        counts.insert(0, kept(longer.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.count("*").alias("n")), "kn-counts"))
    out: list[DataFrame] = []
    for order, rows in enumerate(counts, 1):
        d = _discounts(rows)
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.shiftrightunsigned("key", BITS)
        totals = rows.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
        held = rows.withColumns({"context": context, "cut": cut}).join(totals, "context")
        own = held.select("key", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), (F.col("freed") / F.col("total")).alias("back"))
        if order == 1:
            full = own.select("key", (F.col("own") + F.col("back") / SIZE).alias("p"), "context", "back")
        else:
            mask = SIZE ** (order - 1) - 1
            shorter = out[-1].select(F.col("key").alias("suffix"), F.col("p").alias("shorter"))
            full = own.withColumn("suffix", F.col("key").bitwiseAND(F.lit(mask))).join(shorter, "suffix").select("key", (F.col("own") + F.col("back") * F.col("shorter")).alias("p"), "context", "back")
        out.append(kept(full, "kn-model"))
    return out


class Lookup:
    """Probabilities of n-grams, from the tables (key, p, context, back) of the orders."""

    def __init__(self, tables):
        import numpy as np

        self.orders = []
        for key, p, context, back in tables:
            at = np.argsort(key)
            known, first = np.unique(context, return_index=True)
            self.orders.append((key[at], p[at], known, back[first]))

    def log2(self, key):
        """log2 of the probability of each n-gram's last symbol."""
        import numpy as np

        p = np.full(len(key), 1 / SIZE)
        for order, (seen, own, contexts, back) in enumerate(self.orders, 1):
            gram = key & np.int64(SIZE**order - 1)
            p *= _at(contexts, back, gram >> BITS, 1.0)
            p = np.where((found := _at(seen, own, gram, -1.0)) >= 0, found, p)
        return np.log2(np.maximum(p, FLOOR))


def _at(keys, values, wanted, default: float):
    import numpy as np

    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


SCORED = "lang string, n_symbols long, bits double"


def scored(docs: DataFrame, tables) -> DataFrame:
    """doc_id, lang, n_symbols, bits: the whole text's negative log2 probability; tables as arrays, broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = None
        for batch, texts in text_batches(batches):
            model = Lookup(shared.value) if model is None else model
            for lo in range(0, len(texts), 500):
                some = texts[lo : lo + 500]
                key, begin, own = _keys(some)
                bits = np.zeros(len(some))
                if len(own):
                    distinct, at = np.unique(key, return_inverse=True)
                    bits[own] = -np.add.reduceat(model.log2(distinct)[at], begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 500), batch.column(2).slice(lo, 500), pa.array([len(x) for x in some], pa.int64()), pa.array(bits)], ["doc_id", "lang", "n_symbols", "bits"]
                )

    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, f"doc_id {kind}, {SCORED}")


def scored_by_joins(docs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """scored() where the tables are too large to broadcast: they stay in shards, and the corpus's distinct n-grams join them."""
    rows = kept(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.col("lang").cast("string").alias("lang")), "kn-rows")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            for row, text in zip(batch.column(0).to_pylist(), texts):
                key, n = np.unique(_keys([text])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row)), pa.array(key), pa.array(n)], ["row", "key", "n"])

    grams = kept(rows.select("row", "text").mapInArrow(run, "row long, key long, n long"), "kn-grams")
    p = grams.select("key").distinct().withColumn("p", F.lit(1 / SIZE))
    for order, t in enumerate(tables, 1):
        gram = F.col("key").bitwiseAND(F.lit(SIZE**order - 1))
        seen, back = t.select(F.col("key").alias("gram"), F.col("p").alias("own")), t.select("context", "back").distinct()
        p = p.withColumns({"gram": gram, "context": F.shiftrightunsigned(gram, BITS)}).join(seen, "gram", "left").join(back, "context", "left")
        p = p.select("key", F.coalesce("own", F.col("p") * F.coalesce("back", F.lit(1.0))).alias("p"))
    sums = grams.join(kept(p, "kn-probabilities"), "key").groupBy("row").agg(F.sum(-F.col("n") * F.log2(F.greatest("p", F.lit(FLOOR)))).alias("bits"))
    out = rows.join(sums, "row", "left")
    return out.select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_symbols"), F.coalesce("bits", F.lit(0.0)).alias("bits"))


def held_out(doc_id: Column) -> Column:
    """Half of the trusted documents: these give the quantiles, so that no text is judged by a model that has read it."""
    return F.pmod(F.xxhash64(doc_id, F.lit("quantile")), F.lit(2)) == 0


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """text of the rows of docs whose doc_id is in ids, distinct ones. A bitmap finds them in the scan, a join settles it, so that no other text is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("doc_id").alias("h"))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            some = batch.filter(pa.array(marked(batch.column(0).to_numpy(), shared.value)))
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(2)], ["doc_id", "text"])

    near = docs.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")
    return near.join(ids, "doc_id").select("text")


def judged(docs: DataFrame, labels: DataFrame, *, quality: str = "quality", prior: int = 400, quantile: float = 0.99, broadcast_rows: int = 4_000_000) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity (of a symbol), threshold, kept."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col(quality).isNotNull()).groupBy("doc_id").agg(F.min(quality).alias("q")).where("q = 1").select("doc_id")
    trusted = kept(_of(docs, good.where(~held_out(F.col("doc_id")))), "kn-trusted")
    tables = model(trusted)
    if sum(t.count() for t in tables) <= broadcast_rows:
        got = [arrays(t) for t in tables]
        rows = kept(scored(docs, [tuple(t[c] for c in ("key", "p", "context", "back")) for t in got]), "kn-scored")
        forget(*tables)
    else:
        rows = kept(scored_by_joins(docs, tables), "kn-scored")
    forget(trusted)
    rate = F.col("bits") / F.col("n_symbols")
    known = rows.where("n_symbols > 0").join(good.where(held_out(F.col("doc_id"))), "doc_id").select("lang", "n_symbols", rate.alias("rate"))

    middles = known.groupBy("lang").agg(F.percentile_approx("rate", 0.5, 10_000).alias("middle"))
    high_of = F.percentile_approx(_drawn(F.col("rate"), prior), quantile, 10_000).alias("high")
    own = known.join(middles, known.lang.eqNullSafe(middles.lang)).drop(middles.lang).groupBy("lang").agg(F.first("middle").alias("middle"), high_of)
    middle = known.agg(F.percentile_approx("rate", 0.5, 10_000)).first()[0]  # over all languages
    high = known.withColumn("middle", F.lit(middle).cast("double")).agg(high_of).first()[0]
    own = own.select(F.col("lang").alias("own_lang"), F.col("middle").alias("own_middle"), F.col("high").alias("own_high"))
    out = rows.join(own, F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    out = out.withColumns({"middle": F.coalesce("own_middle", F.lit(middle).cast("double")), "high": F.coalesce("own_high", F.lit(high).cast("double"))})
    bound = F.col("high")
    passes = F.coalesce(_drawn(rate, prior) <= bound, F.lit(True))
    perplexity = F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), rate))
    return out.select("doc_id", "lang", "n_symbols", perplexity.alias("perplexity"), F.pow(F.lit(2.0), bound).alias("threshold"), passes.alias("kept"))


def _drawn(rate: Column, prior: int) -> Column:
    n = F.col("n_symbols")
    return F.when(n > 0, (rate * n + F.col("middle") * prior) / (n + prior))
