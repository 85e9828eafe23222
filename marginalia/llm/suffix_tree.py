"""LM scoring: a probabilistic suffix tree over words and word classes, with exact word counts within the classes.

The text's symbols are words, and one end. The commonest training words are a class each; other words fall in classes by
how they are written. A word has the probability of its class after what stands before it, times its own share of its
class: absolute discounting by class, the freed share being that of a word never seen. Contexts are of two kinds, kept
where they pass a divergence test: G = sum n(c, s) ln(P(s | c) / P(s | parent)) must beat the chi-squared bound of its
degrees. One, two and three classes are states of a tree of SIZE ** 3 leaves at most, whose next-class distributions are
smoothed towards the parent's. Below them stand words: any word that passes the test is a context of its own, with the class it belongs to as parent, so these contexts grow with the input. A position is scored in the
state of its longest retained suffix of classes, and where its last word is retained in that word's state, smoothed
towards it.

Word counts cover all training documents. Texts are split into words once, where they are read, and kept as blocks: texts
that follow each other in a task, about block_bytes of them, as numbers of the block's distinct words. Every later step reads the numbers; texts
are never shuffled. A block asks for the counts of its distinct words once; asked counts, with the retained words' distributions, are joined by
word hash and go back to the block. Hot words are one row for each block, and no vocabulary is ever held in one place. A task holds the words of
PART bytes of text as strings at a time, or of one longer text, and a block's as numbers.

Words are told apart by XXH64. Defined cases: a null text is empty, with the end as its only token. A null doc_id is not
held out. Repeated rows come out once each. Very long texts are scored whole, in one block. Ties between the commonest
words go to the lesser hash. With no training document every count is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrays, bitmap, kept, marked
from .symbols import ngram_keys, summed

SIZE, DEPTH = 48, 3
#: Class 0 stands before the text, 1 is the end, 2 to 17 are ways of writing, the rest single words.
END, WRITTEN, SINGLE = 1, 2, 18
#: Counts that a parent's distribution weighs in a state's.
PSEUDO = 50.0
#: 1 in 1000 beyond chance for SIZE - 1 degrees, by the normal approximation of chi-squared.
BOUND = (SIZE - 1) + 3.1 * math.sqrt(2 * (SIZE - 1))
#: Bytes of text whose words are held as strings at a time.
PART = 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def written_class(word: bytes) -> int:
    """One of 16: by closing mark, by letters beyond ASCII, and by the last letter."""
    core = word.rstrip(b".,;:!?\"')")
    last = core[-1:]
    kind = 0 if last in (b"e", b"n", b"s") else 1 if last in (b"a", b"o", b"i", b"u") else 2 if last.isalpha() else 3
    return WRITTEN + 8 * (len(core) < len(word)) + 4 * (not word.isascii()) + kind


def spans(ends, most: int):
    """(first, end) of some things at a time, of about so much together; ends: running sums of their sizes."""
    import numpy as np

    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Gathered:
    """A block in the making."""

    def __init__(self):
        self.ids, self.out, self.sizes, self.tokens, self.hashes, self.cls = ([] for _ in range(6))
        self.size = self.words = 0

    def add(self, ids, out, raws: list[bytes]) -> None:
        import numpy as np
        import xxhash

        number: dict[bytes, int] = {}
        texts = [np.array([number.setdefault(w, len(number)) for w in x.lower().split()], np.int32) for x in raws]
        self.ids.append(ids)
        self.out.append(out)
        self.sizes.append(np.array([len(t) + 1 for t in texts], np.int64))  # with the end
        end = np.array([-1], np.int32)
        self.tokens.append(np.concatenate([x for t in texts for x in (t + self.words, end)]).astype(np.int32))
        self.hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)).view(np.int64))
        self.cls.append(np.fromiter(map(written_class, number), np.int8, len(number)))
        self.size += sum(map(len, raws))
        self.words += len(number)

    def row(self, block: int):
        """One row of _blocks(); commoner words have smaller numbers, the end has the number after the last."""
        import numpy as np
        import pyarrow as pa

        h, first, at = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        self.hashes, cls = [], np.concatenate(self.cls)[first]
        tokens, sizes = np.append(at, len(h)).astype(np.int32)[np.concatenate(self.tokens)], np.concatenate(self.sizes)
        self.tokens = []
        order = np.argsort(-np.bincount(tokens, minlength=len(h) + 1)[:-1], kind="stable")
        number = np.full(len(h) + 1, len(h), np.int32)
        number[order] = np.arange(len(h))
        tokens = number[tokens]
        ids, out = pa.concat_arrays(self.ids), pa.concat_arrays(self.out)
        n = np.bincount(tokens[np.repeat(~out.to_numpy(zero_copy_only=False), sizes)], minlength=len(h) + 1)[:-1]
        lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        binary = lambda x: pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)])
        columns = {
            "block": pa.array([block], pa.int64()), "doc_id": lists(ids), "out": lists(out), "sizes": binary(sizes),
            "tokens": binary(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).ravel()),  # all first bytes, then all second ones: smaller on disk
            "h": lists(pa.array(h[order])), "cls": binary(cls[order]), "n": lists(pa.array(n.astype(np.int64))),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, doc_id, out, sizes, tokens, h, cls, n): a row for each block, its texts and its distinct words with how often its training texts have them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        block, made = TaskContext.get().partitionId() << 32, Gathered()
        for batch in batches:
            ids, texts, out = (batch.column(i) for i in range(3))
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for lo, hi in spans(ends, min(PART, block_bytes)):
                raws = texts.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
                made.add(ids.slice(lo, hi - lo), out.slice(lo, hi - lo), [b"" if x is None else x for x in raws])
                if made.size >= block_bytes:
                    yield made.row(block)
                    block, made = block + 1, Gathered()
        if made.sizes:
            yield made.row(block)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("out"))
    return rows.mapInArrow(run, f"block long, doc_id array<{kind}>, out array<boolean>, sizes binary, tokens binary, h array<long>, cls binary, n array<long>")


class Block:
    """A row of _blocks() in a task, of those columns that it has."""

    def __init__(self, table, i: int = 0):
        import numpy as np

        value = {c: table.column(c)[i] for c in table.schema.names}
        flat = lambda c: value[c].values.to_numpy(zero_copy_only=False)
        self.h, self.n = (flat(c) if c in value else None for c in ("h", "n"))
        self.cls = np.append(np.frombuffer(value["cls"].as_buffer(), np.int8), np.int8(END))  # class of each number
        for k, at in enumerate(flat("single") if "single" in value else ()):
            if at:
                self.cls[at - 1] = SINGLE + k
        if "tokens" in value:
            planes = np.frombuffer(value["tokens"].as_buffer(), np.uint8).reshape(4, -1)
            self.tokens = np.ascontiguousarray(planes.T).view(np.int32).ravel()
            self.sizes = np.frombuffer(value["sizes"].as_buffer(), np.int64)
            self.begin = np.cumsum(self.sizes) - self.sizes
            self.learn = ~flat("out")

    def parts(self, most: int = 1 << 16):
        """(first text, end, first token, end) of some texts at a time, of about so many tokens together."""
        import numpy as np

        ends = np.cumsum(self.sizes)
        for lo, hi in spans(ends, most):
            yield lo, hi, int(self.begin[lo]), int(ends[hi - 1])


def _word_counts(blocks: DataFrame) -> DataFrame:
    """(h, c, cls): how often training texts have each word."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                on = b.n > 0
                yield pa.RecordBatch.from_arrays([pa.array(b.h[on]), pa.array(b.n[on]), pa.array(b.cls[:-1][on])], ["h", "n", "cls"])

    rows = blocks.select("h", "n", "cls").mapInArrow(run, "h long, n long, cls byte")
    return rows.groupBy("h").agg(F.sum("n").alias("c"), F.first("cls").alias("cls"))


def _class_ngrams(blocks: DataFrame) -> DataFrame:
    """(key, n): 4-grams of classes in training texts, at most SIZE ** 4 rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                for lo, hi, first, end in b.parts():
                    key = ngram_keys(b.cls[b.tokens[first:end]], b.begin[lo:hi] - first, DEPTH + 1, SIZE)
                    key, n = np.unique(key[np.repeat(b.learn[lo:hi], b.sizes[lo:hi])], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

    return summed(blocks.select("out", "sizes", "tokens", "cls", "single").mapInArrow(run, "key long, n long"))


def _word_pairs(blocks: DataFrame, frequent) -> DataFrame:
    """(h, cls, n): how often a class follows a word of the bitmap `frequent` in training texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                b = Block(batch, i)
                own = np.append(marked(b.h, shared.value) & (b.cls[:-1] < SINGLE), False)  # not after an end: no pair goes across texts
                before, after = b.tokens[:-1], b.tokens[1:]
                on = own[before] & np.repeat(b.learn, b.sizes)[:-1]
                pair, n = np.unique(before[on].astype(np.int64) * SIZE + b.cls[after[on]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b.h[pair // SIZE]), pa.array((pair % SIZE).astype(np.int8)), pa.array(n.astype(np.int64))], ["h", "cls", "n"])

    rows = blocks.select("out", "sizes", "tokens", "h", "cls", "single").mapInArrow(run, "h long, cls byte, n long")
    return rows.repartition("h").groupBy("h", "cls").agg(F.sum("n").alias("n"))  # dealt once, for what follows too; a word's rows come together


def tree(key, n, pseudo: float = PSEUDO, least: int = 20):
    """(log10 P of each 4-gram's last class in the state of the longest retained suffix, P after one class, retained contexts by depth)."""
    import numpy as np

    counts = np.zeros(SIZE ** (DEPTH + 1), np.float32)
    counts[key] = n
    by = [counts]
    for _ in range(DEPTH):
        by.insert(0, by[0].reshape(SIZE, -1).sum(axis=0))
    p = (by[0] + 1) / (by[0].sum() + SIZE)
    retained, states = [], []
    for depth in range(1, DEPTH + 1):
        own = by[depth].reshape(-1, SIZE)
        parent = np.tile(p.reshape(-1, SIZE), (SIZE, 1))
        total = own.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = np.where(own > 0, own * np.log(own / total / parent), 0).sum(axis=1)
        keep = (2 * g > BOUND) & (total[:, 0] >= least)
        p = np.where(keep[:, None], (own + pseudo * parent) / (total + pseudo), parent).ravel()
        states.append(p)
        retained.append(int(keep.sum()))
    return np.log10(p).astype(np.float32), states[0].reshape(SIZE, SIZE), retained


def _retained_words(pairs: DataFrame, counts: DataFrame, after_class) -> DataFrame:
    """(h, next, times): the words whose next classes differ from those after their class, with the counts of these."""
    spark = pairs.sparkSession
    parents = spark.createDataFrame([(a, b, float(after_class[a, b])) for a in range(SIZE) for b in range(SIZE)], "of byte, cls byte, parent double")
    rows = pairs.join(counts.select("h", F.col("cls").alias("of"), F.col("c").alias("total")), "h").join(parents, ["of", "cls"])  # something follows each word
    g = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parent")))
    tested = rows.groupBy("h").agg((2 * g).alias("g"), F.collect_list(F.struct("cls", "n")).alias("next"))  # SIZE of them at most
    return tested.where(F.col("g") > BOUND).select("h", F.col("next.cls").alias("next"), F.col("next.n").alias("times"))


def least_count(after_class) -> int:
    """Training counts under which no word can pass the test: n of them give G <= 2 n ln(1 / least P of a class after a class)."""
    return math.floor(BOUND / (-2 * math.log(float(after_class.min())))) + 1


def scored(docs: DataFrame, block_bytes: int = 16 << 20, least_word: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. least_word: training counts from which a word may be a context; None: all that can pass."""
    import numpy as np

    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    # a row group for each block: a reader holds one at a time
    blocks = kept(_blocks(docs, block_bytes), "lm-blocks", {"parquet.block.size": block_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})
    ends = blocks.agg(F.sum(F.size(F.filter("out", lambda x: ~x)).cast("long"))).first()[0] or 0
    counts = kept(_word_counts(blocks), "lm-counts")
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (whole[0] or 0) + ends, whole[1] + (ends > 0)
    singles = [r["h"] for r in counts.orderBy(F.desc("c"), "h").limit(SIZE - SINGLE).collect()]
    blocks = blocks.withColumn("single", F.array(*[F.array_position("h", F.lit(h).cast("long")) for h in singles]).cast("array<long>"))
    grams = arrays(_class_ngrams(blocks))  # at most SIZE ** 4 rows
    log, after_class, _ = tree(grams["key"], grams["n"])
    least_word = least_count(after_class) if least_word is None else least_word
    frequent = bitmap(counts.where(F.col("c") >= least_word).select("h"))
    words = kept(_retained_words(_word_pairs(blocks, frequent), counts.where(F.col("c") >= least_word), after_class), "lm-words")

    # within a class: tokens, words, words seen once and twice
    named = F.when(F.col("h").isin(*singles), F.lit(0)).otherwise(F.col("cls")) if singles else F.col("cls")
    members = {r["k"]: r for r in counts.groupBy(named.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("one"), F.sum((F.col("c") == 2).cast("long")).alias("two")).collect()}
    mass, cut, fresh = np.ones(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    for k in range(WRITTEN, SINGLE):
        if k in members:
            r = members[k]
            d = r["one"] / (r["one"] + 2 * r["two"]) if r["one"] and r["two"] else 0.5
            mass[k], cut[k], fresh[k] = r["c"], d, d * r["v"] / r["c"]
        else:
            fresh[k] = 1.0
    shared = spark.sparkContext.broadcast((log, mass, cut, fresh))

    def run(table, replies):
        import pyarrow as pa
        import pyarrow.compute as pc

        log, mass, cut, fresh = shared.value
        b = Block(table)
        cls, after = b.cls, np.zeros((0, SIZE), np.float32)
        c, state = np.zeros(len(cls)), np.full(len(cls), -1, np.int32)
        if len(replies):
            at = replies.column("at").to_numpy()
            c[at] = replies.column("c").to_numpy()
            follows, times = (replies.column(x).combine_chunks() for x in ("next", "times"))
            known = np.flatnonzero(follows.is_valid().to_numpy(zero_copy_only=False))
            state[at[known]] = np.arange(len(known))
            after = np.zeros((len(known), SIZE), np.float32)
            size = pc.list_value_length(follows).drop_null().to_numpy()
            after[np.repeat(np.arange(len(known), dtype=np.int32), size), follows.flatten().to_numpy()] = times.flatten().to_numpy()
        c[-1] = ends
        with np.errstate(divide="ignore"):
            own = np.where(c > 0, (c - cut[cls]) / mass[cls], fresh[cls])
            own[(cls == END) | (cls >= SINGLE)] = 1.0
            inside = np.log10(np.maximum(own, 1e-12))
        base = np.log10((c + 1) / (total + distinct + 1))
        sums, known = after.sum(axis=1, dtype=np.float64), np.zeros(len(b.sizes), np.int64)
        scores = np.zeros((2, len(b.sizes)))
        for lo, hi, first, end in b.parts():  # the arrays by position are many
            tokens, begin = b.tokens[first:end], b.begin[lo:hi] - first
            chain = log[ngram_keys(cls[tokens], begin, DEPTH + 1, SIZE)].astype(np.float64)
            last = np.r_[-1, state[tokens[:-1]]]
            last[begin] = -1
            at = np.flatnonzero(last >= 0)  # positions after a retained word
            chain[at] = np.log10((after[last[at], cls[tokens[at]]] + PSEUDO * 10 ** chain[at]) / (sums[last[at]] + PSEUDO))
            known[lo:hi] = np.add.reduceat((c > 0)[tokens].astype(np.int64), begin)
            scores[:, lo:hi] = np.add.reduceat(base[tokens], begin), np.add.reduceat(chain + inside[tokens], begin)
        n = len(b.sizes)
        return pa.table(
            {
                "doc_id": table.column("doc_id").combine_chunks().flatten(), "held_out": pa.array(~b.learn), "n_tokens": pa.array(b.sizes),
                "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(scores[0]), "score": pa.array(scores[1]),
            }
        )

    # a word of a block is told by its number there
    replies = blocks.select(F.col("block").alias("asker"), F.posexplode("h").alias("at", "h")).join(counts.select("h", "c").join(words, "h", "left"), "h").drop("h")
    texts = blocks.select("block", "doc_id", "out", "sizes", "tokens", "cls", "single")
    # blocks without a known word still need their texts scored: cogroup keeps them
    return texts.groupBy("block").cogroup(replies.groupBy("asker")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
