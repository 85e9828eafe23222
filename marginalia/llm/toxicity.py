"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give spans and a document score.

Labels of documents become labels of tokens: over labelled training documents, words get the log odds of standing in a
toxic one, and a word of high odds in a toxic document is a toxic token. A two-state chain over each sentence (features:
odds class of the word and of its neighbours, capitals, marks) is fitted to such sentences by gradient ascent on the
conditional likelihood. Forward-backward marginals of all tokens of a text then give the expected number of toxic
tokens, the largest marginal and the share, which a logistic function, fitted on the same documents, turns into a score.

Bounds of training, all parameters: `sample` labelled documents of each kind (the least hashes of their ids), `lexicon`
words, `sentences` of each kind (with words of the lexicon and without; of those without, one in `one_in` is considered, by
hash), in parts of at most `longest` tokens. Scoring has none: texts are read whole, sentences of any length are one chain.
Training reads no document of the held-out fold. Scores never read labels, lang, source or id.

Defined cases: a null text is empty; empty texts have no tokens and get the score of none. A null doc_id is not held
out. A document labelled both ways is toxic. Without labels of both kinds every score is 0. Repeated rows are scored
alike. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, text_batches

MARKS = (string.punctuation + "“”‘’„«»…–—¿¡").encode()
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = 6  # of log odds: 0 none or low, then 1, 2, 3, 4 and 5 or more
FEATURES = CLASSES + 4  # word's class, class before, class after, capitals, marks
TOXIC_CLASS = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Reader:
    """Features of the distinct tokens seen: class of odds, capitals, marks, end of a sentence."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.number: dict[bytes, int] = {}

    def numbers(self, raw: bytes):
        import numpy as np

        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in raw.split()], np.int64)

    def tables(self):
        import numpy as np

        out = np.zeros((4, len(self.number)), np.int64)
        for w, i in self.number.items():
            out[0, i] = self.lexicon.get(plain(w), 0)
            out[1, i] = len(w) > 2 and w.isupper()
            out[2, i] = b"!" in w
            out[3, i] = w[-1:] in (b".", b"!", b"?")
        return out


def plain(token: bytes) -> str:
    return token.decode("utf-8", "replace").strip(MARKS.decode()).lower()


def chains_of(ids, tables):
    """(first token, length) of the sentences of one text."""
    import numpy as np

    ends = np.flatnonzero(tables[3][ids])
    begin = np.unique(np.r_[0, ends + 1])
    begin = begin[begin < len(ids)]
    return begin, np.diff(np.r_[begin, len(ids)])


def features(ids, tables, begin):
    """0/1 features of each token, neighbours within the sentence only."""
    import numpy as np

    cls = tables[0][ids]
    out = np.zeros((len(ids), FEATURES), np.float32)
    out[np.arange(len(ids)), cls] = 1
    some = cls > 0
    first = np.zeros(len(ids), bool)
    first[begin] = True
    out[1:, CLASSES] = some[:-1] & ~first[1:]
    out[:-1, CLASSES + 1] = some[1:] & ~first[1:]
    out[:, CLASSES + 2] = tables[1][ids]
    out[:, CLASSES + 3] = tables[2][ids]
    return out


def marginals(odds, begin, length, moves, start, pairs: bool = False):
    """Forward-backward over many chains at once, step by step through the longest.

    odds: log score of toxic over ordinary by token; moves: 2 x 2 log scores; start: log odds of starting toxic.
    Returns the marginal of toxic by token and, if asked, the expected moves (2 x 2).
    """
    import numpy as np

    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")  # chains longer than t
    toxic, m = np.exp(np.clip(odds, -30, 30)), np.exp(moves)
    a1, b1 = np.zeros(len(odds)), np.full(len(odds), 0.5)  # shares of state 1, forward and backward
    for t, k in enumerate(live):
        at = begin[:k] + t
        if t:
            was = a1[at - 1]
            zero, one = (1 - was) * m[0, 0] + was * m[1, 0], ((1 - was) * m[0, 1] + was * m[1, 1]) * toxic[at]
        else:
            zero, one = 1.0, math.exp(start) * toxic[at]
        a1[at] = one / (zero + one)
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        after = b1[at + 1]
        zero, one = m[0, 0] * (1 - after) + m[0, 1] * toxic[at + 1] * after, m[1, 0] * (1 - after) + m[1, 1] * toxic[at + 1] * after
        b1[at] = one / (zero + one)
    p = a1 * b1
    p = p / (p + (1 - a1) * (1 - b1))
    if not pairs:
        return p, None
    inner = np.ones(len(odds), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    x = np.empty((len(at), 2, 2))
    for i in (0, 1):
        for j in (0, 1):
            x[:, i, j] = (a1[at - 1] if i else 1 - a1[at - 1]) * m[i, j] * (toxic[at] * b1[at] if j else 1 - b1[at])
    return p, (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def fit_chain(x, y, begin, length, steps: int = 120, rate: float = 0.3, ridge: float = 1e-3):
    """Weights, moves and start of the field by Adam on the conditional log likelihood."""
    import numpy as np

    inner = np.ones(len(y), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    theta, m1, m2, n = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5), np.zeros(FEATURES + 5), max(1, len(begin))
    theta[FEATURES + 4] = -1
    for step in range(1, steps + 1):
        w, moves, start = theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[-1]
        p, met = marginals(x @ w, begin, length, moves, start, True)
        g = np.r_[x.T @ (y - p), (seen - met).ravel(), (y[begin] - p[begin]).sum()] / n - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    return theta[:FEATURES], theta[FEATURES : FEATURES + 4].reshape(2, 2), float(theta[-1])


def fit_logistic(x, y, rounds: int = 25, ridge: float = 0.5):
    """Weights (the last one constant) by Newton's method."""
    import numpy as np

    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


class Field:
    """The fitted model: words, chain and score."""

    def __init__(self, lexicon, weights, moves, start, score=None):
        self.lexicon, self.weights, self.moves, self.start, self.score = lexicon, weights, moves, start, score

    def read(self, raws: list[bytes]):
        """By text: marginals of its tokens."""
        import numpy as np

        reader = Reader(self.lexicon)
        ids = [reader.numbers(x) for x in raws]
        tables, sizes = reader.tables(), [len(x) for x in ids]
        offsets = np.cumsum([0, *sizes])
        flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        parts = [chains_of(x, tables) if len(x) else None for x in ids]
        begin = np.concatenate([*(p[0] + o for p, o in zip(parts, offsets) if p), np.zeros(0, np.int64)])
        length = np.concatenate([*(p[1] for p in parts if p), np.zeros(0, np.int64)])
        odds = self._odds(flat, tables, begin)
        p, _ = marginals(odds, begin, length, self.moves, self.start)
        return [p[a:b] for a, b in zip(offsets, offsets[1:])]

    def _odds(self, ids, tables, begin):
        import numpy as np

        w = self.weights
        cls = tables[0][ids]
        some = (cls > 0).astype(np.float64)
        first = np.zeros(len(ids), bool)
        first[begin] = True
        out = w[:CLASSES][cls] + w[CLASSES + 2] * tables[1][ids] + w[CLASSES + 3] * tables[2][ids]
        if len(ids):
            out[1:] += w[CLASSES] * (some[:-1] * ~first[1:])
            out[:-1] += w[CLASSES + 1] * (some[1:] * ~first[1:])
        return out


def summary(p) -> tuple[float, float, float]:
    """Expected toxic tokens (log), the largest marginal, the share. Marginals under a quarter are left out of the sum: in a long clean text they would add up."""
    if not len(p):
        return 0.0, 0.0, 0.0
    total = float(p[p >= 0.25].sum())
    return math.log1p(total), float(p.max()), total / len(p)


def _sampled(docs: DataFrame, labels: DataFrame, toxic: str, sample: int) -> DataFrame:
    """(text, toxic) of at most so many training documents of each kind; their ids are few enough to broadcast."""
    own = labels.where(F.col(toxic).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(toxic).alias("toxic"))
    ids = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return kept(docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id").select("text", "toxic"), "toxic-sample")


def _lexicon(rows: DataFrame, size: int) -> dict[str, int]:
    """Class of log odds by word, for the words of the surest association."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch, texts in text_batches(batches):
            seen = {0: Counter(), 1: Counter()}
            for raw, toxic in zip(texts, batch.column(1).to_pylist()):
                seen[toxic].update({plain(w) for w in set(raw.split())})
            words = [*(seen[0].keys() | seen[1].keys()) - {""}]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[k][w] for w in words], pa.int64()) for k in (1, 0))], ["word", "a", "c"])

    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return {}
    counts = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, a long, c long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    odds = F.log((F.col("a") + 0.5) / (n[1] - F.col("a") + 0.5)) - F.log((F.col("c") + 0.5) / (n[0] - F.col("c") + 0.5))
    sure = F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    got = counts.where("a >= 3").withColumn("odds", odds).withColumn("sure", sure).where("odds >= 1 and sure >= 3").orderBy(F.desc("sure"), "word").limit(size)
    return {r["word"]: min(CLASSES - 1, int(r["odds"])) for r in got.collect()}


def _sentences(rows: DataFrame, lexicon: dict[str, int], most: int, one_in: int, longest: int):
    """x, y, begin, length of the training sentences: those with words of the lexicon, and others; the least hashes of each."""
    import numpy as np

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch, texts in text_batches(batches):
            reader, out = Reader(lexicon), [[], [], [], []]
            ids = [reader.numbers(x) for x in texts]
            tables = reader.tables()
            for own, toxic in zip(ids, batch.column(1).to_pylist()):
                begin, length = chains_of(own, tables) if len(own) else ((), ())
                for b, n in zip(begin, length):
                    for lo in range(b, b + n, longest):  # long ones in parts
                        part = own[lo : min(lo + longest, b + n)]
                        cls = tables[0][part]
                        code = cls + 8 * tables[1][part] + 16 * tables[2][part]
                        h = xxhash.xxh64_intdigest(code.tobytes() + part.tobytes()) >> 1
                        if cls.any() or h % one_in == 0:
                            for column, v in zip(out, (bool(cls.any()), h, code.tolist(), (cls >= TOXIC_CLASS).astype(int).tolist() if toxic else [0] * len(part))):
                                column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.bool_()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))], ["some", "h", "code", "y"])

    made = kept(rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "some boolean, h long, code array<long>, y array<long>"), "toxic-sentences")
    got = [r for some in (True, False) for r in made.where(F.col("some") == some).orderBy("h").limit(most).collect()]
    length = np.array([len(r["code"]) for r in got], np.int64)
    begin = np.cumsum(np.r_[0, length])[:-1].astype(np.int64)
    code = np.array([c for r in got for c in r["code"]], np.int64)
    tables = np.array([code & 7, (code >> 3) & 1, code >> 4, code * 0])
    return features(np.arange(len(code)), tables, begin), np.array([v for r in got for v in r["y"]], np.int64), begin, length


def train(docs: DataFrame, labels: DataFrame, toxic: str = "toxic", sample: int = 10_000, lexicon: int = 5_000, sentences: int = 3_000, one_in: int = 16, longest: int = 64) -> Field | None:
    import numpy as np

    rows = _sampled(docs, labels, toxic, sample)
    words = _lexicon(rows, lexicon)
    if not words:
        return None
    x, y, begin, length = _sentences(rows, words, sentences, one_in, longest)
    field = Field(words, *fit_chain(x, y, begin, length))

    def run(batches):
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            told = list(zip(*(summary(p) for p in field.read(texts)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.float64()) for c in told] + [batch.column(1)], ["total", "most", "share", "toxic"])

    got = rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "total double, most double, share double, toxic int").toPandas()  # 2 x sample rows at most
    field.score = fit_logistic(got[["total", "most", "share"]].to_numpy(), got["toxic"].to_numpy().astype(np.float64))
    return field


def scored(docs: DataFrame, field: Field | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic (tokens of a marginal over one half), spans (their start:end in code points)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch, texts in text_batches(batches):
            for lo in range(0, len(texts), 1000):
                some = texts[lo : lo + 1000]
                score, spans = [], []
                for raw, p in zip(some, field.read(some) if field else [()] * len(some)):
                    z = float(np.dot([*summary(p), 1.0], field.score)) if field else -math.inf
                    score.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))) if field else 0.0)
                    hot = set(np.flatnonzero(p > 0.5).tolist()) if len(p) else ()
                    spans.append([f"{m.start()}:{m.end()}" for i, m in enumerate(TOKEN.finditer(raw.decode())) if i in hot] if hot else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, 1000), pa.array(score, pa.float64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans], pa.string())], ["doc_id", "score", "n_toxic", "spans"]
                )

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_toxic long, spans string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "n_toxic", "spans")
