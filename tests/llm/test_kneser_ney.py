import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import kneser_ney as K


def brute(texts):
    """P of every 5-gram seen or not, by dictionaries."""
    counts = [None] * 5 + [collections.Counter()]
    for t in texts:
        s = [0, 0, 0, 0, *t.encode()]
        counts[5].update(tuple(s[i : i + 5]) for i in range(len(s) - 4))
    for n in (4, 3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        t = [sum(v == k for v in c.values()) for k in range(5)]
        if not (t[1] and t[2]):
            return [0.5] * 3
        y = t[1] / (t[1] + 2 * t[2])
        return [min(k, max(0.0, k - (k + 1) * y * t[k + 1] / t[k])) if t[k] else 0.5 for k in (1, 2, 3)]

    ds = {n: discounts(counts[n]) for n in (1, 2, 3, 4, 5)}
    by = {n: collections.defaultdict(dict) for n in (1, 2, 3, 4, 5)}
    for n in by:
        for g, c in counts[n].items():
            by[n][g[:-1]][g[-1]] = c

    def p(g):
        n = len(g)
        if not n:
            return 1 / K.SIZE
        own, low = by[n].get(g[:-1]), p(g[1:])
        if not own:
            return low
        total, cut = sum(own.values()), lambda c: ds[n][min(c, 3) - 1]
        return max(0.0, own.get(g[-1], 0) - cut(own.get(g[-1], 0)) * (g[-1] in own)) / total + sum(map(cut, own.values())) / total * low

    return p


def prose(r, n):
    return " ".join(r.choice("the quick brown fox jumps over a lazy dog While rain falls on 12 hills".split()) for _ in range(n)) + "."


def looked_up(tables):
    return K.Lookup([tuple(t[c].to_numpy() for c in ("key", "p", "context", "back")) for t in tables])


def test_probabilities_equal_brute_force_and_sum_to_one(spark):
    r = random.Random(1)
    texts = [prose(r, 12) for _ in range(15)] + ["é", "", "ab"]
    tables = [t.toPandas() for t in K.model(spark.createDataFrame([(t,) for t in texts], "text string"))]
    model, p = looked_up(tables), brute(texts)
    near = [k ^ r.randrange(256) << 8 * r.randrange(5) for k in tables[4]["key"].tolist() for _ in range(2)]
    some = np.array([r.randrange(K.SIZE**5) for _ in range(200)] + tables[4]["key"].tolist()[:300] + near[:600])
    for k, log in zip(some.tolist(), model.log2(some).tolist()):
        g = tuple(k >> 8 * i & 255 for i in (4, 3, 2, 1, 0))
        assert math.isclose(2.0**log, max(p(g), K.FLOOR), rel_tol=1e-6), g
    for k in some[::50]:
        assert math.isclose((2.0 ** model.log2((k & ~255) + np.arange(256))).sum(), 1, abs_tol=1e-9)


def test_scores_by_joins_equal_those_by_broadcast_and_brute_force(spark):
    docs, _ = frames(spark)
    docs = docs.where("coalesce(doc_id, 0) % 40 = 0 or doc_id > 1999").repartition(3)
    texts = [prose(random.Random(5), 12) for _ in range(15)]
    tables = K.model(spark.createDataFrame([(t,) for t in texts], "text string"))
    arrays = [tuple(t.toPandas()[c].to_numpy() for c in ("key", "p", "context", "back")) for t in tables]
    key = lambda r: (str(r.doc_id), r.lang or "", r.n_symbols, round(r.bits, 4))
    one, two = (sorted(map(key, df.collect())) for df in (K.scored(docs, arrays), K.scored_by_joins(docs, tables)))
    assert len(one) == docs.count() and [x[:3] for x in one] == [x[:3] for x in two]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-9, abs_tol=1e-3) for a, b in zip(one, two))
    p, text = brute(texts), docs.where("doc_id = 40").first().text
    s = [0, 0, 0, 0, *text.encode()]
    want = -sum(math.log2(max(K.FLOOR, p(tuple(s[i : i + 5])))) for i in range(len(s) - 4))
    assert any(x[0] == "40" and math.isclose(x[3], want, rel_tol=1e-6) for x in one)


def frames(spark):
    r = random.Random(2)
    rows = [(i, prose(r, 60), "en") for i in range(200)] + [(i, prose(r, 60).replace("e", "é"), "fr") for i in range(200, 400)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(r, 60).split()), "en") for i in range(20)] + [(1100 + i, prose(r, 40).upper(), "fr") for i in range(20)]
    rows += [(None, None, None), (2000, "", "en"), (2001, "the fox.", "en"), (2001, "the fox.", "en"), (2002, prose(r, 30000), "en"), (2003, prose(r, 60), "xx")]
    labels = [(i, 1, 0) for i in range(0, 400, 2)] + [(1000, 0, 0), (2, None, 0)]
    return spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, lang string, kept boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_text_stays(spark):
    docs, labels = frames(spark)
    got = {r.doc_id: r for r in K.judged(docs, labels).collect()}
    assert not any(got[i].kept for i in [*range(1000, 1020), *range(1100, 1120)])
    assert sum(got[i].kept for i in range(400)) >= 390  # the threshold is the 99 per cent quantile of half of them
    assert all(got[i].kept for i in (None, 2000, 2001, 2002, 2003)) and got[2000].perplexity is None
    assert K.judged(docs, labels).count() == docs.count()


def test_thresholds_are_the_languages_quantiles(spark):
    """kept and threshold from perplexities alone, recomputed."""
    docs, labels = frames(spark)
    got = K.judged(docs, labels, prior=0).collect()
    held = {r.doc_id for r in labels.where("quality = 1").where(K.held_out(F.col("doc_id"))).collect()} - {2}
    for lang in ("en", "fr"):
        trusted = sorted(r.perplexity for r in got if r.doc_id in held and r.lang == lang)
        own = [r for r in got if r.lang == lang]
        bound = {r.threshold for r in own if r.n_symbols}
        assert len(bound) == 1 and trusted[-3] < bound.pop() <= trusted[-1] + 1e-9
        assert all(r.kept == (r.perplexity is None or r.perplexity <= r.threshold + 1e-12) for r in own)


def test_large_tables_are_not_broadcast(spark):
    docs, labels = frames(spark)
    some = docs.where("doc_id % 20 = 0 or doc_id >= 1000")
    a, b = ({(r.doc_id, r.kept, round(r.perplexity or 0, 6)) for r in K.judged(some, labels, **x).collect()} for x in ({}, {"broadcast_rows": 10}))
    assert a == b


def test_no_trusted_documents_keep_everything(spark):
    docs, labels = frames(spark)
    assert K.judged(docs, labels.limit(0)).where("not kept").count() == 0
    assert K.judged(docs.limit(0), labels).count() == 0


def test_every_trusted_document_trains_the_model(spark):
    """Half of 42,000 trusted documents train; the words of those whose ids have the greatest hashes count like all others."""
    ids = spark.range(42_000).withColumn("last", F.xxhash64("id") > F.lit(int(0.99 * 2**63)))
    docs = ids.select(F.col("id").alias("doc_id"), F.when(F.col("last"), "zq zq zq").otherwise("ab ab ab").alias("text"), F.lit("en").alias("lang"))
    probe = spark.createDataFrame([(-1, "zq zq zq", "en"), (None, "zq zq zq", "en")], "doc_id long, text string, lang string")
    labels = ids.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    got = {r.doc_id: r.perplexity for r in K.judged(docs.unionByName(probe), labels).where("coalesce(doc_id, -1) = -1").collect()}
    texts = docs.where(~K.held_out(F.col("doc_id"))).select("text")
    assert texts.count() > 20_000 and texts.where("text like 'z%'").count()
    table = looked_up([t.toPandas() for t in K.model(texts)])
    want = 2 ** -table.log2(K._keys([b"zq zq zq"])[0]).mean()
    assert all(math.isclose(got[i], want, rel_tol=1e-9) for i in (-1, None)) and len(got) == 2
