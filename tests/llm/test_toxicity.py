import itertools
import math
import random
import zlib

import numpy as np

from marginalia.llm import toxicity as T


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    length = np.array([3, 1, 5, 2])
    begin = np.array([0, 3, 4, 9])
    odds, moves, start = r.normal(size=11), r.normal(size=(2, 2)), 0.3
    p, met = T.marginals(odds, begin, length, moves, start, True)
    want, pairs = np.zeros(11), np.zeros((2, 2))
    for b, n in zip(begin, length):
        total, own, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            z = math.exp(start * y[0] + sum(odds[b + i] * y[i] for i in range(n)) + sum(moves[a, c] for a, c in zip(y, y[1:])))
            total += z
            own += z * np.array(y)
            for a, c in zip(y, y[1:]):
                seen[a, c] += z
        want[b : b + n] = own / total
        pairs += seen / total
    assert np.allclose(p, want) and np.allclose(met, pairs)


def corpus(spark):
    r = random.Random(5)
    words, bad = [f"w{i}" for i in range(400)], ["vile", "rotten", "beast"]
    rows, labels = [(None, None, 1), (10_000, "", 1), (10_001, " \n ", 1), (10_002, "long " * 30000, 1)], []
    for i in range(400):
        text = [r.choice(words) + ("." if r.random() < 0.1 else "") for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[r.randrange(60)] = r.choice(bad) + r.choice(["", ",", "!"])
        rows.append((i, " ".join(text), 2))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_spans(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in T.scored(docs, T.train(docs, labels)).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 404 and not any(got[i].predicted for i in (None, 10_000, 10_001, 10_002))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held) + sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in (10_000, 10_001, 10_002))
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.97
    for i in held:
        for span in filter(None, got[i].spans.split(",")):
            s, e = map(int, span.split(":"))
            assert text[i][s:e].strip(",!.") in ("vile", "rotten", "beast")


def test_without_labels_all_scores_are_zero(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in T.scored(docs, T.train(docs, labels.limit(0))).select("score").distinct().collect()} == {0.0}
    assert T.scored(docs.limit(0), T.train(docs, labels.where("toxic = 0"))).count() == 0


def test_repeated_rows_are_scored_alike(spark):
    docs, labels = corpus(spark)
    twice = docs.union(docs.where("doc_id in (0, 1, 10000) or doc_id is null"))
    got = T.scored(twice, T.train(docs, labels)).where("doc_id in (0, 1, 10000) or doc_id is null").collect()
    assert len(got) == 8 and len({(r.doc_id, r.score, r.predicted, r.spans) for r in got}) == 4
