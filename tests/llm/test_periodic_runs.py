import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fractions import Fraction

from marginalia.llm import periodic_runs as P
from marginalia.llm.queries import digested_runs


def brute(words, least=24):
    """Every stretch of every period; of one stretch the smallest period."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 3 * q):
                best.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, length, q) for (s, length), q in best.items())


def sample(r, n, kinds):
    shape = r.randrange(6)
    if shape == 0:
        return [r.randrange(kinds) for _ in range(n)]
    if shape == 1:
        q = r.randrange(1, max(2, n // 3))
        return [r.randrange(50) for _ in range(r.randrange(10))] + ([r.randrange(kinds) for _ in range(q)] * (n // q + 1))[:n] + [r.randrange(50)]
    if shape == 2:  # a period that is nearly one word only
        q = r.randrange(1, max(2, n // 3))
        root = [0] * q
        root[r.randrange(q)] = 1
        return (root * (n // q + 1))[:n]
    if shape == 3:
        w = []
        while len(w) < n:
            root = [r.randrange(kinds) for _ in range(r.randrange(1, 60))]
            w += (root * 9)[: r.randrange(1, 8 * len(root) + 1)]
        return w[:n]
    if shape == 4:  # Fibonacci words: as many runs as can be
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    q = r.randrange(2, 80)  # runs within the root of a run
    return (([0] * (q - 2) + [1, r.randrange(3)]) * 3 + [r.randrange(3)] * r.randrange(1, 5)) * 20


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(12):
        texts = [sample(r, r.randrange(0, 500), r.choice([1, 2, 3, 10])) for _ in range(4)]
        begin = np.cumsum([0, *[len(x) + 1 for x in texts]])
        w = np.array([x for k, ws in enumerate(texts) for x in [*ws, 10**6 + k]], np.int64)
        found = list(zip(*(x.tolist() for x in P.runs(w, np.diff(begin)))))
        for k, ws in enumerate(texts):
            assert [(s - begin[k], n, q) for s, n, q in found if begin[k] <= s < begin[k + 1]] == brute(ws)


def test_other_bounds():
    r = random.Random(9)
    for least, repeats in ((5, 3), (24, 4), (50, 5)):
        ws = sample(r, 400, 2)
        want = [x for x in brute(ws, least) if x[1] >= repeats * x[2]]
        assert list(zip(*(x.tolist() for x in P.runs(np.array([*ws, 99], np.int64), np.array([len(ws) + 1]), least, repeats)))) == want


def test_a_set_depends_on_its_context_alone():
    """Consistency: equal contexts of 2t words are both in the set, or both not."""
    r = np.random.default_rng(4)
    part = r.integers(0, 4, 400)
    w = np.concatenate([r.integers(0, 4, 37), part, r.integers(0, 4, 91), part])
    t = 8
    at, _ = P.synchronising(w, t, np.zeros(len(w), bool))
    inside = {x - 37 for x in at.tolist() if 37 <= x <= 437 - 2 * t}
    assert inside == {x - 528 for x in at.tolist() if 528 <= x <= 928 - 2 * t}
    assert np.diff(at).max() <= t


def expected(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute(words)
    out = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(w for i, w in enumerate(words) if i not in out)))


def test_query_equals_brute_force(spark):
    r = random.Random(7)
    rows = [(None, None), (None, "a b " * 20), (1, ""), (2, " \n\x0b\t "), (3, "one"), (4, "word " * 23), (5, "word " * 24), (6, "no break " * 30), (7, "x y z " * 8), (7, "x y z " * 8)]
    rows += [(100 + i, r.choice([" ", "\n", " \t"]).join(f"w{x}" for x in sample(r, r.randrange(1, 400), r.choice([2, 5, 50])))) for i in range(150)]
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) >= 10
    docs = spark.createDataFrame([(*x, "z", 1) for x in rows], "doc_id long, text string, runs string, n_runs int")
    got = digested_runs(P.periodic_runs(P.repeated_tail(docs), batch_words=500))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*x) for x in rows), key=str)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_very_long_text(spark):
    """A run of a third of a million words with a period of a hundred thousand, in one text among short ones."""
    r = np.random.default_rng(1)
    root = " ".join(map(str, r.integers(0, 30, 100_000)))
    docs = spark.createDataFrame([(1, "a b c"), (2, " ".join(["head", root, root, root, root, "tail"])), (3, "q " * 30)], "doc_id long, text string")
    got = {x.doc_id: x for x in P.periodic_runs(docs).collect()}
    assert (got[2].start, got[2].length, got[2].period) == (1, 400_000, 100_000) and got[2].collapsed == f"head {root} tail"
    assert (got[1].n_runs, got[1].collapsed, got[3].collapsed) == (0, "a b c", "q")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert digested_runs(P.periodic_runs(P.repeated_tail(docs))).count() == 0
