import random

import pytest

from marginalia.llm import near_copies as N

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingle_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_ids that stay where every pair of an overlap of 0.8 or more is linked."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    again = True
    while again:
        again = False
        for i in range(len(rows)):
            for j in range(i):
                union = len(sets[i] | sets[j])
                if 5 * len(sets[i] & sets[j]) >= 4 * union and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    again = True
    return sorted(min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root))


def texts():
    r = random.Random(8)
    word = lambda: r.choice("ab cd ef gh ij kl mn op".split()) + str(r.randrange(200))
    line, rows = " ".join(word() for _ in range(12)), [(1, None), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three")]
    for b in range(12):
        base = [word() for _ in range(60 + 20 * b)] + line.split()
        for k in range(8):
            words = list(base)
            for p in r.sample(range(len(words)), k * len(words) // 90):
                words[p] = word()
            rows.append((1000 - 10 * b - k, " ".join(words)))
    rows += [(2000 + i, " ".join([line] * i)) for i in range(1, 5)]
    return rows


def test_stage_equals_brute_force(spark):
    rows = texts()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    want = brute(rows)
    assert sorted(r.doc_id for r in got.collect()) == want and 20 < len(want) < len(rows) - 20


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z"), (5, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in N.representatives(df).collect()), key=str) == sorted([(1, "a b c d"), (None, "x y z"), (3, "")], key=str)
    assert N.representatives(df.limit(0)).count() == 0


def test_prefix_size():
    assert [N.prefix_size(n, 80) for n in (0, 1, 4, 5, 6, 10, 11)] == [0, 1, 1, 2, 2, 3, 3]


def test_stage_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == brute([tuple(r) for r in docs.collect()])


def test_hot_shingles_lose_no_link(spark):
    import functools

    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = N.candidates
    N.candidates = functools.partial(whole, hot=3, shard_rows=50, deal=3)
    try:
        assert sorted(r.doc_id for r in N.representatives(df).collect()) == brute(rows)
    finally:
        N.candidates = whole


def test_columns_with_the_names_used_inside(spark):
    rows = [(1, "a b c d e f", 7, "x", 1), (2, "a b c d e f", 8, "y", 2), (3, "g", 9, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid long, node string, _rid long")
    assert sorted(map(tuple, N.representatives(df).collect())) == [rows[0], rows[2]]


def test_ids_of_text(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e f"), ("c", "g h")]
    assert sorted(r.doc_id for r in N.representatives(spark.createDataFrame(rows, "doc_id string, text string")).collect()) == ["a", "c"]


def test_counts_of_small_and_large_sets():
    import numpy as np
    import pyarrow as pa

    small, large = np.arange(50, dtype=np.uint64) << np.uint64(24), np.zeros(300, np.uint64)
    got = N.counts_of(pa.array([N.bucket_counts(small), N.bucket_counts(large)], pa.binary()))
    assert got.sum(axis=1).tolist() == [50, 300] and got[1, 0] == 300
    assert N.may_overlap(got[:1], got[:1], np.array([100]), 80).tolist() == [True] and N.may_overlap(got[:1], got[1:], np.array([350]), 80).tolist() == [False]


def test_second_round_dealt_over_cells_is_all_pairs(spark):
    import numpy as np

    r = np.random.default_rng(3)
    base = [r.integers(1, 2**62, 40, dtype=np.uint64) for _ in range(6)]
    sets = []
    for k in range(90):
        own = base[k % 6].copy()
        own[r.choice(40, k % 5, replace=False)] = r.integers(1, 2**62, k % 5, dtype=np.uint64)
        sets.append(np.unique(np.r_[own[: 40 - k % 9], np.uint64(7)]))
    n = np.array([len(x) for x in sets])
    rows = [(k, len(x), 0, k % 40, [(7, 0), (1000 + k, 1)], N.bucket_counts(x)) for k, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n long, fp long, label long, prefix array<struct<h:long,at:long>>, buckets binary")
    counts = np.stack([np.frombuffer(x[5], "u1") for x in rows])
    i, j = np.triu_indices(90, 1)
    fit = (i % 40 != j % 40) & (180 * np.minimum(n[i], n[j]) >= 80 * (n[i] + n[j])) & N.may_overlap(counts[i], counts[j], n[i] + n[j], 80)
    want = sorted(zip(j[fit].tolist(), i[fit].tolist()))
    for deal in (1, 20, 10**9):
        got = N.candidates(nodes, 80, False, shard_rows=100, deal=deal)
        assert sorted(map(tuple, got.collect())) == want and 50 < len(want) < 2000
