import hashlib
import random
import zlib

import pytest

from marginalia.llm import merkle as M
from marginalia.llm.queries import checked_proofs


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def climb(levels, i):
    """(left, right) siblings by level."""
    out = []
    for level in levels[:-1]:
        a = i // 3 * 3
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 3])))
        i //= 3
    return out


def brute(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        changed = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        groups.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, changed)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([x[1] for x in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, own, changed) in enumerate(groups[s]):
            way = climb(trees[s], i) + climb(top, k)
            got = changed
            for a, b in way:
                got = sha(a, got, b)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], sha(*[a + b for a, b in way]), got, got == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, lo string, way int"


def table(spark, rows):
    return spark.createDataFrame([(*x, "z", 1) for x in rows], SCHEMA)


def rows_of(sizes, seed=1):
    r = random.Random(seed)
    out = [(None, "a", None, None, None), (None, None, "en", 1, "x\ny"), (5, "a", "en", 3, ""), (5, "a", "en", 3, ""), (5, "a", "de", 3, "other"), (2**62, "É", "en", 3, "Grüße\n\n"), (0, "￿", "", 0, "\n"), (-7, "\U00010000", "en", 1, "\r\n")]
    for k, n in enumerate(sizes):
        ids = r.sample(range(10**6), n)
        out += [(i, f"source {k}", "en", i % 50, "line\n" * (i % 3) + str(i)) for i in ids]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("layer", [6, 2, 1])
def test_equals_brute_force(spark, monkeypatch, layer):
    """Layers of few levels send groups of few leaves through many of them."""
    monkeypatch.setattr(M, "LAYER", layer)
    rows = rows_of([1, 2, 3, 4, 9, 10, 27, 28, 82])
    assert sorted(map(tuple, checked_proofs(M.proofs(table(spark, rows))).collect()), key=str) == brute(rows)


def test_one_large_source_and_many_sources(spark):
    rows = rows_of([1500, *[1] * 800])
    assert sorted(map(tuple, checked_proofs(M.proofs(table(spark, rows))).collect()), key=str) == brute(rows)


def test_intervals_nest(spark, monkeypatch):
    monkeypatch.setattr(M, "LAYER", 2)
    rows = rows_of([1, 40])
    got = [x for x in M.nodes(table(spark, rows)).collect() if x.source == "source 1"]
    by_level = {}
    for x in got:
        by_level.setdefault(x.level, []).append((x.lo, x.hi, x.digest))
    levels = [sorted(by_level[k]) for k in range(len(by_level))]
    want = tree([leaf(*x) for x in sorted((x for x in rows if x[1] == "source 1"), key=lambda x: x[0])])
    assert [[d for _, _, d in level] for level in levels] == want
    for k, level in enumerate(levels):
        assert [(a, b) for a, b, _ in level] == [(a, min(a + 3**k, 40)) for a in range(0, 40, 3**k)]


def test_very_long_text(spark):
    rows = [(k, "a", "en", 1, "long\n" * 1_000_000 if k == 2 else "short") for k in range(4)]
    assert sorted(map(tuple, checked_proofs(M.proofs(table(spark, rows))).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    got = checked_proofs(M.proofs(table(spark, [])))
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
