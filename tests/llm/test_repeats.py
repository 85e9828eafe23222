import hashlib
import random

import numpy as np
import pytest

from marginalia.llm import repeats as D


def brute(rows):
    """Every 100-byte string in a dictionary of its first start."""
    first = {}
    raws = [((d is None, d or 0), (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for j in range(len(raw) - 99):
            w = raw[j : j + 100]
            first[w] = min(first.get(w, (d, j)), (d, j))
    out = []
    for (d, raw), (doc_id, _) in zip(raws, rows):
        gone = np.zeros(len(raw) + 1, bool)
        for j in range(len(raw) - 99):
            if first[raw[j : j + 100]] < (d, j):
                gone[j : j + 100] = True
        gone = gone[:-1] if len(raw) else gone[:0]
        left = bytes(b for b, g in zip(raw, gone) if not g)
        n = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        out.append((doc_id, len(raw), int(gone.sum()), n, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("rain hill fox river stone light moon été straße door".split()) + str(r.randrange(50)) for _ in range(n))
    passage, other = text(40), text(25)
    out = [(i, text(30)) for i in range(12)]
    out += [(20 + i, text(r.randrange(1, 20)) + " " + passage[r.randrange(3) : len(passage) - r.randrange(3)] + " " + text(9)) for i in range(25)]
    out += [(60 + i, other[: 60 + 10 * i]) for i in range(12)] + [(80, other + other + text(5) + other), (81, "a" * 350), (82, "ab" * 200), (83, "a" * 120)]
    base = text(80).split()
    for i in range(12):
        copy = list(base)
        for _ in range(3):
            copy[r.randrange(80)] = "edit"
        out.append((100 + i, " ".join(copy)))
    out += [(200, text(60)), (200, passage), (5, out[5][1]), (5, out[5][1]), (7, passage + text(3)), (None, passage), (None, None), (None, text(20) + other), (300, ""), (301, "x" * 99), (302, "é" * 70)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_brute_force(spark, hot):
    df = spark.createDataFrame([(*x, 0) for x in rows()], "doc_id long, text string, n_bytes int").repartition(3)
    got = D.without_repeats(df, hot=hot, shard_rows=300).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows())
    assert all(hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 for r in got)
    short = D.without_repeats(df, keep_text=False, hot=hot, shard_rows=300)
    assert short.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and sorted(map(tuple, short.collect()), key=str) == brute(rows())


def test_texts_longer_than_a_chunk(spark):
    r = random.Random(7)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_300_000))
    docs = [(1, long), (2, "start " + long[520_000:530_000] + " end"), (3, long[-150:] + long[:150])]
    got = {x.doc_id: x for x in D.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert 10_000 <= got[2].n_removed <= 10_010 and got[2].n_spans == 1
    assert got[1].n_removed == 0 and got[3].n_removed == 300 and got[3].n_spans == 1


def test_suffix_sort_equals_sorted():
    r = random.Random(8)
    raw = bytes(r.choice(b"ab") for _ in range(600)) + b"a" * 300
    buffer = np.frombuffer(raw, np.uint8)
    at = np.array([r.randrange(790) for _ in range(300)])
    group = np.sort(np.array([r.randrange(5) for _ in range(300)]))
    order = D.suffix_sort(buffer, D.Prefix(buffer), at, group)
    want = sorted(range(300), key=lambda i: (group[i], raw[at[i] : at[i] + 100], i))
    assert order.tolist() == want


def test_empty_table(spark):
    assert D.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_text_sort_as_text(spark):
    r = random.Random(9)
    text = " ".join(r.choice("rain hill fox river stone".split()) + str(r.randrange(99)) for _ in range(60))
    docs = [("9", text), ("10", "so " + text), (None, text[20:])]
    got = {x.doc_id: x.n_removed for x in D.without_repeats(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got == {"10": 0, "9": len(text), None: len(text) - 20}


def test_the_sort_decides(monkeypatch):
    """Without the suffix sort, equal strings of different spans are not neighbours and are not found."""
    r = random.Random(10)
    passage = "".join(r.choice("abcdefgh") for _ in range(180)).encode()
    raws = [bytes(r.choice(b"ijklm") for _ in range(40)) + passage[k % 3 * 9 :] for k in range(60)]
    parts = []
    for doc, raw in enumerate(raws):
        for buffer, valid, _, _ in D.chunks([raw]):
            first, last, place, a, s = D.spans(buffer, valid)
            parts += [(x, y, doc, f, e, p, raw[f : e + 100]) for f, e, p, x, y in zip(first, last, place, a, s)]
    a, s, doc, start, last, place = (np.array([p[i] for p in parts]) for i in range(6))
    content = np.empty(len(parts), object)
    content[:] = [p[6] for p in parts]

    def found():
        return sum(int((e - b + 1).sum()) for _, b, e in [D.repeats_of(a, s, doc, start, last, place, content)])

    sorted_ = found()
    monkeypatch.setattr(D, "suffix_sort", lambda buffer, prefix, at, group: np.arange(len(at)))
    assert found() < sorted_
