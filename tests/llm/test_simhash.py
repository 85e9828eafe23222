import random
import re

import numpy as np
import pytest
import xxhash

from marginalia.llm import simhash as S
from marginalia.llm.components import components


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def texts():
    r = random.Random(3)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(30)) for _ in range(300)) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, " \n\t "), (3, "One"), (4, "one TWO"), (5, "one two three"), (5, "one two three"), (7, "É É é"), (None, "only null ids"), (None, "only null ids")]
    for i, b in enumerate(base):
        rows.append((100 + i, b))
        for k in range(3):
            words = b.split()
            words[r.randrange(300)] = "changed"
            rows.append((200 + 10 * i + k, " ".join(words)))
        rows.append((50 + i, b.upper()))
    return rows


def test_equals_brute_force(spark):
    rows = texts()
    got = S.near_duplicates(spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, fp string"))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [4096, 20, 4])
def test_trie_join_loses_no_link(spark, limit):
    """A dense ball of fingerprints: groups over the limit are dealt again until they fit."""
    r = np.random.default_rng(5)
    centre = r.integers(0, 2**63, 12, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for c in centre for _ in range(25)]
    fps = sorted({*map(int, centre), *near})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    rooted = {x.node: x.root for x in components(S.links(spark.createDataFrame(signed, "fp long"), 3, limit)).collect()}
    root = list(range(len(fps)))
    again = True
    while again:
        again = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    again = True
    classes = lambda of: sorted(sorted(c) for c in of.values())
    want, got = {}, {}
    for i, (x,) in enumerate(signed):
        want.setdefault(root[i], []).append(x)
        got.setdefault(rooted.get(x, x), []).append(x)
    assert classes(got) == classes(want)


def test_components_of_a_chain(spark):
    n = 70
    got = components(spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 500), (600, 601)], "u long, v long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(1, n + 1)} | {(601, 600)}
