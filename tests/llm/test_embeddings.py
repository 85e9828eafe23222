import numpy as np
import pytest

from marginalia.llm import embeddings as E

SCHEMA = "vec_id long, label int, embedding array<float>, home int, list string"


def brute(rows, least=0.98):
    def fine(label, v):
        return label is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v)

    n = len(rows)
    near = np.zeros((n, n), bool)
    for i, (_, a, v) in enumerate(rows):
        for j, (_, b, w) in enumerate(rows[:i]):
            if a == b and fine(a, v) and fine(b, w) and len(v) == len(w):
                x, y = np.float32(v).astype(float), np.float32(w).astype(float)
                near[i, j] = near[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= least
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *[root[j] for j in np.flatnonzero(near[i])]]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((d, int(near[i].sum()), least_id, d == least_id))
    return sorted(out, key=str)


def vectors(seed=0, dims=24):
    r = np.random.default_rng(seed)
    rows = [(d, int(r.integers(0, 3)), r.normal(size=dims)) for d in range(200)]
    for k in range(12):  # clusters whose pairs lie on both sides of the bound, and copies
        centre = r.normal(size=dims)
        rows += [(1000 + 20 * k + i, k % 3, centre + r.normal(size=dims) * r.uniform(0, 0.25)) for i in range(15)]
        rows += [(2000 + k, k % 3, centre), (3000 + k, k % 3, centre), (4000 + k, (k + 1) % 3, centre), (5000 + k, k % 3, 7 * centre)]
    rows = [(d, label, [float(np.float32(x)) for x in v]) for d, label, v in rows]
    v = rows[0][2]
    odd = [(7000, None, v), (7001, 0, None), (7002, 0, []), (7003, 0, [0.0] * dims), (7004, 0, [float("nan")] * dims), (7005, 0, [float("inf"), *v[1:]]), (7006, 0, [None, *v[1:]])]
    odd += [(7007, 0, v[:8]), (7008, 0, v[:8]), (7009, 0, [1e-40, *[0.0] * 5]), (7010, 0, [3e38, *[0.0] * 5]), (None, 1, v[:9]), (None, 1, v[:9]), (0, rows[0][1], v), (None, rows[0][1], v)]
    return rows + odd


@pytest.mark.parametrize("options", [{}, {"per_list": 8, "sample": 150}, {"per_list": 40, "limit": 7}, {"per_list": 5, "limit": 30, "subspaces": 40, "most_lists": 16}])
def test_equals_brute_force(spark, options):
    rows = vectors()
    got = E.near_vectors(spark.createDataFrame([(*x, 3, "z") for x in rows], SCHEMA), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_large_group(spark):
    """A third of all rows are one vector, another third near copies of one; over many lists and tiles."""
    r = np.random.default_rng(5)
    hub = r.normal(size=16)
    rows = [(i, 1, hub) for i in range(300)] + [(1000 + i, 1, hub + 1 + r.normal(size=16) * 0.12) for i in range(300)] + [(2000 + i, 1, r.normal(size=16)) for i in range(300)]
    rows = [(d, label, [float(np.float32(x)) for x in v]) for d, label, v in rows]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), per_list=30, limit=64)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_no_pair_is_beyond_both_planes():
    r = np.random.default_rng(2)
    x = E._units(r.normal(size=(400, 12)))
    y = E._units(x + r.normal(size=x.shape) * 0.04)
    q = E.Quantiser(x, 60, 4)
    a, b = (E._distances(v, q.centres).argmin(axis=1) for v in (x, y))
    near = ((x - y) ** 2).sum(axis=1) <= 0.04
    met = (a == b) | q.visits(x, a, 0.1)[np.arange(400), b] | q.visits(y, b, 0.1)[np.arange(400), a]
    assert near.sum() > 300 and (a != b)[near].sum() > 5 and met[near].all()


def test_table_distances_bound_true_ones():
    r = np.random.default_rng(3)
    x = E._units(r.normal(size=(300, 20)))
    q = E.Quantiser(x, 4, 5)
    left = x - q.centres[0]
    codes, lost = q.codes(left)
    d = np.sqrt(sum(t[:, codes[:, m]] for m, t in enumerate(q.tables(left))).clip(0))
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert (np.abs(d - true) <= lost + 1e-3).all()


def test_empty_table(spark):
    got = E.near_vectors(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["vec_id", "n_links", "component_id", "kept"]
