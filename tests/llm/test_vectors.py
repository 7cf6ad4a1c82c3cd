"""Centroid clustering and whitening against slow twins over awkward tables."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lloyd, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, digest string, q int, n long, cluster int, x string, vector int, z int"


def table(spark, vectors, parts=3):
    rows = [(i, v, k, "d", k, k, k, "x", k, k) for k, (i, v) in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(dims=4, seed=3):
    """Nulls, NaN, infinities, other lengths, hot and repeated vectors, ties, a null id, an id that repeats."""
    rng = random.Random(seed)
    some = lambda: [rng.gauss(0, 1) * (k + 1) for k in range(dims)]
    hot = some()
    rows = [(k, some()) for k in range(150)] + [(k, hot) for k in range(150, 260)] + [(k, [float(k % 3)] * dims) for k in range(260, 300)]
    rows += [(300, None), (301, []), (302, [1.0] * (dims - 1)), (303, [math.nan] + [0.0] * (dims - 1)), (304, [math.inf] * dims), (305, [None] * dims), (None, some()), (7, some()), (8, rows[8][1])]
    return rows


def kept(vectors, dims):
    return [(i, np.float32(v).astype(float)) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def slow_lloyd(vectors, dims, k, rounds, scale, seed):
    own = [(i, [math.floor(scale * x) for x in v]) for i, v in kept(vectors, dims)]
    order = sorted(own, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups: dict = {}
        for _, q in own:
            groups.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, q, *near(q)) for i, q in own]
    inertia = Counter()
    for _, _, d, c in last:
        inertia[c] += d
    copies = Counter(tuple(q) for _, q, _, _ in last)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return Counter((i, c, d, inertia[c], inertia.total(), digest(c), copies[tuple(q)]) for i, q, d, c in last)


@pytest.mark.parametrize(("k", "scale"), [(5, 256), (12, 1), (400, 16), (3, 1 << 22)])
def test_clusters_against_a_slow_twin(spark, k, scale):
    """Scale 1 gives ties, empty centroids and equal seeds; 400 more centroids than vectors; 2^22 entries that only whole-number distances tell apart."""
    vectors = awkward()
    got = lloyd.cluster_vectors(table(spark, vectors), 4, k, 5, scale, 2).collect()
    assert Counter(tuple(r) for r in got) == slow_lloyd(vectors, 4, k, 5, scale, 2)


def test_hot_and_light_vectors_are_joined_alike(spark, monkeypatch):
    vectors = awkward(seed=5)
    want = slow_lloyd(vectors, 4, 6, 3, 256, 2)
    for share in (1, 50, 10**9):
        monkeypatch.setattr(lloyd, "HOT_SHARE", share)
        assert Counter(tuple(r) for r in lloyd.cluster_vectors(table(spark, vectors), 4, 6, 3).collect()) == want


def test_distances_are_exact_on_both_ways():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 20, 1 << 27):
        x, c = rng.integers(-most, most, (50, 64)), rng.integers(-most, most, (7, 64))
        best, d = lloyd.nearest(x, c)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
        assert best.tolist() == [r.index(min(r)) for r in exact] and d.tolist() == [min(r) for r in exact]


def test_clusters_of_no_vectors_and_of_too_large_ones(spark):
    assert lloyd.cluster_vectors(table(spark, [])).count() == 0
    assert lloyd.cluster_vectors(table(spark, [(1, None), (2, [1.0])]), 4).count() == 0
    with pytest.raises(Exception, match="beyond 2\\^27"):
        lloyd.cluster_vectors(table(spark, [(1, [1e30] * 4)]), 4).collect()


# ---- whitening ----
def slow_whitening(vectors, dims, most):
    own = kept(vectors, dims)
    x = [[math.floor(64 * e) + 1_000_000 for e in v] for _, v in own]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * e - s) / n for e, s in zip(r, sums, strict=True)] for r in x])
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    used = min(most, int((e > 1e-9 * e[0]).sum()))
    z = centred @ q[:, :used] / np.sqrt(e[:used])
    return [i for i, _ in own], [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x], z, e[:used] / np.trace(v)


@pytest.mark.parametrize(("dims", "most", "parts"), [(4, 32, 3), (4, 2, 1), (7, 32, 70), (1, 32, 2)])
def test_whitening_against_eigenvectors(spark, dims, most, parts):
    """70 partitions merge their states in two rounds."""
    vectors = [(i if i is not None else -1, v) for i, v in awkward(dims, 11)]
    vectors = [(k if i >= 0 else None, v) for k, (i, v) in enumerate(vectors)]  # ids that differ, to line up the rows
    if dims == 1:
        vectors = [r for r in vectors if r[1] != []]
    ids, deviation, z, explained = slow_whitening(vectors, dims, most)
    rows = whitening.whiten(table(spark, vectors, parts), most).collect()
    assert len(rows) == z.size and {r["n"] for r in rows} == {len(ids)}
    place = {i: k for k, i in enumerate(ids)}
    got = np.zeros_like(z)
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[place[r["vec_id"]]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert np.abs(got * np.sign((got * z).sum(0)) - z).max() < 1e-8
    assert max(r["identity_error"] for r in rows) == pytest.approx(np.abs(np.cov(got.T, bias=True) - np.eye(z.shape[1])).max(), abs=1e-12)


def test_small_singular_values_are_accurate():
    """Values over twelve orders of magnitude: squares would have lost those below the eighth."""
    rng = np.random.default_rng(4)
    u, v = (np.linalg.qr(rng.normal(size=(12, 12)))[0] for _ in range(2))
    want = 10.0 ** -np.arange(12)
    sigma, w = whitening.jacobi((u * want) @ np.eye(12))
    assert np.allclose(sigma, want, rtol=1e-10) and np.allclose(w.T @ w, np.eye(12), atol=1e-14)
    sigma, w = whitening.jacobi((u * want) @ v.T)
    assert np.allclose(sigma[:8], want[:8], rtol=1e-6)
    for shape in ((3, 5), (1, 1), (6, 2)):
        a = rng.normal(size=shape)
        sigma, w = whitening.jacobi(a)
        assert np.allclose(sigma[: min(shape)], np.linalg.svd(a)[1]) and np.allclose((a @ w) ** 2 @ np.ones(shape[1]), (a**2).sum(1))
        assert (sigma[min(shape) :] < 1e-14).all()


def test_whitening_of_few_flat_and_no_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    one_flat = whitening.whiten(table(spark, [(k, [1.0, float(k)]) for k in range(9)])).collect()
    assert {r["component"] for r in one_flat} == {1} and len(one_flat) == 9 and one_flat[0]["explained"] == pytest.approx(1)
    mixed = whitening.whiten(table(spark, [(k, [1.0, float(k)]) for k in range(9)] + [(20, [5.0]), (21, [1.0, 2.0, 3.0])])).collect()
    assert {r["vec_id"] for r in mixed} == set(range(9))
    with pytest.raises(Exception, match="no long"):
        whitening.whiten(table(spark, [(1, [1e30] * 4), (2, [0.0] * 4)])).collect()


def test_deviations_at_the_edge_of_a_long():
    n = 1 << 20
    model = whitening.Whitening(n, [0, n // 2], np.eye(2), np.ones(2), 2.0)
    x = np.array([[0, 0], [2896, 3], [2897, 0], [1 << 40, 0], [-2896, -1]])
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in x]
    got = model.deviations(x)
    assert [None if m else v for m, v in zip(np.ma.getmaskarray(got).tolist(), got.data.tolist(), strict=True)] == [e if e < 1 << 63 else None for e in exact]
    assert None in [e if e < 1 << 63 else None for e in exact]
