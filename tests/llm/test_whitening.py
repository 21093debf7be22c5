"""Whitening against exact integers and a plain eigendecomposition."""
import math
import random

import numpy as np
import pytest

from plumbline.llm import queries, whitening


def brute(rows, components=32):
    """{vec_id: [(component, n, deviation, |whitened|, explained)]} of vectors of one length."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n = len(good)
    sums = [sum(x[j] for _, x in good) for j in range(len(good[0][1]))]
    whole = [(i, [n * c - s for c, s in zip(x, sums, strict=True)]) for i, x in good]
    d = np.array([[c / n for c in x] for _, x in whole])
    v = d.T @ d / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, len(sums))
    return [(i, c + 1, n, sum(a * a for a in x), float(d[r] @ q[:, c] / math.sqrt(e[c])), float(e[c] / np.trace(v))) for r, (i, x) in enumerate(whole) for c in range(k)]


def compare(found, want):
    assert len(found) == len(want)
    found, want = sorted(found, key=lambda r: (r.deviation, r.vec_id is None, r.vec_id, r.component)), sorted(want, key=lambda r: (r[3], r[0] is None, r[0], r[1]))
    sign = {}
    for f, w in zip(found, want, strict=True):
        assert (f.vec_id, f.component, f.n, int(f.deviation)) == w[:4]
        assert abs(f.explained - w[5]) <= 1e-9 * w[5] + 1e-15
        if abs(w[4]) > 0.1:
            sign.setdefault(w[1], math.copysign(1, w[4] * f.whitened))
        assert abs(f.whitened * sign.get(w[1], 1) - w[4]) < 1e-7 or w[1] not in sign


def test_whitening_matches_eigenvectors(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((6, 6)) * np.array([5, 4, 3, 2, 1, 0.5])
    rows = [(i, (rng.standard_normal(6) @ mix).tolist()) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [math.nan] + [0.0] * 5), (304, [math.inf] + [0.0] * 5), (7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1])]
    frame = spark.createDataFrame([(i, v, "a", 3) for i, v in rows], "vec_id long, embedding array<double>, whitened string, n int").repartition(3)
    found = whitening.whiten_embeddings(frame, components=4).collect()
    compare(found, brute(rows, 4))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_whitening_query_on_the_table(spark):
    found = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.01")
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = found.collect()
    compare(found, brute(rows))
    assert max(r.identity_error for r in found) < 1e-4


def test_whitening_of_empty_equal_and_unlike_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten_embeddings(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten_embeddings(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    same = whitening.whiten_embeddings(spark.createDataFrame([(i, [0.5, 2.0]) for i in range(5)], schema)).collect()
    assert len(same) == 10 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in same)
    two = whitening.whiten_embeddings(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in two) == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 1)]
    assert {r.vec_id: abs(round(r.whitened, 9)) for r in two if r.component == 1 and r.n == 2} == {1: 1.0, 2: 1.0}
    assert all(r.whitened is None for r in two if r.component == 2 or r.n == 1)


def test_whitening_of_large_entries_is_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e12, 1e12), rng.uniform(-1, 1)]) for i in range(50)] + [(50, [1e300, -1e300])]
    found = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    clipped = lambda c: max(-(2.0**52), min(2.0**52, math.floor(max(-(2.0**52), min(2.0**52, c)) * 64)))
    x = {i: [int(clipped(c)) + 1_000_000 for c in v] for i, v in rows}
    sums = [sum(v[j] for v in x.values()) for j in range(2)]
    assert {r.vec_id: int(r.deviation) for r in found} == {i: sum((51 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}


@pytest.mark.parametrize("m", [1, 2, 7, 40])
def test_spectral_components(m):
    a = np.random.default_rng(m).standard_normal((m, 2 * m))
    for v in (a @ a.T, np.eye(m), np.zeros((m, m)), np.diag(2.0 ** -np.arange(m)), np.diag([1.0] * (m - m // 2) + [3.0] * (m // 2))):
        e, q = whitening.spectral_components(v)
        assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-13 * max(1, np.abs(v).max()) * m
        assert np.abs(q.T @ q - np.eye(m)).max() < 1e-13 and np.abs(v @ q - q * e).max() <= 1e-13 * max(1, np.abs(v).max()) * m


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(1).standard_normal((20, 20)) @ np.diag(10.0 ** -np.arange(20.0).clip(0, 12))
    u = whitening.qdwh(a)
    w, _, z = np.linalg.svd(a)
    assert np.abs(u.T @ u - np.eye(20)).max() < 1e-13 and np.abs(u - w @ z).max() < 1e-3
