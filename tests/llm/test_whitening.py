"""Whitening against numpy's eigenvectors and whole numbers in Python."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening as W


def plain(vectors, components, scale=1024, offset=100_000):
    """deviation of each vector, eigenvalues and vectors of the covariance, shares, and centred x."""
    xs = [[math.floor(scale * c) + offset for c in v] for v in vectors]
    n, d = len(xs), len(xs[0])
    total = [sum(x[i] for x in xs) for i in range(d)]
    far = [sum((n * x[i] - total[i]) ** 2 for i in range(d)) for x in xs]
    centred = np.array([[(n * x[i] - total[i]) / n for i in range(d)] for x in xs])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return far, values[order], vecs[:, order], values[order] / values.sum(), centred


def check(df, usable, components=8):
    got = W.whiten(df, components).collect()
    far, values, vecs, share, centred = plain([v for _, v in usable], components)
    assert len(got) == len(usable) * len(values)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    white = centred @ vecs / np.sqrt(values)
    signs = {}
    for row, (i, _) in enumerate(usable):
        for c in range(len(values)):
            r = by_id[i][c + 1][0]
            if abs(white[row, c]) > 1e-6:
                signs.setdefault(c, math.copysign(1, r["whitened"] * white[row, c]))
            assert abs(r["whitened"] - signs.get(c, 1) * white[row, c]) < 1e-7
            assert (r["n"], int(r["deviation"])) == (len(usable), far[row])
            assert abs(r["explained"] - share[c]) < 1e-12
            assert r["identity_error"] < 1e-9


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(df.repartition(3), [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_awkward_rows(spark):
    """Null and empty vectors, null and non-finite entries, other lengths, and clashing columns take no part; repeated rows and null ids do."""
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=5).tolist()) for i in range(40)] + [(None, [0.5, 0.1, 0.2, 0.3, 0.9])]
    good += [good[3]]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [1.0, math.nan, 1.0, 1.0, 1.0]), (94, [1.0, -math.inf, 1.0, 1.0, 1.0]), (95, [1.0, 2.0])]
    rows = [(i, v, "x", 1, [2]) for i, v in good + bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, component int, x array<int>").repartition(4)
    check(df, good, 4)


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert W.whiten(df).collect() == []
    same = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(5)], "vec_id long, embedding array<float>")
    assert W.whiten(same).collect() == []


def test_fewer_dimensions_that_vary(spark):
    r = np.random.default_rng(2)
    rows = [(i, [a, 0.5, b, 0.25]) for i, (a, b) in enumerate(r.normal(size=(50, 2)).tolist())]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["component"] for x in got} == {1, 2} and all(x["identity_error"] < 1e-9 for x in got)


def test_large_entries_stay_exact(spark):
    """Products leave 53 and 63 bits; deviations are whole numbers all the same."""
    rows = [(i, [float(i % 7) * 2**40, float(i % 5) * 2**38 + i]) for i in range(35)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2).collect()
    far = plain([v for _, v in rows], 2)[0]
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, far[i]) for i in range(35)}
    assert max(r["identity_error"] for r in got) < 1e-6


def _spectrum(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "matrix",
    [
        _spectrum(np.arange(1.0, 31), 1), _spectrum(np.r_[np.full(5, 3.0), np.linspace(1, 2, 20)], 2), np.eye(6), np.diag([5.0, 0, 0, 3, 1]),
        _spectrum(np.r_[1 + 1e-12 * np.arange(4), np.linspace(0.1, 0.5, 12)], 3), _spectrum(10.0 ** -np.arange(0, 12.0), 4), np.zeros((3, 3)), np.array([[2.0]]),
    ],
)
def test_leading_pairs(matrix):
    """Repeated, close, tiny and zero eigenvalues; every value has the number that the count of larger ones gives it."""
    values, vectors = W.leading(matrix, 8)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    want = want[want > 256 * W.EPS * np.abs(matrix).sum(1).max()][:8]
    assert len(values) == len(want) and np.allclose(values, want, rtol=0, atol=1e-13 * max(1, want.max(initial=0)))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-12 * max(1, want.max(initial=0)))


def test_inertia_and_solutions():
    r = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        m = r.normal(size=(n, n))
        m = m + m.T
        m[np.diag_indices(n)] *= r.integers(0, 2, n)  # zero pivots need blocks of two
        f = W.Factor(m)
        assert f.positive() == (np.linalg.eigvalsh(m) > 0).sum()
        if n > 1:
            b = r.normal(size=n)
            assert np.allclose(m @ f.solve(b), b, atol=1e-8 * np.linalg.cond(m))
