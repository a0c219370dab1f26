"""Whitening against numpy's dense eigensolver and exact integers."""

import numpy as np
import pytest

from cropframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, component string, white string, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z", "i") for i, v in rows], SCHEMA)


def found(spark, rows, **kw):
    return whitening.whiten(table(spark, rows), **kw).collect()


def cut(v):
    return np.floor(1024 * np.float32(v).astype(np.float64)).astype(np.int64) + 100_000


def check(rows, got, components=8):
    """Every value of the result against dense numpy."""
    x = np.array([cut(v) for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(components, x.shape[1])
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    white = np.array([[by[i][j + 1]["whitened"] for j in range(k)] for i, _ in rows])
    for i, (key, _) in enumerate(rows):
        want = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s, strict=True))
        assert {int(r["deviation"]) for r in by[key].values()} == {want}
    assert np.allclose([by[rows[0][0]][j + 1]["explained"] for j in range(k)], values[:k] / v.trace(), rtol=1e-9)
    error = np.abs(np.cov(white.T, bias=True) - np.eye(k)).max()
    assert error < 1e-9 and {r["identity_error"] < 1e-9 for r in got} == {True}
    # the component behind a column is the solution of c @ p = white * sqrt(e): a unit eigenvector of v
    for j in range(k):
        p = np.linalg.lstsq(c, white[:, j] * np.sqrt(values[j]), rcond=None)[0]
        assert abs(np.linalg.norm(p) - 1) < 1e-9
        assert np.abs(v @ p - values[j] * p).max() < 1e-9 * values[0]


def test_against_dense_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.standard_normal((24, 24)) * np.linspace(1, 0.02, 24)
    rows = [(i, (rng.standard_normal(24) @ mix + 3).tolist()) for i in range(700)]
    check(rows, found(spark, rows))


def test_equal_eigenvalues_stay_orthogonal(spark):
    # +-e_i in 12 dimensions: all twelve eigenvalues are equal
    rows = [(2 * i + s, (np.eye(12)[i] * (1 - 2 * s)).tolist()) for i in range(12) for s in (0, 1)]
    check(rows, found(spark, rows))


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(50)]
    check(rows, found(spark, rows), 3)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(9).tolist()) for i in range(60)]
    bad = [(100, None), (101, [1.0, None] + [0.0] * 7), (102, [float("nan")] * 9), (103, [float("inf")] + [0.0] * 8), (104, [])]
    check(good, found(spark, good + bad))
    again = found(spark, good + [good[0], (None, good[1][1]), (None, good[2][1])])
    assert {r["n"] for r in again} == {63} and len(again) == 63 * 8
    assert sum(r["vec_id"] is None for r in again) == 16


def test_lengths_are_populations_of_their_own(spark):
    rng = np.random.default_rng(4)
    a = [(i, rng.standard_normal(9).tolist()) for i in range(40)]
    b = [(100 + i, rng.standard_normal(10).tolist()) for i in range(30)]
    got = found(spark, a + b)
    check(a, [r for r in got if r["vec_id"] < 100])
    check(b, [r for r in got if r["vec_id"] >= 100])


def test_no_variance_and_no_rows(spark):
    got = found(spark, [(1, [1.0] * 9), (2, [1.0] * 9)])
    assert len(got) == 16 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] == 0
                                  and r["deviation"] == 0 for r in got)
    got = found(spark, [(i, [float(i), 2.0 * i] + [0.5] * 8) for i in range(20)])  # one direction only
    assert {r["component"] for r in got if r["whitened"] is not None} == {1}
    assert all(r["identity_error"] < 1e-9 for r in got)
    empty = whitening.whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == whitening.whiten(table(spark, [(1, [1.0])])).columns


def test_entries_beyond_64_bits(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(9).tolist()) for i in range(20)] + [(50, [3e38, -3e38] + [0.0] * 7)]
    got = found(spark, rows)
    assert len(got) == 21 * 8
    assert {r["component"] for r in got if r["vec_id"] == 50} == set(range(1, 9))


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    base = np.linalg.qr(rng.standard_normal((n, n)))[0]
    for values in (np.arange(n, 0, -1.0) ** 3, np.ones(n), np.r_[np.ones(n - n // 2), np.full(n // 2, 1 - 1e-12)]):
        a = base * values @ base.T
        a = (a + a.T) / 2
        e, z = whitening.leading_eigen(a, min(n, 8))
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:8], rtol=1e-12, atol=1e-12 * values.max())
        assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-12
        assert np.abs(a @ z - z * e).max() < 1e-12 * values.max()
    diagonal = np.diag(np.arange(n, dtype=float))  # no off-diagonal at all
    e, z = whitening.leading_eigen(diagonal, 2)
    assert np.allclose(e, np.arange(n, dtype=float)[::-1][:2]) and np.abs(diagonal @ z - z * e).max() < 1e-12 * max(n, 1)


def test_query_over_the_whole_table(spark):
    import __spark_entry__ as entry

    got = entry.queries()["op11_whitening"](spark, "/root/testdata/sf0.001").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(rows, got)
