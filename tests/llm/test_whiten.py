import math

import numpy as np
import pytest

from wardstat.llm import queries, whiten

SMALL = "/root/testdata/sf0.001"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "x", 3) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int").repartition(3)


def whole(v, dims):
    return [math.floor(256 * c) for c in v] + [0] * (dims - len(v))


def check(df, vectors, k, rtol=1e-9):
    """Against exact sums and numpy's SVD of the centred distinct rows."""
    dims = max(len(v) for v in vectors)
    x = [whole(v, dims) for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    _, sv, vt = np.linalg.svd(centred, full_matrices=False)
    e = sv * sv / n
    got = {}
    for r in df.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(got) == list(range(len(vectors)))
    for i, v in enumerate(x):
        assert sorted(got[i]) == list(range(1, k + 1))
        for j, r in got[i].items():
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums))
            assert r["explained"] == pytest.approx(e[j - 1] / e.sum(), rel=max(rtol, 1e-9))
            assert r["identity_error"] <= 1e-9
            want = float(np.dot([float(n * a - s) / n for a, s in zip(v, sums)], vt[j - 1])) / math.sqrt(e[j - 1])
            assert abs(r["whitened"]) == pytest.approx(abs(want), rel=1e-6, abs=1e-7)
    # one sign for all rows of a component
    for j in range(1, k + 1):
        sign = {np.sign(got[i][j]["whitened"]) * np.sign(np.dot([n * a - s for a, s in zip(v, sums)], vt[j - 1])) for i, v in enumerate(x) if abs(got[i][j]["whitened"]) > 1e-6}
        assert len(sign) == 1


def test_random_vectors_with_copies(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 7)) * [3, 2.5, 2, 1.5, 1, 0.5, 0.1]
    check(whiten.whitened(table(spark, v.tolist() + v[:30].tolist() * 3)), v.tolist() + v[:30].tolist() * 3, 4)


def test_constant_and_spanned_columns_and_short_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, size=(60, 3)).astype(float)
    v = np.hstack([v, np.full((60, 1), 7.0), v[:, :1] + v[:, 1:2], 2 * v[:, 2:] - v[:, :1]]).tolist()
    check(whiten.whitened(table(spark, v)), v, 3)  # rank 3
    few = [[1.0, 2.0, 3.0], [2.0], [], [5.0, 5.0]]
    check(whiten.whitened(table(spark, few)), few, 3)


def test_columns_of_scales_far_apart(spark):
    """The covariance matrix has condition 1e17 and more; variances stay accurate."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 5))
    mix = base @ rng.normal(size=(5, 5))
    v = (mix * [1e9, 1e6, 1e3, 1, 0.1]).tolist()
    out = whiten.whitened(table(spark, v), k=5).collect()
    x = np.array([whole(r, 5) for r in v], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = [[sum((n * a[i] - sums[i]) * (n * a[j] - sums[j]) for a in x) for j in range(5)] for i in range(5)]
    # the product of the variances is the determinant, which fractions give exactly
    from fractions import Fraction

    m, det = [[Fraction(c, n**3) for c in row] for row in exact], Fraction(1)
    for i in range(5):
        det *= m[i][i]
        for j in range(i + 1, 5):
            f = m[j][i] / m[i][i]
            m[j] = [a - f * b for a, b in zip(m[j], m[i])]
    trace = sum(Fraction(exact[i][i], n**3) for i in range(5))
    shares = {r["component"]: r["explained"] for r in out}
    assert math.prod(shares.values()) == pytest.approx(float(det / trace**5), rel=1e-6)
    assert max(r["identity_error"] for r in out) < 1e-6


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 2.0], None, [nan, 1.0], [1.0, None], [inf, 0.0], [3.0, -1.0], [-0.001, 4.0], [1.0, 2.0]]
    out = whiten.whitened(table(spark, v, ids=[0, 1, 2, 3, 4, 5, None, 0])).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in out) == [(False, 0, 1), (False, 0, 1), (False, 0, 2), (False, 0, 2), (False, 5, 1), (False, 5, 2), (True, 0, 1), (True, 0, 2)]
    assert {r["n"] for r in out} == {3}
    assert whiten.whitened(table(spark, [[1.0, 2.0]] * 3)).count() == 0  # no variance
    assert whiten.whitened(table(spark, [[]])).count() == 0
    assert whiten.whitened(table(spark, [[1.0], [2.0]]).where("false")).count() == 0


def test_deviation_beyond_a_long_and_just_within(spark):
    v = [[2.0**50, 0.0], [-(2.0**50), 1.0], [0.0, 0.0]]
    assert {r["deviation"] for r in whiten.whitened(table(spark, v)).collect()} == {None, 65536}
    centre = whiten.Centre(3, [0, 1])
    x = np.array([[1012333, 5], [1012333333, 7], [-(1 << 40), 3]])
    assert centre.squares(x) == [(3 * 1012333) ** 2 + 14**2, (3 * 1012333333) ** 2 + 400 if (3 * 1012333333) ** 2 + 400 < 2**63 else None, None]


def test_given_table(spark):
    df = queries.QUERIES["op11_embedding_whitening"](spark, SMALL)
    vectors = [r[0] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()]
    check(df, vectors, 4)
