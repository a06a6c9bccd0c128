"""Matrix and regression functions against numpy."""

import numpy as np
import pytest

from mensura.functions import matrix


def _cells(spark, m, skip=()):
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if (i, j) not in skip], "row long, col long, value double").repartition(3)


def test_product(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(13, 22)), rng.normal(size=(22, 9))
    a[2, 5] = 0
    got = np.zeros((13, 9))
    rows = matrix.mmult(_cells(spark, a, {(2, 5)}), _cells(spark, b), size=4).collect()
    for r in rows:
        got[r.row, r.col] += r.value
    assert len(rows) == 13 * 9 and np.allclose(got, a @ b)
    assert matrix.mmult(_cells(spark, a).limit(0), _cells(spark, b)).count() == 0


def test_regressions(spark):
    rng = np.random.default_rng(3)
    x1, x2 = rng.uniform(1, 5, 60), rng.uniform(-1, 1, 60)
    y = 3 + 2 * x1 - 4 * x2 + rng.normal(0, 0.1, 60)
    key = [None if i % 2 else "k" for i in range(60)]
    df = spark.createDataFrame(list(zip(key, x1.tolist(), x2.tolist(), y.tolist(), np.exp(y / 4).tolist())), "k string, x1 double, x2 double, y double, e double")
    got = {r.k: r for r in matrix.linest(df, "y", ["x1", "x2"], ["k"]).collect()}
    new = {r.k: r.trend for r in matrix.trend(df, spark.createDataFrame([(None, 2.0, 0.5), ("k", 2.0, 0.5), ("other", 1.0, 1.0)], "k string, x1 double, x2 double"), "y", ["x1", "x2"], ["k"]).collect()}
    for k, at in (("k", slice(0, None, 2)), (None, slice(1, None, 2))):
        m = np.stack([np.ones(30), x1[at], x2[at]], 1)
        c, (res,), *_ = np.linalg.lstsq(m, y[at], rcond=None)
        se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * res / 27)
        r = got[k]
        assert np.allclose(r.coefficients, c) and np.allclose(r.errors, se) and np.allclose([r.ss_res, r.se_y, r.dof], [res, np.sqrt(res / 27), 27])
        total = ((y[at] - y[at].mean()) ** 2).sum()
        assert np.allclose([r.r2, r.ss_reg, r.f], [1 - res / total, total - res, (total - res) / 2 / (res / 27)]) and np.isclose(new[k], c @ [1, 2.0, 0.5])
    assert new["other"] is None
    whole = matrix.linest(df, "y", ["x1", "x2"], constant=False).first()
    c, (res,), *_ = np.linalg.lstsq(np.stack([x1, x2], 1), y, rcond=None)
    assert np.allclose(whole.coefficients, c) and np.allclose([whole.ss_res, whole.r2], [res, 1 - res / (y**2).sum()])
    log = matrix.logest(df, "e", ["x1", "x2"]).first()
    c = np.linalg.lstsq(np.stack([np.ones(60), x1, x2], 1), y / 4, rcond=None)[0]
    grown = matrix.growth(df, df.limit(1), "e", ["x1", "x2"]).first()
    assert np.allclose(log.coefficients, np.exp(c)) and np.isclose(grown.growth, np.exp(c @ [1, grown.x1, grown.x2]))


def test_frequency_and_trimmed_mean(spark):
    rng = np.random.default_rng(4)
    v = np.r_[rng.integers(0, 20, 300), [5.0] * 200].astype(float)
    df = spark.createDataFrame([(float(x), "h" if i % 3 else None) for i, x in enumerate(v)] + [(None, "h")], "v double, k string").repartition(5)
    bounds = [5.0, 3.0, 11.0, 5.0, None]
    got = {r.bound: r.n for r in matrix.frequency(df, "v", spark.createDataFrame([(b,) for b in bounds], "b double"), "b").collect()}
    assert got == {3.0: (v <= 3).sum(), 5.0: ((v > 3) & (v <= 5)).sum(), 11.0: ((v > 5) & (v <= 11)).sum(), None: (v > 11).sum()}
    for f in (0.0, 0.3, 0.99):
        for r in matrix.trimmean(df, "v", ["k"], f).collect():
            own = np.sort(v[[i % 3 > 0 if r.k else i % 3 == 0 for i in range(len(v))]])
            cut = int(len(own) * f / 2)
            assert np.isclose(r.trimmean, own[cut : len(own) - cut].mean())
    with pytest.raises(Exception, match="fraction"):
        matrix.trimmean(df, "v", ["k"], 1.0)


def test_determinant_and_inverse(spark):
    """Matrices of several sizes at once: a hot one, one that needs row swaps, a singular one, a null key, numbers apart by size."""
    from mensura.functions import elimination

    rng = np.random.default_rng(5)
    swap = np.roll(np.eye(9), 1, 0) * 2 + np.triu(rng.normal(size=(9, 9)), 4) * 0.1
    singular = rng.normal(size=(4, 4))
    singular[2] = 0
    given = {"hot": rng.normal(size=(21, 21)), "swap": swap, "zero": singular, None: np.array([[4.0]]), "tiny": rng.normal(size=(5, 5)) * np.array([1e-6, 1, 1e6, 1, 1])[:, None]}
    rows = [(k, int(i), int(j), float(v)) for k, m in given.items() for (i, j), v in np.ndenumerate(m) if v]
    rows.append(("zero", 2, 3, None))
    cells = spark.createDataFrame(rows, "k string, row long, col long, value double").repartition(3)
    dets = {r.k: r.determinant for r in elimination.mdeterm(cells, ["k"], 4).collect()}
    assert dets.keys() == given.keys() and dets["zero"] == 0
    for k, m in given.items():
        assert np.isclose(dets[k], np.linalg.det(m), rtol=1e-9, atol=0 if k != "zero" else 1e-12), k
    inv = {k: np.full(m.shape, np.nan) for k, m in given.items()}
    for r in elimination.minverse(cells, ["k"], 4).collect():
        inv[r.k][r.row, r.col] = r.value
    assert np.isnan(inv.pop("zero")).all() and all(np.allclose(v @ given[k], np.eye(len(v)), atol=1e-8) for k, v in inv.items())
    one = cells.where("k = 'hot'").drop("k")
    assert np.isclose(elimination.mdeterm(one).first().determinant, np.linalg.det(given["hot"])) and elimination.minverse(one).count() == 441
    none = cells.limit(0)
    assert elimination.mdeterm(none, ["k"]).count() == 0 and elimination.minverse(none, ["k"]).count() == 0
