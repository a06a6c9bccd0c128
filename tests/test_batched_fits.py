"""Grouped fits advanced together equal the solver, group by group; null keys are groups everywhere."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.fit import odr
from mensura.fit import spark as fits

SPECS = {
    "line": odr.FitSpec.single("a*x + b", "w", ["x"], ["a", "b"], sigmas={"x": "sx", "w": "sy"}, guesses=(1.0, 0.0)),
    "curve": odr.FitSpec.single("a*exp(-b*x^2) + c", "y", ["x"], ["a", "b", "c"], sigmas={"x": "sx", "y": "sy"}, guesses=(1.0, 0.2, 0.0)),
    "correlated": odr.FitSpec.single("a*x + b", "w", ["x"], ["a", "b"], sigmas={"x": "sx", "w": "sy"}, guesses=(1.0, 0.0), correlation=[[1, 0.4], [0.4, 1]], type_a={"w": None}),
    "two": odr.FitSpec((odr.Layer("a*x + b", "w", ("x",)), odr.Layer("a*x + c", "z", ("x",))), ("a", "b", "c"), sigmas={"x": "sx", "w": "sy", "z": "sy"}, guesses=(1.0, 0.0, 0.0)),
    "counts": odr.FitSpec.single("a + b*x", "n", ["x"], ["a", "b"], guesses=(1.0, 1.0), poisson=True),
    "flat": odr.FitSpec.single("a + b", "y", ["x"], ["a", "b"], sigmas={"y": "sy"}, guesses=(1.0, 2.0)),
}


def _array(v):
    """Nested lists as numbers; a null is NaN or infinite in the table's form."""
    return np.array([_array(x) for x in v], float) if isinstance(v, list) else np.float64("nan") if v is None else v


def _points(groups=4, rows=40):
    rng, out = np.random.default_rng(5), []
    for k in range(groups):
        x = rng.uniform(-2, 2, rows)
        y = (1 + k) * np.exp(-(0.3 + 0.05 * k) * x**2) + 0.5 + rng.normal(0, 0.02, rows)
        out.append(pd.DataFrame({"k": float(k) if k else np.nan, "j": f"g{k % 2}" if k != 3 else None, "x": x, "y": y, "w": 1.5 * x + k + rng.normal(0, 0.02, rows), "z": 1.5 * x + rng.normal(0, 0.02, rows), "sx": 0.02, "sy": 0.02 + 0.01 * k, "n": rng.poisson(30 + k + 5 * (x + 2)).astype(float)}))
    return pd.concat(out)


@pytest.mark.parametrize("name", sorted(SPECS))
def test_batched_equals_the_solver(spark, name):
    spec, data = SPECS[name], _points()
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "k double, j string, x double, y double, w double, z double, sx double, sy double, n double").repartition(5)
    got = {(r.k, r.j): r for r in fits.fit_batched(df, ["k", "j"], spec).collect()}
    assert len(got) == 4
    for (k, j), part in data.groupby(["k", "j"], dropna=False):
        want, r = odr.fit(spec, part), got[None if pd.isna(k) else k, None if pd.isna(j) else j]
        assert r.success == want["success"] and abs(r.iterations - want["iterations"]) <= 2 and r.error is None and r.n == 40  # sums differ in their last digits
        if name == "flat":  # only the sum of its parameters is settled
            assert np.allclose([sum(r.parameters), r.chi2], [sum(want["parameters"]), want["chi2"]], rtol=1e-8) and r.rank == want["rank"] == 1
            continue
        for c in ("parameters", "sigmas", "sigmas_raw", "expanded", "chi2", "chi2_obs", "rmse", "r_squared", "effective_dof", "coverage_factor"):
            assert np.allclose(_array(r[c]), _array(want[c]), rtol=1e-8, atol=1e-8, equal_nan=True), (c, r[c], want[c])
        assert np.allclose(_array(r["correlation"]), _array(want["correlation"]), rtol=1e-7, atol=1e-8, equal_nan=True) and r.warnings == want["warnings"]


def test_batched_errors_and_empty(spark):
    rows = [(1, 1.0, None), (1, 2.0, 3.0), (2, 1.0, 1.0), (3, -1.0, 1.0), (3, 2.0, 2.0), (4, 1.0, 1.0), (4, 2.0, 2.0), (4, 3.0, 3.1)]
    df = spark.createDataFrame(rows, "k int, x double, y double").withColumn("s", F.lit(0.1))
    spec = odr.FitSpec.single("a*sqrt(x)", "y", ["x"], ["a"], sigmas={"y": "s"}, guesses=(1.0,))
    got = {r.k: r for r in fits.fit_batched(df, ["k"], spec).collect()}
    assert got[1].error == "y holds nulls or non-finite values" and got[2].error == "a fit needs at least 2 points"
    assert got[3].error == "the model is not finite at some point" and got[4].success and not got[4].error
    assert fits.fit_batched(df.limit(0), ["k"], spec).count() == 0


def test_large_groups_go_together(spark):
    """Groups above the bound and below it in one table, null keys among both, each fitted once."""
    data = _points(4, 60)
    extra = data[data["k"].isna()].sample(200, replace=True, random_state=1)
    data = pd.concat([data, extra, extra.assign(k=9.0)])
    df = spark.createDataFrame(data[["k", "x", "w", "sx", "sy"]].astype(object).where(data[["k", "x", "w", "sx", "sy"]].notna(), None), "k double, x double, w double, sx double, sy double")
    got = {r.k: r for r in fits.fit_groups(df, ["k"], SPECS["line"], rows=100).collect()}
    assert set(got) == {None, 1.0, 2.0, 3.0, 9.0} and got[None].n == 260
    for k, part in data.groupby("k", dropna=False):
        assert np.allclose(got[None if pd.isna(k) else k].parameters, odr.fit(SPECS["line"], part)["parameters"], rtol=1e-8)


def test_linear_groups_with_null_keys(spark):
    rows = [(k, float(x), 2.0 * x + (k or 5)) for k in (1, None, 3) for x in range(6)]
    df = spark.createDataFrame(rows, "k int, x double, y double").withColumn("s", F.lit(0.1))
    spec = odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"y": "s"}, guesses=(1.0, 0.0))
    got = {r.k: r for r in fits.fit_linear_groups(df, ["k"], spec).collect()}
    assert {k: np.round(r.parameters, 9).tolist() for k, r in got.items()} == {1: [2.0, 1.0], None: [2.0, 5.0], 3: [2.0, 3.0]}
    assert all(r.success and r.chi2 < 1e-12 and r.n == 6 for r in got.values())


@pytest.mark.parametrize("name", ["line", "correlated", "two", "flat"])
@pytest.mark.parametrize("rows", [50_000, 3], ids=["alone", "rounds"])
def test_condensed_points_have_the_sums_of_all(spark, name, rows):
    """Weighted points in place of all give what the solver does, in one task or round by round; few uncertainties recur."""
    data = pd.concat([_points(), _points(3, 60).assign(sy=lambda d: np.where(np.arange(len(d)) % 2, 0.05, 0.03))])
    assert fits.condensable(SPECS[name])
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "k double, j string, x double, y double, w double, z double, sx double, sy double, n double").repartition(5)
    got = {(r.k, r.j): r for r in fits.fit_batched(df, ["k", "j"], SPECS[name], rows=rows).collect()}
    for (k, j), part in data.groupby(["k", "j"], dropna=False):
        want, r = odr.fit(SPECS[name], part), got[None if pd.isna(k) else k, None if pd.isna(j) else j]
        assert (r.success, r.error, r.n, r.rank) == (want["success"], None, len(part), want["rank"]) and (name == "flat" or r.warnings == want["warnings"])
        for c in ("chi2", "chi2_obs", "rmse", "r_squared", *(() if name == "flat" else ("parameters", "sigmas", "sigmas_raw"))):
            assert np.allclose(_array(r[c]), _array(want[c]), rtol=1e-8, atol=1e-8, equal_nan=True), (c, r[c], want[c])


def test_what_is_condensed():
    line = dict(dependent="y", independents=["x", "v"], parameters=["a", "b"], sigmas={"x": "s", "y": "s"})
    assert all(fits.condensable(odr.FitSpec.single(f, **line)) for f in ("a*x + b", "(a^2*x - v)/exp(b) + 3", "a + b", "x*sin(a) + b*v"))
    assert not any(fits.condensable(odr.FitSpec.single(f, **line)) for f in ("a*x*v + b", "a*x^2", "a/x + b", "a*exp(b*v)", "a*sqrt(x)"))
    assert not fits.condensable(odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], sigmas={"y": "x"})) and not fits.condensable(odr.FitSpec.single("a*x + b", "y", ["x"], ["a", "b"], poisson=True))


RHO = ((1.0, 0.3, 0.1, 0.2), (0.3, 1.0, 0.25, -0.1), (0.1, 0.25, 1.0, 0.15), (0.2, -0.1, 0.15, 1.0))


def _plane(**kw):
    return odr.FitSpec.single("p*x1 + q*x2 + r*x3 + s", "y", ["x1", "x2", "x3"], list("pqrs"), sigmas=dict.fromkeys(("x1", "x2", "x3", "y"), "u"), correlation=RHO, **kw)


@pytest.mark.parametrize("start", [(-2.0, -1.0, -1.0, 0.0), (-2.0, 1.0, -1.0, 2.0), (0.0, 1.0, -1.0, 0.0), (3.0, -1.0, 1.0, 0.0)])
def test_a_fit_comes_back_from_a_valley_without_an_end(start):
    """From these places the plain steps lead to parameters that grow without bound."""
    i = np.arange(400.0)
    data = pd.DataFrame({"x1": i % 97 / 50, "x2": np.sin(i) * 2, "x3": np.cos(i * 0.7), "u": 0.05})
    data["y"] = 2 * data["x1"] - 3 * data["x2"] + 0.5 * data["x3"] + 1
    spec = _plane(guesses=start)
    out = odr.fit(spec, data)
    assert out["success"] and np.allclose(out["parameters"], [2, -3, 0.5, 1], atol=1e-6) and out["iterations"] < spec.max_iterations
    points, p = odr.prepare(spec, data), odr.begin(spec, np.array(start))
    while not p.guarded:
        p = odr.advance(spec, p, odr.evaluate(spec, points, p.at))
    again = odr.Progress.of(spec, p.numbers())
    assert again.guarded and again.at.tolist() == list(start) and again.phase == odr.FIRST and again.iteration == 100


def test_rounds_of_a_condensed_fit_are_no_jobs(spark):
    """However many rounds the fit takes, the table is read a fixed number of times."""
    i = F.col("id")
    rows = spark.range(0, 3000, 1, 4).select((i % 3).alias("k"), (i % 97 / 50).alias("x1"), (F.sin(i) * 2).alias("x2"), F.cos(i * 0.7).alias("x3"), F.lit(0.05).alias("u"))
    rows = rows.withColumn("y", F.expr("2 * x1 - 3 * x2 + 0.5 * x3 + 1"))
    jobs = []
    for guesses in ((2.0, -3.0, 0.5, 1.1), (0.0,) * 4):
        spark.sparkContext.setJobGroup(f"fit {guesses}", "")
        got = fits.fit_batched(rows, ["k"], _plane(guesses=guesses)).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {guesses}")))
        assert len(got) == 3 and all(r.success and r.n == 1000 and np.allclose(r.parameters, [2, -3, 0.5, 1]) for r in got)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
