import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError
from mensura.fit import grid, odr
from mensura.fit import spark as fits


def run(formula, dep, ind, par, data, sig, **kw):
    cols, sigmas = dict(data), {}
    for v, s in sig.items():
        cols["s_" + v] = np.full(len(data[v]), float(s))
        sigmas[v] = "s_" + v
    return odr.fit(odr.FitSpec.single(formula, dep, ind, par, sigmas=sigmas, **kw), cols)


X50 = np.arange(50.0)


def test_linear_and_negative_covariance():
    r = run("a*x + b", "y", ["x"], ["a", "b"], {"x": X50, "y": 2.5 * X50 - 4}, {"x": 0.1, "y": 0.2}, guesses=(1, 0))
    assert r["success"] and np.allclose(r["parameters"], [2.5, -4], atol=1e-6)
    assert r["covariance_raw"][0][1] < 0 and any("descriptive" in a for a in r["assumptions"])
    assert r["coverage_factor"] > 1 and r["expanded"][0] >= 0.99 * r["coverage_factor"] * r["sigmas"][0]


def test_names_ignore_case():
    x = np.arange(20.0)
    r = run("A*X + B", "Y", ["x"], ["A", "B"], {"x": x, "Y": 3 * x + 1.5}, {"x": 0.1, "Y": 0.1}, guesses=(0, 0))
    assert np.allclose(r["parameters"], [3, 1.5], atol=1e-4)


def test_scaling():
    t = np.arange(303.0, 308)
    r = run("k*t^4 + a", "y", ["t"], ["k", "a"], {"t": t, "y": 1e-9 * t**4 - 7}, {"t": 0.01, "y": 0.01}, guesses=(0, -1))
    assert r["success"] and r["iterations"] > 1 and r["chi2"] < 1e-9 and r["rank"] <= 2 and not math.isnan(r["condition"])


def test_correlated():
    i = np.arange(40)
    d = {"x1": 0.25 * i, "x2": np.sin(0.2 * i)}
    d["y"] = 1.2 * d["x1"] - 0.8 * d["x2"] + 3
    rho = np.eye(3)
    rho[0, 1] = rho[1, 0] = 0.35
    r = run("p*x1 + q*x2 + r", "y", ["x1", "x2"], ["p", "q", "r"], d, {"x1": 0.05, "x2": 0.04, "y": 0.08}, guesses=(0, 0, 0), correlation=rho)
    assert np.allclose(r["parameters"], [1.2, -0.8, 3], atol=1e-6)
    x = 0.1 * np.arange(30)
    r = run("a*x+b", "y", ["x"], ["a", "b"], {"x": x, "y": 2 * x + 1}, {"x": 0.03, "y": 0.05}, guesses=(1, 0), correlation=[[1, 0.7], [0.7, 1]])
    assert np.allclose(r["parameters"], [2, 1], atol=1e-6) and math.isfinite(r["chi2"])


def test_three_variables():
    i = np.arange(35)
    d = {"x1": 0.3 * i, "x2": np.cos(0.17 * i), "x3": np.sin(0.11 * i)}
    d["y"] = 0.9 * d["x1"] - 1.1 * d["x2"] + 0.7 * d["x3"] + 4
    rho = np.array([[1, 0.2, -0.1, 0.15], [0.2, 1, 0.3, -0.2], [-0.1, 0.3, 1, 0.1], [0.15, -0.2, 0.1, 1]])
    r = run("p*x1 + q*x2 + r*x3 + s", "y", ["x1", "x2", "x3"], list("pqrs"), d, {"x1": 0.05, "x2": 0.04, "x3": 0.03, "y": 0.06}, guesses=(0, 0, 0, 0), correlation=rho)
    assert np.allclose(r["parameters"], [0.9, -1.1, 0.7, 4], atol=2e-6)


def test_gaussian_poisson_rank_clamp_layers():
    x = np.arange(-2, 2.01, 0.05)
    r = run("a*exp(-b*x^2)+c", "y", ["x"], ["a", "b", "c"], {"x": x, "y": 2 * np.exp(-0.7 * x**2) + 0.5}, {"x": 0.02, "y": 0.03}, guesses=(1, 0.2, 0))
    assert np.allclose(r["parameters"], [2, 0.7, 0.5], atol=1e-3)
    x = np.arange(10.0)
    r = run("a*x^2", "y", ["x"], ["a"], {"x": x, "y": x**2}, {}, guesses=(0.5,), poisson=True)
    assert abs(r["parameters"][0] - 1) < 1e-2 and any("Poisson" in w for w in r["warnings"])
    x = np.arange(25.0)
    r = run("a + b", "y", ["x"], ["a", "b"], {"x": x, "y": 0 * x + 3}, {"x": 0.1, "y": 0.1}, guesses=(1, 2))
    assert r["rank"] < 2 and all(s == math.inf for s in r["sigmas"]) and any("rank-deficient" in w for w in r["warnings"])
    r = run("m*x + c", "y", ["x"], ["m", "c"], {"x": x, "y": 6 - 1.5 * x}, {"x": 0, "y": 0}, guesses=(0, 0))
    assert r["success"] and any("clamped" in w for w in r["warnings"])
    t = np.arange(20.0)
    spec = odr.FitSpec((odr.Layer("a*t+b", "x1", ("t",)), odr.Layer("a*x1+c", "y", ("x1",))), ("a", "b", "c"), (1, 0, 0), sigmas={"t": "st", "x1": "s", "y": "s"})
    r = odr.fit(spec, {"t": t, "x1": 2 * t + 1, "y": 2 * (2 * t + 1) - 3, "st": 0 * t + 0.01, "s": 0 * t + 0.05})
    assert np.allclose(r["parameters"], [2, 1, -3], atol=1e-4) and len(r["r_squared_layers"]) == 2


def test_errors():
    d = {"x": X50, "y": X50}
    with pytest.raises(DataError, match="invalid shape"):
        run("a*x", "y", ["x"], ["a"], d, {}, correlation=[[1.0]])
    with pytest.raises(DataError, match="positive semidefinite"):
        i = np.eye(3) * 0.1 + 0.9
        i[0, 1] = i[1, 0] = -0.9
        np.fill_diagonal(i, 1)
        run("a*x1+b*x2", "y", ["x1", "x2"], ["a", "b"], {"x1": X50, "x2": X50**2, "y": X50}, {}, correlation=i)
    with pytest.raises(DataError):
        run("a*x", "y", ["x"], ["a"], {"x": np.array([1, np.nan]), "y": np.array([1.0, 2])}, {})
    with pytest.raises(FormulaError):
        run("a*x", "y", ["x"], ["x"], d, {})
    assert run("a*x + k", "y", ["x"], ["a"], {"x": X50, "y": 2 * X50 + 5}, {}, fixed={"k": 5.0})["parameters"][0] == pytest.approx(2)


def test_profiled_derivatives():
    rng = np.random.default_rng(0)
    x = np.linspace(0, 2, 30) + rng.normal(0, 0.05, 30)
    spec = odr.FitSpec.single("a*exp(b*x)", "y", ["x"], ["a", "b"], sigmas={"x": "sx", "y": "sy"})
    p = odr.prepare(spec, {"x": x, "y": 1.3 * np.exp(0.7 * x) + rng.normal(0, 0.1, 30), "sx": x * 0 + 0.05, "sy": x * 0 + 0.1})
    b, h = np.array([1.2, 0.75]), 1e-5
    s = odr.evaluate(spec, p, b)
    for j in range(2):
        e = np.eye(2)[j] * h
        up, down = odr.evaluate(spec, p, b + e), odr.evaluate(spec, p, b - e)
        assert s.gradient[j] == pytest.approx((up.chi2 - down.chi2) / (4 * h), rel=1e-5)
        assert np.allclose(s.hessian[j], (up.gradient - down.gradient) / (2 * h), rtol=1e-5)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_without_x_errors_it_is_weighted_least_squares(seed):
    rng = np.random.default_rng(seed)
    x, s = rng.uniform(-5, 5, 30), rng.uniform(0.2, 0.8, 30)
    y = 2.5 * x - 1.3 + rng.normal(0, s)
    r = odr.fit(odr.FitSpec.single("a*x+b", "y", ["x"], ["a", "b"], sigmas={"y": "s"}, guesses=(0, 0)), {"x": x, "y": y, "s": s})
    A = np.c_[x, np.ones(30)] / s[:, None]
    assert np.allclose(r["parameters"], np.linalg.lstsq(A, y / s, rcond=None)[0], atol=1e-7)
    assert np.allclose(r["covariance_raw"], np.linalg.inv(A.T @ A), rtol=1e-6)


def test_effective_dof():
    assert odr.effective_dof(None, None, 1.0) is None and odr.effective_dof(5, None, 1.0) == 5 and odr.effective_dof(None, 7, 3) == 7
    assert odr.effective_dof(5, 7, 0.5) == 5 and odr.effective_dof(5, 7, 3.0) == pytest.approx(9 / (1 / 5 + 4 / 7))


def test_grouped_equals_single_and_large(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(x), float((g + 1) * x + 2 + rng.normal(0, 0.1)), 0.05, 0.1) for g in range(3) for x in np.linspace(0, 5, 20)]
    df = spark.createDataFrame([*rows, (9, 1.0, 1.0, 0.1, 0.1)], "g int, x double, y double, sx double, sy double")
    spec = odr.FitSpec.single("a*x+b", "y", ["x"], ["a", "b"], sigmas={"x": "sx", "y": "sy"}, guesses=(1, 0))
    got = {r.g: r for r in fits.fit_grouped(df, ["g"], spec).collect()}
    assert got[9].success is False and "2 points" in got[9].error
    one = np.array([r[1:] for r in rows if r[0] == 1]).T
    want = odr.fit(spec, dict(zip(("x", "y", "sx", "sy"), one)))
    assert np.allclose(got[1].parameters, want["parameters"]) and np.allclose(got[1].sigmas, want["sigmas"])
    for parts in (1, 5):
        large = fits.fit_large(df.where("g = 1").repartition(parts), spec)
        assert np.allclose(large["parameters"], want["parameters"], atol=1e-8) and large["r_squared"] == pytest.approx(want["r_squared"])


def test_closed_forms(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 9, 40)
    y = 1.5 * x + 2 + rng.normal(0, 0.3, 40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r, want = fits.fit_line(df, "x", "y").first(), np.polyfit(x, y, 1)
    assert np.allclose([r.slope, r.intercept], want)
    cov = np.polyfit(x, y, 1, cov=True)[1]
    assert r.slope_sigma == pytest.approx(math.sqrt(cov[0][0])) and r.intercept_sigma == pytest.approx(math.sqrt(cov[1][1]))


def test_grids(spark):
    pts = grid.curve(spark, "x^2", "x", 0, 1, resolution=11).orderBy("i").collect()
    assert len(pts) == 11 and pts[-1].x == 1.0 and pts[5].y == pytest.approx(0.25)
    assert grid.surface(spark, "u+v", ("u", "v"), (0, 1), (0, 1), resolution=5).count() == 25
    for n in (1, 2001):
        with pytest.raises(DataError, match="resolution too high"):
            grid.curve(spark, "x", "x", 0, 1, resolution=n)
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0)], "x double, y double")
    assert grid.quick_plot(df, "x", "y").count() == 1 and grid.padded_range(df.where("y = 2"), "y")[0] < 2
    assert df.select(F.lit(1)).count() == 3
