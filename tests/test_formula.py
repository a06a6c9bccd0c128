import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mensura.errors import FormulaError
from mensura.expr import formula as X

LEAVES = st.sampled_from(["x", "y", "2", "0.5", "3"])
EXPRS = st.recursive(
    LEAVES,
    lambda e: st.one_of(
        st.tuples(st.sampled_from("+-*"), e, e).map(lambda t: f"({t[1]} {t[0]} {t[2]})"),
        st.tuples(st.sampled_from(["sin", "cos", "exp", "tanh", "atan", "sinc", "erf", "asinh"]), e).map(lambda t: f"{t[0]}({t[1]} / 7)"),
        e.map(lambda t: f"({t})^2"),
        st.tuples(e, e).map(lambda t: f"({t[0]}) / (2 + ({t[1]})^2)"),
    ),
    max_leaves=6,
)


@settings(max_examples=150, deadline=None)
@given(EXPRS, st.floats(-1.5, 1.5), st.floats(-1.5, 1.5))
def test_print_parse_and_derivative(text, x, y):
    e = X.parse(text)
    at = {"x": x, "y": y}
    value = float(X.to_numpy(e, at))
    assert math.isclose(float(X.to_numpy(X.parse(X.to_text(e)), at)), value, rel_tol=1e-12, abs_tol=1e-12)
    h = 1e-5
    d = float(X.to_numpy(X.diff(e, "x"), at))
    n = (float(X.to_numpy(e, at | {"x": x + h})) - float(X.to_numpy(e, at | {"x": x - h}))) / (2 * h)
    third = abs(value) + abs(d) + 1
    assert abs(d - n) <= 1e-4 * third * max(1.0, abs(d))


@pytest.mark.parametrize("name", sorted(k for k, f in X.FUNCTIONS.items() if f.arity == 1 and f.slopes[0] and k not in ("floor", "ceil", "round", "signum")))
def test_function_derivatives(name):
    for x in (0.3, 0.7, 1.3, 2.2, 3.7):
        h = 1e-5
        f = lambda v: float(X.to_numpy(X.parse(f"{name}(x)"), {"x": v}))
        d = float(X.to_numpy(X.diff(X.parse(f"{name}(x)"), "x"), {"x": x}))
        n = (f(x + h) - f(x - h)) / (2 * h)
        if math.isfinite(n) and math.isfinite(d):
            assert math.isclose(d, n, rel_tol=1e-5, abs_tol=1e-6), (name, x)


def test_sinc_is_smooth_at_zero(spark):
    e = X.parse("sinc(x)")
    d, dd = X.diff(e, "x"), X.diff(X.diff(e, "x"), "x")
    for x in (0.0, 1e-5, 5e-4, 0.3):
        assert float(X.to_numpy(d, {"x": x})) == pytest.approx(-x / 3 + x**3 / 30, abs=1e-4 if x > 0.1 else 1e-9)
        r = spark.createDataFrame([(x,)], "x double").select(X.to_column(d, {"x": F.col("x")}), X.to_column(dd, {"x": F.col("x")})).first()
        assert r[0] == pytest.approx(float(X.to_numpy(d, {"x": x})), abs=1e-12) and r[1] == pytest.approx(float(X.to_numpy(dd, {"x": x})), abs=1e-9)
    assert float(X.to_numpy(dd, {"x": 0.0})) == pytest.approx(-1 / 3)


def test_grammar():
    at = {"x": 3.0}
    assert X.to_numpy(X.parse("-x^2"), at) == -9
    assert X.to_numpy(X.parse("2^3^2"), {}) == 512
    assert X.to_numpy(X.parse("X**2 - 1e1"), at) == -1
    assert X.symbols(X.parse("AlotA^2", ["alota"])) == {"alota"}
    assert X.parse("e", ["e"]) == X.Sym("e") and X.parse("e") == X.Num(math.e)
    assert X.split_equation("y = a*x\nz = 2") == ("y", "a*x")
    assert X.diff(X.parse("x^2"), "x") == X.parse("2*x")  # no logarithm for constant powers
    for bad in ("", "2x", "x +", "foo(x)", "sin(x, y)", "(x", "x ? y"):
        with pytest.raises(FormulaError):
            X.parse(bad, ["x", "y"])


def test_columns_agree_with_numpy(spark):
    names = [k for k, f in X.FUNCTIONS.items() if f.arity == 1 and f.column]
    rows = spark.createDataFrame([(0.3,), (0.9,), (1.7,)], "x double")
    cols = [X.to_column(X.parse(f"{n}(x)"), {"x": F.col("x")}).cast("double").alias(n) for n in names]
    for r in rows.select("x", *cols).collect():
        for n in names:
            want = float(X.to_numpy(X.parse(f"{n}(x)"), {"x": r.x}))
            got = r[n]
            assert (got is None or math.isnan(got)) if math.isnan(want) else math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-14), n


def test_sql_and_latex(spark):
    e = X.parse("sin(a)*b / 2")
    out = spark.createDataFrame([(1.0, 3.0)], "p double, q double").selectExpr(X.to_sql(e, {"a": "p", "b": "q"}) + " AS v").first().v
    assert math.isclose(out, math.sin(1) * 1.5)
    assert X.to_latex(X.parse("sqrt(sigma_x)")) == r"\sqrt{\sigma_{x}}"
    assert X.substitute(X.parse("a*x + c"), {"a": 2.0, "c": 0.0}) == X.parse("2*x")
    assert np.isclose(X.to_numpy(X.parse("uncert(x, 0.1)"), {"x": 4.0}), 4)
