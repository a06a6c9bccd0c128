"""Uncertainty, units and special functions against known values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError, UnitError
from mensura.functions import special as S
from mensura.functions import units as U
from mensura.operators import uncertainty as Q


def test_calculate():
    out = Q.calculate("x^2", [("x", 3, 0.1)])
    assert math.isclose(out["value"], 9) and math.isclose(out["sigma"], 0.6, rel_tol=1e-9)
    assert math.isclose(Q.calculate("a1+b1", [("a1", 5, 0.3), ("b1", 4, 0.2)])["sigma"], math.hypot(0.3, 0.2))
    assert math.isclose(Q.calculate("AlotA^2", [("AlotA", 3, 0.1)])["sigma"], 0.6)
    with pytest.raises(FormulaError):
        Q.calculate("a + A", [("a", 1, 0), ("A", 1, 0)])
    with pytest.raises(DataError):
        Q.calculate("1/x", [("x", 0, 1)])


def test_confidence():
    for p, z in ((95, 1.96), (68, 1.0), (99, 2.576)):
        assert abs(Q.z_of(p) - z) < 0.01
        assert abs(Q.percent_of(Q.z_of(p)) - p) < 1e-9
    assert Q.z_of(0) == 0 and Q.z_of(100) == math.inf
    for bad in (150, -10, math.nan):
        with pytest.raises(DataError):
            Q.z_of(bad)
    for bad in (0, -1, math.nan):
        with pytest.raises(DataError):
            Q.percent_of(bad)


def test_propagate_levels_and_nulls(spark):
    df = spark.createDataFrame([(2.0, 0.1), (None, 0.1), (0.0, 0.1)], "x double, s double")
    out = Q.propagate(df, "1/x", {"x": ("x", "s")}, in_confidence={"x": 95}, out_confidence=68).collect()
    assert math.isclose(out[0].sigma, 0.25 * 0.1 * Q.z_of(68) / Q.z_of(95))
    assert out[1].value is None and out[2].value is None
    assert Q.propagate(df, "x*2", {"x": ("x", None)}).first().sigma == 0.0
    assert Q.finite_report(df, ["x"]).first().x_null == 1


@pytest.mark.parametrize(
    "text,want",
    [
        ("5 ± 0.1", (5, 0.1, None, "absolute", None)), ("5 +- 2%", (5, 2, None, "relative", None)), ("5 +/- .2", (5, 0.2, None, "absolute", None)), ("5.00(12)", (5, 0.12, None, "absolute", None)), ("123(4)", (123, 4, None, "absolute", None)),
        ("5 +0.1/-0.2", (5, 0.1, 0.2, "absolute", "absolute")), ("5 -0.2/+0.1", (5, 0.1, 0.2, "absolute", "absolute")), ("5 +1% -2%", (5, 1, 2, "relative", "relative")), ("± 0.3", (7, 0.3, None, "absolute", None)), ("−5 ± 1", (-5, 1, None, "absolute", None)),
        ("hello", None), ("", None), ("5", None),
    ],
)
def test_parse_plus_minus(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(Q.parse_plus_minus(F.col("t"), F.lit(7.0)).alias("u")).first().u
    assert (r is None) if want is None else all(a == b or (isinstance(b, (int, float)) and math.isclose(a, b)) for a, b in zip(r, want)), r


def test_formats(spark):
    df = spark.createDataFrame([(1.23456, 0.0213, 0.02), (123.456, 3.4, 1.0), (5.0, 0.29, 0.1)], "v double, u double, l double")
    assert [r[0] for r in df.select(Q.format_uncertain(F.col("v"), F.col("u"))).collect()] == ["1.235 ± 0.021", "123 ± 3", "5.00 ± 0.29"]
    assert df.select(Q.edit_text(F.col("v"), F.col("u"), F.col("l"))).first()[0] == "1.23456 +0.0213/-0.02"
    assert df.select(Q.absolute(F.col("v"), F.lit(10.0), "relative")).first()[0] == pytest.approx(0.123456)


def test_autofill(spark):
    src = spark.createDataFrame([(0, 0.1), (1, 0.2)], "idx int, upper double")
    dst = spark.createDataFrame([(i, "=A1" if i == 3 else None) for i in range(5)], "idx int, formula string")
    assert [r.upper for r in Q.autofill(dst, src, columns=["upper"]).orderBy("idx").collect()] == [0.1, 0.2, 0.1, None, 0.1]


def test_units():
    assert len(U.registry()) == 220 and len(U.GROUPS) == 32
    assert U.convert_value(100, "°C", "°F")["value"] == pytest.approx(212)
    assert U.affine("km", "mi") == (0.621371, 0.0) and U.affine("km", "mi", exact=True)[0] == pytest.approx(1000 / 1609.34)
    assert U.parse_unit("(kg·m⁻²)/(s⁴·A⁻¹)").dimension == (1, -2, -4, 1, 0, 0, 0)
    assert U.parse_unit("m/s*kg").dimension == (-1, 1, -1, 0, 0, 0, 0)  # all after a slash divides
    assert U.parse_unit("dam").factor == 10 and U.parse_unit("Mm").factor == 1e6
    assert U.compatible("J", "kg*m^2/s^2") and not U.compatible("J", "W") and not U.valid("blah")
    assert U.format_value(1234567) == "1.234567e+06" and U.format_value(2.5) == "2.5" and U.format_value(0.00012) == "0.00012"
    with pytest.raises(UnitError):
        U.affine("m", "kg")


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(sorted(U.registry())), st.floats(-1e3, 1e3), st.data())
def test_unit_round_trip(a, v, data):
    same = [s for s, u in U.registry().items() if u.dimension == U.registry()[a].dimension]
    b = data.draw(st.sampled_from(same))
    k, o = U.affine(a, b, exact=True)
    k2, o2 = U.affine(b, a, exact=True)
    assert math.isclose((v * k + o) * k2 + o2, v, rel_tol=1e-9, abs_tol=1e-9)


def test_unit_columns(spark):
    df = spark.createDataFrame([(1.0, "m", "ft"), (1.0, "m", "kg"), (1.0, None, "m"), (2.0, "zz", "m")], "v double, a string, b string")
    assert [r.converted for r in U.convert_columns(df, "v", "a", "b").collect()].count(None) == 3
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1234567.0,), (2.5,), (0.00012,)], "v double").select(U.format_column(F.col("v"))).collect()]
    assert got == ["0", "1.234567e+06", "2.5", "0.00012"]


def test_special_values():
    assert S.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6) and S.student_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-6) and S.student_quantile(0.975, 1e12) == pytest.approx(1.959964, abs=1e-6)
    assert S.zeta(2.0) == pytest.approx(math.pi**2 / 6) and S.zeta(-1.0) == pytest.approx(-1 / 12) and math.isnan(S.zeta(1.0))
    assert S.zeta_deriv(1, 2.0) == pytest.approx(-0.9375482543158437) and S.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert S.polygamma(3, 1.0) == pytest.approx(math.pi**4 / 15) and S.tetragamma(1.0) == pytest.approx(-2 * 1.2020569031595942)
    assert S.besselj(0, 1.0) == pytest.approx(0.7651976865579666) and S.bessely(0, 1.0) == pytest.approx(0.08825696421567698) and S.besseli(1, 1.0) == pytest.approx(0.5651591039924851) and S.besselk(0, 1.0) == pytest.approx(0.42102443824070834)
    assert S.hermite(3, 2.0) == 40 and S.assoc_legendre(2, 1, 0.5) == pytest.approx(-1.299038105676658) and S.spherical_harmonic(0, 0, 1, 1) == pytest.approx(math.sqrt(1 / (4 * math.pi)))
    w = S.lambertw(np.array([-0.36, -0.1, 0.0, 1.0, 50.0]))
    assert np.allclose(w * np.exp(w), [-0.36, -0.1, 0, 1, 50]) and math.isnan(S.lambertw(-1.0))
    assert S.beta(2.5, 1.5) == pytest.approx(S.beta(1.5, 2.5)) and S.elliptic_k(0.0) == pytest.approx(math.pi / 2) and S.elliptic_e(1.0) == 1


def test_special_columns(spark):
    S.register_all(spark)
    r = spark.sql("SELECT gamma(5D) g, beta(2D, 3D) b, spherical_harmonic(2D, 0D, 0.3D, 0.1D) y, sinc(0D) s, asec(2D) a, erf(cast(null as double)) n").first()
    assert r.g == 24 and r.b == pytest.approx(1 / 12) and r.s == 1 and r.a == pytest.approx(math.acos(0.5)) and r.n is None
    k = spark.createDataFrame([(0.6,)], "k double").select(S.elliptic_native(F.col("k")).alias("k"), S.elliptic_native(F.col("k"), "e").alias("e"), S.lgamma_native(F.lit(4.5)).alias("l")).first()
    assert k.k == pytest.approx(float(S.elliptic_k(0.6))) and k.e == pytest.approx(float(S.elliptic_e(0.6))) and k.l == pytest.approx(math.lgamma(4.5))


def test_uncertain_text_of_tiny_bounds_and_its_plan(spark):
    """Bounds far below one keep their digits, and the text of three columns still compiles to generated code."""
    df = spark.createDataFrame([(1.0, 1e-17), (2.5, 4e-16)], "v double, u double")
    got = [r[0] for r in df.select(Q.format_uncertain(F.col("v"), F.col("u"))).collect()]
    assert got == ["1.000000000000000000 ± 0.000000000000000010", "2.5000000000000000 ± 0.0000000000000004"]
    v, u = F.col("id") + 1.5, F.col("id") * 0.01 + 0.03
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        both = spark.range(3).select(*(Q.format_uncertain(v, u * k, u).alias(f"t{k}") for k in (1, 2, 3))).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert both[0].t1 == "1.50 +0.03/-0.03" and len(both) == 3
