import datetime
import math

import pytest
from pyspark.sql import functions as F

from mensura.errors import FormulaError
from mensura.fit import odr
from mensura.fit import spark as fits
from mensura.functions import sheetlike as S


@pytest.mark.parametrize(
    "name,args,want",
    [
        ("EVEN", (3.2,), 4), ("ODD", (-2.0,), -3), ("TRUNC", (-2.57, 1), -2.5), ("MOD", (-7, 3), 2), ("ROUNDUP", (-2.11, 1), -2.2), ("MROUND", (10, 3), 9), ("CEILING", (7, 4), 8), ("GCD", (54, 24), 6), ("LCM", (4, 6), 12),
        ("FACT", (5,), 120), ("COMBIN", (10.0, 3.0), 120), ("PERMUT", (5.0, 2.0), 20), ("BITXOR", (6, 3), 5), ("BITLSHIFT", (1, 4), 16), ("HEX2DEC", ("ff",), 255), ("DEC2OCT", (8,), "10"), ("BASE", (10, 2), "1010"), ("GAUSS", (1.0,), 0.3413447460685429),
        ("LEFT", ("abc", 2), "ab"), ("RIGHT", ("abc", 2), "bc"), ("MID", ("abcde", 2, 3), "bcd"), ("TRIM", ("  a   b ",), "a b"), ("REPT", ("ab", 2), "abab"), ("FIND", ("c", "abc"), 3), ("FIND", ("z", "abc"), None), ("REPLACE", ("abcdef", 2, 3, "X"), "aXef"),
        ("VALUE", ("x",), None), ("TEXTJOIN", ("-", "a", "b"), "a-b"), ("PROPER", ("hello wORLD",), "Hello World"), ("REGEXEXTRACT", ("ab12", "[0-9]+"), "12"), ("CHOOSE", (2, "a", "b"), "b"), ("XOR", (True, True), False), ("ISTEXT", ("a",), True), ("ISEMAIL", ("a@b.co",), True),
    ],
)
def test_scalars(spark, name, args, want):
    got = spark.range(1).select(S.scalar(name, *args)).first()[0]
    assert got == want or isinstance(want, (int, float)) and math.isclose(float(got), want, rel_tol=1e-9), got


def test_dates(spark):
    d = F.lit(datetime.date(2024, 1, 31))
    r = spark.range(1).select(S.scalar("EDATE", d, 1), S.scalar("EOMONTH", d, 1), S.scalar("NETWORKDAYS", d, F.lit(datetime.date(2024, 2, 5))), S.scalar("DAYS360", d, F.lit(datetime.date(2024, 3, 31)))).first()
    assert tuple(r) == (datetime.date(2024, 2, 29), datetime.date(2024, 2, 29), 4, 60)
    with pytest.raises(FormulaError):
        S.scalar("NOPE")
    with pytest.raises(FormulaError):
        S.aggregate("NOPE")


def test_every_aggregate_runs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (4.0, 9.0), (4.0, 7.0), (None, 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    for name, f in S.AGGREGATES.items():
        args = {"COUNTIF": (x > 1,), "PERCENTILE": (x, F.lit(0.5)), "QUARTILE": (x, F.lit(3))}.get(name) or ((x, y > 2) if name.endswith(("SUMIF", "AVERAGEIF", "IFS")) else (x, y) if name in ("CORREL", "PEARSON", "COVAR", "SLOPE", "INTERCEPT", "RSQ", "STEYX", "SUMPRODUCT", "SUMX2MY2", "SUMX2PY2", "SUMXMY2") else (x,))
        assert df.agg(f(*args)).first()[0] is not None, name
    assert [r.x for r in S.nth(df.withColumn("k", F.lit(1)), "x", ["k"], 2).collect()] == [4.0]


def test_lookup(spark):
    t = spark.createDataFrame([(1, "a"), (5, "b"), (5, "c"), (9, "d"), (None, "z")], "k int, v string")
    df = spark.createDataFrame([(i,) for i in (0, 1, 4, 5, 8, 100, None)], "x int").repartition(5)
    got = {r.x: r.looked_up for r in S.lookup(df, t, "x", "k", "v", approximate=True).collect()}
    assert got == {0: None, 1: "a", 4: "a", 5: "b", 8: "b", 100: "d", None: None}
    assert {r.x: r.looked_up for r in S.lookup(df, t, "x", "k", "v").collect()} == {0: None, 1: "a", 4: None, 5: "b", 8: None, 100: None, None: None}


def test_groups_of_any_size(spark):
    df = spark.range(300).select((F.when(F.col("id") < 200, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")))).alias("g"), F.col("id").cast("double").alias("x"))
    df = df.withColumn("y", 2 * F.col("x") + 1 + F.sin("x"))
    spec = odr.FitSpec.single("a*x+b", "y", ["x"], ["a", "b"], guesses=(1.0, 0.0))
    one = {r.g: r for r in fits.fit_grouped(df, ["g"], spec).collect()}
    two = {r.g: r for r in fits.fit_groups(df, ["g"], spec, rows=150).collect()}
    assert one.keys() == two.keys() == {"big", "s0", "s1"}
    for g in one:
        assert two[g].parameters == pytest.approx(one[g].parameters, abs=1e-9) and two[g].n == one[g].n and two[g].sigmas == pytest.approx(one[g].sigmas)
