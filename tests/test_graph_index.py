"""Cell graphs, the text index, exact quantiles and ranks against plain versions; sheet functions by their definitions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError
from mensura.functions import sheetlike
from mensura.operators import catalog, cellgraph, selection, sheet, textindex

CELLS = "cell string, value double, formula string, upper double, lower double, source string"


def test_cell_table_equals_the_dict(spark):
    rng, cells = np.random.default_rng(3), {}
    for i in range(1, 61):
        c = cells[f"A{i}"] = {"value": float(rng.uniform(1, 5))}
        if i % 3:
            c["upper"] = 0.1 * i
        if i % 4 == 0 and i % 3:
            c["lower"] = 0.05 * i
        cells[f"B{i}"] = {"value": 0.0, "formula": f"=A{i}^2 + $A$1*Z9", "upper": 7.0}
        cells[f"C{i}"] = {"value": 1.0, "formula": f"=sin(b{i}) + A{i} - B{max(1, i - 1)}"}
        cells[f"D{i}"] = {"value": float(i), "formula": "=C1", "source": "manual", "upper": 0.5}
        if i > 6:
            continue
        cells[f"E{i}"] = {"value": 0.0, "formula": f"=D{i}*2" if i == 1 else f"=E{i - 1} + D{i}"}
    cells["F1"] = {"value": 0.0, "formula": "=2+3", "upper": 1.0}
    rows = [(k, c.get("value"), c.get("formula"), c.get("upper"), c.get("lower"), c.get("source")) for k, c in cells.items()]
    got = {r.cell: r for r in cellgraph.propagate_table(spark.createDataFrame(rows, CELLS)).collect()}
    want = sheet.propagate_cells(cells)
    assert set(got) == set(want)
    for k, c in want.items():
        for f in ("value", "upper", "lower"):
            a, b = getattr(got[k], f), c.get(f)
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)), (k, f, a, b)
        assert got[k].source == c.get("source")


def test_cell_table_reports_cycles_and_errors(spark):
    make = lambda rows: spark.createDataFrame(rows, CELLS)
    with pytest.raises(FormulaError, match="2 cells depend on themselves, such as A1, B1"):
        cellgraph.propagate_table(make([("A1", 0.0, "=B1", None, None, None), ("B1", 0.0, "=A1", None, None, None), ("C1", 1.0, "=2", None, None, None)]))
    with pytest.raises(FormulaError, match="A1"):
        cellgraph.propagate_table(make([("A1", 0.0, "=(2", None, None, None)]))
    with pytest.raises(DataError):
        cellgraph.propagate_table(make([("A1", 0.0, None, None, None, None), ("a1", 0.0, None, None, None, None)]))
    assert cellgraph.propagate_table(make([])).count() == 0


def test_text_index_finds_what_the_scan_finds(spark, tmp_path):
    rows = [
        ("1", "Zug_probe", "Heiße Quelle, x2", ["alpha", "Wärme-9"], "lab"), ("2", "probe 100%", None, None, "Feld"), ("3", None, "unprobed  PROBENAHME", ["a"], None),
        ("4", "x", "", [], "quelle probe"), ("4", "x", "probe", [], "quelle"), ("5", "日本 データ", "测试 probe", ["日"], "lab"), ("6", "", "re-probe", None, "lab"),
    ]
    df = spark.createDataFrame(rows, "id string, name string, description string, tags array<string>, source string")
    path = str(tmp_path / "index")
    textindex.build(df, path)
    for q in ("probe", "pro", "quelle pro", "probe quelle", "wärme", "9", "x_", "デー", "zug_pr", "%", "alpha lab", "  "):
        want = sorted(r.id for r in catalog.search(df, q).collect())
        assert sorted(r.id for r in textindex.search_catalog(df, path, q).collect()) == want, q
    assert textindex.search_catalog(df, path, "probe", source="lab").count() == catalog.search(df, "probe", source="lab").count()
    plan = textindex.postings(spark, path, "pro")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,pro)" in plan and "LessThan(token,prp)" in plan
    assert textindex._after("a\U0010ffff") == "b" and textindex._after("퟿") == "" and textindex._after("\U0010ffff") is None


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {None: rng.normal(size=3000), "hot": np.r_[np.full(500, 2.5), rng.lognormal(0, 8, 700)], "ties": np.array([1.0] * 9 + [2.0]), "wide": np.array([-1.7e308, -1e-300, 0.0, 5e-324, 1e300, 1.7e308]), "one": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("none", None), ("nan", 1.0), ("nan", float("nan")), ("nan", 3.0)]
    ps = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r.k, r.p): r.quantile for r in selection.exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(6), "v", ["k"], ps, bins=16).collect()}
    assert len(got) == 7 * 5
    for k, vs in groups.items():
        s = np.sort(vs)
        for p in ps:
            at = p * (len(s) - 1)
            lo, hi = int(math.floor(at)), int(math.ceil(at))
            want = s[lo] if lo == hi else s[lo] + (s[hi] - s[lo]) * (at - lo)
            assert got[k, p] == want or math.isclose(got[k, p], want, rel_tol=1e-15), (k, p)
    assert all(got["none", p] is None for p in ps) and got["nan", 0.5] == 3.0 and math.isnan(got["nan", 1.0])
    assert selection.exact_quantiles(spark.createDataFrame([], "k string, v double"), "v", ["k"], [0.5]).count() == 0


def test_ranks_of_hot_and_null_groups(spark):
    from pyspark.sql import Window

    rows = [(k, float(v % 7) if v % 5 else None, v) for v in range(200) for k in (["a", None, "b"][v % 3],)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(5)
    for down in (True, False):
        order = F.col("v").desc() if down else F.col("v").asc()
        want = df.withColumns({"rank": F.rank().over(Window.partitionBy("k").orderBy(order)), "percent_rank": F.percent_rank().over(Window.partitionBy("k").orderBy(F.col("v").asc()))})
        got = selection.ranks(df, "v", ["k"], down)
        key = lambda r: (r.i, r["rank"], round(r.percent_rank, 12))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
        n = selection.nth(df, "v", ["k"], 4, down).collect()
        assert {r.k: r.v for r in n} == {k: sorted((x[1] for x in rows if x[0] == k and x[1] is not None), reverse=down)[3] for k in ("a", None, "b")}
    placed = catalog.positions(df, ["k"], ["i"]).collect()
    assert len(placed) == 200 and {(r.k, r.idx) for r in placed} == {(k, j) for k in ("a", None, "b") for j in range(sum(x[0] == k for x in rows))}
    dev = {r.k: r.avedev for r in sheetlike.average_deviation(df, "v", ["k"]).collect()}
    for k in ("a", None, "b"):
        v = np.array([x[1] for x in rows if x[0] == k and x[1] is not None])
        assert math.isclose(dev[k], np.abs(v - v.mean()).mean())


def test_sheet_functions_by_definition(spark):
    s, d = sheetlike.scalar, lambda t: F.lit(t).cast("date")
    one = spark.createDataFrame([(1.0, 0.0, "a.b")], "x double, zero double, t string")
    cases = {
        "div": (s("IFERROR", F.col("x") / F.col("zero"), 9), 9.0), "fine": (s("IFERROR", F.col("x") / 4, 9), 0.25), "cast": (s("IFERROR", F.col("t").cast("int"), -1), -1.0), "text": (s("IFERROR", F.col("t"), "no"), "a.b"), "worse": (s("IFERROR", F.col("t").cast("int"), "no"), "no"),
        "na": (s("IFNA", F.lit(None).cast("double"), 3.0), 3.0), "uni": (s("UNICHAR", 8364), "€"), "astral": (s("UNICHAR", 128512), "\U0001f600"), "latin": (s("UNICHAR", 65), "A"), "split": (s("TEXTSPLIT", F.col("t"), "."), ["a", "b"]), "t5": (s("T", 5), ""), "ta": (s("T", "ab"), "ab"),
        "d": (s("DATEDIF", d("2020-02-29"), d("2021-02-28"), "D"), 365), "m": (s("DATEDIF", d("2020-01-31"), d("2020-02-29"), "M"), 0), "y": (s("DATEDIF", d("2020-02-29"), d("2021-02-28"), "y"), 0), "md": (s("DATEDIF", d("2020-01-20"), d("2020-03-05"), "MD"), 14), "ym": (s("DATEDIF", d("2018-11-15"), d("2020-03-14"), "YM"), 3), "yd": (s("DATEDIF", d("2018-11-15"), d("2020-03-14"), "YD"), 120),
    }
    row = one.select(*(c.alias(k) for k, (c, _) in cases.items())).first()
    assert {k: row[k] for k in cases} == {k: v for k, (_, v) in cases.items()}
    for bad in (s("DATEDIF", d("2020-01-02"), d("2020-01-01"), "D"), s("DATEDIF", d("2020-01-01"), d("2020-01-02"), "Q")):
        with pytest.raises(Exception, match="DATEDIF"):
            one.select(bad).collect()
    days = spark.createDataFrame([(dt.date(2024, 3, 1) + dt.timedelta(k), n) for k in range(9) for n in range(-13, 14)], "a date, n int")
    for r in days.withColumn("w", s("WORKDAY", F.col("a"), F.col("n"))).collect():
        at, left = r.a, abs(r.n)
        while left:
            at += dt.timedelta(1 if r.n > 0 else -1)
            left -= at.weekday() < 5
        assert r.w == at, (r.a, r.n)
    mixed = spark.createDataFrame([("4",), ("true",), ("word",), (None,)], "v string").agg(*(sheetlike.aggregate(n, F.col("v")).alias(n) for n in ("AVERAGEA", "MAXA", "MINA", "VARPA"))).first()
    assert math.isclose(mixed["AVERAGEA"], 5 / 3) and (mixed["MAXA"], mixed["MINA"]) == (4.0, 0.0) and math.isclose(mixed["VARPA"], np.var([4, 1, 0]))
