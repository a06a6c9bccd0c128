"""Sinks and sources of the library, headers of files, generated formulas, and linear fits of odd groups."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError
from mensura.fit import odr
from mensura.fit import spark as fits
from mensura.functions import sheetlike as S
from mensura.functions import units
from mensura.operators import catalog, sheet, uncertainty
from mensura.sources import files


def test_headers_of_files(spark, tmp_path):
    """Each part has its header; a row that equals it is a row."""
    df = spark.createDataFrame([("a", "b"), ("x", "1"), ("a", "b")], "a string, b string").repartition(3)
    p = str(tmp_path / "h")
    files.write_text(df, p, header=True)
    parts = [f for f in os.listdir(p) if f.startswith("part-") and os.path.getsize(f"{p}/{f}")]
    assert all(open(f"{p}/{f}", "rb").read().startswith(b"a,b\r\n") for f in parts)
    back = files.read_csv(spark, p, header=True)
    assert back.columns == ["a", "b"] and sorted(tuple(r) for r in back.collect()) == [("a", "b"), ("a", "b"), ("x", "1")]
    files.write_text(df.where("false"), p, header=True)
    assert files.read_csv(spark, p).collect()[0].c0 == "a"
    (tmp_path / "s.csv").write_bytes(b"junk\n\nk,v\n1,2\nk,v\n")
    got = files.read_csv(spark, str(tmp_path / "s.csv"), skip_rows=1, header=True)
    assert got.columns == ["k", "v"] and [tuple(r) for r in got.collect()] == [("1", "2"), ("k", "v")]
    assert files.read_text(spark, str(tmp_path / "s.csv")).first().text.startswith("junk")


def test_large_snapshots_are_errors(spark, tmp_path, monkeypatch):
    files.write_snapshot({"sheets": {}}, str(tmp_path / "a.snap"))
    monkeypatch.setattr(files, "LARGEST", 10)
    with pytest.raises(Exception, match="larger than 100 MB"):
        files.snapshot_cells(spark, str(tmp_path / "a.snap")).collect()


def test_library_export_and_import(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, "1.5"), (1, 0, "x"), (2, 0, "2"), (0, 1, "0.1"), (2, 1, "0.2"), (1, 1, None)], "row int, col int, value string")
    one = sheet.to_library(cells, "mass, a", "A1:A3", "B1:B3", "kg", 'the "first"', "p, q,", id_="1")
    two = sheet.to_library(cells, "b", "A1:A1", id_="2")
    both = one.unionByName(two)
    r = one.first()
    assert (r.data, r.uncertainties, r.tags, r.source) == ([1.5, 2.0], [0.1, 0.2], ["p", "q"], "sheet")
    with pytest.raises(Exception, match="differ in number"):
        sheet.to_library(cells, "c", "A1:A3", "B1:B1").collect()
    p = str(tmp_path / "lib")
    files.export_sequences(both, ["2", "9", "1"], p)
    lines = "".join(open(f"{p}/{f}").read() for f in sorted(os.listdir(p)) if f.startswith("part-")).splitlines()
    assert lines == ["[b,,,],[mass; a,kg,the 'first',p|q],[mass; a_uncertainty,kg,Uncertainty values for mass; a,p|q]", "1.5,1.5,0.1", ",2.0,0.2"]
    with pytest.raises(DataError):
        files.export_sequences(both, ["9"], p)
    assert both.columns == [c.split()[0] for c in catalog.SCHEMA.split(", ")]


def test_generated_formulas():
    out = uncertainty.generate("x*y", 2, {"x": ("A1", "B1"), "y": ("C1", None)})
    assert out["success"] and len(out["value_formulas"]) == len(out["sigma_formulas"]) == 2
    refs = lambda t: set(sheet.references(t))
    assert refs(out["value_formulas"][1]) == {"A2", "C2"} and refs(out["sigma_formulas"][1]) <= {"A2", "B2", "C2"} and "B2" in refs(out["sigma_formulas"][1])
    bad = uncertainty.generate("x*", 2, {"x": ("A1", "B1")})
    assert not bad["success"] and bad["error"] and bad["value_formulas"] == []
    assert not uncertainty.generate("a", 1, {"a": ("A1", None), "A": ("B1", None)})["success"]


def test_more_sheet_functions(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, 7.0), (4, 7.0)], "k int, x double")
    x, k = F.col("x"), F.col("k")
    assert df.agg(S.numbered_aggregate(9, x)).first()[0] == 19.0 and df.agg(S.database("DGET", x, k == 3)).first()[0] == 7.0
    with pytest.raises(Exception, match="several rows"):
        df.agg(S.database("DGET", x, k >= 3)).collect()
    for f in (lambda: S.subtotal(99, x), lambda: S.numbered_aggregate(99, x), lambda: S.database("DNOPE", x, k == 1)):
        with pytest.raises(FormulaError):
            f()
    assert S.index(df, ["k"], 3, 1).first().value == 3 and {r.position for r in S.match(df, df, "k", "k", ["k"]).collect()} == {1, 2, 3, 4}
    cells = sheet.to_cells(spark.createDataFrame([("h", "g"), ("1", "2")], "a string, b string"), ["b"], ["a", "b"])
    assert S.hlookup(cells.withColumn("row", 1 - F.col("row")), "g", 2).first().value == "2"
    one = spark.range(1)
    assert one.select(S.scalar("IFS", F.lit(False), 1, F.lit(True), 2)).first()[0] == 2 and one.select(S.scalar("SWITCH", 3, 1, "a", 3, "c", "z")).first()[0] == "c"
    assert one.select(S.scalar("TEXTAFTER", "ab-cd", "-")).first()[0] == "cd"


def test_linear_groups_equal_the_general_solver(spark):
    """Groups of one row, with nulls, negative uncertainties and no rank, against the solver for any model."""
    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(2 * x - 1 + rng.normal()), float(rng.uniform(0.1, 1))) for g in (0, 1) for x in range(12)]
    rows += [(2, 1.0, 1.0, 0.1), (3, 1.0, None, 0.1), (3, 2.0, 1.0, 0.1), (4, 1.0, 1.0, -0.1), (4, 2.0, 2.0, 0.1), (5, 3.0, 1.0, 0.1), (5, 3.0, 2.0, 0.1), (5, 3.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double, s double")
    spec = odr.FitSpec.single("a*x^2 + b*x + k", "y", ["x"], ["a", "b"], sigmas={"y": "s"}, fixed={"k": -1.0}, guesses=(0.5, 1.0))
    assert fits.linear(spec) and not fits.linear(odr.FitSpec.single("a*exp(b*x)", "y", ["x"], ["a", "b"]))
    one = {r.g: r for r in fits.fit_grouped(df, ["g"], spec).collect()}
    two = {r.g: r for r in fits.fit_groups(df, ["g"], spec).collect()}
    assert one.keys() == two.keys() == set(range(6))
    for g in one:
        assert (one[g].success, one[g].n, one[g].error, one[g].rank) == (two[g].success, two[g].n, two[g].error, two[g].rank), g
        if g in (0, 1):
            for c in ("parameters", "sigmas", "sigmas_raw", "expanded", "chi2", "chi2_obs", "rmse", "r_squared", "effective_dof", "coverage_factor"):
                assert one[g][c] == pytest.approx(two[g][c], rel=1e-7), c
            assert np.allclose(one[g].covariance, two[g].covariance, rtol=1e-6)
    assert one[5].rank == 1 and one[5].sigmas == [float("inf")] * 2


def test_unit_rows():
    assert len(units.registry()) == 220 and len({u[0] for u in units.UNITS}) == len(units.UNITS)
    assert units.registry()["kB"].factor == 8000 and units.registry()["GeV"].dimension == units.registry()["J"].dimension
