"""Catalog, sheets, files and streams."""

import datetime
import gzip
import os

import pytest
from pyspark.sql import functions as F

from mensura.errors import DataError, FormatError, FormulaError
from mensura.operators import catalog, sheet
from mensura.sources import files
from mensura.streaming import live

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def library(spark):
    rows = [
        ("1", "Mass of rod", "first", ["alpha", "b"], "kg", "lab", [1.0, 2.0, 3.0], [0.1, 0.1, 0.2], True, T0, T0),
        ("2", "length_50%", None, ["a"], "m", "field", [4.0, 1.0], None, False, T0, T0 + datetime.timedelta(1)),
        ("3", "empty", "nothing", [], "m", "lab", [], None, False, T0, T0 + datetime.timedelta(2)),
    ]
    return spark.createDataFrame(rows, catalog.SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search(library):
    assert ids(catalog.search(library, "mas ro")) == ["1"] and ids(catalog.search(library, "ass")) == ["1"]  # the second by LIKE
    assert ids(catalog.search(library, "fir lab")) == ["1"] and ids(catalog.search(library, "%")) == ["1", "2", "3"]
    assert ids(catalog.search(library, tags=["a"])) == ["2"] and ids(catalog.search(library, tags=["a"], substring_tags=True)) == ["1", "2"]
    assert ids(catalog.search(library, source="lab")) == ["1", "3"] and ids(catalog.search(library)) == ["1", "2", "3"]


def test_page(library):
    head, rows = catalog.page(library, "size", True, 9, 2)
    assert head == {"total": 3, "pinned": 1, "page": 1, "page_size": 2, "total_pages": 2, "has_next": False, "has_prev": True} and ids(rows) == ["3"]
    assert [r.id for r in catalog.page(library)[1].collect()] == ["1", "3", "2"]


def test_statistics(library, spark):
    s = {r.id: r for r in catalog.sequence_statistics(library).collect()}
    assert (s["1"]["count"], s["1"].mean, s["1"].median, s["1"].has_uncertainties) == (3, 2.0, 2.0, True) and s["1"].std_dev == pytest.approx((2 / 3) ** 0.5)
    assert (s["3"]["count"], s["3"].mean, s["3"].max) == (0, 0.0, 0.0)
    nan = spark.createDataFrame([("k", 1.0), ("k", float("nan"))], "id string, value double")
    r = catalog.statistics(nan).first()
    assert (r.min, r.max) == (1.0, 1.0) and r.mean != r.mean


def test_forms_and_changes(library, spark):
    wide = {r.id: r for r in catalog.to_wide(catalog.to_long(library)).collect()}
    assert wide["1"].data == [1.0, 2.0, 3.0] and wide["1"].uncertainties == [0.1, 0.1, 0.2] and wide["2"].uncertainties is None
    assert [r.tag for r in catalog.all_tags(library).collect()] == ["a", "alpha", "b"]
    assert ids(catalog.duplicate(library, "1", "9")) == ["1", "2", "3", "9"] and ids(catalog.delete(library, spark.createDataFrame([("2",)], "id string"))) == ["1", "3"]
    assert catalog.pin(library, ["2"]).where("is_pinned").count() == 2
    new = library.where("id = '1'").withColumn("id", F.lit("7"))
    ok, bad = catalog.insert(library, new.unionByName(library.where("id = '2'")).unionByName(new.withColumn("name", F.lit(""))))
    assert ids(ok) == ["1", "2", "3", "7"] and sorted(r.error for r in bad.collect()) == ["id exists", "missing name"]
    up = catalog.update(library, spark.createDataFrame([("2", "new")], "id string, name string"))
    assert up.where("id = '2'").first().name == "new" and up.where("id = '1'").first().name == "Mass of rod"
    with pytest.raises(Exception, match="lengths differ"):
        catalog.zip_strict(library.withColumn("uncertainties", F.array(F.lit(1.0)))).collect()
    assert catalog.uncertainty_column(["x", "Sigma(X)"], "x") == "Sigma(X)"


def test_references():
    assert sheet.parse_cell("AB12") == (11, 27) and sheet.column_letters(27) == "AB"
    assert sheet.Range.parse("C3:A1").shape == (3, 3) and sheet.Range.parse("A1:B2").overlaps(sheet.Range.parse("B2:C3")) and not sheet.Range.parse("A1").overlaps(sheet.Range.parse("B2"))
    assert sheet.references("=A1*LOG10(B2)+A10-A1") == ["A1", "B2", "A10"] and sheet.shift("A1+$B$2", 1, 1) == "B2+$B$2"
    assert [sheet.input_kind(x) for x in ("1e3", "A1", "A1:B2", "?")] == ["number", "cell", "range", "invalid"]
    with pytest.raises(DataError):
        sheet.shift("A1", -1, 0)
    assert sheet.validate_request("a*b", {"a": {"range": "A1:A3"}, "b": {"range": "B1:B2"}}, "A2:A3") == ["output overlaps a", "ranges have different numbers of rows"]
    assert sheet.validate_request("", {}, "") != []


def test_cell_propagation():
    out = sheet.propagate_cells({"A1": {"value": 3.0, "upper": 0.1}, "A10": {"value": 2.0}, "B1": {"value": 0, "formula": "=A1^2*A10"}, "C1": {"value": 0, "formula": "=B1+1", "upper": 9, "source": "manual"}, "D1": {"value": 0, "formula": "=A10*2", "upper": 5}})
    assert out["B1"]["value"] == pytest.approx(18) and out["B1"]["upper"] == pytest.approx(1.2) and out["C1"]["upper"] == 9 and "upper" not in out["D1"]
    with pytest.raises(FormulaError):
        sheet.propagate_cells({"A1": {"formula": "=B1", "value": 0}, "B1": {"formula": "=A1", "value": 0}})


def test_cells(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(100)], "k int, n string").repartition(7)
    cells = sheet.to_cells(df, ["k"])
    assert [r.value for r in sheet.read_range(cells, "A1:A100").orderBy("row").collect()] == [str(i) for i in range(100)]
    assert sheet.range_cells(spark, "B2:C4").count() == 6 and sheet.dense(cells.where("row % 2 = 0"), 2).count() == 99
    assert {(r.row, r.col) for r in sheet.place(cells, "C5").where("row = 4").collect()} == {(4, 2), (4, 3)}


def write(path, data):
    path.write_bytes(data)
    return str(path)


def test_delimited(spark, tmp_path):
    p = write(tmp_path / "a.csv", '﻿a,b\r\n"x, ""y""",1.5\r\n\r\nq,nan,7\r\n'.encode())
    rows = [tuple(r) for r in files.read_csv(spark, p).collect()]
    assert rows == [("a", "b", None), ('x, "y"', "1.5", None), ("q", "nan", "7")]
    assert [r.b for r in files.read_csv(spark, p, header=True, numeric=["b"]).collect()] == [1.5, None]
    assert files.metadata(spark, p) == {"size": os.path.getsize(p), "extension": "csv", "rows": 3, "columns": 3}
    p = write(tmp_path / "b.txt", b"junk\nmore\ncaf\xe9|2\n")
    assert files.detect_encoding(spark, p) == "windows-1252"
    assert [tuple(r) for r in files.read_txt(spark, p, "|", skip_rows=2, encoding="latin1").collect()] == [("café", "2")]
    with pytest.raises(DataError):
        files.read_txt(spark, p, "")
    with pytest.raises(FormatError):
        files.resolve(str(tmp_path / "none"))


def test_strict_numbers(spark, tmp_path):
    p = write(tmp_path / "n.csv", b"x;y\n1,5;2\n3;4\n")
    got = files.read_numeric(spark, p, decimal_comma=True)
    assert got.columns == ["x", "y"] and [tuple(r) for r in got.orderBy("x").collect()] == [(1.5, 2.0), (3.0, 4.0)]
    with pytest.raises(Exception, match="not a number"):
        files.read_numeric(spark, p).collect()


def test_snapshots(spark, tmp_path):
    book = {"id": "w", "sheets": {"s": {"name": "One", "cellData": {"0": {"1": {"v": 2.5, "f": "=A1"}}, "3": {"0": {"v": True}}}}}}
    p = str(tmp_path / "w.snap")
    files.write_snapshot(book, p)
    assert files.read_snapshot(p) == book
    assert sorted(tuple(r) for r in files.snapshot_cells(spark, p).collect()) == [("s", "One", 0, 1, "2.5", "=A1"), ("s", "One", 3, 0, "true", None)]
    for bad in (b"nonsense", b"MENSURA\x01\x02\x00\x00\x00", b"MENSURA\x01\x01\x00\x00\x00zz", b"MENSURA\x01\x01\x00\x00\x00" + gzip.compress(b"{}")):
        with pytest.raises(FormatError):
            files.read_snapshot(write(tmp_path / "bad", bad))


def test_documents_are_whole(spark, tmp_path):
    df = spark.range(0, 100_001, 1, 3)
    with pytest.raises(DataError):
        files.document(df, "html")
    assert files.document(df.limit(5), "html", most=5).count("<tr>") == 5
    for kind in ("html", "markdown", "tex"):
        files.write_document(df, kind, str(tmp_path / kind))
        parts = sorted(p for p in os.listdir(tmp_path / kind) if p.startswith("part-"))
        assert "".join((tmp_path / kind / p).read_text() for p in parts) == files.document(df, kind, most=100_001)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', None), (2, "x|y\\_", [1])], "i int, s string, l array<int>")
    assert [r.line for r in files.text_rows(df).collect()] == ['1,"a ""q""",', "2,x|y\\_,[1]"]
    assert files.markdown_rows(df).collect()[1].line == r"| 2 | x\|y\_ | [1] |"
    assert "\\textbackslash{}\\_" in files.document(df, "tex") and "<td>a &quot;q&quot;</td>" in files.document(df, "html")
    assert files.unique_names(["A"], ["A", "A", "B"]) == ["A (1)", "A (2)", "B"]
    target = str(tmp_path / "book")
    assert files.append_sheets(spark, target, {"A": df}) == ["A"] and files.append_sheets(spark, target, {"A": df, "B": df}) == ["A (1)", "B"]
    assert sorted(os.listdir(target)) == ["A", "A (1)", "B"] and not os.path.exists(target + ".staging")
    with pytest.raises(FormatError):
        files.write(df, "xlsx", target)


def test_streams(spark, tmp_path):
    from mensura.functions import units
    from mensura.operators import uncertainty

    src = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    local = uncertainty.propagate(stream.withColumn("s", F.lit(0.1)), "v^2", {"v": ("value", "s")}).withColumn("inch", units.convert(F.col("value"), "cm", "in"))
    q = local.writeStream.format("memory").queryName("local_rows").trigger(availableNow=True).start()
    q.awaitTermination()
    want = uncertainty.propagate(events.withColumn("s", F.lit(0.1)), "v^2", {"v": ("value", "s")})
    assert spark.table("local_rows").select("event_id", "sigma").exceptAll(want.select("event_id", "sigma")).count() == 0
    q = live.windowed_statistics(stream, "ts", ["event_type"], "value", "30 days").writeStream.outputMode("complete").format("memory").queryName("stats").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("stats").agg(F.sum("count")).first()[0] == events.count()
    got = []
    q = live.recompute_changed(stream, "event_type", "event_id", lambda d: d.select("event_type", "event_id"), lambda d, n: got.extend(d.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert {r.event_type: r.event_id for r in got} == {r[0]: r[1] for r in events.groupBy("event_type").agg(F.max("event_id")).collect()}
