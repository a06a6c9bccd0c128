"""Appends of sheets are seen whole or not at all, wherever the driver stops; pages of a written listing."""

import os

import pytest
from pyspark.sql import functions as F

from mensura.operators import catalog
from mensura.sources import files


def test_an_append_that_stops_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    target, df = str(tmp_path / "book"), spark.range(3)
    files.append_sheets(spark, target, {"A": df})

    def stop(*a):
        raise KeyboardInterrupt

    with pytest.raises(Exception):  # before the commit: the second sheet cannot be written
        files.append_sheets(spark, target, {"B": df, "C": df.select(F.raise_error(F.lit("no")).alias("id"))})
    assert sorted(files.read_sheets(spark, target)) == ["A"] and not os.path.exists(target + ".appends/x")
    place = files._place_sheet
    calls = []
    monkeypatch.setattr(files, "_place_sheet", lambda *a: calls.append(a) or (place(*a) if len(calls) < 2 else stop()))
    with pytest.raises(KeyboardInterrupt):  # after it, between two sheets
        files.append_sheets(spark, target, {"A": df.limit(1), "B": df.limit(2)})
    monkeypatch.setattr(files, "_place_sheet", place)
    assert sorted(os.listdir(target)) == ["A", "A (1)"]
    assert {n: d.count() for n, d in files.read_sheets(spark, target).items()} == {"A": 3, "A (1)": 1, "B": 2}
    assert files.append_sheets(spark, target, {"B": df}) == ["B (1)"]
    assert sorted(os.listdir(target)) == ["A", "A (1)", "B", "B (1)"] and not os.path.exists(target + ".appends")


def test_pages_of_a_written_listing(spark, tmp_path):
    rows = [(f"{i:03d}", f"n{i % 9}", None, [], None, "s", [1.0] * (i % 4), None, i % 11 == 0, i % 7) for i in range(95)]
    names = "id string, name string, description string, tags array<string>, unit string, source string, data array<double>, uncertainties array<double>, is_pinned boolean, m int"
    df = spark.createDataFrame(rows, names).withColumns({"created_at": F.timestamp_seconds("m"), "modified_at": F.timestamp_seconds("m")}).drop("m")
    for sort, down in (("modified", True), ("name", False), ("size", True)):
        path = str(tmp_path / sort)
        catalog.write_listing(df, path, sort, down)
        for number, size in ((0, 10), (9, 10), (50, 10), (2, 40), (0, 0)):
            want, got = catalog.page(df, sort, down, number, size), catalog.read_page(spark, path, number, size)
            assert want[0] == got[0] and want[1].collect() == got[1].collect()
    plan = catalog.read_page(spark, path, 2, 10)[1]._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(place,20)" in plan and "LessThan(place,30)" in plan
