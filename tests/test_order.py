"""Row numbers and approximate lookups of tables large enough to be dealt, merged and split in many ways."""

import pytest
from pyspark.sql import functions as F

from mensura.functions import sheetlike
from mensura.operators import sheet


@pytest.fixture(params=["true", "false"], ids=["adaptive", "plain"])
def session(spark, request):
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def wide(spark, n):
    return spark.range(n).select(((F.col("id") * 7919) % n).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))


@pytest.mark.parametrize("n", [1_000_000, 4_000_000])
def test_numbers_are_whole(session, n):
    got = sheet.numbered(wide(session, n), ["k"]).agg(F.count("*"), F.count_if(F.col("k") == F.col("row")), F.max("row")).first()
    assert tuple(got) == (n, n, n - 1)


@pytest.mark.parametrize("n", [1_000_000, 4_000_000])
def test_approximate_lookup_is_whole(session, n):
    """A third of the rows share one key."""
    table = session.range(0, n, 10).select(F.col("id").alias("tk"), F.col("id").cast("string").alias("v"))
    rows = wide(session, n).withColumn("k", F.when(F.col("k") < n / 3, 17).otherwise(F.col("k")))
    got = sheetlike.lookup(rows, table, "k", "tk", "v", "got", approximate=True)
    right = F.col("got").cast("long") == F.floor(F.col("k") / 10) * 10
    assert tuple(got.agg(F.count("*"), F.count_if(right)).first()) == (n, n)


def test_lookup_of_repeated_rows_and_empty_sides(spark):
    t = spark.createDataFrame([(1.0, "a"), (float("nan"), "n")], "k double, v string")
    rows = spark.createDataFrame([(1.5, {"m": 1})] * 5 + [(0.5, None), (float("nan"), None), (None, None)], "x double, m map<string,int>")
    got = sheetlike.lookup(rows, t, "x", "k", "v", approximate=True).collect()
    assert sorted(str(r.looked_up) for r in got) == ["None", "None", "a", "a", "a", "a", "a", "n"]
    assert sheetlike.lookup(rows.where("false"), t, "x", "k", "v", approximate=True).count() == 0
    assert sheetlike.lookup(rows, t.where("false"), "x", "k", "v", approximate=True).where("looked_up is null").count() == 8
