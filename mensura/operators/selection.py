"""Exact quantiles and ranks of groups of any size: refined histograms and global numbers instead of windows over a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mensura.errors import DataError
from mensura.scratch import SMALL, drop_path, same_keys, saved, shared_dir, small

#: Bins of a group's histogram in one round.
BINS = 1024


def exact_quantiles(df: DataFrame, value: str, keys: Sequence[str], probabilities: Sequence[float], bins: int = BINS) -> DataFrame:
    """keys, p, quantile: exact, with linear interpolation between neighbours, whatever the size of a group.

    Each wanted order statistic has an interval that holds it and its rank there. A round counts the
    values inside by bins (summed in the tasks first; ``bins`` rows a group at most) and goes on
    with the bin of that rank, bounded by the least and greatest value found in it, until both are
    one value: a bin narrows by a factor of ``bins``, so two or three rounds are common. No group's
    values are gathered anywhere.

    Nulls do not count, NaN is the greatest value, a group of nulls alone gives null; null keys are
    a group. An empty table gives no rows.
    """
    if bins < 2 or not probabilities or any(not 0 <= p <= 1 for p in probabilities):
        raise DataError("probabilities must lie between 0 and 1, and bins be 2 or more")
    spark, own = df.sparkSession, [f"_own{i}" for i in range(len(keys))]
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*(F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)), v.alias("v"))
    finite = F.when(~F.isnan("v"), F.col("v"))
    facts = rows.groupBy(*own).agg(F.count("v").alias("n"), F.count(finite).alias("numbers"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    groups = saved(facts.withColumn("g", F.monotonically_increasing_id()))
    points = saved(same_keys(rows.where("v is not null and not isnan(v)"), small(groups.select(*own, "g")), own).select("g", "v"))
    place = F.explode(F.array(*(F.lit(float(p)) for p in dict.fromkeys(probabilities))))
    asked = groups.where("n > 0").select("g", "n", "numbers", "lo", "hi", place.alias("p")).withColumn("at", F.col("p") * (F.col("n") - 1))
    ends = saved(asked.select("g", "p", "at", "numbers", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k")))
    fields = "g bigint, k bigint, r bigint, lo double, hi double"
    wanted = ends.where("k < numbers").select("g", "k", F.col("k").alias("r"), "lo", "hi").distinct()
    done, before = shared_dir(spark), None
    settled = F.col("lo") == F.col("hi")
    wanted = saved(wanted)
    wanted.where(settled).write.parquet(done)
    active = wanted.where(~settled)
    left = active.count()
    while left:
        inside = points.join(F.broadcast(active) if left <= SMALL else active, "g").where("v between lo and hi")
        part = F.coalesce(F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2), F.lit(0.0))
        bin_ = F.when(F.col("v") == F.col("hi"), bins - 1).otherwise(F.least(F.floor(part * bins), F.lit(bins - 1)))  # both ends part, so every round narrows
        counted = inside.withColumn("bin", F.when(F.col("v") == F.col("lo"), 0).otherwise(bin_)).groupBy("g", "k", "r", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("g", "k").orderBy("bin"))  # ``bins`` rows at most
        picked = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("r")) & (F.col("_upto") - F.col("c") <= F.col("r")))
        path = shared_dir(spark)
        wanted = saved(picked.select("g", "k", (F.col("r") - F.col("_upto") + F.col("c")).alias("r"), "lo", "hi"), path)
        ended, left = wanted.agg(F.count_if(settled), F.count_if(~settled)).first()
        if ended:
            wanted.where(settled).write.mode("append").parquet(done)
        if before:
            drop_path(spark, before)
        before, active = path, wanted.where(~settled)
    found = spark.read.schema(fields).parquet(done).select("g", "k", F.col("lo").alias("x"))
    value_at = F.when(F.col("k") >= F.col("numbers"), F.lit(float("nan"))).otherwise(F.col("x"))
    got = ends.join(found, ["g", "k"], "left").withColumn("x", value_at)
    both = got.groupBy("g", "p", "at").agg(F.min_by("x", "k").alias("a"), F.max_by("x", "k").alias("b"))
    weight = F.col("at") - F.floor("at")
    both = both.select("g", "p", F.when(weight == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * weight).alias("quantile"))
    every = groups.select("g", *own, place.alias("p"))
    return every.join(both, ["g", "p"], "left").select(*own, "p", "quantile").toDF(*keys, "p", "quantile")


def placed(df: DataFrame, value: str, keys: Sequence[str], descending: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the order of (keys, value), written once; and by group its first place and size."""
    from mensura.operators.sheet import numbered

    order = F.col(f"`{value}`").desc() if descending else F.col(f"`{value}`").asc()
    rows = numbered(df, [*(F.col(f"`{k}`") for k in keys), order], "_place")
    return rows, rows.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))


def ranks(df: DataFrame, value: str, keys: Sequence[str], descending: bool = True) -> DataFrame:
    """Adds ``rank`` (ties share the first) and ``percent_rank`` (ascending) within groups of any size.

    All rows are numbered together by ranges, so a hot group is dealt over many tasks; its first
    place, and the first and last place of each tie, are found by aggregation and joined back
    (broadcast if they are few; else adaptive execution splits a hot tie). Nulls rank as Spark's
    order puts them: last if descending, else first. Null keys are a group.
    """
    keys = list(keys)
    rows, groups = placed(df, value, keys, descending)
    ties = rows.groupBy(*(F.col(f"`{k}`") for k in keys), F.col(f"`{value}`")).agg(F.min("_place").alias("_head"), F.max("_place").alias("_tail"))
    out = same_keys(same_keys(rows, small(ties), [*keys, value]), small(groups), keys)
    below = (F.col("_n") - 1 - (F.col("_tail") - F.col("_first"))) if descending else F.col("_head") - F.col("_first")
    percent = F.when(F.col("_n") > 1, below / (F.col("_n") - 1)).otherwise(0.0)
    return out.withColumns({"rank": F.col("_head") - F.col("_first") + 1, "percent_rank": percent}).select(*(F.col(f"`{c}`") for c in df.columns), "rank", "percent_rank")


def nth(df: DataFrame, value: str, keys: Sequence[str], k: int, largest: bool = True) -> DataFrame:
    """keys, value: the k-th largest or smallest value of each group (repeats count), of groups of any size; smaller groups give none."""
    keys = list(keys)
    rows, groups = placed(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keys, value]))).where(F.col(f"`{value}`").isNotNull()), value, keys, largest)
    return same_keys(rows, small(groups), keys).where(F.col("_place") - F.col("_first") == k - 1).select(*(F.col(f"`{c}`") for c in (*keys, value)))
