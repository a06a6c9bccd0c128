"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm.common import drop_path, join_classes, saved, shared_dir


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return join_classes(both.where("v > u"), least, ["u"], "n", 2 * edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = join_classes(down, least, ["u"], "n", edges)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u > v")
        .distinct()
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v): the component is its smallest node.

    Each round joins edges with the least neighbour of each node, which is aggregated before the
    shuffle, and writes the shrunk edge table to the shared folder; no node's neighbours are ever
    gathered in one row or task (nodes of many edges, a thousand or so, are joined by broadcast),
    and nothing but two numbers reaches the driver. Rows with a null end and loops are dropped. An
    empty table gives an empty result.
    """
    spark = edges.sparkSession
    path = shared_dir(spark)
    now = saved(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    seen = _summary(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        fresh, middle = shared_dir(spark), shared_dir(spark)
        star = saved(_large_star(now, seen[0]), middle)
        now = saved(_small_star(star, seen[0]), fresh)
        drop_path(spark, middle)
        drop_path(spark, path)
        path, before, seen = fresh, seen, _summary(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
