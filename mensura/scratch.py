"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of one row for each group is broadcast; beyond it the join shuffles.
SMALL = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``; only tests on one machine fall back to its temporary folder."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("mensura.scratch.dir", None)
    if not top:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="mensura-")
        spark.conf.set("mensura.scratch.dir", top)
    return f"{top.rstrip('/')}/mensura-files/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once and read again: what depends on how rows were dealt to tasks is settled by the file."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``saved`` wrote, by Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(side: DataFrame, rows: int = SMALL) -> DataFrame:
    """``side``, marked for a broadcast if it has ``rows`` rows at most."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` by keys, of which nulls are equal to one another; keys come from ``left``."""
    renamed = right.select(*(F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`") for c in right.columns if c not in keys))
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & left[f"`{k}`"].eqNullSafe(renamed[f"_key{i}"])
    if right.columns == keys or how in ("left_semi", "left_anti"):
        return left.join(renamed, on, how).select(*(left[f"`{c}`"] for c in left.columns))
    return left.join(renamed, on, how).drop(*(f"_key{i}" for i in range(len(keys))))
