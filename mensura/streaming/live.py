"""Row-local operators on streams, running statistics, and recomputation of what changed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_statistics(stream: DataFrame, time: str, keys: Sequence[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """count, mean, population std, min and max by key and tumbling window; state is dropped once the watermark passes."""
    t = F.col(time).cast("timestamp")
    v = F.col(value).cast("double")
    rows = stream.withColumn(time, t).withWatermark(time, late)
    out = rows.groupBy(F.window(time, window), *keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "count", "mean", "std_dev", "min", "max")


def recompute_changed(changes: DataFrame, key: str, order: str, compute: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that, batch by batch, keeps the newest change of each key, computes it and hands it to ``sink``.

    Earlier changes of a key in a batch are superseded, as a queue of edits would drop them. The
    checkpoint folder must be shared; ``sink`` gets the batch number so that it can be idempotent.
    """

    def batch(df: DataFrame, number: int) -> None:
        newest = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r")).select("_r.*")
        sink(compute(newest), number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
