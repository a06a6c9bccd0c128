"""Model values on grids, and the tables behind residual plots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.errors import DataError
from mensura.expr import formula as X

#: Points along an axis at most; defaults of curves, surfaces, and the pad of their ranges.
LARGEST, CURVE, SURFACE, PAD = 2000, 300, 30, 0.10


def _axis(i: Column, low: float, high: float, n: int) -> Column:
    return F.when(i == n - 1, F.lit(float(high))).otherwise(F.lit(float(low)) + i * F.lit((high - low) / (n - 1)))


def _checked(n: int) -> int:
    if not 2 <= n <= LARGEST:
        raise DataError(f"resolution too high or too low: {n} is not in 2..{LARGEST}")
    return n


def curve(spark: SparkSession, formula: str, independent: str, low: float, high: float, parameters: Mapping[str, float] = {}, resolution: int = CURVE) -> DataFrame:
    """(i, x, y) with both end points: generated and evaluated on the executors."""
    n = _checked(resolution)
    e = X.substitute(X.parse(formula, [independent, *parameters]), {k.lower(): v for k, v in parameters.items()})
    out = spark.range(n).select(F.col("id").alias("i"), _axis(F.col("id"), low, high, n).alias("x"))
    return out.withColumn("y", X.to_column(e, {independent.lower(): F.col("x")}))


def surface(spark: SparkSession, formula: str, independents: tuple[str, str], x_range, y_range, parameters: Mapping[str, float] = {}, resolution: int = SURFACE) -> DataFrame:
    """(i, x, y, z) row by row, y outside: one range of resolution² indices, split by division."""
    if len(independents) != 2:
        raise DataError("a surface takes exactly two independents")
    n = _checked(resolution)
    e = X.substitute(X.parse(formula, [*independents, *parameters]), {k.lower(): v for k, v in parameters.items()})
    i = F.col("id")
    out = spark.range(n * n).select(i.alias("i"), _axis(F.pmod(i, F.lit(n)), *x_range, n).alias("x"), _axis(F.floor(i / n), *y_range, n).alias("y"))
    return out.withColumn("z", X.to_column(e, dict(zip((v.lower() for v in independents), (F.col("x"), F.col("y"))))))


def padded_range(df: DataFrame, column: str, pad: float = PAD) -> tuple[float, float]:
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise DataError(f"{column} has no values")
    edge = (high - low) * pad or abs(low) * pad or 1.0
    return low - edge, high + edge


def predicted_observed(df: DataFrame, dependent: str, fitted: str = "fitted", pad: float = 0.05) -> DataFrame:
    """One row with the common range of observed and predicted values, padded: low, high."""
    lo, hi = F.least(F.min(dependent), F.min(fitted)), F.greatest(F.max(dependent), F.max(fitted))
    return df.agg(lo.alias("_lo"), hi.alias("_hi")).select((F.col("_lo") - (F.col("_hi") - F.col("_lo")) * pad).alias("low"), (F.col("_hi") + (F.col("_hi") - F.col("_lo")) * pad).alias("high"))


def quick_plot(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs for a plot: rounded to 1e-10, without nulls and non-finite values."""
    cols = {c: F.round(F.col(c).cast("double"), 10) for c in (x, y)}
    out = df.select(*(v.alias(k) for k, v in cols.items()))
    for c in (x, y):
        out = out.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")))
    return out
