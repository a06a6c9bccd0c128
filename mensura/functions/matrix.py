"""Matrix and regression functions of spreadsheets over tables: MMULT, LINEST, LOGEST, TREND, GROWTH, FREQUENCY, TRIMMEAN."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.errors import DataError
from mensura.fit import odr
from mensura.fit import spark as fits
from mensura.functions import sheetlike
from mensura.operators import selection
from mensura.scratch import same_keys, small

#: Rows and columns of a block.
BLOCK = 128


def _blocks(cells: DataFrame, size: int, down: str, across: str, name: str) -> DataFrame:
    """One row for each block that holds a cell, with its cells: ``size`` squared at most."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    entry = F.struct((F.col("row") % size).cast("int").alias("r"), (F.col("col") % size).cast("int").alias("c"), F.col("value").cast("double").alias("v"))
    return cells.where(F.col("value").isNotNull()).groupBy(at("row").alias(down), at("col").alias(across)).agg(F.collect_list(entry).alias(name))


def mmult(left: DataFrame, right: DataFrame, size: int = BLOCK) -> DataFrame:
    """MMULT: the product of two matrices of cells (row, col, value), unique by place, indices from 0, as cells.

    Cells are gathered to blocks; blocks that meet in an inner index are multiplied as arrays, and
    their products added up by cell (in the tasks first), so what moves is one row for each result
    cell and inner block, not for each product of numbers. Absent cells and nulls are 0; result
    cells are those of rows and columns with a cell in blocks that meet. An empty side gives no cells.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def dense(entries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, c, v = (np.array([e[k] for e in entries]) for k in "rcv")
            out = np.zeros((size, size))
            out[r, c] = v
            return out, np.unique(r), np.unique(c)

        for pdf in parts:
            for i, j, a, b in zip(pdf["i"], pdf["j"], pdf["a"], pdf["b"]):
                (x, rows, _), (y, _, cols) = dense(a), dense(b)
                r, c = np.meshgrid(rows, cols, indexing="ij")
                yield pd.DataFrame({"row": (i * size + r).ravel(), "col": (j * size + c).ravel(), "value": (x @ y)[r, c].ravel()})

    pairs = _blocks(left, size, "i", "k", "a").join(_blocks(right, size, "k", "j", "b"), "k").select("i", "j", "a", "b")
    return pairs.mapInPandas(run, "row bigint, col bigint, value double").groupBy("row", "col").agg(F.sum("value").alias("value"))


def _spec(y: str, xs: Sequence[str], constant: bool) -> odr.FitSpec:
    if not xs:
        raise DataError("a regression needs a column")
    names = [f"b{k}" for k in range(0 if constant else 1, len(xs) + 1)]
    formula = " + ".join([*(["b0"] if constant else []), *(f"b{k}*{x}" for k, x in enumerate(xs, 1))])
    return odr.FitSpec.single(formula, y, list(xs), names, guesses=(0.0,) * len(names))


def linest(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), constant: bool = True) -> DataFrame:
    """LINEST by group of any size: keys, coefficients (intercept first, if any), errors, r2, se_y, f, dof, ss_reg, ss_res, error.

    Sums of products are aggregated, and the residuals taken in a second pass (``fit_linear_groups``).
    A group that cannot be fitted has ``error``; null keys are a group.
    """
    rows = df if keys else df.withColumn("_all", F.lit(0))
    own = list(keys) or ["_all"]
    out = fits.fit_linear_groups(rows, own, _spec(y, xs, constant))
    res = F.pow(F.col("rmse"), 2) * F.col("n")
    total = F.col("_sst") if constant else F.col("_syy")
    v = F.col(f"`{y}`").cast("double")
    sums = rows.groupBy(*own).agg((F.var_pop(v) * F.count(v)).alias("_sst"), F.sum(v * v).alias("_syy"))
    out = same_keys(out, small(sums), own, "left").withColumns({"ss_res": res, "ss_reg": total - res})
    f = F.try_divide(F.col("ss_reg") / len(xs), F.col("ss_res") / F.col("dof"))
    return out.select(*keys, F.col("parameters").alias("coefficients"), F.col("sigmas").alias("errors"), F.try_divide(F.col("ss_reg"), total).alias("r2"), F.sqrt(F.try_divide("ss_res", "dof")).alias("se_y"), f.alias("f"), "dof", "ss_reg", "ss_res", "error")


def trend(df: DataFrame, new: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), constant: bool = True, out: str = "trend") -> DataFrame:
    """TREND: ``new`` with the value that its group's regression over ``df`` gives at its columns; null without one."""
    own = list(keys) or ["_all"]
    known, asked = (d if keys else d.withColumn("_all", F.lit(0)) for d in (df, new))
    fitted = fits.fit_linear_groups(known, own, _spec(y, xs, constant)).select(*own, F.col("parameters").alias("_b"))
    value = F.get("_b", F.lit(0)) if constant else F.lit(0.0)
    for k, x in enumerate(xs, int(constant)):
        value = value + F.get("_b", F.lit(k)) * F.col(f"`{x}`")
    return same_keys(asked, small(fitted), own, "left").select(*(F.col(f"`{c}`") for c in new.columns), value.alias(out))


def logest(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), constant: bool = True) -> DataFrame:
    """LOGEST: y = b m1^x1 m2^x2 ... by the regression of ln y: as ``linest``, with the coefficients as b and m."""
    out = linest(df.withColumn(y, F.ln(F.col(f"`{y}`").cast("double"))), y, xs, keys, constant)
    return out.withColumn("coefficients", F.transform("coefficients", lambda c: F.exp(c)))


def growth(df: DataFrame, new: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), constant: bool = True, out: str = "growth") -> DataFrame:
    """GROWTH: ``new`` with the value of its group's exponential curve."""
    return trend(df.withColumn(y, F.ln(F.col(f"`{y}`").cast("double"))), new, y, xs, keys, constant, out).withColumn(out, F.exp(out))


def frequency(df: DataFrame, value: str, bins: DataFrame, bound: str) -> DataFrame:
    """FREQUENCY: (bound, n): for each distinct bound how many values lie at or below it and above the next smaller; a null bound has those above all.

    Values and bounds are merged in their order by ranges, so neither side is broadcast. Nulls do not count.
    """
    values = df.where(F.col(f"`{value}`").isNotNull()).select((-F.col(f"`{value}`").cast("double")).alias("_v"))
    edges = bins.where(F.col(f"`{bound}`").isNotNull()).select(F.col(f"`{bound}`").cast("double").alias("bound")).distinct()
    found = sheetlike.lookup(values, edges.select((-F.col("bound")).alias("_e"), "bound"), "_v", "_e", "bound", "_b", approximate=True)
    counts = found.groupBy("_b").agg(F.count("*").alias("n"))
    every = edges.unionByName(edges.sparkSession.range(1).select(F.lit(None).cast("double").alias("bound")))
    return every.join(counts, F.col("bound").eqNullSafe(F.col("_b")), "left").select("bound", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def trimmean(df: DataFrame, value: str, keys: Sequence[str], fraction: float) -> DataFrame:
    """TRIMMEAN: keys, trimmean: the mean without the ``fraction`` of values at both ends together, rounded down to an even number.

    What goes is told by places in one numbering of all rows, whatever the size of a group.
    """
    if not 0 <= fraction < 1:
        raise DataError("the fraction must lie in 0 to 1, 1 excluded")
    keys = list(keys)
    rows, groups = selection.placed(df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keys, value]))).where(F.col(f"`{value}`").isNotNull()), value, keys, False)
    cut, at = F.floor(F.col("_n") * fraction / 2), F.col("_place") - F.col("_first")
    return same_keys(rows, small(groups), keys).where((at >= cut) & (at < F.col("_n") - cut)).groupBy(*(F.col(f"`{k}`") for k in keys)).agg(F.avg(value).alias("trimmean"))
