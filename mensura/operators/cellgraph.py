"""A sheet's formulas as a graph over a table of cells: levels of dependence by joins, each computed at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError, MensuraError
from mensura.expr import formula as X
from mensura.operators.sheet import CELL_REFERENCE
from mensura.scratch import drop_path, saved, shared_dir, small

_VALUES = "cell string, value double, upper double, lower double, source string"
#: Names of a formula's references, by their first use.
_SLOT = "cell_{}"


def _slots(formula: str) -> tuple[str, int]:
    """A formula with its references as slots, so that autofilled ones are alike, and their number."""
    seen: dict[str, int] = {}
    text = CELL_REFERENCE.sub(lambda m: _SLOT.format(seen.setdefault(f"{m[2].upper()}{m[4]}", len(seen))), formula.strip().lstrip("="))
    return text, len(seen)


@functools.lru_cache(4096)
def _compiled(text: str, n: int):
    names = [_SLOT.format(i) for i in range(n)]
    e = X.parse(text, names)
    return e, [X.diff(e, v) for v in names]


def _computed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Values and bounds of cells whose references are known; formulas alike are computed as one array."""

    def array(x, size: int) -> np.ndarray:
        return np.broadcast_to(np.asarray(x, float), (size,)).copy()

    for pdf in parts:
        keys = [_slots(f) for f in pdf["formula"]]
        out = pd.DataFrame({"cell": pdf["cell"], "value": np.nan, "upper": np.nan, "lower": np.nan, "source": None, "error": None})
        alike: dict[tuple, list[int]] = {}
        for i, k in enumerate(keys):
            alike.setdefault(k, []).append(i)
        for key, at in alike.items():
            refs = [{r["pos"]: r for r in row} for row in pdf["refs"].iloc[at]]
            grid = {f: np.array([[np.nan if (v := r.get(j, {}).get(f)) is None else v for j in range(key[1])] for r in refs], float).reshape(len(at), key[1]) for f in ("value", "upper", "lower")}
            try:
                e, slopes = _compiled(*key)
                names = {_SLOT.format(j): np.nan_to_num(grid["value"][:, j], nan=0.0) for j in range(key[1])}
                with np.errstate(all="ignore"):
                    value = array(X.to_numpy(e, names), len(at))
                    d = np.stack([array(X.to_numpy(s, names), len(at)) for s in slopes], 1) if slopes else np.zeros((len(at), 0))
                    live = ~np.isnan(grid["upper"])
                    part = lambda b: np.sqrt((np.where(live, d * np.where(live, b, 0.0), 0.0) ** 2).sum(1))
                    upper, lower = part(grid["upper"]), part(np.where(np.isnan(grid["lower"]), grid["upper"], grid["lower"]))
                some, sided = live.any(1), (live & ~np.isnan(grid["lower"])).any(1)
                out.loc[out.index[at], ["value", "upper", "lower"]] = np.stack([value, np.where(some, upper, np.nan), np.where(some & sided, lower, np.nan)], 1)
                out.loc[out.index[at], "source"] = np.where(some, "propagated", None)
            except MensuraError as x:
                out.loc[out.index[at], "error"] = str(x)
        yield out


def propagate_table(cells: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """Propagates uncertainty through all formulas of a table of cells: the same columns, with new values and bounds.

    ``cells``: cell (A1 form, unique, any case), value, formula, upper, lower, source. Cells without
    a formula, and those whose source is ``manual``, keep what they have. Others are computed from the cells they name: those with
    an upper bound are variables, others constants (absent cells and nulls 0); a cell with no
    uncertain reference loses its bounds. Bounds are propagated by first derivatives, the lower
    one where some reference has one (the others' upper bounds stand in).

    An edge table (cell, reference) gives each cell the number of references still open. In each
    round the cells without any are computed at once, written to a growing table in the shared
    folder, and taken off the others' counts, so rounds are as many as the graph has levels. When
    none is left to compute but some are open, these depend on themselves, which is an error, as is
    a formula that cannot be read. The driver sees only counts and the first few names.
    """
    spark = cells.sparkSession
    live = F.coalesce(F.trim("formula") != "", F.lit(False)) & ~F.coalesce(F.col("source") == "manual", F.lit(False))
    base = saved(cells.select(F.upper(F.trim("cell")).alias("cell"), F.col("value").cast("double").alias("value"), "formula", F.col("upper").cast("double").alias("upper"), F.col("lower").cast("double").alias("lower"), "source", live.alias("live")))
    if base.count() != base.select("cell").distinct().count():
        raise DataError("a cell stands in several rows")
    found = F.array_distinct(F.transform(F.regexp_extract_all("formula", F.lit(CELL_REFERENCE.pattern), F.lit(0)), lambda r: F.upper(F.replace(r, F.lit("$"), F.lit("")))))
    edges = saved(base.where("live").select("cell", F.posexplode(found).alias("pos", "ref")))
    computed = base.where("live").select("cell")
    inner = edges.join(computed.withColumnRenamed("cell", "ref"), "ref").groupBy("cell").agg(F.count("*").alias("open"))
    waiting = saved(computed.join(inner, "cell", "left").select("cell", F.coalesce("open", F.lit(0).cast("long")).alias("open")))
    values, before = shared_dir(spark), None
    base.where(~F.col("live")).select("cell", "value", "upper", "lower", "source").write.parquet(values)
    known = lambda: spark.read.schema(_VALUES).parquet(values)
    for _ in range(max_levels):
        ready, left = waiting.agg(F.count_if(F.col("open") == 0), F.count_if(F.col("open") > 0)).first()
        if not ready:
            if left:
                raise FormulaError(f"{left} cells depend on themselves, such as {', '.join(r.cell for r in waiting.orderBy('cell').limit(5).collect())}")
            break
        now = waiting.where("open = 0").select("cell")
        asked = edges.join(small(now), "cell")
        given = asked.join(known().withColumnRenamed("cell", "ref").drop("source"), "ref", "left")
        refs = given.groupBy("cell").agg(F.collect_list(F.struct("pos", "value", "upper", "lower")).alias("refs"))  # as many as the formula names
        rows = now.join(refs, "cell", "left").join(base.select("cell", "formula"), "cell")
        rows = rows.select("cell", "formula", F.coalesce("refs", F.array().cast(refs.schema["refs"].dataType)).alias("refs"))
        level = saved(rows.mapInPandas(_computed, f"{_VALUES}, error string"))
        wrong = level.where("error is not null").limit(1).collect()
        if wrong:
            raise FormulaError(f"{wrong[0].cell}: {wrong[0].error}")
        level.drop("error").write.mode("append").parquet(values)
        less = edges.join(small(now.withColumnRenamed("cell", "ref")), "ref").groupBy("cell").agg(F.count("*").alias("less"))
        path = shared_dir(spark)
        after = waiting.where("open > 0").join(less, "cell", "left").select("cell", (F.col("open") - F.coalesce("less", F.lit(0).cast("long"))).alias("open"))
        waiting = saved(after, path)
        if before:
            drop_path(spark, before)
        before = path
    else:
        raise FormulaError(f"the formulas have more than {max_levels} levels")
    return base.select("cell", "formula").join(known(), "cell").select("cell", "value", "formula", "upper", "lower", "source")
