"""MDETERM and MINVERSE of many square matrices of cells at once: elimination by panels of columns over tables of row blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.scratch import drop_path, saved, shared_dir, small

#: Rows of a block and columns of a panel.
BLOCK = 64
#: Bytes of pivot rows up to which they are broadcast.
PIVOT_BYTES = 8 << 20

_STATE = "_g string, n int, i int, pos array<int>, data binary"


def _matrix(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(-1, columns)


def _start(size: int, inverse: bool):
    """Blocks of cells as arrays, with the unit matrix beside them if the inverse is asked for."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            data, pos = [], []
            for n, i, cells in zip(pdf["n"], pdf["i"], pdf["cells"]):
                m = min(size, n - i * size)
                out = np.zeros((m, 2 * n if inverse else n))
                for c in cells if cells is not None else ():
                    out[c["r"], c["c"]] = c["v"]
                if inverse:
                    out[np.arange(m), n + i * size + np.arange(m)] = 1.0
                data.append(out.tobytes())
                pos.append([-1] * m)
            yield pdf[["_g", "n", "i"]].assign(pos=pos, data=data)

    return run


def _panels(k: int, size: int, wide: int):
    """Of each block: the rows not yet placed, and their numbers in the columns of the panel."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows, data = [], []
            for n, i, pos, d in zip(pdf["n"], pdf["i"], pdf["pos"], pdf["data"]):
                open_ = np.flatnonzero(np.asarray(pos) < 0)
                rows.append((open_ + i * size).tolist())
                data.append(_matrix(d, wide * n)[open_, k : min(k + size, n)].tobytes())
            yield pdf[["_g", "n"]].assign(rows=rows, panel=data)

    return run


def _chosen(k: int, size: int):
    """Of one matrix: the pivot rows of a panel by size, largest first, the inverse of their square and its determinant."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = min(size, int(pdf["n"].iloc[0]) - k)
        rows = np.concatenate([np.asarray(r, dtype=np.int64) for r in pdf["rows"]])
        whole = np.concatenate([_matrix(d, b) for d in pdf["panel"]])
        order = np.argsort(rows)
        rows, whole = rows[order], whole[order]
        left, picked, det = whole.copy(), [], 1.0
        for j in range(b):
            at = int(np.argmax(np.abs(left[:, j])))
            pivot = left[at, j]
            if pivot == 0 or not np.isfinite(left[:, j]).all():
                return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "picked": [None], "inv": [None], "det": [0.0 if pivot == 0 else np.nan]})
            picked.append(at)
            det *= pivot
            left = left - np.outer(left[:, j] / pivot, left[at])
            left[picked] = 0.0
        return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "picked": [rows[picked].tolist()], "inv": [np.linalg.inv(whole[picked]).tobytes()], "det": [det]})

    return run


def _pivots(size: int, wide: int):
    """The pivot rows in a block, whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for g, n, i, d, picked in zip(pdf["_g"], pdf["n"], pdf["i"], pdf["data"], pdf["picked"]):
                m = _matrix(d, wide * n)
                out += [(g, j, m[r - i * size].tobytes()) for j, r in enumerate(picked) if 0 <= r - i * size < len(m)]
            yield pd.DataFrame(out, columns=["_g", "j", "row"])

    return run


def _updated(k: int, size: int, wide: int):
    """Blocks after a panel: pivot rows solved and placed, the others cleared of the panel's columns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            places, data = [], []
            for n, i, pos, d, picked, inv, pivots in zip(pdf["n"], pdf["i"], pdf["pos"], pdf["data"], pdf["picked"], pdf["inv"], pdf["pivots"]):
                m, pos, b = _matrix(d, wide * n), np.array(pos), min(size, n - k)
                solved = _matrix(inv, b) @ np.stack([np.frombuffer(p["row"], float) for p in sorted(pivots, key=lambda p: p["j"])])
                out = m - m[:, k : k + b] @ solved
                if wide == 1:  # of a determinant, placed rows are done
                    out[pos >= 0] = m[pos >= 0]
                for j, r in enumerate(picked):
                    if 0 <= r - i * size < len(m):
                        out[r - i * size], pos[r - i * size] = solved[j], k + j
                places.append(pos.tolist())
                data.append(out.tobytes())
            yield pdf[["_g", "n", "i"]].assign(pos=places, data=data)

    return run


def _sign(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sign of the order in which rows were taken: -1 to the power of rows less cycles."""
    to = np.concatenate([np.asarray(p, dtype=np.int64) for p in pdf.sort_values("i")["pos"]])
    seen, cycles = np.zeros(len(to), bool), 0
    for s in range(len(to)):
        cycles += not seen[s]
        while not seen[s]:
            seen[s], s = True, to[s]
    return pd.DataFrame({"_g": [pdf["_g"].iloc[0]], "sign": [1.0 if (len(to) - cycles) % 2 == 0 else -1.0]})


def _eliminated(cells: DataFrame, keys: Sequence[str], inverse: bool, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, determinants of panels, placed blocks): the work of both functions."""
    spark, wide = cells.sparkSession, 2 if inverse else 1
    key = F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys))) if keys else F.lit("")
    rows = cells.where(F.col("value").isNotNull()).select(key.alias("_g"), *(F.col(f"`{k}`") for k in keys), "row", "col", F.col("value").cast("double").alias("value"))
    groups = saved(rows.groupBy("_g", *(F.col(f"`{k}`") for k in keys)).agg((F.greatest(F.max("row"), F.max("col")) + 1).cast("int").alias("n")))
    entry = F.struct((F.col("row") % size).cast("int").alias("r"), F.col("col").cast("int").alias("c"), F.col("value").alias("v"))
    held = rows.groupBy("_g", F.floor(F.col("row") / size).cast("int").alias("i")).agg(F.collect_list(entry).alias("cells"))
    every = groups.select("_g", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("i"))
    path, done, dets = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    state = saved(every.join(held, ["_g", "i"], "left").mapInPandas(_start(size, inverse), _STATE), path)
    state.where("false").write.parquet(done)
    most = groups.agg(F.max("n")).first()[0] or 0
    groups.select("_g", F.lit(0).alias("k"), F.lit(1.0).alias("det")).write.parquet(dets)
    for k in range(0, most, size):
        panels = state.mapInPandas(_panels(k, size, wide), "_g string, n int, rows array<bigint>, panel binary")
        picks = saved(panels.groupBy("_g").applyInPandas(_chosen(k, size), "_g string, picked array<bigint>, inv binary, det double"))
        picks.select("_g", F.lit(k).alias("k"), "det").write.mode("append").parquet(dets)
        good = picks.where("picked is not null").select("_g", "picked", "inv")
        limit = max(1, PIVOT_BYTES // (8 * wide * most * size))
        found = state.join(small(good.select("_g", "picked"), limit), "_g").mapInPandas(_pivots(size, wide), "_g string, j int, row binary")
        pivots = good.join(found.groupBy("_g").agg(F.collect_list(F.struct("j", "row")).alias("pivots")), "_g")
        after_path = shared_dir(spark)
        after = saved(state.join(small(saved(pivots), limit), "_g").mapInPandas(_updated(k, size, wide), _STATE), after_path)
        after.where(F.col("n") <= k + size).write.mode("append").parquet(done)
        state = after.where(F.col("n") > k + size)
        drop_path(spark, path)
        path = after_path
    return groups, spark.read.parquet(dets), spark.read.schema(_STATE).parquet(done)


def mdeterm(cells: DataFrame, keys: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """MDETERM: keys, n, determinant of each matrix of cells (keys, row, col, value), unique by place, indices from 0.

    Absent cells and nulls are 0, null keys are a group, and a matrix is as large as its largest
    index says; one without a cell gives no row. All matrices advance together by ``size`` columns a
    round: of each, one task sees the open rows in those columns and takes pivot rows, largest first;
    all blocks of rows are then cleared at once. So a task holds ``size`` columns, or ``size`` rows, of a
    matrix, never all of it. A singular matrix has 0, one with a non-finite number NaN.
    """
    groups, dets, done = _eliminated(cells, keys, False, size)
    signs = done.select("_g", "i", "pos").groupBy("_g").applyInPandas(_sign, "_g string, sign double")
    product = F.aggregate(F.sort_array(F.collect_list(F.struct("k", "det"))), F.lit(1.0), lambda a, x: a * x["det"])
    out = groups.join(dets.groupBy("_g").agg(product.alias("_d")), "_g").join(signs, "_g", "left")
    return out.select(*(F.col(f"`{k}`") for k in keys), "n", (F.col("_d") * F.coalesce("sign", F.lit(1.0))).alias("determinant"))


def minverse(cells: DataFrame, keys: Sequence[str] = (), size: int = BLOCK) -> DataFrame:
    """MINVERSE: the inverse of each matrix as cells (keys, row, col, value), all of them; none for a singular one.

    Matrices as in ``mdeterm``, cleared with the unit matrix beside them.
    """
    groups, _, done = _eliminated(cells, keys, True, size)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for g, n, pos, d in zip(pdf["_g"], pdf["n"], pdf["pos"], pdf["data"]):
                right = _matrix(d, 2 * n)[:, n:]
                yield pd.DataFrame({"_g": g, "row": np.repeat(np.asarray(pos, dtype=np.int64), n), "col": np.tile(np.arange(n), len(pos)), "value": right.ravel()})

    return groups.drop("n").join(done.mapInPandas(run, "_g string, row bigint, col bigint, value double"), "_g").drop("_g")
