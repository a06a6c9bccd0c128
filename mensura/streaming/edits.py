"""Edits of a sheet's cells as a stream: cells that name an edited one are computed anew from inputs held as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mensura.errors import FormulaError
from mensura.operators import cellgraph
from mensura.operators.sheet import CELL_REFERENCE

EDIT = "cell string, value double, upper double, lower double, at timestamp"
_OUT = f"{EDIT}, version bigint, error string"


class _Inputs(StatefulProcessor):
    """Of one cell: the newest edit of each cell that its formula names, and how often it was computed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inputs = handle.getMapState("inputs", "pos int", "at timestamp, version bigint, value double, upper double, lower double")
        self.computed = handle.getValueState("computed", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest: dict[int, tuple] = {}
        formula = None
        order = lambda e: (e[0], e[1], *((v is not None, v or 0.0) for v in e[2:]))
        for pdf in rows:
            for r in pdf.itertuples():
                formula = r.formula
                e = (r.at.to_pydatetime(), int(r.version), *(None if pd.isna(v) else float(v) for v in (r.value, r.upper, r.lower)))
                if r.pos not in newest or order(e) > order(newest[r.pos]):
                    newest[r.pos] = e
        changed = False
        for pos, e in newest.items():
            old = self.inputs.getValue((pos,))
            if old is None or order(e) > order(tuple(old)):
                self.inputs.updateValue((pos,), e)
                changed = True
        if not changed:
            return
        held = [(k[0], *v) for k, v in self.inputs.iterator()]
        n = (self.computed.get()[0] if self.computed.exists() else 0) + 1
        self.computed.update((n,))
        refs = [{"pos": p, "value": v, "upper": u, "lower": low} for p, _, _, v, u, low in held]
        out = next(cellgraph._computed(iter([pd.DataFrame({"cell": [key[0]], "formula": [formula], "refs": [refs]})])))
        yield out[["cell", "value", "upper", "lower"]].assign(at=max(h[1] for h in held), version=n, error=out["error"])

    def close(self) -> None:
        pass


def _levels(formulas: DataFrame, most: int) -> list[DataFrame]:
    """(cell, formula, pos, ref) of the cells of each level: the first names no cell with a formula, others only cells of earlier ones."""
    name = lambda c: F.upper(F.replace(F.trim(c), F.lit("$"), F.lit("")))
    found = F.array_distinct(F.transform(F.regexp_extract_all("formula", F.lit(CELL_REFERENCE.pattern), F.lit(0)), name))
    edges = cellgraph.saved(formulas.where(F.trim("formula") != "").select(name(F.col("cell")).alias("cell"), "formula", found.alias("refs")))
    pairs = edges.select("cell", "formula", F.posexplode("refs").alias("pos", "ref"))
    depth = edges.select("cell", F.lit(1).alias("level"))
    for k in range(1, most + 1):
        deeper = pairs.join(depth.where(F.col("level") == k).select(F.col("cell").alias("ref")), "ref").select("cell").distinct().withColumn("deeper", F.lit(True))
        after = cellgraph.saved(depth.join(deeper, "cell", "left").select("cell", F.when(F.col("deeper"), k + 1).otherwise(F.col("level")).alias("level")))
        if after.where(F.col("level") > k).isEmpty():
            return [pairs.join(after.where(F.col("level") == j).select("cell"), "cell") for j in range(1, k + 1)]
        depth = after
    raise FormulaError(f"the formulas have more than {most} levels, or depend on themselves")


def live_cells(edits: DataFrame, formulas: DataFrame, most: int = 20) -> DataFrame:
    """The stream of computed cells (cell, value, upper, lower, at, version, error) that a stream of edits causes.

    ``edits``: see EDIT; ``formulas``: a table (cell, formula), unique by cell. An edit goes to all
    cells that name its cell; each holds the newest edit of its inputs, so state is bounded by the
    formulas and not by the edits. An edit older than the one held is late and changes nothing; of
    two with one time the greater numbers win, so results do not hang on the order of arrival.
    Inputs never edited and null numbers are 0, as in ``cellgraph.propagate_table``. Cells named by
    other formulas go on to them: a stage for each level of formulas, all in one query. ``at`` is the
    time of the newest input and ``version`` rises with each result of a cell. Edits without cell or
    time, or of a cell that has a formula, are passed over; a formula that cannot be computed gives
    ``error``. Append mode; the session's state store must be RocksDB, as Spark asks.
    """
    name = F.upper(F.replace(F.trim("cell"), F.lit("$"), F.lit("")))
    own = formulas.where(F.trim("formula") != "").select(F.upper(F.replace(F.trim("cell"), F.lit("$"), F.lit(""))).alias("cell"))
    fed = edits.where(F.col("cell").isNotNull() & F.col("at").isNotNull()).select(name.alias("cell"), *(F.col(c).cast("double").alias(c) for c in ("value", "upper", "lower")), "at")
    fed = fed.join(own, "cell", "left_anti").withColumn("version", F.lit(0).cast("long"))
    results = None
    for level in _levels(formulas, most):
        asked = fed.select(F.col("cell").alias("ref"), "value", "upper", "lower", "at", "version").join(level, "ref")
        out = asked.groupBy("cell").transformWithStateInPandas(_Inputs(), _OUT, "Append", "None")
        results = out if results is None else results.unionByName(out)
        fed = fed.unionByName(out.where("error is null").drop("error"))
    if results is None:
        raise FormulaError("no cell has a formula")
    return results
