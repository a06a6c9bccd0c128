"""Edits of cells as a stream: what is computed last equals the sheet computed from the newest edits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mensura.errors import FormulaError
from mensura.operators import cellgraph
from mensura.streaming import edits

FORMULAS = [("b1", "=A1*2+$A$2"), ("C1", "=B1^2 - a3"), ("D1", "=C1+B1/A1"), ("E1", " "), ("F1", None), ("G1", "=A9+1")]


def _run(spark, tmp_path, batches, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / name)
    q = None
    formulas = spark.createDataFrame(FORMULAS, "cell string, formula string")
    out = str(tmp_path / f"{name}-out")
    for rows in batches:  # a query is started anew for each, from its checkpoint
        spark.createDataFrame(rows, edits.EDIT).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(edits.EDIT).parquet(src)
        q = edits.live_cells(stream, formulas).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(out)
        q.awaitTermination()
    return spark.read.parquet(out)


def test_late_edits(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rng = random.Random(4)
    rows = [(rng.choice(["A1", "$a$2", "A3", " a9 "]), round(rng.uniform(1, 5), 3), rng.choice([0.1, 0.2, None]), rng.choice([None, 0.05]), at(s)) for s in rng.sample(range(50), 30)]
    rows += [("A1", 2.0, 0.1, None, at(55)), ("A1", 3.0, 0.1, None, at(55)), (None, 1.0, None, None, at(56)), ("B1", 99.0, None, None, at(57)), ("A2", 9.0, None, None, None)]
    rng.shuffle(rows)
    got = _run(spark, tmp_path, [rows[:12], rows[12:13], rows[13:]], "late")
    last = {r.cell: r for r in got.groupBy("cell").agg(F.max_by(F.struct("*"), "version").alias("r")).select("r.*").collect()}
    newest = {}
    for c, v, u, low, t in rows:
        c = c and c.strip().upper().replace("$", "")
        if c and c != "B1" and t and (c not in newest or (t, v) > newest[c][0]):
            newest[c] = ((t, v), v, u, low)
    cells = spark.createDataFrame([(c, v, None, u, low, None) for c, (_, v, u, low) in newest.items()] + [(c, None, f, None, None, None) for c, f in FORMULAS if f and f.strip()], "cell string, value double, formula string, upper double, lower double, source string")
    want = {r.cell: r for r in cellgraph.propagate_table(cells).where("formula is not null").collect()}
    assert last.keys() == want.keys() == {"B1", "C1", "D1", "G1"}
    for c, w in want.items():
        g = last[c]
        assert g.error is None and g.value == pytest.approx(w.value) and (g.upper, g.lower) == (pytest.approx(w.upper) if w.upper is not None else None, pytest.approx(w.lower) if w.lower is not None else None), c


def test_cycles_are_errors(spark):
    stream = spark.readStream.format("rate").load().select(F.lit("A1").alias("cell"), F.lit(1.0).alias("value"), F.lit(None).alias("upper"), F.lit(None).alias("lower"), F.col("timestamp").alias("at"))
    with pytest.raises(FormulaError, match="depend on themselves"):
        edits.live_cells(stream, spark.createDataFrame([("B1", "=C1"), ("C1", "=B1+A1")], "cell string, formula string"), 3)
