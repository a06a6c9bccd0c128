"""Sheets as cells: A1 references, rectangles, cleaning, dense form, and propagation between cells."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.errors import DataError, FormulaError
from mensura.expr import formula as X
from mensura.scratch import saved

_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d+)$")
#: A cell reference that is neither part of a name nor a function's name.
CELL_REFERENCE = re.compile(r"(?<![A-Za-z0-9_.])(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d*)(?![A-Za-z0-9_(])")


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_cell(text: str) -> tuple[int, int]:
    """A1 to (row, column), from zero."""
    m = _CELL.match(text.strip())
    if not m or int(m[2]) < 1:
        raise DataError(f"not a cell: {text!r}")
    return int(m[2]) - 1, column_number(m[1])


@dataclass(frozen=True)
class Range:
    """A rectangle of cells, corners included, from zero."""

    top: int
    left: int
    bottom: int
    right: int
    sheet: str | None = None

    @classmethod
    def parse(cls, text: str) -> Range:
        sheet, _, ref = text.rpartition("!")
        a, _, b = ref.partition(":")
        (r1, c1), (r2, c2) = parse_cell(a), parse_cell(b or a)
        return cls(min(r1, r2), min(c1, c2), max(r1, r2), max(c1, c2), sheet.strip("'") or None)

    @property
    def shape(self) -> tuple[int, int]:
        return self.bottom - self.top + 1, self.right - self.left + 1

    @property
    def single(self) -> bool:
        return self.shape == (1, 1)

    def overlaps(self, o: Range) -> bool:
        return self.sheet == o.sheet and self.top <= o.bottom and o.top <= self.bottom and self.left <= o.right and o.left <= self.right

    def cells(self) -> list[str]:
        return [f"{column_letters(c)}{r + 1}" for r in range(self.top, self.bottom + 1) for c in range(self.left, self.right + 1)]


def input_kind(text: str) -> str:
    """number, cell, range or invalid."""
    t = text.strip()
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
        return "number"
    try:
        return "cell" if Range.parse(t).single else "range"
    except DataError:
        return "invalid"


# ---------------------------------------------------------------- tables of cells (row, col, value)


def read_range(cells: DataFrame, ref: str) -> DataFrame:
    r = Range.parse(ref)
    out = cells.where(F.col("row").between(r.top, r.bottom) & F.col("col").between(r.left, r.right))
    return out.where(F.col("sheet") == r.sheet) if r.sheet and "sheet" in cells.columns else out


def range_cells(spark, ref: str) -> DataFrame:
    """Every cell of a rectangle as rows, generated on the executors."""
    r = Range.parse(ref)
    h, w = r.shape
    return spark.range(h * w).select((F.floor(F.col("id") / w) + r.top).cast("int").alias("row"), (F.pmod("id", F.lit(w)) + r.left).cast("int").alias("col"))


def to_cells(df: DataFrame, order: Sequence[str | Column] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """A table as (row, col, value as text). Rows are numbered by ``order``, which must be total (see ``numbered``)."""
    columns = list(columns or df.columns)
    pick = F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)))
    return numbered(df, order).select(F.col("row").cast("int").alias("row"), F.explode(pick).alias("c")).select("row", "c.col", "c.value")


#: The low bits of ``monotonically_increasing_id`` count the rows of a task, the others number the task.
_ROW_BITS = 33


def in_order(df: DataFrame, order: Sequence[str | Column], task: str = "_p", row: str = "_k") -> DataFrame:
    """Rows dealt by ranges of ``order`` and sorted, with the number of their range and their place in it, from zero.

    The dealt rows are written to the shared folder once. Planned twice they could be dealt in two
    ways, as ranges are sampled and merged by what each plan reads, and numbers would not agree.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = F.col("_at")
    return saved(dealt).withColumns({task: F.shiftright(at, _ROW_BITS).cast("int"), row: at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_at")


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "row") -> DataFrame:
    """Adds the place from zero in a total order, as a long, without a single-partition window.

    One range shuffle and one written table; only the counts of its ranges are broadcast.
    """
    from pyspark.sql import Window

    task, inside, before = "_range_of_rows", "_row_in_range", "_rows_before"
    dealt = in_order(df, order, task, inside)
    counts = dealt.groupBy(task).agg(F.count("*").alias("_n"))  # one row for each range
    sums = counts.select(task, F.coalesce(F.sum("_n").over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    return dealt.join(F.broadcast(sums), task).withColumn(name, F.col(inside) + F.col(before)).drop(task, inside, before)


def clean_bounding_box(cells: DataFrame) -> DataFrame:
    """Drops empty rows before the first and after the last filled one, and empty columns after the last; the inside stays.

    Rows start again at zero.
    """
    filled = cells.where(F.col("value").isNotNull() & (F.trim(F.col("value").cast("string")) != ""))
    box = filled.agg(F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.max("col").alias("_c1"))  # one row
    out = cells.join(F.broadcast(box), F.col("row").between(F.col("_r0"), F.col("_r1")) & (F.col("col") <= F.col("_c1")))
    return out.withColumn("row", F.col("row") - F.col("_r0")).drop("_r0", "_r1", "_c1")


def truncate(cells: DataFrame, target: str) -> DataFrame:
    """Cells that fit into the target's shape; a single cell only says where to start."""
    r = Range.parse(target)
    if r.single:
        return cells
    h, w = r.shape
    return cells.where((F.col("row") < h) & (F.col("col") < w))


def place(cells: DataFrame, target: str) -> DataFrame:
    r = Range.parse(target)
    return truncate(cells, target).withColumns({"row": F.col("row") + r.top, "col": F.col("col") + r.left})


def dense(cells: DataFrame, width: int | None = None) -> DataFrame:
    """(row, values): every row from zero to the last, each an array of the full width, gaps null."""
    height, most = cells.agg(F.max("row"), F.max("col")).first()
    if height is None:
        return cells.sparkSession.createDataFrame([], "row int, values array<string>")
    width = width or most + 1
    by = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.col("value").cast("string")))).alias("_m"))
    rows = cells.sparkSession.range(height + 1).select(F.col("id").cast("int").alias("row"))
    get = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.try_element_at(F.col("_m"), c))
    return rows.join(by, "row", "left").select("row", F.when(F.col("_m").isNull(), F.array_repeat(F.lit(None).cast("string"), width)).otherwise(get).alias("values"))


def numeric_cells(cells: DataFrame) -> DataFrame:
    """Cells whose whole text is a finite number, as doubles."""
    from mensura.sources.files import number

    return cells.withColumn("value", number(F.col("value").cast("string"))).where(F.col("value").isNotNull())


def to_library(cells: DataFrame, name: str, values: str, uncertainties: str | None = None, unit: str = "", description: str = "", tags: str = "", source: str = "sheet", id_: str | None = None) -> DataFrame:
    """A range of a sheet as one row of the catalog: its numbers in reading order, tags parted by commas.

    Cells that are no numbers are left out. Uncertainties must be as many as values, else running
    the result is an error. One sequence is one row, as large as its range.
    """
    from mensura.operators import catalog

    def numbers(ref: str, out: str) -> DataFrame:
        rows = numeric_cells(read_range(cells, ref)).select(F.struct("row", "col", "value").alias("c"))
        return rows.agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["value"]).alias(out))

    both = numbers(values, "data")
    both = both.crossJoin(numbers(uncertainties, "uncertainties")) if uncertainties else both.withColumn("uncertainties", F.lit(None).cast("array<double>"))  # one row each
    wrong = F.size("uncertainties") != F.size("data")
    data = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("uncertainties and values differ in number")).cast("array<double>")).otherwise(F.col("data"))
    listed = [t.strip() for t in tags.split(",") if t.strip()]
    fixed = {"id": F.lit(id_) if id_ else F.uuid(), "name": F.lit(name), "description": F.lit(description), "tags": F.array(*map(F.lit, listed)).cast("array<string>"), "unit": F.lit(unit), "source": F.lit(source)}
    out = both.select(*(c.alias(k) for k, c in fixed.items()), data.alias("data"), "uncertainties", F.lit(False).alias("is_pinned"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("modified_at"))
    return out.select(*(n.split()[0] for n in catalog.SCHEMA.split(", ")))


# ---------------------------------------------------------------- references and propagation


def references(formula: str) -> list[str]:
    """Cells that a formula names, each once, without the names of functions such as LOG10( )."""
    return list(dict.fromkeys(f"{m[2].upper()}{m[4]}" for m in CELL_REFERENCE.finditer(formula)))


def shift(formula: str, rows: int, columns: int) -> str:
    """References moved as by autofill; parts behind ``$`` stay. Moves off the sheet are an error."""

    def moved(m):
        col = column_number(m[2]) + (0 if m[1] else columns)
        row = int(m[4]) + (0 if m[3] else rows)
        if col < 0 or row < 1:
            raise DataError(f"{m[0]} cannot move by {rows}, {columns}")
        return f"{m[1]}{column_letters(col)}{m[3]}{row}"

    return CELL_REFERENCE.sub(moved, formula)


def propagate_cells(cells: dict[str, dict]) -> dict[str, dict]:
    """Propagates uncertainty through a sheet's formulas, in order of dependence.

    ``cells``: reference -> {value, formula?, upper?, lower?, source?}. Referenced cells with bounds
    are variables, others constants (non-numbers 0). Cells whose bounds are ``manual`` keep them;
    bounds of formulas without uncertain inputs are cleared. For one sheet's few cells; a table of
    cells goes by ``cellgraph.propagate_table``, columns of rows by ``uncertainty.propagate``.
    """
    out = {k.upper(): dict(v) for k, v in cells.items()}
    state: dict[str, int] = {}
    order: list[str] = []

    def visit(k: str) -> None:
        todo = [(k, False)]
        while todo:
            c, done = todo.pop()
            if done:
                state[c] = 2
                order.append(c)
            elif state.get(c) == 1:
                raise FormulaError(f"{c} depends on itself")
            elif c in out and c not in state:
                state[c] = 1
                todo.append((c, True))
                for r in references(out[c].get("formula") or ""):
                    if state.get(r) == 1:
                        raise FormulaError(f"{r} depends on itself")
                    todo.append((r, False))

    for k in out:
        visit(k)
    for k in order:
        c = out[k]
        if not c.get("formula") or c.get("source") == "manual":
            continue
        refs = references(c["formula"])
        text = CELL_REFERENCE.sub(lambda m: f"{m[2]}{m[4]}", c["formula"].lstrip("="))
        e = X.parse(text, refs)
        numbers = {r.lower(): v if isinstance(v := out.get(r, {}).get("value"), (int, float)) else 0.0 for r in refs}
        live = [r for r in refs if out.get(r, {}).get("upper") is not None]
        c["value"] = float(X.to_numpy(e, numbers))
        if not live:
            for f in ("upper", "lower", "source"):
                c.pop(f, None)
            continue

        def sigma(bound):
            return sum((float(X.to_numpy(X.diff(e, r.lower()), numbers)) * bound(out[r])) ** 2 for r in live) ** 0.5

        c["upper"], c["source"] = sigma(lambda v: v["upper"]), "propagated"
        if any(out[r].get("lower") is not None for r in live):
            c["lower"] = sigma(lambda v: v["lower"] if v.get("lower") is not None else v["upper"])
        else:
            c.pop("lower", None)
    return out


# ---------------------------------------------------------------- validation


def validate_request(formula: str, inputs: dict[str, dict], output: str) -> list[str]:
    """What is wrong with a range-wise propagation request, in order: fields, ranges, overlap."""
    errors = []
    if not formula.strip():
        errors.append("a formula is needed")
    if not inputs:
        errors.append("a variable is needed")
    errors += [f"variable {n!r} lacks its range" for n, v in inputs.items() if not v.get("range")]
    if not output:
        errors.append("an output range is needed")
    if errors:
        return errors
    ranges = {}
    for n, ref in [*((n, v["range"]) for n, v in inputs.items()), *((f"σ({n})", v["sigma"]) for n, v in inputs.items() if v.get("sigma")), ("output", output)]:
        try:
            ranges[n] = Range.parse(ref)
        except DataError as e:
            errors.append(f"{n}: {e}")
    if errors:
        return errors
    errors += [f"output overlaps {n}" for n, r in ranges.items() if n != "output" and r.overlaps(ranges["output"])]
    sizes = {r.shape[0] for n, r in ranges.items() if n != "output"}
    if len(sizes) > 1:
        errors.append("ranges have different numbers of rows")
    return errors


def validation_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of counts: rows, and for each column nulls, blanks, non-numbers and non-finite values."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        d = text.try_cast("double")
        aggs += [
            F.count_if(text.isNull()).alias(f"{c}_null"),
            F.count_if(F.trim(text) == "").alias(f"{c}_blank"),
            F.count_if(text.isNotNull() & (F.trim(text) != "") & d.isNull()).alias(f"{c}_non_numeric"),
            F.count_if(F.isnan(d) | (F.abs(d) == float("inf"))).alias(f"{c}_non_finite"),
        ]
    return df.agg(*aggs)
