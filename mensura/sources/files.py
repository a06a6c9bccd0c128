"""Readers and writers: delimited text, Parquet, snapshots, and tables as HTML, Markdown and LaTeX."""

from __future__ import annotations

import gzip
import json
import os
import re
import struct
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.errors import DataError, FormatError
from mensura.scratch import saved, small

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
VERSION, LARGEST = 1, 100 * 1024 * 1024


@dataclass(frozen=True)
class Container:
    """The frame of a snapshot: eight bytes at its start, and the name in its JSON. Pass those of the
    application whose snapshots are read."""

    magic: bytes = b"MENSURA\x01"
    tag: str = "mensura"


def number(c: Column | str) -> Column:
    """The whole field as a finite double, else null: ``nan``, ``inf`` and ``1.5d`` are no numbers."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def resolve(path: str) -> str:
    """Local paths made canonical (and checked); anything with a scheme is Spark's to open."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return path
    out = os.path.realpath(path)
    if not os.path.exists(out):
        raise FormatError(f"no such file: {path}")
    return out


def _encoding(name: str | None) -> str:
    low = (name or "auto").lower()
    if low == "auto":
        return "auto"
    return "windows-1252" if low in ("latin1", "latin-1", "iso-8859-1", "cp1252", "windows-1252", "ansi") else "UTF-8" if low in ("utf8", "utf-8") else name


# What bytes 80 to 9F stand for in windows-1252, those without a sign left as they are.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([c]).decode("cp1252") if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(c) for c in range(0x80, 0xA0))


def _cp1252(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), _C1, _CP1252)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 (with or without mark) if every line of every file is, else windows-1252: one pass over the lines, of which one flag is read."""
    return "windows-1252" if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count() else "utf-8"


def _decoder(encoding: str):
    """Bytes to text in encodings that Spark's decode() lacks."""
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b).decode(encoding, "replace"))

    return F.pandas_udf(run, "string")


def _decoded(data: Column, encoding: str, legacy: Column | None = None) -> Column:
    """Bytes as text; ``auto`` takes windows-1252 where ``legacy`` holds (by default where the bytes are no UTF-8)."""
    text = F.make_valid_utf8(data.cast("string"))
    if encoding == "UTF-8":
        return text
    if encoding == "windows-1252":
        return _cp1252(data)
    if encoding == "auto":
        return F.when(~F.is_valid_utf8(data.cast("string")) if legacy is None else legacy, _cp1252(data)).otherwise(text)
    return _decoder(encoding)(data)


#: Encodings in which every byte 0A is a line's end.
_BY_LINE = ("UTF-8", "windows-1252", "auto")


def _lines(spark: SparkSession, path: str, encoding: str, header: bool = False) -> DataFrame:
    """(value): the lines of each file; with ``header`` without the first line of each that is not blank.

    Bytes are parted into lines first and decoded then. A file that ``auto`` finds with a line that
    is no UTF-8 is windows-1252 as a whole.
    """
    one_column = {"sep": "\u0001", "quote": "", "columnNameOfCorruptRecord": "whole", "mode": "PERMISSIVE", "header": header}

    def csv(name: str) -> Column | DataFrame:  # a line with the separator in it is kept as it stood
        rows = spark.read.format("csv").options(**one_column).option("encoding", name).schema("value string, whole string").load(path)
        return rows.select(F.coalesce("whole", "value").alias("value"), F.col("_metadata.file_path").alias("file"))

    if header:
        raw = csv("ISO-8859-1").select(F.encode(F.col("value"), "ISO-8859-1").alias("data"), "file")  # each byte is a sign
    else:
        raw = spark.read.text(path).select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"))
    if encoding != "auto":
        return raw.select(_decoded(F.col("data"), encoding).alias("value"))
    odd = spark.read.text(path).where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path").alias("_odd")).distinct()
    marked = raw.join(small(odd), F.col("file") == F.col("_odd"), "left")
    return marked.select(_decoded(F.col("data"), "auto", F.col("_odd").isNotNull()).alias("value"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(data, file, line): the lines of each file as bytes, numbered from 0 in the order of the file.

    Tasks read splits of files. A line's place in its split follows from the order in which the task
    read it, and splits are counted to tell where each begins. The lines are written once to the
    shared folder, as a second reading may be split in another way.
    """
    raw = spark.read.text(path).select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = saved(raw)
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # one row for each split
    starts = splits.select("file", "block", (F.coalesce(before, F.lit(0).cast("long")) - F.col("first")).alias("shift"))
    return rows.join(small(starts), ["file", "block"]).select("data", "file", (F.col("at") + F.col("shift")).alias("line"))


def read_delimited(spark: SparkSession, path: str, delimiter: str, skip_rows: int = 0, header: bool = False, encoding: str | None = None, numeric: Sequence[str] = ()) -> DataFrame:
    """Rows of text fields ``c0..cN`` (or header names); the columns in ``numeric`` become doubles.

    Fields may be quoted, quotes doubled; blank lines are dropped, short rows padded with nulls to
    the widest. The width is found first, by one pass over the text. With ``header`` the first line
    of each file, and no other, is one. Without ``encoding`` a file is UTF-8 if all its lines are,
    else windows-1252. ``skip_rows`` raw lines of each file are passed over: lines are numbered by
    file (``numbered_lines``, which writes them once), so files are split as usual. Only encodings such
    as UTF-16 make Spark read a file whole in one task.
    """
    if not delimiter:
        raise DataError("a delimiter is needed")
    d, enc = delimiter[0], _encoding(encoding)
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "^\ufeff", ""), r"\r$", "")
    if enc not in _BY_LINE:
        whole = spark.read.format("binaryFile").load(path).select(_decoded(F.col("content"), enc).alias("value"))
        every = F.split("value", r"\r?\n")
        rest = F.filter(F.slice(every, skip_rows + 1, F.greatest(F.lit(0), F.size(every) - skip_rows)), lambda x: F.trim(clean(x)) != "")
        files_ = whole.select(rest.alias("v"))
        heads = files_.select(F.get("v", F.lit(0)).alias("value")) if header else None
        lines = files_.select(F.explode(F.slice("v", 2, F.greatest(F.lit(0), F.size("v") - 1)) if header else "v").alias("value"))
    elif skip_rows:
        rows = numbered_lines(spark, path)
        odd = rows.where(~F.is_valid_utf8(F.col("data").cast("string"))).select(F.col("file").alias("_odd")).distinct() if enc == "auto" else None
        marked = rows if odd is None else rows.join(small(odd), F.col("file") == F.col("_odd"), "left")
        text = _decoded(F.col("data"), enc, None if odd is None else F.col("_odd").isNotNull())
        lines = marked.where(F.col("line") >= skip_rows).select("file", "line", text.alias("value")).where(F.trim(clean("value")) != "")
        if header:
            tops = lines.groupBy("file").agg(F.min("line").alias("_top"))
            lines = lines.join(small(tops), "file")
            heads, lines = lines.where(F.col("line") == F.col("_top")).select("value"), lines.where(F.col("line") > F.col("_top"))
        lines = lines.select("value")
    else:
        lines = _lines(spark, path, enc, header)
        heads = _lines(spark, path, enc) if header else None
    tidy = lambda rows: rows.select(clean("value").alias("value")).where(F.trim("value") != "")
    lines = tidy(lines)
    first = tidy(heads).first() if header else None
    bare = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    count = F.length(bare) - F.length(F.replace(bare, F.lit(d))) + 1
    width = lines.agg(F.max(count)).first()[0] or 0
    if first:
        title = spark.createDataFrame([first], "value string")
        width = max(width, title.select(count).first()[0])
    if not width:
        return spark.createDataFrame([], T.StructType([]))
    schema = ", ".join(f"c{i} string" for i in range(width))
    fields = F.from_csv("value", schema, {"sep": d, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    out = lines.select(fields.alias("r")).select("r.*")
    if first:
        out = out.toDF(*((v or "").strip() or f"c{i}" for i, v in enumerate(title.select(fields.alias("r")).select("r.*").first())))
    return out.withColumns({c: number(F.col(f"`{c}`")) for c in numeric}) if numeric else out


def read_csv(spark, path, **kw) -> DataFrame:
    return read_delimited(spark, path, ",", **kw)


def read_tsv(spark, path, **kw) -> DataFrame:
    return read_delimited(spark, path, "\t", **kw)


def read_txt(spark, path, delimiter: str, **kw) -> DataFrame:
    return read_delimited(spark, path, delimiter, **kw)


def sheet_values(df: DataFrame) -> DataFrame:
    """Every column flattened as a sheet shows it: numbers as double (non-finite 0), bytes as hex, times as numbers, nested as JSON."""

    def one(f: T.StructField) -> Column:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.FloatType, T.DoubleType)):
            d = c.cast("double")
            return F.when(F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)
        if isinstance(t, T.IntegralType):
            return c.cast("double")
        if isinstance(t, T.BinaryType):
            return F.concat(F.lit("0x"), F.lower(F.hex(c)))
        if isinstance(t, T.TimestampType):
            return F.unix_micros(c).cast("double")
        if isinstance(t, T.TimestampNTZType):
            return F.unix_micros(c.cast("timestamp")).cast("double")
        if isinstance(t, T.DateType):
            return F.unix_date(c).cast("double")
        return F.to_json(c) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string") if isinstance(t, T.DecimalType) else c

    return df.select(*(one(f).alias(f.name) for f in df.schema))


def guess_delimiter(spark: SparkSession, path: str, skip_rows: int = 0) -> str:
    """Tab, semicolon or comma: the most frequent on the first data line, earlier ones winning ties."""
    rows = [r.value for r in spark.read.text(path).where(F.trim("value") != "").limit(skip_rows + 1).collect()]
    line = rows[-1] if rows else ""
    return max("\t;,", key=lambda d: (line.count(d), -"\t;,".index(d)))


def read_numeric(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, decimal_comma: bool = False, skip_rows: int = 0) -> DataFrame:
    """The strict reader for fits: equal widths, every field a finite number, or an error.

    Columns are named by the header, else ``Column N``.
    """
    d = delimiter or guess_delimiter(spark, path, skip_rows)
    raw = read_delimited(spark, path, d, skip_rows=skip_rows, header=header)
    names = [c if header else f"Column {i + 1}" for i, c in enumerate(raw.columns)]
    raw = raw.toDF(*(f"c{i}" for i in range(len(names))))
    fix = (lambda c: F.replace(c, F.lit(","), F.lit("."))) if decimal_comma else (lambda c: c)
    values = [number(fix(F.col(c))) for c in raw.columns]
    strict = [F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit(f"column {n}: not a number: "), F.coalesce(F.col(c), F.lit("nothing")))).cast("double")) for v, c, n in zip(values, raw.columns, names)]
    return raw.select(*(v.alias(n) for v, n in zip(strict, names)))


def metadata(spark: SparkSession, path: str, delimiter: str | None = None) -> dict:
    """Size, extension, non-blank lines, and the most columns by plain splitting; Parquet has no line counts."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext == "parquet":
        return {"size": size, "extension": ext, "rows": None, "columns": None}
    d = delimiter or {"csv": ",", "tsv": "\t"}.get(ext)
    if not d:
        raise DataError("a delimiter is needed for this extension")
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows, cols = lines.agg(F.count("*"), F.max(F.size(F.split("value", re.escape(d))))).first()
    return {"size": size, "extension": ext, "rows": rows, "columns": cols or 0}


# ---------------------------------------------------------------- snapshots


def _local(path: str) -> str:
    return path.removeprefix("file://")


def write_snapshot(workbook: dict, path: str, container: Container = Container()) -> None:
    """Magic, version, then gzip JSON. A snapshot is one workbook of at most 100 MB, so the driver writes it."""
    body = gzip.compress(json.dumps({"format": container.tag, "workbook": workbook}, separators=(",", ":")).encode(), mtime=0)
    with open(_local(path), "wb") as f:
        f.write(container.magic + struct.pack("<I", VERSION) + body)


def read_snapshot(path: str, container: Container = Container()) -> dict:
    if os.path.getsize(_local(path)) > LARGEST:
        raise FormatError("snapshot is larger than 100 MB")
    with open(_local(path), "rb") as f:
        return parse_snapshot(f.read(), container)


def parse_snapshot(data: bytes, container: Container = Container()) -> dict:
    n = len(container.magic)
    if data[:n] != container.magic:
        raise FormatError("not a snapshot of this kind")
    if len(data) < n + 4 or struct.unpack("<I", data[n : n + 4])[0] != VERSION:
        raise FormatError("unknown snapshot version")
    try:
        body = json.loads(gzip.decompress(data[n + 4 :]))
    except (OSError, ValueError, EOFError) as e:
        raise FormatError(f"damaged snapshot: {e}") from None
    if body.get("format") != container.tag or "workbook" not in body:
        raise FormatError("snapshot lacks its workbook")
    return body["workbook"]


CELLS = "sheet_id string, sheet_name string, row int, col int, value string, formula string"


def snapshot_cells(spark: SparkSession, path: str, container: Container = Container()) -> DataFrame:
    """(sheet_id, sheet_name, row, col, value, formula) of every snapshot below ``path``; one task reads each file.

    A snapshot above the bound is an error, as for ``read_snapshot``.
    """
    def run(parts):
        for pdf in parts:
            rows = []
            for data in pdf["content"]:
                book = parse_snapshot(data, container)
                for sid, sheet in book.get("sheets", {}).items():
                    for r, cols in (sheet.get("cellData") or {}).items():
                        for c, cell in (cols or {}).items():
                            v = cell.get("v")
                            rows.append((sid, sheet.get("name"), int(r), int(c), None if v is None else str(v).lower() if isinstance(v, bool) else str(v), cell.get("f")))
            yield pd.DataFrame(rows, columns=["sheet_id", "sheet_name", "row", "col", "value", "formula"])

    found = spark.read.format("binaryFile").load(path)
    small = F.when(F.col("length") <= LARGEST, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("snapshot is larger than 100 MB: "), F.col("path"))).cast("binary"))
    return found.select(small.alias("content")).mapInPandas(run, CELLS)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each text file, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


# ---------------------------------------------------------------- writers


def _text(c: str, t: T.DataType) -> Column:
    col = F.col(f"`{c}`")
    return F.to_json(col) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else col.cast("string")


def text_rows(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """(line): fields quoted where they hold the delimiter, quotes or line breaks; null is empty."""
    if not delimiter:
        raise DataError("a delimiter is needed")
    d = delimiter[0]

    def one(f):
        s = _text(f.name, f.dataType)
        quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(s.isNull(), "").when(s.contains(d) | s.rlike('["\r\n]'), quoted).otherwise(s)

    return df.select(F.concat_ws(d, *(one(f) for f in df.schema)).alias("line"))


def write_text(df: DataFrame, path: str, delimiter: str = ",", header: bool = False) -> None:
    """Part files of CRLF lines, written where the rows are; with a header each part has it, and an empty table one part."""
    line = text_rows(df, delimiter)
    if header:
        names = df.sparkSession.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))])
        head = text_rows(names, delimiter).first().line
        if line.isEmpty():
            line = df.sparkSession.range(0, 1, 1, 1).select(F.lit(head).alias("line"))
        else:  # the first row of a task has a number without low bits
            first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
            line = line.select(F.when(first, F.concat(F.lit(head + "\r\n"), F.col("line"))).otherwise(F.col("line")).alias("line"))
    line.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_parquet(df: DataFrame, path: str, as_text: bool = False) -> None:
    """Typed, or with ``as_text`` every column as text named ``column_i``."""
    out = df.select(*(_text(f.name, f.dataType).alias(f"column_{i}") for i, f in enumerate(df.schema, 1))) if as_text else df
    out.write.mode("overwrite").parquet(path)


def _escaped(c: Column, table: dict[str, str]) -> Column:
    """One pass over the text, so an escape's own signs are never escaped again."""
    out = F.transform(F.split(c, ""), lambda ch: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), ch), ch))
    return F.when(c.rlike("[" + "".join(re.escape(k) for k in table) + "]"), F.array_join(out, "")).otherwise(c)


# Escapes by format.
HTML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
LATEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "%": r"\%", "#": r"\#", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def _cells(df: DataFrame, table: dict[str, str]) -> list[Column]:
    return [F.coalesce(_escaped(_text(f.name, f.dataType), table), F.lit("")) for f in df.schema]


def html_rows(df: DataFrame) -> DataFrame:
    cells = [F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in _cells(df, HTML)]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def markdown_rows(df: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.replace(_text(f.name, f.dataType), F.lit("|"), F.lit(r"\|")), F.lit("")) for f in df.schema]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def latex_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.concat_ws(" & ", *_cells(df, LATEX)), F.lit(r" \\")).alias("line"))


def _frame(df: DataFrame, kind: str) -> tuple[str, DataFrame, str]:
    """Header, rows and footer of a document."""
    rows = {"html": html_rows, "markdown": markdown_rows, "tex": latex_rows}[kind](df)
    if kind == "html":
        return '<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body><table>\n', rows, "\n</table></body></html>\n"
    if kind == "tex":
        return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n\\hline\n", rows, "\n\\hline\n\\end{tabular}\n"
    return "", rows, "\n"


def document(df: DataFrame, kind: str, most: int = 100_000) -> str:
    """A whole small document as text: header and footer around the rows. Meant for reports.

    More than ``most`` rows are an error, as they would gather on the driver; ``write_document`` has no such bound.
    """
    head, rows, foot = _frame(df, kind)
    lines = rows.limit(most + 1).collect()
    if len(lines) > most:
        raise DataError(f"more than {most} rows; use write_document")
    return head + "\n".join(r.line for r in lines) + foot


def write_document(df: DataFrame, kind: str, path: str) -> None:
    """A document of any size as text parts: put together in the order of their names they are the document."""
    head, rows, foot = _frame(df, kind)
    line = lambda s: df.sparkSession.range(0, 1, 1, 1).select(F.lit(s.strip("\n")).alias("line"))
    for s, before in ((head, True), (foot, False)):
        if s.strip("\n"):
            rows = line(s).unionByName(rows) if before else rows.unionByName(line(s))
    rows.write.mode("overwrite").text(path)


def _plain(text: str | None) -> str:
    return (text or "").replace(",", ";").replace('"', "'")


def sequences_wide(points: DataFrame, names: Sequence[str]) -> DataFrame:
    """The library's CSV layout: a column for each sequence (and ``_uncertainty``), by position, short ones padded."""
    from mensura.operators.catalog import fit_input

    wide = fit_input(points, names)
    cols = [F.col(f"`{c}`").alias(_plain(c[2:-1]) + "_uncertainty" if c.startswith("σ(") else _plain(c)) for c in wide.columns if c != "idx"]
    return wide.orderBy("idx").select(*cols)


def export_sequences(sequences: DataFrame, ids: Sequence[str], path: str) -> None:
    """Sequences of the catalog as one wide CSV, by position, short ones padded, in the order of ``ids``.

    Each column's header is ``[name,unit,description,tags]`` (tags joined by ``|``), and that of its
    uncertainties ``[name_uncertainty,unit,Uncertainty values for name,tags]``, where there are any;
    commas in these become semicolons and quotes apostrophes. Only the chosen sequences' names reach
    the driver. Unknown ids are passed over; if none is known it is an error.
    """
    from mensura.operators.catalog import fit_input, to_long

    own = sequences.where(F.col("id").isin(list(ids)))
    info = {r.id: r for r in own.select("id", "name", "unit", "description", "tags", F.col("uncertainties").isNotNull().alias("u")).collect()}
    known = [i for i in ids if i in info]
    if not known:
        raise DataError("none of these sequences exists")
    wide = fit_input(to_long(own), known, name="id").orderBy("idx")
    header, cells = [], []
    for i in known:
        r = info[i]
        name, unit, tags = _plain(r.name), _plain(r.unit), _plain("|".join(r.tags or []))
        header.append(f"[{name},{unit},{_plain(r.description)},{tags}]")
        cells.append(F.coalesce(F.col(f"`{i}`").cast("string"), F.lit("")))
        if r.u:
            header.append(f"[{name}_uncertainty,{unit},Uncertainty values for {name},{tags}]")
            cells.append(F.coalesce(F.col(f"`σ({i})`").cast("string"), F.lit("")))
    rows = wide.select(F.concat_ws(",", *cells).alias("line"))
    head = sequences.sparkSession.range(0, 1, 1, 1).select(F.lit(",".join(header)).alias("line"))
    head.unionByName(rows).write.mode("overwrite").text(path)


def read(spark: SparkSession, format: str, path: str, **options) -> DataFrame:
    """Import by format name."""
    kinds = {"csv": read_csv, "tsv": read_tsv, "txt": read_txt, "parquet": lambda s, p: s.read.parquet(p), "snapshot": snapshot_cells}
    if format not in kinds:
        raise FormatError(f"unknown import format {format!r}")
    return kinds[format](spark, path, **options)


def write(df: DataFrame, format: str, path: str, **options) -> None:
    """Export by format name; html, markdown and tex write rows as text parts."""
    if format in ("csv", "tsv", "txt"):
        d = {"csv": ",", "tsv": "\t"}.get(format) or options.pop("delimiter", "")
        return write_text(df, path, d, **options)
    if format == "parquet":
        return write_parquet(df, path, **options)
    rows = {"html": html_rows, "markdown": markdown_rows, "tex": latex_rows}.get(format)
    if not rows:
        raise FormatError(f"unknown export format {format!r}")
    rows(df).write.mode("overwrite").text(path)


def unique_names(existing: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Sheet names for an append: a taken one becomes ``X (n)`` with the smallest free n."""
    taken, out = set(existing), []
    for w in wanted:
        name, n = w, 1
        while name in taken:
            name, n = f"{w} ({n})", n + 1
        taken.add(name)
        out.append(name)
    return out


def _file_system(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, target: str) -> dict[str, list]:
    """Appends that are committed but not all in place: token -> [[name, staged folder], ...]."""
    path, fs = _file_system(spark, target)
    log = path(f"{target.rstrip('/')}.appends")
    found = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
    return {n[:-5]: json.loads(spark.read.text(f"{log}/{n}").first().value) for n in found if n.endswith(".json")}


def _sheet_names(spark: SparkSession, target: str) -> list[str]:
    path, fs = _file_system(spark, target)
    return sorted(s.getPath().getName() for s in fs.listStatus(path(target))) if fs.exists(path(target)) else []


def _place_sheet(spark: SparkSession, target: str, name: str, staged: str) -> None:
    path, fs = _file_system(spark, target)
    if fs.exists(path(staged)):  # else it is in place already
        free = unique_names(_sheet_names(spark, target), [name])[0]  # taken meanwhile only if two appends raced
        if not fs.rename(path(staged), path(f"{target}/{free}")):
            raise FormatError(f"could not place sheet {name}")


def finish_appends(spark: SparkSession, target: str) -> None:
    """Puts the sheets of committed appends in place that a lost driver has left, and forgets the appends."""
    path, fs = _file_system(spark, target)
    log = f"{target.rstrip('/')}.appends"
    for token, sheets in _committed(spark, target).items():
        fs.mkdirs(path(target))
        for name, staged in sheets:
            _place_sheet(spark, target, name, staged)
        fs.delete(path(f"{log}/{token}.json"), False)
        fs.delete(path(f"{log}/{token}"), True)
    if fs.exists(path(log)) and not fs.listStatus(path(log)):
        fs.delete(path(log), True)


def append_sheets(spark: SparkSession, target: str, sheets: dict[str, DataFrame]) -> list[str]:
    """All sheets or none, at any moment: returns their names (see ``unique_names``).

    Each sheet is written to a staging folder of this append's own. One rename of a manifest, which
    names them all, commits it; then they are renamed into place. A driver lost before the commit
    leaves nothing that readers see; one lost after it leaves the manifest, which ``read_sheets``
    follows and ``finish_appends``, or the next append, carries out.
    """
    finish_appends(spark, target)
    path, fs = _file_system(spark, target)
    names = unique_names(_sheet_names(spark, target), list(sheets))
    log, token = f"{target.rstrip('/')}.appends", uuid.uuid4().hex
    staged = [[n, f"{log}/{token}/{k}"] for k, n in enumerate(names)]
    try:
        for (_, place), df in zip(staged, sheets.values()):
            df.write.parquet(place)
        out = fs.create(path(f"{log}/{token}.tmp"))
        out.writeBytes(json.dumps(staged))  # ASCII
        out.close()
        if not fs.rename(path(f"{log}/{token}.tmp"), path(f"{log}/{token}.json")):
            raise FormatError("could not commit the sheets")
    except BaseException:
        fs.delete(path(f"{log}/{token}.tmp"), False)
        fs.delete(path(f"{log}/{token}"), True)
        raise
    finish_appends(spark, target)
    return names


def read_sheets(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The sheets of a folder by name: those in place, and those of committed appends wherever they are."""
    path, fs = _file_system(spark, target)
    at = {n: f"{target}/{n}" for n in _sheet_names(spark, target)}
    for sheets in _committed(spark, target).values():
        at |= {n: place for n, place in sheets if fs.exists(path(place))}
    return {n: spark.read.parquet(place) for n, place in sorted(at.items())}
