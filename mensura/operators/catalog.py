"""The sequence catalog: long and wide forms, search, paging, statistics, tags, changes."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.errors import DataError
from mensura.scratch import same_keys, small

# The data model's columns.
SCHEMA = "id string, name string, description string, tags array<string>, unit string, source string, data array<double>, uncertainties array<double>, is_pinned boolean, created_at timestamp, modified_at timestamp"
#: Columns of a listing: the arrays stay unread.
LISTED = ("id", "name", "description", "tags", "unit", "source", "is_pinned", "created_at", "modified_at")


def to_long(sequences: DataFrame) -> DataFrame:
    """(id, idx, value, sigma): the analytic form. Missing uncertainties are null."""
    zipped = F.arrays_zip(F.col("data").alias("value"), F.coalesce("uncertainties", F.array().cast("array<double>")).alias("sigma"))
    return sequences.select("id", F.posexplode(zipped).alias("idx", "v")).select("id", "idx", "v.value", "v.sigma")


def to_wide(points: DataFrame, keys: Sequence[str] = ("id",), idx: str = "idx", value: str = "value", sigma: str | None = "sigma") -> DataFrame:
    """Arrays again, ordered by index: one row for each key, as large as its sequence."""
    s = F.col(sigma) if sigma else F.lit(None).cast("double")
    rows = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("idx"), F.col(value).cast("double").alias("v"), s.alias("s"))))
    out = points.groupBy(*keys).agg(rows.alias("_r"), F.count(s).alias("_n"))
    return out.select(*keys, F.transform("_r", lambda r: r["v"]).alias("data"), F.when(F.col("_n") > 0, F.transform("_r", lambda r: r["s"])).alias("uncertainties"))


# ---------------------------------------------------------------- filters


def query_tokens(query: str) -> list[str]:
    """Words of a search, without signs other than ``_``; an underscore parts words as in the index."""
    kept = ("".join(c for c in w if c.isalnum() or c == "_") for w in query.split())
    return [t.lower() for w in kept for t in w.split("_") if t]


def text_match(columns: Sequence[str | Column], query: str) -> Column:
    """Every token of the query starts a word in some column."""
    text = F.lower(F.concat_ws(" ", *columns))
    parts = [text.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(t)}") for t in query_tokens(query)]
    return functools.reduce(operator.and_, parts) if parts else F.lit(False)


def name_like(name: str | Column, query: str) -> Column:
    """The name holds the query; ``%`` and ``_`` in it are wildcards, case does not count."""
    name = F.col(name) if isinstance(name, str) else name
    return F.lower(name).like(f"%{query.strip().lower()}%".replace("\\", "\\\\"))


def has_tags(tags: str, wanted: Sequence[str], substring: bool = False) -> Column:
    """All tags are members; with ``substring`` each only has to occur in some tag."""
    test = (lambda w: F.exists(tags, lambda t: t.contains(w))) if substring else (lambda w: F.array_contains(tags, w))
    return functools.reduce(operator.and_, map(test, wanted)) if wanted else F.lit(True)


def search(sequences: DataFrame, query: str | None = None, tags: Sequence[str] = (), source: str | None = None, substring_tags: bool = False) -> DataFrame:
    """The conjunction of the given clauses; without any, everything."""
    out = sequences
    if query and query.strip():
        either = name_like("name", query)
        if query_tokens(query):
            either = text_match(["name", "description", F.concat_ws(" ", "tags"), "source"], query) | either
        out = out.where(F.coalesce(either, F.lit(False)))
    if tags:
        out = out.where(F.coalesce(has_tags("tags", tags, substring_tags), F.lit(False)))
    return out.where(F.col("source") == source) if source else out


ORDERS = {"name": "name", "created": "created_at", "modified": "modified_at", "size": "size"}


def page(sequences: DataFrame, sort: str = "modified", descending: bool = True, number: int = 0, size: int = 50) -> tuple[dict, DataFrame]:
    """(totals, rows): pinned first, then the sort key, ties by id. Page and size are clamped.

    The totals are one aggregate; the rows are a top-k of the listed columns, not a full sort.
    """
    if sort not in ORDERS:
        raise DataError(f"unknown order {sort!r}")
    total, pinned = sequences.agg(F.count("*"), F.count_if("is_pinned")).first()
    size = max(1, size)
    pages = -(-total // size)
    number = min(max(0, number), max(0, pages - 1))
    key = F.size("data") if sort == "size" else F.col(ORDERS[sort])
    rows = sequences.orderBy(F.desc("is_pinned"), key.desc() if descending else key.asc(), "id").offset(number * size).limit(size).select(*LISTED)
    return {"total": total, "pinned": pinned, "page": number, "page_size": size, "total_pages": pages, "has_next": number + 1 < pages, "has_prev": number > 0}, rows


def write_listing(sequences: DataFrame, path: str, sort: str = "modified", descending: bool = True) -> None:
    """Writes the listing in the order of ``page``, numbered from 0 (``place``): sorted files whose bounds Parquet keeps."""
    from mensura.operators.sheet import numbered

    if sort not in ORDERS:
        raise DataError(f"unknown order {sort!r}")
    key = F.size("data") if sort == "size" else F.col(ORDERS[sort])
    rows = sequences.select(*LISTED, key.alias("_key"))
    placed = numbered(rows, [F.desc("is_pinned"), F.desc("_key") if descending else F.asc("_key"), F.asc("id")], "place").drop("_key")
    placed.repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)


def read_page(spark: SparkSession, path: str, number: int = 0, size: int = 50) -> tuple[dict, DataFrame]:
    """(totals, rows) of a page of a written listing, as ``page`` gives them: a range of places, pushed down to the scan, however far back."""
    listing = spark.read.parquet(path)
    total, pinned = listing.agg(F.count("*"), F.count_if("is_pinned")).first()
    size = max(1, size)
    pages = -(-total // size)
    number = min(max(0, number), max(0, pages - 1))
    rows = listing.where((F.col("place") >= number * size) & (F.col("place") < (number + 1) * size)).orderBy("place").select(*LISTED)
    return {"total": total, "pinned": pinned, "page": number, "page_size": size, "total_pages": pages, "has_next": number + 1 < pages, "has_prev": number > 0}, rows


# ---------------------------------------------------------------- aggregates


def statistics(points: DataFrame, keys: Sequence[str] = ("id",), value: str = "value", sigma: str | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std_dev (population), min, max, median, has_uncertainties by key.

    Minimum and maximum pass over NaN, the mean does not. ``exact=False`` takes an approximate
    median, whose memory does not grow with the group; ``selection.exact_quantiles`` has both.
    """
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v), v)
    return points.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.min(finite).alias("min"), F.max(finite).alias("max"),
        (F.median(v) if exact else F.percentile_approx(v, 0.5, 10000)).alias("median"), (F.count(sigma) > 0 if sigma else F.lit(False)).alias("has_uncertainties"),
    )


def sequence_statistics(sequences: DataFrame) -> DataFrame:
    """The same by row of the catalog; an empty sequence has zeros."""
    stats = statistics(to_long(sequences))
    out = sequences.select("id", (F.size("uncertainties") > 0).alias("_u")).join(stats.drop("has_uncertainties"), "id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("mean", "std_dev", "min", "max", "median")}
    return out.withColumns({"count": F.coalesce("count", F.lit(0)), **zero, "has_uncertainties": F.coalesce("_u", F.lit(False))}).drop("_u")


def all_tags(sequences: DataFrame, tags: str = "tags") -> DataFrame:
    return sequences.select(F.explode(tags).alias("tag")).distinct().orderBy("tag")


# ---------------------------------------------------------------- joins by position


def positions(points: DataFrame, keys: Sequence[str], order: Sequence[str], idx: str = "idx") -> DataFrame:
    """Adds the place of each row in its key's order, from zero; no key's rows meet in one task.

    ``keys`` and ``order`` together must be a total order; null keys are a key. Rows are numbered all together, and the first number
    of each key is taken away.
    """
    from mensura.operators.sheet import numbered

    rows = numbered(points, [*keys, *order], "_place")
    first = rows.groupBy(*keys).agg(F.min("_place").alias("_first"))
    return same_keys(rows, small(first), list(keys)).withColumn(idx, F.col("_place") - F.col("_first")).drop("_place", "_first")


def zip_full(left: DataFrame, right: DataFrame, idx: str = "idx", names: tuple[str, str] = ("left_value", "right_value"), value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Two long sequences side by side, the shorter padded with nulls; with ``keys`` those of each key."""
    a, b = (d.select(*keys, idx, F.col(value).alias(n)) for d, n in zip((left, right), names))
    return a.join(b, [*keys, idx], "full")


def zip_strict(sequences: DataFrame) -> DataFrame:
    """Long form of sequences whose uncertainties must be as many as their values; others raise."""
    checked = F.when(F.col("uncertainties").isNull() | (F.size("uncertainties") == F.size("data")), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("lengths differ in sequence "), "id")).cast("array<double>"))
    return to_long(sequences.withColumn("data", checked))


def fit_input(points: DataFrame, names: Sequence[str], name: str = "name", idx: str = "idx", value: str = "value", sigma: str | None = "sigma") -> DataFrame:
    """Columns by name (and ``σ(name)`` where uncertainties exist) by index, for given names."""
    aggs = [F.first(value, ignorenulls=True).alias("v")] + ([F.first(sigma, ignorenulls=True).alias("s")] if sigma else [])
    wide = points.groupBy(idx).pivot(name, list(names)).agg(*aggs)
    if not sigma:
        return wide
    return wide.select(idx, *(c for n in names for c in (F.col(f"`{n}_v`").alias(n), F.col(f"`{n}_s`").alias(f"σ({n})"))))


def uncertainty_column(columns: Sequence[str], name: str) -> str | None:
    """The column that looks like the uncertainty of ``name``, by the usual spellings."""
    low = {c.lower(): c for c in columns}
    return next((low[k] for k in (f.format(name.lower()) for f in ("σ({})", "sigma({})", "unc({})", "δ{}", "d{}")) if k in low), None)


# ---------------------------------------------------------------- changes


def insert(catalog: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog with the valid rows, rejected rows with ``error``). A failing row stops no other."""
    error = (
        F.when(F.col("id").isNull() | (F.col("id") == ""), "missing id")
        .when(F.col("name").isNull() | (F.trim("name") == ""), "missing name")
        .when(F.col("data").isNull(), "missing data")
        .when(F.col("uncertainties").isNotNull() & (F.size("uncertainties") != F.size("data")), "uncertainties differ in length")
    )
    judged = rows.join(catalog.select("id", F.lit(True).alias("_there")), "id", "left").withColumn("error", F.when(F.col("_there"), "id exists").otherwise(error)).drop("_there")
    return catalog.unionByName(judged.where("error is null").select(catalog.columns)), judged.where("error is not null")


def upsert(catalog: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows replace those of the same key, and are added otherwise."""
    return catalog.join(rows.select(key), key, "left_anti").select(catalog.columns).unionByName(rows.select(catalog.columns))


def update(catalog: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Partial rows: non-null fields of ``changes`` (unique by key) replace those of the catalog."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    out = catalog.join(renamed, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(catalog.columns)


def pin(catalog: DataFrame, ids: Sequence[str], pinned: bool = True) -> DataFrame:
    return catalog.withColumn("is_pinned", F.when(F.col("id").isin(list(ids)), pinned).otherwise(F.col("is_pinned")))


def delete(catalog: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return catalog.join(ids.select(key), key, "left_anti")


def duplicate(catalog: DataFrame, id_: str, new_id: str, suffix: str = " (copy)") -> DataFrame:
    copy = catalog.where(F.col("id") == id_).withColumns({"id": F.lit(new_id), "name": F.concat("name", F.lit(suffix)), "is_pinned": F.lit(False)})
    return catalog.unionByName(copy.select(catalog.columns))
