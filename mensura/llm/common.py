"""Helpers shared by the operators: shared-folder tables, Arrow batch maps, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased, on UTF-8 bytes: other bytes become a blank.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: A-Z lower-cased, on UTF-8 bytes.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Remembered(dict):
    """A bounded memo of ``make(key)``: two generations of ``most`` short keys; a lookup of a known key is a plain dict's.

    When the younger is full it becomes the older, which is let go; what is used lives on.
    """

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[key] = out
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("mensura.scratch.dir", None)
    if not top:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="mensura-")
        spark.conf.set("mensura.scratch.dir", top)
    return f"{top.rstrip('/')}/mensura-{sc.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a table that ``saved`` wrote, by Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch that are turned into Python objects at once; a longer text goes by itself.
PART_BYTES = 8 << 20


def parts_of(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, halved until a part holds ``most`` bytes at most, or one row."""
    todo = [batch]
    while todo:
        b = todo.pop()
        if b.num_rows > 1 and b.nbytes > most:
            half = b.num_rows // 2
            todo += [b.slice(half), b.slice(0, half)]
        elif b.num_rows:
            yield b


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches joined to about ``most`` bytes, for work whose cost is by batch."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_batches(
    df: DataFrame,
    columns: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list]],
    gather: int = 0,
    part: int = PART_BYTES,
) -> DataFrame:
    """Arrow batches of ``columns`` to rows of ``fields``: one result row for each input row.

    ``make()`` runs once in each task; what it returns takes one Arrow array for each column and
    returns one Arrow array or list for each field. ``columns`` may repeat none; other columns of
    ``df`` are pruned before the transfer, so clashing names cannot matter.

    Spark bounds its batches by bytes; of each no more than ``part`` bytes become Python objects at
    once, so memory is bounded by that and by the longest text. ``gather``: bytes of batches that
    are joined first instead, for work that has a cost by batch.
    """
    schema = T.StructType(list(fields))
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in gathered(batches, gather) if gather else (x for b in batches for x in parts_of(b, part)):
            out = work(*b.columns)
            yield pa.RecordBatch.from_arrays(
                [
                    (x.cast(f.type) if x.type != f.type else x)
                    if isinstance(x, (pa.Array, pa.ChunkedArray))
                    else pa.array(x, f.type)
                    for x, f in zip(out, arrow, strict=True)
                ],
                schema=arrow,
            )

    return df.select(*columns).mapInArrow(run, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def utf8_bytes(col: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    return col.cast(pa.binary()).to_pylist()


def held_out(id_col: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def one_text_each(documents: DataFrame, picked: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``picked`` (column _id and others, unique by _id, of bounded size) with the text (_text) of each id.

    Of several rows with one id that of the smallest text counts, and is found before the shuffle, so
    neither the result nor a task grows with the rows of an id. Ids without a row are left out; null
    texts are empty.
    """
    texts = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    others = [c for c in picked.columns if c != "_id"]
    return texts.join(F.broadcast(picked), "_id").groupBy("_id", *others).agg(F.min("_text").alias("_text"))


def labelled_sample(labels: DataFrame, documents: DataFrame, label: str, rows: int, id_col="doc_id", text_col="text"):
    """At most ``rows`` labelled documents that are not held out, one row for each id: (_id, _y, _text).

    The sample is taken from the labels alone by a hash of the id, so its size is bounded by
    ``rows`` before it is broadcast against the documents. Ids whose labels disagree count once, with
    the largest label; null labels and ids do not count; of repeated documents see ``one_text_each``.
    """
    picked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(~held_out("_id") & F.col("_y").isNotNull() & F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    return one_text_each(documents, picked, id_col, text_col)


#: A key with more rows than this, and than a thousandth of all, is joined by broadcast.
HOT = 100


def join_classes(rows: DataFrame, classes: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``classes``, unique by ``on``, whose column ``size`` counts the rows of each key.

    Keys with more than ``HOT`` rows and more than a thousandth of ``total`` rows are a thousand at
    most, so they go by broadcast; no task meets all rows of such a key. The other keys go by a
    shuffle join, and each has few rows. ``how``: inner, or left (rows without a class keep nulls).
    Null keys have no class. The result lacks ``size``.
    """
    hot = max(HOT, total // 1000)
    many = classes.where(F.col(size) > hot).drop(size)
    few = classes.where(F.col(size) <= hot).drop(size)
    keys = F.broadcast(many.select(*on))
    return rows.join(F.broadcast(many), on).unionByName(rows.join(keys, on, "left_anti").join(few, on, how))
