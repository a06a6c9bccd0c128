"""An inverted index of a catalog's words, so that a search reads ranges of postings instead of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.operators.catalog import has_tags, name_like, query_tokens
from mensura.scratch import small

#: Fixed value: a word of the index.
WORD = r"[\p{L}\p{N}]+"
#: The columns whose words a search takes.
TEXTS = ("name", "description", "tags", "source")


def build(sequences: DataFrame, path: str, id_col: str = "id") -> None:
    """Writes the index of ``sequences`` below ``path``: postings (token, id), sorted by token, and names (id, name).

    A word counts once for each row. Postings are dealt by ranges of (token, id) and sorted, so that
    the files and their row groups hold ranges of tokens, whose bounds Parquet keeps: a prefix reads
    those that meet it. A token of very many rows takes several files, never one task. Null texts
    have no words; rows without an id are not indexed.
    """
    text = F.lower(F.concat_ws(" ", *(F.concat_ws(" ", c) if c == "tags" else F.col(c) for c in TEXTS)))
    rows = sequences.where(F.col(id_col).isNotNull())
    words = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).alias("token")).select("token", "id").distinct()
    words.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
    rows.select(F.col(id_col).alias("id"), "name").write.mode("overwrite").parquet(f"{path}/names")


def _after(prefix: str) -> str | None:
    """The smallest text, by code points, above all that begin with ``prefix``."""
    for at in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[at]) + 1
        c = 0xE000 if 0xD800 <= c < 0xE000 else c  # no surrogates
        if c <= 0x10FFFF:
            return prefix[:at] + chr(c)
    return None


def postings(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(token, id) of the words that begin with ``prefix``: a range of the sorted postings, pushed down to the scan."""
    rows = spark.read.parquet(f"{path}/postings").where(F.col("token") >= prefix)
    end = _after(prefix)
    return rows.where(F.col("token") < end) if end else rows


def search(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(id) of the rows that a query finds: every token of it begins a word, or the name holds it as it stands.

    Ids of each token's range are counted by token; the name's pattern reads the names alone.
    """
    tokens = list(dict.fromkeys(query_tokens(query)))
    by_name = spark.read.parquet(f"{path}/names").where(F.coalesce(name_like("name", query), F.lit(False))).select("id")
    if not tokens:
        return by_name.distinct()
    hits = None
    for k, t in enumerate(tokens):
        one = postings(spark, path, t).select("id").distinct().withColumn("k", F.lit(k))
        hits = one if hits is None else hits.unionByName(one)
    found = hits.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(tokens)).select("id")
    return found.unionByName(by_name).distinct()


def search_catalog(sequences: DataFrame, path: str, query: str | None = None, tags: tuple[str, ...] = (), source: str | None = None, id_col: str = "id") -> DataFrame:
    """``catalog.search`` by the index: the rows of ``sequences`` that it finds, of which no text column is read to find them."""
    out = sequences
    if query and query.strip():
        ids = search(sequences.sparkSession, path, query).withColumnRenamed("id", "_found")
        out = out.join(small(ids), F.col(id_col) == F.col("_found"), "left_semi")
    if tags:
        out = out.where(F.coalesce(has_tags("tags", tags), F.lit(False)))
    return out.where(F.col("source") == source) if source else out
