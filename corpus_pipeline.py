"""The corpus pipeline: five stages over ``documents``, each one of the operators, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm import bytebpe, decontam, quality, secrets, simhash
from mensura.llm.common import saved, table


def _packed(docs: DataFrame):
    """The whole row as one column, so that names of the documents' columns never meet those of a stage."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    The model is fitted on the stage's own input. Scores are joined to no one: the rows pass
    through the scorer, so repeated and null ids stay as they are. Null and empty texts are scored
    as texts without tokens, texts of any length whole; a score at the threshold keeps the
    document. An empty table gives an empty one; other columns are kept, whatever their names.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(_packed(docs).alias("_row"), F.col("text").alias("_text")), model, "_row", "_text")
    return scored.where(F.col("score") >= quality.THRESHOLD).select("_row.*")


def _row_digest(docs: DataFrame):
    """SHA-256 of a row's values: rows that share it are the same in every column."""
    parts = []
    for c in docs.columns:
        value = F.col(f"`{c}`").cast("string").cast("binary")
        parts.append(F.coalesce(F.concat(F.concat(F.octet_length(value).cast("string"), F.lit(":")).cast("binary"), value), F.lit("-").cast("binary")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Rows are told apart by their values, so different texts with the same id are different
    documents, and of rows that are the same throughout one stays. Where the smallest id repeats in
    a group, the row of the smallest digest stays. Rows without an id are not compared and stay.
    Null, empty and blank texts are copies of each other. Texts of any length are compared whole. An
    empty table gives an empty one; other columns are kept, whatever their names.
    """
    packed = docs.select(_packed(docs).alias("_doc"), _row_digest(docs).alias("_row"))
    keyed = packed.where("_doc.doc_id is not null")
    found = simhash.near_duplicates(keyed.select(F.struct(F.col("_doc.doc_id").alias("doc_id"), "_row").alias("_id"), F.col("_doc.text").alias("text")), "_id")
    kept = found.where(F.col("_id") == F.col("component_id")).select("_id._row").distinct()
    named = keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    return named.select("_doc.*").unionByName(packed.where("_doc.doc_id is null").select("_doc.*"))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null, empty and wordless texts hold none and stay; texts of any length are compared whole, and
    each row is judged by itself, repeated or without an id. An empty table gives an empty one, an
    empty benchmark keeps all; other columns are kept, whatever their names.
    """
    rows = docs.select(_packed(docs).alias("_row"), F.col("text").alias("_text"))
    found = decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), "_row", "_text")
    return found.where(F.size("spans") == 0).select("_row.*")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of every secret replaced by a mark; n_chars follows the text.

    Texts without a secret, null and empty ones too, stay as they are; overlapping spans are one;
    texts of any length are masked whole. Repeated rows and rows without an id stay. An empty table
    gives an empty one; other columns are kept, whatever their names.
    """
    rows = docs.select(_packed(docs).alias("_row"), F.col("doc_id").alias("_path"), F.col("text").alias("_text"))
    found = secrets.joined_findings(rows, None, "_path", "_text", keep="_row")
    hit = F.size("spans") > 0
    clean = F.when(hit, secrets.redacted(F.col("_row.text"), F.col("spans"))).otherwise(F.col("_row.text"))
    masked = found.select("_row", "spans", clean.alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.when(hit, F.length("_clean").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return masked.select(*((new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes of every document.

    Null and empty texts have no tokens; texts of any length are encoded whole. Repeated rows and rows
    without an id each give a row; an empty table gives none; other columns are left out.
    """
    return bytebpe.round_trip(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_duplicates", near_duplicate_filter),
    ("benchmark_decontamination", decontamination_filter),
    ("secret_scans", secret_redaction),
    ("byte_level_bpe", tokenization),
]

#: A classifier, a hash and an encoder that SQL lacks: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
