"""SimHash near-duplicates: pivot distance tables give join keys, discard pairs, and survivors are verified."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import LOWER_BYTES, join_classes, map_batches, saved, table, utf8_bytes
from mensura.llm.components import connected_components

#: Differing bits up to which fingerprints link. The keys below are exact for 2.
RADIUS = 2
#: Words in a shingle, and the hash seed.
SHINGLE, SEED = 3, 42
#: Runs of neighbouring bits; the flips between linked fingerprints leave all but RADIUS of them alone.
SECTIONS = [sum(1 << j for j in range(64 * k // 5, 64 * (k + 1) // 5)) for k in range(5)]
#: Reference fingerprints, from a rule: in each family one and, for each section, the same with that section inverted.
FAMILIES = [[r, *(r ^ s for s in SECTIONS)] for r in (xxhash.xxh64_intdigest(str(k), seed=7) for k in range(8))]
REFERENCES = [r for family in FAMILIES for r in family]
#: A bucket of more fingerprints than this is linked by shared neighbours instead of pairs.
BUCKET = 32


def fingerprint(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles (repeats count) of a UTF-8 text; 0 if it has no words."""
    w = text.translate(LOWER_BYTES).split() if text else []
    if not w:
        return 0
    if len(w) < size:
        s = [b" ".join(w)]
    else:
        s = map(b" ".join, zip(*(w[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, seed) for x in s], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for long texts
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, np.int64)
    bits = total * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed 64-bit integer."""

    def make():
        def run(ids, col):
            return ids, np.array([fingerprint(x) for x in utf8_bytes(col)], np.uint64).view(np.int64)

        return run

    return map_batches(documents, [id_col, text_col], [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("fp", T.LongType())], make)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance_table(fp: Column, references: Sequence[int] = REFERENCES) -> list[Column]:
    """The row of the pivot table: the Hamming distance of a fingerprint to every reference."""
    return [_distance(fp, F.lit(_signed(r))) for r in references]


def section_codes(distances: Sequence[Column], families: int = len(FAMILIES)) -> list[Column]:
    """For each section one code, from the distances alone, that changes only if bits of the section do.

    Distances to a reference and to the same with a section inverted differ by the section's size
    less twice the distance within the section, whatever the other bits are. The code is these
    differences of all families, which tell most contents of a section apart.
    """
    step = len(SECTIONS) + 1
    codes = []
    for s in range(1, step):
        code = F.lit(0).cast("long")
        for f in range(families):
            code = code * 32 + (distances[f * step] - distances[f * step + s] + 16)
        codes.append(code)
    return codes


def pivot_bands(codes: Sequence[Column], radius: int = RADIUS) -> Column:
    """Join keys: array of (band, key), one for each choice of all sections but ``radius``.

    Fingerprints within ``radius`` bits differ in that many sections at most, so their codes agree
    in one choice of the others. A key is a hash of the chosen codes: fingerprints that share one
    by chance are candidates that the table of distances discards.
    """
    keys = (F.xxhash64(*own) for own in combinations(codes, len(codes) - radius))
    return F.array(*(F.struct(F.lit(k).alias("band"), key.alias("key")) for k, key in enumerate(keys)))


def _survivors(members: Column, references: Sequence[int] = REFERENCES) -> Column:
    """Pairs of a bounded bucket within RADIUS: coordinate differences first, then the exact distance."""

    def near(x, y):
        keep = F.lit(True)
        for k in range(len(references)):
            keep = keep & (F.abs(F.get(x["d"], F.lit(k)) - F.get(y["d"], F.lit(k))) <= RADIUS)
        return keep & (_distance(x["fp"], y["fp"]) <= RADIUS)

    def partners(x):
        return F.transform(
            F.filter(members, lambda y: (y["fp"] > x["fp"]) & near(x, y)),
            lambda y: F.struct(x["fp"].alias("u"), y["fp"].alias("v")),
        )

    return F.flatten(F.transform(members, partners))


def near_edges(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (column fp) whose components are those of all links.

    Buckets of at most ``bucket`` fingerprints are compared inside: the table of distances to the
    reference fingerprints discards a pair when any coordinate differs by more than the radius,
    and the rest is verified. Larger buckets are those of many texts almost alike, whose pairs are
    not to be listed; their members are linked exactly without pairs: two fingerprints are within
    two bits just if some fingerprint is within one bit of both, so each emits itself and its 64
    one-bit neighbours, and those that meet at a neighbour (65 at most) are chained to the smallest.
    """
    measured = prints.select("fp", *(d.alias(f"d{k}") for k, d in enumerate(distance_table(F.col("fp")))))
    distances = [F.col(f"d{k}") for k in range(len(REFERENCES))]
    coded = measured.select("fp", *(c.alias(f"c{k}") for k, c in enumerate(section_codes(distances))))
    codes = [F.col(f"c{k}") for k in range(len(SECTIONS))]
    keyed = saved(coded.select("fp", F.explode(pivot_bands(codes)).alias("b")).select("fp", "b.band", "b.key"))
    sizes = saved(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")).withColumn("members", F.col("n"))
    shared = saved(join_classes(keyed, sizes, ["band", "key"], "members", keyed.count()))
    table_ = F.array(*(d.cast("byte") for d in distance_table(F.col("fp"))))
    small = (
        shared.where(F.col("n") <= bucket)
        .groupBy("band", "key")
        .agg(F.collect_list(F.struct("fp", table_.alias("d"))).alias("members"))
        .select(F.explode(_survivors(F.col("members"))).alias("e"))
        .select("e.u", "e.v")
    )
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    met = (
        shared.where(F.col("n") > bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
        .agg(F.collect_list("fp").alias("f"))  # 65 fingerprints at most lie within one bit of z
        .where(F.size("f") > 1)
        .select(F.array_min("f").alias("u"), F.explode("f").alias("v"))
        .where("u <> v")
    )
    return small.unionByName(met).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: id, fp, component_id (smallest id reachable by links).

    Equal fingerprints are collapsed to one row before any join, so copies cost nothing further.
    Null, empty and blank texts have fingerprint 0 and are linked like any other. Texts of any
    length are read whole, in bounded pieces of their hashes. Repeated ids each give a row. A null
    id is never a component's name unless the component has no other id. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    d = saved(fingerprints(documents, id_col, text_col).withColumnRenamed(id_col, "_id"))
    prints = saved(d.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("copies")))
    linked = connected_components(near_edges(prints.select("fp")))
    named = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    root = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_print = join_classes(named.select("fp", "copies", "component"), root, ["component"], "n", prints.count())
    return join_classes(d, saved(by_print.select("fp", "component_id", "copies")), ["fp"], "copies", d.count()).select(F.col("_id").alias(id_col), "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
