"""Line dedup: Bloom filters of once-seen and twice-seen lines; only suspected repeats are confirmed by a shuffle."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import LOWER_BYTES, join_classes, parts_of, saved, table, utf8_bytes

#: Bits that a key sets in a filter; bits a line that filters are sized for; their least and most bits (powers of two).
HASHES, BITS_A_LINE, LEAST_BITS, MOST_BITS = 3, 16, 1 << 16, 1 << 28
#: Bits of a filter's segment.
SEGMENT = 1 << 16
#: Bytes of confirmed keys up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Keys that a task counts before they leave as partial rows.
ENTRIES = 200_000


def line_keys(text: bytes, min_chars: int = 1) -> list[bytes]:
    """For each line of a UTF-8 text its key: A-Z lower-cased, ASCII white space stripped at both ends; empty if shorter than ``min_chars`` code points."""
    keys = [x.strip() for x in text.translate(LOWER_BYTES).split(b"\n")]
    if min_chars > 1:
        keys = [k if len(k) >= 4 * min_chars or len(k.decode()) >= min_chars else b"" for k in keys]
    return keys


def bit_places(keys: list[bytes], bits: int) -> np.ndarray:
    """(keys, HASHES) places in a filter of ``bits``, a power of two up to 2^32: 32-bit pieces of one 128-bit hash."""
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u4").reshape(-1, 4)[:, :HASHES]
    return (h & np.uint32(bits - 1)).astype(np.int64)


def _are_set(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _set_bits(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places.ravel() >> 3, np.left_shift(1, places.ravel() & 7).astype(np.uint8))


def _texts(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[list]:
    for batch in batches:
        for part in parts_of(batch):
            yield [x or b"" for x in utf8_bytes(part.column(column))]


def twice_filter(documents: DataFrame, bits: int, min_chars: int = 1, text_col: str = "text") -> bytes:
    """The filter of keys that may stand in two documents or more: every key that does is in it.

    Each task keeps two filters: a key all of whose bits are set in the first goes to the second,
    then to the first. Segments meet by their number: twice = either twice, or once in both, bit by
    bit, which loses no repeated key. The result has ``bits`` bits, a bounded size, and goes through
    the driver to a broadcast. Tasks are joined up (``coalesce``) to four a core, so that what the
    filters move grows with the cluster, not with the table.
    """
    most = 4 * documents.sparkSession.sparkContext.defaultParallelism

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for texts in _texts(batches):
            keys = [k for t in texts for k in set(line_keys(t, min_chars)) if k]
            if not keys:
                continue
            places = bit_places(keys, bits)
            _, first, seen = np.unique(places, axis=0, return_index=True, return_counts=True)
            own = places[first]
            _set_bits(twice, own[(seen > 1) | _are_set(once, own)])
            _set_bits(once, own)
        size = min(SEGMENT, bits) >> 3
        for at in range(0, bits >> 3, size):
            if once[at : at + size].any():
                cols = [pa.array([at // size], pa.int32()), pa.array([once[at : at + size].tobytes()], pa.binary()), pa.array([twice[at : at + size].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["segment", "once", "twice"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if segment != now:
                    if now is not None:
                        yield out()
                    now, once, twice = segment, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if now is not None:
            yield out()

    built = documents.select(text_col).coalesce(most).mapInArrow(build, "segment int, once binary, twice binary")
    met = built.repartition("segment").sortWithinPartitions("segment").mapInArrow(meet, "segment int, twice binary")
    out, size = bytearray(bits >> 3), min(SEGMENT, bits) >> 3
    for r in saved(met).toLocalIterator():
        out[r.segment * size : (r.segment + 1) * size] = r.twice
    return bytes(out)


def _suspects(texts: list[bytes], bitmap: np.ndarray, bits: int, min_chars: int) -> list[list[bytes]]:
    """The distinct keys of each text that the filter holds."""
    each = [[k for k in set(line_keys(t, min_chars)) if k] for t in texts]
    flat = [k for keys in each for k in keys]
    if not flat:
        return each
    hit, at, out = _are_set(bitmap, bit_places(flat, bits)), 0, []
    for keys in each:
        out.append([k for k, h in zip(keys, hit[at : at + len(keys)]) if h])
        at += len(keys)
    return out


def confirmed_keys(documents: DataFrame, twice: bytes, min_docs: int, min_chars: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """(key, docs, first_id) of keys in ``min_docs`` documents or more: their number and the smallest id.

    Only keys in the filter leave a task, counted there first; they are grouped by their own text, so the count is exact.
    """
    spark, bits = documents.sparkSession, len(twice) * 8
    held = spark.sparkContext.broadcast(twice)
    kind = documents.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, counts = np.frombuffer(held.value, np.uint8), {}

        def flush() -> Iterator[pa.RecordBatch]:
            known = list(counts.items())
            for at in range(0, len(known), 20_000):
                some = known[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in some], pa.binary()).cast(pa.string()), pa.array([e[0] for _, e in some], pa.int64()), pa.array([e[1] for _, e in some], id_type)],
                    ["key", "docs", "first_id"],
                )

        id_type, entries = None, 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in parts_of(batch):
                texts = [x or b"" for x in utf8_bytes(part.column(1))]
                for i, keys in zip(part.column(0).to_pylist(), _suspects(texts, bitmap, bits, min_chars)):
                    for k in keys:
                        e = counts.get(k)
                        if e is None:
                            counts[k] = [1, i]
                            entries += 1 + len(k) // 256
                        else:
                            e[0] += 1
                            if i is not None and (e[1] is None or i < e[1]):
                                e[1] = i
                if entries > ENTRIES:
                    yield from flush()
                    counts, entries = {}, 0
        if counts:
            yield from flush()

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("first_id", kind)])
    parts = documents.select(id_col, text_col).mapInArrow(run, schema)
    return parts.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first_id").alias("first_id")).where(F.col("docs") >= min_docs)


def _kept(text: bytes, own_id, keys: list[bytes], first_of: Callable, keep_first: bool) -> tuple[bytes, int, int]:
    """(kept text, lines, dropped lines); ``first_of(key)``: the id of its first document in a tuple, or None for a key that stays."""
    lines = text.split(b"\n")
    kept, seen = [], set()
    for line, key in zip(lines, keys):
        first = first_of(key) if key else None
        if first is not None:
            if not (keep_first and key not in seen and first[0] == own_id):
                continue
            seen.add(key)
        kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _fields(documents: DataFrame, id_col: str) -> T.StructType:
    out = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    return T.StructType(out)


def _rows(rows: list, id_col: str, id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], id_type), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], [id_col, "kept", "n_lines", "n_dropped"]
    )


def _drop_by_broadcast(documents: DataFrame, keys: DataFrame, keep_first: bool, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast({r.key.encode(): (r.first_id,) for r in keys.select("key", "first_id").toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of = held.value.get
        for batch in batches:
            for part in parts_of(batch):
                texts = [x or b"" for x in utf8_bytes(part.column(1))]
                done = [(i, *_kept(t, i, line_keys(t, min_chars), first_of, keep_first)) for i, t in zip(part.column(0).to_pylist(), texts)]
                yield _rows(done, id_col, part.schema.field(0).type)

    return documents.select(id_col, text_col).mapInArrow(run, _fields(documents, id_col))


def _drop_by_join(documents: DataFrame, twice: bytes, keys: DataFrame, keep_first: bool, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """What to drop depends on a text alone (and whose the first line is), so lines are joined by their text's digest: copies go once."""
    bits, held = len(twice) * 8, documents.sparkSession.sparkContext.broadcast(twice)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, done = np.frombuffer(held.value, np.uint8), set()
        for texts in _texts(batches):
            for t, keys_ in zip(texts, _suspects(texts, bitmap, bits, min_chars)):
                digest = hashlib.sha256(t).digest()
                if not keys_ or digest in done:
                    continue
                if len(done) < ENTRIES:
                    done.add(digest)
                wanted, at = set(keys_), {}
                for n, k in enumerate(line_keys(t, min_chars)):
                    if k in wanted:
                        at.setdefault(k, []).append(n)
                cols = [pa.array([digest] * len(at), pa.binary()), pa.array(list(at), pa.binary()).cast(pa.string()), pa.array(list(at.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["digest", "key", "lines"])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                done = []
                for i, t, drops in zip(part.column(0).to_pylist(), utf8_bytes(part.column(1)), part.column(2).to_pylist()):
                    names, first = [b""] * ((t or b"").count(b"\n") + 1), {}
                    for n, d in enumerate(drops or ()):
                        own = b"%d" % n
                        first[own] = (d["first_id"],)
                        for line in d["lines"]:
                            names[line] = own
                    done.append((i, *_kept(t or b"", i, names, first.get, keep_first)))
                yield _rows(done, id_col, part.schema.field(0).type)

    suspects = saved(documents.select(text_col).mapInArrow(suspect, "digest binary, key string, lines array<int>").dropDuplicates(["digest", "key"]))
    found = join_classes(suspects, keys.select("key", "first_id", F.col("docs").alias("_docs")), ["key"], "_docs", suspects.count())
    drops = found.groupBy("digest").agg(F.collect_list(F.struct("lines", "first_id")).alias("drops"))
    rows = documents.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies"))
    classes = saved(drops.join(copies, "digest"))
    joined = join_classes(rows, classes, ["digest"], "copies", documents.count(), "left").select(F.col("_id").alias(id_col), "_text", "drops")
    return joined.mapInArrow(drop, _fields(documents, id_col))


def line_dedup(
    documents: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col="doc_id", text_col="text", broadcast_bytes: int = BROADCAST_BYTES, most_bits: int = MOST_BITS
) -> DataFrame:
    """(id, kept, n_lines, n_dropped) for every row: its text without lines whose key stands in ``min_docs`` documents or more.

    Keys: see ``line_keys``; shorter ones than ``min_chars`` code points stay. ``keep_first``: the
    first such line of the document of smallest id stays (rows of one id count as that document).

    Three passes over the texts. The first fills the two filters, the second counts the suspected
    repeats that the twice-seen filter names, the third drops. The filters have ``BITS_A_LINE`` bits
    a line, up to ``most_bits``; on more lines they suspect more, up to all, and the result is the
    same. Confirmed keys of up to ``broadcast_bytes`` go to all tasks; more are joined to the lines
    of each distinct text by a shuffle, where a key or a text of very many rows goes by broadcast.

    Null and empty texts have one empty line. Texts of any length are split whole. Each row is a
    document of its own, repeated ids, null ids and copies included. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more: the filters tell repeated lines only")
    lines = documents.select(F.sum(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).cast("long")).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, 1 << (lines * BITS_A_LINE - 1).bit_length() if lines else 0))
    twice = twice_filter(documents, bits, min_chars, text_col)
    keys = saved(confirmed_keys(documents, twice, min_docs, min_chars, id_col, text_col))
    size = keys.select(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return _drop_by_broadcast(documents, keys, keep_first, min_chars, id_col, text_col)
    return _drop_by_join(documents, twice, keys, keep_first, min_chars, id_col, text_col)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM d),
k AS (SELECT r, n, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (c.key IS NULL), '') AS kept FROM k LEFT JOIN c ON k.key = c.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (r)
"""
