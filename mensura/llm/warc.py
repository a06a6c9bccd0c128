"""WARC archives: written by Spark's text sink, read back record by record, assembled to captures."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import join_classes, saved, shared_dir, table

#: Payloads shorter than this are always stored.
LEAST = 100
#: Pages in one archive file at most; a file is streamed by one task.
PAGES_PER_FILE = 20_000
#: Bytes of an uncompressed archive at most: it is read whole, as only compressed files are never split.
PLAIN_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _uuid(digest: Column) -> Column:
    parts = [F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def _record(headers: list, body: Column) -> Column:
    """One record up to the last line feed, which the text sink adds."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in [*headers, ("Content-Length", F.octet_length(body).cast("string"))]]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), body, F.lit("\r\n\r"))


def _revisits(light: DataFrame) -> DataFrame:
    """(_id, _digest, refers_to, target_uri, target_lone) of the pages whose payload a smaller id holds.

    ``light``: id, digest, uri of the payloads long enough. Copies are counted by (digest, id)
    before the shuffle; digests of very many pages meet their first page by broadcast.
    """
    pages = saved(light.groupBy("digest", "id").agg(F.count("*").alias("m"), F.min("uri").alias("uri")))
    first = pages.groupBy("digest").agg(F.min_by(F.struct("id", "uri", "m"), "id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    met = join_classes(pages.select("digest", "id"), saved(first), ["digest"], "n", pages.count())
    again = met.where(~F.col("id").eqNullSafe(F.col("first.id")))
    return again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first.id").alias("refers_to"), F.col("first.uri").alias("target_uri"), (F.col("first.m") == 1).alias("target_lone"))


def _repeated(light: DataFrame) -> DataFrame:
    """(id, digest) that several rows share: their records need names of their own."""
    return light.groupBy("id", "digest").agg(F.count("*").alias("m")).where("m > 1").select(F.col("id").alias("_rid"), F.col("digest").alias("_rdigest"))


def records(pages: DataFrame, id_col="page_id", uri_col="url", payload_col="html", least: int = LEAST, date: str = DATE) -> DataFrame:
    """(record): request, response or revisit, and metadata of each page as one text.

    Copies are found from (digest, id) alone, aggregated before the shuffle; the (id, digest) of
    the revisits then meet the pages in a join by both, so a page's thousands of copies do not
    share a task. Request and metadata name their response by WARC-Concurrent-To. A revisit names
    the response it repeats by WARC-Refers-To-Target-URI, WARC-Refers-To-Date and, unless that page
    stands in several rows, WARC-Refers-To; record ids follow from kind, id and payload, and rows
    that share these get a further number. The metadata record carries the page's id and, for a
    revisit, that of the page it refers to.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), _one_line(F.col(uri_col)).alias("uri"), payload.alias("payload")).withColumns(
        {"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")}
    )
    light = saved(rows.select("id", "digest", "uri", (F.col("size") >= least).alias("long")))
    again = _revisits(light.where("long")).withColumn("revisit", F.lit(True))
    # one row for each (id, digest) that is a revisit or repeated, so the join cannot multiply pages
    notes = saved(again.join(_repeated(light), F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_digest") == F.col("_rdigest")), "full").select(
        F.coalesce("_id", "_rid").alias("_id"), F.coalesce("_digest", "_rdigest").alias("_digest"), "refers_to", "target_uri", "target_lone", F.coalesce("revisit", F.lit(False)).alias("revisit"), F.col("_rdigest").isNotNull().alias("repeated")
    ))
    rows = rows.join(notes, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    number = F.when(F.coalesce("repeated", F.lit(False)), F.monotonically_increasing_id().cast("string"))
    name = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), "digest", number)
    rows = rows.select("id", "uri", "payload", "digest", "size", "refers_to", "target_uri", "target_lone", F.coalesce("revisit", F.lit(False)).alias("revisit"), name.alias("name"))
    of = lambda kind, n=F.col("name"): _uuid(F.md5(F.concat_ws("|", F.lit(kind), n).cast("binary")))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    target, when = ("WARC-Target-URI", F.col("uri")), ("WARC-Date", F.lit(date))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", of("request")), when, target, ("WARC-Concurrent-To", of("response")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    answer = [("WARC-Type", kind), ("WARC-Record-ID", of("response")), when, target, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response"))]
    original = of("response", F.concat_ws("|", F.col("refers_to").cast("string"), "digest"))
    refers = F.concat(F.when(F.col("target_lone"), F.concat(F.lit("WARC-Refers-To: "), original, F.lit("\r\n"))).otherwise(F.lit("")), F.lit("WARC-Refers-To-Target-URI: "), F.coalesce("target_uri", F.lit("")))
    repeats = [("WARC-Profile", F.concat(F.lit(_REVISIT + "\r\n"), refers)), ("WARC-Refers-To-Date", F.lit(date))]
    response = F.when(F.col("revisit"), _record([*answer, *repeats], http)).otherwise(_record(answer, F.concat(http, F.col("payload"))))
    line = lambda key, v: F.coalesce(F.concat(F.lit(f"{key}: "), v.cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", of("metadata")), when, target, ("WARC-Concurrent-To", of("response")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(line("page-id", F.col("id")), line("refers-to-page", F.col("refers_to"))),
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("record"))


def write_warc(pages: DataFrame, path: str, id_col="page_id", uri_col="url", payload_col="html", least: int = LEAST) -> None:
    """Gzip archives of the pages below ``path``: any file system of Spark's, committed as Spark commits.

    Null payloads are empty; null uris are empty; line breaks in uris become blanks. An empty table
    writes no records. Of several rows with the smallest id of a payload all are responses; a null
    id is larger than others. Payloads of any length are written whole, each held by one task.
    Other columns are ignored. Each file is one gzip member: Spark's sink compresses by file.
    """
    out = records(pages, id_col, uri_col, payload_col, least).write.option("lineSep", "\n").option("maxRecordsPerFile", 3 * PAGES_PER_FILE)
    out.option("compression", "gzip").text(path)


#: What stands between records; what follows it is the version's last digit.
_BETWEEN = "\r\n\r\nWARC/1."


class Splitter:
    """Records from the fragments between ``_BETWEEN``: (headers, block) pairs, cut by Content-Length.

    A payload that itself holds the sign comes in several fragments, which are joined until the
    declared length is reached. Header names are lower-cased. Only one record is held at a time.
    """

    def __init__(self):
        self.parts: list[bytes] = []
        self.head: dict | None = None
        self.missing = 0

    def push(self, fragment: bytes, first: bool) -> Iterator[tuple[dict, bytes]]:
        """The record that this fragment completes, if any. ``first``: it opens a file."""
        if self.head is not None and not first:
            fragment = _BETWEEN.encode() + fragment
            self.parts.append(fragment)
            self.missing -= len(fragment)
        else:
            self.head = None
            fragment = fragment.removeprefix(b"WARC/1.") if first else fragment
            head, between, block = fragment.partition(b"\r\n\r\n")
            if not between:
                return
            lines = head.decode("utf-8", "replace").split("\r\n")
            self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.parts, self.missing = [block], int(self.head.get("content-length", 0)) - len(block)
        if self.missing <= 0:
            block = b"".join(self.parts)[: int(self.head.get("content-length", 0))]
            head, self.head, self.parts = self.head, None, []
            yield head, block


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an archive in memory, plain or gzip of any number of members."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(parts)
    splitter = Splitter()
    for k, fragment in enumerate(data.split(_BETWEEN.encode())):
        yield from splitter.push(fragment, k == 0)


def _fields(block: bytes) -> dict:
    return {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")) if s}


def _row(headers: dict, block: bytes, keep: bool) -> tuple:
    kind = headers.get("warc-type", "")
    body, size, digest, fields = b"", None, None, {}
    if kind in ("response", "revisit", "request") and "application/http" in headers.get("content-type", ""):
        head, _, body = block.partition(b"\r\n\r\n")
        fields = _fields(head.partition(b"\r\n")[2])
    elif kind == "metadata":
        fields = _fields(block)
    else:
        body = block
    if kind == "revisit":  # its payload is elsewhere; length and digest are those of the full payload
        size, digest, body = int(fields.get("content-length", -1)), headers.get("warc-payload-digest", "").partition(":")[2], None
    elif kind != "metadata":
        size, digest = len(body), hashlib.sha256(body).hexdigest()
        if kind == "response" and headers.get("warc-payload-digest", "sha256:" + digest) != "sha256:" + digest:
            raise ValueError(f"payload of {headers.get('warc-record-id')} differs from its digest")
    return kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers, fields, size, digest, body if keep else None


def _parsed(fragments, whole: bool, payloads: bool):
    """Arrow batches of (file, fragment) or of (file, whole archive) to batches of RECORD."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, names = to_arrow_schema(RECORD), RECORD.names

    def out(rows):
        cols = list(zip(*rows))
        fix = [[list(m.items()) for m in c] if n in ("headers", "fields") else list(c) for n, c in zip(names, cols)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fix, schema)], schema=schema)

    def records():
        splitter, at = Splitter(), None
        for b in fragments:
            for file, fragment in zip(b.column(0).to_pylist(), b.column(1)):
                if whole:
                    yield from parse(fragment.as_py())
                    continue
                first = file != at
                if first and splitter.head is not None:
                    raise ValueError(f"{at} ends inside a record")
                at = file
                yield from splitter.push(fragment.as_py(), first)
        if splitter.head is not None:
            raise ValueError(f"{at} ends inside a record")

    rows, held = [], 0
    for headers, block in records():
        rows.append(_row(headers, block, payloads))
        held += len(block)
        if len(rows) >= 2000 or held > 8 << 20:
            yield out(rows)
            rows, held = [], 0
    if rows:
        yield out(rows)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record (see RECORD) of the archives below ``path``.

    Spark's text source streams each compressed archive (``.gz``), cut where a new record may begin,
    so a task holds one record and one Arrow batch, however large the archive. Such an archive is
    read by one task from start to end; write several. Spark would split uncompressed ones inside
    a payload, so these are read whole, and one of more than ``PLAIN_BYTES`` is an error. Digests of
    stored payloads are computed anew and compared with the declared SHA-256. No file, no rows.
    """
    lines = spark.read.option("lineSep", _BETWEEN).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(path)
    pieces = lines.select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    others = "{*[!z],*[!g]z,*[!.]gz}"
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", others).load(path).where("length > 0")
    small = F.when(F.col("length") <= PLAIN_BYTES, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("an uncompressed archive is too large: "), F.col("path"))).cast("binary"))
    from_lines = pieces.mapInArrow(lambda batches: _parsed(batches, False, payloads), RECORD)
    return from_lines.unionByName(plain.select("path", small.alias("content")).mapInArrow(lambda batches: _parsed(batches, True, payloads), RECORD))


_ROLES = {"response": "answer", "revisit": "answer", "resource": "answer", "request": "request", "metadata": "metadata"}


def _placed(found: DataFrame) -> DataFrame:
    """``found`` with the capture and the role of each record, and an order in which only copies are equal."""
    sorted_ = lambda c: F.array_sort(F.map_entries(c))
    content = F.xxhash64("kind", "record_id", "concurrent_to", "uri", "payload_bytes", "payload_digest", sorted_("headers"), sorted_("fields"))
    role = F.element_at(F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv)), F.coalesce("kind", F.lit("")))
    named = found.withColumns({"_role": F.coalesce(role, F.lit("other")), "_order": F.struct(F.col("record_id").alias("id"), content.alias("content"))})
    return named.withColumn("_capture", F.coalesce("concurrent_to", "record_id", F.concat(F.lit("unnamed:"), F.hex("_order.content"))))


def captures(found: DataFrame) -> DataFrame:
    """One nested row for each capture: answer (response, revisit or resource), request, metadata, records, conflicting.

    Records name the capture by WARC-Concurrent-To, the answer is its own centre; all meet in one
    aggregation by that identifier. Records that no answer goes with give a row with a null answer,
    and those without any identifier are captures of their own. ``records`` counts the rows of each
    role: more than one are copies (archives read twice) or, if ``conflicting``, records that differ,
    of which the greatest identifier is shown here and every other by ``others``.
    """
    whole = F.struct(*[c for c in found.columns if c != "concurrent_to"])
    is_ = lambda role: F.col("_role") == role
    roles = ("answer", "request", "metadata")
    one = [F.max_by(F.when(is_(r), F.col("_whole")), F.when(is_(r), F.col("_order"))).alias(r) for r in roles]
    count = F.struct(*(F.count_if(is_(r)).alias(r) for r in roles)).alias("records")
    ends = [F.coalesce(F.max(F.when(is_(r), F.col("_order"))) != F.min(F.when(is_(r), F.col("_order"))), F.lit(False)) for r in roles]
    rows = _placed(found).select("_capture", "_role", "_order", whole.alias("_whole")).where("_role <> 'other'")
    return rows.groupBy(F.col("_capture").alias("capture")).agg(*one, count, (ends[0] | ends[1] | ends[2]).alias("conflicting"))


def others(found: DataFrame) -> DataFrame:
    """The records that ``captures`` does not show, but for copies of those it shows, with their capture: rows of ``found`` as they are.

    These are records that differ from the shown one of their capture and role, and those of kinds
    (such as warcinfo) that belong to no capture. Nothing is there unless identifiers repeat.
    """
    rows = _placed(found)
    shown = rows.where("_role <> 'other'").groupBy("_capture", "_role").agg(F.max("_order").alias("_top"), F.min("_order").alias("_least")).where("_top <> _least")
    left = rows.where("_role <> 'other'").join(shown, ["_capture", "_role"]).where(F.col("_order") != F.col("_top"))
    columns = [F.col("_capture").alias("capture"), *(F.col(f"`{c}`") for c in found.columns)]
    return left.select(*columns).unionByName(rows.where("_role = 'other'").select(*columns))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = shared_dir(spark)
    write_warc(pages, path)
    page = lambda k: F.try_element_at("metadata.fields", F.lit(k)).cast(pages.schema["page_id"].dataType)
    return captures(read_warc(spark, path, payloads=False)).select(
        page("page-id").alias("page_id"),
        F.col("answer.payload_bytes").alias("payload_bytes"),
        F.col("answer.payload_digest").alias("payload_digest"),
        F.col("answer.kind").alias("record_type"),
        page("refers-to-page").alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest,
CASE WHEN payload_bytes >= 100 AND least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= 100 AND least <> page_id THEN least END AS refers_to FROM f
"""
