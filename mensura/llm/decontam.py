"""Benchmark decontamination: prefix-filtered containment join of item windows against documents."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import WORD_BYTES, gathered, map_batches, parts_of, saved, table, utf8_bytes

#: Words in a window; an item of fewer words is one window.
WINDOW = 10
#: UTF-8 bytes of item text in one block of the item index; that bounds what is broadcast at once.
BLOCK_BYTES = 2 << 20
#: Bytes of documents that pass through all blocks together when there are several.
GATHERED = 16 << 20


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class _Items:
    """One block of the benchmark: word sequences and the ids that carry each."""

    def __init__(self, rows, window: int):
        by: dict[tuple, set] = {}
        for item_id, text in rows:
            if item_id is not None and (w := tuple(words(bytes(text) if text is not None else None))):
                by.setdefault(w, set()).add(str(item_id))
        self.window = window
        self.seqs = list(by)
        self.ids = [sorted(by[w]) for w in self.seqs]
        self.shortest = min((min(window, len(w)) for w in self.seqs), default=0)  # words of the shortest window

    def shingles(self) -> dict:
        """Word pairs (for an item of one word that word) by first word; values number them."""
        out: dict[bytes, dict] = {}
        n = 0
        for w in self.seqs:
            for pair in zip(w, w[1:] or (None,)):
                row = out.setdefault(pair[0], {})
                if pair[1] not in row:
                    row[pair[1]] = n
                    n += 1
        return out

    def prefixes(self, pairs: dict, freq: list) -> dict:
        """first word -> second word -> [(sequence, place)]: the rarest shingle of each window.

        Containment must be whole, so one prefix token is needed for each window.
        """
        out: dict[bytes, dict] = defaultdict(lambda: defaultdict(list))
        for s, w in enumerate(self.seqs):
            keys = list(zip(w, w[1:] or (None,)))
            rank = [(freq[pairs[a][b]], pairs[a][b], p) for p, (a, b) in enumerate(keys)]
            size = min(self.window, len(w))
            span = max(1, size - 1)  # shingles in a window
            for p in sorted({min(rank[i : i + span])[2] for i in range(len(keys) - span + 1)}):
                out[keys[p][0]][keys[p][1]].append((s, p))
        return {a: dict(b) for a, b in out.items()}


def _forget(shared) -> None:
    """Let go of a broadcast's value here; its file stays and is read again at need."""
    shared.__dict__.pop("_value", None)


def _count_shingles(blocks):
    """Documents that hold each item shingle, summed over the Arrow batch."""

    def run(batches):
        import pyarrow as pa

        loaded = None
        for batch in gathered(batches, GATHERED) if len(blocks) > 1 else (x for b in batches for x in parts_of(b)):
            docs = [words(x) for x in utf8_bytes(batch.column(0))]
            for b, block in enumerate(blocks):
                if loaded is None or len(blocks) > 1:
                    loaded = block.value.shingles()
                pairs, seen = loaded, Counter()
                for w in docs:
                    found = set()
                    for i, x in enumerate(w):
                        if x in pairs:
                            row = pairs[x]
                            if None in row:
                                found.add(row[None])
                            if i + 1 < len(w) and w[i + 1] in row:
                                found.add(row[w[i + 1]])
                    seen.update(found)
                if len(blocks) > 1:
                    _forget(block)
                if seen:
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([b] * len(seen), pa.int32()), "shingle": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())}
                    )

    return run


def match(w: list[bytes], items: _Items, prefix: dict) -> tuple[list, set]:
    """Runs (start, end) of document words that hold whole windows, and the sequences that occur."""
    runs, found, done = [], set(), {}
    n = len(w)
    if n < items.shortest:  # length bound
        return runs, found
    for i, x in enumerate(w):
        if x not in prefix:
            continue
        row = prefix[x]
        for second in (None, w[i + 1]) if i + 1 < n else (None,):
            for s, p in row.get(second, ()):
                if done.get((s, i - p), -1) > i:  # this alignment is verified beyond here
                    continue
                seq = items.seqs[s]
                size = min(items.window, len(seq))
                # positional bound: a window around this place must fit into the document
                if min(i, p) + min(n - i, len(seq) - p) < size:
                    continue
                a, b, left, right = i, i, p, p
                while a > 0 and left > 0 and w[a - 1] == seq[left - 1]:
                    a, left = a - 1, left - 1
                while b < n and right < len(seq) and w[b] == seq[right]:
                    b, right = b + 1, right + 1
                done[s, i - p] = b
                if b - a >= size:
                    runs.append((a, b))
                    found.add(s)
    return runs, found


def _merged(runs: list) -> list:
    out: list = []
    for a, b in sorted(set(runs)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document row: id, n_words, items (ids found, sorted as strings), spans.

    Every item is cut to windows of ``window`` words. A window's set of shingles (word pairs) is
    ordered by document frequency over all documents; as containment must be whole, its rarest
    shingle is its one prefix token. Documents are joined to windows by prefix tokens; length and
    positional bounds drop candidates, and the survivors are verified word by word along their
    alignment. ``spans`` are merged [start, end) word ranges.

    The item side travels in blocks of at most ``block_bytes`` of text each (a single larger item
    makes its own block); with several blocks documents of ``GATHERED`` bytes pass through one after
    the other, so any benchmark size is exact in bounded memory and documents are never shuffled.

    Null or wordless texts have no words and hit nothing; items that are null, wordless or have a
    null id are no items. Very long texts are compared whole; time grows with their words. Equal
    items and repeated ids are merged; repeated document rows each give a row, ties of frequency
    fall to the earlier shingle. Empty tables give n_items 0 or no rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("binary").alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    blocks = []
    if n > 1:  # one pass over the benchmark; each block is then a part of a sorted table
        items = saved(items.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(n))).repartition("b").sortWithinPartitions("b"))
    for k in range(n):
        part = items if n == 1 else items.where(F.col("b") == k).select("i", "t")
        block = _Items(part.toLocalIterator(), window)
        if block.seqs:
            blocks.append(sc.broadcast(block))
    prefixes = []
    if blocks:
        counted = documents.select(text_col).mapInArrow(_count_shingles(blocks), "block int, shingle long, n long")
        counted = saved(counted.groupBy("block", "shingle").agg(F.sum("n").alias("n")))
    for k, block in enumerate(blocks):
        pairs = block.value.shingles()
        freq = [0] * sum(map(len, pairs.values()))
        for _, s, c in counted.where(F.col("block") == k).toLocalIterator():
            freq[s] = c
        prefixes.append(sc.broadcast(block.value.prefixes(pairs, freq)))
        _forget(block)

    def make():
        def run(ids, col):
            docs = [words(x) for x in utf8_bytes(col)]
            runs: list = [[] for _ in docs]
            found: list = [set() for _ in docs]
            for block, pre in zip(blocks, prefixes):
                it, prefix = block.value, pre.value
                for k, w in enumerate(docs):
                    r, f = match(w, it, prefix)
                    if f:
                        runs[k] += r
                        found[k].update(x for s in f for x in it.ids[s])
                if len(blocks) > 1:
                    _forget(block)
                    _forget(pre)
            spans = [[{"start": a, "end": b} for a, b in _merged(r)] for r in runs]
            return ids, [len(w) for w in docs], [sorted(f) for f in found], spans

        return run

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return map_batches(
        documents,
        [id_col, text_col],
        [
            T.StructField(id_col, documents.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(span)),
        ],
        make,
        GATHERED if len(blocks) > 1 else 0,
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


#: Windows of ten words (or a whole shorter item) found at every document word, by hash join.
OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS t FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
m AS (SELECT DISTINCT dw.r, dw.i, dw.size, bw.item_id FROM (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS t FROM dw) dw JOIN bw USING (size, t)),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
f AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN f USING (r)
"""
