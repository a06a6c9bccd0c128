"""Source divergence audit: terms of each source against its language and its sibling sources, by chunk factorization."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.common import LOWER_BYTES, gathered, parts_of, saved, table, utf8_bytes

#: Fixed value: a term, after A-Z are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Probabilities are whole numbers of this part.
UNIT = 1_000_000_000
#: Entries of a task's counts, and bytes of the texts they come from, after which they leave as partial rows.
ENTRIES, TEXT_BYTES = 1_000_000, 64 << 20
#: Bytes of rows that are summed at once after a shuffle.
BLOCK_BYTES = 8 << 20
#: Rows up to which a table of groups is broadcast; beyond it the join shuffles.
SMALL = 100_000
_PARTS = "lang string, {} string, keys array<bigint>, gs array<bigint>, ns array<bigint>"


def _lists(lengths, values, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values, kind))


def _batches(lang: str, names: pa.Array, keys: list[list[int]], of: np.ndarray, gs: np.ndarray, ns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of one language: ``names`` with their document keys, and counts ``ns`` of groups ``gs``, each of the name numbered ``of``."""
    order = np.argsort(of, kind="stable")
    cols = [
        pa.array([lang] * len(names), pa.string()),
        names,
        _lists([len(k) for k in keys], np.fromiter((x for k in keys for x in k), np.int64), pa.int64()),
        _lists(np.bincount(of, minlength=len(names)), gs[order], pa.int64()),
        _lists(np.bincount(of, minlength=len(names)), ns[order], pa.int64()),
    ]
    whole = pa.RecordBatch.from_arrays(cols, ["lang", "name", "keys", "gs", "ns"])
    for at in range(0, len(names), 50_000):
        yield whole.slice(at, 50_000)


def chunk_counts(groups_of: DataFrame, min_docs: int) -> DataFrame:
    """(lang, chunk, keys, gs, ns) from (lang, g, text): partial rows, several for one chunk.

    A chunk occurs ``ns`` times in the groups ``gs``, and in the documents ``keys``, of which
    ``min_docs`` are named at most. A task holds ``ENTRIES`` entries at most, and those of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, counts, where = TaskContext.get().partitionId() << 40, 0, 0, {}, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, keys in where.items():
                number = {c: i for i, c in enumerate(keys)}
                own = [(g, c) for (of, g), c in counts.items() if of == lang]
                of = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for _, c in own])
                gs = np.repeat(np.array([g for g, _ in own], np.int64), [len(c) for _, c in own])
                ns = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in own])
                yield from _batches(lang, pa.array(list(keys), pa.binary()).cast(pa.string()), list(keys.values()), of, gs, ns)

        for batch in batches:
            for part in parts_of(batch):
                for lang, g, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8_bytes(part.column(2))):
                    words = text.translate(LOWER_BYTES).split()
                    if not words:
                        continue
                    own, keys = counts.setdefault((lang, g), Counter()), where.setdefault(lang, {})
                    held -= len(own) + len(keys)
                    own.update(words)
                    for chunk in set(words):
                        k = keys.get(chunk)
                        if k is None:
                            keys[chunk] = [key]
                        elif len(k) < min_docs:
                            k.append(key)
                    held, size, key = held + len(own) + len(keys), size + len(text), key + 1
                    if held > ENTRIES or size > TEXT_BYTES:
                        yield from flush()
                        held, size, counts, where = 0, 0, {}, {}
        yield from flush()

    return groups_of.select("lang", "g", "text").mapInArrow(run, _PARTS.format("name")).withColumnRenamed("name", "chunk")


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _lists_of(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return col.value_lengths().to_numpy().astype(np.int64), col.flatten().to_numpy(zero_copy_only=False)


def _summed(of: np.ndarray, names: int, keys: tuple, gs: tuple, ns: np.ndarray, most: int) -> tuple:
    """Rows numbered ``of`` by name, summed by it: distinct keys, ``most`` at most, and a count for each group.

    Lists are (lengths, values), of rows going in and of names coming out.
    """
    own, order = np.repeat(of, keys[0]), np.lexsort((keys[1], np.repeat(of, keys[0])))
    own, value = own[order], keys[1][order]
    new = np.r_[True, (own[1:] != own[:-1]) | (value[1:] != value[:-1])][: len(own)]
    own, value = own[new], value[new]
    at = np.arange(len(own)) - np.searchsorted(own, own)
    own, value = own[at < most], value[at < most]
    name, order = np.repeat(of, gs[0]), np.lexsort((gs[1], np.repeat(of, gs[0])))
    name, g, n = name[order], gs[1][order], ns[order]
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (g[1:] != g[:-1])][: len(name)])
    count = lambda x: np.bincount(x, minlength=names)
    return (count(own), value), (count(name[first]), g[first]), np.add.reduceat(n, first) if len(first) else n


def _named(langs: pa.Array, names: pa.Array, keys: tuple, gs: tuple, ns: np.ndarray) -> pa.RecordBatch:
    cols = [langs, names, _lists(*keys, pa.int64()), _lists(*gs, pa.int64()), _lists(gs[0], ns, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["lang", "name", "keys", "gs", "ns"])


def tokenized(chunks: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, keys, gs, ns), partial rows: every globally distinct chunk is tokenized once, and its sums joined to its terms.

    All rows of a chunk meet in one task, sorted; they are as many as tasks have counted it. Terms
    are summed over ``BLOCK_BYTES`` of rows before they move on, so one that stands in very many chunks does so in few rows.
    """
    term = re.compile(TERM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_terms = None, []
        for batch in gathered(batches, BLOCK_BYTES):
            lang, chunk = batch.column(0).dictionary_encode(), batch.column(1)
            starts = np.r_[0, np.flatnonzero(pc.not_equal(chunk.slice(1), chunk.slice(0, len(chunk) - 1)).to_numpy(zero_copy_only=False)) + 1]
            known, own, times, sizes = {}, [], [], []
            for c in chunk.take(pa.array(starts)).to_pylist():
                if c != last:  # one chunk may go on from the block before
                    last, last_terms = c, Counter(term.findall(c))
                sizes.append(len(last_terms))
                for t, n in last_terms.items():
                    own.append(known.setdefault(t, len(known)))
                    times.append(n)
            if not own:
                continue
            sizes = np.array(sizes, np.int64)
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(chunk)]))
            row = np.repeat(np.arange(len(chunk)), sizes[run_of])
            at = _ragged((np.cumsum(sizes) - sizes)[run_of], sizes[run_of])
            name, of = np.unique(lang.indices.to_numpy()[row].astype(np.int64) * len(known) + np.array(own, np.int64)[at], return_inverse=True)
            lists = []
            for col in (2, 3, 4):
                lengths, values = _lists_of(batch.column(col))
                lists.append((lengths[row], values[_ragged((np.cumsum(lengths) - lengths)[row], lengths[row])]))
            keys, gs, (_, ns) = lists
            keys, gs, ns = _summed(of, len(name), keys, gs, ns * np.repeat(np.array(times, np.int64)[at], gs[0]), min_docs)
            yield _named(lang.dictionary.take(pa.array(name // len(known))), pa.array(list(known), pa.string()).take(pa.array(name % len(known))), keys, gs, ns)

    dealt = chunks.repartition("chunk").sortWithinPartitions("chunk")
    return dealt.mapInArrow(run, _PARTS.format("name")).withColumnRenamed("name", "term")


def kept_terms(parts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, gs, ns): the terms of ``min_docs`` documents or more with their counts by group.

    Documents are told apart by their keys up to that number: a document that holds a term in two chunks counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last term so far, which may go on
        for batch in gathered(batches, BLOCK_BYTES):
            if held is not None:
                batch = pa.Table.from_batches([held, batch.rename_columns(held.schema.names)]).combine_chunks().to_batches()[0]
            lang, term = batch.column(0), batch.column(1)
            differs = lambda c: pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            new = np.r_[True, differs(lang) | differs(term)]
            starts = pa.array(np.flatnonzero(new))
            (_, ns) = _lists_of(batch.column(4))
            keys, gs, ns = _summed(np.cumsum(new) - 1, len(starts), _lists_of(batch.column(2)), _lists_of(batch.column(3)), ns, min_docs)
            out = _named(lang.take(starts), term.take(starts), keys, gs, ns)
            done, held = out.slice(0, len(starts) - 1), out.slice(len(starts) - 1)
            yield done.filter(pa.array(keys[0][:-1] >= min_docs))
        if held is not None:
            yield held.filter(pc.greater_equal(pc.list_value_length(held.column(2)), min_docs))

    dealt = parts.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, _PARTS.format("name")).select("lang", F.col("name").alias("term"), "gs", "ns")


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.limit(SMALL + 1).count() <= SMALL else side


def term_counts(documents: DataFrame, min_docs: int = 3, lang_col="lang", source_col="source", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(groups, kept): groups (lang, source, g) that occur, g their number; kept (lang, term, gs, ns) with counts by g.

    Chunks are counted by document and group inside the tasks and meet by chunk, where each is
    tokenized once; terms meet by (lang, term). What moves are rows of (chunk, counts of its groups)
    and of (term, counts of its groups), summed before each shuffle, never a row for each document.
    """
    empty = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    rows = documents.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text")).withColumn("g", F.xxhash64("lang", "source"))
    groups = saved(rows.select("lang", "source", "g").distinct())
    if groups.groupBy("g").count().where("count > 1").limit(1).count():
        raise RuntimeError("two groups have one number")
    return groups, saved(kept_terms(tokenized(chunk_counts(rows, min_docs), min_docs), min_docs))


def _share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(UNIT (n + 1) / (total + kinds)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(kinds > 0, F.call_function("div", wide(n + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + kinds)) + 1)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are UNIT + 1 at most, so the square fits in 64 bits."""
    return _div((p - q) * (p - q), q)


def divergence(documents: DataFrame, min_docs: int = 3, top: int = 200, lang_col="lang", source_col="source", text_col="text") -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's terms depart from its language and from the other sources.

    Kept terms are those in ``min_docs`` documents of the language. With p the smoothed share of a
    term in a group and q that in another, f = floor((p - q)^2 / q). Part ``pair``: for each other
    source of the language f summed over all kept terms; part ``term``: the ``top`` terms that the
    group uses more than its language. Ranks go by value descending, then item.

    Terms that a group lacks all have one share, so only those present are joined: the sum over a
    pair is that of all terms absent from both, corrected for the terms present in one (from counts
    of equal shares) and for those present in both (from counts of equal pairs of counts). Sums stay below 2^63 while a
    language keeps fewer than 10^9 terms.

    Null texts, languages and sources count as empty. Groups without kept terms are given pairs
    too, with value 0 if their language keeps no term. Repeated rows are documents of their own;
    texts of any length are read whole. An empty table gives no rows. Other columns are ignored.
    """
    groups, kept = term_counts(documents, min_docs, lang_col, source_col, text_col)
    whole = kept.withColumn("lang_n", F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n))
    present = whole.select("lang", "term", "lang_n", F.explode(F.arrays_zip("gs", "ns")).alias("x")).select("lang", "term", "lang_n", F.col("x.gs").alias("g"), F.col("x.ns").alias("n"))
    of_lang = whole.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    stats = groups.join(present.groupBy("g").agg(F.sum("n").alias("total")), "g", "left").join(of_lang, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    stats = stats.select("lang", "source", "g", *(zero(c).alias(c) for c in ("total", "kinds", "lang_total")))
    stats = saved(stats.withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("kinds"))))
    shares = present.join(_small(stats.drop("lang")), "g").withColumn("p", _share(F.col("n"), F.col("total"), F.col("kinds")))

    by_lang = shares.withColumn("q", _share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")))
    over = by_lang.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gain(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    other = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = stats.join(_small(other), "lang").where("source <> item")
    both0 = _gain(F.col("p0"), F.col("q0"))
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("kinds") * both0, F.lit(0).cast("long")).alias("v"))
    same = saved(shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("m")))
    mine = same.join(_small(other), "lang").where("source <> item")
    mine = mine.select("lang", "source", "item", (F.col("m") * (_gain(F.col("p"), F.col("q0")) - both0)).alias("v"))
    theirs = same.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q"), "m")
    theirs = theirs.join(_small(stats.select("lang", "source", "p0")), "lang").where("source <> item")
    theirs = theirs.select("lang", "source", "item", (F.col("m") * (_gain(F.col("p0"), F.col("q")) - both0)).alias("v"))
    counted = F.arrays_zip("gs", "ns")
    met = whole.where(F.size("gs") > 1).select(F.explode(counted).alias("a"), counted.alias("all")).select("a", F.explode("all").alias("b")).where("a.gs <> b.gs")
    met = met.select(F.col("a.gs").alias("g"), F.col("a.ns").alias("n"), F.col("b.gs").alias("h"), F.col("b.ns").alias("m"))
    met = met.groupBy("g", "h", "n", "m").agg(F.count("*").alias("times"))  # terms of equal counts in both
    mine_ = stats.select("g", "lang", "source", "p0", "total", "kinds")
    theirs_ = stats.select(F.col("g").alias("h"), F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("total").alias("h_total"))
    met = met.join(_small(mine_), "g").join(_small(theirs_), "h")
    met = met.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kinds"))).withColumn("q", _share(F.col("m"), F.col("h_total"), F.col("kinds")))
    meet = _gain(F.col("p"), F.col("q")) - _gain(F.col("p"), F.col("q0")) - _gain(F.col("p0"), F.col("q")) + both0
    shared = met.select("lang", "source", "item", (F.col("times") * meet).alias("v"))
    each = [x.groupBy("lang", "source", "item").agg(F.sum("v").alias("v")) for x in (base, mine, theirs, shared)]
    summed = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    paired = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(paired)


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.ln FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS tot, count(*) OVER (PARTITION BY lang, source) AS v, sum(ln) OVER (PARTITION BY lang, source) AS ltot FROM x),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (tot + v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (ln + 1)) // (ltot + v))::BIGINT AS q FROM s),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_ AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""
