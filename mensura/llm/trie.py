"""Conversation prefix trie: nodes met by prefix keys, subtree totals by time-forward processing."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import join_classes, saved, table

#: Conversations in a block, and the most turns that one takes over from the block's first.
BLOCK, TURNS = 20, 4
#: Nodes of a path that one shard holds together: longer paths are cut by depth.
STRETCH = 1024
#: Messages in a queue's memory before it spills.
IN_MEMORY = 200_000
#: Ids in a piece of the list of a node's ends.
PIECE = 4096


class SpillingQueue:
    """A priority queue of tuples: the largest part of a full heap is sorted, written to an unlinked temporary file and merged back as it is popped."""

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.heap, self.runs = most, [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, (item, -1))
        if len(self.heap) > self.most + len(self.runs):
            self._spill()

    def _spill(self) -> None:
        own = sorted(x for x, run in self.heap if run < 0)
        self.heap = [x for x in self.heap if x[1] >= 0]
        keep = len(own) // 2
        self.heap += [(x, -1) for x in own[:keep]]
        file = tempfile.TemporaryFile()  # noqa: SIM115
        for at in range(keep, len(own), 4096):
            pickle.dump(own[at : at + 4096], file, pickle.HIGHEST_PROTOCOL)
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                while True:
                    try:
                        yield from pickle.load(file)
                    except EOFError:
                        return

        self.runs.append(read())
        heapq.heapify(self.heap)
        self._next(len(self.runs) - 1)

    def _next(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heap, (item, run))

    def peek(self) -> tuple | None:
        return self.heap[0][0] if self.heap else None

    def pop(self) -> tuple:
        item, run = heapq.heappop(self.heap)
        if run >= 0:
            self._next(run)
        return item


def _running(rows: DataFrame, key: str, order: list[str], codes: list[str]) -> DataFrame:
    """``rows`` with ``no`` (1, 2, ... within ``key``) and each of ``codes`` replaced by its running exclusive-or within the key.

    Rows are dealt by ranges of (key, order), so the rows of one key may lie in many tasks. Each
    task runs along its own rows; what earlier tasks hold of its first key is one small row for each
    task, and is added afterwards. The key and ``codes`` are integers without nulls.
    """
    spark = rows.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, no, carry = TaskContext.get().partitionId(), None, 0, np.zeros(len(codes), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy()
            values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in codes]) if codes else np.zeros((0, n), np.int64)
            starts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1]
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
            numbers = np.arange(n) - starts[of] + 1
            runs = np.bitwise_xor.accumulate(values, axis=1)
            runs = runs ^ np.where(starts > 0, runs[:, starts - 1], 0)[:, of]
            if last is not None and k[0] == last:
                numbers[of == 0] += no
                runs[:, of == 0] ^= carry[:, None]
            last, no, carry = k[-1], int(numbers[-1]), runs[:, -1].copy()
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            cols |= {c: pa.array(r) for c, r in zip(codes, runs)} | {"no": pa.array(numbers), "pid": pa.array(np.full(n, pid, np.int32))}
            yield pa.RecordBatch.from_pydict(cols)

    schema = T.StructType([*rows.schema.fields, T.StructField("no", T.LongType()), T.StructField("pid", T.IntegerType())])
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    out = saved(dealt.mapInArrow(run, schema))
    ends = out.groupBy("pid").agg(F.min(key).alias("head"), F.max(F.struct(key, "no", *codes)).alias("end")).orderBy("pid").collect()  # a row for each task
    before, offsets = None, []
    for r in ends:
        if before is not None and before[0] == r["head"]:
            offsets.append((r["pid"], *before))
        tail = list(r["end"])
        if before is not None and before[0] == tail[0]:
            tail = [tail[0], tail[1] + before[1], *(a ^ b for a, b in zip(tail[2:], before[2:]))]
        before = tail
    if not offsets:
        return out.drop("pid")
    names = ["pid", key, "_no", *(f"_{c}" for c in codes)]
    added = spark.createDataFrame(offsets, f"pid int, {key} bigint, " + ", ".join(f"{c} bigint" for c in names[2:]))
    joined = out.join(F.broadcast(added), ["pid", key], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    changed = {"no": F.col("no") + zero("_no")} | {c: F.col(c).bitwiseXOR(zero(f"_{c}")) for c in codes}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in out.columns if c != "pid"))


def ordered_turns(conversations: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv, no, content, words): every turn with its place from 1, the SHA-256 of its role and text, and the words of its text.

    Turns go by number, null first; those of one number by their digest. Null roles and texts are
    empty; rows without an id are left out. The text itself is not shuffled.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), content.alias("content"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    return _running(rows, "conv", ["turn", "content"], []).select("conv", "no", "content", "words")


def _taken(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % TURNS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their block's first: (conv, length) and (conv, depth, content, words, length).

    Conversation c takes the first h = crc32(c) % TURNS turns of conversation c - c % BLOCK (all, if
    there are fewer; none, if it is absent) and then has its own turns after the first h.
    """
    sizes = turns.groupBy("conv").agg(F.max("no").alias("n"))
    heads = (
        turns.where((F.col("conv") % BLOCK == 0) & (F.col("no") < TURNS))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("no", "content", "words"))).alias("head"))  # TURNS - 1 at most
        .withColumnRenamed("conv", "first")
    )
    convs = sizes.select("conv", "n", _taken(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % BLOCK).alias("first")).join(heads, "first", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = saved(convs.select("conv", "n", "h", "k", "length", "head"))
    own = turns.where(F.col("no") > _taken(F.col("conv")))
    joined = join_classes(own, convs.drop("head"), ["conv"], "n", turns.count())
    own = joined.select("conv", (F.col("no") - F.col("h") + F.col("k")).alias("depth"), "content", "words", "length")
    taken = convs.select("conv", "length", F.explode("head").alias("t")).select("conv", F.col("t.no").alias("depth"), "t.content", "t.words", "length")
    return convs.select("conv", "length"), own.unionByName(taken)


def _pass_up(rows: DataFrame, tops_only: bool = False, most: int = IN_MEMORY) -> DataFrame:
    """Totals over the nodes of each stretch that lie below a node, itself included: (conv, depth, leaves, saved).

    ``rows`` (conv, depth, top, leaves, saved): nodes, and messages to them from other shards as
    further rows of the same node. A stretch is the nodes of one (conv, depth div STRETCH), a path
    down to its ``top``'s depth. Each shard holds whole stretches, sorted by Spark in reverse level
    order; every node takes what the queue holds for it and sends its total to its parent there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, now, out = SpillingQueue(most), None, []

        def done() -> None:
            depth, conv, top, leaves, saved_ = now
            while (x := queue.peek()) and x[:2] == (-depth, conv):
                _, _, a, b = queue.pop()
                leaves, saved_ = leaves + a, saved_ + b
            if depth > top:
                queue.push((1 - depth, conv, leaves, saved_))
            if depth == top or not tops_only:
                out.append((conv, depth, leaves, saved_))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["conv", "depth", "leaves", "saved"])

        for batch in batches:
            for conv, depth, top, leaves, saved_ in zip(*(c.to_pylist() for c in batch.columns)):
                if now and now[0] == depth and now[1] == conv:
                    now = (depth, conv, top, now[3] + leaves, now[4] + saved_)
                    continue
                if now:
                    done()
                now = (depth, conv, top, leaves, saved_)
            if out:
                yield batch_of()
                out = []
        if now:
            done()
        if out:
            yield batch_of()

    shards = rows.select("conv", "depth", "top", "leaves", "saved").repartition("conv", F.floor(F.col("depth") / STRETCH))
    return shards.sortWithinPartitions(F.desc("depth"), "conv").mapInArrow(run, "conv bigint, depth bigint, leaves bigint, saved bigint")


def subtree_totals(nodes: DataFrame, most: int = IN_MEMORY) -> DataFrame:
    """(conv, depth, n_leaves, saved_tokens): ``leaves`` and ``saved`` of ``nodes`` summed over each node's subtree.

    ``nodes`` (conv, depth, parent, leaves, saved): a node is named by its smallest conversation and
    depth. The nodes of one conversation form a path, as a conversation that is the smallest at a
    node is so at all its nodes below; cut by ``STRETCH`` it gives stretches, dealt to shards by
    hash, so that no shard grows with a hot subtree or one long conversation. Within shards totals
    are passed up in reverse level order (``_pass_up``); each stretch's top is a shard root. Across
    shard roots totals are summed over the tree of stretches, whose pointers double in length each
    round, so rounds grow with the logarithm of its height; what every root sends is then passed up
    once more within its parent's shard.
    """
    block = F.floor(F.col("depth") / STRETCH).alias("block")
    nodes = nodes.withColumn("block", block)
    tops = nodes.groupBy("conv", "block").agg(F.min("depth").alias("top"), F.min_by("parent", "depth").alias("up"))
    nodes = saved(nodes.join(tops.select("conv", "block", "top"), ["conv", "block"]))
    local = _pass_up(nodes, True, most)
    up = tops.select("conv", "block", "top", F.col("up").alias("up_conv"), F.floor((F.col("top") - 1) / STRETCH).alias("up_block"))
    roots = saved(up.join(local.select("conv", F.col("depth").alias("top"), "leaves", "saved"), ["conv", "top"]))
    now = saved(roots.select("conv", "block", "up_conv", "up_block", "leaves", "saved"))
    while now.where(F.col("up_conv").isNotNull()).limit(1).count():
        sent = now.where(F.col("up_conv").isNotNull()).groupBy("up_conv", "up_block").agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b"), F.count("*").alias("n"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        grown = now.join(sent.select(F.col("up_conv").alias("conv"), F.col("up_block").alias("block"), "a", "b"), ["conv", "block"], "left")
        grown = grown.select("conv", "block", "up_conv", "up_block", (F.col("leaves") + zero("a")).alias("leaves"), (F.col("saved") + zero("b")).alias("saved"))
        # where a pointer leads to, by size: very many roots may point to one stretch
        ups = now.select(F.col("conv").alias("up_conv"), F.col("block").alias("up_block"), F.col("up_conv").alias("c2"), F.col("up_block").alias("b2")).join(sent.select("up_conv", "up_block", "n"), ["up_conv", "up_block"])
        jumped = join_classes(grown, saved(ups), ["up_conv", "up_block"], "n", now.count(), "left")
        now = saved(jumped.select("conv", "block", F.col("c2").alias("up_conv"), F.col("b2").alias("up_block"), "leaves", "saved"))
    messages = roots.select("conv", "block", "up_conv", F.col("top") - 1).toDF("conv", "block", "to_conv", "to_depth").where(F.col("to_conv").isNotNull()).join(now.select("conv", "block", "leaves", "saved"), ["conv", "block"])
    messages = messages.groupBy(F.col("to_conv").alias("conv"), F.col("to_depth").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    messages = messages.withColumn("block", block).join(tops.select("conv", "block", "top"), ["conv", "block"])
    cols = ["conv", "depth", "top", "leaves", "saved"]
    return _pass_up(nodes.select(*cols).unionByName(messages.select(*cols)), False, most).select("conv", "depth", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of each node's ``conv`` in decimal, ascending and comma-joined.

    Ids are dealt by ranges, so the ids of one node may lie in many tasks, which join them to pieces of
    ``PIECE``; what hashes a node reads its pieces in order and holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            k1, k2 = now
            return pa.RecordBatch.from_arrays([pa.array([k1]), pa.array([k2]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["k1", "k2", "first", "piece"])

        for batch in batches:
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (now != (k1, k2) or len(held) >= PIECE):
                    yield out()
                    held = []
                now = (k1, k2)
                held.append(conv)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, done = None, None, []
        for batch in batches:
            for k1, k2, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if now == (k1, k2):
                    sha.update(b"," + piece.encode())
                    continue
                if now:
                    done.append((*now, sha.hexdigest()))
                now, sha = (k1, k2), hashlib.sha256(piece.encode())
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["k1", "k2", "ends_sha256"])
                done = []
        if now:
            done.append((*now, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["k1", "k2", "ends_sha256"])

    dealt = ends.select("k1", "k2", "conv").repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    cut = dealt.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, piece string")
    ordered = cut.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "piece")
    return ordered.mapInArrow(digests, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, most: int = IN_MEMORY) -> DataFrame:
    """One row for each node, a distinct sequence of first turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs`` (conv, length), one row for each conversation, also of length 0; ``turns`` (conv,
    depth, content, words, length) with depths 1 to length. A prefix's key is the exclusive-or of
    128-bit hashes of its turns with their depths, so prefixes are found from running keys however
    the turns of a conversation are dealt; rows that meet at a key must agree in their last turn's
    digest (by induction then in all turns), else an error is raised. Nodes are counted before
    they are shuffled; a node of very many members or children is joined by broadcast.

    ``conv_id`` is the smallest member, ``n_leaves`` the childless nodes in the subtree (a childless
    node is its own), ``saved_tokens`` the sum over the subtree of (n_convs - 1) times the words of
    the node's last turn. Conversations without turns are members of the root alone. No
    conversations give no node, not even a root.
    """
    codes = [F.xxhash64(F.lit(s), F.col("depth"), F.col("content")).alias(f"k{s}") for s in (1, 2)]
    coded = turns.select("conv", "depth", "length", "words", F.xxhash64("content").alias("c"), *codes, *(c.alias(f"e{s}") for s, c in zip((1, 2), codes)))
    keyed = saved(_running(coded, "conv", ["depth"], ["k1", "k2"]).drop("no"))
    up = [F.col(f"k{s}").bitwiseXOR(F.col(f"e{s}")) for s in (1, 2)]
    met = keyed.groupBy("k1", "k2", "depth").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("c").alias("c"), F.max("c").alias("c_max"), F.max("words").alias("words"), F.min(up[0]).alias("u1"), F.min(up[1]).alias("u2")
    )
    differ = F.raise_error(F.lit("two prefixes have one key"))
    met = met.select("k1", "k2", "depth", F.when(F.col("c") == F.col("c_max"), F.col("conv")).otherwise(differ).alias("conv"), "n_convs", "words", "u1", "u2")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv", "n_convs", zero.alias("words"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"))
    nodes = saved(met.unionByName(root))
    children = nodes.where("depth > 0").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = saved(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv").alias("parent"), "n_children")
    below = nodes.where("depth > 0").withColumnRenamed("n_children", "_children")
    below = join_classes(below, parents, ["u1", "u2"], "n_children", nodes.count()).withColumnRenamed("_children", "n_children")
    tree = saved(below.unionByName(nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))).drop("u1", "u2"))
    own = tree.select("conv", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    ends = keyed.where("depth = length").select("k1", "k2", "conv").unionByName(convs.where("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = tree.join(subtree_totals(own, most), ["conv", "depth"]).join(ends_digests(ends), ["k1", "k2"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(saved(ordered_turns(table(spark, sf_dir, "conversations")))))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS ts,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda e, i: xor(e >> 1, 3988292384 * (e & 1))))) % 4 AS h FROM t GROUP BY c),
r AS (SELECT o.c, list_concat(coalesce(b.ts[1:o.h], []), o.ts[o.h + 1:]) AS ts FROM o LEFT JOIN o b ON b.c = o.c - o.c % 20),
p AS (SELECT c, d, ts[1:d] AS pre, len(ts) AS n FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT pre, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM p GROUP BY pre, d),
k AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(pre[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN k USING (pre)),
s AS (SELECT pre[1:a] AS pre, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY ALL)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN s USING (pre) LEFT JOIN n u ON w.d > 0 AND u.pre = w.pre[1:w.d - 1]
"""
