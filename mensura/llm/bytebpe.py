"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import Remembered, map_batches, table

#: Pre-tokens that a worker remembers in each of two generations; bounds memory, never results.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class PerfectHash:
    """Minimal perfect hash by hashing and displacement: n keys to n slots without collisions.

    Keys fall into buckets of 2.5 on average; the largest buckets first, each gets the smallest
    displacement that sends all its keys to free slots; buckets of one key come last and store
    the free slot itself, as a negative number. A lookup computes one slot, and compares the key
    held there, so foreign keys are refused.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n * 2 // 5)
        self.shift = [0] * self.buckets
        self.slot: list[int] = [-1] * n
        for self.seed in range(64):
            groups: list[list] = [[] for _ in range(self.buckets)]
            for i, k in enumerate(keys):
                h = xxhash.xxh3_64_intdigest(k, self.seed)
                groups[(h >> 40) % self.buckets].append((h & 0xFFFFF, h >> 20 & 0xFFFFF | 1, i))
            if self._place(groups):
                return
        raise ValueError("no perfect hash found; keys repeat")

    def _place(self, groups) -> bool:
        n, slot, free = self.n, [-1] * self.n, 0
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if len(group) < 2:
                for _, _, i in group:
                    while slot[free] >= 0:
                        free += 1
                    slot[free] = i
                    self.shift[b] = -free - 1
                continue
            for d in range(64 * n):
                at = {(p + d * q + (d >> 8)) % n: i for p, q, i in group}
                if len(at) == len(group) and all(slot[s] < 0 for s in at):
                    break
            else:
                return False
            self.shift[b] = d
            for s, i in at.items():
                slot[s] = i
        self.slot = slot
        return True

    def place(self, key: bytes) -> int:
        """The number of the only key that could equal ``key``."""
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.shift[(h >> 40) % self.buckets]
        if d < 0:
            return self.slot[-d - 1]
        return self.slot[((h & 0xFFFFF) + d * (h >> 20 & 0xFFFFF | 1) + (d >> 8)) % self.n]


class ByteBPE:
    """Encoder and decoder for ranks over bytes; equal to the reference library's ordinary encoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.keys = list(ranks)
        self.ids = [ranks[k] for k in self.keys]
        self.hash = PerfectHash(self.keys)
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.packed_id = {i: i.to_bytes(4, "little") for i in self.ids}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: whole by the perfect hash, else merged."""
        k = self.hash.place(piece)
        return [self.ids[k]] if self.keys[k] == piece else self._merge(piece)

    def _merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals: a heap of merges over a linked list of spans."""
        get, n = self.ranks.get, len(piece)
        bits = n.bit_length()
        mask = (1 << bits) - 1
        end = list(range(1, n + 1))  # span starting at i ends at end[i]; next span starts there
        prev = list(range(-1, n - 1))
        # rank of the merge of the span at i with the next; a heap entry with another rank is stale
        now = [get(piece[i : i + 2], -1) for i in range(n)]
        now[-1] = -1
        heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i = x & mask
            if now[i] != x >> bits:
                continue
            j = end[i]
            to = end[i] = end[j]
            now[j] = now[i] = -1
            if to < n:
                prev[to] = i
                if (r := get(piece[i : end[to]])) is not None:
                    now[i] = r
                    push(heap, r << bits | i)
            if (p := prev[i]) >= 0:
                if (r := get(piece[p:to])) is not None:
                    now[p] = r
                    push(heap, r << bits | p)
                else:
                    now[p] = -1
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [t for p in self.split(text) for t in self.encode_piece(p.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Packed(Remembered):
    """Pre-token to its ids as little-endian 32-bit bytes."""

    def __init__(self, bpe: ByteBPE, most: int = REMEMBERED):
        four = bpe.packed_id.__getitem__
        super().__init__(lambda piece: b"".join(map(four, bpe.encode_piece(piece.encode()))), most)


@functools.lru_cache(4)
def load(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The encoder of a rank file, built once in each worker process."""
    import public_tokenizers

    return ByteBPE(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def encode(documents: DataFrame, id_col="doc_id", text_col="text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each document row: id, ids (array of token ids), n_tokens.

    ``ranks`` is the path of a rank file on every executor, by default the public 50k one. Special
    strings are ordinary text. Null and empty texts give no tokens; repeated rows each give a row;
    an empty table gives none; other columns are ignored. Whole texts are encoded, and memory is
    bounded by the longest text, one Arrow batch and ``REMEMBERED`` pre-tokens.
    """

    def make():
        bpe = load(ranks, pattern)
        packed = _Packed(bpe)

        def run(ids, col):
            import pyarrow as pa

            parts = [b"".join(map(packed.__getitem__, bpe.split(x))) if x else b"" for x in col.to_pylist()]
            flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            counts = np.array([len(p) // 4 for p in parts], np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            return ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), counts

        return run

    fields = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    return map_batches(documents, [id_col, text_col], fields, make)


def decode(encoded: DataFrame, id_col="doc_id", ids_col="ids", ranks: str | None = None) -> DataFrame:
    """(id, decoded): the bytes that the ids stand for; null ids give empty bytes."""

    def make():
        bpe = load(ranks)

        def run(ids, col):
            return ids, [bpe.decode(x or ()) for x in col.to_pylist()]

        return run

    return map_batches(encoded, [id_col, ids_col], [T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())], make)


def round_trip(documents: DataFrame, id_col="doc_id", text_col="text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit), decoded_sha256.

    Encoding, packing and decoding of a batch happen in one pass, so token arrays are never moved.
    """

    def make():
        bpe = load(ranks, pattern)
        packed = _Packed(bpe)
        sha = hashlib.sha256

        def run(ids, col):
            n, a, b = [], [], []
            for x in col.to_pylist():
                p = b"".join(map(packed.__getitem__, bpe.split(x))) if x else b""
                n.append(len(p) // 4)
                a.append(sha(p).hexdigest())
                b.append(sha(bpe.decode(np.frombuffer(p, "<u4").tolist())).hexdigest())
            return ids, n, a, b

        return run

    fields = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return map_batches(documents, [id_col, text_col], fields, make)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
