"""Exact token counts at every prefix of a text, by dynamic programming over tokens."""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import Remembered, map_batches, saved, table

#: Tokens above which a document is over the limit.
LIMIT = 4096
#: Chunks (in each of two generations) and token pairs that a worker remembers; bounds memory only.
REMEMBERED = 300_000
SPACE = "▁"
#: Chunks: blanks, then a run of letters and marks, a run of anything else but digits, or one digit.
FINE = r"▁*(?:[\p{L}\p{M}]+|[^\p{L}\p{M}\p{Nd}▁]+|\p{Nd})|▁+"
#: Used where a vocabulary has pieces that cross the finer cuts.
COARSE = r"▁*[^▁]+|▁+"
#: Bytes of texts that are cut into chunks at once, as that takes many times as much; bounds memory only.
CUT_BYTES = 2 << 20
#: Kinds of code points, which tell where chunks begin.
BLANK, LETTER, OTHER, DIGIT = range(4)
#: A stored step between the counts of neighbouring prefixes.
STEP = np.dtype("<i2")


def sign_kinds(fine: bool) -> np.ndarray:
    """The kind of every code point for the chunks of ``FINE``; for those of ``COARSE`` all but blanks are alike."""
    out = np.full(0x110000, OTHER, np.uint8)
    if fine:
        signs = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"[\p{L}\p{M}]+"), (DIGIT, r"\p{Nd}+")):
            out[_codes("".join(regex.findall(pattern, signs)))] = kind
    out[ord(SPACE)] = BLANK
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class PrefixCounter:
    """Token counts of a byte-fallback BPE piece model whose normaliser is the identity.

    A sequence of tokens is the encoding of its text just if every two neighbours encode to
    themselves when joined. So each prefix ends in exactly one token t with: t is a piece, and the
    last token u of the prefix before t is compatible with t. ``count[i] = count[i - len(t)] + 1``.
    Pieces hold blanks only at their start and do not cross the cuts of ``FINE`` (verified when the
    model is loaded, else ``COARSE`` is used), so chunks are independent and their tables add up.

    A table's entries follow from the characters before them, so the table of a chunk goes on from
    that of the chunk before where both begin alike: chunks in order cost only what is new in each.
    Whether two tokens are compatible is decided once and remembered by their numbers.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not any(f(i) for f in kinds)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score) or sp.encode("a  b ", out_type=str)[-1:] != [SPACE]:
            raise ValueError("this model's blanks are not supported")
        self.longest = max(map(len, self.score))
        fine = regex.compile(FINE)
        self.kinds = sign_kinds(all(fine.fullmatch(p) for p in self.score))
        self.pairs: dict[int, bool] = {}
        self.made: dict[str, tuple] = {}
        levels = {v: k for k, v in enumerate(sorted({v for p, v in self.score.items() if len(p) > 1}, reverse=True))}
        self.rank = {p: levels[v] for p, v in self.score.items() if len(p) > 1}
        self.names = list(self.score)
        self.number = {p: k for k, p in enumerate(self.names)}
        self.held, self.last, self.count, self.step = "", [0], [0], []  # of the last chunk, entry by entry
        self.known = _Tables(self)

    def merge(self, text: str) -> list[str]:
        """Tokens by definition: the best-scored neighbours merge first, leftmost among equals."""
        t = list(text)
        while True:
            best, at = None, -1
            for i in range(len(t) - 1):
                r = self.rank.get(t[i] + t[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return t
            t[at : at + 2] = [t[at] + t[at + 1]]

    def _parts(self, piece: str) -> tuple[str, str]:
        """The two tokens whose merge makes a piece of several characters."""
        found = self.made.get(piece)
        if found is None:
            known = self.rank.pop(piece)  # without its own last merge two tokens remain
            found = self.made[piece] = tuple(self.merge(piece))
            self.rank[piece] = known
        return found

    def _joined(self, u: str, t: str) -> bool:
        """Whether u, t is the encoding of u + t.

        Merges are taken back from the latest on. At each moment the two tokens at the border must
        not have a merge of their own that comes earlier than the one taken back next.
        """
        if u[-1] == SPACE:  # runs of blanks have merges of equal score: by definition
            return self.merge(u + t) == [u, t]
        rank, limit = self.rank.get, None
        while True:
            r = rank(u + t)
            if r is not None and (limit is None or r < limit):
                return False
            a = self.rank[u] if len(u) > 1 else -1
            b = self.rank[t] if len(t) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, parts = a, self._parts(u)
                u = parts[-1]
            else:  # on a tie the left one merged first
                limit, parts = b + 1, self._parts(t)
                t = parts[0]
            if len(parts) != 2:  # a piece that merges never make
                return False

    def _decided(self, pair: int) -> bool:
        """``_joined`` of the tokens that a number stands for; signs outside the vocabulary follow its numbers."""
        n = len(self.names)
        u, t = divmod(pair, n)
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        out = self.pairs[pair] = self._joined(self.names[u] if u < n else chr(u - n), self.names[t])
        return out

    def _walk(self, chunk: str) -> None:
        """Fill last tokens, counts and steps for a chunk, from where it parts from the one before."""
        rank, number, known, longest, n_names = self.rank, self.number.get, self.pairs.get, self.longest, len(self.names)
        last, count, step, same = self.last, self.count, self.step, 0
        for a, b in zip(self.held, chunk):
            if a != b:
                break
            same += 1
        self.held = chunk[:same]
        del last[same + 1 :], count[same + 1 :], step[same:]
        for i in range(same + 1, len(chunk) + 1):
            for k in range(max(0, i - longest), i - 1):
                t = chunk[k:i]
                if t in rank:
                    token = number(t)
                    if k == 0:
                        break
                    pair = last[k] * n_names + token
                    fits = known(pair)
                    if self._decided(pair) if fits is None else fits:
                        break
            else:
                k, t = i - 1, chunk[i - 1]
                token = number(t)
            n = 1
            if token is None:
                token, n = n_names + ord(t), len(t.encode())
            n += count[k]
            step.append(n - count[-1])
            count.append(n)
            last.append(token)
        self.held = chunk

    def table(self, chunk: str) -> list[int]:
        """Counts at every prefix of a chunk: table[i] for its first i characters."""
        self._walk(chunk)
        return self.count[:]

    def steps(self, chunk: str) -> bytes:
        """The steps from each count of a chunk's table to the next, as 16-bit numbers; an error beyond these."""
        self._walk(chunk)
        return struct.pack(f"<{len(chunk)}h", *self.step)

    def starts(self, text: str, heads: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of a text begin, in code points, and their bytes; ``heads`` are starts of texts joined in it."""
        codes = _codes(text)
        kind = self.kinds[codes]
        new = np.zeros(len(kind), bool)
        new[1:] = (kind[:-1] != BLANK) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        new[heads] = True
        at = np.flatnonzero(new)
        width = np.ones(len(codes), np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += codes >= least
        return at, np.add.reduceat(width, at, dtype=np.int64)

    def tables(self, text: str, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps of every character of normal texts joined, and where their chunks begin. Each distinct chunk counts once."""
        at, width = self.starts(text, heads)
        ends = np.concatenate([[0], np.cumsum(width)])
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(text.encode())).dictionary_encode()
        order = pc.array_sort_indices(chunks.dictionary)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        steps = pa.array([self.known[c] for c in chunks.dictionary.take(order).to_pylist()], pa.large_binary())
        return np.frombuffer(steps.take(pa.array(place[chunks.indices])).buffers()[2], STEP, len(text)), at

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[i]: tokens of ``text[:i]``, for i from 0 to len(text)."""
        if not text:
            return np.zeros(1, np.int64)
        parts, total, normal = [], 0, self.normal(text)
        at = self.starts(normal)[0].tolist()
        for a, b in zip(at, [*at[1:], len(normal)]):
            t = self.table(normal[a:b])
            parts.append(np.array(t[1:], np.int64) + total)
            total += t[-1]
        out = np.concatenate(parts)
        out[0] = 0  # the empty prefix has no leading blank
        return out


class _Tables(Remembered):
    """Chunk to its prefix table in bytes (``PrefixCounter.steps``); a worker keeps it over all its tasks."""

    def __init__(self, counter: PrefixCounter, most: int = REMEMBERED):
        super().__init__(counter.steps, most)


@functools.lru_cache(4)
def load(path: str | None = None) -> PrefixCounter:
    import public_tokenizers

    return PrefixCounter(path or public_tokenizers.path("piece_bpe_32k.model"))


def steps_of(table: bytes) -> np.ndarray:
    """Steps of a text's stored table: the first of the model's own leading blank joined to that of the first character."""
    steps = np.frombuffer(table, STEP)
    if not len(steps):
        return steps
    steps = steps[1:].copy()
    steps[0] += np.frombuffer(table, STEP, 1)[0]
    return steps


def reach(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens; counts may fall where a merge ends, so the last one counts."""
    held = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(held[-1]) + 1 if len(held) else 0


def token_counts(documents: DataFrame, id_col="doc_id", text_col="text", model: str | None = None, limit: int = LIMIT, tables: bool = False, prefixes: bool = False) -> DataFrame:
    """One row for each document row: id, n_tokens, fit_chars, and on demand the prefix table.

    ``fit_chars`` is the length in code points of the longest prefix of at most ``limit`` tokens.
    ``prefixes`` adds the whole table (``prefix``, see ``prefix_counts``): the count at every prefix, as
    the 16-bit step from each to the next, so that ``budget`` and ``count_at`` answer any truncation or
    budget without the text or the vocabulary. ``tables`` adds it and, for each chunk, its end as a
    code point offset and the count there (``chunk_end``, ``chunk_count``).

    Null and empty texts have no tokens. Special strings are ordinary text. Texts of any length are
    counted whole; memory is bounded by the longest one's table. Repeated rows each give a row; an
    empty table gives none; other columns are ignored. ``model`` is a path on every executor.
    """
    fields = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("fit_chars", T.LongType())]
    if tables or prefixes:
        fields += [T.StructField("prefix", T.BinaryType())]
    if tables:
        fields += [T.StructField("chunk_end", T.ArrayType(T.IntegerType())), T.StructField("chunk_count", T.ArrayType(T.IntegerType()))]

    def make():
        counter = load(model)

        def run(ids, col):
            texts = [x or "" for x in col.to_pylist()]
            sizes = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)  # with the model's own leading blank
            to = np.cumsum(sizes)
            since, some = to - sizes, np.flatnonzero(sizes)
            total, steps, at = np.zeros(len(texts), np.int64), np.zeros(0, STEP), np.zeros(0, np.int64)
            if len(some):
                steps, at = counter.tables("".join(map(counter.normal, texts)), since[some])
                total[some] = np.add.reduceat(steps, since[some], dtype=np.int64)
            spans = list(zip(since.tolist(), to.tolist()))
            fit = [len(x) if n <= limit else reach(steps_of(steps[a:b]), limit) for x, n, (a, b) in zip(texts, total.tolist(), spans)]
            out = [ids, total.tolist(), fit]
            if tables or prefixes:
                out.append([steps[a:b].tobytes() for a, b in spans])
            if tables:
                ends = np.append(at[1:], len(steps))
                sums = np.cumsum(np.add.reduceat(steps, at, dtype=np.int64)) if len(at) else at
                own = list(zip(np.searchsorted(at, since).tolist(), np.searchsorted(at, to).tolist()))
                out.append([ends[i:j] - a - 1 for (i, j), (a, _) in zip(own, spans)])
                out.append([sums[i:j] - (sums[i - 1] if i else 0) for i, j in own])
            return out

        return run

    return map_batches(documents, [id_col, text_col], fields, make, part=CUT_BYTES)


def _from_tables(counted: DataFrame, name: str, answer) -> DataFrame:
    """Adds a long column: ``answer`` of each row's steps and its number in column ``_n``; no text, no vocabulary."""
    others = [c for c in counted.columns if c not in ("_n", name)]
    row = counted.select(F.struct(*others).alias("_row"), "prefix", "_n")

    def make():
        def run(rows, tables, numbers):
            steps = [steps_of(t or b"") for t in tables.to_pylist()]
            return rows, [answer(s, n) if n is not None else None for s, n in zip(steps, numbers.to_pylist())]

        return run

    out = map_batches(row, ["_row", "prefix", "_n"], [T.StructField("_row", row.schema["_row"].dataType), T.StructField(name, T.LongType())], make)
    return out.select("_row.*", name)


def budget(counted: DataFrame, limit: int | Column) -> DataFrame:
    """Adds ``budget_chars``: code points of the longest prefix of at most ``limit`` tokens, a number or a column.

    Reads only the tables of ``token_counts(prefixes=True)``; nothing is encoded again.
    """
    return _from_tables(counted.withColumn("_n", (limit if isinstance(limit, Column) else F.lit(limit)).cast("long")), "budget_chars", reach)


def count_at(counted: DataFrame, chars: int | Column) -> DataFrame:
    """Adds ``n_at``: tokens of the text's first ``chars`` code points (of the whole text, if it is shorter)."""
    at = (chars if isinstance(chars, Column) else F.lit(chars)).cast("long")
    return _from_tables(counted.withColumn("_n", at), "n_at", lambda s, n: int(s[: max(0, n)].sum(dtype=np.int64)))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """The table of prefixes is written to the shared folder; the counts, and what fits the limit, come from it."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.struct("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).alias("row"), "text")
    return saved(token_counts(sized, "row", prefixes=True)).select(
        "row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars"
    )
