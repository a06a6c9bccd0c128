"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import Remembered, held_out, labelled_sample, map_batches, saved, table

#: Labelled documents used for fitting at most, UTF-8 bytes of their texts, and hash buckets of the features.
SAMPLE, SAMPLE_BYTES, BUCKETS = 4000, 64 << 20, 1 << 18
#: Features that the model keeps.
KEEP = 1000
#: Words that a worker remembers in each of two generations; bounds memory only.
REMEMBERED = 200_000
#: A sentence of at least this score is reported as offending.
OFFENDING = 0.5
_SENTENCE = re.compile(r"[^.!?\n。！？]+")
#: Letters of scripts that are written without blanks between words.
_RUN = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORDS = re.compile(rf"[^\W\d_{_RUN}]+|[{_RUN}]+").findall
_UNPARTED = re.compile(rf"[{_RUN}]").match


def word_features(word: str) -> list[int]:
    """Hash buckets of a lower-cased word's beginnings of 3 to 6 letters, and of a short word itself.

    Beginnings generalise over endings; weights of rare whole words would only recall the sample. A
    word of 12 letters or more may be a compound, so that its endings of 4 to 8 letters count
    too. Of a run without blanks between words every two and three neighbouring signs count.
    """
    if _UNPARTED(word):
        parts = [f"{n}{word[k : k + n]}" for n in (2, 3) for k in range(len(word) - n + 1)] or [f"w{word}"]
    else:
        parts = [f"{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n]
        if len(word) < 8:
            parts.append(f"w{word}")
        elif len(word) >= 12:
            parts += [f"{min(n, 6)}{word[-n:][:6]}" for n in range(4, 9)]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def sentence_words(text: str, span: tuple[int, int]) -> set[str]:
    return set(_WORDS(text[span[0] : span[1]].lower()))


@dataclass
class Bags:
    """Labelled documents as bags of sentence patterns, a pattern being the kept features of a sentence.

    ``pattern``: for each (document, pattern) the features' place, flat; ``sizes`` how many each has;
    ``doc`` and ``times`` whose it is and how many sentences of that document have it.
    """

    y: np.ndarray
    doc: np.ndarray
    times: np.ndarray
    sizes: np.ndarray
    pattern: np.ndarray

    def loss(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean negative log-likelihood of the documents' labels, and its gradient; ``w`` ends with the bias."""
        sent = np.repeat(np.arange(len(self.sizes)), self.sizes)
        z = np.clip(np.bincount(sent, w[self.pattern], len(self.sizes)) + w[-1], -30, 30)
        total = np.bincount(self.doc, self.times * np.logaddexp(0, z), len(self.y))  # -log of the chance that no sentence is toxic
        away = np.maximum(-np.expm1(-total), 1e-12)
        value = np.where(self.y, -np.log(away), total).mean()
        factor = np.where(self.y, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0)
        g = factor[self.doc] * self.times / (1 + np.exp(-z))
        return float(value), np.append(np.bincount(self.pattern, g[sent], len(w) - 1), g.sum()) / len(self.y)


@dataclass
class NoisyOr:
    """p(sentence) = sigmoid(bias + weights of its distinct words' features); p(document) = 1 - prod(1 - p)."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, bags: Bags, used: np.ndarray, steps: int = 150, rate: float = 0.15, decay: float = 5e-5) -> NoisyOr:
        """Full-batch Adam on the likelihood of the document labels, over the kept features ``used``."""
        weights = np.zeros(BUCKETS, np.float32)
        if not len(bags.y):
            return cls(weights, -4.0)
        w, m, v = (np.zeros(len(used) + 1) for _ in range(3))
        w[-1] = -5.0
        for step in range(1, steps + 1):
            _, grad = bags.loss(w)
            grad[:-1] += decay * w[:-1]
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights[used] = w[:-1]
        return cls(weights, float(w[-1]))


class _Words(Remembered):
    """Word to the sum of its features' weights."""

    def __init__(self, weights: np.ndarray, most: int = REMEMBERED):
        super().__init__(lambda word: float(weights[word_features(word)].sum()), most)


def _within(sample: DataFrame, most: int) -> DataFrame:
    """The first rows of the sample in order of a hash whose texts hold ``most`` bytes together, one row at least."""
    from pyspark.sql import Window

    # the sample is bounded, and only its ids and lengths are ordered
    order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    lengths = sample.select("_id", F.octet_length("_text").cast("long").alias("n"))
    taken = lengths.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") + F.when(F.col("before") > 0, F.col("n")).otherwise(0) <= most)
    return sample.join(F.broadcast(taken.select("_id")), "_id", "left_semi")


def _sentence_features(text: str) -> list[list[int]]:
    """Features of each sentence with words: those of its distinct words one after another."""
    own = (sentence_words(text, span) for span in sentences(text))
    return [sorted(i for w in words for i in word_features(w)) for words in own if words]


def telling(sample: DataFrame, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` features whose documents are labelled positive most beyond chance, counted on the executors."""

    def make():
        def run(y, col):
            found = [sorted({i for s in _sentence_features(x) for i in s}) for x in col.to_pylist()]
            return y, found

        return run

    fields = [T.StructField("y", T.IntegerType()), T.StructField("f", T.ArrayType(T.IntegerType()))]
    held = map_batches(sample, ["_y", "_text"], fields, make).where(F.size("f") > 0)
    positive = held.agg(F.avg("y")).first()[0] or 0.0
    counts = held.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    expected = F.col("n") * positive
    excess = F.col("p") - expected
    best = counts.where(excess > 0).orderBy(F.desc(excess * excess / expected), "f").limit(keep).collect()
    return np.array(sorted(r.f for r in best), np.int64)


def bags(sample: DataFrame, used: np.ndarray) -> Bags:
    """The sample as patterns of the features ``used``: what the driver holds is bounded by the distinct patterns."""
    place = {int(f): k for k, f in enumerate(used)}

    def make():
        def run(y, col):
            flat, sizes, times = [], [], []
            for x in col.to_pylist():
                count = Counter(tuple(place[i] for i in s if i in place) for s in _sentence_features(x))
                flat.append(np.array([i for p in count for i in p], np.int32).tobytes())
                sizes.append(np.array([len(p) for p in count], np.int32).tobytes())
                times.append(np.array(list(count.values()), np.int32).tobytes())
            return y, flat, sizes, times

        return run

    fields = [T.StructField("y", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("f", "n", "t"))]
    labels, flat, sizes, times = [], [], [], []
    for r in map_batches(sample, ["_y", "_text"], fields, make).where(F.length("n") > 0).toLocalIterator():
        labels.append(r.y)
        for to, data in ((flat, r.f), (sizes, r.n), (times, r.t)):
            to.append(np.frombuffer(data, np.int32))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(labels)), [len(s) for s in sizes])
    return Bags(np.array(labels, bool), doc, join(times).astype(float), join(sizes), join(flat))


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", id_col="doc_id", text_col="text", rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    """A model from labelled documents that are not held out, their texts whole.

    At most ``rows`` documents and ``most_bytes`` of text are learnt from, in order of a hash of the id.
    Ids that repeat count once, with their largest label and smallest text; null ids and labels do
    not count. Features are chosen on the executors; the driver gets patterns of those kept.
    """
    sample = saved(_within(saved(labelled_sample(labels, documents, label, rows, id_col, text_col)), most_bytes))
    used = telling(sample)
    return NoisyOr.fit(bags(sample, used), used)


def score(documents: DataFrame, model: NoisyOr, id_col="doc_id", text_col="text", offending: float = OFFENDING) -> DataFrame:
    """One row for each document row: id, score, sentences (start, end, score of the offending ones).

    Positions are code points, end exclusive. Null and empty texts score 0; texts of any length are
    scored whole. Repeated rows each give a row, null ids too; an empty table gives none; other
    columns are ignored. The model has a fixed size of about 1 MB, so it is broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    threshold = float(np.log(offending / (1 - offending)))

    def make():
        m = shared.value
        known, bias = _Words(m.weights), m.bias
        get = known.__getitem__

        def run(ids, col):
            scores, found = [], []
            for x in col.to_pylist():
                spans = sentences(x) if x else []
                z = np.array([bias + sum(map(get, sentence_words(x, s))) for s in spans])
                scores.append(float(-np.expm1(-np.logaddexp(0, np.clip(z, -30, 30)).sum())) if spans else 0.0)
                found.append([{"start": spans[k][0], "end": spans[k][1], "score": float(1 / (1 + np.exp(-z[k])))} for k in np.flatnonzero(z >= threshold)])
            return ids, scores, found

        return run

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    fields = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("sentences", T.ArrayType(span))]
    return map_batches(documents, [id_col, text_col], fields, make)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").cast("long").alias("n_offending"),
    )
