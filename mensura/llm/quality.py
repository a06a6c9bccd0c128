"""Quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import Remembered, held_out, map_batches, one_text_each, saved, table

#: Trusted positives, and unlabelled documents, used for fitting at most.
POSITIVES, UNLABELLED = 4000, 6000
#: Hash buckets of token shapes; other features follow them.
BUCKETS = 384
#: Tokens that a worker remembers in each of two generations; bounds memory only.
REMEMBERED = 200_000
#: Documents below this score are rejected.
THRESHOLD = 0.3
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def shape(token: str) -> str:
    """Letters as one sign by case, digits as 9, the rest as it is: ``Word.###`` gives ``A.###``."""

    def run(m):
        w = m[0]
        return "a" if w.islower() else "U" if len(w) > 1 and w.isupper() else "A" if w[0].isupper() and (len(w) == 1 or w[1:].islower()) else "m"

    return _DIGITS.sub("9", _LETTERS.sub(run, token))[:12]


class _Shapes(Remembered):
    """Token to the bucket of its shape."""

    def __init__(self, most: int = REMEMBERED):
        super().__init__(lambda token: zlib.crc32(shape(token).encode()) % BUCKETS, most)


def features(text: str | None, shapes: dict) -> np.ndarray:
    """Square roots of the shares of token shapes, then measures of length and repetition."""
    text = text or ""
    tokens = text.split()
    n = max(1, len(tokens))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.bincount(np.fromiter(map(shapes.__getitem__, tokens), np.int64, len(tokens)), minlength=BUCKETS)
    more = [
        np.log1p(len(tokens)) / 10,
        len(text) / n / 10 if tokens else 0,
        len(set(tokens)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(tokens) / max(1, len(lines))) / 5,
        min(1.0, 50 / n),
    ]
    return np.concatenate([np.sqrt(counts / n), more]).astype(np.float32)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class PUModel:
    weights: np.ndarray
    bias: float
    prior: float

    @classmethod
    def fit(cls, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> PUModel:
        """Minimises prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]) with the logistic loss.

        When the bracket falls below 0 the step goes against its gradient, as the non-negative
        estimator asks. Without a prior it is estimated from how the two samples' scores differ.
        """
        if not len(positive) or not len(unlabelled):
            return cls(np.zeros(positive.shape[1] if positive.ndim > 1 else BUCKETS + 6), 0.0, prior if prior is not None else 1.0)
        if prior is None:
            prior = estimated_prior(positive, unlabelled)
        prior = float(np.clip(prior, 0.01, 0.99))
        w, m, v = (np.zeros(positive.shape[1] + 1) for _ in range(3))
        for step in range(1, steps + 1):
            _, grad = descent(w, positive, unlabelled, prior)
            grad[:-1] += decay * w[:-1]
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(w[:-1], float(w[-1]), prior)


def descent(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(risk, direction) at weights and bias ``w``: the gradient of the risk, or that of the negated bracket while it is below 0."""
    w32 = w[:-1].astype(np.float32)
    zp, zu = positive @ w32 + w[-1], unlabelled @ w32 + w[-1]
    sp, su = _sigmoid(zp), _sigmoid(zu)
    bracket = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, bracket)
    gp, gu = -prior * sp / len(zp), su / len(zu)  # gradient of the bracket
    if bracket >= 0:
        gp = gp + prior * (sp - 1) / len(zp)
    else:
        gp, gu = -gp, -gu
    return float(risk), np.append(gp.astype(np.float32) @ positive + gu.astype(np.float32) @ unlabelled, gp.sum() + gu.sum())


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of the shares of U and P above a cut.

    Any region holds at least prior * P(region) of the unlabelled; the cuts are those of a plain
    discriminator between the samples, and each keeps at least a tenth of the positives. The cut
    taken has the least ratio after two standard errors are added, as the least of noisy ratios
    would be too small.
    """
    x = np.concatenate([positive, unlabelled])
    y = np.repeat([1.0, 0.0], [len(positive), len(unlabelled)])
    share = np.where(y > 0, 1 / len(positive), 1 / len(unlabelled))
    w = np.zeros(x.shape[1] + 1)
    for _ in range(300):
        g = (_sigmoid(x @ w[:-1].astype(np.float32) + w[-1]) - y) * share
        w -= 2.0 * np.append(g.astype(np.float32) @ x + 1e-4 * w[:-1], g.sum())
    zp, zu = positive @ w[:-1], unlabelled @ w[:-1]
    cuts = np.quantile(zp, np.linspace(0, 0.9, 46))
    found = []
    for c in cuts:
        a, b = (zu >= c).mean(), max(1e-9, (zp >= c).mean())
        error = np.sqrt(a * (1 - a) / len(zu)) / b + a * np.sqrt(b * (1 - b) / len(zp)) / b**2
        found.append((a / b + 2 * error, a / b))
    return float(min(found)[1])


def _web_sample(documents: DataFrame, id_col: str, rows: int) -> DataFrame:
    """(_id): at most ``rows`` distinct ids that are not held out, by a hash of the id.

    About how many ids there are is counted first; a cut of the hash then leaves few more than are
    asked for, so neither the number of rows of an id nor that of all ids matters to the shuffle.
    """
    ids = documents.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull() & ~held_out("_id"))
    n = ids.agg(F.approx_count_distinct("_id", 0.02)).first()[0]
    wanted = 1.2 * rows + 6 * rows**0.5 + 30  # more than the count's error and chance can take away
    if n > 2 * wanted:
        ids = ids.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 40)) < int(wanted / n * (1 << 40)))
    return ids.distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", id_col="doc_id", text_col="text", positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> PUModel:
    """A model from bounded samples, by a hash of the id, of rows that are not held out.

    Trusted positives are the documents labelled 1; the unlabelled are taken from all documents.
    Labelled negatives serve no end: the prior is estimated from the two samples. Ids that repeat
    count once, with their largest label and smallest text, so a sample has one row for each id;
    null ids and labels do not count. Without positives or documents the model scores 0.5.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where(~held_out("_id") & F.col("_y").isNotNull() & F.col("_id").isNotNull())
    trusted = known.groupBy("_id").agg(F.max("_y").alias("_y")).where("_y = 1").orderBy(F.xxhash64("_id"), "_id").limit(positives)
    picked = trusted.select("_id", F.lit(True).alias("p"), F.lit(False).alias("u")).unionByName(_web_sample(documents, id_col, unlabelled).select("_id", F.lit(False).alias("p"), F.lit(True).alias("u")))
    picked = saved(picked.groupBy("_id").agg(F.max("p").alias("p"), F.max("u").alias("u")))
    texts = saved(one_text_each(documents, picked, id_col, text_col))

    def make():
        shapes = _Shapes()

        def run(p, u, col):
            return p, u, [features(x, shapes).tobytes() for x in col.to_pylist()]

        return run

    fields = [T.StructField("p", T.BooleanType()), T.StructField("u", T.BooleanType()), T.StructField("x", T.BinaryType())]
    rows = map_batches(texts, ["p", "u", "_text"], fields, make).toLocalIterator()
    out: tuple[list, list] = ([], [])
    for r in rows:
        x = np.frombuffer(r.x, np.float32)
        if r.p:
            out[0].append(x)
        if r.u:
            out[1].append(x)
    wide = BUCKETS + 6
    return PUModel.fit(*(np.array(x, np.float32).reshape(-1, wide) for x in out), prior=prior)


def score(documents: DataFrame, model: PUModel, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) for each document row: the model's probability of good quality, whole texts.

    Null and empty texts are scored as texts without tokens; texts of any length are read whole.
    Repeated rows each give a row, null ids too; an empty table gives none; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def make():
        w, b = shared.value
        shapes = _Shapes()

        def run(ids, col):
            x = np.array([features(t, shapes) for t in col.to_pylist()], np.float32).reshape(-1, len(w))
            return ids, _sigmoid((x @ w).astype(float) + b)

        return run

    return map_batches(documents, [id_col, text_col], [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("score", T.DoubleType())], make)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
