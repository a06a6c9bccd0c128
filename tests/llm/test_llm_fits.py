"""The two fits against brute force: their objectives, gradients, samples and scores."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from mensura.llm import common, quality, toxicity

TEXTS = ["you idiot. nice day. nice day.", "nice day! lovely tree", "what an idiot you are", "a tree. an idiot. a day.", "rain", "the rain. the tree."]


def brute_noisy_or(texts, y, weight, bias):
    """Mean negative log-likelihood from the definition, sentence by sentence."""
    total = 0.0
    for t, label in zip(texts, y):
        none = 1.0
        for a, b in toxicity.sentences(t):
            words = toxicity.sentence_words(t, (a, b))
            if words:
                z = bias + sum(weight.get(i, 0.0) for w in words for i in toxicity.word_features(w))
                none *= 1 - 1 / (1 + math.exp(-z))
        total -= math.log(1 - none if label else none)
    return total / len(texts)


def test_noisy_or_objective_gradient_and_score(spark):
    y = [1, 0, 1, 1, 0, 0]
    sample = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(zip(y, TEXTS))], "_id long, _y int, _text string")
    used = toxicity.telling(sample)
    known = {i for t in TEXTS for s in toxicity._sentence_features(t) for i in s}
    rate = {f: [sum(f in {i for s in toxicity._sentence_features(t) for i in s} for t, v in zip(TEXTS, y) if v == k) for k in (0, 1)] for f in known}
    assert set(used.tolist()) == {f for f, (a, b) in rate.items() if b > (a + b) * np.mean(y)}
    bags = toxicity.bags(sample, used)
    order = [TEXTS.index(r._text) for r in sample.collect()]
    rng = np.random.default_rng(0)
    w = np.append(rng.normal(size=len(used)) * 0.3, -1.0)
    value, grad = bags.loss(w)
    brute = lambda w: brute_noisy_or([TEXTS[k] for k in order], [y[k] for k in order], dict(zip(used.tolist(), w)), w[-1])
    assert abs(value - brute(w)) < 1e-9
    for k in range(len(w)):
        e = np.eye(len(w))[k] * 1e-6
        assert abs(grad[k] - (brute(w + e) - brute(w - e)) / 2e-6) < 1e-6
    model = toxicity.NoisyOr.fit(bags, used)
    fitted = dict(zip(used.tolist(), model.weights[used].tolist()))
    for r in toxicity.score(sample, model, "_id", "_text").collect():
        assert abs(r.score - (1 - math.exp(-brute_noisy_or([TEXTS[r._id]], [0], fitted, model.bias)))) < 1e-5
        for s in r.sentences:
            assert "idiot" in TEXTS[r._id][s.start : s.end]


def test_words_of_compounds_and_of_scripts_without_blanks():
    whole = set(toxicity.word_features("donaudampfidiot"))
    assert whole & set(toxicity.word_features("idiot")) and whole & set(toxicity.word_features("wasserdampfidiot"))
    one = toxicity.sentence_words("你是一个坏蛋吗", (0, 7))
    assert set(toxicity.word_features(one.pop())) & set(toxicity.word_features("坏蛋"))


def brute_risk(w, p, u, prior):
    loss = lambda z: math.log(1 + math.exp(-z))
    z = lambda x: float(np.dot(x, w[:-1]) + w[-1])
    positive = sum(loss(z(x)) for x in p) / len(p)
    bracket = sum(loss(-z(x)) for x in u) / len(u) - prior * sum(loss(-z(x)) for x in p) / len(p)
    return prior * positive + max(0.0, bracket), bracket


def test_non_negative_risk_and_its_direction():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (20, 3)).astype(np.float32), rng.normal(0, 1, (30, 3)).astype(np.float32)
    seen = set()
    for scale in (0.1, 1.0, 3.0, -3.0):
        w = np.append(rng.normal(size=3) * scale, 4 * np.sign(scale))
        for prior in (0.3, 0.95):
            risk, grad = quality.descent(w, p, u, prior)
            want, bracket = brute_risk(w, p, u, prior)
            seen.add(bracket >= 0)
            assert abs(risk - want) < 1e-5
            aim = (lambda v: brute_risk(v, p, u, prior)[0]) if bracket >= 0 else (lambda v: -brute_risk(v, p, u, prior)[1])
            for k in range(4):
                e = np.eye(4)[k] * 1e-3
                assert abs(grad[k] - (aim(w + e) - aim(w - e)) / 2e-3) < 2e-3
    assert seen == {True, False}


def test_samples_have_one_row_for_each_id(spark):
    """One id in ten thousand rows, null ids and labels, labels that disagree, clashing columns."""
    many = spark.range(10_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rest = spark.createDataFrame([(1, "one"), (3, None), (4, ""), (6, "six. seven."), (7, "x"), (None, "none")], "doc_id long, text string")
    docs = many.unionByName(rest).withColumn("p", F.lit(1)).withColumn("_y", F.lit("clash")).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (2, 0, 0), (3, 1, 0), (4, 1, None), (6, 1, 0), (7, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r._id: (r._y, r._text) for r in common.labelled_sample(labels, docs, "toxic", 100).collect()}
    free = {i for i in (1, 2, 3, 4, 6, 7) if zlib.crc32(str(i).encode()) % 5}
    assert got == {i: v for i, v in {1: (1, "one"), 2: (1, "text 0"), 3: (0, ""), 6: (0, "six. seven.")}.items() if i in free}
    assert {r[0] for r in quality._web_sample(docs, "doc_id", 100).collect()} == free
    assert quality._web_sample(docs, "doc_id", 2).count() == 2
    n = docs.count()
    for out in (quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels))):
        assert out.count() == n and out.where("score < 0 or score > 1 or score is null").count() == 0
        assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 2").select("score").distinct().count() >= 1
    none = toxicity.fit(docs, labels.where("toxic is null"))
    assert toxicity.score(docs, none).count() == n
    few = common.labelled_sample(labels, docs, "toxic", 100)
    assert toxicity._within(few, 4).count() <= few.count() and toxicity._within(few, 1).count() >= 1
