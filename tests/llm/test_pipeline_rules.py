"""The pipeline's stages against rules written anew here, and rows whose names and values are odd."""

import hashlib
import re

import pytest
import tiktoken
from pyspark.sql import functions as F

from test_llm_text import ascii_words, brute_components, brute_print, brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_rules(spark, tmp_path):
    import corpus_pipeline as pipe
    import public_tokenizers

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(pipe.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    rows = [{r.doc_id: r for r in s.collect()} for s in seen]
    text = lambda r: r.text or ""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(i in rows[1], labels[i]) for i in rows[0] if i in labels]
    assert sum(a == b for a, b in judged) > 0.95 * len(judged)
    prints = {i: brute_print(text(r)) for i, r in rows[1].items()}
    root, least = brute_components(set(prints.values())), {}
    for i, p in sorted(prints.items(), reverse=True):
        least[root[p]] = i
    assert set(rows[2]) == set(least.values())
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = ascii_words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(w[k : k + n]) in windows for w in [ascii_words(t)] for n in sizes for k in range(len(w) - n + 1))
    assert set(rows[3]) == {i for i, r in rows[2].items() if clean(text(r))}
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not brute_secrets(text(r)) and r.n_chars == (len(r.text) if r.text is not None else rows[3][i].n_chars)
        parts = [re.escape(p) for p in text(r).split("[secret]")]
        assert re.fullmatch("(?s:.+)".join(parts), text(rows[3][i])) and (len(parts) > 1) == (r.text != rows[3][i].text)
    ranks = dict(line.split() for line in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))
    import base64

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(k): int(v) for k, v in ranks.items()}, special_tokens={})
    for i, r in rows[5].items():
        ids = enc.encode_ordinary(text(rows[4][i]))
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text(rows[4][i]).encode()).hexdigest()


def test_clashing_columns(spark):
    import corpus_pipeline as pipe

    names = ["_row", "_text", "_doc", "_path", "_blob", "blob", "spans", "_clean", "fp", "score", "copies", "a.b"]
    docs = spark.createDataFrame([(1, "a nice line of words with password = hunter2hunter2 in it", "en", "s", 56), (None, "no id", None, None, 5), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.select("*", *(F.lit(n).alias(n) for n in names))
    for name, stage in pipe.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() == 3 or name == "quality_classifier"
        if name != pipe.STAGES[-1][0]:
            assert out.columns == odd.columns and all(r["a.b"] == "a.b" and r.blob == "blob" for r in out.collect())
    masked = {r.doc_id: r for r in pipe.secret_redaction(spark, odd, SF).collect()}
    assert masked[1].text == "a nice line of words with [secret] in it" and masked[1].n_chars == len(masked[1].text)
    assert masked[None].text == "no id" and masked[3].text is None and masked[3].n_chars is None


@pytest.mark.parametrize("size", [2_000_000])
def test_one_very_long_text(spark, size):
    """Every operator on a text of 2 MB beside short ones; figures of time are printed by pytest's durations."""
    from mensura.llm import bytebpe, decontam, licenses, quality, secrets, simhash, tokencount, toxicity

    part = "the quick brown fox of line {k} has a password = hunter2hunter2{k} and was released under the mit license. "
    long = "".join(part.format(k=k) for k in range(2000)) + "word number of a long text with little in it. " * (size // 46)
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the quick brown fox of line 77 has a password hunter2hunter277 and")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(len(r["items"]) for r in decontam.decontaminate(docs, items).collect()) == [0, 1]
    assert simhash.near_duplicates(docs).count() == 2
    blocks = {r.doc_id: len(r.starts) for r in licenses.scan(docs).collect()}
    assert blocks == {1: 2000, 2: 0}
    found = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert len(found[1]) >= 2000 and not found[2]
    masked = docs.join(secrets.scan(docs), "doc_id").select(secrets.redacted(F.col("text"), F.col("spans")).alias("t")).where("length(t) > 10").first().t
    assert masked.count("[secret]") == 2000 and "hunter2" not in masked
    assert {r.doc_id: r.n_tokens > 400_000 for r in tokencount.token_counts(docs, prefixes=True).collect()} == {1: True, 2: False}
    trip = {r.doc_id: r.decoded_sha256 for r in bytebpe.round_trip(docs).collect()}
    assert trip[1] == hashlib.sha256(long.encode()).hexdigest()
    assert quality.score(docs, quality.fit(docs, labels)).count() == 2 and toxicity.score(docs, toxicity.fit(docs, labels)).count() == 2
