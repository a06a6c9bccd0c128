"""Classifiers on held-out labels, embeddings and archives against brute force, and the whole pipeline."""

import gzip
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import embeddings, quality, toxicity, warc
from mensura.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def _auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.95), ("op7_quality", "quality", 0.99)])
def test_classifiers(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES[name](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert _auc([(s, y) for s, y, _ in held]) > least
    hits = sum(p == y for _, y, p in held)
    assert hits / len(held) > 0.97


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(["you idiot. nice day.", "nice day. lovely tree.", None, ""] * 30)], "doc_id long, text string, score double")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert rows[0].score > 0.5 > rows[1].score and rows[2].score == rows[3].score == 0.0
    assert (rows[0].sentences[0].start, rows[0].sentences[0].end) == (0, 9) and not rows[1].sentences
    none = toxicity.fit(docs.where("false"), labels)
    assert toxicity.score(docs.where("false"), none).count() == 0 and toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).count() == docs.count()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["A nice line here.\nAnd more of it.", "BUY!! NOW!! BUY!!", None, ""] * 30)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("quality"))
    rows = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert rows[0] > rows[1] and rows[2] == rows[3]
    assert quality.score(docs, quality.fit(docs, labels.where("false"))).count() == docs.count() and quality.score(docs.where("false"), quality.fit(docs, labels)).count() == 0


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (3000, 4)), rng.normal(-1.5, 1, (3000, 4))
    u = np.concatenate([p[:1400], n[:600]])
    assert abs(quality.estimated_prior(p[1400:].astype(np.float32), u.astype(np.float32)) - 0.7) < 0.08
    m = quality.PUModel.fit(p[1400:].astype(np.float32), u.astype(np.float32))
    acc = ((p @ m.weights + m.bias) > 0).mean() / 2 + ((n @ m.weights + m.bias) < 0).mean() / 2
    assert acc > 0.95


def _brute_vectors(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            (_, x, l1), (_, y, l2) = good[a], good[b]
            if l1 == l2 and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[good[k][0]] = (len(links[k]), min(good[j][0] for j in seen))
    return {i: out.get(i, (0, i)) for i, _, _ in rows}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + (rng.normal(size=16) * 0.05 if i >= 60 else 0)], i % 60 % 3) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, rows[1][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    monkeypatch.setattr(embeddings, "SHARD", 40)
    monkeypatch.setattr(embeddings, "LARGEST", 60)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    want = _brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert got.keys() == want.keys()
    found, true = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert 0.95 * true <= found <= true
    same = sum(got[i].component_id == want[i][1] for i in want) / len(want)
    assert same > 0.97 and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_graph_reaches_all():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:200] = x[0] + rng.normal(size=(100, 8)) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = embeddings.build_graph(x)
    assert len(embeddings._reach(g, embeddings.medoid(x))) == 300
    true = x @ x.T >= 0.98
    found = sum(len(embeddings.search(x, [sorted(s) for s in g], embeddings.medoid(x), q)) for q in x)
    assert found >= 0.95 * true.sum()


def test_archives(spark, tmp_path):
    long = "<p>" + "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 20
    rows = [(3, "http://b\nx", long), (2, "http://a", long), (9, None, long), (2, "http://a", long), (5, "u", None), (6, "u", ""), (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", "tiny"), (4, "u", "tiny"), (10, "v", "x" * 99), (11, "v", "x" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("revisit", F.lit(2))
    for parts in (1, 4):
        path = str(tmp_path / f"w{parts}")
        warc.write_warc(pages.repartition(parts), path)
        found = warc.read_warc(spark, path)
        assert found.count() == 3 * len(rows) and found.select("record_id").distinct().count() == 3 * len(rows)
        caps = warc.captures(found).collect()
        assert len(caps) == len(rows) and all(c.answer and c.request and c.metadata for c in caps)
        got = sorted((c.metadata.fields.get("page-id", ""), c.answer.kind, c.metadata.fields.get("refers-to-page", ""), c.answer.payload_bytes, c.answer.payload_digest) for c in caps)
        least = {long: 2, "é" * 60: 7}
        want = []
        for i, _, h in rows:
            b = (h or "").encode()
            again = len(b) >= 100 and least[h] != i
            want.append(("" if i is None else str(i), "revisit" if again else "response", str(least[h]) if again else "", len(b), hashlib.sha256(b).hexdigest()))
        assert got == sorted(want)
        assert {bytes(c.answer.payload).decode() for c in caps if c.answer.payload is not None} == {long, "", "é" * 60, "tiny", "x" * 99}
    warc.write_warc(pages.where("false"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    loose = "".join(warc.records(pages).select(F.concat("record", F.lit("\n")).alias("r")).toPandas()["r"]).encode()
    assert len(list(warc.parse(loose))) == 3 * len(rows)
    two = gzip.compress(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n") * 2
    assert [b for _, b in warc.parse(two)] == [b"hi", b"hi"]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipe

    from mensura.llm import bytebpe, decontam, secrets, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, seen = docs, []
    for name, stage in pipe.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, SF).write.parquet(path)
        before, now = now, spark.read.parquet(path)
        seen.append(now)
        if name != pipe.STAGES[-1][0]:
            assert now.columns == docs.columns and now.count() > 0
    kept, unique, clean, hidden, coded = seen
    scored = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scored.items() if s >= quality.THRESHOLD}
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in kept.collect()}
    ids = sorted(prints)
    left = {r.doc_id for r in unique.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in left for b in left if a < b)
    assert all(any((prints[a] ^ prints[b]).bit_count() <= 2 for b in ids if b != a) for a in ids if a not in left)
    hits = {r.doc_id for r in decontam.decontaminate(unique, spark.read.parquet(f"{SF}/benchmark.parquet")).where("size(spans) > 0").collect()}
    assert {r.doc_id for r in clean.collect()} == left - hits
    assert hidden.count() == clean.count() and secrets.scan(hidden).where("size(spans) > 0").count() == 0
    bpe = bytebpe.load()
    assert {r.doc_id: r.n_tokens for r in coded.collect()} == {r.doc_id: len(bpe.encode(r.text or "")) for r in hidden.collect()}


def test_pipeline_edges(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(30).unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (7_000_000, None, None, None, None)], docs.schema))
    for stage in (f for _, f in pipe.STAGES):
        assert stage(spark, odd, SF).count() >= 0 and stage(spark, odd.where("false"), SF).count() == 0
    assert pipe.near_duplicate_filter(spark, odd, SF).where("doc_id is null").count() == 2


def test_pipeline_repeated_ids(spark):
    """Different texts with one id are different documents; copies leave one row, whichever ids repeat."""
    import corpus_pipeline as pipe

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    texts = [(1, a), (1, b), (2, b), (1, c), (3, c), (3, d), (4, a), (1, a), (1, a), (0, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for order in (docs, docs.orderBy("text"), docs.orderBy("doc_id", ascending=False)):
        assert sorted((r.doc_id, r.text) for r in pipe.near_duplicate_filter(spark, order, SF).collect()) == [(0, d), (1, a), (1, b), (1, c)]


def test_captures_of_repeated_records(spark, tmp_path):
    """Archives read twice, records that differ under one identifier, records without one: none is lost without a word."""
    pages = spark.createDataFrame([(1, "u", "<p>" + "a" * 200), (2, "v", "b")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    found = warc.read_warc(spark, path)
    twice = found.unionByName(found).repartition(3)
    caps = warc.captures(twice).collect()
    assert len(caps) == 2 and all(tuple(c.records) == (2, 2, 2) and not c.conflicting and c.answer and c.request and c.metadata for c in caps)
    assert warc.others(twice).count() == 0 and {bytes(c.answer.payload) for c in caps} == {b"<p>" + b"a" * 200, b"b"}

    def made(kind, id_, to, digest):
        return (kind, id_, to, "x", {"a": digest}, {}, 1, digest, None)

    rows = [made("response", "r", None, "1"), made("response", "r", None, "2"), made("response", "r", None, "2"), made("metadata", "m1", "r", "3"), made("metadata", "m2", "r", "4")]
    rows += [made("response", None, None, "5"), made("response", None, None, "6"), made("request", "q", "gone", "7"), made("warcinfo", "i", None, "8"), made(None, None, None, "9")]
    mixed = spark.createDataFrame(rows, warc.RECORD).repartition(2)
    got = warc.captures(mixed).collect()
    shown = [x.payload_digest for c in got for x in (c.answer, c.request, c.metadata) if x]
    rest = [r.payload_digest for r in warc.others(mixed).collect()]
    assert len(got) == 4 and set(shown) | set(rest) == set("123456789") and not set(shown) & set(rest)
    r = next(c for c in got if c.capture == "r")
    assert r.conflicting and tuple(r.records) == (3, 0, 2) and r.metadata.record_id == "m2"
    assert sum(c.conflicting for c in got) == 1 and next(c for c in got if c.capture == "gone").answer is None
    assert warc.captures(mixed.limit(0)).count() == 0 and warc.others(mixed.limit(0)).count() == 0
