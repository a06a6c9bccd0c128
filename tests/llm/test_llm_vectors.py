"""Embedding links are symmetric whatever cells, parts and levels the vectors fall into."""

import numpy as np
import pytest

from mensura.llm import embeddings


def brute(rows, least=0.98):
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([label for *_, label in rows])
    near = (x @ x.T >= least) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("centres,shard,largest,apart", [(3, 30, 60, 0.9), (1, 40, 80, 0.999), (2, 50, 70, -1.0)], ids=["levels", "fine", "salted"])
def test_links_are_symmetric(spark, monkeypatch, centres, shard, largest, apart):
    """Cells split by levels, split finely, and (no two centres count as apart) only dealt out by salt."""
    for k, v in {"CENTRES": centres, "SHARD": shard, "LARGEST": largest, "APART": apart, "CELL_SAMPLE": 200}.items():
        monkeypatch.setattr(embeddings, k, v)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(90, 12))
    rows = [(i, [float(x) for x in base[i % 90] + (rng.normal(size=12) * 0.04 if i >= 90 else 0)], i % 90 % 2) for i in range(560)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(140)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    near = brute(rows)
    want = near.sum(1)
    links = np.array([got[i].n_links for i, *_ in rows])
    assert (links <= want).all() and links.sum() % 2 == 0 and links.sum() >= 0.95 * want.sum()
    size = {}
    for r in got.values():
        size[r.component_id] = size.get(r.component_id, 0) + 1
    assert all((size[r.component_id] > 1) == (r.n_links > 0) for r in got.values())
    assert all(got[r.component_id].component_id == r.component_id for r in got.values())


def test_the_graph_is_searched_not_read_off(monkeypatch):
    """Building and searching meet a part of the pairs only, and still find the links."""
    seen = [0]
    plain = embeddings._visit

    def counted(*args):
        r, c = plain(*args)
        seen[0] += len(r)
        return r, c

    monkeypatch.setattr(embeddings, "_visit", counted)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 24))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.05, base + rng.normal(size=base.shape) * 0.05])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = embeddings.padded(embeddings.build_graph(x))
    built, seen[0] = seen[0], 0
    found = embeddings.search_all(x, graph, embeddings.medoid(x), x)
    assert built < 0.5 * len(x) ** 2 and seen[0] < 0.7 * len(x) ** 2
    true = x @ x.T >= 0.98
    assert not (found & ~true).any() and found.sum() >= 0.95 * true.sum()


@pytest.mark.parametrize("spread", [0.006, 0.02], ids=["inner", "border"])
def test_one_dense_cluster(spark, monkeypatch, spread):
    """A label that is one cluster in several parts: every link is counted, by bounds alone or at the border."""
    monkeypatch.setattr(embeddings, "LARGEST", 150)
    rng = np.random.default_rng(11)
    centre = rng.normal(size=24)
    centre /= np.linalg.norm(centre)
    rows = [(i, (centre + rng.normal(size=24) * spread * (1 + i % 2)).tolist(), 1) for i in range(700)]
    rows += [(1000 + i, rng.normal(size=24).tolist(), 2 + i % 2) for i in range(60)] + [(2000 + i, rng.normal(size=24).tolist(), 1) for i in range(40)]
    rows += [(3000 + i, rows[3][1], 1) for i in range(9)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows)
    links = np.array([got[i].n_links for i, *_ in rows])
    assert (links == want.sum(1)).mean() >= 0.99 and (links <= want.sum(1)).all()
    assert len({got[i].component_id for k, (i, *_) in enumerate(rows) if want[k].any()}) == 1 and min(got[i].component_id for i in range(700)) == 0


@pytest.mark.parametrize("block", [16 * 50, 1 << 20], ids=["blocks", "one"])
def test_links_that_the_search_misses(spark, monkeypatch, block):
    """A search of one cell and a narrow beam misses links; the exact check over pairs of blocks adds every one."""
    for k, v in {"OVERLAP": 1, "BEAM": 1, "RECALL": 0.0, "CENTRES": 6, "SHARD": 40, "BLOCK": block}.items():
        monkeypatch.setattr(embeddings, k, v, raising=False)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    chain = [base + t * np.linalg.norm(base, axis=1, keepdims=True) * np.eye(16)[0] for t in (0, 0.1, 0.25)]
    rows = [(3 * i + k, chain[k][i].tolist(), i % 2) for i in range(150) for k in range(3)]
    rows += [(1000 + i, (base[0] + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(60)] + [(2000 + i, rows[9][1], rows[9][2]) for i in range(5)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    near = brute(rows)
    ids, least = [i for i, *_ in rows], np.array([i for i, *_ in rows])
    for _ in ids:
        least = np.minimum(least, np.where(near, least[None, :], 1 << 40).min(1))
    assert {i: (got[i].n_links, got[i].component_id) for i in ids} == {i: (n, c) for i, n, c in zip(ids, near.sum(1).tolist(), least.tolist())}
    assert got[0].recall < 1
