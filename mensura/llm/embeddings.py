"""Embedding near-duplicates: a robust-pruned flat graph over overlapping shards, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mensura.llm.common import join_classes, saved, table
from mensura.llm.components import connected_components

#: Cosine from which two vectors link.
COSINE = 0.98
#: Vectors in a shard aimed at, those of other cells that join it included, and at most; a larger cell
#: is split, or dealt out by salt if it cannot be.
SHARD, LARGEST = 600, 2500
#: Vectors that the shard centres are fitted on at most, centres at most, and cells each vector joins.
SAMPLE, CENTRES, OVERLAP = 20_000, 4096, 3
#: Levels of splitting, vectors of a cell that its own centres are fitted on, and centres of a cell, at most.
LEVELS, CELL_SAMPLE, CELL_CENTRES = 4, 4000, 512
#: Centres closer than this are one: a cell of such alone is of one kind, and is not split.
APART = 0.9
#: Near and far neighbours in the graph, candidates each, pruning factor, width of the search and of that at building.
NEAR, FAR, POOL, ALPHA, BEAM, BUILD_BEAM = 20, 8, 64, 1.2, 32, 16
#: Vectors searched for together, which bounds memory.
TOGETHER = 256
#: Slack, in radians, of bounds by angles: pairs so near a bound are verified.
SLACK = 1e-6
#: Cosine below the threshold down to which the range search still expands.
MARGIN = 0.04
#: Vectors whose links are compared with brute force, and the recall asked for.
AUDIT, RECALL = 1000, 0.9
#: Components of the vectors in a block of the exact check, at most.
BLOCK = 1 << 20


def _unit(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors, started from evenly spaced rows of the sample."""
    c = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 2048] @ c.T).argmax(1) for a in range(0, len(sample), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-12), c)
    return c


def apart(c: np.ndarray) -> np.ndarray:
    """Centres of which no two are of one kind."""
    kept: list[np.ndarray] = []
    for one in c:
        if all(one @ o < APART for o in kept):
            kept.append(one)
    return np.array(kept)


def robust_prune(x: np.ndarray, p: int, pool: np.ndarray, most: int, alpha: float = ALPHA) -> list[int]:
    """Neighbours of p from a pool: the nearest is taken, and those it covers by factor alpha go, and so on."""
    away = np.sqrt(np.maximum(0, 2 - 2 * (x[pool] @ x[p])))
    order = np.argsort(away, kind="stable")
    pool, away = pool[order], away[order]
    own = x[pool]
    between = alpha * np.sqrt(np.maximum(0, 2 - 2 * (own @ own.T)))
    open_ = pool != p
    out: list[int] = []
    for i in range(len(pool)):
        if open_[i]:
            out.append(int(pool[i]))
            if len(out) == most:
                break
            open_ &= between[i] > away
    return out


def padded(graph, wide: int | None = None) -> np.ndarray:
    """Neighbour lists as a matrix; rows are filled up with the node itself."""
    wide = wide or max((len(g) for g in graph), default=0) or 1
    out = np.repeat(np.arange(len(graph), dtype=np.int32)[:, None], wide, 1)
    for p, g in enumerate(graph):
        out[p, : len(g)] = list(g)
    return out


def _visit(x: np.ndarray, near: np.ndarray, like: np.ndarray, rows: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of the nodes' neighbours that a query has not met; they are put into ``like`` and returned as pairs."""
    next_ = near[nodes]
    r, c = np.nonzero(like[rows[:, None], next_] < -1.5)
    r, c = rows[r], next_[r, c]
    like[r, c] = np.einsum("pd,pd->p", x[c], queries[r])
    return r, c


def walk(x: np.ndarray, near: np.ndarray, start: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Greedy searches from ``start``, many together: cosines of the nodes that each query met, -2 elsewhere.

    Each search expands the best node that is not expanded yet, and stops when its ``beam`` best are.
    """
    n, m = len(x), len(queries)
    like, expanded = np.full((m, n), -2.0), np.zeros((m, n), bool)
    like[:, start] = queries @ x[start]
    live = np.arange(m)
    while len(live):
        own = like[live]
        best = np.where(expanded[live], -3.0, own).argmax(1)
        value = own[np.arange(len(live)), best]
        worst = np.partition(own, n - beam, 1)[:, n - beam] if n > beam else np.full(len(live), -2.0)
        go = (value > -1.5) & (value >= worst) & ~expanded[live, best]
        live, best = live[go], best[go]
        expanded[live, best] = True
        _visit(x, near, like, live, best, queries)
    return like


def build_graph(x: np.ndarray, seed: int = 0) -> list[set[int]]:
    """Adjacency of one shard of unit vectors: a flat graph that starts random and takes in one vector after another.

    Each is searched for greedily from the medoid in the graph as it stands; what the search met is
    robust-pruned to its near neighbours, which take it as theirs and are pruned anew where they have
    too many. Random far neighbours stay. Every node can be reached from the medoid: what a walk
    from there misses is tied to it.
    """
    n = len(x)
    if n == 1:
        return [set()]
    rng = np.random.default_rng(seed)
    far = [set(rng.choice(n, min(n, FAR), replace=False).tolist()) - {p} for p in range(n)]
    graph = [set(f) for f in far]
    wide = 2 * (NEAR + FAR)
    near, m = padded(graph, wide), medoid(x)

    def put(p: int, own: set) -> None:
        graph[p] = own
        near[p] = p
        near[p, : len(own)] = list(own)

    order = rng.permutation(n)
    for at in range(0, n, TOGETHER):
        batch = order[at : at + TOGETHER]
        like = walk(x, near, m, x[batch], min(BUILD_BEAM, n))
        for p, row in zip(batch.tolist(), like):
            met = np.flatnonzero(row > -1.5)
            if len(met) > POOL:
                met = met[np.argpartition(-row[met], POOL)[:POOL]]
            pool = np.array(sorted({*met.tolist(), *graph[p]} - {p}), np.int64)
            own = set(robust_prune(x, p, pool, NEAR)) | far[p]
            put(p, own)
            for q in own:
                other = graph[q]
                if p in other:
                    continue
                if len(other) < wide:
                    near[q, len(other)] = p
                    other.add(p)
                else:
                    put(q, set(robust_prune(x, q, np.array(sorted(other | {p}), np.int64), NEAR)) | far[q])
    seen = _reach(graph, m)
    for p in range(n):
        if p not in seen:
            graph[m].add(p)
            graph[p].add(m)
            seen |= _reach(graph, p)
    return graph


def _reach(graph, start: int) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for q in graph[todo.pop()]:
            if q not in seen:
                seen.add(q)
                todo.append(q)
    return seen


def medoid(x: np.ndarray) -> int:
    """The vector nearest to the shard's mean."""
    return int((x @ x.mean(0)).argmax())


def search_all(x: np.ndarray, near: np.ndarray, start: int, queries: np.ndarray, least: float = COSINE, beam: int = BEAM) -> np.ndarray:
    """For each query which vectors have a cosine of at least ``least``, as found by a walk that then expands its range.

    From the nodes in range, or within a margin of it, neighbours are followed as long as they are
    too. What is returned has been verified by its cosine in double precision.
    """
    like = walk(x, near, start, queries, beam)
    rows, nodes = np.nonzero(like >= least - MARGIN)
    while len(rows):
        new = []
        for at in range(0, len(rows), 4096):
            r, c = _visit(x, near, like, rows[at : at + 4096], nodes[at : at + 4096], queries)
            ok = like[r, c] >= least - MARGIN
            new.append(np.stack([r[ok], c[ok]]))
        rows, nodes = np.unique(np.concatenate(new, 1), axis=1)
    return like >= least


def search(x: np.ndarray, graph, start: int, q: np.ndarray, least: float = COSINE, beam: int = BEAM) -> np.ndarray:
    """Indices that ``search_all`` finds for one query over neighbour lists."""
    return np.flatnonzero(search_all(x, padded(graph), start, q[None], least, beam)[0])


_GRAPH = T.StructType([T.StructField("rid", T.LongType()), T.StructField("near", T.ArrayType(T.LongType()))])
_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("rid", "root", "links", "pairs")])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("rid", ignore_index=True)
    ids = pdf["rid"].to_numpy()
    graph = build_graph(_matrix(pdf["vec"]))
    return pd.DataFrame({"rid": ids, "near": [ids[sorted(g)] for g in graph]})


def _searcher(least: float, beam: int):
    """Searches of one cell's own vectors in one part of it; a link is counted for both of its ends.

    Two vectors may meet in the home cells of both. That of the smaller name settles whether they
    link, and in a common home cell the search of the smaller rid does: so links are symmetric.
    """

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if members.empty or queries.empty:
            return pd.DataFrame({c: [] for c in _FOUND.names})
        members = members.sort_values("rid", ignore_index=True)
        ids, x = members["rid"].to_numpy(), _matrix(members["vec"])
        at = {r: k for k, r in enumerate(ids.tolist())}
        near = padded([[at[r] for r in near if r in at] for near in members["near"]])
        copies, homes, cell = members["n"].to_numpy(), members["home"].to_numpy(), members["cell"].iloc[0]
        rid, own, start = queries["rid"].to_numpy(), queries["n"].to_numpy(), medoid(x)
        parent: dict[int, int] = {}
        links: dict[int, int] = dict.fromkeys(rid.tolist(), 0)
        pairs = links.copy()

        def find(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for first in range(0, len(rid), TOGETHER):
            found = search_all(x, near, start, _matrix(queries["vec"][first : first + TOGETHER]), least, beam)
            for k, row in enumerate(found, first):
                r, other = int(rid[k]), np.flatnonzero(row)
                if not len(other):
                    continue
                home = homes[other]
                both = np.isin(home, queries["cells"].iloc[k])  # the other's home cell holds this vector too
                settle = np.where(home == cell, ids[other] > r, ~both | (home > cell))
                other = other[settle]
                links[r] += int(copies[other].sum())
                pairs[r] += len(other)
                for j in ids[other].tolist():
                    links[j] = links.get(j, 0) + int(own[k])
                    pairs[j] = pairs.get(j, 0) + 1
                    a, b = find(r), find(j)
                    parent[max(a, b)] = min(a, b)
        nodes = sorted(links)
        return pd.DataFrame({"rid": nodes, "root": [find(r) if r in parent else r for r in nodes], "links": [links[r] for r in nodes], "pairs": [pairs[r] for r in nodes]})

    return run


def _verifier(least: float):
    """One part of a cell of one kind against all that ask: bounds by angles to the cell's middle settle most pairs.

    By the triangle inequality two vectors link if their angles add up to no more than that of
    ``least``, and do not if they differ by more; what lies between is verified, block by block.
    Vectors at home here each count their own links, as all ask all parts; those of other homes
    are settled as in other cells.
    """
    reach = float(np.arccos(least))

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if members.empty or queries.empty:
            return pd.DataFrame({c: [] for c in _FOUND.names})
        members = members.assign(guest=members["rank"] > 0).sort_values(["guest", "angle"], ignore_index=True)
        ids, copies, x, homes, cell = members["rid"].to_numpy(), members["n"].to_numpy(), _matrix(members["vec"]), members["home"].to_numpy(), members["cell"].iloc[0]
        at_home = int((~members["guest"]).sum())
        angle = members["angle"].to_numpy()[:at_home]
        upto = np.r_[0, np.cumsum(copies[:at_home])]
        place = {r: k for k, r in enumerate(ids[:at_home].tolist())}
        kind, least_id, joined, found, guests = np.arange(len(ids)), ids.copy(), 0, [], {}

        def unite(nodes: np.ndarray, rid: int) -> int:
            """The members ``nodes``, and a query's name, become one kind."""
            kinds = np.unique(kind[nodes])
            to = kinds[0]
            if len(kinds) > 1:
                kind[np.isin(kind, kinds)] = to
            least_id[to] = min(int(least_id[kinds].min()), rid)
            return int(nodes[0])

        for first in range(0, len(queries), TOGETHER):
            q = queries.iloc[first : first + TOGETHER]
            own, theta, sure = _matrix(q["vec"]), q["angle"].to_numpy(), q["sure"].to_numpy(bool)
            k = np.where(sure, 0, np.searchsorted(angle, reach - SLACK - theta, "right"))
            end = np.where(sure, 0, np.searchsorted(angle, reach + SLACK + theta, "right"))
            start = np.minimum(np.maximum(k, np.searchsorted(angle, theta - reach - SLACK, "left")), end)
            asks = end > start
            lo, hi = (int(start[asks].min()), int(end[asks].max())) if asks.any() else (0, 0)
            place_ = np.arange(lo, hi)
            near = (own @ x[lo:hi].T >= least) & (place_ >= start[:, None]) & (place_ < end[:, None])
            links = upto[k] + near @ copies[lo:hi]
            pairs = k + near.sum(1)
            other = own @ x[at_home:].T >= least
            for j, (rid, n, cells) in enumerate(zip(q["rid"].tolist(), q["n"].tolist(), q["cells"])):
                nodes = place_[near[j]]
                if not sure[j] and rid in place:
                    links[j] -= n
                    pairs[j] -= 1
                if k[j]:
                    if k[j] > joined:
                        unite(np.arange(k[j]), rid)
                        joined = int(k[j])
                    nodes = np.r_[0, nodes]
                met = at_home + np.flatnonzero(other[j])
                if len(met):
                    met = met[~np.isin(homes[met], cells) | (homes[met] > cell)]
                    links[j] += copies[met].sum()
                    pairs[j] += len(met)
                    for g in met.tolist():
                        a, b = guests.get(g, (0, 0))
                        guests[g] = (a + n, b + 1)
                    nodes = np.r_[nodes, met]
                found.append((rid, unite(nodes, rid) if len(nodes) else -1, int(links[j]), int(pairs[j])))
        rows = [(r, int(least_id[kind[node]]) if node >= 0 else r, links, pairs) for r, node, links, pairs in found]
        rows += [(int(r), int(least_id[kind[j]]), 0, 0) for j, r in enumerate(ids.tolist()) if least_id[kind[j]] != r]
        rows += [(int(ids[g]), int(ids[g]), a, b) for g, (a, b) in guests.items()]
        return pd.DataFrame(rows, columns=_FOUND.names)

    return run


def _dense_links(members: DataFrame, total: int, least: float) -> DataFrame:
    """Links of cells of one kind, which are dealt out by salt: those that bounds settle for a whole cell need no search.

    A vector whose angle to the cell's middle and the cell's radius add up to less than the angle of
    ``least`` links with all at home there, so it is given their number and asks no part. The others
    ask every part, as does who may link with a vector of another home.
    """
    key = [members.schema[k] for k in _CELL]
    share = F.pmod(F.xxhash64("rid", F.lit(77)), F.lit(1 << 40)) < F.lit(float(CELL_SAMPLE << 40)) / F.col("many")

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        head, m = pdf.iloc[0], _matrix(pdf["vec"]).mean(0)
        return pd.DataFrame({**{k: [head[k]] for k in _CELL}, "middle": [m.tolist()]})

    sample = members.where("rank = 0").where(share).select(*_CELL, "vec")
    middles = sample.groupBy(*_CELL).applyInPandas(middle, T.StructType([*key, T.StructField("middle", T.ArrayType(T.DoubleType()))]))
    sized = saved(members.groupBy(*_CELL).agg(F.count("*").alias("rows")).join(middles, _CELL, "left"))

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            angles = []
            for vec, m in zip(_matrix(pdf["vec"]) if len(pdf) else [], pdf["middle"]):
                size = 0.0 if m is None else np.linalg.norm(m)
                angles.append(float(np.arccos(np.clip(vec @ m / size, -1, 1))) if size > 1e-9 else float(np.pi))
            yield pdf.drop(columns=["middle"]).assign(angle=angles)

    schema = T.StructType([*members.schema.fields, T.StructField("angle", T.DoubleType())])
    placed = saved(join_classes(members, sized, _CELL, "rows", total, "left").select(*members.columns, "middle").mapInPandas(measure, schema))
    own = F.col("rank") == 0
    facts = placed.groupBy(*_CELL).agg(
        F.max(F.when(own, F.col("angle"))).alias("radius"), F.sum(F.when(own, F.col("n"))).alias("copies"), F.count_if(own).alias("homes"), F.min(F.when(own, F.col("rid"))).alias("hub"), F.min(F.when(~own, F.col("angle"))).alias("guest"), F.count("*").alias("rows")
    )
    known = saved(join_classes(placed, saved(facts), _CELL, "rows", total, "left"))
    reach = float(np.arccos(least))
    sure = F.col("angle") + F.col("radius") <= reach - SLACK
    settled = known.where(own & sure).select("rid", F.col("hub").alias("root"), (F.col("copies") - F.col("n")).alias("links"), (F.col("homes") - 1).alias("pairs"))
    asked = known.where(own & (~sure | F.coalesce(F.col("angle") >= F.col("guest") - reach - SLACK, F.lit(False)))).withColumn("sure", sure)
    shard = ["label", "size", "cell", "salt"]
    asked = asked.select("label", "size", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "rid", "vec", "n", "cells", "angle", "sure")
    near = known.where(own | (F.col("angle") <= reach + F.col("radius") + SLACK)).select(*shard, "rid", "vec", "n", "rank", "home", "angle")
    searched = near.groupBy(*shard).cogroup(asked.toDF(*asked.columns).groupBy(*shard)).applyInPandas(_verifier(least), _FOUND)
    return settled.unionByName(searched)


def _nearest(own: pd.DataFrame, c: np.ndarray, overlap: int) -> np.ndarray:
    like = _matrix(own["vec"]) @ c.T
    return np.argsort(-like, axis=1, kind="stable")[:, : min(overlap, len(c))]


def _assign(reps: DataFrame, by_size: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """Members (cell by rank): each vector in its ``overlap`` nearest cells; rank 0 is its home."""
    shared = reps.sparkSession.sparkContext.broadcast(by_size)
    schema = T.StructType([*reps.schema.fields, T.StructField("cell", T.StringType()), T.StructField("rank", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cents = shared.value
        for pdf in parts:
            for size, own in pdf.groupby("size", sort=False):
                for r, top in enumerate(_nearest(own, cents[int(size)], overlap).T):
                    yield own.assign(cell=[f"{k:04d}" for k in top], rank=np.int32(r))

    return reps.mapInPandas(run, schema)


_CELL = ["label", "size", "cell"]


def _cell_centres(n_col: str = "members"):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        x = _matrix(pdf["vec"][: 2 * CELL_SAMPLE])
        kept = apart(centres(x, int(min(CELL_CENTRES, -(-int(head[n_col]) // SHARD)))))
        return pd.DataFrame({**{k: [head[k]] for k in _CELL}, "members": [head[n_col]], "centres": [[c.tolist() for c in kept]]})

    return run


def _split(placed: DataFrame, overlap: int) -> DataFrame:
    """Cells above ``LARGEST`` cut by centres of their own, level by level; cells of one kind stay as they are.

    Centres are fitted in each cell on a bounded sample by hash; its vectors are assigned in chunks,
    so neither the number of cells nor the size of one is bounded by a task or the driver.
    """
    done = None
    for level in range(LEVELS):
        sizes = placed.groupBy(*_CELL).agg(F.count("*").alias("members")).where(F.col("members") > LARGEST)
        if sizes.isEmpty():
            break
        total = placed.count()
        sizes = saved(sizes.withColumn("rows", F.col("members")))
        known = saved(join_classes(placed, sizes, _CELL, "rows", total, "left"))
        big = known.where("members is not null")
        share = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(1 << 40)) < F.lit(float(CELL_SAMPLE << 40)) / F.col("members")
        key = [placed.schema[k] for k in _CELL]
        schema = T.StructType([*key, T.StructField("members", T.LongType()), T.StructField("centres", T.ArrayType(T.ArrayType(T.DoubleType())))])
        fitted = saved(big.where(share).select(*_CELL, "members", "vec").groupBy(*_CELL).applyInPandas(_cell_centres(), schema)).where(F.size("centres") > 1)
        chunks = F.ceil(F.col("members") / 20_000).cast("int")
        cents = fitted.select(*_CELL, "centres", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))

        def cut(own: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if own.empty or c.empty:
                return own.drop(columns=["chunk"])
            grid = np.array([np.asarray(v, float) for v in c["centres"].iloc[0]])
            home = own["rank"].to_numpy() == 0
            out = []
            for r, top in enumerate(_nearest(own, grid / np.linalg.norm(grid, axis=1, keepdims=True), overlap).T):
                part = own if r == 0 else own[home]  # who is at home here joins more of the new cells
                names = top if r == 0 else top[home]
                rank = part["rank"] if r == 0 else np.int32(r)
                out.append(part.assign(cell=[f"{a}.{k:03d}" for a, k in zip(part["cell"], names)], rank=rank))
            return pd.concat(out).drop(columns=["chunk"])

        dealt = big.withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")).drop("members")
        again = dealt.groupBy(*_CELL, "chunk").cogroup(cents.groupBy(*_CELL, "chunk")).applyInPandas(cut, placed.schema)
        rest = known.where("members is null").drop("members")
        done = rest if done is None else done.unionByName(rest)
        placed = saved(again)
    return placed if done is None else saved(done.unionByName(placed))


def _links(reps: DataFrame, by_size, overlap: int, beam: int, least: float) -> DataFrame:
    """(rid, root, links, pairs): links of each vector that shards have settled, and roots of the components seen in each."""
    shard = ["label", "size", "cell", "salt"]
    placed = _split(saved(_assign(reps, by_size, overlap)), overlap)
    parts = saved(placed.groupBy(*_CELL).agg(F.ceil(F.count("*") / LARGEST).cast("int").alias("parts"), F.count("*").alias("rows"), F.count("*").alias("many")))
    cells = placed.groupBy("rid").agg(F.collect_list("cell").alias("cells"), F.max(F.when(F.col("rank") == 0, F.col("cell"))).alias("home"))
    total = placed.count()
    members = join_classes(placed.join(cells, "rid"), parts, _CELL, "rows", total)
    members = saved(members.withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")))
    dense = members.where("parts > 1")
    found = None if dense.isEmpty() else saved(_dense_links(dense, total, least))
    members = members.where("parts = 1")
    built = members.select(*shard, "rid", "vec").groupBy(*shard).applyInPandas(_build, _GRAPH)
    # a node lies in few shards and has few neighbours in each, so its united list is short
    united = saved(built.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    left = members.join(united, "rid").select(*shard, "rid", "vec", "n", "near", "home").groupBy(*shard)
    asked = members.where("rank = 0").select("label", "size", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "rid", "vec", "n", "cells")
    asked = asked.toDF(*asked.columns).groupBy(*shard)  # attributes of its own
    searched = saved(left.cogroup(asked).applyInPandas(_searcher(least, beam), _FOUND))
    return searched if found is None else searched.unionByName(found)


def _checker(least: float):
    """Every pair of two blocks, or of one block with itself: a link is counted for both of its ends."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        alone = len(left) and left["a"].iloc[0] == left["b"].iloc[0]
        if left.empty or (right.empty and not alone):
            return pd.DataFrame({c: [] for c in _FOUND.names})
        both, beside = (left, 0) if alone else (pd.concat([left, right], ignore_index=True), len(left))
        ids, copies, x = both["rid"].to_numpy(), both["n"].to_numpy(), _matrix(both["vec"])
        kind, links, pairs = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for first in range(0, len(left), TOGETHER):
            from_ = beside or first  # within one block, a vector meets those after it
            rows, cols = np.nonzero(x[first : min(first + TOGETHER, len(left))] @ x[from_:].T >= least)
            rows, cols = rows + first, cols + from_
            rows, cols = rows[cols > rows], cols[cols > rows]
            for one, other in ((rows, cols), (cols, rows)):
                np.add.at(links, one, copies[other])
                np.add.at(pairs, one, 1)
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
            for r, own in zip(rows[starts], np.split(cols, starts[1:])):
                kinds = kind[own]
                if (kinds != kind[r]).any():
                    kinds = np.unique(np.r_[kinds, kind[r]])
                    kind[np.isin(kind, kinds)] = kinds[0]
        met = pairs > 0
        least_id = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least_id, kind, ids)
        return pd.DataFrame({"rid": ids[met], "root": least_id[kind][met], "links": links[met], "pairs": pairs[met]})

    return run


def _checked(reps: DataFrame, least: float) -> DataFrame:
    """(rid, root, links, pairs) of all pairs of vectors of a label and length, block by block: no link is left out.

    Blocks are dealt by hash and hold ``BLOCK`` components at most, on average, so a label of any size
    is spread over pairs of blocks; each vector goes to as many tasks as its label has blocks.
    """
    parts = saved(reps.groupBy("label", "size").agg(F.count("*").alias("rows"), F.ceil(F.count("*") * F.col("size") / F.lit(BLOCK)).cast("int").alias("parts")))
    dealt = join_classes(reps.select("rid", "label", "size", "vec", "n"), parts, ["label", "size"], "rows", reps.count())
    dealt = saved(dealt.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("parts")).cast("int")))
    pair, rest = ["label", "size", "a", "b"], ["rid", "vec", "n"]
    left = dealt.select("label", "size", F.col("part").alias("a"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("b"), *rest)
    right = dealt.where("part > 0").select("label", "size", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("a"), F.col("part").alias("b"), *rest)
    right = right.toDF(*right.columns)  # attributes of its own
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(_checker(least), _FOUND)


def recall(reps: DataFrame, found: DataFrame, audit: int, least: float) -> float:
    """The lesser of two shares of what brute force finds for ``audit`` vectors: of links, and of links between classes.

    Half of the audited vectors are a sample by hash of all, half of those with links, so that
    neither classes of many copies nor vectors without links decide alone; brute force compares
    each with all vectors of its label, in one pass over the table. 1 if there are no links.
    """
    spark = reps.sparkSession
    light = reps.select("rid", "label", "vec")
    mixed = light.orderBy(F.xxhash64("rid"), "rid").limit(audit // 2)
    linked = found.where("pairs > 0").select("rid").distinct().orderBy(F.xxhash64("rid"), "rid").limit(audit - audit // 2)
    picked = mixed.unionByName(light.join(F.broadcast(linked), "rid", "left_semi")).dropDuplicates(["rid"]).toPandas()
    shared = spark.sparkContext.broadcast(picked)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = shared.value
        for pdf in parts:
            for (label, size), own in pdf.groupby(["label", "size"], sort=False):
                mine = ask[(ask["label"] == label) & (ask["vec"].map(len) == size)]
                if len(mine):
                    like = _matrix(mine["vec"]) @ _matrix(own["vec"]).T >= least
                    like &= mine["rid"].to_numpy()[:, None] != own["rid"].to_numpy()[None, :]
                    yield pd.DataFrame({"rid": mine["rid"], "want": like @ own["n"].to_numpy(), "between": like.sum(1)})

    true = reps.select("rid", "label", "size", "vec", "n").mapInPandas(run, "rid long, want long, between long").groupBy("rid").agg(F.sum("want").alias("want"), F.sum("between").alias("between"))
    both = true.where("want > 0").join(found.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs")), "rid", "left")
    have = lambda got, want: F.sum(F.least(F.coalesce(got, F.lit(0)), want))
    got, want, pairs, between = both.agg(have("links", "want"), F.sum("want"), have("pairs", "between"), F.sum("between")).first()
    return min(got / want, pairs / between) if want else 1.0


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = COSINE,
    audit: int = AUDIT,
    attempts: int = 3,
) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept, recall.

    Equal vectors of a label are one class from the start; classes are searched, not their copies.
    Centres are fitted on at most ``SAMPLE`` vectors; every class joins the cells of its nearest
    centres, and each label's part of a cell is a shard. Cells above ``LARGEST`` are split by centres
    of their own, level by level, so their number grows with the vectors; a cell of vectors all
    alike is dealt out by salt instead: bounds by angles to its middle settle its inner pairs by
    number, and its border is verified part by part. Graphs of the other cells are built shard by
    shard, adjacency lists of a node united, and each class searches its home cell from the medoid.
    A link that is found counts for both ends. Only the numbers of links and the root of its
    component within the shard leave a shard, never pairs.

    Recall is audited against brute force; below ``RECALL`` the search runs again with twice the
    overlap and beam, ``attempts`` times at most. An exact check follows: all pairs of classes of a
    label are compared block by block, and links that the search missed count like the others. Its
    work grows with the square of a label's classes. ``recall`` is that of the search.

    Null labels, null, empty or zero vectors and those with null or non-finite components link with
    nothing; vectors of different lengths do not link. Repeated rows each give a row (and link, as
    equal vectors); equal cosines are no matter. Ids may be null or repeat. An empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x))
    good = F.coalesce(F.col("label").isNotNull() & finite & (F.size("vec") > 0) & (_unit(F.col("vec")) > 0), F.lit(False))
    usable = rows.where(good)
    reps = usable.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    reps = saved(saved(reps).select(F.monotonically_increasing_id().alias("rid"), "*", F.size("vec").alias("size")))
    sizes = reps.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()
    largest = {r["size"]: r["n"] for r in reps.groupBy("size", "label").agg(F.count("*").alias("n")).groupBy("size").agg(F.max("n").alias("n")).collect()}
    by_size = {}
    for r in sizes:
        k = int(min(CENTRES, max(1, largest[r["size"]] * OVERLAP // SHARD)))
        sample = reps.where(F.col("size") == r["size"]).orderBy(F.xxhash64("rid", F.lit(5)), "rid").limit(SAMPLE // len(sizes)).select("vec").toPandas()
        by_size[r["size"]] = apart(centres(_matrix(sample["vec"]), k))
    for s in largest.keys() - by_size.keys():
        by_size[s] = np.ones((1, s)) / np.sqrt(s)
    overlap, beam = OVERLAP, BEAM
    for _ in range(attempts):
        found = _links(reps, by_size, overlap, beam, least)
        seen = recall(reps, found, audit, least)
        if seen >= RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    checked = saved(_checked(reps, least))
    edges = found.unionByName(checked).where("rid <> root").select(F.col("rid").alias("u"), F.col("root").alias("v"))
    named = reps.join(connected_components(edges).withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = saved(named.select("rid", "label", "vec", "n", "least", "component"))
    root = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    classes = join_classes(named, root, ["component"], "classes", named.count()).join(links, "rid", "left").select("label", "vec", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    done = join_classes(usable, saved(classes), ["label", "vec"], "n", usable.count()).select("id", "n_links", "component_id")
    out = done.unionByName(rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(seen)).alias("recall"))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0 AND list_dot_product(e, e) < 'inf'::DOUBLE),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.u = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


def embeddings_linked(spark, sf_dir: str) -> DataFrame:
    """The operator over vectors that link: each of the table with two beside it, 0.1 and 0.25 of its length along the first axis.

    Neighbours in this order link, the first and the third do not, so a component is a chain.
    """
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    first = F.get("e", F.lit(0))
    beside = [F.col("e")] + [F.concat(F.array(first + F.lit(t) * length), F.slice("e", 2, 1 << 20)) for t in (0.1, 0.25)]
    rows = v.select("vec_id", "label", F.posexplode(F.array(*beside)).alias("k", "embedding"))
    return near_duplicates(rows.select((F.col("vec_id") * 3 + F.col("k")).alias("vec_id"), "label", "embedding")).select("vec_id", "n_links", "component_id", "kept")


LINKED_SQL = OP9_SQL.replace(
    "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings",
    "SELECT vec_id * 3 + k AS vec_id, label, list_concat([e[1] + t * sqrt(list_dot_product(e, e))], e[2:]) AS e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), (VALUES (0, 0.0::DOUBLE), (1, 0.1), (2, 0.25)) p(k, t)",
)
