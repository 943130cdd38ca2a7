"""Approximate nearest neighbours: a small-world graph for each shard (operator 6).

Equal vectors become one node, which keeps the smallest ids that have it. Nodes fall into
bands of about equal norm, bands into cells around centroids, and cells into shards of bounded
size. Each shard gets a hierarchical navigable small-world graph, stored as flat arrays of
neighbours. A query visits the shards of the cells nearest to it; how many that are is
measured on the data (see ``probes``), so that few are visited if vectors form clusters and
all if they don't. Results are merged by exact inner product. Largest inner product is nearest
Euclidean distance once each vector, scaled by its shard's largest norm, has a further component
that brings all to one norm; bands keep an outlier from blurring the other vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airside.llm.common import materialise

SHARD_ROWS = 8192
LINKS = 16
BUILD_WIDTH = 64
#: Nodes that a search keeps in one shard; of several shards each keeps fewer (see ``_width``).
SEARCH_WIDTH = 160
#: Queries that one task takes past one copy of a shard, and those searched in step.
QUERY_BLOCK, STEP_BLOCK = 16384, 1024
#: Rows of queries, each with its vector, that leave for the shards at once.
VISIT_ROWS = 8192
#: Rows of a band on which its centroids are fitted, and centroids of a band.
FIT_ROWS, CELLS = 65536, 1024
#: Queries on which the number of cells to visit is measured, and the share of their true
#: neighbours that must lie in them.
PROBE_QUERIES, IN_CELLS = 256, 0.98
_INSERT = 256


class Graph:
    """Levels of flat neighbour arrays (rows x links, -1 where there is none)."""

    def __init__(self, vectors: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors
        self.levels = levels  # from the bottom: (node numbers, neighbours as node numbers)

    @staticmethod
    def augmented(raw: np.ndarray) -> np.ndarray:
        """Vectors over the largest norm, with the component that brings each to norm 1."""
        unit = raw / np.abs(raw).max()  # so that no square overflows
        unit /= np.sqrt((unit**2).sum(1).max())
        return np.hstack([unit, np.sqrt(np.maximum(1 - (unit**2).sum(1), 0))[:, None]]).astype(np.float32)

    @classmethod
    def build(cls, raw: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
        """Insert nodes in batches; a batch's candidates are the nearest of the nodes so far and of itself."""
        vectors = cls.augmented(raw)
        n = len(vectors)
        height = np.minimum((-np.log(np.maximum(np.random.default_rng(7).random(n), 1e-12)) / np.log(links)).astype(int), 6)
        levels = []
        for level in range(int(height.max()) + 1):
            nodes = np.flatnonzero(height >= level)
            if level and len(nodes) < 2:
                break
            levels.append((nodes, _connect(vectors[nodes], links * (2 if level == 0 else 1), width)))
        return cls(vectors, levels)

    def search(self, raw: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, found): the ``width`` best nodes of each query; found is false for padding."""
        unit = raw / np.abs(raw).max(1, keepdims=True)
        unit /= np.sqrt((unit**2).sum(1, keepdims=True))
        queries = np.hstack([unit, np.zeros((len(raw), 1))]).astype(np.float32)
        entry = np.zeros((len(queries), 1), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            nodes, near = self.levels[depth]
            best, dist = _beam(self.vectors[nodes], near, queries, entry, width if depth == 0 else 8)
            if depth:
                entry = np.searchsorted(self.levels[depth - 1][0], nodes[best[:, :4]])
        return best, np.isfinite(dist)


def _distances(vectors: np.ndarray, sq: np.ndarray, queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance less the query's own square."""
    return sq[at] - 2 * np.matmul(vectors[at], queries[:, :, None])[:, :, 0]


def _beam(vectors, near, queries, entry, width):
    """Best-first search of all queries in step: node numbers and distances, nearest first."""
    m, n = len(queries), len(vectors)
    width = min(width, n)
    sq = (vectors**2).sum(1)
    row = np.arange(m)[:, None]
    seen = np.zeros((m, n), bool)
    seen[row, entry] = True
    node = np.full((m, width), -1, np.int64)
    dist = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    k = min(entry.shape[1], width)
    first = entry[:, :k]
    node[:, :k], dist[:, :k], done[:, :k] = first, _distances(vectors, sq, queries, first), False
    same = np.sort(first, axis=1)
    if k > 1 and (same[:, 1:] == same[:, :-1]).any():  # entries may repeat
        for j in range(1, k):
            twice = (first[:, :j] == first[:, j : j + 1]).any(1)
            dist[twice, j], done[twice, j], node[twice, j] = np.inf, True, -1
    active = np.arange(m)
    while len(active):
        open_dist = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(open_dist, min(3, width - 1), axis=1)[:, : min(4, width)]  # a few nodes at a time
        value = np.take_along_axis(open_dist, pick, 1)
        live = np.isfinite(value).any(1)
        active, pick, value = active[live], pick[live], value[live]
        if not len(active):
            break
        chosen = np.where(np.isfinite(value), np.take_along_axis(node[active], pick, 1), -1)
        done[active[:, None], pick] = True
        fresh = near[np.maximum(chosen, 0)]
        fresh[chosen < 0] = -1
        fresh = fresh.reshape(len(active), -1)
        new = (fresh >= 0) & ~seen[active[:, None], np.maximum(fresh, 0)]
        order = np.sort(np.where(new, fresh, -1), axis=1)  # neighbours of several nodes may repeat
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        new = order >= 0
        r, c = np.nonzero(new)
        seen[active[r], order[r, c]] = True
        d = np.where(new, _distances(vectors, sq, queries[active], np.maximum(order, 0)), np.inf)
        all_node, all_dist = np.hstack([node[active], order]), np.hstack([dist[active], d])
        all_done = np.hstack([done[active], ~new])
        keep = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        node[active], dist[active], done[active] = (np.take_along_axis(x, keep, 1) for x in (all_node, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.maximum(np.take_along_axis(node, order, 1), 0), np.take_along_axis(dist, order, 1)


def _connect(vectors: np.ndarray, links: int, width: int) -> np.ndarray:
    """Neighbours of every node of one level: near ones in differing directions.

    Nodes are inserted in batches. A shard is small, so the nearest of all nodes before are
    found by matrix products, where larger graphs are searched.
    """
    n = len(vectors)
    near = np.full((n, links), -1, np.int64)
    sq = (vectors**2).sum(1)
    at = 0
    while at < n:
        end = min(n, at + (min(_INSERT, max(16, at // 4))))
        dist = sq[:end] - 2 * vectors[at:end] @ vectors[:end].T
        dist[np.arange(end - at), np.arange(at, end)] = np.inf
        take = min(width, end)
        ids = np.argpartition(dist, take - 1, axis=1)[:, :take]
        dist = np.take_along_axis(dist, ids, 1)
        order = np.lexsort((ids, dist), axis=1)
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        near[at:end] = _spread(vectors, sq, np.arange(at, end), ids, dist, links)
        src, dst = np.repeat(np.arange(at, end), links), near[at:end].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, starts = np.unique(dst, return_index=True)
        sizes = np.diff([*starts, len(dst)])
        if len(targets):
            back = np.full((len(targets), int(sizes.max())), -1, np.int64)
            back[np.repeat(np.arange(len(targets)), sizes), np.arange(len(dst)) - np.repeat(starts, sizes)] = src
            both = np.sort(np.hstack([near[targets], back]), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            d = np.where(both >= 0, _distances(vectors, sq, vectors[targets], np.maximum(both, 0)), np.inf)
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            near[targets] = _spread(vectors, sq, targets, np.take_along_axis(both, order, 1), np.take_along_axis(d, order, 1), links)
        at = end
    return near


def _spread(vectors, sq, nodes, ids, dist, links, rows=512):
    """Up to ``links`` of each node's candidates (nearest first): those nearer to the node than
    to a neighbour already taken, then the nearest of the others."""
    if len(nodes) > rows:  # bounds the products below
        return np.vstack([_spread(vectors, sq, nodes[i : i + rows], ids[i : i + rows], dist[i : i + rows], links) for i in range(0, len(nodes), rows)])
    m, k = ids.shape
    valid = np.isfinite(dist) & (ids >= 0)
    true = dist + sq[nodes][:, None]
    chosen = np.zeros((m, k), bool)
    blocked = ~valid
    held = vectors[np.maximum(ids, 0)]
    own = (held**2).sum(2)
    between = own[:, :, None] + own[:, None, :] - 2 * held @ held.transpose(0, 2, 1)
    closer = between < true[:, None, :]
    for j in range(k):
        take = ~blocked[:, j] & (chosen.sum(1) < links)
        chosen[:, j] = take
        blocked[:, j + 1 :] |= closer[:, j, j + 1 :] & take[:, None]
    rank = np.where(chosen, 0, np.where(valid, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :links]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(ids, order, 1), -1)
    return out if out.shape[1] == links else np.hstack([out, np.full((m, links - out.shape[1]), -1)])


def _pack(arrays: list[np.ndarray]) -> tuple[bytes, list[int]]:
    return b"".join(np.ascontiguousarray(a, "<i4").tobytes() for a in arrays), [a.size for a in arrays]


SPACE = ["dim", "band"]
SHARD = [*SPACE, "cell", "sub"]


def build_shards(nodes: DataFrame, links: int = LINKS, width: int = BUILD_WIDTH) -> DataFrame:
    """A row for each shard: vectors and, level by level, node numbers and neighbours as flat arrays."""

    def build(key, pdf):
        pdf = pdf.sort_values("vec_id", kind="stable")
        raw = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        g = Graph.build(raw, links, width)
        flat, sizes = _pack([x for level in g.levels for x in level])
        ids = [np.asarray(i, np.int64) for i in pdf["ids"]]
        return pd.DataFrame({**{c: [k] for c, k in zip(SHARD, key, strict=True)}, "vectors": [raw.astype("<f8").tobytes()], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "n_ids": [[len(i) for i in ids]], "graph": [flat], "sizes": [sizes]})

    return nodes.groupBy(*SHARD).applyInPandas(build, "dim int, band int, cell int, sub int, vectors binary, ids binary, n_ids array<int>, graph binary, sizes array<int>")


def _width(width: int, shards: int, k: int) -> int:
    """Nodes to keep in each of ``shards`` visited shards: of the k nearest, each holds but a part."""
    return max(k + 12, int(width / shards**0.5))


def _searcher(k: int, width: int):
    def search(key, visits, shard):
        who, which, what, how = [], [], [], []
        for s in shard.itertuples():
            if not len(visits):
                break
            raw = np.frombuffer(s.vectors, "<f8").reshape(-1, int(s.dim))
            ends, ids = np.cumsum([0, *s.n_ids]), np.frombuffer(s.ids, "<i8")
            least = ids[ends[:-1]]
            graph = None
            if len(raw) > width:
                cut = np.cumsum([0, *s.sizes])
                flat = np.frombuffer(s.graph, "<i4").astype(np.int64)
                parts = [flat[a:z] for a, z in zip(cut, cut[1:], strict=False)]
                graph = Graph(Graph.augmented(raw), [(parts[i], parts[i + 1].reshape(len(parts[i]), -1)) for i in range(0, len(parts), 2)])
            for at in range(0, len(visits), STEP_BLOCK):
                block = visits.iloc[at : at + STEP_BLOCK]
                q_ids, keys, q = block["query_id"].to_numpy(), block["query"].to_numpy(), np.stack(block["vector"].to_numpy()).astype(np.float64)
                if graph is None:
                    best, ok = np.broadcast_to(np.arange(len(raw)), (len(q), len(raw))), np.ones((len(q), len(raw)), bool)
                else:
                    best, ok = graph.search(q, width)
                scores = np.einsum("qd,qkd->qk", q, raw[best])
                order = np.lexsort((least[best], np.where(np.isnan(scores), np.inf, -scores), ~ok), axis=1)[:, : k + 1]  # one more: the query itself may be among them
                for i, row in enumerate(order):
                    left = k
                    for j in row:
                        if left <= 0 or not ok[i, j]:
                            break
                        own = ids[ends[best[i, j]] : ends[best[i, j] + 1]]
                        own = own[own != q_ids[i]][:left]
                        who.extend([q_ids[i]] * len(own))
                        which.extend([keys[i]] * len(own))
                        what.extend(own)
                        how.extend([scores[i, j]] * len(own))
                        left -= len(own)
        return pd.DataFrame({"query_id": np.array(who, np.int64), "query": np.array(which, np.int64), "vec_id": np.array(what, np.int64), "score": np.array(how, np.float64)})

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim, band: rows with an id and a finite vector that isn't null or zero.

    Norms of one band differ by a factor of at most four.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    v = v.where(sound).withColumn("dim", F.size("vector")).withColumn("most", F.array_max(F.transform("vector", F.abs)))
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    return v.withColumn("band", F.floor((F.log2("most") + F.log2(squares) / 2) / 2).cast("int")).drop("most")


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Means of ``k`` groups of rows; starts from rows spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def centroids(nodes: DataFrame, shard_rows: int) -> dict[tuple[int, int], np.ndarray]:
    """Centroids of every band that doesn't fit one shard, fitted on its FIT_ROWS rows of least hash."""
    counts = {(r["dim"], r["band"]): r["count"] for r in nodes.groupBy(*SPACE).count().collect()}  # a row for each length and band
    wide = {s: min(CELLS, -(-n // shard_rows)) for s, n in counts.items()}
    out = {s: np.zeros((1, s[0])) for s in counts}
    if max(wide.values(), default=1) == 1:
        return out
    least = Window.partitionBy(*SPACE).orderBy(F.xxhash64("vector"), "vec_id")
    sample = nodes.withColumn("n", F.row_number().over(least)).where(F.col("n") <= FIT_ROWS).select(*SPACE, "vector")

    def fit(key, pdf):
        k = wide[(int(key[0]), int(key[1]))]
        x = np.stack(pdf["vector"].to_numpy())
        c = _kmeans(x, min(k, len(x))) if k > 1 else np.zeros((1, x.shape[1]))
        return pd.DataFrame({"dim": key[0], "band": key[1], "centre": list(c)})

    for r in sample.groupBy(*SPACE).applyInPandas(fit, "dim int, band int, centre array<double>").groupBy(*SPACE).agg(F.collect_list("centre").alias("c")).collect():  # at most CELLS a band
        out[(r["dim"], r["band"])] = np.array(r["c"])
    return out


def _in_cells(held):
    """Adds the cell of each node: that of the nearest centroid of its band."""

    def assign(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), np.int32)
            for space, rows in pdf.groupby(SPACE).indices.items():
                c = held.value[tuple(map(int, space))]
                if len(c) > 1:
                    x = np.stack(pdf["vector"].to_numpy()[rows])
                    cell[rows] = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
            yield pdf.assign(cell=cell)

    return assign


def _nearest_cells(means: dict, dim: int, x: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The cells (band, cell) of vectors of ``dim`` components, and for each query their order."""
    keys, centre = means[dim]
    with np.errstate(over="ignore", invalid="ignore"):
        return keys, np.argsort(-np.nan_to_num(x @ centre.T), axis=1, kind="stable")


def probes(nodes: DataFrame, queries: DataFrame, held_means, k: int) -> dict[int, int]:
    """For each vector length, how many of the cells nearest to a query to visit.

    The true neighbours of the PROBE_QUERIES queries of least hash are found by brute force
    over all nodes (by blocks: a task keeps k for each query); so many cells are visited that
    IN_CELLS of them are met.
    """
    spark = nodes.sparkSession
    least = Window.partitionBy("dim").orderBy(F.xxhash64("vector"), "query_id")
    asked: dict[int, np.ndarray] = {}
    for r in queries.withColumn("n", F.row_number().over(least)).where(F.col("n") <= PROBE_QUERIES).groupBy("dim").agg(F.collect_list("vector").alias("q")).collect():
        asked[r["dim"]] = np.array(sorted(r["q"]))
    held = spark.sparkContext.broadcast(asked)

    def top(batches):
        best: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for dim, rows in pdf.groupby("dim").indices.items():
                q = held.value.get(int(dim))
                if q is None:
                    continue
                x, where = np.stack(pdf["vector"].to_numpy()[rows]), pdf[["band", "cell"]].to_numpy()[rows]
                scores = np.nan_to_num(q @ x.T)
                take = min(k + 1, scores.shape[1])  # the query's own vector is among them
                at = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                now = np.dstack([np.take_along_axis(scores, at, 1), where[at, 0], where[at, 1]])
                both = np.hstack([best[dim], now]) if dim in best else now
                order = np.argsort(-both[:, :, 0], axis=1, kind="stable")[:, : k + 1]
                best[dim] = np.take_along_axis(both, order[:, :, None], 1)
        for dim, b in best.items():
            q, j = np.indices(b.shape[:2])
            yield pd.DataFrame({"dim": np.full(q.size, dim, np.int32), "q": q.ravel().astype(np.int32), "score": b[:, :, 0].ravel(), "band": b[:, :, 1].ravel().astype(np.int32), "cell": b[:, :, 2].ravel().astype(np.int32)})

    best = Window.partitionBy("dim", "q").orderBy(F.col("score").desc())
    found = nodes.select(*SPACE, "cell", "vector").mapInPandas(top, "dim int, q int, score double, band int, cell int").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    needed: dict[int, list[int]] = {}
    for dim, rows in found.toPandas().groupby("dim"):  # at most (k + 1) * PROBE_QUERIES rows a length
        keys, order = _nearest_cells(held_means.value, int(dim), asked[int(dim)])
        place = np.argsort(order, axis=1)
        number = {c: i for i, c in enumerate(keys)}
        needed[int(dim)] = [int(place[r.q, number[(r.band, r.cell)]]) + 1 for r in rows.itertuples()]
    return {dim: int(np.quantile(n, IN_CELLS, method="higher")) for dim, n in needed.items()}


def _visits(held_means, count: dict[int, int], subs: dict, vectors: bool = True):
    """A row for each shard that a query visits, with the query's vector or (to be counted) without it.

    A query's row becomes one for each shard, so they leave in batches of at most VISIT_ROWS.
    """

    def visit(batches):
        for pdf in batches:
            for dim, rows in pdf.groupby("dim").indices.items():
                if int(dim) not in held_means.value:
                    continue
                keys = held_means.value[int(dim)][0]
                band, cell = np.array(keys, np.int32).T
                parts = np.array([subs[(int(dim), *key)] for key in keys])
                step = max(1, VISIT_ROWS // int(parts.sum()))
                for start in range(0, len(rows), step):
                    some = pdf.iloc[rows[start : start + step]]
                    order = _nearest_cells(held_means.value, int(dim), np.stack(some["vector"].to_numpy()))[1][:, : count[int(dim)]]
                    many = parts[order.ravel()]
                    at, which = np.repeat(np.repeat(np.arange(len(some)), order.shape[1]), many), np.repeat(order.ravel(), many)
                    sub = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                    for i in range(0, len(at), VISIT_ROWS):
                        cut = slice(i, i + VISIT_ROWS)
                        own = some.iloc[at[cut]].assign(band=band[which[cut]], cell=cell[which[cut]], sub=sub[cut].astype(np.int32))
                        yield own[["query_id", "query", "vector", *SHARD] if vectors else SHARD]

    return visit


def search(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS, links: int = LINKS, build_width: int = BUILD_WIDTH, search_width: int = SEARCH_WIDTH) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Score is the
    inner product in double precision; ties go to the smaller vec_id, products that aren't a
    number come last; a query's own row is no candidate, but other rows with its vector are.
    Rows with a null, zero or non-finite vector, or without an id, take no part. Vectors are
    only compared with those of their own length. Fewer than ``k`` candidates: all of them. No
    rows: no rows. Other columns are ignored. A vec_id given to several rows counts as several
    candidates, and as a query once for each differing vector.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    # Of rows with one vector only the k + 1 smallest ids can be among anyone's nearest.
    w = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    nodes = few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("vec_id"), F.min("dim").alias("dim"), F.min("band").alias("band"))
    nodes = materialise(nodes, "nodes")
    centres = centroids(nodes, shard_rows)
    nodes = nodes.mapInPandas(_in_cells(spark.sparkContext.broadcast(centres)), "vector array<double>, ids array<long>, vec_id long, dim int, band int, cell int")
    # A row for each cell: at most CELLS for each band.
    filled = {(r["dim"], r["band"], r["cell"]): r["count"] for r in nodes.groupBy("dim", "band", "cell").count().collect()}
    subs = {c: -(-n // shard_rows) for c, n in filled.items()}
    parts = spark.createDataFrame([(*c, n) for c, n in subs.items()] or [(0, 0, 0, 1)], "dim int, band int, cell int, subs int")
    dealt = nodes.join(F.broadcast(parts), ["dim", "band", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vector"), F.col("subs")).cast("int")).drop("subs")
    index = materialise(build_shards(dealt, links, build_width), "graph")

    means = {d: ([c[1:] for c in filled if c[0] == d], np.array([centres[c[:2]][c[2]] for c in filled if c[0] == d])) for d in {c[0] for c in filled}}
    held_means = spark.sparkContext.broadcast(means)
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector", "dim", F.xxhash64("vector").alias("query")).distinct()
    queries = materialise(queries, "queries")
    several = any(len(keys) > 1 for keys, _ in means.values())
    count = probes(nodes, queries, held_means, k) if several else {d: 1 for d in means}
    count = {d: count.get(d, len(keys)) for d, (keys, _) in means.items()}
    most = max((sum(sorted((subs[(d, *c)] for c in keys), reverse=True)[: count[d]]) for d, (keys, _) in means.items()), default=1)

    visits = queries.mapInPandas(_visits(held_means, count, subs), "query_id long, query long, vector array<double>, dim int, band int, cell int, sub int")
    if queries.count() > QUERY_BLOCK:  # a shard goes to as many tasks as its queries need
        visited = queries.mapInPandas(_visits(held_means, count, subs, False), "dim int, band int, cell int, sub int")
        load = visited.groupBy(*SHARD).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        load = F.broadcast(materialise(load, "load"))  # a row for each shard
        visits = visits.join(load, SHARD).withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.col("blocks")).cast("int")).drop("blocks")
        index = index.join(load, SHARD).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")  # kept on both sides it would be ambiguous
    else:
        visits, index = visits.withColumn("block", F.lit(0)), index.withColumn("block", F.lit(0))
    by = [*SHARD, "block"]
    found = visits.groupBy(*by).cogroup(index.groupBy(*by)).applyInPandas(_searcher(k, _width(search_width, most, k)), "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.isnan("score"), F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
