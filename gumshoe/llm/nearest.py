"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Scratch, lowest_hashes, map_batches
from gumshoe.llm.vectors import matrix, usable

#: The index is fitted on about so many vectors at most, those whose id's hash is lowest.
SAMPLE = 8192
#: Vectors of a partition on average; the number of partitions is a power of two.
PARTITION, PARTITIONS_MOST = 2048, 256
GRAPH = 12
HIDDEN, EPOCHS = 128, 40
#: Audited queries, and the recall among them that fixes how many partitions a query is routed to.
AUDIT, RECALL = 300, 0.96
#: Vectors and queries of one block.
BLOCK, BLOCK_QUERIES = 4096, 2048


def neighbour_graph(x: np.ndarray, k: int = GRAPH) -> np.ndarray:
    """The k rows with the largest inner product with each row, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        like = x[at : at + 1024] @ x.T
        like[np.arange(len(like)), np.arange(at, at + len(like))] = -np.inf
        out[at : at + 1024] = np.argpartition(-like, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_partition(graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal size that cut few edges of the graph: recursive bisection at the median of the
    second eigenvector, each followed by swaps of the pairs that save the most edges."""
    n = len(graph)
    a = np.repeat(np.arange(n), graph.shape[1])
    edges = np.unique(np.concatenate([np.stack([a, graph.ravel()], 1), np.stack([graph.ravel(), a], 1)]), axis=0)
    part = np.zeros(n, np.int64)
    rng = np.random.default_rng(47)
    size = 1
    while size < parts:
        inner = edges[part[edges[:, 0]] == part[edges[:, 1]]]
        u, v = inner.T
        degree = np.maximum(np.bincount(u, minlength=n), 1).astype(float)
        members = np.maximum(np.bincount(part, degree, size), 1e-9)
        f = rng.standard_normal(n)
        for _ in range(80):
            f -= (np.bincount(part, f * degree, size) / members)[part]
            f /= np.sqrt(np.maximum(np.bincount(part, f * f * degree, size), 1e-30))[part]
            f = 0.5 * f + 0.5 * np.bincount(u, f[v], n) / degree
        order = np.lexsort((f, part))
        counts = np.bincount(part, minlength=size)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        side = (place >= (counts // 2)[part]).astype(np.int64)
        for _ in range(12):
            same = side[u] == side[v]
            gain = np.bincount(u, ~same, n) - np.bincount(u, same, n)
            flip = np.zeros(n, bool)
            for p in range(size):
                zero, one = (np.flatnonzero((part == p) & (side == s)) for s in (0, 1))
                k = min(len(zero), len(one), max(1, len(zero) // 16))
                zero, one = zero[np.argsort(-gain[zero], kind="stable")[:k]], one[np.argsort(-gain[one], kind="stable")[:k]]
                better = gain[zero] + gain[one] > 2
                flip[zero[better]] = flip[one[better]] = True
            if not flip.any():
                break
            side[flip] ^= 1
        part, size = 2 * part + side, 2 * size
    return part


@dataclass
class Router:
    """A network of one hidden layer: vector -> scores of partitions."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int) -> Router:
    """Trained by cross entropy on how a vector's neighbours, and itself, are spread over the parts."""
    rng = np.random.default_rng(53)
    n, dim = x.shape
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n)[:, None], part[graph]), 1.0)
    target[np.arange(n), part] += 2.0
    target /= target.sum(axis=1, keepdims=True)
    mean = x.mean(axis=0)
    scale = 1.0 / max(float((x - mean).std()), 1e-30)
    p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    z, step = (x - mean) * scale, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = (s / s.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            grads = [z[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
            step += 1
            rate = 2e-3 * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, g in enumerate(grads):
                g = g + 1e-5 * p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * m[i] / (np.sqrt(v[i]) + 1e-8)
    return Router(mean, scale, *p)


def _routed(vectors: DataFrame, router, most: int) -> DataFrame:
    """(id, x, part): each vector with its `most` most probable partitions, best first."""

    def make():
        route = router.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = route.scores(matrix(batch.column(1)))
            best = np.argsort(-scores, axis=1, kind="stable")[:, :most].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, max(1, best.shape[1]), dtype=np.int32)), pa.array(best.ravel()))
            return pa.record_batch([batch.column(0), batch.column(1), lists], names=["id", "x", "parts"])

        return step

    return map_batches(vectors.select("id", "x"), make, "id bigint, x array<float>, parts array<int>")


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, inner products) of the k best rows for each query; products are summed in the same way
    for every pair, whatever block it is met in."""
    like = q @ x.T
    most = min(len(ids), k + 4)
    at = np.argpartition(-like, most - 1, axis=1)[:, :most]
    scores = (q[:, None, :] * x[at]).sum(axis=2)
    own = ids[at]
    order = np.lexsort((own, -scores))[:, :k]
    return np.take_along_axis(own, order, 1), np.take_along_axis(scores, order, 1)


def _found(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    k = ids.shape[1] if ids.ndim == 2 else 0
    return pa.record_batch([pa.array(np.repeat(queries, k), pa.int64()), pa.array(ids.ravel(), pa.int64()), pa.array(scores.ravel(), pa.float64())], names=["q", "id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _against_all(asked: pa.Table, vectors: DataFrame, k: int) -> DataFrame:
    """(q, id, score, rank): the exact k nearest of a bounded set of queries, all vectors being read in blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast(asked)

    def make():
        asked = shared.value.combine_chunks()
        q, x = asked.column("id").to_numpy(), matrix(asked.column("x").combine_chunks() if isinstance(asked.column("x"), pa.ChunkedArray) else asked.column("x"))
        return lambda batch: _found(q, *_best(x, batch.column(0).to_numpy(), matrix(batch.column(1)), k)) if batch.num_rows else None

    return _top(map_batches(vectors.select("id", "x"), make, "q bigint, id bigint, score double"), k)


def _blocked(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q, id, score): best k of each block for its queries. Data (id, x, part) and queries of one
    partition meet block by block, so that neither side's size bounds a task."""
    blocks = data.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    shares = queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("shares"))
    grid = F.broadcast(blocks.join(shares, "part"))  # a row for each partition
    whole = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = data.join(grid, "part").select("part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("i"), F.explode(whole("shares")).alias("j"), "id", "x", F.lit(False).alias("asks"))
    right = queries.join(grid, "part").select("part", F.explode(whole("blocks")).alias("i"), F.pmod(F.xxhash64("id"), "shares").cast("int").alias("j"), "id", "x", F.lit(True).alias("asks"))

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group.column("asks").to_numpy()
        ids, x = group.column("id").to_numpy(), matrix(pa.concat_arrays(group.column("x").chunks))
        if asks.all() or not asks.any():
            return pa.Table.from_batches([_found(ids[:0], np.zeros((0, 1), np.int64), np.zeros((0, 1)))])
        parts = [_found(ids[asks][at : at + 128], *_best(x[asks][at : at + 128], ids[~asks], x[~asks], k)) for at in range(0, int(asks.sum()), 128)]
        return pa.Table.from_batches(parts)

    return left.unionByName(right).groupBy("part", "i", "j").applyInArrow(search, "q bigint, id bigint, score double")


def search_nearest(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, float]:
    """((query_id, rank, vec_id, score), recall among audited queries): for each row whose id is divisible
    by `every`, the k others with the largest inner product that the routed partitions hold.

    1. Equal vectors are one, with their k + 1 smallest ids, so copies are neither indexed nor
       compared twice.
    2. On a bounded sample: a neighbour graph, its partition into equal parts with few cut edges, and a
       small network that learns in which parts a vector's neighbours lie. The number of parts
       follows the number of vectors; few vectors are one part and the search is exact.
    3. Every vector goes to its most probable part. For a fixed number of audited queries the exact
       neighbours, found against all rows, tell how many parts a query must be routed to.
    4. Queries meet the vectors of those parts in blocks; the k best over all blocks stay.

    Products are in double precision, ties go to the smaller id. Null ids and vectors that are null,
    empty, zero or hold a null or non-finite component take no part, nor do vectors whose length is not
    the most common one. Rows that repeat an id are never neighbours of each other. No rows give no
    rows; other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "nearest")
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("x")).filter(usable("x") & F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    rows = rows.filter(F.size("x") == (widths["dim"] if widths else 0))
    vectors = scratch.keep(rows.groupBy("x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    members = scratch.keep(rows.join(vectors, "x").select("id", "vec_id"))
    count = vectors.count()
    sample = lowest_hashes(vectors.select("id", "x"), SAMPLE, count)
    parts = 1
    while parts < PARTITIONS_MOST and 2 * parts * PARTITION <= count:
        parts *= 2
    x = matrix(sample.column("x").combine_chunks())
    graph = neighbour_graph(x) if parts > 1 else None
    if parts > 1:
        router = fit_router(x, graph, balanced_partition(graph, parts), parts)
    else:
        router = Router(np.zeros(x.shape[1]), 1.0, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    shared = rows.sparkSession.sparkContext.broadcast(router)
    data = scratch.keep(_routed(vectors, shared, 1).select("id", "x", F.element_at("parts", 1).alias("part")))
    asking = members.filter(F.col("vec_id") % every == 0).select("id").distinct().join(vectors.select("id", "x"), "id")
    probes, recall = parts, 1.0
    if parts > 1:
        asked = lowest_hashes(asking, AUDIT, asking.count())
        truth = _against_all(asked, vectors, k + 1).filter(F.col("q") != F.col("id")).join(data.select("id", "part"), "id").select("q", "part").toPandas()
        ranks = np.argsort(np.argsort(-router.scores(matrix(asked.column("x").combine_chunks())), axis=1, kind="stable"), axis=1)
        place = dict(zip(asked.column("id").to_pylist(), range(asked.num_rows)))
        needed = ranks[[place[q] for q in truth["q"]], truth["part"].to_numpy()]
        for probes in range(1, parts + 1):
            recall = float((needed < probes).mean()) if len(needed) else 1.0
            if recall >= RECALL:
                break
    queries = _routed(asking, shared, probes).select("id", "x", F.explode("parts").alias("part"))
    best = scratch.keep(_top(_blocked(data, queries, k + 1), k + 1).select("q", "id", "score"))
    few = Window.partitionBy("id").orderBy("vec_id")
    smallest = members.distinct().withColumn("place", F.row_number().over(few)).filter(F.col("place") <= k + 1).select("id", "vec_id")
    askers = members.filter(F.col("vec_id") % every == 0).distinct().select(F.col("id").alias("q"), F.col("vec_id").alias("query_id"))
    found = best.join(smallest, "id").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    inner = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(inner)).filter(F.col("place") <= k + 1).select("q", "vec_id", "score")
    result = askers.join(found, "q").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return result.select("query_id", "rank", "vec_id", "score"), recall
