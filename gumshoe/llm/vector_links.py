"""Near-duplicate vectors by NN-descent over a neighbour graph within labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Scratch, components, lowest_hashes, map_batches
from gumshoe.llm.vectors import matrix, unit_rows, usable

#: Neighbours kept for a vector; a list that holds links only is saturated.
NEIGHBOURS = 10
#: Trees of random hyperplanes that start the graph, and vectors of a leaf on average and at most.
TREES, LEAF, LEAF_MOST = 4, 96, 384
#: Neighbours of one vector that are joined with each other at a time, and vectors of a block.
JOINED, BLOCK = 64, 512
#: Audited vectors that have links, vectors compared with all for that at a time and in all, and the recall
#: they must show. Descents repeat until at most this share of list entries is new.
AUDIT, AUDITED, AUDITED_MOST, RECALL, NEW = 3000, 3000, 12_000, 0.999, 0.001
#: Matrix products closer than this to a limit are summed again in the one order that counts.
ROUNDING = 1e-9
_LISTS = "id bigint, near array<struct<far:double,id:bigint>>, anchor bigint"


def _leaves(nodes: DataFrame, sizes: DataFrame, seed: int) -> DataFrame:
    """Each vector with its leaf in each tree; crowded leaves are dealt into parts by the id."""

    def make():
        planes: dict[int, np.ndarray] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            depth = batch.column(3).to_numpy()
            vectors = batch.column(2)
            width = np.diff(vectors.offsets.to_numpy())
            codes = np.zeros((TREES, batch.num_rows), np.int64)
            for dim in np.unique(width):
                at = np.flatnonzero(width == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((TREES, 40, int(dim)))
                x = unit_rows(matrix(vectors.take(pa.array(at))))
                for tree in range(TREES):
                    bits = (x @ planes[dim][tree].T > 0) & (np.arange(40) < depth[at, None])
                    codes[tree, at] = (bits * (1 << np.arange(40))).sum(axis=1)
            n = batch.num_rows
            order = np.tile(np.arange(n), TREES)
            return pa.record_batch(
                [*(c.take(pa.array(order)) for c in (batch.column(0), batch.column(1), vectors)), pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), pa.array(codes.ravel()), pa.array(width[order].astype(np.int32))],
                names=["id", "label", "x", "tree", "leaf", "dim"],
            )

        return step

    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("members") / LEAF))).cast("int").alias("depth")
    rows = nodes.withColumn("dim", F.size("x")).join(sizes, ["label", "dim"]).select("id", "label", "x", depth)
    leaves = map_batches(rows, make, "id bigint, label int, x array<float>, tree int, leaf bigint, dim int")
    counts = leaves.groupBy("label", "dim", "tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col("n") / LEAF_MOST)).alias("part")
    return leaves.join(counts, ["label", "dim", "tree", "leaf"]).select("label", "dim", "tree", "leaf", part, "id", "x")


def _cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the unit rows x[a] and y[b], each summed along its row in one order. A matrix product
    may differ in the last bit with the rows it is taken with and with the machine."""
    out = np.empty(len(a))
    for at in range(0, len(a), 65_536):
        out[at : at + 65_536] = (x[a[at : at + 65_536]] * y[b[at : at + 65_536]]).sum(axis=1)
    return out


def _linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether each row of x and each of y have a cosine of at least `least`; the same for a pair
    wherever it is met."""
    like = x @ y.T
    linked = like >= least
    a, b = np.nonzero(np.abs(like - least) < ROUNDING)
    linked[a, b] = _cosines(x, y, a, b) >= least
    return linked


def _nearest(ids: np.ndarray, like: np.ndarray, worst: np.ndarray | None, most: int) -> list[np.ndarray]:
    """For each row the places of the most similar others, better than `worst`."""
    np.fill_diagonal(like, -2.0)
    k = min(most, len(ids) - 1)
    if k <= 0:
        return [np.zeros(0, np.int64)] * len(ids)
    best = np.argpartition(-like, k - 1, axis=1)[:, :k]
    floor = -2.0 if worst is None else worst[:, None]
    good = np.take_along_axis(like, best, 1) > floor
    return [b[g] for b, g in zip(best, good)]


def _joined(groups: DataFrame, least: float) -> DataFrame:
    """Lists found by comparing the members of each group with each other: `members` holds structs of
    (id, x, worst). The anchor of a vector is the smallest id it is linked with in the group."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, near, far, anchors = [], [], [], []
            column = batch.column(0)
            ends = column.offsets.to_numpy()
            members = column.values
            all_ids, vectors, worst = (members.field(n) for n in ("id", "x", "worst"))
            all_ids, worst = all_ids.to_numpy(), worst.to_numpy()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                own = all_ids[a:b]
                x = unit_rows(matrix(vectors.slice(a, b - a)))
                linked = np.where(_linked(x, x, least), own[None, :], np.iinfo(np.int64).max).min(axis=1)
                found = _nearest(own, x @ x.T, worst[a:b], NEIGHBOURS)
                for i, at in enumerate(found):
                    anchor = linked[i] < own[i]
                    if len(at) or anchor:
                        ids.append(own[i])
                        near.append(own[at])
                        far.append(-_cosines(x, x, np.full(len(at), i), at))
                        anchors.append(int(linked[i]) if anchor else None)
            sizes = np.cumsum([0] + [len(x) for x in near]).astype(np.int32)
            entries = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(far) if far else np.zeros(0)), pa.array(np.concatenate(near) if near else np.zeros(0, np.int64), pa.int64())], names=["far", "id"]
            )
            return pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), entries), pa.array(anchors, pa.int64())], names=["id", "near", "anchor"])

        return step

    return map_batches(groups.select("members"), make, _LISTS)


def _merged(lists: DataFrame) -> DataFrame:
    """One list for each vector: the nearest of all, ties to the smaller id, each neighbour once. Entries
    stay rows until the list is cut, so a vector that is proposed very often fills no cell."""
    each = lists.repartition("id").select("id", "anchor", F.explode_outer("near").alias("e"))
    pairs = each.groupBy("id", F.col("e.id").alias("other")).agg(F.min("e.far").alias("far"), F.min("anchor").alias("anchor"))
    order = Window.partitionBy("id").orderBy(F.asc_nulls_last("far"), "other")
    first = F.when(F.col("other").isNotNull() & (F.col("place") <= NEIGHBOURS), F.struct("far", F.col("other").alias("id")))
    placed = pairs.withColumn("place", F.row_number().over(order))
    return placed.groupBy("id").agg(F.array_sort(F.collect_list(first)).alias("near"), F.min("anchor").alias("anchor"))


def _struct(worst: Column) -> Column:
    return F.struct("id", "x", worst.cast("double").alias("worst"))


def _descended(nodes: DataFrame, lists: DataFrame, least: float) -> DataFrame:
    """Proposals from one round: the neighbours of a vector, in both directions, meet each other. A
    vector with very many is joined in parts, each by the hash of the neighbour."""
    edges = lists.select(F.col("id").alias("u"), F.explode("near.id").alias("v"))
    anchors = lists.filter("anchor is not null").select(F.col("anchor").alias("u"), F.col("id").alias("v"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).unionByName(anchors).distinct()
    worst = F.when(F.size("near") < NEIGHBOURS, F.lit(-2.0)).otherwise(-F.element_at("near", -1)["far"]).alias("worst")
    carried = nodes.select("id", "x").join(lists.select("id", worst), "id")
    degrees = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    part = F.pmod(F.xxhash64("v"), F.ceil(F.col("degree") / JOINED)).alias("part")
    rows = both.join(degrees, "u").select("u", "v", part).join(carried.withColumnRenamed("id", "v"), "v")
    groups = rows.select("u", "part", F.col("v").alias("id"), "x", "worst").groupBy("u", "part").agg(F.collect_list(_struct(F.col("worst"))).alias("members"))
    return _joined(groups, least)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first place that each place reaches over the links of a symmetric matrix."""
    root = np.arange(len(linked))
    at = np.flatnonzero(linked.any(axis=1))
    inside = linked[np.ix_(at, at)]
    while len(at):
        near = np.where(inside, root[at][None, :], len(root)).min(axis=1)
        new = root.copy()
        np.minimum.at(new, root[at], near)
        new[at] = np.minimum(new[at], near)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _block_links(members: DataFrame, least: float) -> DataFrame:
    """(id, links, root) by comparing all members (component, id, n, x) of one component, block by block:
    two blocks meet in one row, and only sums and the first vector reached leave it, once for each two
    blocks. The edges from vector to root connect what the links do."""
    sizes = members.groupBy("component", F.size("x").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = members.withColumn("dim", F.size("x")).join(sizes, ["component", "dim"]).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", "dim", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("id", "n", "x", "own").alias("member"))
    groups = rows.groupBy("component", "dim", "i", "j").agg(F.collect_list("member").alias("members")).select("members")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(0)
            ends = column.offsets.to_numpy()
            values = column.values
            ids, count, own = (values.field(n).to_numpy() for n in ("id", "n", "own"))
            out = [(np.zeros(0, np.int64),) * 3]
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                x, side, n = unit_rows(matrix(values.field("x").slice(a, b - a))), own[a:b], count[a:b]
                like = _linked(x, x, least)
                if side.min() != side.max():
                    like &= side[:, None] != side[None, :]
                np.fill_diagonal(like, False)
                total, root = like @ n, _roots(like)
                some = total > 0
                out.append((ids[a:b][some], total[some], ids[a:b][root[some]]))
            return pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["id", "links", "root"])

        return step

    return map_batches(groups, make, "id bigint, links bigint, root bigint")


def _truth(nodes: DataFrame, asked: pa.Table, least: float) -> DataFrame:
    """(id, truth): links of the asked vectors, counted against all vectors."""
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def make():
        asked = shared.value.combine_chunks()
        vectors = asked.column("x").combine_chunks() if isinstance(asked.column("x"), pa.ChunkedArray) else asked.column("x")
        ids, labels = asked.column("id").to_numpy(), asked.column("label").to_numpy()
        width = np.diff(vectors.offsets.to_numpy())
        by_width = {int(d): unit_rows(matrix(vectors.take(pa.array(np.flatnonzero(width == d))))) for d in np.unique(width)}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            own, label, n = (batch.column(c).to_numpy() for c in ("id", "label", "n"))
            x = batch.column("x")
            size = np.diff(x.offsets.to_numpy())
            truth = np.zeros(len(ids), np.int64)
            for dim, asked_rows in by_width.items():
                q, r = np.flatnonzero(width == dim), np.flatnonzero(size == dim)
                if len(r):
                    like = _linked(asked_rows, unit_rows(matrix(x.take(pa.array(r)))), least)
                    like &= (labels[q][:, None] == label[r][None, :]) & (ids[q][:, None] != own[r][None, :])
                    truth[q] += like @ n[r]
            some = truth > 0
            return pa.record_batch([pa.array(ids[some]), pa.array(truth[some])], names=["id", "truth"])

        return step

    found = map_batches(nodes.select("id", "label", "n", "x"), make, "id bigint, truth bigint")
    return found.groupBy("id").agg(F.sum("truth").alias("truth"))


def _audited(nodes: DataFrame, count: int, least: float, scratch: Scratch) -> DataFrame:
    """(id, truth) of audited vectors that have links. Vectors are asked in the order of their ids' hash,
    each time four times as many as before, until AUDIT of them have some or AUDITED_MOST were asked."""
    asked = lowest_hashes(nodes.select("id", "label", "x"), AUDITED_MOST, count)
    out, at, size, linked = None, 0, AUDITED, 0
    while out is None or at < asked.num_rows and linked < AUDIT:
        some = scratch.keep(_truth(nodes, asked.slice(at, size), least))
        out = some if out is None else out.unionByName(some)
        linked += some.count()
        at, size = at + size, 3 * (at + size)
    return out


def _recall(result: DataFrame, truth: DataFrame) -> float:
    """The worse of the share of the audited vectors' links that was found and the mean of each one's
    share, so that neither a large group nor many small ones hide what the others miss."""
    found = F.coalesce("others", F.lit(0))
    seen = truth.join(result, "id", "left").agg(F.sum(found), F.sum("truth"), F.avg(found / F.col("truth"))).first()
    return 1.0 if not seen[1] else min(seen[0] / seen[1], seen[2])


def _change(before: DataFrame, after: DataFrame) -> tuple[float, tuple]:
    """Share of the neighbours in the lists that were not in them before, and a digest of the lists."""
    old = before.select("id", F.col("near.id").alias("old"))
    ids = F.array_distinct("near.id")
    same = F.coalesce(F.size(F.array_intersect(ids, "old")), F.lit(0))
    digest = F.sum(F.xxhash64("id", "near.id").cast("decimal(20,0)"))
    new, total, state = after.join(old, "id", "left").agg(F.sum(F.size(ids) - same), F.sum(F.size(ids)), digest).first()
    return new / total if total else 0.0, (total, state)


def _settled(nodes: DataFrame, lists: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Lists after descents that end when few entries are new or the lists are as they were before."""
    seen: set[tuple] = set()
    while True:
        before, lists = lists, scratch.keep(_merged(lists.unionByName(_descended(nodes, lists, least))))
        share, state = _change(before, lists)
        if share <= NEW or state in seen:
            return lists
        seen.add(state)


def _per_id(nodes: DataFrame, found: DataFrame, listed: DataFrame, counted: DataFrame) -> DataFrame:
    """(id, others, component_id): links and component of each id; an id met with several labels or vectors
    has the most links and the smallest component."""
    rows = nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").join(listed, "id", "left").join(counted, "id", "left")
    rows = rows.select("id", F.coalesce("links", "listed", F.lit(0)).alias("others"), F.coalesce("component", "id").alias("component_id"))
    return rows.groupBy("id").agg(F.max("others").alias("others"), F.min("component_id").alias("component_id"))


def link_vectors(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) for each row, recall of the audit).

    1. Equal vectors of a label are one node with a count, so copies cost nothing.
    2. Leaves of random hyperplane trees give every node a first list of neighbours.
    3. NN-descent: the neighbours of each node, in both directions, are compared with each other and
       enter each other's lists where they are nearer.
    4. Lists that hold nothing but links are saturated and are enlarged: the nodes of their connected
       component are compared block by block, so that a list of any length is counted, not written.
    5. An audit compares nodes, until enough of them have links, with all; more trees and descents follow,
       on top of the lists so far, until it finds the recall asked for. Any two vectors of a label share
       a leaf of a new tree with some probability, so the rounds come to an end whatever the vectors.

    Cosines are in double precision, each summed in one order, so that a pair is as near wherever it is met. A null id or label, and a vector that is null, empty, zero or holds
    a null or non-finite component, is linked with nothing: no links, its own component, kept.
    Vectors of different lengths are never linked. Repeated rows are copies of each other. No rows give
    no rows; other columns are not read.
    """
    scratch = Scratch(rows.sparkSession, "vector-links")
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("x"), F.col(label_col).cast("int").alias("label"))
    fine = rows.filter(usable("x") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = scratch.keep(fine.groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    nodes = classes.select("id", "label", "n", "x")
    sizes = scratch.keep(nodes.groupBy("label", F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("members")))
    count = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    truth = _audited(nodes, count, least, scratch)
    lists, seed, recall = None, 0, 0.0
    while recall < RECALL:
        groups = _leaves(nodes, sizes, seed).groupBy("label", "dim", "tree", "leaf", "part").agg(F.collect_list(_struct(F.lit(-2.0))).alias("members"))
        grown = _joined(groups, least)
        lists = scratch.keep(_merged(grown if lists is None else lists.unionByName(grown)))
        lists = _settled(nodes, lists, least, scratch)
        entries = lists.select("id", F.explode("near").alias("e")).select("id", F.col("e.id").alias("other"), (-F.col("e.far")).alias("like")).filter(F.col("like") >= least)
        links = entries.select(F.col("id").alias("a"), F.col("other").alias("b"))
        links = links.unionByName(lists.filter("anchor is not null").select(F.col("id").alias("a"), F.col("anchor").alias("b")))
        links = scratch.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = scratch.keep(components(links, scratch))
        full = entries.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= NEIGHBOURS)
        crowded = full.join(found, F.col("id") == F.col("node")).select("component").distinct()
        inside = found.join(crowded, "component").select(F.col("node").alias("id"), "component").join(nodes, "id")
        counted = _block_links(inside.select("component", "id", "n", "x"), least).groupBy("id").agg(F.sum("links").alias("links"))
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        listed = sides.join(nodes.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("listed"))
        result = scratch.keep(_per_id(nodes, found, listed, counted))
        recall = _recall(result, truth)
        seed += 1
    placed = fine.join(classes, ["label", "x"]).select("vec_id", "id", "n").join(result, "id")
    placed = placed.groupBy("vec_id").agg(F.max(F.col("others") + F.col("n") - 1).alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(placed, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall
