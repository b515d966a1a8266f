"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Recent, Scratch, components, map_batches, mix64, texts_of

WORDS = 5
#: One permutation is cut into so many bins by the first byte of the hash.
BINS = 256
#: A pair shares no band with a chance of 3e-6 at a similarity of 0.8, 2e-9 at 0.85; one at 0.3 shares one with 0.03.
BANDS, ROWS = 42, 6
#: Slots of the bitmap that tells which texts are read again: whole pages of 32768 bits.
SLOTS = 2**24
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(Recent):
    """64-bit hashes of words, and the shingle sets of texts made of them."""

    def __init__(self):
        super().__init__(xxhash.xxh3_64_intdigest)

    def shingles(self, text: str, n: int = WORDS) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the runs of n words; of all words if there are fewer.
        Words are cut at ASCII white space after A-Z became lower case."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        size = min(n, len(words))
        run = h[: len(h) - size + 1]
        for i in range(1, size):
            run = run * _STEP + h[i : len(h) - size + 1 + i]
        return np.unique(mix64(run + np.uint64(size)))


def _probe_ranks() -> np.ndarray:
    """For each bin the order in which it tries the others: rank[bin, other]."""
    return np.argsort(np.argsort(np.random.default_rng(41).random((BINS, BINS)), axis=1), axis=1).astype(np.int16)


class Signer:
    """One-permutation signatures with optimal densification, as band keys."""

    def __init__(self):
        self.ranks = _probe_ranks()
        self.salts = np.random.default_rng(43).integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Smallest hash of each bin; an empty bin takes that of the first bin with one in its own
        random order, independent of the set."""
        bins, first = np.unique((shingles >> np.uint64(56)).astype(np.int64), return_index=True)
        out = np.zeros(BINS, np.uint64)
        out[bins] = shingles[first]
        if len(bins) < BINS:
            empty = np.setdiff1d(np.arange(BINS), bins, assume_unique=True)
            out[empty] = out[bins[self.ranks[np.ix_(empty, bins)].argmin(axis=1)]]
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles)[: BANDS * ROWS].reshape(BANDS, ROWS)
        return mix64((mix64(rows) * self.salts).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sign(rows: DataFrame) -> DataFrame:
    """(doc_id, n, f, g, bands) of (doc_id, text): set size, 128-bit fingerprint of the set, band keys."""

    def make():
        hashes, signer = WordHashes(), Signer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [hashes.shingles(x) for x in texts_of(batch.column(1))]
            f = _signed(np.array([mix64(s ^ _STEP).sum(dtype=np.uint64) for s in sets], np.uint64))
            g = _signed(np.array([mix64(s + _STEP).sum(dtype=np.uint64) for s in sets], np.uint64))
            bands = np.concatenate([_signed(signer.bands(s)) for s in sets if len(s)] or [np.zeros(0, np.int64)])
            ends = np.cumsum([0] + [BANDS * bool(len(s)) for s in sets]).astype(np.int32)
            return pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f), pa.array(g), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands))],
                names=["doc_id", "n", "f", "g", "bands"],
            )

        return step

    return map_batches(rows, make, "doc_id bigint, n bigint, f bigint, g bigint, bands array<bigint>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of a fixed number of slots, set where an id of (id) hashes to: 2 MB whatever their number."""
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS))
    rows = ids.select(F.floor(slot / 32768).cast("int").alias("page"), (slot % 32768).cast("bigint").alias("bit"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for r in rows.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the rows (doc_id, text) whose id is among `ids` (id): the whole sets as sorted
    64-bit integers. A bitmap of the ids' hashes is sent to the texts, so that no text is shuffled; it may let
    others pass, which then meet nothing."""
    bits = rows.sparkSession.sparkContext.broadcast(_bitmap(ids))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))

    def make():
        hashes, own = WordHashes(), bits.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            slots = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((own[slots >> 3] >> (slots & 7)) & 1, pa.uint8()).cast(pa.bool_()))
            sets = [hashes.shingles(x).tobytes() for x in texts_of(batch.column(1))]
            return pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

        return step

    return map_batches(rows.filter("doc_id is not null").select("doc_id", "text", slot.alias("slot")), make, "id bigint, shingles binary")


def _held_elsewhere(sets: DataFrame, open_: DataFrame) -> DataFrame:
    """Adds `common` to the rows (key, id, n, component): how many shingles of the document some other
    of these documents holds too. No intersection among them can be larger."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.array([len(x.as_buffer()) // 8 for x in batch.column(1)])
        owner = pa.array(np.repeat(batch.column(0).to_numpy(), sizes))
        values = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)] or [np.zeros(0, np.int64)])
        return pa.record_batch([owner, pa.array(values)], names=["id", "shingle"])

    own = sets.join(open_.select("id").distinct(), "id", "left_semi").select("id", "shingles")
    spelled = map_batches(own, lambda: step, "id bigint, shingle bigint")
    held = spelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("id").alias("id"))
    lone = held.filter("holders = 1").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    return open_.join(lone, "id", "left").withColumn("common", F.col("n") - F.coalesce("lone", F.lit(0))).drop("lone")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component, with the smallest set size in their bucket."""
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).filter("low < high")
    return rows.join(mixed.select("key", "least"), "key")


def _hidden(sets: DataFrame, placed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket of `placed` (key, id, n, component) and
    that counts do not exclude: with at most c shingles in common, sizes n and m, the similarity is at
    most c / (n + m - c). Copies altered too much hold many shingles that nobody else does; they
    drop out one by one, or at the latest in the join."""

    def possible(c, n, m):
        return 100 * c >= percent * (n + m - c)

    open_ = scratch.keep(_mixed(placed))
    for _ in range(2):
        open_ = _held_elsewhere(sets, open_.drop("least", "common")).join(open_.groupBy("key").agg(F.min("n").alias("least")), "key")
        alive = possible(F.col("common"), F.col("n"), F.greatest("least", F.ceil(percent * F.col("n") / 100)))
        open_ = scratch.keep(_mixed(open_.filter(alive).drop("least")))
    # A pair meets in the first bucket it shares, and only there.
    open_ = open_.join(open_.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    other = open_.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("common").alias("shared"), F.col("component").alias("second"), F.col("keys").alias("others"))
    pairs = open_.join(other, "key").filter(
        (F.col("id") < F.col("b")) & (F.col("component") != F.col("second")) & possible(F.least("common", "shared"), F.col("n"), F.col("m"))
        & (F.array_min(F.array_intersect("keys", "others")) == F.col("key"))
    )
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on whole sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def make():
        def linked(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            same = int((y[at] == x).sum())
            return 100 * same >= percent * (len(x) + len(y) - same)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b, x, y = (batch.column(n) for n in ("a", "b", "x", "y"))
            hit = pa.array([linked(p.as_buffer(), q.as_buffer()) for p, q in zip(x, y)], pa.bool_())
            return pa.record_batch([a, b], names=["a", "b"]).filter(hit)

        return step

    return map_batches(both.select("a", "b", "x", "y"), make, "a bigint, b bigint")


def link_documents(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    1. Documents with one shingle set form a class, found by a partial-merging minimum over a 128-bit
       fingerprint; only the smallest id of a class goes on, so copies cost nothing.
    2. Representatives that share a band key share a bucket. Each bucket is a star: its centre is the
       member met most often in buckets, as the original of altered copies is, and the edges
       from the centre to the others are confirmed on whole sets.
    3. A bucket whose members are then in one component is settled. The others may hide a link from
       their star; there the members of different components meet unless counts of their shingles
       exclude a link, and are confirmed in the same way. So no pair that shares a bucket stays unsettled.
    4. Components of the confirmed edges, by alternating stars.

    Null and empty texts and texts without words have 0 shingles and are linked with nothing. A row
    with a null id has a null component and is kept. Repeated ids with different texts are one
    document with both texts' links. No rows give no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(sign(rows))
    full = signed.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "f", "g").agg(F.min("doc_id").alias("id"))
    copies = scratch.keep(full.select("doc_id", "n", "f", "g").join(classes, ["n", "f", "g"]).select("doc_id", "id"))
    leaders = copies.filter("doc_id = id").select(F.col("id").alias("doc_id")).distinct()
    bucketed = full.join(leaders, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    shared = bucketed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = scratch.keep(bucketed.join(shared, "key").select("key", "id", "n", "size").distinct())
    weights = met.groupBy("id").agg(F.sum("size").alias("weight"))
    members = scratch.keep(met.join(weights, "id").select("key", "id", "n", "weight"))
    scratch.drop(met)
    sets = scratch.keep(_sets(rows, members.select("id").distinct()))
    several = copies.groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("doc_id")
    edges = copies.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    best = Window.partitionBy("key").orderBy(F.desc("weight"), "id")
    centres = members.withColumn("place", F.row_number().over(best)).filter("place = 1").select("key", F.col("id").alias("c"), F.col("n").alias("m"))
    alike = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("id") != F.col("c"))
    pairs = members.join(centres, "key").filter(alike).select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    edges = scratch.keep(edges.unionByName(_confirmed(pairs, sets, percent)))
    labels = scratch.keep(components(edges, scratch))
    placed = members.join(labels, F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    more = scratch.keep(_confirmed(_hidden(sets, placed, percent, scratch), sets, percent))
    if not more.isEmpty():
        labels = scratch.keep(components(edges.unionByName(more), scratch))
    by_doc = copies.join(labels, F.col("id") == F.col("node"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc.select("doc_id", "component_id"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
