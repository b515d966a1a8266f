"""Shards of near equal size: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Scratch

#: Hex digits by which one level splits a block of groups: 4096 parts.
DIGITS = 3
KEY_DIGITS = 15
#: Parts of a shard whose rows are numbered together; spread by the id, so equal texts don't meet in one.
SLOT_PARTS = 4096


def text_size(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def group_key(text: str) -> Column:
    """Place of a text in the order of groups, the same for equal texts: the first digits of its digest."""
    return F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, KEY_DIGITS)


def _blocks(sizes: DataFrame, prefixes: list[str], digits: int) -> list[tuple[str, int, int]]:
    """(prefix, bytes, groups) of the blocks under `prefixes`, in order: at most 4096 for each prefix."""
    part = sizes
    if digits > DIGITS:
        part = part.filter(F.substring("key", 1, digits - DIGITS).isin(prefixes))
    part = part.groupBy(F.substring("key", 1, digits).alias("block"))
    rows = part.agg(F.sum("size").alias("size"), (F.min("key") == F.max("key")).alias("single")).collect()
    return sorted((r["block"], r["size"], r["single"]) for r in rows)


def _fill(items: list[tuple[str, int, bool]], capacity: int, shards: int, divide: bool) -> list[int] | None:
    """Greedy cuts (index of the first item of each later shard) or None if `shards` are too few.

    With `divide`, a block of several groups may be cut anywhere, which no real cut can beat.
    """
    cuts, used, count = [], 0, 1
    for i, (_, size, single) in enumerate(items):
        if used + size <= capacity:
            used += size
            continue
        if divide and not single:
            rest = size - (capacity - used)
            more = -(-rest // capacity)
            count += more
            used = rest - (more - 1) * capacity
            cuts += [i] * more
        else:
            if size > capacity:
                return None
            count, used = count + 1, size
            cuts.append(i)
        if count > shards:
            return None
    return cuts


def _smallest(items: list[tuple[str, int, bool]], shards: int, divide: bool) -> int:
    total = sum(x[1] for x in items)
    low, high = -(-total // shards), max(total, 1)
    while low < high:
        mid = (low + high) // 2
        if _fill(items, mid, shards, divide) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(sizes: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest feasible shard capacity over the groups of `sizes` (key, size) in key order, and the
    keys at which the later shards begin.

    The groups are seen as blocks of keys with one prefix, at most 4096 for a prefix, so the driver
    holds a number of sums that depends on the shards alone. A binary search with greedy filling gives
    the smallest capacity if blocks could be cut anywhere (no cut can do better) and if none could
    be cut. Where the two agree, the second is the optimum with its cuts; else only the blocks
    that some capacity in between could cut are split further.
    """
    items = _blocks(sizes, [], DIGITS)
    while True:
        best = _smallest(items, shards, True)
        cuts = _fill(items, best, shards, False)
        if cuts is None:
            best = _smallest(items, shards, True)
            safe = _smallest(items, shards, False)
            open_ = [items[i][0] for i in _touched(items, best, safe, shards) if len(items[i][0]) < KEY_DIGITS]
            if not open_:
                best, cuts = safe, _fill(items, safe, shards, False)
        if cuts is not None:
            return best, [items[i][0] for i in cuts]
        finer = []
        for length in sorted({len(x) for x in open_}):
            finer += _blocks(sizes, [x for x in open_ if len(x) == length], length + DIGITS)
        items = sorted([x for x in items if x[0] not in set(open_)] + finer)


def giant_groups(sizes: DataFrame, shards: int) -> list[str]:
    """Keys of the groups larger than an equal share of what is left; each gets a shard of its own.
    They come first in the order of groups, so that the rest is still cut evenly."""
    left = sizes.agg(F.sum("size")).first()[0] or 0
    giants = []
    for row in sizes.orderBy(F.desc("size"), "key").limit(shards - 1).collect():
        if row["size"] * (shards - len(giants)) <= left:
            break
        giants.append(row["key"])
        left -= row["size"]
    return giants


def _touched(items, low: int, high: int, shards: int) -> list[int]:
    """Blocks of several groups in which a greedy cut can fall for a capacity from `low` to `high`:
    cut number j lies between what j shards hold at least and j times `high`."""
    ends, total = [], 0
    for _, size, _ in items:
        total += size
        ends.append(total)
    out = set()
    first = _fill_positions(items, low)
    for j in range(1, shards):
        a = bisect_right(ends, first[j - 1] if j - 1 < len(first) else total)
        b = bisect_right(ends, min(total, j * high))
        out |= {i for i in range(max(0, a - 1), min(b + 1, len(items))) if not items[i][2]}
    return sorted(out)


def _fill_positions(items, capacity: int) -> list[int]:
    """Bytes before each greedy cut when no block is divided, however many shards that takes."""
    at, used, total = [], 0, 0
    for _, size, _ in items:
        if used + size > capacity and used:
            at.append(total)
            used = 0
        used, total = used + size, total + size
    return at


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Contiguous shards under the law `bytes`: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Rows with equal texts are one atomic group and share a shard; groups are ordered by the digest of
    their text, after those larger than an equal share. The largest shard is as small as any cut
    of that order allows. A null text has size 1
    and the checksum of no bytes, and shares a group with empty texts. An empty table gives no rows;
    repeated rows are numbered apart; columns other than the two are not read. `slot` numbers the
    rows of a shard from 0: by part of the id's hash, then id, so that no task sorts a whole shard
    and a group of copies is spread.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = rows.select("doc_id", text_size("text").alias("size"), group_key("text").alias("key"))
    scratch = Scratch(docs.sparkSession, "sharding")
    sizes = scratch.keep(sized.groupBy("key").agg(F.sum("size").alias("size")))
    giants = giant_groups(sizes, shards)
    _, starts = minimax_cuts(sizes.filter(~F.col("key").isin(giants)), shards - len(giants))
    scratch.drop(sizes)
    rows = rows.select("doc_id", text_size("text").alias("size"), F.crc32(bytes_).alias("text_crc32"), group_key("text").alias("key"))
    shard = sum(((F.col("key") >= start).cast("int") for start in starts), F.lit(len(giants)))
    for i, key in enumerate(giants):
        shard = F.when(F.col("key") == key, F.lit(i)).otherwise(shard)
    rows = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_PARTS)).cast("int").alias("part"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x SLOT_PARTS rows.
    offsets = F.broadcast(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")))
    return numbered.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("place") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
