"""Ranks, first-wins, forward fill: windows that survive one group holding most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.session import pin


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet; the keys and other columns of `left`, then the rest of `right`."""
    named = {k: f"_same_{k}" for k in keys}
    other = right.withColumnsRenamed(named)
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
    return left.join(other, match, how).drop(*named.values())


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key. An aggregate of one struct: partial results are merged before the
    shuffle, so a hot key sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first `k` rows per group. The rank filter lets Spark cut every group to `k` rows in
    each task before the shuffle (window group limit)."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def ranked(df: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Exact 1-based rank, over the whole table or within groups, without one task per group.

    Rows are range-partitioned by (group, order) and written once, so the bounds hold; each
    partition is numbered on its own and shifted by the rows of its group before it. The order
    should be total.
    """
    placed = pin(
        df.repartitionByRange(*[F.col(c) for c in within], *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", *within).orderBy(*order)
    sizes = placed.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"))
    # One row per task and group: a group spans many tasks only when it is large.
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", *within, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = placed.withColumn("_pos", F.row_number().over(inside))
    out = join_same(numbered, shifts, ["_part", *within])
    return out.select(*df.columns, (F.col("_pos") + F.col("_shift")).alias(name))


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], chunk: Column
) -> DataFrame:
    """Fill nulls with the last known value in order, per key.

    `chunk` must grow with the order (a day or month of the time). Each chunk is filled on its
    own and takes over what the chunks before it left, so one key may hold most of the rows.
    """
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    when = F.struct(*order)
    lasts = rows.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(v, F.when(F.col(v).isNotNull(), when)).alias("_last_" + v)
            for v in values
        ]
    )
    # One row per key and chunk.
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *keys, "_chunk", *[F.last("_last_" + v, ignorenulls=True).over(earlier).alias("_from_" + v) for v in values]
    )
    filled = rows.select(
        *[c for c in rows.columns if c not in values],
        *[F.last(v, ignorenulls=True).over(inside).alias(v) for v in values],
    )
    filled = join_same(filled, carried, [*keys, "_chunk"])
    return filled.select(
        *[c for c in df.columns if c not in values],
        *[F.coalesce(v, "_from_" + v).alias(v) for v in values],
    )


def sort_dated(df: DataFrame, begin: str, newest: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """By date, undated rows always last."""
    by = F.desc_nulls_last(begin) if newest else F.asc_nulls_last(begin)
    return df.orderBy(by, *ties)


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 10) -> tuple[DataFrame, Column]:
    """One page with continued rank numbers, and the total as a scalar.

    Only `offset + limit` rows leave the tasks; the page itself is numbered."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    number = F.row_number().over(Window.orderBy(*order)) + offset
    return rows.withColumn("rank", number), total


def marker_size(df: DataFrame, value: str, low: float = 50.0, high: float = 500.0) -> DataFrame:
    """Min-max scaled size; the bounds are one aggregate row, not a window over everything."""
    floor = df.agg(F.min(value)).scalar()
    ceil = df.agg(F.max(value)).scalar()
    span = F.when(ceil != floor, ceil - floor).otherwise(F.lit(1))
    return df.withColumn("size", F.lit(low) + (high - low) * (F.col(value) - floor) / span)


def channel_latest(videos: DataFrame, channel: str, position: str, limit: str | int) -> DataFrame:
    """The first `limit` videos of each channel in feed order; `limit` may be a column with a
    limit per channel (null = all)."""
    if isinstance(limit, int):
        return top_per_group(videos, [channel], [F.asc(position)], limit)
    return videos.where(F.col(limit).isNull() | (F.col(position) < F.col(limit)))


def timeline(events: DataFrame) -> DataFrame:
    """(place, begin, label, side) of the dated events: one label per date, the last event by
    name winning; labels alternate above and below in date order."""
    dated = events.where(F.col("begin").isNotNull())
    last = dated.groupBy("begin").agg(F.max_by("short", "name").alias("label"))
    placed = ranked(last, [F.asc("begin")], name="place")
    side = F.when(F.col("place") % 2 == 1, "above").otherwise("below")
    return placed.select("place", "begin", "label", side.alias("side"))
