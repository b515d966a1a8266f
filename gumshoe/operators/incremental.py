"""Refresh by difference: fingerprints, manifests, modification times, feeds, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.operators.ranking import first_by_key, join_same
from gumshoe.quest import KINDS, Quest


def diff_by_hash(old: DataFrame, new: DataFrame, key: str, hashes: Sequence[str], actions: dict[str, str]) -> DataFrame:
    """(key, action): one full outer join of two manifests. `actions` names the outcomes
    new / same / changed / gone."""
    had = old.select(key, F.lit(True).alias("_old"), *[F.col(h).alias("_o_" + h) for h in hashes])
    has = new.select(key, F.lit(True).alias("_new"), *[F.col(h).alias("_n_" + h) for h in hashes])
    same = F.lit(True)
    for h in hashes:
        same = same & (F.col("_o_" + h) == F.col("_n_" + h))
    action = (
        F.when(F.col("_old").isNull(), actions["new"])
        .when(F.col("_new").isNull(), actions["gone"])
        .when(F.coalesce(same, F.lit(False)), actions["same"])
        .otherwise(actions["changed"])
    )
    return had.join(has, key, "full").select(key, action.alias("action"))


def incr_index(old: DataFrame, new: DataFrame, key: str = "doc", fingerprint: str = "fingerprint") -> DataFrame:
    """insert / keep / update / delete per document, by fingerprint."""
    names = {"new": "insert", "same": "keep", "changed": "update", "gone": "delete"}
    return diff_by_hash(old, new, key, [fingerprint], names)


def incr_sync(manifest: DataFrame, local: DataFrame, key: str = "filename") -> DataFrame:
    """upload / skip / replace / delete per file, by content and metadata hash; a manifest entry
    without hashes counts as changed."""
    names = {"new": "upload", "same": "skip", "changed": "replace", "gone": "delete"}
    return diff_by_hash(manifest, local, key, ["hash", "hash_meta"], names)


def incr_mtime(local: DataFrame, remote: DataFrame, delete_orphans: bool = False) -> DataFrame:
    """(path, action): upload what is absent or newer, skip the rest, delete remote orphans on
    request. Both sides are (path, mtime)."""
    there = remote.select("path", F.lit(True).alias("_there"), F.col("mtime").alias("_remote"))
    here = local.select("path", F.lit(True).alias("_here"), F.col("mtime").alias("_local"))
    action = (
        F.when(F.col("_here").isNull(), F.lit("delete" if delete_orphans else "ignore"))
        .when(F.col("_remote").isNotNull() & (F.col("_local") <= F.col("_remote")), "skip")
        .otherwise("upload")
    )
    return here.join(there, "path", "full").select("path", action.alias("action"))


PROFILE_FIELDS = ("handle", "display_name", "description", "followers_count", "follows_count", "posts_count")


def profile_diff(snapshots: DataFrame, keys: Sequence[str] = ("did",), order: Sequence[str] = ("taken_at",), chunk=None) -> DataFrame:
    """(did, taken_at, changes): fields that differ from the snapshot before, with the old value.

    An account may have most of the snapshots, so the look back runs per (account, day): only
    the first row of a day asks the day before, through one row per account and day.
    """
    fields = [f for f in PROFILE_FIELDS if f in snapshots.columns]
    day = F.date_trunc("day", order[0]) if chunk is None else chunk
    rows = snapshots.withColumn("_day", day)
    inside = Window.partitionBy(*keys, "_day").orderBy(*order)
    lasts = rows.groupBy(*keys, "_day").agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_last"))
    days = Window.partitionBy(*keys).orderBy("_day")
    carried = lasts.select(*keys, "_day", F.lag("_last").over(days).alias("_yesterday"))
    looked = join_same(rows.withColumn("_today", F.lag(F.struct(*fields)).over(inside)), carried, [*keys, "_day"])
    before = F.coalesce("_today", "_yesterday")
    names = F.array(*[F.lit(f) for f in fields])
    entries = F.map_from_arrays(names, F.array(*[before[f].cast("string") for f in fields]))
    now = F.map_from_arrays(names, F.array(*[F.col(f).cast("string") for f in fields]))
    both = looked.where(before.isNotNull()).select(*keys, *order, entries.alias("_old"), now.alias("_now"))
    changed = F.map_filter("_old", lambda k, v: ~v.eqNullSafe(F.try_element_at("_now", k)))
    out = both.select(*keys, *order, changed.alias("changes"))
    return out.where(F.size("changes") > 0)


def rag_orphans(manifest: DataFrame) -> DataFrame:
    """Manifest entries in no collection."""
    return manifest.where(F.coalesce("collection", F.lit("")) == "")


def rag_find(manifest: DataFrame, collection: str, pattern: str) -> DataFrame:
    """Entries of a collection whose name matches."""
    return manifest.where((F.col("collection") == collection) & F.col("filename").rlike(pattern))


def incr_feed(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored rows plus the incoming ones whose key is new, each once: the first of its copies in the
    order of their other columns."""
    fresh = first_by_key(incoming.join(stored.select(*key), [*key], "left_anti"), [*key], [])
    return stored.unionByName(fresh, allowMissingColumns=True)


def merge_quest(main: Quest, other: Quest) -> Quest:
    """The later quest overwrites by name, for every kind: its rows, plus the main rows it does
    not name."""
    return main.with_tables(
        **{
            kind: other.table(kind).unionByName(
                main.table(kind).join(other.table(kind).select("name"), "name", "left_anti")
            )
            for kind in KINDS
        }
    )
