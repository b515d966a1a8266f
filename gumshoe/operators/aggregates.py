"""Counts and indexes over the quest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.text import initial, sanitize_label
from gumshoe.operators.filters import Params, get_cities, get_countries, get_events, get_idents, get_orgs
from gumshoe.quest import ENTITY_KINDS, Quest


def _cat_rows(quest: Quest, kinds: Sequence[str]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            quest.table(k).select(F.lit(k).alias("kind"), "name", "label", F.explode("cats").alias("cat"))
            for k in kinds
        ],
    )


def cats_by_kind(quest: Quest, kinds: Sequence[str] = ENTITY_KINDS) -> DataFrame:
    """Distinct (kind, cat), ordered. Partial aggregation leaves one row per task and category."""
    return _cat_rows(quest, kinds).select("kind", "cat").distinct().orderBy("kind", "cat")


def objects_by_cat(quest: Quest, cat: str, kinds: Sequence[str] = ENTITY_KINDS) -> DataFrame:
    """(kind, name) of everything in a category, ordered; a plain filter before the sort."""
    parts = [
        quest.table(k).where(F.array_contains("cats", cat)).select(F.lit(k).alias("kind"), "name")
        for k in kinds
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("kind", "name")


def idents_by_cat(quest: Quest) -> DataFrame:
    """(cat, label, name) ordered by category then label: a range-partitioned sort, so a big
    category spreads over many tasks instead of becoming one list."""
    return (
        _cat_rows(quest, ["idents"]).select("cat", "label", "name").orderBy("cat", "label", "name")
    )


def count_by_country(quest: Quest, params: Params, kind: str = "idents") -> DataFrame:
    p = params
    rows = {
        "idents": lambda: get_idents(quest, p.orgs, p.idents, p.cats, p.countries),
        "events": lambda: get_events(quest, p.orgs, p.cats, p.countries),
        "orgs": lambda: get_orgs(quest, p.orgs, p.cats, p.countries),
        "cities": lambda: get_cities(quest, p.cats, p.countries),
        "countries": lambda: get_countries(quest, p.cats),
    }[kind]()
    if kind == "idents" and not (p.cats or p.countries):
        from gumshoe.operators.attributes import effective_country

        rows = effective_country(rows, quest, inherit=True)
    return rows.groupBy("country").agg(F.count(F.lit(1)).alias("value"))


def letter_index(quest: Quest, kinds: Sequence[str]) -> DataFrame:
    """Alphabetical index rows (initial, label, kind, name, docname), in order."""
    parts = [
        quest.table(k).select(
            initial(F.col("label")).alias("initial"),
            sanitize_label(F.col("label")).alias("label"),
            F.lit(k).alias("kind"),
            "name",
            "docname",
        )
        for k in kinds
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("initial", "label", "kind", "name")


def letter_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("initial").agg(F.count(F.lit(1)).alias("n"))


def index_stats(docs: DataFrame, doc: str = "doc") -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.max(doc).alias("last_id"))


def top_k(df: DataFrame, key: str, n: str, k: int) -> DataFrame:
    """Most common `k`, ties by key: a per-task heap, no full sort."""
    return df.orderBy(F.desc(n), F.asc(key)).limit(k)
