"""Attributes an entity takes from others: country, categories, style, URL, fetch method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.quest import EDGE_ENDS, EDGE_KINDS, ENTITY_KINDS, Quest, first_org


def effective_country(df: DataFrame, quest: Quest, inherit: bool = False) -> DataFrame:
    """Own country, else (on request) the first organisation's, else the quest default."""
    own = F.when(F.col("country") != "", F.col("country"))
    fallback = F.lit(quest.default_country).cast("string")
    if not inherit:
        return df.withColumn("country", F.coalesce(own, fallback))
    lookup = quest.orgs.select(
        F.col("name").alias("_org"),
        F.when(F.col("country") != "", F.col("country")).alias("_org_country"),
    )
    joined = df.withColumn("_first", first_org()).join(
        lookup, F.col("_first") == F.col("_org"), "left"
    )
    return joined.withColumn("country", F.coalesce(own, "_org_country", fallback)).drop(
        "_first", "_org", "_org_country"
    )


def inherit_org_cats(df: DataFrame, quest: Quest) -> DataFrame:
    """Own categories, else those of the first organisation. Serves idents, whois records,
    channels and profiles alike."""
    lookup = quest.orgs.select(F.col("name").alias("_org"), F.col("cats").alias("_org_cats"))
    joined = df.withColumn("_first", first_org()).join(
        lookup, F.col("_first") == F.col("_org"), "left"
    )
    cats = F.when(F.size("cats") > 0, F.col("cats")).otherwise(
        F.coalesce("_org_cats", F.array().cast("array<string>"))
    )
    return joined.withColumn("cats", cats).drop("_first", "_org", "_org_cats")


def end_cats(quest: Quest, kind: str) -> DataFrame:
    """(name, cats) that an edge takes from an end of this kind."""
    rows = quest.table(kind)
    return (inherit_org_cats(rows, quest) if kind == "idents" else rows).select("name", "cats")


def effective_cats(df: DataFrame, quest: Quest, kind: str) -> DataFrame:
    """Categories after inheritance: idents from their first organisation, edges from both ends."""
    if kind == "idents":
        return inherit_org_cats(df, quest)
    if kind not in EDGE_ENDS:
        return df
    start, stop, start_kind, stop_kind = EDGE_ENDS[kind]

    def lookup(side: str, of_kind: str) -> DataFrame:
        return end_cats(quest, of_kind).select(F.col("name").alias(side), F.col("cats").alias(side + "_cats"))

    joined = df.join(lookup("_a", start_kind), F.col(start) == F.col("_a"), "left").join(
        lookup("_b", stop_kind), F.col(stop) == F.col("_b"), "left"
    )
    cats = F.when(F.size("cats") > 0, F.col("cats")).otherwise(F.concat("_a_cats", "_b_cats"))
    return joined.withColumn("cats", cats).drop("_a", "_b", "_a_cats", "_b_cats")


def inherit_attrs(quest: Quest) -> Quest:
    """The quest with every derived country and category written out."""

    def full(kind: str) -> DataFrame:
        rows = effective_cats(quest.table(kind), quest, kind)
        return effective_country(rows, quest, inherit=kind == "idents")

    return quest.with_tables(**{k: (lambda k=k: full(k)) for k in ENTITY_KINDS + EDGE_KINDS})


# Class defaults of a kind without category style.
STYLE_DEFAULTS = {"style": "solid", "shape": "circle"}
EVENT_STYLE_DEFAULTS = {"style": "dashed", "shape": "folder"}


def with_style(df: DataFrame, styles: dict[str, dict[str, str]] | None, kind: str = "idents") -> DataFrame:
    """style, shape, fillcolor, color: by the first category, else the 'default' entry, else the
    class default. `styles` is configuration, so it becomes a literal map, not a join."""
    styles = styles or {}
    base = EVENT_STYLE_DEFAULTS if kind == "events" else STYLE_DEFAULTS
    first = F.try_element_at(F.col("cats"), F.lit(1))
    for attribute in ("style", "shape", "fillcolor", "color"):
        pairs = [(c, s[attribute]) for c, s in styles.items() if c != "default" and attribute in s]
        value: Column = F.lit(None).cast("string")
        if pairs:
            lookup = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
            value = F.try_element_at(lookup, first)
        fallback = styles.get("default", {}).get(attribute, base.get(attribute))
        df = df.withColumn(attribute, F.coalesce(value, F.lit(fallback).cast("string")))
    return df


def source_url(order=("url", "youtube", "bsky", "link")) -> Column:
    """First known address of a source. Entity pages and search rows use different orders."""
    return F.coalesce(*[F.col(c) for c in order])


def entity_urls(quest: Quest, *kinds: str) -> DataFrame:
    """(kind, name, url): the address of the first linked source."""
    cited = None
    for kind in kinds:
        rows = quest.table(kind).select(
            F.lit(kind).alias("kind"), "name", F.try_element_at("sources", F.lit(1)).alias("source")
        )
        cited = rows if cited is None else cited.unionByName(rows)
    urls = quest.sources.select(F.col("name").alias("source"), source_url().alias("url"))
    return cited.join(urls, "source", "left").select("kind", "name", "url")
