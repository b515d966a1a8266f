"""Harvested references: publisher by domain, what is new, draft events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.text import clean_label, slugify, truncate_words
from gumshoe.functions.urls import domain, domain_suffixes, normalize_url
from gumshoe.operators.ranking import first_by_key


def domain_map(events: DataFrame, order: str = "name") -> DataFrame:
    """(domain, from, place): the first publisher seen per domain, with where it was seen.
    `events` has `url` and `from`."""
    rows = events.where(F.coalesce("url", F.lit("")) != "").where(F.coalesce("from", F.lit("")) != "")
    rows = rows.select(domain(F.col("url")).alias("domain"), F.col(order).alias("place"), "from")
    return first_by_key(rows, ["domain"], ["place"])


def known_urls(*tables: DataFrame) -> DataFrame:
    """Distinct normalised addresses of several tables."""
    out = None
    for t in tables:
        rows = t.select(normalize_url(F.col("url")).alias("norm")).where("norm is not null")
        out = rows if out is None else out.union(rows)
    return out.distinct()


def domain_match(domains: DataFrame, known: DataFrame) -> DataFrame:
    """(domain, from): the publisher of the same domain, else of the first known parent or
    sub-domain, null when none.

    "Ends with" becomes equality on listed parent domains, so both directions are equi joins.
    """
    wanted = domains.select("domain").distinct()
    parents = wanted.select("domain", F.explode(domain_suffixes(F.col("domain"))).alias("known"))
    children = known.select(
        F.explode(domain_suffixes(F.col("domain"))).alias("domain"), F.col("domain").alias("known"), "from", "place"
    )
    named = known.select(F.col("domain").alias("known"), "from", "place")
    exact = wanted.join(named, F.col("domain") == F.col("known")).select("domain", F.lit(0).alias("rank"), "place", "from")
    up = parents.join(named, "known").select("domain", F.lit(1).alias("rank"), "place", "from")
    down = wanted.join(children, "domain").select("domain", F.lit(1).alias("rank"), "place", "from")
    best = first_by_key(exact.union(up).union(down), ["domain"], ["rank", "place"])
    return wanted.join(best.select("domain", "from"), "domain", "left")


def new_references(references: DataFrame, known: DataFrame, order: str = "pos") -> DataFrame:
    """References whose address is neither in the quest nor repeated."""
    rows = references.withColumn("norm", normalize_url(F.col("url"))).join(known, "norm", "left_anti")
    return first_by_key(rows, ["norm"], [order]).drop("norm")


def harvest_events(references: DataFrame, publishers: DataFrame) -> DataFrame:
    """Draft event rows (slug, label, description, from, url, begin) ordered by publisher.

    `references` has url, title, description, date; the publisher falls back to the domain.
    """
    rows = references.withColumn("domain", domain(F.col("url"))).join(publishers, "domain", "left")
    base = slugify(truncate_words(F.col("title"), 7))
    slug = F.when(F.col("from").isNotNull(), F.concat_ws("_", slugify(F.col("from")), base)).otherwise(base)
    return rows.select(
        slug.alias("slug"),
        clean_label(F.col("title")).alias("label"),
        "description",
        F.coalesce("from", "domain").alias("from"),
        "url",
        F.coalesce("date", F.lit("")).alias("begin"),
    ).orderBy(F.lower("from"), "url")
