"""Category, country, organisation, date and name filters, and their composition per kind."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.lists import with_prefix
from gumshoe.operators.attributes import effective_cats, effective_country
from gumshoe.quest import KINDS, PREFIX, Quest

# The open ends of a date filter.
DATE_MIN = "1800-01-01"
DATE_MAX = "2100-01-01"


@dataclass(frozen=True)
class Params:
    """The parameters of a saved query (report, graph, export, list, timeline, map, analysis)."""

    cats: Sequence[str] = ()
    orgs: Sequence[str] = ()
    idents: Sequence[str] = ()
    countries: Sequence[str] = ()
    begin: str | None = None
    end: str | None = None
    borders: bool = True
    types: Sequence[str] | None = None
    exclude_cats: Sequence[str] = ()
    name: str = "report"
    label: str = ""
    # Opt-in: honour arguments that are otherwise accepted without effect.
    honour_idents: bool = False
    honour_exclude_on_edges: bool = False
    honour_dates: bool = False
    honour_event_sources: bool = False
    extra: dict = field(default_factory=dict)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def filter_cats(
    df: DataFrame,
    cats: Sequence[str] = (),
    exclude: Sequence[str] = (),
    null_ok: bool = False,
    column: str = "cats",
) -> DataFrame:
    """Rows sharing a category with `cats`; then drop those sharing one with `exclude`."""
    if cats:
        keep = F.arrays_overlap(column, _strings(cats))
        if null_ok:
            keep = keep | (F.size(column) == 0)
        df = df.where(keep)
    if exclude:
        df = df.where(~F.arrays_overlap(column, _strings(exclude)))
    return df


def cats_condition(cats: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "cats") -> Column:
    """What `filter_cats` asks of a row without empty categories."""
    keep = F.arrays_overlap(column, _strings(cats)) if cats else F.lit(True)
    return keep & ~F.arrays_overlap(column, _strings(exclude)) if exclude else keep


def filter_country(df: DataFrame, countries: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("country").isin(*countries)) if countries else df


def filter_dates(df: DataFrame, begin: str | None = None, end: str | None = None) -> DataFrame:
    """begin >= `begin` and end < `end`, each open when not given; undated rows drop out."""
    if begin is None and end is None:
        return df
    low = F.lit(begin or DATE_MIN).cast("date")
    high = F.lit(end or DATE_MAX).cast("date")
    return df.where((F.col("begin") >= low) & (F.col("end") < high))


def filter_orgs(df: DataFrame, orgs: Sequence[str] = (), null_ok: bool = False) -> DataFrame:
    if not orgs:
        return df
    keep = F.arrays_overlap("orgs", _strings(with_prefix(orgs, PREFIX["orgs"])))
    if null_ok:
        keep = keep | (F.size("orgs") == 0)
    return df.where(keep)


def filter_idents(df: DataFrame, idents: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("name").isin(*with_prefix(idents, PREFIX["idents"]))) if idents else df


def filter_types(df: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds)) if kinds else df


def filter_rows(
    df: DataFrame,
    orgs: Sequence[str] = (),
    cats: Sequence[str] = (),
    countries: Sequence[str] = (),
    exclude_cats: Sequence[str] = (),
) -> DataFrame:
    """The generic chain org -> cats -> country. Serves idents and events, but also whois
    records, channels, profiles, posts, stories and saved queries: any table that carries
    those columns. Catalyst merges the chain into one scan filter."""
    return filter_country(filter_cats(filter_orgs(df, orgs), cats, exclude_cats), countries)


def get_orgs(quest: Quest, orgs=(), cats=(), countries=(), exclude_cats=()) -> DataFrame:
    """Named organisations (all when none are named), then categories, then country."""
    df = quest.orgs
    if orgs:
        df = df.where(F.col("name").isin(*with_prefix(orgs, PREFIX["orgs"])))
    df = effective_country(df, quest)
    return filter_country(filter_cats(df, cats, exclude_cats), countries)


def get_idents(
    quest: Quest, orgs=(), idents=(), cats=(), countries=(), exclude_cats=(), honour_idents=False
) -> DataFrame:
    """Idents by organisation, category and country. `idents` takes effect on request only."""
    df = quest.idents
    if honour_idents:
        df = filter_idents(df, idents)
    df = filter_orgs(df, orgs)
    if cats or exclude_cats or countries:
        df = effective_country(effective_cats(df, quest, "idents"), quest, inherit=True)
    return filter_country(filter_cats(df, cats, exclude_cats), countries)


def get_events(quest: Quest, orgs=(), cats=(), countries=(), exclude_cats=(), begin=None, end=None) -> DataFrame:
    """Events by organisation, category and country; `begin`/`end` only if a caller passes them."""
    df = filter_rows(effective_country(quest.events, quest), orgs, cats, countries, exclude_cats)
    return filter_dates(df, begin, end)


def get_cities(quest: Quest, cats=(), countries=(), exclude_cats=()) -> DataFrame:
    df = effective_country(quest.cities, quest)
    return filter_country(filter_cats(df, cats, exclude_cats), countries)


def get_countries(quest: Quest, cats=()) -> DataFrame:
    """Countries by category only; the other arguments have no effect on countries."""
    return filter_cats(quest.countries, cats)


def get_edges(quest: Quest, kind: str, cats=(), exclude_cats=()) -> DataFrame:
    """Relations, links or quotes by their derived categories only. Without a category filter
    the endpoint joins are skipped altogether."""
    df = quest.table(kind)
    if not cats and not exclude_cats:
        return df
    return filter_cats(effective_cats(df, quest, kind), cats, exclude_cats)


def get_relations(quest: Quest, cats=(), exclude_cats=()) -> DataFrame:
    return get_edges(quest, "relations", cats, exclude_cats)


def get_links(quest: Quest, cats=(), exclude_cats=()) -> DataFrame:
    return get_edges(quest, "links", cats, exclude_cats)


def get_quotes(quest: Quest, cats=(), exclude_cats=()) -> DataFrame:
    return get_edges(quest, "quotes", cats, exclude_cats)


def clean_doc(quest: Quest, docname: str) -> Quest:
    """The quest without any row authored in `docname`."""
    return quest.with_tables(
        **{
            kind: quest.table(kind).where(~F.col("docname").eqNullSafe(F.lit(docname)))
            for kind in KINDS
        }
    )


def min_size(df: DataFrame, text: str = "text", size: int = 500) -> DataFrame:
    """Texts longer than `size`; shorter ones count as failed extractions."""
    return df.where(F.length(text) > size)


def stale(
    df: DataFrame, result_at: str, source_at: str, now: Column | str, ttl_seconds: int
) -> DataFrame:
    """Rows to redo: no result, a source newer than it, or a result older than the TTL."""
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    age = F.unix_timestamp(now) - F.unix_timestamp(result_at)
    return df.where(
        F.col(result_at).isNull()
        | (F.col(source_at) > F.col(result_at))
        | (age > F.lit(ttl_seconds))
    )


def site(df: DataFrame, part: str, fetched_at: str | None = None, before: str | None = None) -> DataFrame:
    """Sources whose URL contains `part`, last fetched before a cut-off."""
    df = df.where(F.col("url").contains(part))
    if fetched_at and before:
        df = df.where(F.col(fetched_at) < F.lit(before).cast("timestamp"))
    return df
