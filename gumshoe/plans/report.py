"""The report: filter every kind, expand one hop, complete the edges, group by organisation."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.operators.attributes import effective_cats, effective_country
from gumshoe.operators.expand import kept_edges, touching
from gumshoe.operators.filters import (
    Params,
    filter_dates,
    get_cities,
    get_countries,
    get_events,
    get_idents,
    get_orgs,
)
from gumshoe.quest import KINDS, Quest, first_org
from gumshoe.session import pin


@dataclass(frozen=True)
class Report:
    """Name tables of the nine kinds; edges also carry their two ends, so that completing a
    report needs no further look at the edge tables. `lonely_*` are filled by `group_orgs`."""

    countries: DataFrame
    cities: DataFrame
    orgs: DataFrame
    idents: DataFrame
    events: DataFrame
    relations: DataFrame
    links: DataFrame
    quotes: DataFrame
    sources: DataFrame
    lonely_idents: DataFrame | None = None
    lonely_events: DataFrame | None = None

    def rows(self, *kinds: str) -> DataFrame:
        """All kinds as one (kind, name) table."""
        parts = [
            getattr(self, kind).select(F.lit(kind).alias("kind"), "name") for kind in kinds or KINDS
        ]
        return reduce(DataFrame.unionByName, parts)

    def of(self, quest: Quest, kind: str) -> DataFrame:
        """Full rows of a kind, attributes derived."""
        return derived(quest.table(kind).join(getattr(self, kind), "name", "left_semi"), quest, kind)


def derived(rows: DataFrame, quest: Quest, kind: str) -> DataFrame:
    """Rows of a kind with the attributes they take from others."""
    return effective_country(effective_cats(rows, quest, kind), quest, inherit=kind == "idents")


def get_sources(
    quest: Quest,
    orgs: DataFrame,
    idents: DataFrame,
    relations: DataFrame,
    links: DataFrame,
    quotes: DataFrame,
    countries: DataFrame,
    events: DataFrame | None = None,
) -> DataFrame:
    """Distinct sources cited by the given names. Events' own sources count on request only."""
    sets = {
        "orgs": orgs,
        "idents": idents,
        "relations": relations,
        "links": links,
        "quotes": quotes,
        "countries": countries,
    }
    if events is not None:
        sets["events"] = events
    cited = [
        quest.citations(kind).join(names.select("name"), "name", "left_semi").select("source")
        for kind, names in sets.items()
    ]
    return reduce(DataFrame.union, cited).distinct().withColumnRenamed("source", "name")


def report_filter(quest: Quest, params: Params) -> Report:
    """Filter every kind, then expand over relations, links and quotes, then gather sources.

    Kept edges and the expanded name sets feed several later steps each, so they are written
    once (`pin`); everything else stays lazy.
    """
    p = params
    edge_exclude = p.exclude_cats if p.honour_exclude_on_edges else ()
    countries = get_countries(quest, p.cats)
    cities = get_cities(quest, p.cats, p.countries, p.exclude_cats)
    orgs = get_orgs(quest, p.orgs, p.cats, p.countries, p.exclude_cats)
    idents = get_idents(
        quest, p.orgs, p.idents, p.cats, p.countries, p.exclude_cats, p.honour_idents
    ).select("name")
    events = get_events(quest, p.orgs, p.cats, p.countries, p.exclude_cats)
    if p.honour_dates:
        events = filter_dates(events, p.begin, p.end)
    events = events.select("name")

    def kept(kind: str, starts: DataFrame, stops: DataFrame) -> DataFrame:
        return pin(kept_edges(quest, kind, starts, stops, p.borders, p.cats, edge_exclude), joins=True)

    relations = kept("relations", idents, idents)
    links = kept("links", idents, events)
    if p.borders:
        grown = [relations.select("rfrom"), relations.select("rto"), links.select("lfrom")]
        idents = pin(reduce(DataFrame.union, grown, idents).distinct(), joins=True)
        events = events.union(links.select("lto")).distinct()
    quotes = kept("quotes", events, events)
    if p.borders:
        grown = [quotes.select("qfrom"), quotes.select("qto")]
        events = pin(reduce(DataFrame.union, grown, events).distinct(), joins=True)
    sources = get_sources(
        quest, orgs, idents, relations, links, quotes, countries,
        events if p.honour_event_sources else None,
    )
    return Report(
        countries.select("name"), cities.select("name"), orgs.select("name"), idents, events,
        relations, links, quotes, sources,
    )


def report_complete(quest: Quest, report: Report, neighbours: bool = False) -> Report:
    """Add the missing ends of every edge of the report, one pass.

    `neighbours=True` first adds all relations touching the report's idents, with their other
    ends; by default only edges already in the report are completed.
    """
    relations = report.relations
    if neighbours:
        edges = quest.relations.select("name", "rfrom", "rto")
        more = touching(edges, "rfrom", "rto", report.idents, report.idents, True)
        relations = pin(relations.union(more).distinct(), joins=True)
    idents = [relations.select("rfrom"), relations.select("rto"), report.links.select("lfrom")]
    events = [report.links.select("lto"), report.quotes.select("qfrom"), report.quotes.select("qto")]
    return replace(
        report,
        relations=relations,
        idents=pin(reduce(DataFrame.union, idents, report.idents).distinct(), joins=True),
        events=pin(reduce(DataFrame.union, events, report.events).distinct(), joins=True),
    )


def group_orgs(quest: Quest, report: Report) -> Report:
    """Bring in the first organisation of every ident and event; those without one are lonely."""
    idents = quest.idents.join(report.idents, "name", "left_semi")
    events = quest.events.join(report.events, "name", "left_semi")
    firsts = [rows.select(first_org().alias("name")).where("name is not null") for rows in (idents, events)]
    return replace(
        report,
        orgs=report.orgs.union(firsts[0]).union(firsts[1]).distinct(),
        lonely_idents=idents.where(F.size("orgs") == 0).select("name"),
        lonely_events=events.where(F.size("orgs") == 0).select("name"),
    )


def build_report(quest: Quest, params: Params, neighbours: bool = False) -> Report:
    return report_complete(quest, report_filter(quest, params), neighbours)
