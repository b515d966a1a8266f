"""Who is linked to whom: the bridge tables behind report rows, lists and source lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.lists import joined
from gumshoe.functions.text import sanitize_description, sanitize_label
from gumshoe.operators.filters import DATE_MIN, Params, get_idents
from gumshoe.plans.report import Report, build_report, derived
from gumshoe.quest import EDGE_ENDS, KINDS, Quest, named
from gumshoe.session import pin


def _pairs(df: DataFrame, kind: str, name, linked_kind: str, linked) -> DataFrame:
    return df.select(
        F.lit(kind).alias("kind"),
        F.col(name).alias("name") if isinstance(name, str) else name.alias("name"),
        F.lit(linked_kind).alias("linked_kind"),
        F.col(linked).alias("linked") if isinstance(linked, str) else linked.alias("linked"),
    )


def linked_rows(quest: Quest) -> DataFrame:
    """(kind, name, linked_kind, linked) for every way an object reaches another.

    Kept as rows, never as a list per object: a hub may have any number of neighbours.
    """
    q = quest
    by_org = [
        _pairs(q.table(k).select("name", F.explode("orgs").alias("org")), "orgs", "org", k, "name")
        for k in ("idents", "events")
    ]
    edges = [
        _pairs(q.relations, "idents", "rfrom", "relations_from", "name"),
        _pairs(q.relations, "idents", "rto", "relations_to", "name"),
        _pairs(q.links, "idents", "lfrom", "links", "name"),
        _pairs(q.links, "events", "lto", "links", "name"),
        _pairs(q.quotes, "events", "qfrom", "quotes_from", "name"),
        _pairs(q.quotes, "events", "qto", "quotes_to", "name"),
    ]
    cites = q.citations()
    cited = [
        cites.select(F.lit("sources").alias("kind"), F.col("source").alias("name"), F.col("kind").alias("linked_kind"), F.col("name").alias("linked")),
        cites.select("kind", "name", F.lit("sources").alias("linked_kind"), F.col("source").alias("linked")),
    ]
    return reduce(DataFrame.unionByName, [*by_org, *edges, *cited])


def report_rows(quest: Quest, report: Report, cut: Quest | None = None) -> DataFrame:
    """One display row per reported object: label, description, categories, country, dates. `cut` has the
    reported rows of each table where they are known."""
    parts = []
    for kind in ("countries", "cities", "orgs", "idents", "events", "relations", "links", "quotes", "sources"):
        rows = derived(cut.table(kind), quest, kind) if cut else report.of(quest, kind)
        span = "begin" in rows.columns
        parts.append(
            rows.select(
                F.lit(kind).alias("kind"),
                "name",
                sanitize_label(F.col("label")).alias("label"),
                sanitize_description(F.col("description"), F.col("label")).alias("description"),
                joined("cats").alias("cats"),
                "country",
                (F.col("begin") if span else F.lit(None).cast("date")).alias("begin"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def reported_tables(quest: Quest, inside: DataFrame, bridge: bool = False) -> Quest:
    """The tables cut to the reported rows (kind, name), each written once: the bridge reads them several
    times, and a table may be a join of large ones. `bridge=True` keeps only what the bridge reads."""

    def reported(kind: str) -> DataFrame:
        rows = quest.table(kind)
        if bridge:
            read = ("name", "orgs", "sources", *EDGE_ENDS.get(kind, ())[:2])
            rows = rows.select(*[c for c in rows.columns if c in read])
        return pin(rows.join(inside.where(F.col("kind") == kind).select("name"), "name", "left_semi"), joins=True)

    return quest.with_tables(**{kind: (lambda kind=kind: reported(kind)) for kind in KINDS})


def report_neighbours(quest: Quest, report: Report) -> DataFrame:
    """The linked rows of the report, both ends reported."""
    inside = pin(report.rows(), joins=True)
    rows = _neighbours(reported_tables(quest, inside, bridge=True), inside)
    return reduce(DataFrame.unionByName, rows.values()).select("linked", "kind", "name", "linked_kind")


def _neighbours(cut: Quest, inside: DataFrame) -> dict[str, DataFrame]:
    """The rows of `linked_rows` of a report, for each kind of the end that a table row names.

    Every linked row comes from some table row that is reported itself, as the tables are cut to the report; so
    one semi join settles the other end."""

    def reached(kind: str, rows: list[DataFrame]) -> DataFrame:
        names = inside.where(F.col("kind") == kind).select("name")
        return reduce(DataFrame.unionByName, rows).join(names, "name", "left_semi").withColumn("kind", F.lit(kind))

    def end(kind: str, column, linked_kind: str | None = None) -> DataFrame:
        column = F.col(column) if isinstance(column, str) else column
        return cut.table(kind).select(column.alias("name"), F.lit(linked_kind or kind).alias("linked_kind"), F.col("name").alias("linked"))

    cites = cut.citations().select(F.col("source").alias("name"), F.col("kind").alias("linked_kind"), F.col("name").alias("linked"))
    # A citation is a neighbour either way.
    there = F.struct("kind", "name", "linked_kind", "linked")
    back = F.struct(F.col("linked_kind").alias("kind"), F.col("linked").alias("name"), F.col("kind").alias("linked_kind"), F.col("name").alias("linked"))
    return {
        "orgs": reached("orgs", [end(k, F.explode("orgs")) for k in ("idents", "events")]),
        "idents": reached("idents", [end("relations", "rfrom", "relations_from"), end("relations", "rto", "relations_to"), end("links", "lfrom")]),
        "events": reached("events", [end("links", "lto"), end("quotes", "qfrom", "quotes_from"), end("quotes", "qto", "quotes_to")]),
        "sources": reached("sources", [cites]).select(F.explode(F.array(there, back)).alias("_c")).select("_c.*"),
    }


#: The kinds of linked rows that a number counts.
_NUMBERS = {
    "n_idents": ["idents"],
    "n_events": ["events"],
    "n_relations": ["relations", "relations_from", "relations_to"],
    "n_links": ["links"],
    "n_quotes": ["quotes", "quotes_from", "quotes_to"],
    "n_sources": ["sources"],
}


def report_tables(quest: Quest, report: Report) -> DataFrame:
    """Report rows with the number of neighbours per kind; the neighbours themselves are the
    rows of `report_neighbours`, since a hub's list has no bound."""
    inside = pin(report.rows(), joins=True)
    cut = reported_tables(quest, inside)
    numbers = [F.count(F.when(F.col("linked_kind").isin(*kinds), 1)).alias(n) for n, kinds in _NUMBERS.items()]
    # Counted where the semi join put the rows of a name, then the few counts of an object are summed.
    parts = [found.groupBy("kind", "name").agg(*numbers) for found in _neighbours(cut, inside).values()]
    counts = reduce(DataFrame.unionByName, parts).groupBy("kind", "name").agg(*[F.sum(n).alias(n) for n in _NUMBERS])
    return report_rows(quest, report, cut).join(counts, ["kind", "name"], "left").fillna(0, list(_NUMBERS))


def source_fetchmethod(quest: Quest) -> DataFrame:
    """(source, fetchmethod): over the events citing it, their links and the idents of those,
    the first ident that names a method, in (event, link, ident) name order."""
    cited = quest.citations("events").select("source", F.col("name").alias("event"))
    links = quest.links.select(F.col("lto").alias("event"), F.col("name").alias("link"), F.col("lfrom").alias("ident"))
    methods = quest.idents.where(F.col("fetchmethod").isNotNull()).select(
        F.col("name").alias("ident"), "fetchmethod"
    )
    found = (
        cited.join(links, "event")
        .join(methods, "ident")
        .groupBy("source")
        .agg(F.min_by("fetchmethod", F.struct("event", "link", "ident")).alias("fetchmethod"))
    )
    return quest.sources.select(F.col("name").alias("source")).join(found, "source", "left")


def list_sources(quest: Quest, params: Params) -> DataFrame:
    report = build_report(quest, params)
    return report.of(quest, "sources").select("name", "label", "url")


def list_events(quest: Quest, params: Params) -> DataFrame:
    """Events by begin, undated ones first."""
    report = build_report(quest, params)
    rows = report.of(quest, "events").withColumn(
        "sort_begin", F.coalesce("begin", F.lit(DATE_MIN).cast("date"))
    )
    return rows.select("name", "label", "begin", "sort_begin").orderBy("sort_begin", "name")


def list_idents(quest: Quest, params: Params) -> DataFrame:
    """Idents by label with country and categories; no expansion."""
    from gumshoe.operators.attributes import effective_cats, effective_country

    rows = get_idents(quest, params.orgs, params.idents, params.cats, params.countries,
                      honour_idents=params.honour_idents).select("name")
    full = quest.idents.join(rows, "name", "left_semi")
    full = effective_country(effective_cats(full, quest, "idents"), quest, inherit=True)
    return full.select("name", "label", "country", joined("cats").alias("cats")).orderBy("label", "name")


def source_referrers(quest: Quest) -> DataFrame:
    """Distinct (source, label) of the entities citing a source."""
    kinds = ("countries", "cities", "orgs", "idents", "events")
    labels = reduce(
        DataFrame.unionByName,
        [quest.table(k).select("label", F.explode("sources").alias("source")) for k in kinds],
    )
    return labels.select("source", "label").distinct()


def country_labels(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Replace country codes by labels; unknown codes stay."""
    lookup = countries.select(
        F.col("country").alias("_code"), sanitize_label(F.col("label")).alias("_label")
    )
    joined_rows = df.join(lookup, F.col("country") == F.col("_code"), "left")
    return joined_rows.withColumn("country", F.coalesce("_label", "country")).drop("_code", "_label")


def name_collision(quest: Quest) -> Quest:
    """Same bare name in two kinds: countries and cities beat idents, idents beat orgs."""
    bare = F.regexp_replace("name", r"^[a-z]+\.", "")

    def without(rows: DataFrame, *others: DataFrame) -> DataFrame:
        rows = rows.withColumn("_bare", bare)
        for other in others:
            rows = rows.join(other.select(bare.alias("_bare")), "_bare", "left_anti")
        return rows.drop("_bare")

    return quest.with_tables(
        idents=without(quest.idents, quest.countries, quest.cities),
        orgs=without(quest.orgs, quest.idents),
    )


def remaining_sources(quest: Quest, *kinds: str) -> DataFrame:
    """Sources cited by none of the indexed entity kinds."""
    kinds = kinds or ("countries", "cities", "orgs", "idents", "events")
    cited = quest.citations(*kinds).select(F.col("source").alias("name"))
    return quest.sources.join(cited, "name", "left_anti")


def union_kinds(quest: Quest, *kinds: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [named(quest.table(k), k) for k in kinds])


def distinct_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct()
