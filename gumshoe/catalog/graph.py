"""Queries over the investigation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from gumshoe.catalog.registry import query
from gumshoe.catalog.views import with_views
from gumshoe.functions.lists import joined
from gumshoe.operators import aggregates, attributes, expand, filters, linked
from gumshoe.operators.filters import Params
from gumshoe.plans import report as reports
from gumshoe.sources.tables import quest_from_tables as quest

CATS = ("building", "asia", "1-URGENT", "returned")
COUNTRIES = tuple(str(i) for i in range(0, 20))
PARAMS = Params(cats=CATS, countries=COUNTRIES, name="report.flagship")
INNER = Params(cats=CATS, countries=COUNTRIES, borders=False, exclude_cats=("returned",))
WIDE = Params(countries=COUNTRIES)

_CATS = "['building', 'asia', '1-URGENT', 'returned']"
_IN = "(" + ", ".join(f"'{c}'" for c in COUNTRIES) + ")"


def _flat(df):
    keep = [c for c in ("name", "label", "country") if c in df.columns]
    return df.select(*keep, joined("cats").alias("cats"))


_FLAT = "select name, label, country, array_to_string(cats, ',') as cats from "
_FLAT_EDGE = "select name, label, array_to_string(cats, ',') as cats from "


@query(
    "inherit_attrs",
    with_views(
        """select 'idents' as kind, name, array_to_string(cats, ',') as cats, country from idents
        union all select 'relations', name, array_to_string(cats, ','), null from relations
        union all select 'links', name, array_to_string(cats, ','), null from links
        union all select 'quotes', name, array_to_string(cats, ','), null from quotes""",
        "relations", "links", "quotes",
    ),
)
def inherit_attrs(spark, sf):
    full = attributes.inherit_attrs(quest(spark, sf))
    parts = [
        full.table(k).select(F.lit(k).alias("kind"), "name", joined("cats").alias("cats"), "country")
        for k in ("idents", "relations", "links", "quotes")
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "flt_cats",
    with_views(
        _FLAT + """idents where (list_has_any(cats, ['building', 'asia']) or len(cats) = 0)
        and not list_has_any(cats, ['furniture', 'europe'])""",
        "idents",
    ),
)
def flt_cats(spark, sf):
    full = attributes.inherit_attrs(quest(spark, sf))
    return _flat(filters.filter_cats(full.idents, ["building", "asia"], ["furniture", "europe"], null_ok=True))


@query("flt_country", with_views(_FLAT + "idents where country in ('1', '7', '19')", "idents"))
def flt_country(spark, sf):
    full = attributes.inherit_attrs(quest(spark, sf))
    return _flat(filters.filter_country(full.idents, ["1", "7", "19"]))


@query(
    "flt_dates",
    with_views(
        """select name, strftime("begin", '%Y-%m-%d') as begin_day from evts
        where "begin" >= date '1996-01-01' and "end" < date '1997-06-01'""",
        "evts",
    ),
)
def flt_dates(spark, sf):
    rows = filters.filter_dates(quest(spark, sf).events, "1996-01-01", "1997-06-01")
    return rows.select("name", F.date_format("begin", "yyyy-MM-dd").alias("begin_day"))


@query(
    "flt_orgs",
    with_views(
        "select name, array_to_string(orgs, ',') as orgs from raw_idents "
        "where list_has_any(orgs, ['org.3', 'org.8']) or len(orgs) = 0",
        "raw_idents",
    ),
)
def flt_orgs(spark, sf):
    rows = filters.filter_orgs(quest(spark, sf).idents, ["3", "org.8"], null_ok=True)
    return rows.select("name", joined("orgs").alias("orgs"))


@query("flt_idents", with_views("select name, label from raw_idents where name in ('ident.5', 'ident.77')", "raw_idents"))
def flt_idents(spark, sf):
    return filters.filter_idents(quest(spark, sf).idents, ["5", "ident.77"]).select("name", "label")


@query("get_orgs", with_views(_FLAT + f"orgs where list_has_any(cats, {_CATS}) and country in {_IN}", "orgs"))
def get_orgs(spark, sf):
    return _flat(filters.get_orgs(quest(spark, sf), cats=CATS, countries=COUNTRIES))


@query(
    "get_idents",
    with_views(
        _FLAT + f"idents where list_has_any(cats, {_CATS}) and country in {_IN} "
        "and list_has_any(orgs, ['org.1', 'org.2', 'org.3', 'org.4', 'org.5', 'org.6'])",
        "idents",
    ),
)
def get_idents(spark, sf):
    orgs = ["1", "2", "3", "4", "5", "6"]
    return _flat(filters.get_idents(quest(spark, sf), orgs=orgs, cats=CATS, countries=COUNTRIES))


@query(
    "get_events",
    with_views(_FLAT + f"evts where list_has_any(cats, {_CATS}) and country in {_IN} and not list_has_any(cats, ['5-LOW'])", "evts"),
)
def get_events(spark, sf):
    return _flat(filters.get_events(quest(spark, sf), cats=CATS, countries=COUNTRIES, exclude_cats=["5-LOW"]))


@query("get_cities", with_views(_FLAT + f"cities where list_has_any(cats, {_CATS}) and country in {_IN}", "cities"))
def get_cities(spark, sf):
    return _flat(filters.get_cities(quest(spark, sf), CATS, COUNTRIES))


@query("get_countries", with_views(f"select name, label from countries where list_has_any(cats, {_CATS})", "countries"))
def get_countries(spark, sf):
    return filters.get_countries(quest(spark, sf), CATS).select("name", "label")


def _edges(kind):
    return lambda spark, sf: _flat(filters.get_edges(quest(spark, sf), kind, CATS, ["5-LOW"])).drop("country")


for _kind in ("relations", "links", "quotes"):
    query(
        f"get_{_kind}",
        with_views(_FLAT_EDGE + f"{_kind} where list_has_any(cats, {_CATS}) and not list_has_any(cats, ['5-LOW'])", _kind),
    )(_edges(_kind))


# --- expansion ---------------------------------------------------------------------------

_START = {"start_idents": "select name from idents where list_has_any(cats, ['building']) and country in ('1', '7', '19')"}
_START_EVENTS = {"start_events": "select name from evts where list_has_any(cats, ['1-URGENT']) and country in ('1', '7', '19')"}


def _start(q):
    return filters.get_idents(q, cats=["building"], countries=["1", "7", "19"])


def _start_events(q):
    return filters.get_events(q, cats=["1-URGENT"], countries=["1", "7", "19"])


def _as_rows(**frames):
    out = None
    for kind, frame in frames.items():
        rows = frame.select(F.lit(kind).alias("kind"), "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "ident_relations",
    with_views(
        """select 'relations' as kind, name from kept
        union all (select 'idents', name from start_idents union select 'idents', rfrom from kept
                   union select 'idents', rto from kept)""",
        "relations", **_START,
        kept="select * from relations where rfrom in (from start_idents) or rto in (from start_idents)",
    ),
)
def ident_relations(spark, sf):
    q = quest(spark, sf)
    names, kept = expand.ident_relations(q, _start(q))
    return _as_rows(idents=names, relations=kept)


@query(
    "ident_relations_inside",
    with_views(
        "select name, rfrom, rto from relations where rfrom in (from start_idents) and rto in (from start_idents)",
        "relations", **_START,
    ),
)
def ident_relations_inside(spark, sf):
    q = quest(spark, sf)
    return expand.ident_relations(q, _start(q), borders=False)[1].select("name", "rfrom", "rto")


@query(
    "ident_events",
    with_views(
        """select 'links' as kind, name from kept
        union all (select 'idents', name from start_idents union select 'idents', lfrom from kept)
        union all (select 'events', name from start_events union select 'events', lto from kept)""",
        "links", **_START, **_START_EVENTS,
        kept="select * from links where lfrom in (from start_idents) or lto in (from start_events)",
    ),
)
def ident_events(spark, sf):
    q = quest(spark, sf)
    idents, events, kept = expand.ident_events(q, _start(q), _start_events(q))
    return _as_rows(idents=idents, events=events, links=kept)


@query(
    "event_quotes",
    with_views(
        """select 'quotes' as kind, name from kept
        union all (select 'events', name from start_events union select 'events', qfrom from kept
                   union select 'events', qto from kept)""",
        "quotes", **_START_EVENTS,
        kept="select * from quotes where qfrom in (from start_events) or qto in (from start_events)",
    ),
)
def event_quotes(spark, sf):
    q = quest(spark, sf)
    events, kept = expand.event_quotes(q, _start_events(q))
    return _as_rows(events=events, quotes=kept)


# --- reports -----------------------------------------------------------------------------


def report_views(params: Params, complete: bool = True, neighbours: bool = False, group: bool = False) -> dict[str, str]:
    """The report semantics as SQL views f_<kind> (filtered) and r_<kind> (final)."""
    cats = "[" + ", ".join(f"'{c}'" for c in params.cats) + "]"
    has = f"list_has_any(cats, {cats})" if params.cats else "true"
    drop = "[" + ", ".join(f"'{c}'" for c in params.exclude_cats) + "]"
    keep = f"{has} and not list_has_any(cats, {drop})" if params.exclude_cats else has
    place = "country in (" + ", ".join(f"'{c}'" for c in params.countries) + ")" if params.countries else "true"
    op = "or" if params.borders else "and"
    v = {
        "i0": f"select name from idents where {keep} and {place}",
        "e0": f"select name from evts where {keep} and {place}",
        "f_countries": f"select name from countries where {has}",
        "f_cities": f"select name from cities where {keep} and {place}",
        "f_orgs": f"select name from orgs where {keep} and {place}",
        "k_relations": f"select * from relations where {has} and (rfrom in (from i0) {op} rto in (from i0))",
        "k_links": f"select * from links where {has} and (lfrom in (from i0) {op} lto in (from e0))",
    }
    if params.borders:
        v["f_idents"] = ("select name from i0 union select rfrom from k_relations union select rto from k_relations "
                         "union select lfrom from k_links")
        v["e1"] = "select name from e0 union select lto from k_links"
    else:
        v["f_idents"] = "select name from i0"
        v["e1"] = "select name from e0"
    v["k_quotes"] = f"select * from quotes where {has} and (qfrom in (from e1) {op} qto in (from e1))"
    v["f_events"] = (
        "select name from e1 union select qfrom from k_quotes union select qto from k_quotes"
        if params.borders else "select name from e1"
    )
    for kind in ("relations", "links", "quotes"):
        v[f"f_{kind}"] = f"select name from k_{kind}"
    v["f_sources"] = " union ".join(
        f"select c.source as name from citations c where c.kind = '{k}' and c.name in (from f_{k})"
        for k in ("orgs", "idents", "relations", "links", "quotes", "countries")
    )
    final = {k: f"select name from f_{k}" for k in ("countries", "cities", "orgs", "relations", "links", "quotes", "sources", "idents", "events")}
    if complete:
        if neighbours:
            final["relations"] = ("select name from f_relations union select name from relations "
                                  "where rfrom in (from f_idents) or rto in (from f_idents)")
        final["idents"] = ("select name from f_idents union select rfrom from relations where name in (from r_relations) "
                           "union select rto from relations where name in (from r_relations) "
                           "union select lfrom from links where name in (from f_links)")
        final["events"] = ("select name from f_events union select lto from links where name in (from f_links) "
                           "union select qfrom from quotes where name in (from f_quotes) "
                           "union select qto from quotes where name in (from f_quotes)")
    if group:
        final["lonely_idents"] = "select name from idents where name in (from r_idents) and len(orgs) = 0"
        final["lonely_events"] = "select name from evts where name in (from r_events) and len(orgs) = 0"
        for k in ("orgs",):
            final.pop(k)
    for kind, sql in final.items():
        v[f"r_{kind}"] = sql
    if group:
        v["r_orgs"] = ("select name from f_orgs union select orgs[1] from idents where name in (from r_idents) and len(orgs) > 0 "
                       "union select orgs[1] from evts where name in (from r_events) and len(orgs) > 0")
    return v


REPORT_NEEDS = ("idents", "evts", "countries", "cities", "orgs", "relations", "links", "quotes", "citations")
_ALL_KINDS = ("countries", "cities", "orgs", "idents", "events", "relations", "links", "quotes", "sources")


def report_sql(body: str, params: Params, needs: tuple[str, ...] = (), **options) -> str:
    return with_views(body, *REPORT_NEEDS, *needs, **report_views(params, **options))


def _rows_sql(*kinds: str) -> str:
    return " union all ".join(f"select '{k}' as kind, name from r_{k}" for k in kinds)


@query("report_filter", report_sql(_rows_sql(*_ALL_KINDS), PARAMS, complete=False))
def report_filter(spark, sf):
    return reports.report_filter(quest(spark, sf), PARAMS).rows()


@query("report_filter_inside", report_sql(_rows_sql(*_ALL_KINDS), INNER, complete=False))
def report_filter_inside(spark, sf):
    return reports.report_filter(quest(spark, sf), INNER).rows()


@query("report_complete", report_sql(_rows_sql(*_ALL_KINDS), PARAMS))
def report_complete(spark, sf):
    return reports.build_report(quest(spark, sf), PARAMS).rows()


@query("report_complete_neighbours", report_sql(_rows_sql(*_ALL_KINDS), INNER, neighbours=True))
def report_complete_neighbours(spark, sf):
    return reports.build_report(quest(spark, sf), INNER, neighbours=True).rows()


@query("group_orgs", report_sql(_rows_sql("orgs", "idents", "events", "lonely_idents", "lonely_events"), PARAMS, group=True))
def group_orgs(spark, sf):
    q = quest(spark, sf)
    grouped = reports.group_orgs(q, reports.build_report(q, PARAMS))
    return grouped.rows("orgs", "idents", "events", "lonely_idents", "lonely_events")


@query(
    "get_sources",
    with_views(
        "select distinct source as name from citations where kind <> 'events'", "citations"
    ),
)
def get_sources(spark, sf):
    q = quest(spark, sf)
    return reports.get_sources(q, q.orgs, q.idents, q.relations, q.links, q.quotes, q.countries)


_LINKED_SQL = """select 'orgs' as kind, unnest(orgs) as name, 'idents' as linked_kind, name as linked from raw_idents
    union all select 'orgs', unnest(orgs), 'events', name from evts
    union all select 'idents', rfrom, 'relations_from', name from raw_relations
    union all select 'idents', rto, 'relations_to', name from raw_relations
    union all select 'idents', lfrom, 'links', name from raw_links
    union all select 'events', lto, 'links', name from raw_links
    union all select 'events', qfrom, 'quotes_from', name from raw_quotes
    union all select 'events', qto, 'quotes_to', name from raw_quotes
    union all select 'sources', source, kind, name from citations
    union all select kind, name, 'sources', source from citations"""
_LINKED_NEEDS = ("raw_idents", "evts", "raw_relations", "raw_links", "raw_quotes", "citations")


@query("linked_rows", with_views(_LINKED_SQL, *_LINKED_NEEDS))
def linked_rows(spark, sf):
    return linked.linked_rows(quest(spark, sf))


_INSIDE = {
    "inside": _rows_sql(*_ALL_KINDS),
    "linked": _LINKED_SQL,
    "near": """select l.* from linked l join inside i on i.kind = l.kind and i.name = l.name
        join inside j on j.kind = regexp_replace(l.linked_kind, '_(from|to)$', '') and j.name = l.linked""",
}


def _near_sql(body: str, params: Params, needs: tuple[str, ...] = ()) -> str:
    return with_views(body, *REPORT_NEEDS, *_LINKED_NEEDS, *needs, **report_views(params), **_INSIDE)


@query("report_neighbours", _near_sql("select * from near", PARAMS))
def report_neighbours(spark, sf):
    q = quest(spark, sf, stored=True)
    return linked.report_neighbours(q, reports.build_report(q, PARAMS))


def _shown(table: str, kind: str, description: str = "null", country: str = "null", begin: str = "null") -> str:
    return (
        f"select '{kind}' as kind, name, replace(label, '\\n', ' ') as label, "
        f"replace(coalesce({description}, label), '\\n', ' ') as description, "
        f"array_to_string(cats, ',') as cats, {country} as country, {begin} as begin_day "
        f"from {table} where name in (from r_{kind})"
    )


_SHOWN = " union all ".join(
    [
        _shown("countries", "countries", country="country"),
        _shown("cities", "cities", country="country"),
        _shown("orgs", "orgs", country="country"),
        _shown("idents", "idents", "description", "country"),
        _shown("evts", "events", country="country", begin="strftime(\"begin\", '%Y-%m-%d')"),
        _shown("relations", "relations"),
        _shown("links", "links", begin="strftime(\"begin\", '%Y-%m-%d')"),
        _shown("quotes", "quotes"),
        _shown("sources", "sources"),
    ]
)


@query(
    "report_tables",
    _near_sql(
        f"""select s.*, coalesce(n_idents, 0) as n_idents, coalesce(n_events, 0) as n_events,
        coalesce(n_relations, 0) as n_relations, coalesce(n_links, 0) as n_links,
        coalesce(n_quotes, 0) as n_quotes, coalesce(n_sources, 0) as n_sources
        from ({_SHOWN}) s left join (
            select kind, name, count(*) filter (linked_kind = 'idents') as n_idents,
            count(*) filter (linked_kind = 'events') as n_events,
            count(*) filter (linked_kind like 'relations%') as n_relations,
            count(*) filter (linked_kind = 'links') as n_links,
            count(*) filter (linked_kind like 'quotes%') as n_quotes,
            count(*) filter (linked_kind = 'sources') as n_sources
            from near group by 1, 2) c on c.kind = s.kind and c.name = s.name""",
        PARAMS, ("sources",),
    ),
)
def report_tables(spark, sf):
    q = quest(spark, sf, stored=True)
    rows = linked.report_tables(q, reports.build_report(q, PARAMS))
    return rows.withColumn("begin_day", F.date_format("begin", "yyyy-MM-dd")).drop("begin")


@query(
    "source_fetchmethod",
    with_views(
        """select s.name as source, f.fetchmethod from sources s left join (
        select c.source, arg_min(i.fetchmethod, (c.name, l.name, i.name)) as fetchmethod
        from citations c join raw_links l on l.lto = c.name join raw_idents i on i.name = l.lfrom
        where c.kind = 'events' and i.fetchmethod is not null group by 1) f on f.source = s.name""",
        "sources", "citations", "raw_links", "raw_idents",
    ),
)
def source_fetchmethod(spark, sf):
    return linked.source_fetchmethod(quest(spark, sf))


@query("list_sources", report_sql("select name, label, url from sources where name in (from r_sources)", PARAMS, ("sources",)))
def list_sources(spark, sf):
    return linked.list_sources(quest(spark, sf), PARAMS)


@query(
    "list_events",
    report_sql(
        """select name, label, strftime("begin", '%Y-%m-%d') as begin_day,
        strftime(coalesce("begin", date '1800-01-01'), '%Y-%m-%d') as sort_day
        from evts where name in (from r_events)""",
        PARAMS,
    ),
)
def list_events(spark, sf):
    rows = linked.list_events(quest(spark, sf), PARAMS)
    return rows.select(
        "name", "label", F.date_format("begin", "yyyy-MM-dd").alias("begin_day"),
        F.date_format("sort_begin", "yyyy-MM-dd").alias("sort_day"),
    )


@query("list_idents", with_views(_FLAT + f"idents where list_has_any(cats, {_CATS}) and country in {_IN}", "idents"))
def list_idents(spark, sf):
    return linked.list_idents(quest(spark, sf), PARAMS)


@query(
    "source_referrers",
    with_views(
        """select distinct c.source, e.label from citations c join (
        select name, label from countries union all select name, label from orgs
        union all select name, label from raw_idents union all select name, label from evts) e
        on e.name = c.name where c.kind in ('countries', 'orgs', 'idents', 'events')""",
        "citations",
    ),
)
def source_referrers(spark, sf):
    return linked.source_referrers(quest(spark, sf))


@query(
    "country_labels",
    with_views(
        "select e.name, coalesce(c.label, e.country) as country from evts e left join countries c on c.country = e.country",
        "evts", "countries",
    ),
)
def country_labels(spark, sf):
    q = quest(spark, sf)
    return linked.country_labels(q.events, q.countries).select("name", "country")


@query(
    "name_collision",
    with_views(
        """, i as (select name from raw_idents where split_part(name, '.', 2) not in
            (select split_part(name, '.', 2) from countries))
        select 'idents' as kind, name from i
        union all select 'orgs', name from orgs where split_part(name, '.', 2) not in
            (select split_part(name, '.', 2) from raw_idents)""",
        "raw_idents", "orgs", "countries",
    ),
)
def name_collision(spark, sf):
    q = linked.name_collision(quest(spark, sf))
    return linked.union_kinds(q, "idents", "orgs")


@query(
    "remaining_sources",
    with_views(
        """select name, url from sources where name not in (
        select source from citations where kind in ('countries', 'orgs', 'idents', 'events'))""",
        "sources", "citations",
    ),
)
def remaining_sources(spark, sf):
    return linked.remaining_sources(quest(spark, sf)).select("name", "url")


@query(
    "union_kinds",
    with_views(
        "select 'orgs' as kind, name from orgs union all select 'idents', name from raw_idents union all select 'events', name from evts",
        "orgs", "raw_idents", "evts",
    ),
)
def union_kinds(spark, sf):
    return linked.union_kinds(quest(spark, sf), "orgs", "idents", "events")


@query("distinct_names", with_views("select distinct lto as name from raw_links", "raw_links"))
def distinct_names(spark, sf):
    return linked.distinct_names(quest(spark, sf).links.select(F.col("lto").alias("name")))


@query(
    "clean_doc",
    with_views(
        """select 'idents' as kind, name from raw_idents where docname <> 'building'
        union all select 'orgs', name from orgs union all select 'events', name from evts""",
        "raw_idents", "orgs", "evts",
    ),
)
def clean_doc(spark, sf):
    return linked.union_kinds(filters.clean_doc(quest(spark, sf), "building"), "idents", "orgs", "events")


@query(
    "entity_url",
    with_views(
        """select e.kind, e.name, s.url from (
        select 'orgs' as kind, name, sources[1] as source from orgs
        union all select 'links', name, sources[1] from raw_links) e left join sources s on s.name = e.source""",
        "orgs", "raw_links", "sources",
    ),
)
def entity_url(spark, sf):
    return attributes.entity_urls(quest(spark, sf), "orgs", "links")


# A category style map of a small site.
STYLES = {
    "default": {"shape": "circle", "style": "solid"},
    "building": {"shape": "octogon", "style": "invis", "color": "red"},
    "asia": {"shape": "hexagon", "style": "dashed", "fillcolor": "yellow"},
}


@query(
    "fn_style",
    with_views(
        """select name, case cats[1] when 'building' then 'octogon' when 'asia' then 'hexagon' else 'circle' end as shape,
        case cats[1] when 'building' then 'invis' when 'asia' then 'dashed' else 'solid' end as style,
        case cats[1] when 'building' then 'red' end as color,
        case cats[1] when 'asia' then 'yellow' end as fillcolor from idents""",
        "idents",
    ),
)
def fn_style(spark, sf):
    full = attributes.inherit_attrs(quest(spark, sf))
    return attributes.with_style(full.idents, STYLES).select("name", "shape", "style", "color", "fillcolor")


# --- aggregates --------------------------------------------------------------------------


@query(
    "cats_by_kind",
    with_views(
        " union all ".join(
            f"select distinct '{k}' as kind, unnest(cats) as cat from {t}"
            for k, t in (("countries", "countries"), ("cities", "cities"), ("orgs", "orgs"), ("idents", "idents"), ("events", "evts"))
        ),
        "countries", "cities", "idents", "evts",
    ),
)
def cats_by_kind(spark, sf):
    return aggregates.cats_by_kind(attributes.inherit_attrs(quest(spark, sf)))


@query(
    "objects_by_cat",
    with_views(
        " union all ".join(
            f"select '{k}' as kind, name from {t} where list_contains(cats, 'asia')"
            for k, t in (("countries", "countries"), ("cities", "cities"), ("orgs", "orgs"), ("idents", "idents"), ("events", "evts"))
        ),
        "countries", "cities", "idents", "evts",
    ),
)
def objects_by_cat(spark, sf):
    return aggregates.objects_by_cat(attributes.inherit_attrs(quest(spark, sf)), "asia")


@query("idents_by_cat", with_views("select unnest(cats) as cat, label, name from idents", "idents"))
def idents_by_cat(spark, sf):
    return aggregates.idents_by_cat(attributes.inherit_attrs(quest(spark, sf)))


@query(
    "count_by_country",
    with_views(f"select country, count(*) as value from idents where list_has_any(cats, {_CATS}) group by 1", "idents"),
)
def count_by_country(spark, sf):
    return aggregates.count_by_country(quest(spark, sf), Params(cats=CATS))


_INDEX = " union all ".join(
    f"select lower(left(label, 1)) as initial, replace(label, '\\n', ' ') as label, '{k}' as kind, name, docname from {t}"
    for k, t in (("countries", "countries"), ("cities", "cities"), ("orgs", "orgs"), ("idents", "raw_idents"), ("events", "evts"))
)


@query("letter_index", with_views(_INDEX, "countries", "cities", "orgs", "raw_idents", "evts"))
def letter_index(spark, sf):
    return aggregates.letter_index(quest(spark, sf), ["countries", "cities", "orgs", "idents", "events"])


@query(
    "letter_index_counts",
    with_views(f"select initial, count(*) as n from ({_INDEX}) group by 1", "countries", "cities", "orgs", "raw_idents", "evts"),
)
def letter_index_counts(spark, sf):
    return aggregates.letter_counts(
        aggregates.letter_index(quest(spark, sf), ["countries", "cities", "orgs", "idents", "events"])
    )
