"""Filters, expansion and graph text on small hand-made quests."""

import os

import pytest

from gumshoe.operators import expand, filters, linked
from gumshoe.operators.attributes import inherit_attrs
from gumshoe.operators.filters import Params
from gumshoe.plans.report import build_report, report_filter
from gumshoe.quest import EDGE_ENDS, KINDS, Quest, conform, edge_name
from gumshoe.session import _JOINS
from gumshoe.sinks.exports import graph_dot

STYLES = {
    "default": {"shape": "circle", "style": "solid"},
    "test1": {"shape": "hexagon", "style": "dashed"},
    "test2": {"shape": "octogon", "style": "invis"},
}


def make(spark, **tables):
    def build(kind):
        rows = tables.get(kind, [])
        schema = conform(spark.createDataFrame([], "name string, label string"), kind).schema
        data = [tuple(row.get(f.name, [] if f.name in ("cats", "orgs", "sources", "content") else None) for f in schema.fields) for row in rows]
        return spark.createDataFrame(data, schema)

    return Quest(**{k: build(k) for k in KINDS})


@pytest.fixture(scope="module")
def quest(spark):
    return make(
        spark,
        orgs=[
            {"name": "org.org1", "label": "org1", "cats": ["test1"]},
            {"name": "org.org2", "label": "org2", "cats": ["test2"]},
        ],
        idents=[
            {"name": "ident.ident1", "label": "ident1", "orgs": ["org.org1"], "cats": ["test1"]},
            {"name": "ident.ident2", "label": "ident2", "orgs": ["org.org2"]},
            {"name": "ident.ident3", "label": "ident3"},
        ],
        events=[{"name": "event.event1", "label": "event1", "cats": ["test1"]}],
        relations=[
            {"name": f"relation.ident.ident1__{n}__ident.{t}", "label": n, "rfrom": "ident.ident1", "rto": f"ident.{t}"}
            for n, t in (("rel1", "ident2"), ("rel2", "ident3"))
        ],
        links=[
            {"name": f"link.ident.{f}__{n}__event.event1", "label": n, "lfrom": f"ident.{f}", "lto": "event.event1"}
            for n, f in (("link1", "ident1"), ("link2", "ident2"))
        ],
    )


def test_filters(quest, names):
    assert names(filters.get_idents(quest, orgs=["org1"])) == ["ident.ident1"]
    assert names(filters.get_idents(quest, cats=["test1"])) == ["ident.ident1"]
    assert names(filters.get_idents(quest, cats=["test2"])) == ["ident.ident2"]
    assert names(filters.get_events(quest, cats=["test1"])) == ["event.event1"]
    assert len(names(filters.get_relations(quest))) == 2
    assert len(names(filters.get_relations(quest, cats=["test1"]))) == 2
    assert names(filters.get_relations(quest, cats=["test2"])) == ["relation.ident.ident1__rel1__ident.ident2"]
    assert names(filters.filter_cats(inherit_attrs(quest).idents, ["test1"], null_ok=True)) == ["ident.ident1", "ident.ident3"]


def test_ident_arguments_take_effect_on_request(quest, names):
    assert len(names(filters.get_idents(quest, idents=["ident1"]))) == 3
    assert names(filters.get_idents(quest, idents=["ident1"], honour_idents=True)) == ["ident.ident1"]


def test_expansion(quest, names):
    start = filters.get_idents(quest, orgs=["org1"])
    reached, relations = expand.ident_relations(quest, start)
    assert names(reached) == ["ident.ident1", "ident.ident2", "ident.ident3"]
    assert len(names(relations)) == 2
    inside, none = expand.ident_relations(quest, start, borders=False)
    assert names(inside) == ["ident.ident1"] and names(none) == []
    idents, events, links = expand.ident_events(quest, start, quest.events.limit(0))
    assert names(events) == ["event.event1"]
    assert names(links) == ["link.ident.ident1__link1__event.event1"]
    assert names(idents) == ["ident.ident1"]


def test_report(quest, names):
    report = report_filter(quest, Params(orgs=["org1"], borders=False))
    assert names(report.idents) == ["ident.ident1"]
    assert names(report.relations) == []
    grown = build_report(quest, Params(orgs=["org.org1"], borders=False), neighbours=True)
    assert names(grown.idents) == ["ident.ident1", "ident.ident2", "ident.ident3"]
    assert len(names(grown.relations)) == 2


def test_default_country(quest, names):
    placed = quest.with_tables()
    placed.default_country = "FR"
    assert len(names(filters.get_idents(placed, countries=["FR"]))) == 3


def test_dot(quest):
    lines = [r.line for r in graph_dot(quest, Params(name="graph.graph1"), STYLES).collect()]
    assert lines == [
        "digraph graph_graph1 {",
        'subgraph cluster_org_org1 {style="dashed";',
        'ident_ident1 [shape="hexagon", label="ident1", style="dashed"];',
        "}",
        'subgraph cluster_org_org2 {style="invis";',
        'ident_ident2 [shape="octogon", label="ident2", style="invis"];',
        "}",
        'event_event1 [shape="hexagon", label="event1", style="dashed"];',
        'ident_ident3 [shape="circle", label="ident3", style="solid"];',
        'ident_ident1 -> ident_ident2 [label="rel1"];',
        'ident_ident1 -> ident_ident3 [label="rel2"];',
        'ident_ident1 -> event_event1 [label="link1"];',
        'ident_ident2 -> event_event1 [label="link2"];',
        "}",
    ]


def test_dot_types(quest):
    lines = [r.line for r in graph_dot(quest, Params(name="graph.g", types=["events"]), STYLES).collect()]
    assert not any("ident_ident3" in x for x in lines)
    assert any("event_event1 [" in x for x in lines)


def test_edge_name(spark):
    row = spark.range(1).selectExpr("'ident.a' a", "'knows' l", "'ident.b' b")
    assert row.select(edge_name("relation", "a", "l", "b")).first()[0] == "relation.ident.a__knows__ident.b"


def test_report_reads_each_table_once(spark, quest):
    """The reported rows of a table are written once and read from there; results as from the tables themselves."""
    from gumshoe.operators import linked

    report = build_report(quest, Params(cats=("test1",)))
    inside = report.rows()
    cut = linked.reported_tables(quest, inside)
    for kind in KINDS:
        assert cut.table(kind) is cut.table(kind) and (cut.table(kind).inputFiles() or not cut.table(kind).count())
        assert sorted(r.name for r in cut.table(kind).collect()) == sorted(r.name for r in report.of(quest, kind).collect())
    key = lambda rows: sorted(map(str, rows.collect()))
    assert key(linked.report_rows(quest, report, cut)) == key(linked.report_rows(quest, report))


def _tangled(spark, seed=5):
    """Names that come twice, ends that no table has, own and inherited categories."""
    import random

    draw = random.Random(seed)
    cats = lambda: draw.sample(["test1", "test2", "test3"], draw.randint(0, 2))
    orgs = [{"name": f"org.{i}", "label": "o", "cats": cats(), "sources": [f"source.{i}"]} for i in range(5)]
    idents = [{"name": f"ident.{i % 14}", "label": "i", "cats": cats(), "orgs": draw.sample([f"org.{k}" for k in range(7)], draw.randint(0, 2)), "sources": [f"source.{i % 9}"]} for i in range(16)]
    events = [{"name": f"event.{i}", "label": "e", "cats": cats(), "orgs": [f"org.{i % 6}"] * (i % 2), "sources": [f"source.{i % 4}"]} for i in range(12)]

    def edges(prefix, a, b, start, stop):
        out = []
        for i in range(40):
            x, y = f"{start}.{draw.randint(0, 16)}", f"{stop}.{draw.randint(0, 13)}"
            out.append({"name": f"{prefix}.{i % 37}", "label": "l", a: x, b: y, "cats": cats() if i % 3 == 0 else [], "sources": [f"source.{i % 8}"] * (i % 2)})
        return out

    return make(
        spark, orgs=orgs, idents=idents, events=events,
        relations=edges("relation", "rfrom", "rto", "ident", "ident"), links=edges("link", "lfrom", "lto", "ident", "event"),
        quotes=edges("quote", "qfrom", "qto", "event", "event"),
        sources=[{"name": f"source.{i}", "label": "s"} for i in range(7)],
    )


@pytest.mark.parametrize("borders", [True, False])
def test_kept_edges_look_each_end_up_once(spark, borders):
    """The edges of `touching` over `get_edges`, with one join for each end instead of two."""
    quest = _tangled(spark)
    for kind, starts, stops in (("relations", "idents", "idents"), ("links", "idents", "events"), ("quotes", "events", "events")):
        a, b = EDGE_ENDS[kind][:2]
        starts, stops = (filters.filter_cats(quest.table(k), ["test1"]).select("name") for k in (starts, stops))
        starts = starts.union(spark.createDataFrame([("ident.15",), ("ident.15",)], "name string"))
        for cats, exclude in ((["test1"], ()), (["test2"], ["test3"]), ((), ())):
            kept = expand.kept_edges(quest, kind, starts, stops, borders, cats, exclude)
            edges = filters.get_edges(quest, kind, cats, exclude).select("name", a, b)
            old = expand.touching(edges, a, b, starts, stops, borders)
            assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, old.collect()))
    kept = expand.kept_edges(quest, "relations", starts, starts, borders, ["test1"])
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2


def test_report_neighbours_by_one_join_for_each_kind(spark):
    """Both ends of every linked row are reported; the end that a table row is needs no look-up."""
    quest = _tangled(spark)
    for params in (Params(cats=("test1",)), Params(cats=("test2",), borders=False)):
        report = build_report(quest, params)
        inside = {tuple(r) for r in report.rows().select("kind", "name").collect()}
        side = lambda kind: kind.removesuffix("_from").removesuffix("_to")
        near = [r for r in linked.linked_rows(quest).select("kind", "name", "linked_kind", "linked").collect()]
        near = sorted(tuple(r) for r in near if (r.kind, r.name) in inside and (side(r.linked_kind), r.linked) in inside)
        got = linked.report_neighbours(quest, report)
        assert near and sorted(tuple(r) for r in got.select("kind", "name", "linked_kind", "linked").collect()) == near
        counts = {}
        for kind, name, linked_kind, _ in near:
            key = (kind, name, side(linked_kind))
            counts[key] = counts.get(key, 0) + 1
        for r in linked.report_tables(quest, report).collect():
            for kind in ("idents", "events", "relations", "links", "quotes", "sources"):
                assert r["n_" + kind] == counts.get((r.kind, r.name, kind), 0)
    # One for each column that names a far end; the citations of a kind serve both of their sides.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2 + 3 + 3 + 8


def test_graph_text_is_ordered_from_a_written_table(spark):
    """Ordering reads its input twice, so no join of large tables may stand below it."""
    lines = graph_dot(_tangled(spark), Params(cats=("test1",)), STYLES)
    assert "Join" not in lines._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count() > 20


def test_no_shuffle_files_outlive_a_written_join(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, fs in os.walk(d.getPath()) for f in fs if f.startswith("shuffle_")}

    quest, before = _tangled(spark), files()
    report = build_report(quest, Params(cats=("test1",)))
    linked.report_tables(quest, report)
    left = files() - before
    kept = {name: spark.conf.get(name) for name in _JOINS}
    assert not left and kept["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] == "false"
