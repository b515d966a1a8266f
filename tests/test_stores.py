"""Readers and writers over real files."""

import json
import os

from pyspark.sql import functions as F

from conftest import rows
from gumshoe.operators import integrity
from gumshoe.operators.filters import Params
from gumshoe.plans.report import build_report
from gumshoe.sinks import exports
from gumshoe.sources import html, stores
from test_graph import make


def write(path, name, content):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(content if isinstance(content, str) else json.dumps(content, indent=1))


def test_texts_store_wins(spark, tmp_path):
    store, cache = str(tmp_path / "store"), str(tmp_path / "cache")
    write(store, "a.json", {"title": "A", "text": "stored"})
    write(cache, "a.json", {"title": "A", "text": "cached"})
    write(cache, "b.json", {"text": None, "yt_text": "spoken"})
    write(cache, "c.json", {"text": None})
    got = stores.read_text_docs(spark, store, cache).select("source", "origin", F.coalesce("text", F.lit("-")))
    assert rows(got) == [("a", "store", "stored"), ("b", "cache", "spoken"), ("c", "cache", "-")]
    files = integrity.list_files(spark, store, store="store").unionByName(integrity.list_files(spark, cache, store="cache"))
    wanted = spark.createDataFrame([("a.json",), ("b.json",), ("d.json",)], "name string")
    got = {r.name: r.status for r in integrity.check_files(wanted, files).collect()}
    assert got == {"a.json": "duplicate", "b.json": "ok", "c.json": "orphan", "d.json": "missing"}
    assert [r.name for r in integrity.check_bad_size(files, 20).collect()] == ["c.json"]


def test_analyses(spark, tmp_path):
    store, cache = str(tmp_path / "store"), str(tmp_path / "cache")
    write(store, "x.json", {"mood": {"sentiment_general": "Positive", "polarite": 0.2}, "words": {"commons": [["gitlab", 31], ["time", 9]]}, "ident": {"idents": [["ident.a", 2]]}})
    write(cache, "y.json", {})
    counts = stores.analysis_counts(stores.read_analyses(spark, store, cache))
    assert rows(counts) == [("x", "ident", "idents", "ident.a", 2), ("x", "words", "commons", "gitlab", 31), ("x", "words", "commons", "time", 9)]


def test_wordlists_and_urls(spark, tmp_path):
    lists = str(tmp_path / "lists")
    write(lists, "__badwords__.txt", "one, two,\ntwo\n")
    write(lists, "media__badwords.txt", "three")
    write(lists, "other.txt", "four")
    got = rows(stores.read_wordlists(spark, lists, ["media"], "__badwords__"))
    assert got == [("__badwords__", "one"), ("__badwords__", "two"), ("media__badwords", "three")]
    write(str(tmp_path), "urls.txt", "# c\nhttp://a.org/x?y=1\n\nHTTP://no\nhttp://A.org/x/\nhttps://b.org\n")
    assert rows(stores.read_url_list(spark, str(tmp_path / "urls.txt"))) == [("file-2", "http://a.org/x"), ("file-6", "https://b.org")]
    assert rows(stores.read_url_list(spark, str(tmp_path / "urls.txt"), 1)) == [("file-2", "http://a.org/x")]


def test_csv_round_trip(spark, tmp_path):
    quest = make(
        spark,
        idents=[{"name": "ident.a", "label": 'A, "b"', "cats": ["x", "y"], "orgs": ["org.o"], "country": "FR"}, {"name": "ident.b", "label": "B"}],
        orgs=[{"name": "org.o", "label": "O"}],
        relations=[{"name": "relation.ident.a__r__ident.b", "label": "r", "rfrom": "ident.a", "rto": "ident.b"}],
    )
    paths = exports.export_csv(quest, Params(name="csv.all"), str(tmp_path))
    assert len(paths) == 9
    raw = open([os.path.join(paths["idents"], f) for f in os.listdir(paths["idents"]) if f.endswith(".csv")][0]).read()
    assert raw.startswith('"name","label"')
    folder = str(tmp_path / "quest")
    os.makedirs(folder)
    for kind, path in paths.items():
        os.rename(path, os.path.join(folder, kind))
    back = stores.read_quest(spark, folder, "csv")
    assert [(r.name, r.label, r.cats, r.orgs) for r in back.idents.orderBy("name").collect()] == [
        ("ident.a", 'A, "b"', ["x", "y"], ["org.o"]), ("ident.b", "B", [], []),
    ]
    assert [(r.rfrom, r.rto) for r in back.relations.collect()] == [("ident.a", "ident.b")]
    report = build_report(back, Params())
    assert report.idents.count() == 2


def test_page_facts(spark):
    page = """<html><head><title> T &amp; t </title><script>var x = "<p>no</p>";</script>
      <meta name="description" content=" D "><style>p {}</style></head>
      <body><h1>Head</h1><p>First <b>para</b></p><p>publié le 14 août 2023</p></body></html>"""
    bare = "<p>" + "word " * 100 + "</p>"
    df = spark.createDataFrame([(1, "http://a.org/x", page), (2, "http://a.org/2024/05/06/y.html", bare), (3, "http://a.org/z", "<h1>Just a moment</h1>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.page_metadata(df, this_year=2025).collect()}
    assert (got[1].title, got[1].description, got[1].date) == ("T & t", "D", "2023-08-14")
    assert (got[2].date, got[2].bot) == ("2024-05-06", False)
    assert got[3].title == "Just a moment" and got[3].bot
    text = {r.page_id: r for r in html.extract_html(df).collect()}
    assert text[2].title == "y.html"
    assert "var x" not in text[1].text and "para" in text[1].text


def test_mentions_are_partitioned(spark, tmp_path):
    mentions = spark.createDataFrame([("idents", "ident.a", "s1"), ("cities", "city.b", "s1")], "kind string, key string, source string")
    exports.write_mentions(mentions, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m")).where("kind = 'idents'")
    assert [r.source for r in back.collect()] == ["s1"]


def test_mention_report_has_every_kind(spark, tmp_path):
    """Cities and countries belong to the inverted report as much as idents and orgs; it is written by kind."""
    from __spark_entry__ import queries

    words = "alpha beta gamma delta epsilonic zeta"
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(7, f"so {words} end"), (8, "so zeta end"), (9, "none of them")]
    docs = [(i, t, "en", "web", len(t)) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries()["sink_mentions"](spark, str(tmp_path))
    got = {(r.kind, r.key, r.source) for r in rows.collect()}
    assert got == {
        ("idents", "ident.1", "source.d7"), ("orgs", "org.1", "source.d7"), ("cities", "city.1", "source.d7"),
        ("countries", "country.1", "source.d7"), ("countries", "country.1", "source.d8"),
    }
    assert any("kind=cities" in f for f in rows.inputFiles())


def test_match_kinds_agrees_with_each_kind(spark):
    docs = spark.createDataFrame([("s1", "x red fox runs home y"), ("s2", "x fox red y")], "source string, text string")
    one = spark.createDataFrame([("red fox", "org.a"), ("fox red", "org.a"), ("one two three four five", "org.b")], "phrase string, key string")
    two = spark.createDataFrame([("red fox", "city.a"), ("runs", "city b")], "phrase string, key string")
    from gumshoe.operators import mentions

    got = sorted(tuple(r) for r in mentions.match_kinds(docs, orgs=one, cities=two).collect())
    parts = mentions.mention_table(orgs=mentions.match_phrases(docs, one), cities=mentions.match_phrases(docs, two))
    assert got == sorted(tuple(r) for r in parts.collect()) and len(got) == 4


def test_json_snapshot_is_compressed_and_cut(spark, tmp_path, monkeypatch):
    """Every field name stands in every row of JSON, so its files are compressed; no file grows with the table."""
    from gumshoe.quest import KINDS, Quest, conform

    monkeypatch.setattr(exports, "JSON_ROWS", 40)
    rows = spark.range(100).select(F.concat(F.lit("org."), F.col("id").cast("string")).alias("name"), F.lit("a").alias("label"))
    quest = Quest(**{kind: conform(rows.limit(0) if kind != "orgs" else rows.coalesce(1), kind) for kind in KINDS})
    exports.snapshot(quest, str(tmp_path / "q"), fmt="json")
    files = sorted(f.name for f in (tmp_path / "q" / "orgs").glob("part-*"))
    assert len(files) == 3 and all(f.endswith(".json.gz") for f in files)
    back = stores.read_quest(spark, str(tmp_path / "q"), "json")
    assert sorted(r.name for r in back.orgs.collect()) == sorted(r.name for r in rows.collect())
