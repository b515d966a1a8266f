"""The stored index: found by term, by stem, by folded spelling and by synonym, without reading texts."""

import pytest
from pyspark.sql import functions as F

from gumshoe.operators import fusion, index, search

DOCS = [
    ("d1", "Antonín Dvořák", "A composer of symphonies", "Dvorak|composer", "p1", "the ninth symphony of Dvořák was written abroad"),
    ("d2", "Łódź", "A city", None, "p1", "a city of weavers and their cities"),
    ("d3", "Москва", "Capital", "Moscow", "p2", "the city on the river, visited by dvorak"),
    ("d4", "Nothing", "", None, "p2", ""),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc string, title string, description string, altlabels string, peer string, data string")
    docs = docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})
    return index.write_index(docs, str(tmp_path_factory.mktemp("index") / "one"), by="peer")


def found(df):
    return sorted(r.doc for r in df.collect())


def test_spellings_meet(stored):
    assert found(search.search_index(stored, "Dvořák")) == found(search.search_index(stored, "dvorak")) == ["d1", "d3"]
    assert found(search.search_index(stored, "Lodz")) == ["d2"] and found(search.search_index(stored, "moskva")) == ["d3"]


def test_a_plural_finds_the_singular(stored):
    assert found(search.search_index(stored, "cities")) == ["d2"]
    assert found(search.search_index(stored, "rivers")) == []
    assert found(search.search_index(stored, "rivers", stemmed=True)) == ["d3"]


def test_stems_in_the_language_of_the_document(spark, tmp_path):
    rows = [("a", "en", "horses running"), ("b", "fr", "les chevaux courants"), ("c", "fr", "un cheval nationale"), ("d", None, "horse ran"), ("e", "de", "verschwendungen")]
    docs = spark.createDataFrame([(d, "", "", None, t, x) for d, x, t in rows], "doc string, title string, description string, altlabels string, data string, lang string")
    docs = docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})
    one = index.write_index(docs, str(tmp_path / "stems"))
    names = lambda word, language: found(search.search_index(one, word, stemmed=True, language=language))
    assert names("horse", "en") == ["a", "d"] and names("runs", "en") == ["a"]
    assert names("cheval", "fr") == ["b", "c"] and names("nationales", "fr") == ["c"]
    assert names("verschwendung", "de") == ["e"] and names("cheval", "xx") == ["b", "c"]


def test_synonyms_join(stored):
    assert found(search.search_index(stored, "moscow")) == ["d3"]
    assert found(search.search_index(stored, "composer", synonyms=True)) == ["d1", "d3"]


def test_index_equals_scan(spark, stored):
    for query in ("city of", "the dvorak symphony"):
        for op in ("or", "and"):
            one = {r.doc: round(r.score, 9) for r in search.search_index(stored, query, op).collect()}
            two = {r.doc: round(r.score, 9) for r in search.search_bm25(stored.docs(), query, op).collect()}
            assert one == two


def test_plan_is_pruned_by_term(stored):
    plan = stored.hits(["city"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [city])]" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term,city)]" in plan
    whole = search.search_index(stored, "city")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in whole and "data#" not in whole.split("Relation")[0]


def test_peers_in_their_own_words(spark, stored):
    memory = spark.createDataFrame([("ru", "capital", "москва")], "lang string, term string, translation string")
    languages = spark.createDataFrame([("p1", "en"), ("p2", "ru")], "peer string, lang string")
    assert found(fusion.peer_search(stored, "weavers", mode="fast")) == ["d2"]
    assert found(fusion.peer_search(stored, "capital", mode="deep", memory=memory, languages=languages)) == ["d3"]


def tables(stored):
    """What an index gives its readers."""
    lists = {
        "docs": stored.docs().select("doc", "title", "data"),
        "stats": stored.stats(),
        "groups": stored.group_stats(),
        "vocabulary": stored.vocabulary().select("term", "df"),
        "spelling": stored.spelling().select("variant", "term", "df"),
        "postings": stored.hits_of(stored.vocabulary().select("term")).select("doc", "term", "tf", "doc_len", "peer"),
        "places": stored.live("places").select("doc", "word", "at"),
        "stems": stored.live("stems").select("doc", "doc_len", "peer", "stem", "tf"),
    }
    return {name: sorted(map(str, df.collect())) for name, df in lists.items()}


def test_updates_equal_a_fresh_index(spark, tmp_path):
    """Three deltas of inserts, updates and deletes, with documents that come back and empty deltas."""
    import random

    from gumshoe.operators.incremental import incr_index

    rng = random.Random(8)
    schema = "doc string, title string, description string, altlabels string, peer string, data string, lang string"
    words = "river city weaver symphony cities rivers moscow the of and".split()

    def some(i):
        return (f"d{i}", rng.choice(words), "", None, f"p{i % 3}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["en", "fr", None]))

    def frame(rows):
        docs = spark.createDataFrame(rows, schema)
        return docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})

    state = {i: some(i) for i in range(40)}
    stored = index.write_index(frame(list(state.values())), str(tmp_path / "grown"), by="peer")
    for step in range(4):
        if step < 3:
            for i in rng.sample(range(60), 15):
                if i in state and rng.random() < 0.4:
                    del state[i]
                else:
                    state[i] = some(i)
        docs = frame(list(state.values()))
        prints = [rows.select("doc", F.md5(F.to_json(F.struct("title", "data", "lang"))).alias("fingerprint")) for rows in (stored.docs(), docs)]
        stored = index.update_index(stored, incr_index(*prints), docs, by="peer")
        if step % 2 == 0:
            continue
        fresh = index.write_index(docs, str(tmp_path / f"fresh{step}"), by="peer")
        assert tables(stored) == tables(fresh)
        for query in ("city river", "weaver"):
            one, two = ({r.doc: (round(r.score, 9), round(r.percent, 9)) for r in search.search_index(x, query).collect()} for x in (stored, fresh))
            assert one == two
        spelled = [{r.word: r.correction for r in search.search_spelling(x.spelling(), "rivr moskow zzzzzzz").collect()} for x in (stored, fresh)]
        assert spelled[0] == spelled[1] and spelled[0]["rivr"] == "river"
    assert stored.segments == [0, 1, 2, 3, 4]


def test_a_broken_update_does_not_count(spark, tmp_path):
    """Tables of a segment that is not listed are not read, and are written anew by the next update."""
    rows = [(f"d{i}", "city", "", None, "p", f"word{i}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc string, title string, description string, altlabels string, peer string, data string")
    docs = docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})
    path = str(tmp_path / "one")
    stored = index.write_index(docs, path, by="peer")
    index._write_segment(docs.limit(2), path, 1, False, "peer", "en")
    stored = index.SearchIndex(spark, path)
    assert stored.segments == [0] and stored.docs().count() == 6
    gone = spark.createDataFrame([("d1", "delete"), ("d9", "delete"), ("d2", "keep")], "doc string, action string")
    stored = index.update_index(stored, gone, docs, by="peer")
    assert found(stored.docs()) == ["d0", "d2", "d3", "d4", "d5"]
    assert found(search.search_index(stored, "city")) == ["d0", "d2", "d3", "d4", "d5"]
    assert found(search.search_index(stored, "word1")) == [] and stored.vocabulary().where("term = 'word1'").count() == 0


def test_snippets_from_places(spark, tmp_path):
    """Equal to a search in the texts: words inside words, accents, marks, empty words, nulls, several hits."""
    texts = ["Quelque chose que le Que", "la que. QUE", None, "", "éque Que dit-il? qu'il", "que" * 50, "x" * 200 + " Straße que " + "y" * 200, "İstanbul que", "日本語 que 本"]
    docs = spark.createDataFrame([(f"d{i}", "t", "", None, t) for i, t in enumerate(texts)], "doc string, title string, description string, altlabels string, data string")
    docs = docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})
    one = index.write_index(docs, str(tmp_path / "one"))
    page = one.docs().select("doc").union(spark.createDataFrame([("gone",)], "doc string"))
    for query in ("que", "Que le", "straße il", "dit-il que", "que  que", "本 nowhere", ""):
        for mark in ("", "<b>%s</b>"):
            want = {r.doc: r.context for r in search.snippets(page, docs, query, 8, mark).collect()}
            got = {r.doc: r.context for r in search.indexed_snippets(one, page, query, 8, mark).collect()}
            assert got == want, query


def test_words_are_counted_without_a_shuffle(spark):
    """Counts equal the grouped ones, weighted or not, and no word moves; no length, stem or place needs a join."""
    rows = [("a", "Éque que", "one two one", "x|y", "que la que " * 300), ("b", "", None, None, None), ("ü ß", None, "Ω", None, "日本 日本 İ ﬁ"), ("", "", "", "", "")]
    docs = spark.createDataFrame(rows * 1, "doc string, title string, description string, altlabels string, data string")
    for weighted in (False, True):
        got = index.counted_rows(docs, weighted)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = index.index_terms(index.fields(docs, weighted))
        columns = ["doc", "term", "tf", "doc_len"]
        assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


def test_repeated_and_missing_names(spark, tmp_path):
    """Rows of one name are one document in the counts; rows without a name are only stored."""
    rows = [("a", "p", "que la"), ("a", "q", "que"), ("b", "p", "la la"), (None, "p", "que"), (None, "p", "la")]
    docs = spark.createDataFrame([(d, "", "", None, p, x) for d, p, x in rows], "doc string, title string, description string, altlabels string, peer string, data string")
    docs = docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})
    one = index.write_index(docs, str(tmp_path / "one"), by="peer")
    assert sorted((r.doc, r.tf, r.doc_len, r.peer) for r in one.hits(["que"]).collect()) == [("a", 2, 5, "p"), ("a", 2, 5, "q")]
    assert sorted((r.doc, r.term, r.tf) for r in one.live("counts").where("term = 'la'").collect()) == [("a", "la", 1), ("b", "la", 2)]
    assert one.docs().count() == 5 and sorted((r.doc, r.doc_len) for r in one.live("lengths").collect()) == [("a", 5), ("a", 5), ("b", 3)]


def test_postings_are_stored_once(stored):
    """Stems are terms beside their stems, not postings once more."""
    import os

    assert not os.path.isdir(os.path.join(stored.path, "stems"))
    assert {r.stem for r in stored.table("stemmed").where("term = 'cities'").collect()} == {r.stem for r in stored.table("stemmed").where("term = 'city'").collect()}


def test_texts_are_gathered_once_for_a_list_of_sources(spark, monkeypatch):
    """A source cited by many entities: its text is gathered for its list, not for each of them."""
    from gumshoe.quest import KINDS, Quest, conform

    cited = F.when(F.col("id") < 90, F.array(F.lit("source.a"))).when(F.col("id") < 96, F.array(F.lit("source.b"), F.lit("source.a")))
    orgs = spark.range(100).select(F.concat(F.lit("org."), F.col("id").cast("string")).alias("name"), F.lit("l").alias("label"), cited.alias("sources"))
    orgs = orgs.union(orgs.where("name = 'org.95'"))  # a name that comes twice has the sources of both rows
    sources = spark.createDataFrame([("source.a", "a", "http://a"), ("source.b", "b", None)], "name string, label string, url string")
    quest = Quest(**{k: conform({"orgs": orgs, "sources": sources}.get(k, orgs.limit(0)), k) for k in KINDS})
    texts = spark.createDataFrame([("source.a", "one"), ("source.b", "two")], "source string, text string")
    gathered = []
    bodies = index._bodies
    monkeypatch.setattr(index, "_bodies", lambda lists, *rest: gathered.append(lists.count()) or bodies(lists, *rest))
    docs = index.build_docs(quest, texts, ("orgs",))
    assert docs.count() == 101 and gathered == [3]
    got = sorted((r.doc, r.url, r.data) for r in docs.collect() if r.doc in ("org.1", "org.94", "org.95", "org.99"))
    twice = ("org.95", "http://a", "two\ntwo\none\none")
    assert got == [("org.1", "http://a", "one"), ("org.94", "http://a", "two\none"), twice, twice, ("org.99", None, None)]
