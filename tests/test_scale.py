"""Results stay exact when one key holds most of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from gumshoe.functions import similarity
from gumshoe.operators import fusion, incremental, mentions, ranking, search, words
from gumshoe.operators.social import ratio_history, story_tree, thread_rows, thread_text


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    return spark.range(0, 3000, 1, 6).select("id", key.alias("k"), (F.col("id") * 37 % 101).alias("v"))


def test_ranked_equals_window(skewed):
    order = [F.desc("v"), F.asc("id")]
    got = ranking.ranked(skewed, order, ["k"])
    want = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    assert rows(got) == rows(want)
    got = ranking.ranked(skewed, order)
    want = skewed.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    assert rows(got) == rows(want)


def test_carry_forward_equals_window(skewed):
    sparse = skewed.withColumn("a", F.when(F.col("id") % 5 == 0, F.col("v"))).withColumn("b", F.when(F.col("id") % 301 == 7, F.col("v")))
    got = ranking.carry_forward(sparse, ["k"], ["id"], ["a", "b"], F.floor(F.col("id") / 100))
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = sparse.select("id", "k", "v", F.last("a", True).over(w).alias("a"), F.last("b", True).over(w).alias("b"))
    assert rows(got.select(want.columns).fillna(-1)) == rows(want.fillna(-1))


def test_first_by_key_equals_window(skewed):
    got = ranking.first_by_key(skewed, ["k"], ["v", "id"])
    w = Window.partitionBy("k").orderBy("v", "id")
    want = skewed.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    assert rows(got.select("id", "k", "v")) == rows(want.select("id", "k", "v"))


def test_profile_diff_equals_lag(skewed):
    snaps = skewed.select(
        F.col("k").alias("did"), F.timestamp_seconds(F.col("id") * 3600).alias("taken_at"), (F.col("v") % 3).cast("string").alias("handle"),
        (F.col("v") % 5).alias("followers_count"),
    )
    got = incremental.profile_diff(snaps).select("did", "taken_at", F.col("changes")["handle"].alias("h"), F.col("changes")["followers_count"].alias("f"))
    w = Window.partitionBy("did").orderBy("taken_at")
    lagged = snaps.withColumn("h0", F.lag("handle").over(w)).withColumn("f0", F.lag("followers_count").over(w)).where("h0 is not null")
    want = lagged.where("h0 <> handle or f0 <> followers_count").select(
        "did", "taken_at", F.when(F.col("h0") != F.col("handle"), F.col("h0")).alias("h"),
        F.when(F.col("f0") != F.col("followers_count"), F.col("f0").cast("string")).alias("f"),
    )
    assert rows(got.fillna("-")) == rows(want.fillna("-"))


def test_substring_match(spark):
    docs = spark.createDataFrame([("s1", "The Irish and Iran, irritable"), ("s2", "nothing"), ("s3", "Uk"), ("s4", "")], "source string, text string")
    words = spark.createDataFrame([("iran", "c.iran"), ("ir", "c.ir"), ("uk", "c.uk"), ("ish and", "c.x"), ("zz", "c.z"), ("", "c.empty")], "phrase string, key string")
    assert rows(mentions.match_substrings(docs, words)) == [("s1", "c.ir", 1), ("s1", "c.iran", 1), ("s1", "c.x", 1), ("s3", "c.uk", 1)]


def test_long_labels_match_as_written(spark):
    docs = spark.createDataFrame(
        [("s1", "the United Nations High Commissioner for Refugees spoke"), ("s2", "a United Nations High Commissioner for Nothing spoke"), ("s3", "x nations united y")],
        "source string, text string",
    )
    entities = spark.createDataFrame(
        [("org.u", "United Nations High Commissioner for Refugees", ["United Nations"]), ("org.e", "", [""]), ("org.n", None, None)],
        "name string, label string, altlabels array<string>",
    )
    got = rows(mentions.match_phrases(docs, mentions.phrase_dict(entities), occurrences=True))
    assert got == [("s1", "org.u", 2, 2), ("s2", "org.u", 1, 1), ("s3", "org.u", 1, 1)]


def test_null_groups_stay(spark):
    df = spark.createDataFrame([("a", 1, 5.0), (None, 2, 1.0), (None, 3, 3.0)], "peer string, doc int, score double")
    got = {r.doc: r["rank"] for r in ranking.ranked(df, [F.asc("doc")], ["peer"]).collect()}
    assert got == {1: 1, 2: 1, 3: 2}
    assert {r.doc: r.normalized_score for r in fusion.norm_minmax(df).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    assert {r.doc: r.normalized_score for r in fusion.norm_rank(df, ["doc"]).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    filled = ranking.carry_forward(df.withColumn("v", F.when(F.col("doc") == 2, 7)), ["peer"], ["doc"], ["v"], F.lit(0))
    assert {r.doc: r.v for r in filled.collect()} == {1: None, 2: 7, 3: 7}


def test_words_beyond_the_report_decide_a_sum(spark):
    """A word that is 31st in every source is first over all of them."""
    docs = spark.createDataFrame(
        [(f"s{i}", " ".join(" ".join([f"word{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}"] * 3) for k in range(30)) + " common common") for i in range(6)],
        "source string, text string",
    )
    top = words.cloud_terms(words.words_engine(docs), 1).first()
    assert (top.key, top.n) == ("common", 12)


def test_reply_circles_end(spark):
    data = [("1", None, "a", 1, "root"), ("2", "1", "a", 2, "more"), ("3", "4", "a", 3, "x"), ("4", "3", "a", 4, "y"), ("5", "4", "a", 5, "z"), ("6", "gone", "a", 6, "lost")]
    replies = spark.createDataFrame(data, "cid string, parent string, did string, created_at int, text string")
    placed, circles = thread_rows(replies)
    assert [(r.root, r.step, r.text) for r in placed.orderBy("step").collect()] == [("1", 0, "root"), ("1", 1, "more")]
    assert rows(circles) == [("3",), ("4",)]
    tree, circles = story_tree(replies.select(F.col("cid").alias("name"), "parent"))
    assert rows(tree.select("name", "pager")) == [("1", 1), ("2", 2)] and rows(circles) == [("3",), ("4",), ("5",)]


def test_deep_story_tree(spark):
    stories = spark.range(5000).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    tree, circles = story_tree(stories)
    assert tree.agg(F.max("pager"), F.count("name")).first()[:] == (5000, 5000) and circles.isEmpty()


def test_phrases_touching_an_end_do_not_count(spark):
    docs = spark.createDataFrame([("s1", "john smith met paul jones"), ("s2", "so John, Smith; met"), ("s3", "a b")], "source string, text string")
    entities = spark.createDataFrame([("ident.j", "John Smith", ["Jones"])], "name string, label string, altlabels array<string>")
    got = rows(mentions.match_phrases(docs, mentions.phrase_dict(entities), occurrences=True))
    assert got == [("s2", "ident.j", 1, 1)]


def test_phonetic_duplicates_equal_brute_force(spark):
    random.seed(7)
    firsts = ["Mohammed", "Muhammad", "Mohamed", "Schmidt", "Schmitt", "Catherine", "Katherine", "Jo", "Martin"]
    lasts = ["Ali", "Aly", "Alie", "Weber", "Webber", "Brown", "Braun", "Hassan", "Hasan", "Hassane"]
    labels = [f"{random.choice(firsts)} {random.choice(lasts)}{random.choice(['', 'e', 's'])}" for _ in range(150)]
    labels += ["Martin " + "".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(120)]
    people = [(f"ident.{i:03d}", label) for i, label in enumerate(labels)]
    want = set()
    for i, (a, la) in enumerate(people):
        for b, lb in people[i + 1 :]:
            wa, wb = la.split()[0], lb.split()[0]
            if min(len(wa), len(wb)) < 3 or similarity.metaphone(wa) != similarity.metaphone(wb):
                continue
            if 0.93 <= similarity.jaro_winkler(la.lower(), lb.lower()) < 1:
                want.add((a, b))
    frame = spark.createDataFrame(people, "name string, label string")
    got = search.phonetic_duplicates(frame).collect()
    assert len(got) == len({(r.label_a, r.label_b) for r in got})
    holders = {}
    for r in search.label_holders(frame).collect():
        holders.setdefault(r.label, []).append(r.name)
    pairs = {tuple(sorted((a, b))) for r in got for a in holders[r.label_a] for b in holders[r.label_b]}
    assert pairs == want and len(want) > 50
    assert all(r.n_a == len(holders[r.label_a]) and r.b == min(holders[r.label_b]) for r in got)


def test_network_counts_equal_pairs(spark):
    from test_graph import make

    random.seed(3)
    found = sorted({(f"s{random.randrange(12)}", f"ident.{random.randrange(9)}") for _ in range(60)})
    found += [("hot", f"ident.{i}") for i in range(9)]
    quest = make(spark, idents=[{"name": f"ident.{i}", "label": str(i)} for i in range(9)])
    table = spark.createDataFrame([(s, "idents", k, 1) for s, k in found], "source string, kind string, key string, n int")
    by_source = {}
    for s, k in found:
        by_source.setdefault(s, set()).add(k)

    def network(x):
        return [(o, s) for s, ks in by_source.items() if x in ks for o in ks if o != x]

    got = {(r.other, r.source) for r in mentions.ident_network(quest, table, ["ident.1"]).collect()}
    assert got == set(network("ident.1"))
    second = {}
    for near in {o for o, _ in network("ident.1")}:
        for other, _ in network(near):
            if other != "ident.1":
                second[other] = second.get(other, 0) + 1
    got = {r.other: r.n for r in mentions.ident_network_2(quest, table, "ident.1").collect()}
    assert got == second
    totals = {r.ident: (r.n_sources, r.n_shared) for r in mentions.network_totals(table).collect()}
    assert totals["ident.1"] == (sum("ident.1" in ks for ks in by_source.values()), len(network("ident.1")))


def test_ratio_history(spark):
    changes = spark.createDataFrame(
        [("d", "2024-01-01 00:00:00", 10, None), ("d", "2024-01-05 00:00:00", None, 4), ("d", "2024-02-01 00:00:00", 12, 0)],
        "did string, t string, followers_count long, follows_count long",
    ).select("did", F.col("t").cast("timestamp_ntz").alias("at"), "followers_count", "follows_count")
    current = spark.createDataFrame([("d", 20, 5)], "did string, followers_count long, follows_count long")
    got = [(r.followers, r.follows, r.ratio) for r in ratio_history(changes, current, "2024-03-01").orderBy("at").collect()]
    assert got == [(10, 4, 2.5), (12, 0, None), (20, 5, 4.0)]


def test_thread_text(spark):
    data = [("1", None, "a", 1, "root"), ("2", "1", "b", 2, "other"), ("3", "1", "a", 3, "more"), ("4", "1", "a", 4, "late"), ("5", "3", "a", 5, "end"), ("6", "5", "b", 6, "no")]
    replies = spark.createDataFrame(data, "cid string, parent string, did string, created_at int, text string")
    assert [(r.root, r.text, r.replies) for r in thread_text(replies).collect()] == [("1", "root\nmore\nend", 2)]


def test_long_thread(spark):
    replies = spark.range(300).select(
        F.col("id").cast("string").alias("cid"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"),
        F.lit("a").alias("did"), F.col("id").cast("int").alias("created_at"), F.col("id").cast("string").alias("text"),
    )
    parts = thread_text(replies).orderBy("part").collect()
    assert [(r.part, r.replies) for r in parts] == [(0, 255), (1, 299)]
    assert "\n".join(r.text for r in parts).split("\n") == [str(i) for i in range(300)]


def test_large_tables_are_dealt_out(spark, small_dir, monkeypatch):
    """A table beyond a row group has as many tasks as its bytes ask for, and all of its rows."""
    from gumshoe.sources import tables

    monkeypatch.setattr(tables, "file_bytes", lambda *_: 200 << 20)
    dealt = tables.texts(spark, small_dir, "documents", "doc_id")
    assert dealt.rdd.getNumPartitions() == 50 and dealt.count() == tables.table(spark, small_dir, "documents").count()
    assert tables.texts(spark, small_dir, "documents", "doc_id", large=False).rdd.getNumPartitions() < 50


def test_letters_are_folded_where_there_are_any(spark):
    from gumshoe.functions.text import _folded, first_tokens, fold_accents, tokens

    texts = ["plain words", "", None, " Éque  ñandú é ", "Σίσυφος ß æŒ", "Жук объект", "日本 İstanbul", "x" * 500 + " a b c", " ".join("ab%d" % i for i in range(300)), "é-" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(fold_accents(F.col("t")).alias("a"), _folded(F.col("t")).alias("b"), first_tokens(F.col("t"), 7).alias("c"), F.slice(tokens(F.col("t")), 1, 7).alias("d")).collect():
        assert r.a == r.b and r.c == r.d
