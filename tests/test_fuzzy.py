"""The bound of the fuzzy score, and the reranking against scores of every result."""

import random

import pytest
from pyspark.sql import functions as F

from gumshoe.functions import similarity
from gumshoe.functions.bounds import fuzzy_bound, text_words
from gumshoe.operators import search

QUERIES = ["que les ingor", "john  smith", "a", "", "ab ab cd", "île-de-france paris", "x y z", "smith johnathan the third of that name"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = "que les ingor john smith jon smyth paris ile france île-de-france a b ab cd the third of name xyz ingorr".split()
    out = ["", " ", "a", "smith, john", " john smith\x1f", "QUE les", "日本 que", "ab\tcd ab"]
    for _ in range(600):
        spaces = rng.choice([" ", " ", "  ", " ", "\x1c", "\n"])
        out.append(spaces.join(rng.choice(words) for _ in range(rng.randint(0, 12))))
    for _ in range(300):
        out.append("".join(rng.choice("abcdehijnoqrst é") for _ in range(rng.randint(0, 60))))
    return out


def test_bound_is_never_below(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("w", text_words(F.col("t")))
    for query in QUERIES:
        bounds = {r.i: r.b for r in frame.select("i", fuzzy_bound(query, F.col("t"), F.col("w")).alias("b")).collect()}
        for i, text in enumerate(texts):
            assert similarity.fuzzy_score(query, text)[0] <= bounds[i] + 1e-9, (query, text)
    split = {r.i: list(r.w) for r in frame.collect()}
    assert all(split[i] == t.split() for i, t in enumerate(texts))


def frame_of(spark, texts):
    rows = [(f"d{i}", t.title(), "" if i % 3 else "a the", 100.0 - i % 90) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc string, title string, description string, percent double"), rows


@pytest.mark.parametrize("threshold", [20, 60, 70, 90])
def test_equals_scores_of_every_result(spark, texts, threshold):
    found, rows = frame_of(spark, texts)
    query = "Que les Ingor"
    want = []
    for doc, title, description, percent in rows:
        text = " ".join([title, description] if description else [title]).lower()
        score, sound, present = similarity.fuzzy_score(query.lower(), text)
        if score >= threshold:
            share = 0.3 + score / 100 * 0.2
            want.append((doc, round(score, 2), round(sound, 2), present, round(percent * (1 - share) + score * share, 6)))
    got = [(r.doc, r.fuzzy_score, r.phonetic_score, r.token_match, round(r.combined_score, 6)) for r in search.search_fuzzy(found, query, threshold).collect()]
    assert sorted(got) == sorted(want) and [g[4] for g in got] == sorted((g[4] for g in got), reverse=True)


def test_share_that_is_not_scored(spark, texts):
    found, _ = frame_of(spark, texts)
    text = F.lower(F.concat_ws(" ", "title"))
    worded = found.withColumn("t", text).withColumn("w", text_words(F.col("t")))
    possible = worded.where(fuzzy_bound("que les ingor", F.col("t"), F.col("w")) >= 70).count()
    # Of 908 texts, made of the query's own words or of its letters, over half cannot reach 70.
    assert possible < 0.5 * len(texts)


def test_query_against_brute_force(spark, small_dir):
    from gumshoe.catalog import searching

    found = search.search_index(searching.stored_index(spark, small_dir), searching.QUERY).collect()
    want = set()
    for r in found:
        text = " ".join([r.title, r.description] if r.description else [r.title]).lower()
        score = similarity.fuzzy_score("que les ingor", text)[0]
        if score >= 20:
            want.add((r.doc, round(score, 2)))
    assert {(r.doc, r.fuzzy_score) for r in searching.search_fuzzy(spark, small_dir).collect()} == want and want
