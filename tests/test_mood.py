"""Valence shifts on literal sentences."""

import pytest

from gumshoe.operators import social, words

LEXICON = [("good", 0.7, 0.6), ("bad", -0.7, 0.6), ("calm", 0.3, 0.2), ("plain", 0.0, 0.1)]
# Sentence, and the valence of its listed words in thousandths, halves and turns as stated.
CASES = [
    ("good", [700]),
    ("not good", [-518]),
    ("very good", [993]),
    ("not very good", [-734.82]),
    ("very bad", [-993]),
    ("slightly good", [407]),
    ("slightly bad", [-407]),
    ("very x good", [978.35]),
    ("very x y good", [963.7]),
    ("very x y z good", [700]),
    ("never x y bad", [518]),
    ("never x y z bad", [-700]),
    ("good but bad", [350, -1050]),
    ("bad, but not good but good", [-350, -777, -777]),
    ("very very good", [993 + 278.35]),
    ("good plain", [700, 0]),
    ("not plain but very plain", [0, 0]),
    ("nothing listed", []),
    ("", []),
]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double")


def test_valences(spark, lexicon):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "source int, text string")
    rows = words.with_valence(words.shifted_words(docs, "source"), lexicon).collect()
    for i, (text, expected) in enumerate(CASES):
        got = sorted(r.valence / words.UNITS * 1000 for r in rows if r.source == i and r.valence is not None)
        assert got == pytest.approx(sorted(expected)), text


def test_mood(spark, lexicon):
    docs = spark.createDataFrame([("a", "not good"), ("b", "good but bad"), ("c", None), ("d", "plain words"), ("e", "very good and calm")], "source string, text string")
    got = {r.source: r for r in words.lexicon_mood(docs, lexicon).collect()}
    assert {k: r.mood for k, r in got.items()} == {"a": "Negative", "b": "Negative", "c": "Neutral", "d": "Neutral", "e": "Positive"}
    assert (got["a"].polarity, got["a"].subjectivity, got["a"].negative, got["a"].neutral) == (-0.518, 0.6, 0.5, 0.5)
    assert got["b"].polarity == -0.35 and got["e"].polarity == pytest.approx(0.778)
    value = -0.7
    assert got["b"].compound == round(value / (value * value + 15) ** 0.5, 3)


def test_sums_do_not_depend_on_partitions(spark, lexicon):
    posts = [(f"d{i % 3}", f"c{i}", ["not very good", "good but bad calm", "calm calm", "x"][i % 4], False, None) for i in range(400)]
    frame = spark.createDataFrame(posts, "did string, cid string, text string, is_reply boolean, reply_did string")
    results = []
    for parts in (1, 7, 50):
        rows = frame.repartition(parts)
        results.append(sorted(map(str, social.account_mood(rows, social.compound(rows, lexicon)).collect())))
    assert results[0] == results[1] == results[2]
