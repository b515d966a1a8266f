"""Phrases found by the automaton, against plain search."""

import random

import pytest

from gumshoe.operators import patterns
from gumshoe.operators.mentions import match_phrases, match_substrings
from gumshoe.operators.patterns import Automaton, occurrences


def plain(phrases, texts):
    out = {}
    for i, text in enumerate(texts):
        for p in phrases:
            n = sum(text.startswith(p, at) for at in range(len(text)))
            if n:
                out[i, p] = n
    return out


@pytest.mark.parametrize("lane", [1, 7, 2048])
def test_automaton(monkeypatch, lane):
    monkeypatch.setattr(patterns, "LANE", lane)
    rng = random.Random(lane)
    for _ in range(150):
        letters = rng.choice(["ab", "abc é", "abcdefg ", "日本語a"])
        word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most))).encode()
        phrases = sorted({word(6) for _ in range(rng.randint(1, 12))})
        texts = [word(60) for _ in range(rng.randint(1, 7))] + [b"", b"zz"]
        text, phrase, times = Automaton(phrases).found(texts)
        got = {(i, phrases[p]): n for i, p, n in zip(text.tolist(), phrase.tolist(), times.tolist())}
        assert got == plain(phrases, texts) and len(got) == len(text)


def test_occurrences_in_parts(spark, monkeypatch):
    """Dictionaries of several parts, phrases of several keys, copies of a text, nulls and empty phrases."""
    docs = [(1, "the cat sat on the cat"), (2, None), (3, ""), (4, "a" * 5000), (1, "the cat sat on the cat"), (5, "dog\0cat")]
    words = [("cat", "c"), ("cat", "d"), ("the cat", "t"), ("", "e"), ("aa", "a"), ("dog\0cat", "z"), ("at", "c"), (None, "n"), ("sat on the mat", "m"), ("cat", "c")]
    frame = spark.createDataFrame(docs, "source int, body string")
    dictionary = spark.createDataFrame(words, "phrase string, key string")
    want = sorted([(1, "cat", "c", 2), (1, "cat", "d", 2), (1, "the cat", "t", 2), (1, "at", "c", 3)] * 2 + [(4, "aa", "a", 4999), (5, "cat", "c", 1), (5, "cat", "d", 1), (5, "at", "c", 1)])
    for most in (1 << 18, 7):
        monkeypatch.setattr(patterns, "PART_BYTES", most)
        assert sorted(tuple(r) for r in occurrences(frame, dictionary, "source", "body").collect()) == want
    assert occurrences(frame, dictionary.limit(0), "source", "body").collect() == []
    assert occurrences(frame.limit(0), dictionary, "source", "body").collect() == []


def test_long_phrases_need_blanks(spark):
    docs = spark.createDataFrame([("s", "x one two three four five six y"), ("t", "one two three four five x"), ("u", "x one two three four five fives one two three four five one two three four five z")], "source string, text string")
    words = spark.createDataFrame([("one two three four five", "k"), ("two three four five six", "k"), ("three four", "k"), ("four five six y z", "l")], "phrase string, key string")
    got = sorted(tuple(r) for r in match_phrases(docs, words, occurrences=True).collect())
    assert got == [("s", "k", 3, 3), ("t", "k", 1, 1), ("u", "k", 2, 6)]


def test_substrings_of_a_long_text(spark):
    docs = spark.createDataFrame([("s", "Word, " * 200_000 + "Iran!")], "source string, text string")
    words = spark.createDataFrame([("iran", "c.ir"), ("word  word", "c.w"), ("ran ", "c.r")], "phrase string, key string")
    assert sorted(tuple(r) for r in match_substrings(docs, words).collect()) == [("s", "c.ir", 1), ("s", "c.r", 1), ("s", "c.w", 1)]


def test_only_found_phrases_are_shuffled(spark):
    """Mentions of short phrases come from one pass over the texts: no run of words is made a row."""
    from gumshoe.operators import mentions

    words = spark.createDataFrame([("one two", "k1"), ("two", "k2"), ("two", "k3"), ("", "k4"), (" two", "k5")], "phrase string, key string")
    docs = spark.createDataFrame([("a", "x one two two one two y"), ("a", "x two y"), ("b", "two one"), ("c", None), ("d", ""), (None, "x two y")], "source string, text string")
    found = mentions.match_phrases(docs, words, occurrences=True)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "k1", 1, 2), ("a", "k2", 1, 4), ("a", "k3", 1, 4), (None, "k2", 1, 1), (None, "k3", 1, 1)], key=str)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
