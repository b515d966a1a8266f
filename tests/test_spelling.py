"""Corrections found by cut variants, against every distance."""

import random
import re

import pytest

from gumshoe.operators import index, search


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def brute(vocabulary, words, most):
    out = {}
    for word in words:
        near = [(d, -df, t) for t, df in vocabulary if (d := distance(word, t)) <= most]
        if near:
            out[word] = min(near)[2]
    return out


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abcde", 2), ("abé日", 3)])
def test_equals_every_distance(spark, letters, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 9, 12, 20])))
    vocabulary = sorted({(word(), rng.randint(1, 5)) for _ in range(300)})
    vocabulary = list(dict(vocabulary).items())

    def mangled(t):
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t = rng.choice([t[:at] + rng.choice(letters) + t[at:], t[:at] + t[at + 1 :], t[:at] + rng.choice(letters) + t[at + 1 :]])
        return t or "a"

    words = sorted({mangled(t) for t, _ in rng.sample(vocabulary, 40)} | {"zzzzzzz", "z", "zz"})
    words = [w for w in words if search.query_words(w) == [w]]
    variants = index.spelling_variants(spark.createDataFrame(vocabulary, "term string, df long"))
    for most in (0, 1, 2):
        got = {r.word: r.correction for r in search.search_spelling(variants, " ".join(words), most).collect()}
        assert got == brute(vocabulary, words, most)
    with pytest.raises(ValueError):
        search.search_spelling(variants, "a", 3)


def test_long_words_have_few_variants(spark):
    words = spark.createDataFrame([("x" * 50_000, 1), ("abcdefghij", 1), ("a", 1), ("aa", 1)], "term string, df long")
    counts = {len(r.term): r["count"] for r in index.spelling_variants(words).groupBy("term").count().collect()}
    assert counts == {50_000: 3, 10: 29, 1: 2, 2: 3}


def test_only_the_variants_are_read(spark, tmp_path):
    vocabulary = spark.createDataFrame([(f"w{i:05d}", i) for i in range(20_000)], "term string, df long")
    path = str(tmp_path / "spelling")
    index.spelling_variants(vocabulary).repartitionByRange(40, "variant", "term").sortWithinPartitions("variant", "term").write.parquet(path)
    found = search.search_spelling(spark.read.parquet(path), "w1234")
    assert [(r.word, r.correction) for r in found.collect()] == [("w1234", "w19234")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "In(variant" in pushed and "GreaterThan" not in pushed
    files = [r[0] for r in spark.read.parquet(path).selectExpr("_metadata.file_path").distinct().collect()]
    assert len(files) > 30
