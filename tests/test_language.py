"""Languages by letter sequences: held-out documents, odd texts, and sums against plain counting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gumshoe.functions import language
from gumshoe.functions.language import SLOTS, LanguageModel, fit_languages, score_languages


def slots(text):
    points = [ord(c) for c in text]
    return [((a * 65_599 + b) * 65_599 + c) % SLOTS for a, b, c in zip(points, points[1:], points[2:])]


def test_sums_equal_plain_counting(spark, monkeypatch):
    rows = [(1, "Abc, abd!", "x"), (2, "zzz ééé 日本", "y"), (3, None, "x"), (4, "abc", None), (5, "12 34", "y"), (6, "b c", "x")]
    docs = spark.createDataFrame(rows, "id int, text string, lang string").repartition(3)
    clean = {1: " abc abd ", 2: " zzz ééé 日本 ", 3: "  ", 4: " abc ", 5: "  ", 6: " b c "}
    counts = {"x": slots(clean[1]) + slots(clean[6]), "y": slots(clean[2])}

    def cost(name, text):
        own = counts[name]
        return sum(math.floor(1000 * math.log((len(own) + SLOTS) / (own.count(s) + 1))) for s in slots(text))

    for letters in (2_000_000, 1, 4):
        monkeypatch.setattr(language, "LETTERS", letters)
        model = fit_languages(docs)
        assert model.languages == ["x", "y"]
        got = {r.id: (r.lang, r.cost, r.sequences) for r in score_languages(docs, model, "id").collect()}
        for i, text in clean.items():
            n = len(slots(text))
            best = min((cost(name, text), name) for name in counts)
            assert got[i] == ((best[1], best[0], n) if n else ("und", 0, 0))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "id int, text string, lang string")
    model = fit_languages(docs)
    assert model.languages == [] and [r.lang for r in score_languages(docs, model, "id").collect()] == ["und"]
    assert score_languages(docs.limit(0), model, "id").count() == 0


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").where("lang is not null")
    model = fit_languages(docs.where("doc_id % 3 <> 1"))
    asked = docs.where("doc_id % 3 = 1 and length(regexp_replace(text, '[^a-zA-Z]', '')) > 20")
    found = score_languages(asked, model, "doc_id").withColumnRenamed("lang", "found").join(asked.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("found") == F.col("lang")).cast("int"))).first()[0]
    assert right >= 0.97


def test_scores_are_exact_for_long_texts():
    model = LanguageModel(["a"], np.full((1, SLOTS), 11_090, np.int64))
    costs, sequences = model.scores([" " + "abcdefg " * 300_000, "  "])
    assert sequences.tolist() == [2_399_999, 0] and costs[:, 0].tolist() == [2_399_999 * 11_090, 0]
