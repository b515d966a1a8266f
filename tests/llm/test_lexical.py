"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gumshoe.llm import lexical
from gumshoe.llm.lexical import Items, Ranker, rank_documents, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def spelled(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=50):
    """docs: (id, text) rows; items: id -> text."""
    own = [(i, Counter(spelled(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    total, words = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items.items():
        found = []
        for i, c in own:
            n = sum(c.values())
            m = 50 + (50 * n * total) // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(spelled(text)) if c[t])
            if score and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_terms():
    text = "Étude, Straße_x 12-a\x00B\x7fc–d e 日本語 fooBAR9"
    assert terms_of(text.encode()) == [t.encode() for t in spelled(text)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    names = [f"t{i}" for i in range(400)]
    word = lambda: names[min(399, int(rng.expovariate(0.02)))]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(120)] + [(2000, None), (2001, ""), (2002, " ,;"), (None, docs[6][1]), (3, docs[3][1]), (2003, "T1 " * 30_000)]
    items = {i: " ".join(word() for _ in range(rng.randint(1, 25))) for i in range(30)} | {100: docs[5][1], 101: "", 102: "nowhere", 103: "t0 t1 t2", 104: " ".join(names)}
    return docs, items


def rows(spark, corpus, parts=3):
    docs, items = corpus
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(parts)
    right = spark.createDataFrame([(i, t, 5) for i, t in items.items()] + [(None, "t3", 5), (105, None, 5)], "item_id long, text string, doc_id int")
    return left, right


@pytest.mark.parametrize("size,bytes_most", [(8192, 4_000_000), (64, 4_000_000), (16, 500)])
def test_rank_documents(spark, corpus, monkeypatch, size, bytes_most):
    monkeypatch.setattr(lexical, "DOCUMENTS", size)
    monkeypatch.setattr(lexical, "ITEM_BYTES", bytes_most)
    docs, items = rows(spark, corpus)
    assert sorted(tuple(r) for r in rank_documents(docs, items).collect()) == brute(*corpus)


def test_empty_tables_and_repeated_items(spark, corpus):
    docs, items = rows(spark, corpus)
    assert rank_documents(docs.limit(0), items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "t5 t9"), (1, "t9 t30")], "item_id long, text string")
    got = sorted(tuple(r) for r in rank_documents(docs, twice, k=7).collect())
    assert got == brute(corpus[0], {1: "t5 t9 t30"}, 7)


def test_accumulators_are_limited():
    """Once rare terms decide, frequent ones make no accumulators, and results stay exact."""
    rng = np.random.default_rng(5)
    n, k = 4000, 10
    df = np.array([40, 60, 3000, 3500, 3900])
    post = [rng.choice(n, d, replace=False) for d in df]
    doc, term = np.concatenate(post), np.repeat(np.arange(5), df)
    order = np.argsort(doc, kind="stable")
    items = Items([7], [np.arange(5)], {})
    ranker = Ranker.of(items, n, 50 * n, df, k)
    tf = np.ones(len(doc), np.int64)
    ranker.add(np.arange(n), np.full(n, 50), doc[order], term[order], tf)
    part = ranker.weights * (10**9 // (1000 + 20 * 100))
    exact = np.zeros(n, np.int64)
    np.add.at(exact, doc, part[term])
    best = np.lexsort((np.arange(n), -exact))[:k]
    assert ranker.best[0][1].tolist() == best.tolist() and ranker.best[0][0].tolist() == exact[best].tolist()
    assert ranker.accumulators <= 100 < n and ranker.postings_read < 500
