"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gumshoe.llm.runs import lyndon_array, periodic_runs, recurring_stretches, runs_of


def brute_runs(x, least=24, times=3):
    found = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                w = x[i : i + length]
                if not any(all(w[k] == w[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def periodic(rng, most, letters):
    x = []
    while len(x) < most:
        x += [rng.randrange(letters) for _ in range(rng.randint(1, 12))] * rng.randint(1, 7)
    return x


def test_lyndon_array():
    rng = random.Random(1)
    for _ in range(600):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 40))]
        ends = [next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x)) for i in range(len(x))]
        assert lyndon_array(x).tolist() == [e - i for i, e in enumerate(ends)]


def test_runs_of_sequences():
    rng = random.Random(2)
    for _ in range(250):
        x = np.array(periodic(rng, rng.randint(1, 160), rng.randint(1, 4)))
        assert [tuple(r) for r in runs_of(x, 6, 3).tolist()] == brute_runs(x.tolist(), 6)
        found = []
        for a, b in recurring_stretches(x, np.zeros(len(x), np.int64), 24):
            own = np.unique(x[a:b], return_inverse=True)[1]
            found += [(s + a, n, q) for s, n, q in runs_of(own, 24, 3).tolist()]
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute_runs(x.tolist())


def test_stretches_stay_in_their_document():
    x = np.tile(np.arange(9), 8)
    doc = np.repeat([0, 1, 2], [36, 5, 31])
    assert list(recurring_stretches(x, doc, 24)) == [(0, 36), (41, 72)]
    assert list(recurring_stretches(np.arange(100), np.zeros(100, np.int64), 24)) == []


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [" ".join(f"w{x}" for x in periodic(rng, rng.randint(1, 300), rng.randint(1, 40))) for _ in range(60)]
    out += [None, "", " \n\t", "a", "a " * 24, "a " * 23, "É é" * 30, "x\x1cy z " * 20, "a b\tc\x0b" * 30]
    out += [" ".join(f"w{rng.randrange(3000)}" for _ in range(30_000)), "ab cd ef " * 20_000]
    return out + out[:3]


def test_periodic_runs(spark, texts):
    rows = [(i % 40 if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed long").repartition(3)
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect())
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words) if len(words) < 20_000 else [(0, 60_000, 3)] if t.startswith("ab") else []
        want.append((str(i), runs, b" ".join(collapse(words, runs)).decode() if len(words) < 20_000 or not runs else "ab cd ef"))
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, small_dir):
    from gumshoe.llm.catalog import op13_periodic_runs
    from gumshoe.llm.common import table

    texts = {r.doc_id: r.text or "" for r in table(spark, small_dir, "documents").collect()}
    got = {r.doc_id: r for r in op13_periodic_runs(spark, small_dir).collect()}
    assert set(got) == set(texts) and any(r.n_runs for r in got.values())
    for i, text in texts.items():
        words = text.encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n > 3000:
            continue
        runs = brute_runs(words)
        r = got[i]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *top)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()


def test_longest_of_ties(spark):
    from gumshoe.llm.catalog import _longer
    from pyspark.sql import functions as F

    schema = "runs array<struct<start:long,length:long,period:long>>"
    rows = [([(9, 30, 10), (2, 24, 8), (2, 27, 9), (5, 24, 8)],), ([(1, 2**40, 3), (7, 2**40 + 1, 3)],), ([],)]
    best = F.try_element_at(F.array_sort("runs", _longer), F.lit(1)).alias("b")
    got = [r.b and tuple(r.b) for r in spark.createDataFrame(rows, schema).select(best).collect()]
    assert got == [(2, 24, 8), (7, 2**40 + 1, 3), None]
