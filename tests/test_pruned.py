"""The k best by pruned postings, against the scores of every hit."""

import random

import pytest
from pyspark.sql import functions as F

from gumshoe.operators import index, search
from gumshoe.operators.incremental import incr_index


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "doc string, title string, description string, altlabels string, peer string, data string")
    return docs.withColumns({"url": F.lit("http://x"), "cats": F.array(F.lit("a")), "type": F.lit("t"), "country": F.lit("c"), "begin": F.lit(None).cast("date")})


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(13)
    names = [f"t{i}" for i in range(300)]
    word = lambda: names[min(299, int(rng.expovariate(0.03)))]
    rows = [(f"d{i:05d}", word(), "", None, "p", " ".join([word() for _ in range(rng.randint(1, 60))] + ["rare"] * (rng.randint(1, 6) if i % 97 == 0 else 0))) for i in range(3000)]
    rows += [(f"e{i}", "rare", "", None, "p", "t0 t0 t1") for i in range(30)]
    one = index.write_index(frame(spark, rows), str(tmp_path_factory.mktemp("pruned") / "one"))
    later = [(d, "t2", "", None, "p", x) if i % 50 == 0 else (d, t, "", None, "p", x) for i, (d, t, _, _, _, x) in enumerate(rows) if i % 31]
    prints = [r.select("doc", F.md5(F.concat("title", "data")).alias("fingerprint")) for r in (one.docs(), frame(spark, later))]
    return one, index.update_index(one, incr_index(*prints), frame(spark, later))


@pytest.mark.parametrize("which", [0, 1])
def test_same_first_ones(stored, which):
    for query, sizes in (("rare t0", (1, 50)), ("t0 t1 t2 t5", (7,)), ("t250 t0", (50,)), ("nowhere", (7,)), ("rare nowhere t299", (7, 50))):
        for k in sizes:
            whole = search.search_index(stored[which], query).orderBy(F.desc(F.round("score", 9)), "doc").limit(k)
            want = [(r.doc, round(r.score, 9)) for r in whole.collect()]
            got = search.search_top(stored[which], query, k)
            assert sorted(((r.doc, round(r.score, 9)) for r in got.best.collect()), key=lambda x: (-x[1], x[0])) == want


def test_fewer_postings_are_read(stored):
    first = search.search_top(stored[0], "rare t0 t1", 5)
    assert first.best.count() == 5 and first.read < 0.5 * first.held
    assert search.search_top(stored[0], "t299", 500).read >= 1
