"""Rank fusion on the literal cases."""

import pytest

from gumshoe.operators import fusion


def fused(spark, peers, **options):
    rows = [(p, d, s) for p, results in peers.items() for d, s in results]
    df = spark.createDataFrame(rows, "peer string, doc string, score double")
    return [(r.peer, r.doc, round(r.normalized_score, 6)) for r in fusion.fuse_results(df, **options).collect()]


def test_minmax(spark):
    got = fused(spark, {"a": [("x", 10.0), ("y", 5.0), ("z", 0.0)]})
    assert got == [("a", "x", 1.0), ("a", "y", 0.5), ("a", "z", 0.0)]


def test_minmax_ties_single_and_missing(spark):
    got = dict((d, s) for _, d, s in fused(spark, {"a": [("x", 3.0), ("y", 3.0)], "b": [("w", 7.0)], "c": [("u", None), ("v", 4.0)]}))
    assert got == {"x": 1.0, "y": 1.0, "w": 1.0, "u": 0.0, "v": 1.0}


def test_rank(spark):
    got = fused(spark, {"a": [("x", 9.99), ("y", 9.98), ("z", 0.01)], "b": [("w", 1.0)]}, method="rank")
    assert sorted(got) == [("a", "x", 1.0), ("a", "y", 0.5), ("a", "z", 0.0), ("b", "w", 1.0)]


def test_limit_and_unknown_method(spark):
    assert len(fused(spark, {"a": [("x", 1.0), ("y", 0.0)]}, limit=1)) == 1
    with pytest.raises(ValueError):
        fused(spark, {"a": [("x", 1.0)]}, method="median")


def test_routing(spark):
    vocabulary = spark.createDataFrame([("p1", "ukraine"), ("p2", "bank"), ("p2", "volodymyr")], "peer string, term string")
    route = lambda q: sorted(r.peer for r in fusion.route_peers(vocabulary, q).collect())
    assert route("Ukraine war") == ["p1"]
    assert route("volodymyr ukraine") == ["p1", "p2"]
    assert route("nothing") == []
