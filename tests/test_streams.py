"""Streams give the answer of the whole history, whatever the order and number of arrivals."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gumshoe.streaming import feeds


def at(hour):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour)


@pytest.fixture()
def arrive(spark, tmp_path):
    """Write rows as one more file and run the stream over what is new."""

    def run(data, schema, store, **options):
        folder = str(tmp_path / "in")
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(folder)
        store(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), available_now=True, **options).awaitTermination()
        return str(tmp_path / "out"), stream.schema

    return run


def test_a_post_repeated_long_after_stays_out(spark, arrive):
    schema = "cid string, created_at timestamp, text string"
    arrive([("a", at(0), "first"), ("a", at(1), "again")], schema, feeds.store_feed)
    arrive([("b", at(2), "b")], schema, feeds.store_feed)
    path, kind = arrive([("a", at(500), "much later"), ("b", at(1), "late"), ("c", at(-900), "old")], schema, feeds.store_feed)
    assert rows(feeds.read_feed(spark, path, kind).select("cid", "text")) == [("a", "first"), ("b", "b"), ("c", "old")]


def test_a_late_snapshot_takes_its_place(spark, arrive):
    schema = "did string, taken_at timestamp, handle string, followers_count long"
    arrive([("x", at(0), "one", 1), ("x", at(10), "two", 1)], schema, feeds.store_changes)
    arrive([("y", at(0), "y", 1)], schema, feeds.store_changes)
    path, kind = arrive([("x", at(5), "middle", 1), ("x", at(10), "two", 1), ("y", at(-3), "z", None)], schema, feeds.store_changes)
    got = rows(feeds.read_changes(spark, path, kind).select("did", "field", F.coalesce("old", F.lit("-")), "new"))
    assert got == [("x", "handle", "middle", "two"), ("x", "handle", "one", "middle"), ("y", "followers_count", "-", "1"), ("y", "handle", "z", "y")]


def test_any_order_of_arrival_gives_the_same_changes(spark, arrive):
    """Against the changes of the whole history, for batches dealt at random, copies and accounts with nulls."""
    import random

    from gumshoe.operators.incremental import profile_diff

    rng = random.Random(7)
    schema = "did string, taken_at timestamp, seq long, handle string, followers_count long"
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), at(rng.randint(0, 200)), i, rng.choice(["h", "g", None]), rng.randint(0, 3)) for i in range(400)]
    for batch in range(4):
        part = [d for i, d in enumerate(data) if i % 4 == batch] + data[:5]
        path, kind = arrive(part, schema, feeds.store_changes, order=["taken_at", "seq"])
    got = rows(feeds.read_changes(spark, path, kind, order=["taken_at", "seq"]).selectExpr("coalesce(did, '')", "seq", "field", "coalesce(old, '-')", "coalesce(new, '-')"))
    whole = spark.createDataFrame(data, schema)
    diffs = profile_diff(whole, ["did"], ["taken_at", "seq"]).selectExpr("did", "seq", "explode(changes) as (field, old)")
    assert [(d, s, f, o) for d, s, f, o, _ in got] == rows(diffs.selectExpr("coalesce(did, '')", "seq", "field", "coalesce(old, '-')"))
    now = {d[2]: {"handle": d[3], "followers_count": str(d[4])} for d in data}
    assert all(n == (now[s][f] or "-") for _, s, f, _, n in got)


def test_a_batch_reads_no_history(spark, arrive):
    """What a batch writes and looks up does not grow with the batches before it."""
    schema = "cid string, created_at timestamp, text string"
    for batch in range(4):
        path, kind = arrive([(f"{batch}-{i}", at(i), "t") for i in range(50)] + [("0-0", at(1), "again")], schema, feeds.store_feed)
    counts = {r["batch"]: r["count"] for r in feeds.read_batches(spark, path, kind).groupBy("batch").count().collect()}
    assert counts == {0: 50, 1: 50, 2: 50, 3: 50}
    assert rows(feeds.read_feed(spark, path, kind).where("cid = '0-0'").select("text")) == [("t",)]


def test_a_repeated_batch_is_the_same(spark, tmp_path):
    """A batch whose commit was lost runs again after a restart and leaves the same rows."""
    import pathlib

    schema = "cid string, created_at timestamp"
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for batch in range(2):
        spark.createDataFrame([(str(i), at(i)) for i in range(3 * batch, 3 * batch + 5)], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        feeds.store_feed(stream, out, checkpoint, available_now=True).awaitTermination()
    before = rows(feeds.read_batches(spark, out, stream.schema))
    for name in ("1", ".1.crc"):
        (pathlib.Path(checkpoint) / "commits" / name).rename(tmp_path / f"lost{name}")
    feeds.store_feed(stream, out, checkpoint, available_now=True).awaitTermination()
    assert rows(feeds.read_batches(spark, out, stream.schema)) == before and len(before) == 8
