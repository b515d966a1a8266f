"""Structured Streaming: feeds without repeated posts and profile changes, exact for late rows.

What is known of a key lies in the state store of the stream (RocksDB), so a micro-batch looks up its own keys
only, however long the history is. Every micro-batch writes a folder of its own number, which a repeated
batch overwrites; state and folders go on together after a restart.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType, TimestampType

from gumshoe.operators.incremental import PROFILE_FIELDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return path


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows written so far, with the number of their batch."""
    numbered = StructType(list(schema.fields)).add("batch", IntegerType())
    return spark.read.schema(numbered).parquet(_folder(spark, path))


def _start(rows: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Write the rows of groups that a batch has touched, a folder for each batch."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={number}"))

    writer = rows.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def store_feed(
    posts: DataFrame, path: str, checkpoint: str, key: str = "cid", order: Sequence[str] = ("created_at",), available_now: bool = False
) -> StreamingQuery:
    """Append each post the first time its id arrives, however late or often it comes again. Within a batch the
    first by `order`, then by all its values, counts.

    The state of an id is its first row and the time of the batch that brought it. That time is the same for all
    rows of a batch, also when it is repeated, so an id leaves with the batch whose time it bears. The
    clock that starts batches must not go back.
    """
    stamped = posts.withColumn("_now", F.current_timestamp())
    first = F.min_by(F.struct(*posts.columns), F.struct("_now", *order, F.to_json(F.struct(*posts.columns)))).alias("_row")
    known = stamped.groupBy(F.col(key).alias("_key")).agg(F.min("_now").alias("_since"), first)
    return _start(known.where(F.col("_since") == F.current_timestamp()).select("_row.*"), path, checkpoint, available_now)


def read_feed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_batches(spark, path, schema).drop("batch")


def _fields(columns: Sequence[str]) -> list[str]:
    return [f for f in PROFILE_FIELDS if f in columns]


def _differing(order: Sequence[str], fields: Sequence[str], before: Column, after: Column) -> Column:
    """An entry (order..., field, old, new) for each field that differs between two snapshots."""
    entries = [F.struct(*[after[o].alias(o) for o in order], F.lit(f).alias("field"), before[f].alias("old"), after[f].alias("new")) for f in fields]
    return F.filter(F.array(*entries), lambda c: ~c["old"].eqNullSafe(c["new"]))


def store_changes(
    snapshots: DataFrame, path: str, checkpoint: str, key: str = "did", order: Sequence[str] = ("taken_at",), available_now: bool = False, chunk: str = "day"
) -> StreamingQuery:
    """Changes of accounts from their snapshots, which may arrive late.

    The state of an account and day (or other `chunk` of the first order column) is its snapshots, each once. A batch
    writes, for the days it brought a snapshot of, the changes inside the day with its first and last
    snapshot: a late one takes its place in time, and an account with very many is split by days.
    `read_changes` takes the newest of each day and compares it with the day before.
    """
    fields = _fields(snapshots.columns)
    snapshot = F.struct(*order, *[F.col(f).cast("string").alias(f) for f in fields])
    days = snapshots.groupBy(key, F.date_trunc(chunk, F.col(order[0]).cast("timestamp")).alias("_day")).agg(F.array_sort(F.collect_set(snapshot)).alias("_s"))
    steps = F.transform(F.slice("_s", 2, F.size("_s")), lambda s, i: _differing(order, fields, F.get("_s", i), s))
    told = days.select(key, "_day", F.flatten(steps).alias("changes"), F.element_at("_s", 1).alias("first"), F.element_at("_s", -1).alias("last"))
    return _start(told, path, checkpoint, available_now)


def _told(schema: StructType, key: str, order: Sequence[str]) -> StructType:
    """Columns that `store_changes` writes for snapshots of a schema."""
    ordered = StructType([schema[o] for o in order])
    snapshot = StructType(list(ordered.fields))
    for f in _fields(schema.names):
        snapshot = snapshot.add(f, StringType())
    change = StructType(list(ordered.fields)).add("field", StringType()).add("old", StringType()).add("new", StringType())
    return StructType([schema[key]]).add("_day", TimestampType()).add("changes", ArrayType(change)).add("first", snapshot).add("last", snapshot)


def read_changes(spark: SparkSession, path: str, schema: StructType, key: str = "did", order: Sequence[str] = ("taken_at",)) -> DataFrame:
    """(did, order..., field, old, new): one row for each field that differs from the snapshot before, as of the last
    batch. `schema` is that of the snapshots."""
    rows = read_batches(spark, path, _told(schema, key, order))
    newest = rows.groupBy(key, "_day").agg(F.max_by(F.struct("changes", "first", "last"), "batch").alias("d")).select(key, "_day", "d.*")
    before = F.lag("last").over(Window.partitionBy(key).orderBy("_day"))
    inside = newest.select(key, F.explode("changes").alias("c"))
    over = newest.select(key, "first", before.alias("_before")).where(F.col("_before").isNotNull())
    over = over.select(key, F.explode(_differing(order, _fields(schema.names), F.col("_before"), F.col("first"))).alias("c"))
    return inside.select(key, "c.*").unionByName(over.select(key, "c.*"))
