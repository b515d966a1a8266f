"""What the operators share: written intermediates, batches of texts, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.session import shared_dir

TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}
#: Rows a Python task works on at a time.
BATCH_ROWS = 512


#: Rows that Spark hands to a Python task at a time, so that texts in transit take little memory.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch for the session, as whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the folder that all executors share, so that a lost executor costs no
    replay and a plan does not grow. `drop` deletes one as soon as no later step reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
        self.count = 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = os.path.join(self.root, str(self.count))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def lowest_hashes(rows: DataFrame, most: int, count: int) -> pa.Table:
    """About the `most` of `count` rows whose id's hash is lowest, in its order. A limit on the hash chooses
    them, so each task sends its share of them and none sorts its rows."""
    hashed = rows.withColumn("_hash", F.xxhash64("id"))
    if count > most:
        hashed = hashed.filter(F.col("_hash") < -(2**63) + int(2**64 * most / count))
    return hashed.toArrow().sort_by([("_hash", "ascending"), ("id", "ascending")]).drop_columns("_hash")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, barrier: bool = False) -> DataFrame:
    """Run `make()` once in each task and its result on each bounded batch of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                out = fn(batch.slice(at, BATCH_ROWS))
                if out is not None:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a batch; null is empty."""
    return [x or "" for x in column.to_pylist()]


class Recent(dict):
    """Values by key, made when first asked for. Beyond a fixed number the keys met since the last time
    become the older generation, from which those still in use come back; the rest are forgotten."""

    SIZE = 250_000

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.SIZE:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest node each node of `edges` (a, b) reaches: (node, component), without isolated nodes.

    Alternating large-star and small-star steps: each node's edges are re-hung on the smallest
    neighbour, as a partial-merging minimum and an equi join. A hub's edges are only joined with its
    one minimum, so adaptive skew handling can split them; no group is gathered.
    """
    down = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = scratch.keep(edges.filter("a <> b").select(*down).distinct())
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").select(*down).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").select(*down).distinct())
        scratch.drop(edges)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
