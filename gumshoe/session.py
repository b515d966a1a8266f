"""Session helpers: a tuned local session, the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "gumshoe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tested with; `conf` overrides any of them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: there driver and executors share
    one machine; it goes when the process ends. On a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="gumshoe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def file_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or of all files below a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


#: While a result of large joins is written: shuffle files go when the write ends, since what was written needs them no
#: more; a join whose smaller side has at most so many bytes in every partition hashes that side instead of sorting both.
_JOINS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def pin(df: DataFrame, joins: bool = False) -> DataFrame:
    """Write a result that several later steps read to the shared folder and go on from there.

    Each reader would otherwise recompute it; a lost executor then costs no replay, a range
    partitioning keeps its bounds, and the optimizer sees the true size. `joins=True` is for results
    of large joins: none of their shuffle files outlive the write.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "pinned", uuid.uuid4().hex)
    settings = _JOINS if joins else {}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)
