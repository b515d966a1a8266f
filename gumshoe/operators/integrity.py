"""Is the collection whole? Missing, orphaned, doubled, empty and wrong-language documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD_SIZE = 20


def list_files(spark: SparkSession, *paths: str, store: str) -> DataFrame:
    """(store, name, size, modified_at) of the files under the paths; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return rows.select(
        F.lit(store).alias("store"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    )


def check_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status, store_size, cache_size): `duplicate` when both stores hold a source's
    document, `missing` when none does, `orphan` when no source asks for it, else `ok`.

    `sources` has the expected file names, `files` (store, name, size) with the stores `store`
    and `cache`. One aggregation of the listing, then one full outer join.
    """
    held = files.groupBy("name").agg(
        F.max(F.when(F.col("store") == "store", F.col("size"))).alias("store_size"),
        F.max(F.when(F.col("store") == "cache", F.col("size"))).alias("cache_size"),
    )
    wanted = sources.select("name").distinct().withColumn("_wanted", F.lit(True))
    both = wanted.join(held, "name", "full")
    status = (
        F.when(F.col("_wanted").isNull(), "orphan")
        .when(F.col("store_size").isNotNull() & F.col("cache_size").isNotNull(), "duplicate")
        .when(F.col("store_size").isNull() & F.col("cache_size").isNull(), "missing")
        .otherwise("ok")
    )
    return both.select("name", status.alias("status"), "store_size", "cache_size")


def check_bad_size(files: DataFrame, size: int = BAD_SIZE, failed: DataFrame | None = None) -> DataFrame:
    """Files under `size` bytes. `failed` (store, name) lists texts already known bad: their
    analyses are not reported again."""
    bad = files.where(F.col("size") < size)
    return bad if failed is None else bad.join(failed, ["store", "name"], "left_anti")


def check_translation(docs: DataFrame, target: str, language: Column | str, text: str = "text", original: str | None = None) -> DataFrame:
    """Documents whose text is empty (language `unknown`) or not in the target language. A null
    text without an original never was fetched, and is no translation fault."""
    language = F.col(language) if isinstance(language, str) else language
    empty = F.coalesce(text, F.lit("")) == ""
    rows = docs
    if original:
        rows = rows.where(F.col(text).isNotNull() | F.col(original).isNotNull())
    found = F.when(empty, "unknown").otherwise(language)
    return rows.withColumn("found_lang", found).where(~F.col("found_lang").eqNullSafe(F.lit(target)))


def duplicate_urls(sources: DataFrame) -> DataFrame:
    """(url, name, docname) of every source sharing its address with another. The counts are
    merged before the shuffle, so a shared address with many holders stays cheap."""
    urls = sources.where(F.col("url").isNotNull())
    shared = urls.groupBy("url").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return urls.join(shared, "url", "left_semi").select("url", "name", "docname")


def duplicate_addresses(sources: DataFrame) -> DataFrame:
    """(address, name, first): links and urls in one namespace, each later holder with the first
    one, in name order."""
    rows = sources.select(
        "name",
        F.explode(F.filter(F.array(
            F.struct(F.lit(0).alias("rank"), F.col("link").alias("address")),
            F.struct(F.lit(1).alias("rank"), F.col("url").alias("address")),
        ), lambda a: a["address"].isNotNull())).alias("a"),
    ).select("name", "a.rank", "a.address")
    firsts = rows.groupBy("address").agg(F.min(F.struct("name", "rank")).alias("_first"))
    joined = rows.join(firsts, "address").where(F.struct("name", "rank") != F.col("_first"))
    return joined.select("address", "name", F.col("_first.name").alias("first"))


def duplicate_keep(duplicates: DataFrame, rule: str = "smaller") -> DataFrame:
    """Which copy of each duplicate to drop: the smaller one (`smaller`, ties drop the stored
    one), or the one outside `store` / `cache`. A report; nothing is deleted."""
    drop = {
        "smaller": F.when(F.col("store_size") <= F.col("cache_size"), "store").otherwise("cache"),
        "store": F.lit("cache"),
        "cache": F.lit("store"),
    }[rule]
    return duplicates.where(F.col("status") == "duplicate").withColumn("drop", drop)


def dump_kind(df: DataFrame) -> DataFrame:
    """(name, json) of every row, keys in schema order, nulls left out."""
    return df.select("name", F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("json"))
