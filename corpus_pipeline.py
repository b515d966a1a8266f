"""Documents to training sequences: toxic, undetermined and repeated documents go, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gumshoe.llm import language, toxicity
from gumshoe.llm.common import Scratch, table
from gumshoe.llm.minhash import link_documents
from gumshoe.llm.packing import Limits, pack_documents

#: No stage can be told in SQL: two apply fitted models, two work on hashes of words and token ids.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. It learns from the labelled ones among them
    whose id leaves a remainder other than 0, as in the query of that operator."""
    labels = table(spark, sf_dir, "labels").filter(toxicity.id_remainder("doc_id", 5) != 0)
    return toxicity.clean_documents(docs, toxicity.fit_on(docs, labels))


def drop_undetermined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones among them; null and letterless
    texts, letter junk, texts of other languages and texts mixed of several go."""
    return language.determined_documents(docs, language.fit_on(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, and one row of an id that is
    repeated; rows without an id stay. Ids are dealt out by their hash, so no group meets in one task."""
    links = link_documents(docs, percent=80)
    kept = links.filter("kept and doc_id is not null").select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
    return one.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), Limits(1024, 256, 1024))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_undetermined),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
