"""The registered queries of this subpackage: thin, over whole tables, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.llm import html_text, language, toxicity
from gumshoe.llm.bpe import decode_documents, encode_documents
from gumshoe.llm.common import table
from gumshoe.llm.lexical import rank_documents
from gumshoe.llm.minhash import link_documents
from gumshoe.llm.nearest import search_nearest
from gumshoe.llm.packing import Limits, pack_documents
from gumshoe.llm.runs import Words, periodic_runs, split_words
from gumshoe.llm.sharding import shard_documents
from gumshoe.llm.token_counts import count_tokens
from gumshoe.llm.vector_links import link_vectors
from gumshoe.llm.warc import archive_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), percent=85)


@query
def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.fit_on(pages)).select("page_id", "url", "text", "n_chars")


@query
def op3_link_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), least=0.98)[0]


@query
def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), Limits(1024, 256, 1024))


@query
def op5_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = toxicity.id_remainder("doc_id", 3)
    model = language.fit_on(docs.filter(remainder != 1))
    return language.identify(docs, model).withColumn("held_out", F.coalesce(remainder == 1, F.lit(False)))


@query
def op6_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = toxicity.id_remainder("doc_id", 5)
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels").filter(remainder != 0))
    scored = toxicity.score_documents(docs, model).select("doc_id", "score", "predicted")
    return scored.withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))


@query
def op7_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode_documents(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op9_search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)[0]


@query
def op10_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


@query
def op11_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op11_archive_pages"] = """
    with payloads as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
    groups as (select payload_digest, payload_bytes, max(page_id) as last from payloads where payload_bytes >= 1000 group by 1, 2)
    select page_id, payload_bytes::bigint as payload_bytes, payload_digest, case when page_id < last then 'revisit' else 'response' end as record_type,
        case when page_id < last then last end as refers_to
    from payloads left join groups using (payload_digest, payload_bytes)"""


@query
def op12_rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"""
ORACLE["op12_rank_documents"] = f"""
    with words as (select doc_id, {_TERMS} from documents),
    lengths as (select doc_id, count(*) as n from words group by 1),
    totals as (select count(*) as docs, sum(n)::bigint as total from lengths),
    postings as (select doc_id, term, count(*) as tf from words group by 1, 2),
    wanted as (select distinct item_id, {_TERMS} from benchmark),
    weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from postings, totals
        where term in (select term from wanted) group by 1),
    parts as (select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) as part
        from postings join weights using (term) join lengths using (doc_id), totals),
    scores as (select item_id, doc_id, sum(part)::bigint as score from wanted join parts using (term) group by 1, 2),
    ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scores where score > 0)
    select * from ranked where rank <= 50"""


def with_periods(doc_id: int | None, text: bytes) -> Words:
    """Words of a text; from some place on those of one document in ten, chosen by its id, repeat."""
    words = split_words(doc_id, text)
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _longer(x: Column, y: Column) -> Column:
    """Order of runs: most periods first, exactly, then by start and period."""
    sides = y["length"] * x["period"] - x["length"] * y["period"], x["start"] - y["start"], x["period"] - y["period"]
    return F.signum(F.when(sides[0] != 0, sides[0]).when(sides[1] != 0, sides[1]).otherwise(sides[2])).cast("int")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), with_periods)
    best = F.try_element_at(F.array_sort("runs", _longer), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


def load():
    return QUERIES, ORACLE
