"""Readers of stored collections: entity tables, JSON documents, records, lists."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.functions.lists import add_prefix, split_list
from gumshoe.functions.urls import clean_url, normalize_url
from gumshoe.operators.ranking import first_by_key, ranked
from gumshoe.quest import EDGE_ENDS, KINDS, PREFIX, SCHEMAS, Quest, conform, edge_name
from gumshoe.session import shared_dir

_LISTS = ("content", "cats", "sources", "orgs", "altlabels")


def read_quest(spark: SparkSession, path: str, fmt: str = "parquet") -> Quest:
    """A stored quest: one folder (or file) per kind under `path`, as parquet, json or csv.

    Schemas are stated, so nothing is inferred and absent columns are null. In CSV, lists are
    comma text and an edge's ends are named `from` and `to`.
    """

    def load(kind: str) -> DataFrame:
        where = os.path.join(path, kind)
        if fmt != "csv":
            return conform(spark.read.schema(SCHEMAS[kind]).format(fmt).load(where), kind)
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(where)
        if kind in EDGE_ENDS:
            start, stop = EDGE_ENDS[kind][:2]
            df = df.withColumnsRenamed({"from": start, "to": stop})
        for name in _LISTS:
            if name in df.columns:
                parts = split_list(F.regexp_replace(name, r"^\[|\]$", ""), PREFIX[name] if name in PREFIX else None)
                df = df.withColumn(name, parts)
        return conform(df, kind)

    return Quest(**{kind: (lambda kind=kind: load(kind)) for kind in KINDS})


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def expand_authored(authored: DataFrame) -> Quest:
    """Authored rows to the tables they stand for.

    `authored` has `kind` (org, ident, event), `name`, `label` and, where given, comma texts
    `cats, orgs, sources`, `country, city, description, begin, end, url, docname, altlabels,
    fetchmethod` plus the options that make further rows: `ident` (an org is also an ident),
    `source` (a source of its own), `to`/`to_label` and `from`/`from_label` (an ident's
    relations, an event's link). An empty option means the row's own name. Each target table is
    one projection over the authored rows.
    """
    a = authored

    def given(name: str) -> Column:
        return _text(a, name).isNotNull()

    def own(option: str) -> Column:
        return F.when(_text(a, option) != "", _text(a, option)).otherwise(F.col("name"))

    cited = F.concat(
        F.when(given("source"), F.array(add_prefix(own("source"), "source"))).otherwise(F.array().cast("array<string>")),
        split_list(_text(a, "sources"), "source"),
    )
    base = [
        "label",
        _text(a, "description").alias("description"),
        split_list(_text(a, "cats")).alias("cats"),
        cited.alias("sources"),
        _text(a, "city").alias("city"),
        _text(a, "country").alias("country"),
        _text(a, "docname").alias("docname"),
    ]
    alternatives = F.filter(
        F.transform(F.split(F.coalesce(_text(a, "altlabels"), F.lit("")), r"\|", -1), lambda x: F.trim(x)), lambda x: x != ""
    ).alias("altlabels")
    span = [F.to_date(_text(a, c)).alias(c) for c in ("begin", "end")]
    is_org, is_ident, is_event = (F.col("kind") == k for k in ("org", "ident", "event"))

    orgs = a.where(is_org).select(add_prefix(F.col("name"), "org").alias("name"), *base, alternatives)
    method = _text(a, "fetchmethod").alias("fetchmethod")
    idents = a.where(is_ident).select(
        add_prefix(F.col("name"), "ident").alias("name"), *base, alternatives, method,
        split_list(_text(a, "orgs"), "org").alias("orgs"),
    )
    org_idents = a.where(is_org & given("ident")).select(
        add_prefix(own("ident"), "ident").alias("name"), *base, alternatives, method,
        F.array(add_prefix(F.col("name"), "org")).alias("orgs"),
    )
    events = a.where(is_event).select(
        add_prefix(F.col("name"), "event").alias("name"), *base, *span, split_list(_text(a, "orgs"), "org").alias("orgs")
    )
    source_label = F.when(is_ident, own("source")).otherwise(F.col("label"))
    source_rest = base[1:]
    sources = a.where(given("source")).select(
        add_prefix(own("source"), "source").alias("name"), source_label.alias("label"), *source_rest,
        *[_text(a, c).alias(c) for c in ("url", "link", "local", "youtube", "bsky")],
        split_list(_text(a, "orgs"), "org").alias("orgs"),
    ).withColumn("sources", F.array().cast("array<string>"))
    target, origin = add_prefix(_text(a, "to"), "ident"), add_prefix(_text(a, "from"), "ident")
    me = add_prefix(F.col("name"), "ident")

    def relation(condition: Column, start: Column, stop: Column, side: str) -> DataFrame:
        rows = a.where(is_ident & condition).select(
            F.coalesce(_text(a, side + "_label"), F.lit("")).alias("label"),
            start.alias("rfrom"), stop.alias("rto"),
            *[F.to_date(_text(a, f"{side}_{c}")).alias(c) for c in ("begin", "end")],
            split_list(_text(a, "cats")).alias("cats"), cited.alias("sources"), _text(a, "docname").alias("docname"),
        )
        return rows.withColumn("name", edge_name("relation", "rfrom", "label", "rto"))

    relations = relation(given("to"), me, target, "to").unionByName(relation(given("from"), origin, me, "from"))
    links = a.where(is_event & given("from")).select(
        F.coalesce(F.when(_text(a, "from_label") != "", _text(a, "from_label")), F.lit("ERROR")).alias("label"),
        origin.alias("lfrom"), add_prefix(F.col("name"), "event").alias("lto"),
        split_list(_text(a, "cats")).alias("cats"), cited.alias("sources"), _text(a, "docname").alias("docname"),
    ).withColumn("name", edge_name("link", "lfrom", "label", "lto"))
    empty = a.where(F.lit(False)).select("name", "label")
    found = {
        "orgs": orgs, "idents": idents.unionByName(org_idents), "events": events, "sources": sources,
        "relations": relations, "links": links, "countries": empty, "cities": empty,
        "quotes": empty.withColumn("qfrom", F.lit(None).cast("string")).withColumn("qto", F.lit(None).cast("string")),
    }
    return Quest(**{kind: conform(df, kind) for kind, df in found.items()})


# The fields of a stored source text.
TEXT_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in "title author hostname date text excerpt language tags yt_title yt_text yt_language text_orig title_orig excerpt_orig".split()
    ]
)


def stored_json(spark: SparkSession, schema: T.StructType | str, store: str | Sequence[str], cache: str | Sequence[str]) -> DataFrame:
    """One JSON document per file from two folders: (source, origin, ...fields), the store's
    document winning over the cache's. Files are found in parallel by Spark."""

    def load(paths, origin: str, priority: int) -> DataFrame:
        paths = [paths] if isinstance(paths, str) else list(paths)
        rows = spark.read.schema(schema).option("multiLine", True).json(paths)
        name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
        return rows.select(
            F.url_decode(name).alias("source"), F.lit(origin).alias("origin"), F.lit(priority).alias("_priority"), "*"
        )

    return prefer_store(load(store, "store", 0).unionByName(load(cache, "cache", 1)))


def prefer_store(rows: DataFrame) -> DataFrame:
    """Per source the row of the lowest priority number; the whole row is kept as one struct so
    that maps and nested fields pass through an aggregate with partial merging."""
    rest = [c for c in rows.columns if c not in ("source", "_priority")]
    best = rows.groupBy("source").agg(F.min_by(F.struct(*rest), "_priority").alias("_r"))
    return best.select("source", *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_text_docs(spark: SparkSession, store, cache) -> DataFrame:
    """Source texts; the text is that of the video when there is one."""
    rows = stored_json(spark, TEXT_SCHEMA, store, cache)
    return rows.withColumn("text", F.coalesce("yt_text", "text"))


_PAIRS = "array<array<string>>"
ANALYSIS_SCHEMA = (
    "mood struct<sentiment_general: string, polarite: double, subjectivite: double, "
    "scores_vader: struct<positif: double, neutre: double, negatif: double, compose: double>>, "
    f"words struct<commons: {_PAIRS}, lists: {_PAIRS}>, people struct<commons: {_PAIRS}>, "
    f"ident struct<idents: {_PAIRS}, orgs: {_PAIRS}>, countries struct<countries: {_PAIRS}>, cities struct<cities: {_PAIRS}>"
)
# Where each counter lies in a stored analysis.
COUNTERS = (
    ("words", "commons"), ("words", "lists"), ("people", "commons"), ("ident", "idents"), ("ident", "orgs"),
    ("countries", "countries"), ("cities", "cities"),
)


def read_analyses(spark: SparkSession, store, cache) -> DataFrame:
    return stored_json(spark, ANALYSIS_SCHEMA, store, cache)


def analysis_counts(analyses: DataFrame) -> DataFrame:
    """Long table (source, engine, bucket, key, n) of every counter."""
    items = [
        F.struct(F.lit(engine).alias("engine"), F.lit(bucket).alias("bucket"), F.col(f"{engine}.{bucket}").alias("pairs"))
        for engine, bucket in COUNTERS
    ]
    rows = analyses.select("source", F.explode(F.array(*items)).alias("c"))
    pairs = rows.select("source", "c.engine", "c.bucket", F.explode("c.pairs").alias("p"))
    return pairs.select(
        "source", "engine", "bucket", F.get("p", F.lit(0)).alias("key"), F.get("p", F.lit(1)).cast("bigint").alias("n")
    )


def scalar_or_array(json: Column, path: str) -> Column:
    """A JSON value that is a string or a list of strings, as a list."""
    raw = F.get_json_object(json, path)
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def read_whois(records: DataFrame, json: str = "json") -> DataFrame:
    """Adds domain, registrar, creation, updated and expiration to rows with a raw whois
    document; each field may be a value or a list, whose first counts. Failed look-ups are null."""
    doc = F.col(json)

    def first(field: str) -> Column:
        return F.get(scalar_or_array(doc, f"$.whois.{field}"), F.lit(0))

    return records.withColumns(
        {
            "domain": F.lower(first("domain_name")),
            "registrar": first("registrar"),
            "creation": first("creation_date"),
            "updated": first("updated_date"),
            "expiration": first("expiration_date"),
            "name_servers": scalar_or_array(doc, "$.whois.name_servers"),
        }
    )


VIDEO = (
    "struct<url: string, title: string, publish_date: string, description: string, thumbnail_url: string, "
    "views: bigint, keywords: array<string>, key_moments: array<string>>"
)
CHANNEL_SCHEMA = f"limit int, with_description boolean, videos map<string, {VIDEO}>"


def parse_channels(rows: DataFrame, json: str = "json") -> DataFrame:
    """(channel, limit, videos) from raw channel documents."""
    return rows.withColumn("_c", F.from_json(json, CHANNEL_SCHEMA)).select("channel", "_c.limit", "_c.videos")


def explode_videos(channels: DataFrame) -> DataFrame:
    """One row per video in feed order: id after `watch?v=`, missing address or title `None`."""
    rows = channels.select("channel", "limit", F.posexplode(F.map_values("videos")).alias("pos", "v"))
    video_id = F.regexp_extract("v.url", r"watch\?v=(.*)$", 1)
    return rows.select(
        "channel", "limit", "pos",
        F.when(F.col("v.url").isNull(), "None").otherwise(video_id).alias("video_id"),
        F.coalesce("v.url", F.lit("None")).alias("url"),
        F.coalesce("v.title", F.lit("None")).alias("title"),
        F.col("v.publish_date").alias("publish_date"),
        F.col("v.description").alias("description"),
        F.col("v.views").alias("views"),
        F.coalesce("v.keywords", F.array().cast("array<string>")).alias("keywords"),
    )


_PERSON = "struct<did: string, handle: string, display_name: string, created_at: string, indexed_at: string>"
_POST = (
    "struct<cid: string, created_at: string, text: string, is_reply: boolean, reply_did: string, reply_cid: string, "
    "reply_created_at: string, reply_text: string, root_did: string, root_cid: string, root_created_at: string, root_text: string>"
)
_DIFF = (
    "struct<handle: string, display_name: string, description: string, followers_count: bigint, "
    "follows_count: bigint, posts_count: bigint>"
)
ACCOUNT_SCHEMA = (
    "profile struct<did: string, handle: string, display_name: string, description: string, created_at: string, "
    "indexed_at: string, followers_count: bigint, follows_count: bigint, posts_count: bigint>, "
    f"feeds map<string, {_POST}>, followers map<string, {_PERSON}>, follows map<string, {_PERSON}>, diff map<string, {_DIFF}>"
)


def parse_accounts(rows: DataFrame, json: str = "json") -> DataFrame:
    return rows.withColumn("_a", F.from_json(json, ACCOUNT_SCHEMA)).select(F.col("_a.profile.did").alias("did"), "_a.*")


def explode_account(accounts: DataFrame) -> dict[str, DataFrame]:
    """The five tables of stored accounts: profile, posts, followers, follows, diff."""

    def entries(column: str, key: str) -> DataFrame:
        rows = accounts.select(F.col("did").alias("did"), F.explode(column).alias(key, "v"))
        fields = [c for c in rows.select("v.*").columns if c != "did" and c != key]
        return rows.select("did", key, *[F.col(f"v.{c}").alias(c) for c in fields])

    return {
        "profile": accounts.select("profile.*"),
        "posts": entries("feeds", "cid"),
        "followers": entries("followers", "follower"),
        "follows": entries("follows", "followed"),
        "diff": entries("diff", "epoch").withColumn("at", F.timestamp_seconds(F.col("epoch").cast("double"))),
    }


def read_wordlists(spark: SparkSession, folder: str, cats: Sequence[str] = (), kind: str = "__all__") -> DataFrame:
    """Distinct (list, word) of comma-separated lines, trimmed: the common list of a kind and
    one list per category. Kinds: __all__, __badwords__, __badpeoples__, __badcountries__."""
    suffix = "" if kind == "__all__" else kind.rstrip("_")
    names = [kind, *[c + suffix for c in cats]]
    lines = [spark.read.text(path).select(F.lit(n).alias("list"), "value") for n in names if (path := _plain_file(spark, f"{folder}/{n}.txt"))]
    found = reduce(DataFrame.unionByName, lines) if lines else spark.createDataFrame([], "list string, value string")
    return wordlists(found, names)


def _plain_file(spark: SparkSession, path: str) -> str | None:
    """A file that Spark's readers see, None when absent. They skip names that begin with an underscore, as these
    lists do; such a file is copied, as a stream, to a plain name in the shared folder."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    where = hadoop.Path(path)
    fs = where.getFileSystem(conf)
    if not fs.exists(where):
        return None
    if not where.getName().startswith(("_", ".")):
        return path
    plain = hadoop.Path(f"{shared_dir(spark)}/lists/{uuid.uuid4().hex}/list.txt")
    hadoop.FileUtil.copy(fs, where, plain.getFileSystem(conf), plain, False, conf)
    return plain.toString()


def wordlists(lines: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(list, word) from (list, value) lines, of the named lists or of all."""
    chosen = lines if names is None else lines.where(F.col("list").isin(*names))
    words = chosen.select("list", F.explode(F.split("value", ",", -1)).alias("word"))
    return words.select("list", F.trim("word").alias("word")).where(F.col("word") != "").distinct()


def read_url_list(spark: SparkSession, path: str, max_refs: int | None = None) -> DataFrame:
    """References of a text file with one address per line. The file is read in splits; a line's number is
    its rank by the place of its split and its place there."""
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_place")
    )
    return url_list(ranked(lines, [F.asc("_split"), F.asc("_place")], name="line_no").select("line_no", "line"), max_refs)


def url_list(lines: DataFrame, max_refs: int | None = None) -> DataFrame:
    """(id, url) from (line_no, line): blanks and comments skipped, query and fragment dropped,
    http(s) only, the first line per normalised address."""
    rows = lines.select("line_no", F.trim("line").alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.select("line_no", clean_url(F.col("line")).alias("url"))
    rows = rows.where(F.col("url").startswith("http://") | F.col("url").startswith("https://"))
    firsts = first_by_key(rows.withColumn("_norm", normalize_url(F.col("url"))), ["_norm"], ["line_no"])
    out = firsts.select(F.concat(F.lit("file-"), F.col("line_no").cast("string")).alias("id"), "line_no", "url")
    out = out.orderBy("line_no").limit(max_refs) if max_refs else out
    return out.select("id", "url")
