"""The search index: documents, terms, postings."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.arrays import unnest
from gumshoe.functions.lists import joined
from gumshoe.functions.stemming import stem_word, with_stems
from gumshoe.functions.text import fold_accents, sanitize_description, sanitize_label, tokens
from gumshoe.operators.attributes import effective_cats, effective_country, source_url
from gumshoe.quest import Quest
from gumshoe.session import pin

# The weight of each prefixed field copy.
FIELD_WEIGHTS = {"title": 3, "description": 2, "content": 2, "name": 1, "altlabels": 2, "author": 1}
DOC_COLUMNS = ("doc", "type", "title", "description", "cats", "country", "url", "begin", "altlabels")


def build_docs(quest: Quest, texts: DataFrame | None = None, kinds=("countries", "cities", "orgs", "idents", "events")) -> DataFrame:
    """One search document per entity: stored values plus the text to index.

    Source texts join per citation; an entity's body is the texts of the sources its author
    listed, in list order.
    """
    parts = []
    for kind in kinds:
        rows = effective_country(effective_cats(quest.table(kind), quest, kind), quest, inherit=kind == "idents")
        parts.append(
            rows.select(
                F.col("name").alias("doc"),
                F.lit(kind).alias("type"),
                sanitize_label(F.col("label")).alias("title"),
                sanitize_description(F.col("description"), F.col("label")).alias("description"),
                "cats",
                "country",
                (F.col("begin") if "begin" in rows.columns else F.lit(None).cast("date")).alias("begin"),
                (F.array_join("altlabels", "|") if "altlabels" in rows.columns else F.lit(None).cast("string")).alias("altlabels"),
                F.array_join("content", " ").alias("content"),
                "sources",
            )
        )
    docs = reduce(DataFrame.unionByName, parts)
    # Texts are gathered once for every list of sources that occurs, never once for every entity that has it.
    cited = docs.select("doc", F.posexplode("sources").alias("_pos", "_source"))
    lists = pin(cited.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("_pos", "_source"))).alias("_list")), joins=True)
    bodies = _bodies(lists.select("_list").distinct(), quest, texts)
    return (
        docs.drop("sources").join(lists, "doc", "left").join(bodies, "_list", "left").drop("_list")
        .withColumn("url", F.try_element_at("urls", F.lit(1)))
    )


def _bodies(lists: DataFrame, quest: Quest, texts: DataFrame | None) -> DataFrame:
    """(_list, urls, data): addresses and texts of the sources of a list of (_pos, _source), in its order."""
    cited = lists.select("_list", F.explode("_list").alias("_c")).select("_list", "_c._pos", F.col("_c._source").alias("source"))
    cited = cited.join(quest.sources.select(F.col("name").alias("source"), source_url(("url", "link", "youtube", "bsky")).alias("_url")), "source", "left")
    if texts is not None:
        cited = cited.join(texts.select("source", F.col("text").alias("_text")), "source", "left")
    else:
        cited = cited.withColumn("_text", F.lit(None).cast("string"))
    # At most the sources an author listed for one entity.
    return cited.groupBy("_list").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_url", "_text"))).alias("_s")
    ).select("_list", F.filter("_s._url", lambda u: u.isNotNull()).alias("urls"), F.array_join("_s._text", "\n").alias("data"))


def remaining_docs(quest: Quest, texts: DataFrame, *kinds: str) -> DataFrame:
    """Documents for the sources no indexed entity cites."""
    from gumshoe.operators.linked import remaining_sources

    rows = remaining_sources(quest, *kinds).join(texts.select(F.col("source").alias("name"), "text"), "name", "left")
    return rows.select(
        F.col("name").alias("doc"),
        F.lit("sources").alias("type"),
        sanitize_label(F.col("label")).alias("title"),
        sanitize_description(F.col("description"), F.col("label")).alias("description"),
        "cats",
        "country",
        F.lit(None).cast("date").alias("begin"),
        F.lit(None).cast("string").alias("altlabels"),
        F.lit("").alias("content"),
        F.filter(F.array(source_url(("url", "link", "youtube", "bsky"))), lambda u: u.isNotNull()).alias("urls"),
        F.col("text").alias("data"),
        source_url(("url", "link", "youtube", "bsky")).alias("url"),
    )


def video_docs(channels: DataFrame, videos: DataFrame) -> DataFrame:
    """Documents of channels and their videos, a video titled `channel : video`."""
    own = channels.select(
        F.col("name").alias("doc"), F.lit("ytchannel").alias("type"), F.col("label").alias("title"),
        F.col("description").alias("description"), "url", F.lit(None).cast("string").alias("data"),
    )
    named = channels.select(F.col("name").alias("channel"), F.col("label").alias("_channel_label"))
    clips = videos.join(named, "channel").select(
        F.concat_ws("#", "channel", "video_id").alias("doc"),
        F.lit("ytvideo").alias("type"),
        F.concat_ws(" : ", "_channel_label", "title").alias("title"),
        F.coalesce("description", "title").alias("description"),
        "url",
        F.concat_ws("\n", "title", "description", F.array_join("keywords", " ")).alias("data"),
    )
    return own.unionByName(clips)


def fields(docs: DataFrame, weighted: bool = False) -> DataFrame:
    """(doc, field, weight, text): every field as free text. `weighted=True` applies the field
    weights, which no user query reaches by default."""
    names = [n for n in ("title", "description", "content", "altlabels", "data") if n in docs.columns]
    items = [
        F.struct(
            F.lit(n).alias("field"),
            F.lit(FIELD_WEIGHTS.get(n, 1) if weighted else 1).alias("weight"),
            F.col(n).alias("text"),
        )
        for n in [*names, "doc"]
    ]
    rows = docs.select("doc", F.explode(F.array(*items)).alias("f")).select("doc", "f.field", "f.weight", "f.text")
    return rows.where(F.coalesce("text", F.lit("")) != "")


def search_tokens(text: Column) -> Column:
    """Accent-folded tokens."""
    return tokens(fold_accents(text))


def term_counts(field_rows: DataFrame) -> DataFrame:
    """(doc, term, tf): counted per document in each task before the shuffle."""
    split = field_rows.select("doc", "weight", search_tokens(F.col("text")).alias("_t"))
    words = unnest(split, "_t", "term", "doc", "weight")
    return words.groupBy("doc", "term").agg(F.sum("weight").alias("tf"))


def index_terms(field_rows: DataFrame) -> DataFrame:
    """Postings (doc, term, tf, doc_len); the length is the sum of the counts."""
    counts = term_counts(field_rows)
    # From the same counts, so that the texts are split once and the shuffle is reused.
    lengths = counts.groupBy("doc").agg(F.sum("tf").alias("doc_len"))
    return counts.join(lengths, "doc")


#: Tokens that are counted at a time.
COUNTED = 1_000_000


def counted_rows(docs: DataFrame, weighted: bool, *keep: Column | str) -> DataFrame:
    """(doc, keep..., term, tf, doc_len) of documents that have one row each: `term_counts` and the lengths, counted where
    the texts are read, so that no word is shuffled. A document's rows follow one another, sorted by term."""
    names = [n for n in ("title", "description", "content", "altlabels", "data") if n in docs.columns] + ["doc"]
    weights = np.array([FIELD_WEIGHTS.get(n, 1) if weighted else 1 for n in names])
    # A projection of its own, so that no text is split twice.
    split = docs.select("doc", *keep, *[search_tokens(F.coalesce(n, F.lit(""))).alias(f"_{n}") for n in names])
    rest = split.columns[: -len(names)]
    split = split.select(*rest, F.array(*[F.size(f"_{n}") for n in names]).alias("_n"), F.concat(*[f"_{n}" for n in names]).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(len(rest)).flatten()).reshape(-1, len(names))
            until = np.cumsum(sizes.sum(axis=1))
            at = 0
            while at < batch.num_rows:
                end = max(int(np.searchsorted(until, (until[at - 1] if at else 0) + COUNTED, side="right")), at + 1)
                yield _counted(batch.slice(at, end - at), rest, sizes[at:end], weights)
                at = end

    fixed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in split.select(*rest).schema.fields)
    return split.mapInArrow(run, f"{fixed}, term string, tf bigint, doc_len bigint")


def _counted(part: pa.RecordBatch, rest: list[str], sizes: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    words = part.column(len(rest) + 1).flatten().dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[np.asarray(order)] = np.arange(len(order))
    row = np.repeat(np.arange(len(sizes)), sizes.sum(axis=1))
    worth = np.repeat(np.tile(weights, len(sizes)), sizes.ravel())
    pairs, which = np.unique(row * max(len(order), 1) + rank[np.asarray(words.indices)], return_inverse=True)
    # Sums stay far below 2 ** 53, so the weights are exact.
    tf = np.bincount(which, worth, len(pairs)).astype(np.int64)
    length = np.bincount(row, worth, len(sizes)).astype(np.int64)
    row, term = np.divmod(pairs, max(len(order), 1))
    place = pa.array(row)
    columns = [part.column(i).take(place) for i in range(len(rest))]
    return pa.RecordBatch.from_arrays([*columns, words.dictionary.take(order).take(pa.array(term)), pa.array(tf), pa.array(length[row])], names=[*rest, "term", "tf", "doc_len"])


#: Postings of one file, and of one of the at most SPREAD files of a small table.
POSTINGS_PER_FILE, SPREAD_FILE, SPREAD = 4_000_000, 250_000, 64


# BM25 constants and the floor of the length norm.
K1, B, MIN_NORM = 1.2, 0.3, 0.5
#: Terms that a stemmed search names.
NAMED = 1000
#: Levels of a term's postings by what they add to a score.
LEVELS = 16


def saturation(tf: Column | float, doc_len: Column | float, average: Column | float) -> Column:
    """What a posting adds to a score for each unit of its term's weight, below K1 + 1: more with each occurrence,
    less in longer documents."""
    norm = F.greatest(doc_len / average, F.lit(MIN_NORM)) if isinstance(doc_len, Column) else max(doc_len / average, MIN_NORM)
    return tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * norm))


class SearchIndex:
    """A stored index: documents, postings by term, terms by stem, vocabulary, spellings, lengths, statistics.

    Postings, spellings and vocabulary lie sorted in files by ranges of the term, so a query reads the row
    groups of its terms and a term that most documents hold spans as many files as it needs. Within a term
    postings lie by levels of what they add to a score, whose counts and bounds are stored beside them.
    `by` names a column (a peer) that has statistics of its own.

    The tables consist of segments: `write_index` writes the first, `update_index` adds one for each delta with the
    new documents and the names of those that are dead in the segments before. Readers leave dead documents out;
    counts and sums have rows that take off what the dead ones had. A segment counts once it is listed
    under `segments`, which is written last; one that was broken off is written again.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.segments = sorted(r["segment"] for r in spark.read.schema("segment int").parquet(os.path.join(path, "segments")).collect())

    def table(self, name: str, first: int = 0) -> DataFrame:
        """All rows of the listed segments from one on, with the column `segment` where there are several."""
        folder = os.path.join(self.path, name)
        if len(self.segments) == 1:
            return self.spark.read.parquet(os.path.join(folder, f"segment={self.segments[0]}"))
        rows = self.spark.read.option("basePath", folder).parquet(*[os.path.join(folder, f"segment={n}") for n in self.segments[first:]])
        return rows.withColumn("segment", F.col("segment").cast("int"))

    def live(self, name: str) -> DataFrame:
        """Rows of documents that no later segment deleted or replaced. `stems` are postings by stem, (doc, doc_len, by,
        stem, tf)."""
        if name == "stems":
            return self._by_stem(self.live("postings"), self.table("stemmed"))
        rows = self.table(name)
        if len(self.segments) == 1:
            return rows
        dead = self.table("dead", 1).groupBy(F.col("doc").alias("_dead")).agg(F.max("segment").alias("_since"))
        return rows.join(dead, (F.col("doc") == F.col("_dead")) & (F.col("segment") < F.col("_since")), "left_anti").drop("segment")

    def _summed(self, name: str, keys: list[str], *sums: str) -> DataFrame:
        """Counts over all segments, what the dead had taken off; keys without any left are out."""
        rows = self.table(name)
        if len(self.segments) == 1:
            return rows
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(sums[0]) > 0)

    def docs(self) -> DataFrame:
        return self.live("docs")

    def hits(self, words: list[str], stemmed: bool = False, language: str = "en") -> DataFrame:
        """Postings (doc, term, tf, doc_len, ...) of the words only, pruned by their range. `stemmed` meets the
        stems of all documents, each taken in its own language, with those of the words in `language`."""
        if not stemmed:
            return self.live("postings").where(F.col("term").isin(*words))
        wanted = [stem_word(w, language) for w in words]
        stemmed = self.table("stemmed").where(F.col("stem").isin(*wanted))
        postings = self.live("postings")
        # The terms of a few stems, named so that only their postings are read; more are joined.
        terms = [r["term"] for r in stemmed.select("term").distinct().limit(NAMED + 1).collect()]
        if len(terms) <= NAMED:
            postings = postings.where(F.col("term").isin(*terms))
        return self._by_stem(postings, stemmed).withColumnRenamed("stem", "term")

    def _by_stem(self, postings: DataFrame, stemmed: DataFrame) -> DataFrame:
        rows = postings.join(stemmed.select("stem", "lang", "term").distinct(), ["term", "lang"])
        about = [c for c in postings.columns if c not in ("term", "lang", "level", "tf", "segment")]
        return rows.groupBy(*about, "stem").agg(F.sum("tf").alias("tf"))

    def hits_of(self, terms: DataFrame) -> DataFrame:
        """The same for any number of terms (term)."""
        return self.live("postings").join(terms, "term", "left_semi")

    def stats(self) -> DataFrame:
        """(n, avg): documents and their mean length."""
        return self.table("stats").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg"))

    def group_stats(self) -> DataFrame:
        """(by, n, avg) for the index's groups."""
        sums = self.table("group_stats")
        by = next(c for c in sums.columns if c not in ("n", "words", "segment"))
        return sums.groupBy(by).agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avg")).where("n > 0")

    def vocabulary(self) -> DataFrame:
        """(term, df)"""
        return self._summed("vocabulary", ["term"], "df")

    def spelling(self) -> DataFrame:
        """(variant, term, df): see `spelling_variants`."""
        return self._summed("spelling", ["variant", "term"], "df")


def _write_segment(docs: DataFrame, path: str, number: int, weighted: bool, by: str | None, language: str, dead: DataFrame | None = None) -> None:
    """Store the tables of documents; `dead` (doc, doc_len, by, lang, term) lists the terms that go."""
    spark, group = docs.sparkSession, [by] if by else []

    def keep(rows: DataFrame, name: str) -> DataFrame:
        folder = os.path.join(path, name, f"segment={number}")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)
        return spark.read.schema(rows.schema).parquet(folder)

    def in_ranges(table: DataFrame, *order: Column | str) -> DataFrame:
        return table.repartitionByRange(files, *order).sortWithinPartitions(*order)

    # By document in each file, and so are the tables of what a few documents hold.
    stored = keep(docs.sortWithinPartitions("doc"), "docs")
    spoken = (F.coalesce("lang", F.lit(language)) if "lang" in stored.columns else F.lit(language)).alias("lang")
    about = ["doc", "doc_len", *group, "lang"]
    repeated = pin(stored.groupBy("doc").count().where("count > 1 and doc is not null").select("doc"))
    if repeated.isEmpty():
        counts = keep(counted_rows(stored.where("doc is not null"), weighted, *group, spoken).select("term", "tf", *about), "counts")
        rows, lengths = counts, counts.select(about).distinct()
    else:
        # Rows of one name are one document, which has a length for each of them.
        single, several = (stored.join(repeated, "doc", how) for how in ("left_anti", "left_semi"))
        alone = counted_rows(single.where("doc is not null"), weighted, *group, spoken).select("term", "tf", *about)
        merged = term_counts(fields(several, weighted))
        nothing = [F.lit(None).cast(alone.schema[c].dataType).alias(c) for c in about[1:]]
        counts = keep(alone.unionByName(merged.select("term", F.col("tf").cast("bigint").alias("tf"), "doc", *nothing)), "counts")
        whole, parts = counts.where("doc_len is not null"), counts.where("doc_len is null").select("term", "tf", "doc")
        long = parts.groupBy("doc").agg(F.sum("tf").alias("doc_len")).join(several.select("doc", *group, spoken), "doc")
        rows = whole.unionByName(parts.join(long, "doc"))
        lengths = whole.select(about).distinct().unionByName(long)
    total = counts.count()
    files = max(-(-total // POSTINGS_PER_FILE), min(SPREAD, -(-total // SPREAD_FILE)), 1)
    lengths = keep(lengths.sortWithinPartitions("doc"), "lengths")
    keep(word_places(stored), "places")
    # Sorted by term, the postings are what the other tables are made of. What belongs to the document moves as one value.
    average = lengths.agg(F.avg("doc_len")).scalar()
    level = F.floor(LEVELS * saturation(F.col("tf"), F.col("doc_len"), average) / (K1 + 1)).cast("int").alias("level")
    moved = in_ranges(rows.select("term", level, "tf", F.struct(*about).alias("d")), "term", "level", F.col("d.doc"))
    postings = keep(moved.select("term", "level", "tf", "d.*"), "postings")
    levels = postings.groupBy("term", "level").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("most_tf"), F.min("doc_len").alias("least_len"))
    keep(levels.sortWithinPartitions("term", "level"), "levels")
    terms = keep(vocabulary(postings), "terms")
    keep(in_ranges(with_stems(terms).select("stem", "lang", "term"), "stem", "lang", "term"), "stemmed")

    measured = lengths.select(*group, F.lit(1).alias("n"), F.col("doc_len").alias("words"))
    words = terms.select("term", "df")
    if dead is not None:
        gone = dead.select("doc", "doc_len", *group).distinct()
        measured = measured.unionByName(gone.select(*group, F.lit(-1).alias("n"), (-F.col("doc_len")).alias("words")))
        words = words.unionByName(dead.groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
    sums = F.sum("n").cast("bigint").alias("n"), F.sum("words").cast("bigint").alias("words")
    keep(measured.groupBy(*group).agg(*sums) if by else measured.agg(*[F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(sums, ("n", "words"))]), "group_stats" if by else "stats")
    if by:
        keep(measured.agg(*[F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(sums, ("n", "words"))]), "stats")
    words = keep(in_ranges(words.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "term"), "vocabulary")
    keep(in_ranges(spelling_variants(words), "variant", "term"), "spelling")


def _list_segment(spark, path: str, number: int) -> None:
    listed = spark.createDataFrame([(number,)], "segment int").coalesce(1)
    listed.write.mode("overwrite").parquet(os.path.join(path, "segments", f"number={number}"))


def write_index(docs: DataFrame, path: str, weighted: bool = False, by: str | None = None, language: str = "en") -> SearchIndex:
    """Store the index of (doc, ...) under a new folder. Every text is split once. Stems are found for each distinct
    term and language and joined; a document without a `lang` of its own is in `language`."""
    _write_segment(docs, path, 0, weighted, by, language)
    _list_segment(docs.sparkSession, path, 0)
    return SearchIndex(docs.sparkSession, path)


def update_index(index: SearchIndex, changes: DataFrame, docs: DataFrame, weighted: bool = False, by: str | None = None, language: str = "en") -> SearchIndex:
    """Apply the actions (doc, action) of `incr_index`: insert, update, delete; others change nothing.

    One segment is added: the inserted and updated documents of `docs`, the names of those that are dead before it, and
    what the dead ones take off the counts, from their own rows of the segments before. Documents that no
    action names are not read again. A document to insert that is there is replaced. Options are those
    of `write_index`.
    """
    spark, number = index.spark, index.segments[-1] + 1
    acted = pin(changes.where(F.col("action").isin("insert", "update", "delete")).select("doc", "action").distinct())
    fresh = docs.join(acted.where("action <> 'delete'").select("doc").distinct(), "doc", "left_semi").select(docs.columns)
    folder = os.path.join(index.path, "dead", f"segment={number}")
    acted.select("doc").distinct().write.mode("overwrite").parquet(folder)
    group = [by] if by else []
    known = index.live("lengths").join(acted.select("doc").distinct(), "doc", "left_semi").select("doc", "doc_len", *group)
    counted = index.live("counts").select("doc", "term").join(known, "doc")
    _write_segment(fresh, index.path, number, weighted, by, language, pin(counted))
    _list_segment(spark, index.path, number)
    return SearchIndex(spark, index.path)


def vocabulary(postings: DataFrame) -> DataFrame:
    """(term, lang, df) over the distinct terms of each language."""
    return postings.groupBy("term", "lang").agg(F.count(F.lit(1)).alias("df"))


def word_places(docs: DataFrame) -> DataFrame:
    """(doc, word, at): where each distinct word of the text, in lower case, first stands, in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            first: list[tuple[str, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: dict[str, int] = {}
                for word in WORD.finditer(text or ""):
                    found.setdefault(word.group(), word.start())
                names += [doc] * len(found)
                first += found.items()
                if len(first) > 500_000:
                    yield _places(names, first)
                    names, first = [], []
            yield _places(names, first)

    return docs.select("doc", F.lower("data").alias("text")).mapInArrow(run, "doc string, word string, at bigint")


WORD = re.compile(r"\w+")


def _places(names: list[str], first: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(names, pa.string()), pa.array([w for w, _ in first], pa.string()), pa.array([at for _, at in first], pa.int64())], names=["doc", "word", "at"])


#: Letters cut from a word to find its neighbours, and letters at its beginning that are cut from.
CUTS, HEAD = 2, 7


def cut_variants(word: Column) -> Column:
    """The first HEAD letters of a word and all that is left of them when up to CUTS letters are cut: at most 29.

    Two words within distance CUTS have a variant in common: each edit costs either word at most one
    letter of its beginning, be it changed, missing or moved out of it."""
    head = F.substring(word, 1, HEAD)
    size = F.length(head)
    variants = [head]
    for i in range(HEAD):
        one = F.concat(F.substring(head, 1, i), F.substring(head, i + 2, HEAD))
        variants.append(F.when(size > i, one))
        for j in range(i + 1, HEAD):
            two = F.concat(F.substring(head, 1, i), F.substring(head, i + 2, j - i - 1), F.substring(head, j + 2, HEAD))
            variants.append(F.when(size > j, two))
    return F.array_distinct(F.array_compact(F.array(*variants)))


def spelling_variants(vocabulary: DataFrame) -> DataFrame:
    """(variant, term, df): every term of (term, df) under each of its variants."""
    return unnest(vocabulary, cut_variants(F.col("term")), "variant", "term", "df").select("variant", "term", "df")


def facet_terms(docs: DataFrame, facet: str = "cats") -> DataFrame:
    """Distinct lower-case filter values, sorted."""
    value = F.explode("cats") if facet == "cats" else F.col(facet)
    values = docs.select(value.alias("value")).where(F.col("value").isNotNull() & (F.col("value") != ""))
    return values.select(F.lower("value").alias("value")).distinct().orderBy("value")


def top_terms(vocabulary: DataFrame, limit: int = 300, min_length: int = 3, stop_words=()) -> DataFrame:
    """Most frequent terms of (term, df): long enough, lower-case letters, no stop word."""
    rows = vocabulary.where(
        (F.length("term") >= min_length)
        & F.col("term").rlike(r"^\p{L}+$")
        & (F.lower("term") == F.col("term"))
    )
    if stop_words:
        rows = rows.where(~F.col("term").isin(*stop_words))
    return rows.select("term", "df").orderBy(F.desc("df"), "term").limit(limit)


def canonical_labels(docs: DataFrame, limit: int | None = None, min_length: int = 2) -> DataFrame:
    """Titles and alternative labels, distinct whatever their case, at least two characters,
    alphabetical. Among spellings differing by case the first by (doc, position) is kept."""
    others = F.filter(F.transform(F.split(F.coalesce("altlabels", F.lit("")), r"\|", -1), lambda x: F.trim(x)), lambda x: x != "")
    labels = docs.select("doc", F.posexplode(F.concat(F.array("title"), others)).alias("pos", "label"))
    labels = labels.where(F.length("label") >= min_length)
    firsts = labels.groupBy(F.lower("label").alias("folded")).agg(F.min(F.struct("doc", "pos", "label")).alias("f"))
    out = firsts.select(F.col("f.label").alias("label"), "folded").orderBy("folded").select("label")
    return out.limit(limit) if limit else out


def doc_row(docs: DataFrame, *more: str) -> DataFrame:
    """Stored values as flat columns, for display; `more` names columns to keep beside them."""
    return docs.select("doc", "type", "title", "description", joined("cats").alias("cats"), "country", "url", *more)
