"""Ranked search over documents: BM25, filters, synonyms, spelling, fuzzy rerank, snippets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.functions.arrays import unnest
from gumshoe.functions import similarity
from gumshoe.functions.bounds import fuzzy_bound, text_words
from gumshoe.functions.text import context, context_at, fold_accents, fold_text, sanitize_label
from gumshoe.operators.attributes import source_url
from gumshoe.operators.filters import get_events, get_idents, get_orgs
from gumshoe.operators.index import CUTS, WORD, SearchIndex, cut_variants, fields, saturation, search_tokens, term_counts
from gumshoe.operators.ranking import join_same, sort_dated
from gumshoe.plans.report import get_sources
from gumshoe.quest import Quest
from gumshoe.session import pin

# Fixed value: the smallest idf.
MIN_IDF = 1e-6


def query_words(query: str) -> list[str]:
    """Folded words of a query, each once. Computed on the parameter, not on data."""
    import re

    words = re.sub(r"[^\w\s]", " ", fold_text(query).lower()).split()
    return list(dict.fromkeys(words))


def field_hits(docs: DataFrame, words: Sequence[str], weighted: bool = False) -> DataFrame:
    """(doc, term, tf) for the query words, and every document's length as term ''.

    One pass over the texts: each field keeps only its hits and its length, so the shuffle
    carries a few rows per document, never its words.
    """
    split = fields(docs, weighted).select("doc", "weight", search_tokens(F.col("text")).alias("_t"))
    hits = F.filter("_t", lambda w: w.isin(*words))
    found = split.select("doc", "weight", F.size("_t").alias("_n"), hits.alias("_h"))
    entries = F.concat(
        F.array(F.struct(F.lit("").alias("term"), F.col("_n").alias("n"))),
        F.transform("_h", lambda w: F.struct(w.alias("term"), F.lit(1).alias("n"))),
    )
    counted = unnest(found, entries, "e", "doc", "weight")
    return counted.groupBy("doc", F.col("e.term").alias("term")).agg(
        F.sum(F.col("e.n") * F.col("weight")).alias("tf")
    )


def joined_hits(docs: DataFrame, terms: DataFrame, weighted: bool = False) -> DataFrame:
    """`field_hits` for any number of terms: the counted words of the documents meet them in a join."""
    counts = term_counts(fields(docs, weighted))
    lengths = counts.groupBy("doc").agg(F.sum("tf").alias("tf")).select("doc", F.lit("").alias("term"), "tf")
    return counts.join(terms, "term", "left_semi").select("doc", "term", "tf").union(lengths)


def bm25(hits: DataFrame, lengths: DataFrame, words: Sequence[str], op: str = "or", by: str | None = None) -> DataFrame:
    """(doc, score) from hits (doc, term, tf) and lengths (doc, doc_len). With `and` a document
    must hold every word. `by` names a column (a peer) with statistics of its own."""
    group = [by] if by else []
    stats = lengths.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg"))
    return scored_hits(join_same(hits, lengths, ["doc", *group]), stats, len(words), op, by)


def scored_hits(hits: DataFrame, stats: DataFrame, n_words: int, op: str = "or", by: str | None = None) -> DataFrame:
    """(doc, score) from hits (doc, term, tf, doc_len) and statistics (n, avg)."""
    group = [by] if by else []
    freq = hits.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("_df"))
    if by:
        freq = join_same(freq, stats, [by])
    else:
        freq = freq.select("*", stats.select("n").scalar().alias("n"), stats.select("avg").scalar().alias("avg"))
    idf = F.greatest(F.log((F.col("n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(MIN_IDF))
    # One row per query word (and peer).
    weights = freq.select(*group, "term", idf.alias("_idf"), F.col("avg").alias("_avg"))
    weight = F.col("_idf") * saturation(F.col("tf"), F.col("doc_len"), F.col("_avg"))
    scored = join_same(hits, weights, [*group, "term"])
    scored = scored.groupBy("doc", *group).agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("_terms"))
    if op.lower() == "and":
        scored = scored.where(F.col("_terms") == n_words)
    return scored.select("doc", *group, "score")


def search_index(
    index: SearchIndex,
    query: str,
    op: str = "or",
    cats: Sequence[str] = (),
    types: Sequence[str] = (),
    countries: Sequence[str] = (),
    synonyms: bool = False,
    stemmed: bool = False,
    language: str = "en",
) -> DataFrame:
    """`search_bm25` on a stored index: the postings of the query's words and the stored values of the
    documents they hit are read, never a text. `synonyms` adds the words of every variant of an
    entity that the query names; `stemmed` meets words that differ by their ending in `language`."""
    words = query_words(query)
    if synonyms:
        hits = index.hits_of(expand_synonyms(synonym_pairs(index.docs()), words))
    else:
        hits = index.hits(words, stemmed, language)
    scored = scored_hits(hits.select("doc", "term", "tf", "doc_len"), index.stats(), len(words), op)
    found = search_facets(index.docs().drop("data").join(scored, "doc"), cats, types, countries)
    return found.withColumn("percent", 100 * F.col("score") / found.agg(F.max("score")).scalar())


#: Values of one condition that Parquet readers test one by one; more would become a range.
PUSHED = 8
#: Documents that are looked up by name at the end of a pruned search, and how the rows read grow each time.
LOOKED_UP, GROWTH = 512, 4


@dataclass
class Pruned:
    """The k best documents (doc, score), how many postings were read for them, and of how many."""

    best: DataFrame
    read: int
    held: int


def search_top(index: SearchIndex, query: str, k: int = 10) -> Pruned:
    """The k documents with the highest score of any of the query's words, ties by name: the same as the first k of
    `search_index`, without reading postings that cannot matter.

    The levels of the words' postings have bounds of what they add. The highest are read first. A document in
    none of them scores at most the sum of the highest bounds left; once the k-th partial score is
    above that, only documents already met count, and of them those whose own bound reaches it. When they
    are few, their rows are looked up by document; else more levels are read, in the end all.
    """
    words, spark = query_words(query), index.spark
    n, average = index.stats().select("n", "avg").first()
    df = {r["term"]: r["df"] for r in index.vocabulary().where(F.col("term").isin(*words)).collect()}
    empty = spark.createDataFrame([], "doc string, score double")
    if not df:
        return Pruned(empty, 0, 0)
    idf = {t: max(math.log((n - d + 0.5) / (d + 0.5)), MIN_IDF) for t, d in df.items()}
    levels = index.table("levels").where(F.col("term").isin(*df)).groupBy("term", "level")
    # At most LEVELS rows for each word of the query.
    rows = levels.agg(F.sum("n").alias("n"), F.max("most_tf").alias("tf"), F.min("least_len").alias("len")).collect()
    bounds = sorted(((idf[r["term"]] * saturation(r["tf"], r["len"], average) * (1 + 1e-9), r["term"], r["level"], r["n"]) for r in rows), reverse=True)
    held, taken, wanted = sum(b[3] for b in bounds), 0, GROWTH * k
    weight = F.create_map(*[F.lit(x) for t in idf for x in (t, idf[t])])[F.col("term")]
    add = weight * saturation(F.col("tf"), F.col("doc_len"), F.lit(float(average)))
    read = 0
    while True:
        while taken < len(bounds) and (sum(b[3] for b in bounds[:taken]) < wanted):
            taken += 1
        opened: dict[str, list[int]] = {}
        for _, term, level, _ in bounds[:taken]:
            opened.setdefault(term, []).append(level)
        left = {t: max((b[0] for b in bounds[taken:] if b[1] == t), default=0.0) for t in idf}
        read += sum(b[3] for b in bounds[:taken])
        chosen = reduce(Column.__or__, [(F.col("term") == t) & F.col("level").isin(*own) for t, own in opened.items()])
        rest = F.create_map(*[F.lit(x) for t in left for x in (t, left[t])])[F.col("term")]
        met = index.live("postings").where(chosen).groupBy("doc").agg(F.sum(add).alias("part"), F.sum(rest).alias("known"))
        if taken == len(bounds):
            best = met.select("doc", F.col("part").alias("score")).orderBy(F.desc("score"), "doc").limit(k)
            return Pruned(best, read, held)
        met = pin(met)
        first = met.orderBy(F.desc("part")).limit(k).agg(F.min("part"), F.count(F.lit(1))).first()
        if first[1] == k and first[0] > sum(left.values()):
            able = met.where(F.col("part") + sum(left.values()) - F.col("known") >= first[0] * (1 - 1e-9)).select("doc")
            names = [r["doc"] for r in able.limit(LOOKED_UP + 1).collect()]
            if len(names) <= LOOKED_UP:
                asked = named(names)
                counted = index.live("counts").where(asked & F.col("term").isin(*df)).select("doc", "term", "tf")
                exact = counted.join(index.live("lengths").where(asked).select("doc", "doc_len"), "doc").groupBy("doc").agg(F.sum(add).alias("score"))
                return Pruned(exact.orderBy(F.desc("score"), "doc").limit(k), read + len(names) * len(df), held)
        wanted = GROWTH * max(wanted, sum(b[3] for b in bounds[:taken]))


def search_bm25(
    docs: DataFrame,
    query: str,
    op: str = "or",
    cats: Sequence[str] = (),
    types: Sequence[str] = (),
    countries: Sequence[str] = (),
    synonyms: DataFrame | None = None,
    weighted: bool = False,
) -> DataFrame:
    """Documents with raw score and percent of the best, filtered by facets. Not cut or sorted:
    page, rerank or sort the result. Statistics are those of the whole index."""
    words = query_words(query)
    # Hits, lengths and statistics all come from here: written once, the texts are read once.
    if synonyms is None:
        rows = pin(field_hits(docs, words, weighted))
    else:
        rows = pin(joined_hits(docs, expand_synonyms(synonyms, words), weighted))
    lengths = rows.where("term = ''").select("doc", F.col("tf").alias("doc_len"))
    scored = bm25(rows.where("term <> ''"), lengths, words, op)
    found = docs.drop("data").join(scored, "doc")
    found = search_facets(found, cats, types, countries)
    best = found.agg(F.max("score")).scalar()
    return found.withColumn("percent", 100 * F.col("score") / best)


def search_facets(docs: DataFrame, cats=(), types=(), countries=()) -> DataFrame:
    """Any of the categories, types, countries; compared in lower case."""
    if cats:
        lowered = F.transform("cats", F.lower)
        docs = docs.where(F.arrays_overlap(lowered, F.array(*[F.lit(c.lower()) for c in cats])))
    if types:
        docs = docs.where(F.lower("type").isin(*[t.lower() for t in types]))
    if countries:
        docs = docs.where(F.lower("country").isin(*[c.lower() for c in countries]))
    return docs


def synonym_pairs(docs: DataFrame) -> DataFrame:
    """(variant, doc, other): for each entity, each of its label variants reaches all of them.
    Variants of one entity are what its author wrote, a handful."""
    others = F.transform(F.split(F.coalesce("altlabels", F.lit("")), r"\|", -1), lambda x: F.trim(x))
    variants = docs.select("doc", F.array_distinct(F.filter(
        F.transform(F.concat(F.array("title"), others), lambda x: F.lower(fold_accents(x))), lambda x: x != ""
    )).alias("_v"))
    each = unnest(variants, "_v", "variant", "doc", "_v")
    return unnest(each, "_v", "other", "variant", "doc").where(F.col("variant") != F.col("other"))


def expand_synonyms(pairs: DataFrame, words: Sequence[str]) -> DataFrame:
    """(term): the query words plus the words of every variant of an entity that one of them, or all
    together, name."""
    named = [*words, " ".join(words)]
    own = pairs.sparkSession.createDataFrame([(w,) for w in words], "term string")
    others = pairs.where(F.col("variant").isin(*named)).select("other").distinct()
    return own.union(others.select(F.explode(search_tokens(F.col("other"))))).distinct()


def search_synonyms(docs: DataFrame, name: str) -> DataFrame:
    """(doc, other): entities any of whose variants is `name`, with their other variants."""
    return synonym_pairs(docs).where(F.col("variant") == " ".join(query_words(name))).select("doc", "other")


def search_spelling(spelling: DataFrame, query: str, distance: int = CUTS) -> DataFrame:
    """(word, correction): per query word the nearest term within `distance`, ties by document frequency then
    alphabet; the word itself when it is known.

    `spelling` holds the terms under their variants (`spelling_variants`), sorted in an index: only the row
    groups of the words' own variants are read, and only the terms there are compared in full."""
    if not 0 <= distance <= CUTS:
        raise ValueError(f"distance is at most {CUTS}")
    words = query_words(query)
    asked = spelling.sparkSession.createDataFrame([(w,) for w in words], "word string")
    asked = unnest(asked, cut_variants(F.col("word")), "variant", "word")
    variants = sorted({r["variant"] for r in asked.collect()})  # at most 29 for each word of the query
    held = [F.col("variant").isin(*variants[at : at + PUSHED]) for at in range(0, len(variants), PUSHED)]
    near = spelling.where(reduce(Column.__or__, held, F.lit(False))).join(F.broadcast(asked), "variant")
    near = near.where(F.abs(F.length("term") - F.length("word")) <= distance).select("word", "term", "df").distinct()
    near = near.withColumn("_d", F.levenshtein("word", "term", distance)).where("_d >= 0")
    best = F.min(F.struct("_d", -F.col("df"), "term")).alias("_b")
    return near.groupBy("word").agg(best).select("word", F.col("_b.term").alias("correction"))


def sort_results(found: DataFrame, sort: str = "relevance") -> DataFrame:
    if sort in ("oldest", "newest"):
        return sort_dated(found, "begin", sort == "newest", ["doc"])
    return found.orderBy(F.desc("score"), "doc")


def result_page(found: DataFrame, sort: str = "relevance", offset: int = 0, limit: int = 10) -> DataFrame:
    """One page with rank numbers continued from the pages before; only `offset + limit` rows
    leave the tasks."""
    rows = sort_results(found, sort).offset(offset).limit(limit)
    if sort == "relevance":
        order = [F.desc("score"), F.asc("doc")]
    else:
        order = [F.desc_nulls_last("begin") if sort == "newest" else F.asc_nulls_last("begin"), F.asc("doc")]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + offset)


def snippets(page: DataFrame, docs: DataFrame, query: str, distance: int = 60, highlight: str = "<b>%s</b>") -> DataFrame:
    """Context for the rows of a page; the texts join only now."""
    texts = docs.select("doc", "data")
    rows = page.join(texts, "doc", "left")
    return rows.withColumn("context", context(F.coalesce("data", F.lit("")), query, distance, highlight)).drop("data")


def named(docs: Sequence[str]) -> Column:
    """Condition for the rows of a few documents that Parquet readers can test."""
    chunks = [F.col("doc").isin(*docs[at : at + PUSHED]) for at in range(0, len(docs), PUSHED)]
    return reduce(Column.__or__, chunks, F.lit(False))


def indexed_snippets(index: SearchIndex, page: DataFrame, query: str, distance: int = 60, highlight: str = "<b>%s</b>") -> DataFrame:
    """`snippets` for a page of results, from the stored places of words: the rows of its documents are read, their
    texts are cut and not searched. A query word stands where the first word that contains it does; one with
    other characters is looked for in the text."""
    page = pin(page)
    names = [r["doc"] for r in page.select("doc").distinct().collect()]  # a page
    words = list(dict.fromkeys(w for w in query.split(" ") if WORD.fullmatch(w)))
    low = {w: w.lower() for w in words}
    at = [F.min(F.when(F.instr("word", low[w]) > 0, F.col("at") + F.instr("word", low[w]) - 1)).alias(f"_at{i}") for i, w in enumerate(words)]
    docs = index.docs().where(named(names)).select("doc", F.coalesce("data", F.lit("")).alias("_data"))
    if at:
        docs = docs.join(index.live("places").where(named(names)).groupBy("doc").agg(*at), "doc", "left")
    data = F.col("_data")
    place = {w: F.coalesce(f"_at{i}", F.lit(-1)) for i, w in enumerate(words)}
    hits = [(w, place[w] if w in place else F.instr(F.lower(data), w.lower()) - 1) for w in query.split(" ")]
    found = docs.select("doc", context_at(data, hits, distance, highlight).alias("context"))
    return page.join(found, "doc", "left").withColumn("context", F.coalesce("context", context(F.lit(""), query, distance, highlight)))


def search_fuzzy(found: DataFrame, query: str, threshold: float = 70.0) -> DataFrame:
    """Rerank the results by string likeness of title and description. Every result that can reach the threshold
    by an upper bound of its letter and word counts is scored, in Arrow batches; a page is cut from the
    ranking, not before it."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.when(F.col("description") != "", F.col("description"))))
    wanted = query.lower()

    @F.pandas_udf("fuzzy double, phonetic double, all_tokens boolean")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = [similarity.fuzzy_score(wanted, t) for t in texts]
        return pd.DataFrame(rows, columns=["fuzzy", "phonetic", "all_tokens"])

    shown = found.columns
    worded = found.withColumn("_text", text).withColumn("_words", text_words(F.col("_text")))
    possible = worded.where(fuzzy_bound(wanted, F.col("_text"), F.col("_words")) >= threshold - 1e-6)
    scored = possible.withColumn("_f", score("_text")).where(F.col("_f.fuzzy") >= threshold)
    fuzzy = F.col("_f.fuzzy")
    share = 0.3 + fuzzy / 100 * 0.2
    return scored.select(
        *shown,
        F.round(fuzzy, 2).alias("fuzzy_score"),
        F.round("_f.phonetic", 2).alias("phonetic_score"),
        F.col("_f.all_tokens").alias("token_match"),
        (F.col("percent") * (1 - share) + fuzzy * share).alias("combined_score"),
    ).orderBy(F.desc("combined_score"), F.desc("token_match"), "doc")


def phonetic_duplicates(idents: DataFrame, low: float = 0.93) -> DataFrame:
    """(label_a, label_b, similarity, a, n_a, b, n_b): labels that start with words of the same
    sound and are alike, `low` <= Jaro-Winkler < 1, each with its first ident and how many bear
    it; `label_holders` lists them all.

    Exact without comparing all pairs of a bucket. A label counts once, whoever bears it. A pair can
    only reach `low` when enough characters agree: Jaro must be at least (low - 0.4) / 0.6, so
    with m common characters m/|a| + m/|b| >= 3*jaro - 1. Hence each label shares a character
    (with its occurrence number) among its rarest few with every partner; labels meet on
    (sound, rare character, occurrence), pass the length and overlap bounds inside the JVM, and
    only the survivors are scored in Python.
    """
    need = 3 * (low - 0.4) / 0.6 - 1
    rows = idents.select("name", sanitize_label(F.col("label")).alias("label")).where(
        F.coalesce("label", F.lit("")) != ""
    )
    first = F.get(F.filter(F.split(fold_accents(F.col("label")), r"\s+", -1), lambda w: w != ""), F.lit(0))

    @F.pandas_udf("string")
    def sound(words: pd.Series) -> pd.Series:
        return words.map(lambda w: similarity.metaphone(w) if w else "")

    labels = rows.select(F.lower("label").alias("low"), first.alias("_first")).where(F.length("_first") >= 3)
    labels = labels.groupBy("low").agg(F.min("_first").alias("_first"))
    labels = labels.withColumn("code", sound("_first")).where("code <> ''")
    sized = labels.select("low", "code", F.length("low").alias("n"), F.filter(F.split("low", "", -1), lambda x: x != "").alias("_c"))
    # (character, how many times it occurred before), rarest characters of the alphabet first.
    marked = F.transform(
        "_c", lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice("_c", 1, i + 1), lambda x: x == c)).alias("k"))
    )
    spelled = sized.select("low", "code", "n", F.transform(marked, lambda m: F.struct(
        F.instr(F.lit(similarity.COMMON_FIRST), m["c"]).alias("o"), m["c"].alias("c"), m["k"].alias("k"))).alias("t"))
    # Rare first: characters outside the frequency list, then from its end.
    ordered = F.transform(F.array_sort(F.transform("t", lambda m: F.struct(
        F.when(m["o"] == 0, -1000).otherwise(-m["o"]).alias("o"), m["c"].alias("c"), m["k"].alias("k")))),
        lambda m: F.concat(m["c"], m["k"].cast("string")))
    # The shortest partner has m characters at least: m >= (need - 1) * n.
    keep = (F.col("n") - F.ceil((need - 1) * F.col("n")) + 1).cast("int")
    prefixed = spelled.select("low", "code", "n", ordered.alias("t")).withColumn("_keep", keep)
    keyed = unnest(prefixed, F.slice("t", 1, F.greatest("_keep", F.lit(1))), "tok", "low", "code", "n", "t")
    other = keyed.select(F.col("low").alias("low_b"), "code", F.col("n").alias("n_b"), F.col("t").alias("t_b"), "tok")
    common = F.size(F.array_intersect("t", "t_b"))
    met = keyed.join(other, ["code", "tok"]).where(
        (F.col("low") < F.col("low_b"))
        & (F.least("n", "n_b") >= (need - 1) * F.greatest("n", "n_b"))
        & (common / F.col("n") + common / F.col("n_b") >= need - 1e-9)
    )
    # A pair meets once per shared token: keep the meeting on its first shared one.
    shared = F.array_intersect("t", "t_b")
    met = met.where(F.get(shared, F.lit(0)) == F.col("tok")).select("low", "low_b")

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity.jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")

    pairs = met.withColumn("similarity", alike("low", "low_b")).where((F.col("similarity") >= low) & (F.col("similarity") < 1))
    holders = rows.groupBy(F.lower("label").alias("low")).agg(F.min("name").alias("a"), F.count(F.lit(1)).alias("n_a"))
    other = holders.select(F.col("low").alias("low_b"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    return pairs.join(holders, "low").join(other, "low_b").select(
        F.col("low").alias("label_a"), F.col("low_b").alias("label_b"), "similarity", "a", "n_a", "b", "n_b"
    )


def label_holders(idents: DataFrame) -> DataFrame:
    """(label, name): the idents behind each lower-case label."""
    return idents.select(F.lower(sanitize_label(F.col("label"))).alias("label"), "name").distinct()


def search_filters(
    quest: Quest,
    texts: DataFrame | None = None,
    cats: Sequence[str] = (),
    countries: Sequence[str] = (),
    types: Sequence[str] = ("orgs", "idents", "events", "sources"),
) -> DataFrame:
    """Filter-only search: uniform rows of every kind with text and addresses of their sources.

    `sources` are those cited by the filtered quest but by none of the listed kinds. Score and
    rank are constant.
    """
    getters = {"orgs": get_orgs, "idents": get_idents, "events": get_events}
    rows = {k: getters[k](quest, cats=cats, countries=countries) for k in types if k in getters}
    parts = []
    from gumshoe.operators.attributes import effective_cats, effective_country

    for kind, names in rows.items():
        full = quest.table(kind).join(names.select("name"), "name", "left_semi")
        full = effective_country(effective_cats(full, quest, kind), quest, inherit=kind == "idents")
        parts.append(_result_rows(full, kind))
    if "sources" in types:
        from gumshoe.operators.filters import get_countries, get_links, get_quotes, get_relations

        cited = get_sources(
            quest, get_orgs(quest, cats=cats, countries=countries), get_idents(quest, cats=cats, countries=countries),
            get_relations(quest, cats), get_links(quest, cats), get_quotes(quest, cats), get_countries(quest, cats),
        )
        for kind, names in rows.items():
            own = quest.citations(kind).join(names.select("name"), "name", "left_semi")
            cited = cited.join(own.select(F.col("source").alias("name")), "name", "left_anti")
        full = quest.sources.join(cited, "name", "left_semi")
        parts.append(_result_rows(full.withColumn("sources", F.array("name")), "sources"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    urls = quest.sources.select(F.col("name").alias("source"), source_url(("url", "link", "youtube", "bsky")).alias("_url"))
    linked = out.select("name", "type", F.posexplode("sources").alias("_pos", "source")).join(urls, "source", "left")
    if texts is not None:
        linked = linked.join(texts.select("source", F.col("text").alias("_text")), "source", "left")
    else:
        linked = linked.withColumn("_text", F.lit(None).cast("string"))
    data = linked.groupBy("name", "type").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_url", "_text"))).alias("_s")
    ).select("name", "type", F.array_compact("_s._url").alias("urls"), F.array_join("_s._text", "\n").alias("data"))
    return out.drop("sources").join(data, ["name", "type"], "left")


def _result_rows(df: DataFrame, kind: str) -> DataFrame:
    from gumshoe.functions.text import sanitize_description

    return df.select(
        "name",
        F.lit(kind).alias("type"),
        sanitize_label(F.col("label")).alias("title"),
        sanitize_description(F.col("description"), F.col("label")).alias("description"),
        "cats",
        "country",
        (F.col("begin") if "begin" in df.columns else F.lit(None).cast("date")).alias("begin"),
        F.lit(100).alias("score"),
        F.lit(1).alias("rank"),
        "sources",
    )
