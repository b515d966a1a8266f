"""Which known entities a text names, and what follows from that."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.arrays import unnest
from gumshoe.functions.permute import word_permutations
from gumshoe.functions.text import capitalised_names, clean_text, sanitize_label, tokens
from gumshoe.operators import patterns
from gumshoe.operators.attributes import inherit_org_cats
from gumshoe.quest import Quest

MAX_WORDS = 4


def label_phrases(label: Column, max_words: int) -> Column:
    """Every word order of a label; a longer one only as it is written."""
    written = F.array(F.lower(label))
    return F.when(F.size(F.split(label, " ", -1)) > max_words, written).otherwise(word_permutations(label, max_words))


def phrase_dict(entities: DataFrame, label: str = "label", altlabels: str | None = "altlabels") -> DataFrame:
    """(phrase, key): every word order of labels up to 4 words and alternative labels up to 3, longer
    ones as they are written; the first entity by name keeps a phrase. Empty labels give none."""
    entities = entities.withColumn("_label", sanitize_label(F.col(label)))
    phrases = label_phrases(F.col("_label"), MAX_WORDS)
    if altlabels and altlabels in entities.columns:
        others = F.transform(
            F.coalesce(altlabels, F.array().cast("array<string>")), lambda a: label_phrases(F.trim(a), 3)
        )
        phrases = F.array_distinct(F.concat(phrases, F.flatten(others)))
    rows = unnest(entities, phrases, "phrase", "name").where(F.trim("phrase") != "")
    return rows.groupBy("phrase").agg(F.min("name").alias("key"))


def phrase_dict_desc(entities: DataFrame, label: str = "label", description: str = "description") -> DataFrame:
    """The older variant: word orders of the label and of the description, both up to 4 words."""
    texts = F.array(sanitize_label(F.col(label)), sanitize_label(F.coalesce(description, label)))
    phrases = F.flatten(F.transform(texts, lambda t: label_phrases(t, MAX_WORDS)))
    rows = unnest(entities, F.array_distinct(phrases), "phrase", "name").where(F.trim("phrase") != "")
    return rows.groupBy("phrase").agg(F.min("name").alias("key"))


def match_phrases(
    docs: DataFrame, dictionary: DataFrame, occurrences: bool = False, key: str = "source", text: str = "text"
) -> DataFrame:
    """(source, key, n): `n` phrase variants of the entity occur between blanks in the text.

    All phrases are looked for in one pass over the words of the texts (`patterns.occurrences`); only what is
    found is shuffled. Rows of one source are one text for phrases of up to MAX_WORDS words. A run touching
    either end of the text has no blank on that side and does not count.
    `occurrences=True` adds how often they occur.
    """
    words = docs.select(key, tokens(F.col(text)).alias("_t"))
    inner = words.select(key, F.slice("_t", 2, F.greatest(F.size("_t") - 2, F.lit(0))).alias("_w"))
    known = dictionary.where("phrase <> ''").select("phrase", "key", F.size(F.split("phrase", " ", -1)).alias("_p"))
    short, long = (known.where(F.col("_p") <= MAX_WORDS), known.where(F.col("_p") > MAX_WORDS))
    blank = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    spaced = inner.select(key, blank(F.array_join("_w", " ")).alias("_w"))
    found = patterns.occurrences(spaced, short.select(blank(F.col("phrase")).alias("phrase"), F.col("phrase").alias("key")), key, "_w")
    # Counted before the phrases bring their keys.
    counted = found.groupBy(key, F.col("key").alias("phrase")).agg(F.sum("times").alias("times")).join(short.select("phrase", "key"), "phrase")
    more = patterns.occurrences(spaced, long.select(blank(F.col("phrase")).alias("phrase"), "key"), key, "_w")
    columns = [key, "key", "phrase", "times"]
    hits = counted.select(columns).unionByName(more.select(columns))
    n = F.count(F.lit(1)).alias("n")
    return hits.groupBy(key, "key").agg(*([n, F.sum("times").alias("occurrences")] if occurrences else [n]))


def match_idents(docs: DataFrame, idents: DataFrame, *taken: DataFrame, **options) -> DataFrame:
    """Ident mentions; phrases that also name an org, country or city do not count."""
    return match_phrases(docs, free_phrases(idents, *taken), **options)


def free_phrases(idents: DataFrame, *taken: DataFrame) -> DataFrame:
    """Ident phrases that name no org, country or city."""
    return reduce(lambda d, other: d.join(other.select("phrase"), "phrase", "left_anti"), taken, idents)


def match_kinds(docs: DataFrame, **dictionaries: DataFrame) -> DataFrame:
    """(source, kind, key, n): `match_phrases` with a dictionary per kind, the texts read once for all of them."""
    kinds = [d.select("phrase", F.concat_ws(" ", F.lit(kind), "key").alias("key")) for kind, d in dictionaries.items()]
    hits = match_phrases(docs, reduce(DataFrame.unionByName, kinds))
    own = F.when(F.instr("key", " ") > 0, F.expr("substr(key, instr(key, ' ') + 1)"))
    return hits.select("source", F.substring_index("key", " ", 1).alias("kind"), own.alias("key"), "n")


def match_substrings(docs: DataFrame, dictionary: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """(source, key, n): phrases occurring anywhere in the cleaned text, no word bounds.

    All phrases are looked for in one pass over the texts (`patterns.occurrences`); only what is found is
    shuffled. Empty phrases match nothing.
    """
    cleaned = docs.select(key, clean_text(F.col(text)).alias("_clean"))
    hits = patterns.occurrences(cleaned, dictionary, key, "_clean")
    return hits.groupBy(key, "key").agg(F.count(F.lit(1)).alias("n"))


def flt_bad_names(
    people: DataFrame,
    bad: DataFrame | None = None,
    idents: DataFrame | None = None,
    countries: DataFrame | None = None,
    column: str = "person",
) -> DataFrame:
    """Drop candidates with `]` or `https`, in the bad list, or naming a known ident or country.
    The lists hold lower-case phrases; a listed phrase in its own case also counts."""
    out = people.where(~F.col(column).contains("]") & ~F.col(column).contains("https"))
    lists = [(bad, "word", False), (idents, "phrase", True), (countries, "phrase", True)]
    for table, phrase, exact in lists:
        if table is None:
            continue
        words = table.select(F.col(phrase).alias("_known")).distinct()
        match = F.lower(column) == F.col("_known")
        out = out.join(words, match, "left_anti")
        if exact:
            out = out.join(words, F.col(column) == F.col("_known"), "left_anti")
    return out


def people(docs: DataFrame, key: str = "source", text: str = "text", **lists: DataFrame) -> DataFrame:
    """(source, person, n): capitalised two-word names, counted after `flt_bad_names`.

    Counting comes first: the anti joins then see each (source, name) once."""
    found = unnest(docs, capitalised_names(F.col(text)), "person", key)
    counted = found.where(F.length("person") > 2).groupBy(key, "person").agg(F.count(F.lit(1)).alias("n"))
    return flt_bad_names(counted, **lists)


def mention_table(**matches: DataFrame) -> DataFrame:
    """Long table (source, kind, key, n) from the match results per kind."""
    parts = [m.select("source", F.lit(kind).alias("kind"), "key", "n") for kind, m in matches.items()]
    return reduce(DataFrame.unionByName, parts)


def mentioning_sources(mentions: DataFrame) -> DataFrame:
    """The inverted report: distinct (kind, key, source). Rows, written partitioned by kind."""
    return mentions.select("kind", "key", "source").distinct()


def ident_profile(quest: Quest, mentions: DataFrame, ident: str) -> DataFrame:
    """One ident with its mentioning sources, one row each (a null source when none)."""
    cited = mentions.where((F.col("kind") == "idents") & (F.col("key") == ident)).select(
        F.col("key").alias("name"), "source"
    )
    person = quest.idents.where(F.col("name") == ident).select("name", "label", "country")
    return person.join(cited.distinct(), "name", "left")


def ident_network(
    quest: Quest,
    mentions: DataFrame,
    idents: Sequence[str],
    exclude_cats: Sequence[str] = (),
    exclude_idents: Sequence[str] = (),
) -> DataFrame:
    """(ident, other, source): idents named in the same source as one of `idents`.

    Linear in the mentions: each meets the few start idents of its source, never its peers.
    Others are dropped by first category or by name, and must exist in the quest.
    """
    named = mentions.where(F.col("kind") == "idents").select("source", F.col("key").alias("other")).distinct()
    starts = named.where(F.col("other").isin(*idents)).select("source", F.col("other").alias("ident"))
    if exclude_idents:
        starts = starts.where(~F.col("ident").isin(*exclude_idents))
        named = named.where(~F.col("other").isin(*exclude_idents) | F.col("other").isin(*idents))
    pairs = named.join(starts, "source").where(F.col("other") != F.col("ident"))
    if exclude_idents:
        pairs = pairs.where(~F.col("other").isin(*exclude_idents))
    return _known(pairs, quest, exclude_cats)


def _known(pairs: DataFrame, quest: Quest, exclude_cats: Sequence[str]) -> DataFrame:
    rows = inherit_org_cats(quest.idents, quest) if exclude_cats else quest.idents
    if exclude_cats:
        first = F.try_element_at("cats", F.lit(1))
        rows = rows.where(first.isNull() | ~first.isin(*exclude_cats))
    return pairs.join(rows.select(F.col("name").alias("other")), "other", "left_semi")


def network_counts(network: DataFrame) -> DataFrame:
    """How many sources each start shares with each other ident."""
    return network.groupBy("ident", "other").agg(F.count(F.lit(1)).alias("n"))


def ident_network_2(
    quest: Quest, mentions: DataFrame, ident: str, exclude_cats: Sequence[str] = (), exclude_idents: Sequence[str] = ()
) -> DataFrame:
    """(other, n): idents co-mentioned with any level-1 neighbour, counted once per neighbour
    and source, the start left out.

    Per source, an ident meets every neighbour named there but itself, so its share is the
    number of neighbours in the source, less one when it is a neighbour itself: two counts per
    source instead of pairs.
    """
    level1 = ident_network(quest, mentions, [ident], exclude_cats, exclude_idents).select("other").distinct()
    banned = [ident, *exclude_idents]
    named = mentions.where((F.col("kind") == "idents") & ~F.col("key").isin(*banned)).select(
        "source", F.col("key").alias("other")
    ).distinct()
    marked = named.join(level1.withColumn("_near", F.lit(1)), "other", "left").fillna(0, ["_near"])
    per_source = marked.groupBy("source").agg(F.sum("_near").alias("_neighbours")).where("_neighbours > 0")
    shares = marked.join(per_source, "source").select("other", (F.col("_neighbours") - F.col("_near")).alias("_n"))
    counted = shares.groupBy("other").agg(F.sum("_n").alias("n")).where("n > 0")
    return _known(counted, quest, exclude_cats)


def network_totals(mentions: DataFrame) -> DataFrame:
    """(ident, n_sources, n_shared): for every ident at once, in how many sources it is named
    and how many co-mentions it has there. Two aggregations, no pairs."""
    named = mentions.where(F.col("kind") == "idents").select("source", F.col("key").alias("ident")).distinct()
    sizes = named.groupBy("source").agg(F.count(F.lit(1)).alias("_size"))
    return (
        named.join(sizes, "source")
        .groupBy("ident")
        .agg(F.count(F.lit(1)).alias("n_sources"), F.sum(F.col("_size") - 1).alias("n_shared"))
    )


def ident_occurrences(quest: Quest, mentions: DataFrame, idents: Sequence[str]) -> DataFrame:
    """(ident, source, kind, name): events and other idents citing a source that names one of
    `idents`."""
    named = (
        mentions.where((F.col("kind") == "idents") & F.col("key").isin(*idents))
        .select("source", F.col("key").alias("ident"))
        .distinct()
    )
    citing = quest.citations("events", "idents")
    return (
        citing.join(named, "source")
        .where((F.col("kind") != "idents") | (F.col("name") != F.col("ident")))
        .select("ident", "source", "kind", "name")
    )


def missing_links(quest: Quest, mentions: DataFrame, idents: Sequence[str]) -> DataFrame:
    """(ident, event) implied by mentions but not linked."""
    implied = ident_occurrences(quest, mentions, idents).where(F.col("kind") == "events")
    implied = implied.select("ident", F.col("name").alias("event")).distinct()
    known = quest.links.where(F.col("lfrom").isin(*idents)).select(
        F.col("lfrom").alias("ident"), F.col("lto").alias("event")
    )
    return implied.join(known, ["ident", "event"], "left_anti")


def missing_relations(quest: Quest, mentions: DataFrame, idents: Sequence[str]) -> DataFrame:
    """(ident, other) implied by mentions but related in neither direction."""
    implied = ident_occurrences(quest, mentions, idents).where(F.col("kind") == "idents")
    implied = implied.select("ident", F.col("name").alias("other")).distinct()
    touching = quest.relations.where(F.col("rfrom").isin(*idents) | F.col("rto").isin(*idents))
    known = touching.select(F.explode(F.array(
        F.struct(F.col("rfrom").alias("ident"), F.col("rto").alias("other")),
        F.struct(F.col("rto").alias("ident"), F.col("rfrom").alias("other")),
    )).alias("e")).select("e.ident", "e.other")
    return implied.join(known, ["ident", "other"], "left_anti")


def suggest_idents(found: DataFrame) -> DataFrame:
    """Draft idents from people mentions: name without blanks, label as found."""
    return found.select(F.replace("person", F.lit(" "), F.lit("")).alias("name"), F.col("person").alias("label")).distinct()


def suggest_links(mentions: DataFrame, label: str = "link_label") -> DataFrame:
    """One draft link per mentioned ident and source."""
    return mentions.where(F.col("kind") == "idents").select(
        F.lit(label).alias("label"),
        F.regexp_replace("key", r"^ident\.", "").alias("from"),
        F.regexp_replace("source", r"^source\.", "").alias("to"),
    )
