"""Word counts, mood, rollups, translation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.arrays import unnest
from gumshoe.functions.language import STOP_WORDS, detect_language, language_score
from gumshoe.functions.text import tokens
from gumshoe.operators.ranking import first_by_key, top_per_group

# Month and day names that are no topics.
DAY_MONTH = (
    "january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday"
).split()


def topic_words(words: Column, lang: Column) -> Column:
    """Of the tokens, those of more than two letters, alphabetic, no stop word of the language,
    no day or month name. Each language has its own branch, so the lists stay literals."""

    def keep(stops: Sequence[str]) -> Column:
        skip = [*stops, *DAY_MONTH]
        return F.filter(
            words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$") & ~w.isin(*skip)
        )

    out = keep(())
    for language, stops in STOP_WORDS.items():
        out = F.when(lang == language, keep(stops)).otherwise(out)
    return out


def word_counts(
    docs: DataFrame,
    top: int | None = 30,
    bad: DataFrame | None = None,
    only: DataFrame | None = None,
    key: str = "source",
    text: str = "text",
    lang: str | None = None,
) -> DataFrame:
    """(source, word, n): most frequent words per source, ties alphabetical. `bad` words are
    removed, `only` restricts to a list; `top=None` keeps all, for exact sums over sources."""
    split = docs.select(key, tokens(F.col(text)).alias("_t"), *([F.col(lang).alias("_lang")] if lang else []))
    if not lang:
        split = split.withColumn("_s", language_score(F.col("_t")))
        split = split.withColumn("_lang", detect_language(F.col("_s")))
    words = unnest(split, topic_words(F.col("_t"), F.col("_lang")), "word", key)
    counts = words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    if bad is not None:
        counts = counts.join(bad.select("word").distinct(), "word", "left_anti")
    if only is not None:
        counts = counts.join(only.select("word").distinct(), "word", "left_semi")
    if top is None:
        return counts
    return top_per_group(counts, [key], [F.desc("n"), F.asc("word")], top)


# Words that strengthen, weaken or turn the next ones, their effect in millionths by the number
# of words between, and how many hundredths of a turned valence are left.
BOOSTERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially exceptionally extremely fully "
    "greatly highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly "
    "totally tremendously unbelievably unusually utterly very"
).split()
DAMPERS = "almost barely hardly kinda less little marginally occasionally partly scarcely slightly somewhat sorta".split()
NEGATIONS = (
    "not no never none nobody nothing neither nor nowhere without cannot cant dont doesnt didnt isnt wasnt wont aint don doesn didn isn "
    "wasn aren weren won wouldn shouldn couldn hasn haven hadn ain despite rarely seldom"
).split()
BOOST_BY_DISTANCE, TURNED = (293_000, 278_350, 263_700), -74
#: Units of a valence: half millionths, so that every step below is whole.
UNITS = 2_000_000


def shifted_words(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys..., total, word, boost, turned, side): each token with what the three before it do to its valence, and
    the side of the first `but` it stands on: 1 before it, 3 after it, 2 without one. A text without
    tokens has one row without a word."""
    split = docs.select(*keys, tokens(F.col(text)).alias("_t"))
    # What each word does to others: strengthen (1), weaken (-1), turn (2).
    kind = lambda w: F.when(w.isin(*BOOSTERS), 1).when(w.isin(*DAMPERS), -1).when(w.isin(*NEGATIONS), 2).otherwise(0)
    placed = split.select(*keys, "_t", F.transform("_t", kind).alias("_k"), F.array_position("_t", "but").alias("_but"))
    before = lambda i, n: F.coalesce(F.get("_k", i - n), F.lit(0))

    def boost(i: Column) -> Column:
        return reduce(Column.__add__, [F.when(F.abs(before(i, n)) == 1, before(i, n) * effect).otherwise(0) for n, effect in enumerate(BOOST_BY_DISTANCE, 1)])

    def turned(i: Column) -> Column:
        return reduce(Column.__or__, [before(i, n) == 2 for n in (1, 2, 3)])

    def side(i: Column) -> Column:
        return F.when(F.col("_but") == 0, 2).when(i + 1 < F.col("_but"), 1).when(i + 1 > F.col("_but"), 3).otherwise(2)

    entries = F.transform("_t", lambda w, i: F.struct(w.alias("word"), boost(i).alias("boost"), turned(i).alias("turned"), side(i).alias("side")))
    spread = placed.select(*keys, F.size("_t").alias("total"), F.explode_outer(entries).alias("e"))
    return spread.select(*keys, "total", "e.word", "e.boost", "e.turned", "e.side")


def with_valence(words: DataFrame, lexicon: DataFrame, how: str = "left") -> DataFrame:
    """Adds `valence` in UNITS to `shifted_words`: polarity, raised or lowered by boosters, turned by a negation,
    halved before a `but` and half as much again after it; and `subjectivity` in thousandths. Whole
    numbers, so that sums do not depend on their order."""
    known = lexicon.select("word", F.round(F.col("polarity") * 1000).cast("bigint").alias("_p"), *([F.round(F.col("subjectivity") * 1000).cast("bigint").alias("subjectivity")] if "subjectivity" in lexicon.columns else []))
    joined = words.join(known, "word", how)
    raised = F.col("_p") * 1000 + F.signum("_p").cast("bigint") * F.col("boost")
    shifted = F.when(F.col("_p") == 0, F.lit(0)).when(F.col("turned"), F.call_function("div", raised * TURNED, F.lit(100))).otherwise(raised)
    return joined.withColumn("valence", shifted * F.col("side")).drop("_p")


def lexicon_mood(docs: DataFrame, lexicon: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """Mood per source from a (word, polarity, subjectivity) lexicon: averages over the listed words with
    their valence shifted by the words before, shares of positive, neutral and negative tokens, a
    compound in -1..1 and a label."""
    scored = with_valence(shifted_words(docs, key, text=text), lexicon)
    sums = scored.groupBy(key).agg(
        F.max("total").alias("_total"),
        F.sum("valence").alias("_sum"),
        F.sum("subjectivity").alias("_subjectivity"),
        F.count("valence").alias("_listed"),
        F.count(F.when(F.col("valence") > 0, 1)).alias("_pos"),
        F.count(F.when(F.col("valence") < 0, 1)).alias("_neg"),
    )
    total, listed = F.greatest("_total", F.lit(1)), F.greatest("_listed", F.lit(1))
    valence = F.coalesce("_sum", F.lit(0))
    strength = valence / F.lit(float(UNITS))
    return sums.select(
        key,
        mood_label(strength / listed).alias("mood"),
        thousandths(valence, listed * (UNITS // 1000)).alias("polarity"),
        thousandths(F.coalesce("_subjectivity", F.lit(0)), listed).alias("subjectivity"),
        thousandths(F.col("_pos") * 1000, total).alias("positive"),
        thousandths((total - F.col("_pos") - F.col("_neg")) * 1000, total).alias("neutral"),
        thousandths(F.col("_neg") * 1000, total).alias("negative"),
        F.round(strength / F.sqrt(strength * strength + 15), 3).alias("compound"),
    )


def thousandths(value: Column, by: Column) -> Column:
    """The quotient of two whole numbers in thousandths, rounded half away from zero in whole numbers."""
    return F.signum(value) * F.call_function("div", F.abs(value) * 2 + by, by * 2) / 1000


def exact_mean(column: str) -> Column:
    """Mean of a double column: summed as decimals, so that it does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(20,9)")).cast("double") / F.count(column)


def mood_label(polarity: Column) -> Column:
    return F.when(polarity > 0.1, "Positive").when(polarity < -0.1, "Negative").otherwise("Neutral")


def mood_rollup(moods: DataFrame) -> DataFrame:
    """Sources and mean values per label. The single values stay rows of the mood table: a
    list of all of them has no bound."""
    return moods.groupBy("mood").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(exact_mean(c), 4).alias(c) for c in ("polarity", "subjectivity", "compound")],
    )


def counts_rollup(counts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Sum of counters (engine, bucket, key, n) over a filtered set of sources."""
    if sources is not None:
        counts = counts.join(sources.select(F.col("name").alias("source")), "source", "left_semi")
    return counts.groupBy("engine", "bucket", "key").agg(F.sum("n").alias("n"))


def cloud_terms(counts: DataFrame, k: int = 20) -> DataFrame:
    """The `k` heaviest terms with a weight relative to the first."""
    top = counts.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(k)
    return top.withColumn("weight", F.col("n") / top.agg(F.max("n")).scalar())


def translation_lookup(terms: DataFrame, memory: DataFrame) -> DataFrame:
    """Translate (lang, term) through a memory; unknown terms stay as they are."""
    known = memory.select("lang", "term", "translation")
    joined = terms.join(known, ["lang", "term"], "left")
    return joined.withColumn("translation", F.coalesce("translation", "term"))


def translation_update(memory: DataFrame, fresh: DataFrame) -> DataFrame:
    """The memory after an update: fresh entries win."""
    both = fresh.withColumn("_age", F.lit(0)).unionByName(memory.withColumn("_age", F.lit(1)))
    return first_by_key(both, ["lang", "term"], ["_age"]).drop("_age")


class Engines:
    """Analysis engines by name. An engine maps documents to (source, bucket, key, n) rows;
    merging engines or sources is always a sum."""

    def __init__(self) -> None:
        self._engines: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, engine: Callable[..., DataFrame]) -> None:
        self._engines[name] = engine

    def names(self) -> Sequence[str]:
        return sorted(self._engines)

    def analyse(self, docs: DataFrame, names: Sequence[str] | None = None, **context) -> DataFrame:
        out = None
        for name in names or self.names():
            rows = self._engines[name](docs, **context)
            rows = rows.select("source", F.lit(name).alias("engine"), "bucket", "key", "n")
            out = rows if out is None else out.unionByName(rows)
        return out


def words_engine(docs: DataFrame, **_) -> DataFrame:
    """Every word, so that sums over sources are exact; a report cuts its list after the sum."""
    rows = word_counts(docs, top=None)
    return rows.select("source", F.lit("commons").alias("bucket"), F.col("word").alias("key"), "n")
