"""Language of a text: by a model of letter sequences learned from labelled texts, or by stop words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.text import tokens

# Common function words per language.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or had by but not what were we when".split(),
    "fr": "le la les de des du un une et est que qui dans pour pas sur au aux avec ce il elle par plus sont en ne se son sa".split(),
    "de": "der die das und ist nicht ein eine zu den dem des mit von auf für sich im auch als an nach wie bei oder aus er sie".split(),
    "es": "el la los las de del un una y es que en por para con no se su al lo como más pero sus le ya o este sí porque".split(),
}
ALL_STOP_WORDS = sorted({w for words in STOP_WORDS.values() for w in words})


def language_score(words: Column) -> Column:
    """Struct with the number of tokens that are stop words of each language."""

    def hits(stops: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*stops)))

    return F.struct(*[hits(stops).alias(language) for language, stops in STOP_WORDS.items()])


def detect_language(scores: Column) -> Column:
    """Best language, ties by the order above; null when no stop word occurs."""
    best = F.greatest(*[scores[language] for language in STOP_WORDS])
    out = F.lit(None).cast("string")
    for language in reversed(STOP_WORDS):
        out = F.when(scores[language] == best, F.lit(language)).otherwise(out)
    return F.when(best > 0, out)


#: Slots of the model's table, in which sequences of three letters share places by a hash of their code points.
SLOTS, FACTOR = 1 << 16, 65_599
#: Letters that are worked on at a time.
LETTERS = 2_000_000
#: Name of texts without a letter.
UNDETERMINED = "und"


def lettered(text: Column) -> Column:
    """Lower-case words of letters between blanks, also before the first and after the last."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _sequences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of the sequences of three letters of texts, some texts at a time or one in parts."""

    def of(some: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(t for _, t in some).encode("utf-32-le"), np.uint32).astype(np.uint64)
        own = np.repeat([i for i, _ in some], [len(t) for _, t in some])
        part = np.repeat(np.arange(len(some)), [len(t) for _, t in some])
        slots = ((points[:-2] * np.uint64(FACTOR) + points[1:-1]) * np.uint64(FACTOR) + points[2:]) % np.uint64(SLOTS)
        inside = part[:-2] == part[2:]
        return own[:-2][inside], slots[inside].astype(np.int64)

    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - 2, 0), LETTERS):
            held.append((i, text[at : at + LETTERS + 2]))
            size += len(held[-1][1])
            if size >= LETTERS:
                yield of(held)
                held, size = [], 0
    if held:
        yield of(held)


@dataclass
class LanguageModel:
    """For each language how unlikely a sequence of three letters is, in thousandths of the natural logarithm; whole
    numbers, so that a text's sum is the same however it is parted."""

    languages: list[str]
    costs: np.ndarray

    @staticmethod
    def of(languages: list[str], counts: np.ndarray) -> LanguageModel:
        """Add-one estimates from (language, slot) counts."""
        totals = counts.sum(axis=1)
        costs = [[math.floor(1000 * math.log((int(total) + SLOTS) / (int(n) + 1))) for n in row] for total, row in zip(totals, counts)]
        return LanguageModel(languages, np.array(costs, np.int64).reshape(len(languages), SLOTS))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cost of each text in each language, sequences of each text); texts as `lettered` gives them."""
        costs, sequences = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        for text, slots in _sequences(texts):
            sequences += np.bincount(text, minlength=len(texts))
            for k in range(len(self.languages)):
                # Sums stay far below 2 ** 53, so the weights are exact.
                costs[:, k] += np.bincount(text, self.costs[k][slots], len(texts)).astype(np.int64)
        return costs, sequences


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts of all labelled texts, added up in the tasks. The model has SLOTS numbers a language; rows without
    a label or text teach nothing. Without any there is no language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                own = counts.setdefault(name, np.zeros(SLOTS, np.int64))
                for _, slots in _sequences([t for n, t in zip(names, texts) if n == name]):
                    own += np.bincount(slots, minlength=SLOTS)
        for name, own in counts.items():
            slots = np.flatnonzero(own)
            yield pa.record_batch([pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int64()), pa.array(own[slots], pa.int64())], names=["lang", "slot", "n"])

    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), lettered(F.col(text)).alias("text"))
    summed = labelled.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((len(languages), SLOTS), np.int64)
    place = {name: k for k, name in enumerate(languages)}
    counts[[place[n] for n in rows.column("lang").to_pylist()], rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return LanguageModel.of(languages, counts)


def score_languages(docs: DataFrame, model: LanguageModel, key: str, text: str = "text") -> DataFrame:
    """(key, lang, cost, sequences) of each row: the language in which the text is least unlikely, ties by name; `und`
    without letters, or where no language is known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            costs, sequences = model.scores(batch.column(1).to_pylist())
            if model.languages:
                best = costs.argmin(axis=1)
                names = [model.languages[k] if n else UNDETERMINED for k, n in zip(best, sequences)]
                cost = np.take_along_axis(costs, best[:, None], 1)[:, 0] if len(best) else sequences
            else:
                names, cost = [UNDETERMINED] * len(sequences), np.zeros(len(sequences), np.int64)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(cost), pa.array(sequences)], names=[key, "lang", "cost", "sequences"])

    rows = docs.select(key, lettered(F.col(text)).alias("_text"))
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, lang string, cost bigint, sequences bigint"
    return rows.mapInArrow(run, schema)


def with_language(df: DataFrame, text: str = "text", out: str = "lang") -> DataFrame:
    """Adds the detected language. Tokens and scores are columns of their own, so each text is
    tokenised once."""
    columns = [c for c in df.columns if c != out]
    scored = df.select(*columns, tokens(F.col(text)).alias("_words")).select(
        *columns, language_score(F.col("_words")).alias("_scores")
    )
    return scored.select(*columns, detect_language(F.col("_scores")).alias(out))
