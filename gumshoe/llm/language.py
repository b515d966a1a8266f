"""Language identification by cross parsing: how few pieces of a language's text make up a document."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import map_batches, texts_of

#: Labelled text per language: at most so many characters from at most so many documents, none
#: longer than the first bound; all languages together share TOTAL_CHARS.
LANGUAGE_CHARS = 32_000
LANGUAGE_DOCS = 100
TOTAL_CHARS = 160_000
#: Symbols: 0 pads, 1 is any run of other characters, 2 any letter that is not in the labelled text. If that has
#: more letters than there are symbols left, rare ones are spelled with DIGITS of them.
SYMBOLS, DIGITS = 64, 16
PAD, GAP, OTHER = 0, 1, 2
#: Symbols of one lane; a text is parsed in lanes that restart the match.
LANE = 512
#: No letter, or no language was learned.
UNDETERMINED = "und"
#: Labelled documents of a language, outside its learned text, that its limits are measured on, and their fewest letters.
MEASURED_DOCS, MEASURED_LEAST = 50, 200
#: A document is in a language up to this part of the way from the phrases per symbol of that language's
#: documents to those they would need had it not been learned, and from this part of their usual margin
#: to the second language. In texts of fewer symbols the margin is chance and is not asked for.
REACH, MARGIN, MARGIN_SYMBOLS = 2 / 3, 1 / 3, 100


@dataclass
class Symbols:
    """Symbol of each code point; of a rare letter its number, which is spelled in `places` digits after them."""

    table: np.ndarray
    number: np.ndarray | None = None
    places: int = 0


def symbol_table(texts: list[str]) -> Symbols:
    """The most frequent letters of the labelled text have a symbol of their own, the others a spelling."""
    counts = Counter()
    for text in texts:
        counts.update(c for c in text.lower() if c.isalpha())
    letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    table = np.full(0x110000, GAP, np.uint8)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = OTHER
    single = SYMBOLS - 3 if len(letters) <= SYMBOLS - 3 else SYMBOLS - 3 - DIGITS
    for i, c in enumerate(letters[:single]):
        table[ord(c)] = i + 3
    rare = letters[single:]
    if not rare:
        return Symbols(table)
    number = np.full(0x110000, -1, np.int32)
    for i, c in enumerate(rare):
        number[ord(c)] = i
    places = 1
    while DIGITS**places < len(rare):
        places += 1
    return Symbols(table, number, places)


def encode(text: str, symbols: Symbols) -> np.ndarray:
    """Symbols of the lower-cased text, each run of other characters as one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = symbols.table[points]
    gap = codes == GAP
    gap[1:] &= gap[:-1]
    if len(gap):
        gap[0] = False
    codes = codes[~gap]
    if symbols.number is None:
        return codes
    number = symbols.number[points[~gap]]
    rare = number >= 0
    if not rare.any():
        return codes
    each = np.where(rare, symbols.places, 1)
    out, first = np.repeat(codes, each), np.cumsum(each) - each
    for k in range(symbols.places):
        out[first[rare] + k] = SYMBOLS - DIGITS + number[rare] // DIGITS**k % DIGITS
    return out


def suffix_automaton(codes: np.ndarray) -> np.ndarray:
    """Transitions (states x symbols, -1 for none) of the automaton of all substrings; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    out = np.full((len(moves), SYMBOLS), -1, np.int32)
    for s, row in enumerate(moves):
        for c, t in row.items():
            out[s, c] = t
    return out


@dataclass
class Model:
    """One table for all languages: entry [state + symbol] is 2 * next state, plus 1 if a match ended
    there and the next began; states count in steps of SYMBOLS. roots: each language's start.
    most, least: each language's limits on phrases per symbol and margin, none where nothing was measured."""

    languages: list[str]
    symbols: Symbols
    moves: np.ndarray
    roots: np.ndarray
    most: np.ndarray | None = None
    least: np.ndarray | None = None


def fit(samples: dict[str, list[str]]) -> Model:
    """Suffix automata of the languages' texts. Where an automaton knows no continuation, the longest
    match is over: the step counts a phrase and starts again from the same symbol."""
    languages = sorted(samples)
    table = symbol_table([t for k in languages for t in samples[k]])
    parts, roots, first = [], [], 0
    for language in languages:
        gap = np.array([GAP], np.uint8)
        codes = np.concatenate([x for t in samples[language] for x in (encode(t, table), gap)] or [gap])
        states = suffix_automaton(codes)
        restart = np.maximum(states[0], 0)
        ended = states < 0
        target = np.where(ended, restart[None, :], states)
        moves = np.int32(2 * SYMBOLS) * (target + np.int32(first)) + ended
        moves[:, PAD] = 2 * SYMBOLS * (np.arange(len(states)) + first)
        parts.append(moves.astype(np.int32, copy=False).ravel())
        roots.append(SYMBOLS * first)
        first += len(states)
    return Model(languages, table, np.concatenate(parts or [np.zeros(0, np.int32)]), np.array(roots, np.int32))


def measure(model: Model, held_out: dict[str, list[str]]) -> Model:
    """The model with limits for `determined`, from labelled texts it was not fitted on. Texts of a
    language read by the others stand for those of a language that was not learned; if only one was,
    their letters in a random order do. Medians, as labels may be wrong. A language without such texts
    has the widest limits of the others."""
    names, parser = model.languages, Parser(model)
    model.most, model.least = np.full(len(names), np.inf), np.full(len(names), -np.inf)
    rng = np.random.default_rng(67)
    known = []
    for k, name in enumerate(names):
        texts = [t for t in held_out.get(name, []) if sum(map(str.isalpha, t)) >= MEASURED_LEAST][:MEASURED_DOCS]
        if not texts:
            continue
        phrases, sizes, _ = parser.phrases(texts)
        own = phrases[k] / sizes
        if len(names) > 1:
            other = np.delete(phrases, k, axis=0).min(axis=0) / sizes
            model.least[k] = MARGIN * np.median(1 - own / other)
        else:
            mixed, lengths, _ = parser.phrases(["".join(rng.permutation(list(t))) for t in texts])
            other = mixed[0] / lengths
        model.most[k] = np.median(own) + REACH * max(0.0, np.median(other) - np.median(own))
        known.append(k)
    if known:
        rest = np.setdiff1d(np.arange(len(names)), known)
        model.most[rest], model.least[rest] = model.most[known].max(), model.least[known].min()
    return model


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on labelled documents, per language those whose id's hash is lowest, within the bounds above;
    the limits of the languages are measured on others of them. A language that has only longer texts is
    learned from the first LANGUAGE_CHARS characters of the shortest."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    size = F.length(text_col)
    rows = rows.filter(size > 0).select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.greatest(size - LANGUAGE_CHARS, F.lit(0)).alias("over"))
    order = Window.partitionBy("lang").orderBy("over", F.xxhash64("doc_id"), "doc_id")
    chosen = rows.distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= LANGUAGE_DOCS)
    chosen = chosen.filter((F.col("over") == 0) | (F.col("n") == 1)).drop("over").toPandas()
    if not len(chosen):
        return fit({})
    spark = docs.sparkSession
    wanted = spark.createDataFrame(chosen, "doc_id bigint, lang string, n int")
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.substring(text_col, 1, LANGUAGE_CHARS).alias("text")).join(F.broadcast(wanted), ["doc_id", "lang"])
    found = found.filter(F.length("text") > 0).toPandas().sort_values(["lang", "n", "text"])
    share = min(LANGUAGE_CHARS, TOTAL_CHARS // found["lang"].nunique()) if len(found) else 0
    samples: dict[str, list[str]] = {}
    held_out: dict[str, list[str]] = {}
    for language, part in found.groupby("lang"):
        size, texts, others = 0, samples.setdefault(language, []), held_out.setdefault(language, [])
        for text in part["text"]:
            if texts and size + len(text) > share:
                others.append(text)
                continue
            texts.append(text)
            size += len(text)
    return measure(fit(samples), held_out)


class Parser:
    """Parses batches of whole texts against all languages at once."""

    def __init__(self, model: Model):
        self.model = model

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, symbols, whether there is a letter)."""
        model = self.model
        codes = [encode(t, model.symbols) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        lanes = -(-sizes // LANE)
        first = np.concatenate([[0], np.cumsum(lanes)])
        flat = np.zeros(int(first[-1]) * LANE, np.uint8)
        for c, at in zip(codes, first.tolist()):
            flat[at * LANE : at * LANE + len(c)] = c
        letters = np.array([bool((c > GAP).any()) for c in codes], bool)
        counts = np.zeros((len(model.languages), int(first[-1])), np.int32)
        if counts.size:
            steps = np.ascontiguousarray(flat.reshape(-1, LANE).T).astype(np.int32)
            state = np.repeat(model.roots[:, None], counts.shape[1], 1)
            step = np.empty_like(state)
            for c in steps:
                np.add(state, c, out=step)
                np.take(model.moves, step, out=state, mode="clip")
                np.bitwise_and(state, 1, out=step)
                counts += step
                np.right_shift(state, 1, out=state)
            counts += 1
        total = np.concatenate([np.zeros((len(model.languages), 1), np.int64), np.cumsum(counts, axis=1, dtype=np.int64)], axis=1)
        return total[:, first[1:]] - total[:, first[:-1]], sizes, letters

    def determined(self, texts: list[str]) -> list[str]:
        """The language of each text, without a name where none was learned, `und` also where its best language needs more phrases per symbol
        than that language's documents do, or hardly fewer than the second. The phrase that the end of
        a lane cuts is not counted."""
        phrases, sizes, letters = self.phrases(texts)
        names, scores = self._named(phrases, sizes, letters)
        if not self.model.languages:
            return ["" if x else UNDETERMINED for x in letters]
        most, least = self.model.most, self.model.least
        if most is None:
            return names
        number = {n: k for k, n in enumerate(self.model.languages)}
        lanes = -(-sizes // LANE)
        for i, (name, score) in enumerate(zip(names, scores)):
            if (k := number.get(name) if letters[i] else None) is not None:
                strange = phrases[k, i] - lanes[i] > most[k] * sizes[i]
                if strange or sizes[i] >= MARGIN_SYMBOLS and score < least[k]:
                    names[i] = UNDETERMINED
        return names

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        return self._named(*self.phrases(texts))

    def _named(self, phrases: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i in range(len(sizes)):
            if not letters[i] or not self.model.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            rate = phrases[:, i] / sizes[i]
            order = np.argsort(rate, kind="stable")
            names.append(self.model.languages[order[0]])
            scores.append(float(1.0 - rate[order[0]] / rate[order[1]]) if len(order) > 1 else 1.0)
        return names, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the language whose text makes up the document in the fewest
    phrases per symbol, ties to the first name, and by what share the second needs more.

    The automata, of bounded size, are broadcast; each text is parsed whole where it is read. Null,
    empty and letterless texts are `und` with score 0, as are all texts if no language was learned;
    repeated rows and null ids are kept; no rows give no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        parser = Parser(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = parser.predict(texts_of(batch.column(1)))
            return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

        return step

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, "doc_id bigint, lang_pred string, score double")


def determined_documents(docs: DataFrame, model: Model, languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is in a language the model learned and, if
    `languages` are given, in one of them (`Parser.determined`). Null, empty and letterless texts, letter
    junk, texts of other languages and texts mixed of several go. Where no language was learned, or no
    labelled text was left to measure limits on, any text with a letter passes for determined."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    wanted = None if languages is None else set(languages)

    def make():
        parser = Parser(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = parser.determined(texts_of(batch.column(at)))
            return batch.filter(pa.array([n != UNDETERMINED and (wanted is None or n in wanted) for n in names], pa.bool_()))

        return step

    return map_batches(docs, make, docs.schema)
