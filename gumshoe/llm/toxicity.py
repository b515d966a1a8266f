"""Toxicity by multiple-instance learning: documents carry the labels, sentences the scores."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Recent, map_batches, texts_of

#: The model is fitted on at most so many labelled documents and characters. Each label has its share of
#: them, a rare one at least this part; a document too long for what is left is passed over.
SAMPLE_DOCS = 6_000
SAMPLE_CHARS = 20_000_000
RARE = 0.1
EPOCHS = 100
DECAY = 0.5
#: Features in fewer sample documents, or with a weaker log odds ratio in standard errors, get no weight.
LEAST_DOCS, LEAST_ODDS, FEATURES = 4, 2.0, 5000
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]?")
ENDS = (".", "!", "?")
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»¿¡“”‘’…"


def tokens_of(text: str) -> list[str]:
    """Lower-cased words with their punctuation; a line break stands as a word of its own."""
    return text.lower().replace("\n", " . ").split()


def features_of(token: str) -> list[str]:
    """The bare word and its beginnings of three to five letters, which inflected forms share."""
    word = token.strip(EDGES)
    return [word, *(word[:n] + "*" for n in (3, 4, 5) if len(word) > n)] if word else []


@dataclass
class Model:
    """Weights of features and the bias of every sentence."""

    weights: dict[str, float]
    bias: float


def tokens_with(weights: dict[str, float]) -> Recent:
    """Token -> its weight, plus 1j if it ends a sentence."""
    weight = weights.get
    return Recent(lambda token: complex(sum(weight(x, 0.0) for x in features_of(token)), token.endswith(ENDS)))


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Places of the first words of sentences."""
    starts = np.flatnonzero(ends) + 1
    return np.concatenate([[0], starts[starts < len(ends)]])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def telling_features(texts: list[str], toxic: list[int]) -> list[str]:
    """The features whose share among toxic documents differs most clearly from that among the others."""
    counts, features = (Counter(), Counter()), Recent(features_of)
    features.SIZE = 30_000
    for text, label in zip(texts, toxic):
        counts[label > 0].update(set().union(*map(features.__getitem__, set(tokens_of(text)))))
    n_one = sum(x > 0 for x in toxic)
    n_none = len(toxic) - n_one
    names = sorted(x for x in counts[0].keys() | counts[1].keys() if counts[0][x] + counts[1][x] >= LEAST_DOCS)
    one = np.array([counts[1][x] for x in names], float)
    none = np.array([counts[0][x] for x in names], float)
    odds = np.log((one + 0.5) / (n_one - one + 0.5)) - np.log((none + 0.5) / (n_none - none + 0.5))
    clear = np.abs(odds) / np.sqrt(1 / (one + 0.5) + 1 / (none + 0.5) + 1 / (n_one - one + 0.5) + 1 / (n_none - none + 0.5))
    best = np.argsort(-clear, kind="stable")[:FEATURES]
    return [names[i] for i in best if clear[i] >= LEAST_ODDS]


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS) -> Model:
    """Logistic sentence scores p, combined as 1 - prod(1 - p), fitted to the documents' labels by
    full-gradient Adam steps with a decay of the weights; the same input gives the same model."""
    if not toxic or not 0 < sum(toxic) < len(toxic):
        return Model({}, 8.0 if toxic and sum(toxic) else -20.0)
    names = telling_features(texts, toxic)
    number = {x: i for i, x in enumerate(names)}
    types: dict[str, int] = {}
    features: list[int] = []
    counts: list[int] = []
    tokens, sentences, owners, y = [], [], [], []
    total = 0
    for text, label in zip(texts, toxic):
        words = tokens_of(text)
        if not words:
            continue
        for t in words:
            if t in types:
                continue
            types[t] = len(types)
            own = [number[x] for x in features_of(t) if x in number]
            features += own
            counts.append(len(own))
        tokens.append(np.fromiter(map(types.__getitem__, words), np.int32, len(words)))
        starts = sentence_starts(np.fromiter((t.endswith(ENDS) for t in words), bool, len(words)))
        sentences.append(np.repeat(np.arange(total, total + len(starts), dtype=np.int32), np.diff(np.append(starts, len(words)))))
        owners.append(np.full(len(starts), len(y), np.int32))
        total += len(starts)
        y.append(label > 0)
    token, sentence, owner, label = np.concatenate(tokens), np.concatenate(sentences), np.concatenate(owners), np.array(y, float)
    count = np.array(counts)
    first = np.cumsum(count) - count
    told = count[token] > 0
    token, sentence = token[told], sentence[told]
    size = count[token]
    end = np.cumsum(size)
    word = np.array(features, np.int64)[np.arange(size.sum()) + np.repeat(first[token] - (end - size), size)]
    sentence = np.repeat(sentence, size)
    n_words, n_docs = len(names), len(y)
    theta = np.zeros(n_words + 1)
    theta[-1] = np.log(max(label.mean(), 1e-3) / (total / n_docs))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], total)
        s = np.bincount(owner, _softplus(z), n_docs)
        pull = np.where(label > 0, -1.0 / np.expm1(np.clip(s, 1e-9, 50.0)), 1.0)
        dz = pull[owner] / (1.0 + np.exp(-np.clip(z, -50, 50)))
        grad = np.append(np.bincount(word, dz[sentence], n_words), dz.sum())
        grad[:-1] += DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (0.2 if step > 0.8 * epochs else 1.0)
    return Model({x: float(w) for x, w in zip(names, theta) if abs(w) > 0.02}, float(theta[-1]))


def fit_on(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents, per label those whose id's hash is lowest, within the bounds above.

    A document labelled twice counts as toxic if one label says so; null ids and labels are skipped.
    """
    ids = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    ids = ids.withColumn("label", (F.col("label") > 0).cast("int"))
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    if not counts:
        return Model({}, -20.0)
    share = {k: max(RARE, n / sum(counts.values())) for k, n in counts.items()}
    share = {k: v / sum(share.values()) for k, v in share.items()}
    # A limit on the hash for each label leaves about a tenth more than its share, wherever the rows lie.
    hashed = F.xxhash64("doc_id")
    limit = F.lit(False)
    for label, n in counts.items():
        part = min(1.0, (1.1 * share[label] * SAMPLE_DOCS + 50) / n)
        limit = limit | ((F.col("label") == label) & (hashed <= min(2**63 - 1, -(2**63) + int(2**64 * part))))
    ids = ids.filter(limit).withColumn("hash", hashed).toPandas().sort_values(["label", "hash", "doc_id"])
    ids["place"] = ids.groupby("label").cumcount() + 1
    ids = ids[ids["place"] <= ids["label"].map(share).mul(SAMPLE_DOCS).clip(lower=1)][["doc_id", "label", "place"]]
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id bigint, label int, place int")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # Every text of an id that is repeated is taken, so all of them count.
    sized = rows.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("hash")).join(F.broadcast(wanted), "doc_id")
    sized = sized.dropDuplicates(["doc_id", "hash"]).groupBy("doc_id", "label", "place").agg(F.sum("n").alias("n"))
    sized = sized.toPandas().sort_values(["label", "place"])
    if not len(sized):
        return Model({}, -20.0)
    taken: list[bool] = []
    for label, part in sized.groupby("label"):
        left, own = share[label] * SAMPLE_CHARS, []
        for n in part["n"]:
            own.append(n <= left)
            left -= n * own[-1]
        if not any(own):
            own[int(part["n"].to_numpy().argmin())] = True
        taken += own
    sized = sized[taken]
    wanted = docs.sparkSession.createDataFrame(sized[["doc_id", "label"]], "doc_id bigint, label int")
    found = rows.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id", "text"]).toPandas()
    found = found.sort_values(["doc_id", "text"])
    return fit(found["text"].tolist(), found["label"].tolist())


class Scorer:
    """Scores texts with a model; also finds the sentences that are toxic by themselves."""

    def __init__(self, model: Model):
        self.tokens, self.bias = tokens_with(model.weights), model.bias

    def sentences(self, text: str) -> np.ndarray:
        words = tokens_of(text)
        if not words:
            return np.zeros(0)
        found = np.fromiter(map(self.tokens.__getitem__, words), np.complex128, len(words))
        return self.bias + np.add.reduceat(found.real, sentence_starts(found.imag))

    def score(self, text: str) -> float:
        return float(-np.expm1(-_softplus(self.sentences(text)).sum()))

    def offending(self, text: str) -> list[dict]:
        """Spans of sentences with a score of one half or more, as (start, end, score)."""
        out = []
        for found in SENTENCE.finditer(text):
            if found.group().strip():
                score = self.score(found.group())
                if score >= 0.5:
                    out.append({"start": found.start(), "end": found.end(), "score": score})
        return out


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, offending) for each row: the noisy-or of its sentences' scores, 1 if
    that is one half or more, and the offending sentences' spans in a rejected text.

    The model, of bounded size, is broadcast; each text is scored where it is read. Null and empty
    texts score 0; repeated rows and null ids are kept; no rows give no rows; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(1))
            scores = [scorer.score(x) for x in texts]
            spans = [scorer.offending(x) if s >= 0.5 else [] for x, s in zip(texts, scores)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return pa.record_batch(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)],
                names=["doc_id", "score", "predicted", "offending"],
            )

        return step

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, "doc_id bigint, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model does not call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def make():
        scorer = Scorer(shared.value)
        return lambda batch: batch.filter(pa.array([scorer.score(x) < 0.5 for x in texts_of(batch.column(at))], pa.bool_()))

    return map_batches(docs, make, docs.schema)


def id_remainder(id_col: str, parts: int) -> Column:
    """Remainder of the checksum of the id as text; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
