"""Ranked lexical search: term at a time, rarest first, with a limited set of accumulators."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.llm.common import Scratch, small_batches

#: Bytes of item texts that are searched in one pass over the documents: what a task holds of them.
ITEM_BYTES = 4_000_000
#: Documents and postings that a task ranks at a time.
DOCUMENTS, POSTINGS = 8192, 1_500_000
#: Names of the totals among the counts of a block's terms.
_DOCS, _WORDS = -1, -2


def _table() -> bytes:
    """Bytes of terms as they count: ASCII letters in lower case, digits and all beyond ASCII; others part terms."""
    keep = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(ord(chr(b).lower()) if b < 0x80 and keep(b) else b if keep(b) else 0x20 for b in range(256))


TERMS = _table()


def terms_of(text: bytes) -> list[bytes]:
    """All terms of a text, with repeats."""
    return text.translate(TERMS).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """Items of one pass: their terms, each once, by number."""

    ids: list[int]
    terms: list[np.ndarray]
    numbers: dict[bytes, int]

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> Items:
        """Rows that repeat an id are one item with the terms of all."""
        numbers: dict[bytes, int] = {}
        own: dict[int, dict[int, None]] = {}
        for i, text in rows:
            own.setdefault(i, {}).update(dict.fromkeys(numbers.setdefault(t, len(numbers)) for t in terms_of(text)))
        return Items(list(own), [np.array(list(ts), np.int64) for ts in own.values()], numbers)


@dataclass
class Ranker:
    """The best documents of each item so far among those a task has met."""

    items: Items
    documents: int
    words: int
    weights: np.ndarray
    order: list[np.ndarray]
    k: int
    best: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    postings_read: int = 0
    accumulators: int = 0

    @staticmethod
    def of(items: Items, documents: int, words: int, df: np.ndarray, k: int) -> Ranker:
        weights = np.array([weight(documents, int(n)) if n else 0 for n in df], np.int64)
        # Rarest first; a term that no document holds is left out.
        order = [own[np.lexsort((own, df[own]))] for own in items.terms]
        order = [own[df[own] > 0] for own in order]
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return Ranker(items, documents, words, weights, order, k, [empty] * len(items.ids))

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Rank documents (ids, lengths) by their postings (doc, term, tf), each document once."""
        norm = 100 - 50 + (50 * lengths * self.documents) // max(self.words, 1)
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc]))
        by_term = np.argsort(term, kind="stable")
        doc, part = doc[by_term], part[by_term]
        ends = np.searchsorted(term[by_term], np.arange(len(self.weights) + 1))
        most = np.zeros(len(self.weights), np.int64)
        held = np.flatnonzero(np.diff(ends))
        most[held] = np.maximum.reduceat(part, ends[held]) if len(held) else 0
        score = np.zeros(len(ids), np.int64)
        for item, own in enumerate(self.order):
            own = own[most[own] > 0]
            if not len(own):
                continue
            score[:] = 0
            known = self.best[item][0]
            floor = int(known[-1]) if len(known) == self.k else 0
            rest = np.cumsum(most[own][::-1])[::-1]
            limited = False
            for at, t in enumerate(own.tolist()):
                docs, parts = doc[ends[t] : ends[t + 1]], part[ends[t] : ends[t + 1]]
                # What the terms left may still give is less than the k-th partial score: no document
                # without an accumulator can be among the k best, so no more are made.
                limited = limited or int(rest[at]) < max(floor, self._kth(score, int(rest[at])))
                if limited:
                    going = score[docs] > 0
                    docs, parts = docs[going], parts[going]
                score[docs] += parts
                self.postings_read += len(docs)
            self._keep(item, ids, score, floor)

    def _kth(self, score: np.ndarray, bound: int) -> int:
        """The k-th largest partial score where it can be above the bound."""
        if len(score) < self.k or int(score.max()) <= bound:
            return 0
        return int(np.partition(score, len(score) - self.k)[len(score) - self.k])

    def _keep(self, item: int, ids: np.ndarray, score: np.ndarray, floor: int) -> None:
        at = np.flatnonzero(score >= max(floor, 1))
        self.accumulators += int((score > 0).sum())
        known, names = self.best[item]
        score, ids = np.concatenate([known, score[at]]), np.concatenate([names, ids[at]])
        order = np.lexsort((ids, -score))[: self.k]
        self.best[item] = score[order], ids[order]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            yield i, text.as_py() or b""


def _counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """Documents that hold each of the items' terms, documents with a term, and all their terms."""
    shared = docs.sparkSession.sparkContext.broadcast(items.numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        names = numbers.keys()
        found: Counter = Counter()
        documents = words = 0
        for _, text in _rows(batches):
            terms = terms_of(text)
            documents += bool(terms)
            words += len(terms)
            found.update(names & set(terms))
        yield pa.record_batch(
            [pa.array([_DOCS, _WORDS, *(numbers[t] for t in found)], pa.int64()), pa.array([documents, words, *found.values()], pa.int64())], names=["term", "n"]
        )

    counted = docs.select("doc_id", "text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.toLocalIterator()}


def _ranked(docs: DataFrame, items: Items, counts: dict[int, int], k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of each item among those of each task."""
    df = np.array([counts.get(t, 0) for t in range(len(items.numbers))], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((items, counts.get(_DOCS, 0), counts.get(_WORDS, 0), df))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, documents, words, df = shared.value
        ranker = Ranker.of(items, documents, words, df, k)
        names = items.numbers
        ids: list[int] = []
        lengths: list[int] = []
        terms: list[int] = []
        tfs: list[int] = []
        held: list[int] = []

        def rank() -> None:
            doc = np.repeat(np.arange(len(ids)), held)
            ranker.add(np.array(ids, np.int64), np.array(lengths, np.int64), doc, np.array(terms, np.int64), np.array(tfs, np.int64))
            for x in (ids, lengths, terms, tfs, held):
                x.clear()

        for i, text in _rows(batches):
            if i is None:
                continue
            own = terms_of(text)
            counted = Counter(own)
            found = [(names[t], n) for t, n in counted.items() if t in names]
            if not found:
                continue
            ids.append(i)
            lengths.append(len(own))
            held.append(len(found))
            terms.extend(t for t, _ in found)
            tfs.extend(n for _, n in found)
            if len(ids) >= DOCUMENTS or len(terms) >= POSTINGS:
                rank()
        if ids:
            rank()
        for item, (score, doc) in zip(items.ids, ranker.best):
            if len(score):
                yield pa.record_batch([pa.array(np.full(len(score), item)), pa.array(doc), pa.array(score)], names=["item_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item, equal scores
    by ascending doc_id.

    A term is worth floor(1000 ln((2 N + 2) / (2 df + 1))), in a document times (10^9 tf) div (1000 tf + 20 m)
    with m = 50 + (50 n N) div L, so the score is a whole number and the same wherever it is summed.

    1. The items are taken in blocks of bounded size; each block reads all documents twice.
    2. First for the counts of its terms, the documents with a term and the length of all.
    3. Then each task ranks its documents for each item, term at a time, the rarest first. When the terms left
       cannot lift a document that holds none so far to the k-th partial score, no more accumulators
       are made; those there are go on to their exact scores.
    4. The k best of each task meet in a ranking that is cut in each task first.

    Null and empty texts have no terms and are in no result and no count. Documents without an id count but
    are not returned; repeated rows are documents of their own. Items without an id or a term have no
    rows; rows that repeat an item's id are one item with all their terms. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).cast("binary").alias("text"))
    items = items.filter("item_id is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    scratch = Scratch(docs.sparkSession, "lexical")
    found = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        block_items = Items.of([(r["item_id"], bytes(r["text"])) for r in own.toLocalIterator()])
        ranked = scratch.keep(_ranked(docs, block_items, _counts(docs, block_items), k))
        found = ranked if found is None else found.unionByName(ranked)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
