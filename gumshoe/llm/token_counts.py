"""Tokens per document from the piece counts of distinct pre-tokens."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import BATCH_ROWS, Scratch, map_batches, small_batches, texts_of

#: Most frequent pre-tokens whose piece counts every task holds: at most so many rows are broadcast.
FREQUENT = 300_000
#: Distinct pre-tokens a task gathers before it passes their counts on.
GATHERED = 150_000


def pre_tokens(text: str) -> list[bytes]:
    """Runs between ASCII white space. The vocabulary's own pattern drops white space and never
    matches across it, so the pieces of a text are those of these runs."""
    return text.encode().split()


def frequencies(docs: DataFrame) -> DataFrame:
    """(pre, freq): how often each distinct pre-token of the column `text` occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys = list(seen)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                yield pa.record_batch([pa.array([k.decode() for k in part], pa.string()), pa.array([seen[k] for k in part], pa.int64())], names=["pre", "freq"])
            seen.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                for text in texts_of(batch.column(0).slice(at, BATCH_ROWS)):
                    seen.update(pre_tokens(text))
                if len(seen) >= GATHERED:
                    yield from out()
        yield from out()

    return docs.select("text").mapInArrow(run, "pre string, freq bigint").groupBy("pre").agg(F.sum("freq").alias("freq"))


@lru_cache(maxsize=1)
def _library(path: str):
    """The tokenizer of a file, loaded once for each worker process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def piece_counts(vocabulary: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds `pieces` to (pre, freq): how many tokens the library gives for the pre-token."""

    def make():
        tokenizer = _library(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            return pa.record_batch([*batch.columns, pa.array([len(x) for x in found], pa.int64())], names=["pre", "freq", "pieces"])

        return step

    return map_batches(vocabulary.select("pre", "freq"), make, "pre string, freq bigint, pieces bigint")


def octave(freq: str = "freq") -> Column:
    """Frequencies by eighths of octaves: a fixed number of bins."""
    return F.floor(F.log2(freq) * 8)


def least_octave(vocabulary: DataFrame, most: int) -> int:
    """The lowest bin of frequencies from which on there are at most `most` pre-tokens."""
    bins = sorted(tuple(r) for r in vocabulary.groupBy(octave().alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = sum(n for _, n in bins)
    for at, n in bins:
        if left <= most:
            return at
        left -= n
    return 8 * 64


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row, exactly as encoding the whole text would count.

    The pieces of a pre-token are counted once in the corpus. A document's pre-token frequencies meet
    those counts in two joins: the most frequent pre-tokens (a fixed number) are broadcast and summed
    where the text is read, since they would be hot keys; the others go through an equi join on the
    pre-token and a sum by row. No ids are kept. A null or empty text has 0 bytes and tokens;
    repeated rows are counted apart; no rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "token-counts")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = scratch.keep(piece_counts(frequencies(rows), tokenizer_path))
    top = vocabulary.filter(octave() >= least_octave(vocabulary, frequent)).select("pre", "pieces").toArrow()
    known = spark.sparkContext.broadcast({k.encode(): v for k, v in zip(top.column(0).to_pylist(), top.column(1).to_pylist())})
    del top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        find = pieces.get
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sizes, sums, rare, keys = [], [], [], []
                for text in texts_of(batch.column(1)):
                    words = pre_tokens(text)
                    found = [find(w, -1) for w in words]
                    missing = found.count(-1)
                    sizes.append(len(text.encode()))
                    sums.append(sum(found) + missing)
                    rare.append([w.decode() for w, n in zip(words, found) if n < 0] if missing else [])
                    keys.append(number)
                    number += 1
                yield pa.record_batch(
                    [pa.array(keys, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rare, pa.list_(pa.string()))],
                    names=["row", "doc_id", "n_bytes", "frequent", "rare"],
                )

    counted = scratch.keep(rows.mapInArrow(run, "row bigint, doc_id bigint, n_bytes bigint, frequent bigint, rare array<string>"))
    rest = counted.select("row", F.explode("rare").alias("pre")).join(vocabulary.select("pre", "pieces"), "pre").groupBy("row").agg(F.sum("pieces").alias("more"))
    return counted.select("row", "doc_id", "n_bytes", "frequent").join(rest, "row", "left").select(
        "doc_id", "n_bytes", (F.col("frequent") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )
