"""Packing of examples into training sequences under several limits at once (vector bin packing)."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gumshoe.llm.common import BATCH_ROWS, small_batches
from gumshoe.llm.units import UnitEncoder

END_ID = 0


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold: tokens, segments (pieces of examples) and loss-bearing tokens."""

    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


@dataclass
class Piece:
    example: int
    start: int
    length: int
    offset: int


class Packer:
    """Packs a stream of examples; holds a bounded pool of those that do not fill a sequence alone.

    An example is its number of tokens and how many of them, the last ones, bear loss. Stretches that
    fill a sequence alone are cut off at once. The rests wait in the pool; a sequence takes, again and
    again, the rest that fits and whose demand (tokens, segments, loss) has the largest dot product
    with what the sequence has left, each in shares of its limit. With `cut`, a gap that no rest fits is
    closed by the front of the longest rest. At the end the sequences are powers of two long, as
    far as cutting allows, since such lengths need no padding.
    """

    POOL = 512

    def __init__(self, limits: Limits, cut: bool = True):
        self.limits, self.cut = limits, cut
        n = 2 * self.POOL
        self.example = np.zeros(n, np.int64)
        self.start, self.length, self.loss_from = (np.zeros(n, np.int64) for _ in range(3))
        self.used = 0

    def _loss(self, start, length, loss_from):
        return np.maximum(0, start + length - np.maximum(start, loss_from))

    def add(self, example: int, tokens: int, loss: int) -> Iterator[list[Piece]]:
        lim, start, loss_from = self.limits, 0, tokens - loss
        if not self.cut and (tokens > lim.tokens or loss > lim.loss):
            raise ValueError(f"example {example} exceeds a sequence and must not be cut")
        while self.cut:
            step = lim.tokens
            bearing = int(self._loss(start, step, loss_from))
            if bearing > lim.loss:
                step -= bearing - lim.loss
            if tokens - start < step or tokens == start:
                break
            yield [Piece(example, start, step, 0)]
            start += step
        if tokens > start:
            i = self.used
            self.example[i], self.start[i], self.length[i], self.loss_from[i] = example, start, tokens - start, loss_from
            self.used += 1
        if self.used == len(self.length):
            while self.used > self.POOL:
                yield self._fill(lim.tokens)

    def finish(self) -> Iterator[list[Piece]]:
        while self.used:
            left = int(self.length[: self.used].sum())
            size = self.limits.tokens
            if self.cut and left < size:
                size = 1 << (left.bit_length() - 1)
            yield self._fill(size)

    def _fill(self, size: int) -> list[Piece]:
        lim, n = self.limits, self.used
        length, start, loss_from = self.length[:n], self.start[:n], self.loss_from[:n]
        loss = self._loss(start, length, loss_from)
        alive = np.ones(n, bool)
        tokens, segments, bearing, offset, out = size, lim.segments, lim.loss, 0, []
        while tokens and segments:
            fits = alive & (length <= tokens) & (loss <= bearing)
            if not fits.any():
                break
            score = length * (tokens / lim.tokens**2) + loss * (bearing / lim.loss**2) + segments / lim.segments**2
            i = int(np.where(fits, score, -1.0).argmax())
            alive[i] = False
            out.append(Piece(int(self.example[i]), int(start[i]), int(length[i]), offset))
            offset += int(length[i])
            tokens, segments, bearing = tokens - int(length[i]), segments - 1, bearing - int(loss[i])
        if self.cut and tokens and segments and alive.any():
            front = np.minimum(length, tokens)
            front_loss = self._loss(start, front, loss_from)
            over = np.maximum(0, front_loss - bearing)
            front = np.where(alive, front - over, 0)
            i = int(np.where(front == front.max(), length, -1).argmax())
            if front[i] > 0:
                out.append(Piece(int(self.example[i]), int(start[i]), int(front[i]), offset))
                start[i] += front[i]
                length[i] -= front[i]
        kept = np.flatnonzero(alive & (length > 0))
        for a in (self.example, self.start, self.length, self.loss_from):
            a[: len(kept)] = a[kept]
        self.used = len(kept)
        return out


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary file: printable Latin-1
    characters stand for themselves, the other bytes for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian 32-bit) as the tokenizers library gives them for a byte-level BPE file,
    its special strings included. One for each worker process, so that a unit met by an earlier task is
    not encoded again. The merges of such a file are in the order of ids, which lets the faster
    library for rank files encode units; the tests hold its ids against the library of the file."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = byte_alphabet()
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    plain = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = UnitEncoder(lambda unit: array("I", plain.encode_ordinary(unit)).tobytes())
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")")

    def ids(text: str) -> bytes:
        if not any(s in text for s in special):
            return encode(text)
        parts = marks.split(text)
        return b"".join(special[p].to_bytes(4, "little") if i % 2 else encode(p) for i, p in enumerate(parts))

    return ids


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def pack_documents(
    docs: DataFrame, vocabulary: str, limits: Limits = Limits(), cut: bool = True, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, prompt_col: str | None = None
) -> DataFrame:
    """Pieces of documents and their places in sequences: (doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset[, ids][, loss]); with `with_ids` also each piece's ids, with `prompt_col`
    how many of them bear loss.

    A document is the ids of its text and one end id; all of them bear loss. Instruction data have the ids
    of a prompt before, which bear none. Every task packs what it
    reads, with a pool of bounded size, so nothing is shuffled, no key can be hot and a lost task is
    simply run again; a task leaves at most a few sequences that are not full, and those are powers of
    two long. Null text is empty: one end id; a null prompt is empty. Repeated rows are packed apart, ids may
    be null or repeated, very long texts are cut over many sequences, an empty table gives no rows; other
    columns are not read.
    """
    more = ["ids"] * with_ids + ["loss"] * (prompt_col is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = _tokenizer(vocabulary), Packer(limits, cut)
        first = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # example -> [doc_id, ids, tokens not yet placed]
        rows: list[tuple] = []
        count = 0

        def place(sequence: list[Piece], number: int) -> None:
            for p in sequence:
                entry = waiting[p.example]
                doc, ids, _, prompt = entry
                piece = ids[4 * p.start : 4 * (p.start + p.length)]
                loss = p.start + p.length - max(p.start, min(prompt, p.start + p.length))
                rows.append((doc, p.start, p.length, zlib.crc32(piece), len(ids) // 4, first + number, p.offset, *([piece] * with_ids), *([loss] * (prompt_col is not None))))
                entry[2] -= p.length
                if not entry[2]:
                    del waiting[p.example]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * (7 + len(more))
            types = [pa.int64()] * 7 + [pa.binary() if x == "ids" else pa.int64() for x in more]
            rows.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *more])

        example = 0
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                part = whole.slice(at, BATCH_ROWS)
                prompts = part.column(2).to_pylist() if prompt_col is not None else [None] * part.num_rows
                for doc, text, asked in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), prompts):
                    before = ids_of(asked) if asked else b""
                    ids = before + ids_of(text or "") + END_ID.to_bytes(4, "little")
                    tokens, prompt = len(ids) // 4, len(before) // 4
                    waiting[example] = [doc, ids, tokens, prompt]
                    for sequence in packer.add(example, tokens, tokens - prompt):
                        place(sequence, count)
                        count += 1
                    example += 1
                yield batch()
        for sequence in packer.finish():
            place(sequence, count)
            count += 1
        yield batch()

    small_batches(docs.sparkSession)
    columns = [docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"), *([docs[prompt_col].alias("prompt")] if prompt_col is not None else [])]
    return docs.select(columns).mapInArrow(run, SCHEMA + "".join({"ids": ", ids binary", "loss": ", loss bigint"}[x] for x in more))
