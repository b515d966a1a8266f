"""Byte-level BPE by replaying the merges over all words of a block of texts at once."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gumshoe.llm.common import BATCH_ROWS, map_batches, small_batches
from gumshoe.llm.units import unit_lists

#: Characters of text whose words share one index; words already encoded by the task are remembered.
BLOCK_CHARS = 4_000_000
KNOWN_WORDS = 150_000
#: Words of up to so many bytes are merged in waves; so many waves there are at most.
WAVE_BYTES = 64
#: Bytes of words in one row of symbols, so that a row takes little memory.
WAVE_BLOCK = 500_000
#: Stands for the rank of a pair that makes no token; above all ranks and pairs.
NO_RANK = np.iinfo(np.int64).max

#: A text cut into the lists that `unit_lists` gives.
Units = list[tuple[bool, list[str]]]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay_long(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of every word, of any length. All words lie in one row of symbols; an index leads from the
    rank of a pair to the positions that hold it. The lowest rank is applied at all its positions, from
    left to right; each merge looks up only the two pairs with its neighbours and enters them into the
    index. A pair that ranks below the one at work is taken first, as a single word alone would do.
    """
    symbol: list[bytes | None] = []
    after: list[int] = []
    index: dict[int, list[int]] = {}
    rank_of = ranks.get
    ends = []
    for word in words:
        at, last = len(symbol), len(symbol) + len(word) - 1
        symbol.extend([word[i : i + 1] for i in range(len(word))])
        after.extend(range(at + 1, last + 1))
        after.append(-1)
        ends.append(last)
        for i in range(len(word) - 1):
            rank = rank_of(word[i : i + 2])
            if rank is not None:
                index.setdefault(rank, []).append(at + i)
    before = [-1] * len(symbol)
    for i, j in enumerate(after):
        if j >= 0:
            before[j] = i
    queue = list(index)
    heapq.heapify(queue)
    token = {rank: text for text, rank in ranks.items()}
    while queue:
        rank = heapq.heappop(queue)
        places = index.pop(rank, None)
        if places is None:
            continue
        target = token[rank]
        places.sort()
        for n, i in enumerate(places):
            left = symbol[i]
            if left is None:
                continue
            j = after[i]
            if j < 0 or left + symbol[j] != target:
                continue
            symbol[i], symbol[j] = target, None
            k = after[i] = after[j]
            lower = False
            if k >= 0:
                before[k] = i
                new = rank_of(target + symbol[k])
                if new is not None:
                    if new not in index:
                        index[new] = [i]
                        heapq.heappush(queue, new)
                    else:
                        index[new].append(i)
                    lower = new < rank
            h = before[i]
            if h >= 0:
                new = rank_of(symbol[h] + target)
                if new is not None:
                    if new not in index:
                        index[new] = [h]
                        heapq.heappush(queue, new)
                    else:
                        index[new].append(h)
                    lower = lower or new < rank
            if lower:
                rest = places[n + 1 :]
                if rest:
                    if rank in index:
                        index[rank] += rest
                    else:
                        index[rank] = rest
                        heapq.heappush(queue, rank)
                break
    out, at = [], 0
    for last in ends:
        out.append([ranks[s] for s in symbol[at : last + 1] if s is not None])
        at = last + 1
    return out


class Merges:
    """Ranks of pairs of tokens, for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        found = {}
        for text, rank in ranks.items():
            for cut in range(1, len(text)):
                left = ranks.get(text[:cut])
                if left is not None:
                    right = ranks.get(text[cut:])
                    if right is not None:
                        found[left << 32 | right] = rank
        # The last one is no pair; it stands behind all others and spares a bound.
        listed = [*sorted(found.items()), (NO_RANK, NO_RANK)]
        self.pairs = np.array([pair for pair, _ in listed], np.int64)
        self.targets = np.array([rank for _, rank in listed], np.int64)

    def singles(self, text: np.ndarray) -> np.ndarray:
        """Ids of single bytes."""
        ids = np.zeros(256, np.int64)
        for byte in np.unique(text).tolist():
            ids[byte] = self.ranks[bytes([byte])]
        return ids[text]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that each pair makes, else NO_RANK. An index leads from every distinct
        pair to the positions that hold it, so each is looked up once."""
        pairs, held = np.unique(left << 32 | right, return_inverse=True)
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.targets[at], NO_RANK)[held]


def replay_waves(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one row, and how many each word has.

    All words lie in one row of symbols, each with the rank of the pair it begins. A wave applies in
    every word its lowest pair, the leftmost of equal ones, as a single word alone would do, and looks
    up only the two pairs with the neighbours. Words without a pair leave the row. There are as many
    waves as the longest word has merges, so this is for words of bounded length; none may be empty,
    and there must be one.
    """
    text = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    symbol = merges.singles(text)
    rank = np.full(len(symbol), NO_RANK)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = merges.of(symbol[inner], symbol[inner + 1])
    finished = []
    while len(symbol):
        start = np.flatnonzero(np.diff(word, prepend=-1))
        length = np.diff(start, append=len(word))
        lowest = np.minimum.reduceat(rank, start)
        going = lowest < NO_RANK
        if not going.all():
            stay = np.repeat(going, length)
            finished.append((word[~stay], symbol[~stay]))
            word, symbol, rank = word[stay], symbol[stay], rank[stay]
            lowest, length = lowest[going], length[going]
        if not len(symbol):
            break
        at = np.flatnonzero(rank == np.repeat(lowest, length))
        at = at[np.diff(word[at], prepend=-1) != 0]
        symbol[at] = lowest
        kept = np.ones(len(symbol), bool)
        kept[at + 1] = False
        word, symbol, rank = word[kept], symbol[kept], rank[kept]
        at -= np.arange(len(at))
        rank[at] = NO_RANK
        right = at[at + 1 < len(word)]
        right = right[word[right + 1] == word[right]]
        left = at[at > 0] - 1
        left = left[word[left + 1] == word[left]]
        changed = np.concatenate([right, left])
        rank[changed] = merges.of(symbol[changed], symbol[changed + 1])
    word, symbol = (np.concatenate(x) for x in zip(*finished))
    return symbol[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(words))


def _blocks(texts: list[str] | list[bytes], most: int) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def replay_bytes(words: list[bytes], merges: Merges) -> list[bytes]:
    """Ids of every word as little-endian 32-bit integers: words of up to WAVE_BYTES in waves, longer
    ones by an index kept over all merges, whose time does not grow with the square of the length."""
    out = [b""] * len(words)
    short = [i for i, w in enumerate(words) if 0 < len(w) <= WAVE_BYTES]
    for at, end in _blocks([words[i] for i in short], WAVE_BLOCK):
        part = short[at:end]
        ids, counts = replay_waves([words[i] for i in part], merges)
        whole, stops = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        for i, start, stop in zip(part, [0, *stops], stops):
            out[i] = whole[start:stop]
    long = [i for i, w in enumerate(words) if len(w) > WAVE_BYTES]
    for i, found in zip(long, replay_long([words[i] for i in long], merges.ranks) if long else ()):
        out[i] = np.array(found, "<u4").tobytes()
    return out


def replay_merges(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of every word."""
    return [np.frombuffer(x, "<u4").tolist() for x in replay_bytes(words, Merges(ranks))]


class BlockEncoder:
    """Encodes blocks of texts. Ids of words and units are remembered for two generations of at least
    KNOWN_WORDS, so those in use are not replayed again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges, self.split = Merges(ranks), regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.units: list[dict[str, bytes]] = [{}, {}]
        self.older: list[dict[str, bytes]] = [{}, {}]

    def learn(self, texts: list[Units]) -> None:
        """Ids of all units of a block that are not known yet."""
        if len(self.words) > KNOWN_WORDS:
            self.words, self.older_words = {}, self.words
        if len(self.units[0]) + len(self.units[1]) > KNOWN_WORDS:
            self.units, self.older = [{}, {}], self.units
        met: tuple[set, set] = (set(), set())
        for text in texts:
            for blank, units in text:
                met[blank].update(units)
        parts: tuple[dict, dict] = ({}, {})
        words: dict[str, None] = {}
        for blank in (0, 1):
            known, older = self.units[blank], self.older[blank]
            new = met[blank].difference(known)
            for unit in new.intersection(older):
                known[unit] = older[unit]
            for unit in new.difference(older):
                parts[blank][unit] = found = self.split(" " + unit if blank else unit)
                for word in found:
                    if word not in self.words:
                        if word in self.older_words:
                            self.words[word] = self.older_words[word]
                        else:
                            words[word] = None
        listed = list(words)
        self.words.update(zip(listed, replay_bytes([w.encode() for w in listed], self.merges)))
        ids = self.words.__getitem__
        for blank in (0, 1):
            self.units[blank].update((unit, b"".join(map(ids, found))) for unit, found in parts[blank].items())

    def encode(self, text: Units) -> bytes:
        out: list[bytes] = []
        for blank, units in text:
            out.extend(map(self.units[blank].__getitem__, units))
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(ranks_path: str, pattern: str) -> BlockEncoder:
    """One for each worker process, so that words met by an earlier task are not replayed again."""
    return BlockEncoder(read_ranks(ranks_path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian 32-bit integers, without special tokens.

    Each task treats the texts it reads, block by block, as one corpus: the distinct words of a
    block that the task has not met yet get their ids by a replay of the merges over all of them at
    once, in waves that look pairs up by an inverted index, and every text is put together from them. Nothing is shuffled; memory is bounded by the block
    and the words remembered. A null or empty text has no ids; strings of special tokens are plain
    text; repeated rows and null ids are kept as they are; no rows give no rows; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for at, end in _blocks(texts, BLOCK_CHARS):
                cut = [list(unit_lists(x)) for x in texts[at:end]]
                encoder.learn(cut)
                for part in range(at, end, BATCH_ROWS):
                    stop = min(end, part + BATCH_ROWS)
                    ids = [encoder.encode(x) for x in cut[part - at : stop - at]]
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    yield pa.record_batch([batch.column(0).slice(part, stop - part), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds `decoded`, the bytes of the ids (null ids: null)."""
    names = [f.name for f in encoded.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def make():
        tokens = sorted((i, t) for t, i in read_ranks(ranks_path).items())
        blob = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        length = np.zeros(tokens[-1][0] + 1, np.int64)
        length[[i for i, _ in tokens]] = [len(t) for _, t in tokens]
        start = np.concatenate([[0], np.cumsum(length)[:-1]])

        def decode(ids: bytes | None) -> bytes | None:
            if not ids:
                return ids
            n = np.frombuffer(ids, "<u4")
            size = length[n]
            end = np.cumsum(size)
            return blob[np.arange(end[-1]) + np.repeat(start[n] - (end - size), size)].tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(names.index("ids")).to_pylist()
            return pa.record_batch([*batch.columns, pa.array([decode(x) for x in ids], pa.binary())], names=[*names, "decoded"])

        return step

    return map_batches(encoded, make, schema)
