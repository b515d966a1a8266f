"""Many phrases looked for at once: an Aho-Corasick automaton held as integer arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gumshoe.session import pin

#: Bytes of phrases in one automaton, which has at most as many states and one more.
PART_BYTES = 1 << 19
#: Bytes that one lane of a batch steps over, and bytes of texts that step together.
LANE, BATCH_BYTES = 2048, 4_000_000


class Automaton:
    """States of the trie of all phrases. `step` leads from a state and a class of bytes to the state of the longest
    suffix read so far that begins a phrase; `own` is the phrase a state ends, or -1; `up` is the next
    shorter suffix that ends a phrase, or 0. Bytes in no phrase are class 0 and lead to the root."""

    def __init__(self, phrases: list[bytes]):
        used = np.zeros(256, bool)
        used[np.frombuffer(b"".join(phrases), np.uint8)] = True
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, used.sum() + 1)
        self.width = int(used.sum()) + 1
        self.longest = max(map(len, phrases), default=1)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        classes = self.classes.tolist()
        for number, phrase in enumerate(phrases):
            state = 0
            for byte in phrase:
                near = children[state]
                c = classes[byte]
                state = near.get(c, -1)
                if state < 0:
                    state = near[c] = len(children)
                    children.append({})
            ends[state] = number
        self._link(children, ends)

    def _link(self, children: list[dict[int, int]], ends: dict[int, int]) -> None:
        """Steps and suffixes, level by level: a state's suffix is one step from its parent's."""
        n = len(children)
        self.step = np.zeros((n, self.width), np.int32)
        self.own = np.full(n, -1, np.int64)
        self.own[list(ends)] = list(ends.values())
        self.up = np.zeros(n, np.int32)
        suffix = np.zeros(n, np.int32)
        level = np.zeros(1, np.int64)
        while len(level):
            rows = [(s, c, child) for s in level.tolist() for c, child in children[s].items()]
            self.step[level] = self.step[suffix[level]] if level[0] else 0
            if not rows:
                break
            parent, c, child = np.array(rows).T
            suffix[child] = np.where(parent > 0, self.step[suffix[parent], c], 0)
            self.step[parent, c] = child
            near = suffix[child]
            self.up[child] = np.where(self.own[near] >= 0, near, self.up[near])
            level = child
        self.ends = (self.own >= 0) | (self.up > 0)

    def found(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, times): how often each phrase occurs in each text, overlapping or not.

        The bytes of all texts are dealt to lanes that step together. A lane begins so many bytes early that
        it has read every phrase that ends in its share.
        """
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        warm = self.longest - 1
        lane = max(LANE, 4 * self.longest)
        size = int(starts[-1])
        shares = -(-size // lane)
        data = np.zeros(warm + shares * lane, np.int64)
        read = self.classes.copy()
        read[0] = 0  # between texts, and in no phrase
        data[warm : warm + size] = read[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        at = np.arange(shares) * lane
        state = np.zeros(shares, np.int64)
        step = self.step.ravel()
        met: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def gather() -> None:
            if held:
                place, where = (np.concatenate(x) for x in zip(*held))
                text = np.searchsorted(starts, place, side="right") - 1
                pairs, times = np.unique(text * len(self.own) + where, return_counts=True)
                met.append(pairs)
                counts.append(times)
                held.clear()

        for k in range(warm + lane):
            state = step[state * self.width + data[at + k]].astype(np.int64)
            if k >= warm:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    held.append((at[hit] + (k - warm), state[hit]))
                    waiting += len(hit)
                    if waiting > 2_000_000:
                        gather()
                        waiting = 0
        gather()
        if not met:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return self._phrases(np.concatenate(met), np.concatenate(counts))

    def _phrases(self, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that the states end, those of their suffixes included, summed for each text."""
        text, state = np.divmod(pairs, len(self.own))
        out = []
        while len(state):
            own = self.own[state]
            out.append((text[own >= 0] * len(self.own) + own[own >= 0], times[own >= 0]))
            state = self.up[state].astype(np.int64)
            more = state > 0
            text, state, times = text[more], state[more], times[more]
        keys, sums = (np.concatenate(x) for x in zip(*out))
        unique, inverse = np.unique(keys, return_inverse=True)
        total = np.bincount(inverse, sums, len(unique)).astype(np.int64)
        return *np.divmod(unique, len(self.own)), total


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and texts, about BATCH_BYTES at a time; a longer text comes alone."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_BYTES or i + 1 == len(texts):
                yield batch.column(0).slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def occurrences(docs: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, phrase, key, times): every phrase of the dictionary (phrase, key) that occurs in a text, with each of
    its keys, and how often, overlaps included.

    The dictionary is dealt by hash to as many automata as its bytes ask for, each of bounded size and shared
    with all tasks; the texts pass each of them once, and only what is found is shuffled. A row of
    `docs` is a text of its own. Empty phrases and null texts are found nowhere.
    """
    spark = docs.sparkSession
    known = dictionary.select("phrase", "key").where((F.col("phrase") != "") & ~F.col("phrase").contains("\0")).distinct()
    known = pin(known)
    size = known.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    texts = docs.select(key, F.col(text).cast("string").alias("_text"))
    schema = StructType(texts.select(key).schema.fields).add("phrase", "string").add("key", "string").add("times", "long")
    found = []
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part) if parts > 1 else known
        listed = sorted((r["phrase"].encode(), r["key"]) for r in own.toLocalIterator())
        if listed:
            found.append(texts.mapInArrow(_matcher(spark.sparkContext.broadcast(listed)), schema))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _matcher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: list[bytes] = []
        first: list[int] = []
        for at, (phrase, _) in enumerate(shared.value):
            if not phrases or phrases[-1] != phrase:
                phrases.append(phrase)
                first.append(at)
        first.append(len(shared.value))
        start, held = np.array(first[:-1]), np.diff(first)
        automaton = Automaton(phrases)
        names = pa.array([p for p, _ in shared.value], pa.binary()).cast(pa.string())
        owners = pa.array([k for _, k in shared.value], pa.string())
        for keys, texts in _batches(batches):
            text, phrase, times = automaton.found(texts)
            # Each phrase with all its keys.
            n = held[phrase]
            row = pa.array(np.repeat(start[phrase] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            columns = [keys.take(pa.array(np.repeat(text, n))), names.take(row), owners.take(row), pa.array(np.repeat(times, n))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "phrase", "key", "times"])

    return run
