"""Periodic runs of words: Lyndon arrays from the grouping phase of a suffix sorter, roots extended by LCE."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.llm.common import mix64, small_batches

#: Bytes of text that a task works on at a time; a longer text is worked on alone.
TEXT_BYTES = 4_000_000
#: Words of the pieces that must recur within a run, so that its words are told from all others.
PIECE = 8
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Words = list[bytes]


def split_words(doc_id: int | None, text: bytes) -> Words:
    """Words between ASCII white space."""
    return text.split()


def lyndon_array(letters: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place, by the first phase of Baier's suffix sorter.

    Places are grouped by their context, at first one letter. Groups are finished from the highest down: the
    members of the highest leave the list of open places, and the open place before each chain of
    them takes their contexts into its own. It moves to a new group right above its old one, the
    higher the more members it took. What a member reaches when its group is finished is the longest Lyndon
    word that starts there, and where the next smaller suffix begins.
    """
    n = len(letters)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    members: list[list[int]] = []
    group = [0] * n
    names = {letter: i for i, letter in enumerate(sorted(set(letters)))}
    members = [[] for _ in names]
    for at, letter in enumerate(letters):
        g = group[at] = names[letter]
        members[g].append(at)
    lower = list(range(-1, len(names) - 1))
    upper = list(range(1, len(names) + 1))
    out = [0] * n
    top = len(names) - 1
    while top >= 0:
        own = members[top]
        if len(own) > 1:
            own = [s for s in own if group[s] == top]
            own.sort(reverse=True)
        elif own and group[own[0]] != top:
            own = []
        if own:
            length = after[own[0]] - own[0]
            taken: dict[int, int] = {}
            for s in own:
                out[s] = length
                p, q, k = before[s], after[s], 1 + taken.pop(s, 0)
                if p >= 0:
                    after[p] = q
                    taken[p] = taken.get(p, 0) + k
                if q < n:
                    before[q] = p
            made: dict[tuple[int, int], int] = {}
            # The most members first: each new group goes right above the old one, below those made before.
            for p, k in taken.items() if len(taken) == 1 else sorted(taken.items(), key=lambda x: -x[1]):
                old = group[p]
                new = made.get((old, k))
                if new is None:
                    new = made[old, k] = len(members)
                    members.append([])
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    lower[above] = new
                members[new].append(p)
                group[p] = new
        members[top] = []
        top = lower[top]
    return np.array(out, np.int64)


class Extensions:
    """Longest common extensions of places of a sequence, by exact names of its pieces of 1, 2, 4, ... letters."""

    def __init__(self, letters: np.ndarray):
        self.n, self.names, width = len(letters), [letters], 1
        while 2 * width <= self.n:
            last = self.names[-1]
            pairs = last[: len(last) - width] * (int(last.max()) + 1) + last[width:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            width *= 2

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters from a and from b on are the same, for a < b <= n."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            fits = np.flatnonzero(b + (1 << k) <= self.n)
            same = fits[names[a[fits]] == names[b[fits]]]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters before a and before b are the same, for 0 <= a < b."""
        a, b, start = a.copy(), b.copy(), a
        for k in range(len(self.names) - 1, -1, -1):
            names, width = self.names[k], 1 << k
            fits = np.flatnonzero(a >= width)
            same = fits[names[a[fits] - width] == names[b[fits] - width]]
            a[same] -= width
            b[same] -= width
        return start - a


def runs_of(letters: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of the runs of at least `least` letters and `times` periods (3 or more), by start
    and period.

    Every run has a root in its first two periods: the longest Lyndon word of some place, under one order of the
    letters or its reverse, as long as the period. Extended both ways as far as the period holds, the root is
    the run; with three periods, at least one more follows it.
    """
    n = len(letters)
    if n < least:
        return np.zeros((0, 3), np.int64)
    at = np.arange(n)
    extensions = Extensions(letters)
    found = []
    for order in (letters, int(letters.max()) - letters):
        root = lyndon_array(order.tolist())
        fits = at + 2 * root <= n
        start, period = at[fits], root[fits]
        more = extensions.right(start, start + period)
        start, period, more = (x[more >= period] for x in (start, period, more))
        back = extensions.left(start, start + period)
        length = period + more + back
        long = length >= np.maximum(least, times * period)
        found.append(np.stack([(start - back)[long], length[long], period[long]], 1))
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def recurring_stretches(words: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """[from, to) of the stretches of a document whose pieces of PIECE words all occur twice in it.

    A run of 24 words and three periods is inside one: each piece of it recurs one period on or before, and
    so do those of every longer stretch with its period. Pieces are told apart by a hash; two
    that share one only make a stretch longer.
    """
    n = len(words)
    if n < least:
        return
    code = np.zeros(n - PIECE + 1, np.uint64)
    letters = mix64(words.astype(np.uint64) + np.uint64(1))
    for k in range(PIECE):
        code = code * np.uint64(0x9E3779B97F4A7C15) + letters[k : n - PIECE + 1 + k]
    code = mix64(code) ^ mix64(doc[: len(code)].astype(np.uint64) + np.uint64(77))
    inside = doc[: len(code)] == doc[PIECE - 1 :]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    twice = np.zeros(len(code), bool)
    same = ranked[1:] == ranked[:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= inside
    # Pieces next to each other but of two documents are parted by those that reach over the border.
    edge = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a + PIECE - 1 >= least:
            yield a, b + PIECE - 1


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, about TEXT_BYTES at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= TEXT_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _bytes_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def periodic_runs(
    docs: DataFrame, words: Callable[[int | None, bytes], Words] = split_words, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, runs, collapsed) for each row: the runs (start, length, period) of the words of the whole text by
    start and period, and the text of the words that no run holds after its first period, joined by one blank.

    A run is a stretch of consecutive words with smallest period `period` that no word beside it continues,
    of at least `least` words (24 or more) and `times` periods (3 or more).

    Null, empty and blank texts have no runs and an empty text. Null ids and repeated rows are kept, a
    row each. A text is worked on as a whole in one task, a long one alone; nothing is shuffled, so
    equal or frequent texts meet nowhere. No rows give no rows; other columns are not read.
    """
    if least < 3 * PIECE or times < 3:
        raise ValueError("runs have at least 24 words and three periods")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            split = [words(i, t) for i, t in zip(ids, texts)]
            ends = np.cumsum([0, *map(len, split)])
            names: dict[bytes, int] = {}
            letters = np.fromiter((names.setdefault(w, len(names)) for ws in split for w in ws), np.int64, int(ends[-1]))
            del names
            doc = np.repeat(np.arange(len(split)), np.diff(ends))
            dropped = np.zeros(len(letters), bool)
            runs: list[list[dict]] = [[] for _ in split]
            for a, b in recurring_stretches(letters, doc, least):
                d = int(doc[a])
                own = np.unique(letters[a:b], return_inverse=True)[1].astype(np.int64)
                for start, length, period in runs_of(own, least, times).tolist():
                    start += a
                    dropped[start + period : start + length] = True
                    runs[d].append({"start": start - int(ends[d]), "length": length, "period": period})
            collapsed = []
            for d, ws in enumerate(split):
                if runs[d]:
                    runs[d].sort(key=lambda r: (r["start"], r["period"]))
                    ws = [w for w, x in zip(ws, dropped[ends[d] : ends[d + 1]].tolist()) if not x]
                collapsed.append(b" ".join(ws))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(runs, _RUNS), _bytes_column(collapsed)], names=["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
