"""Word-order variants of labels, as array expressions."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_permutations(label: Column, max_words: int) -> Column:
    """Lower-case phrases for every order of the words; none for labels with more words.

    The index orders of 1..max_words words are literals, so nothing leaves the JVM.
    """
    words = F.split(label, " ", -1)
    out = F.array().cast("array<string>")
    for n in range(1, max_words + 1):
        orders = F.array(*[F.array(*[F.lit(i) for i in order]) for order in permutations(range(n))])
        phrases = F.transform(
            orders, lambda order: F.lower(F.array_join(F.transform(order, lambda i: F.get(words, i)), " "))
        )
        out = F.when(F.size(words) == n, phrases).otherwise(out)
    return F.array_distinct(out)
