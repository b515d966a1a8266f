"""The most that a string score can be, from counts that Spark has without Python."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space between the words of a text, as `similarity` parts them.
SPACES = r"[\s\x1c-\x1f\x85\xa0  -     　]+"


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def _ratio(common: Column, total: Column) -> Column:
    """Twice the common letters in percent of all; 100 for two empty texts."""
    return F.when(total > 0, 200.0 * common / total).otherwise(100.0)


def _window(common: Column, shorter: Column) -> Column:
    """Best ratio of a text with a window of a longer one: the window may be as short as what they share."""
    inside = F.least(common, shorter)
    return F.when(shorter > 0, 200.0 * inside / (shorter + inside)).otherwise(100.0)


def fuzzy_bound(query: str, text: Column, words: Column) -> Column:
    """An upper bound of `similarity.fuzzy_score(query, text)`; `words` are `text_words(text)`.

    A common subsequence has no letter more often than either text has it. Every ratio is bounded by that and
    by the lengths; shared words, presence of all words and the overlap are exact; a sound is at most
    the same.
    """
    asked = query.split()
    wanted = set(asked)
    letters = Counter(query)
    distinct = F.array_distinct(words)
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    whole = sum((F.least(F.lit(n), count(c)) for c, n in sorted(letters.items())), F.lit(0))
    solid = sum((F.least(F.lit(n), count(c)) for c, n in sorted(letters.items()) if not c.isspace()), F.lit(0))
    size_a, size_b = F.lit(len(query)), F.length(text)

    def joined(items: Column) -> Column:
        return F.length(F.array_join(items, " "))

    sorted_a, sorted_b = F.lit(len(" ".join(asked))), joined(words)
    unique_a, unique_b = F.lit(len(" ".join(wanted))), joined(distinct)
    spaced = lambda n, items: solid + F.least(F.lit(max(n - 1, 0)), F.greatest(F.size(items) - 1, F.lit(0)))
    common_sorted, common_unique = spaced(len(asked), words), spaced(len(wanted), distinct)
    shared = F.size(F.array_intersect(distinct, F.array(*[F.lit(w) for w in sorted(wanted)]).cast("array<string>")))
    none = (F.size(distinct) == 0) | F.lit(not wanted)

    plain = _ratio(whole, size_a + size_b)
    by_order = _ratio(common_sorted, sorted_a + sorted_b)
    by_set = F.when(none, 0.0).when(shared > 0, 100.0).otherwise(_ratio(common_unique, unique_a + unique_b))
    part = F.when((size_b == 0) | F.lit(not query), 100.0).otherwise(_window(whole, F.least(size_a, size_b)))
    part_sorted = F.when(shared > 0, 100.0).otherwise(_window(common_sorted, F.least(sorted_a, sorted_b)))
    longer = F.greatest(size_a, size_b) / F.greatest(F.least(size_a, size_b), F.lit(1))
    scale = F.when(longer <= 8.0, 0.9).otherwise(0.6)
    apart = F.greatest(plain, part * scale, part_sorted * 0.95 * scale)
    weighted = F.when(longer < 1.5, F.greatest(plain, 0.95 * F.greatest(by_order, by_set))).otherwise(apart)
    overlap = F.when(none, 0.0).otherwise(100.0 * shared / F.greatest(F.lit(len(wanted)) + F.size(distinct) - shared, F.lit(1)))
    sound = F.when(F.exists(words, lambda w: F.length(w) >= 3) & F.lit(any(len(w) >= 3 for w in wanted)), 100.0).otherwise(0.0)
    present = F.when(shared == len(wanted), 10.0).otherwise(0.0)
    total = 0.30 * weighted + 0.20 * by_set + 0.15 * by_order + 0.15 * part + 0.10 * overlap + 0.10 * sound + present
    return F.least(F.lit(100.0), total)
