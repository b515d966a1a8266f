"""String likeness, from the published definitions: Jaro-Winkler, Metaphone, indel ratios.

Small helpers for pandas UDFs over bounded pools and blocked candidate pairs.
"""

from __future__ import annotations

# Letters and digits from common to rare.
COMMON_FIRST = " eainostrludcmphgbvfyqkwjzx0123456789"


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hit_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit_a.append(c)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    hit_b = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(hit_a, hit_b)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro, raised by up to four common leading characters when above 0.7."""
    base = jaro(a, b)
    if base <= 0.7:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + prefix * weight * (1 - base)


_FRONT = frozenset("iey")
_VOWELS = frozenset("aeiou")


def metaphone(word: str) -> str:
    """Metaphone code of a word (Philips 1990)."""
    w = "".join(c for c in word.lower() if "a" <= c <= "z")
    if not w:
        return ""
    if w[:2] in ("kn", "gn", "pn", "wr", "ae"):
        w = w[1:]
    elif w[0] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out = []
    n = len(w)
    i = 0
    while i < n:
        c = w[i]
        before = w[i - 1] if i else ""
        after = w[i + 1] if i + 1 < n else ""
        later = w[i + 2] if i + 2 < n else ""
        step = 1
        if c == before and c != "c":
            i += 1
            continue
        if c in _VOWELS:
            if i == 0:
                out.append(c)
        elif c == "b":
            if not (before == "m" and i == n - 1):
                out.append("b")
        elif c == "c":
            if after == "i" and later == "a":
                out.append("x")
            elif after == "h":
                out.append("k" if before == "s" else "x")
                step = 2
            elif after in _FRONT and after:
                if before != "s":
                    out.append("s")
            else:
                out.append("k")
        elif c == "d":
            if after == "g" and later in _FRONT and later:
                out.append("j")
                step = 2
            else:
                out.append("t")
        elif c == "g":
            if after == "h":
                if i + 2 < n and later not in _VOWELS:
                    pass
                elif i + 2 >= n:
                    pass
                else:
                    out.append("k")
                step = 2
            elif after == "n" and (i + 2 >= n or w[i + 1 :] == "ned"):
                pass
            elif after in _FRONT and after and before != "g":
                out.append("j")
            else:
                out.append("k")
        elif c == "h":
            if after in _VOWELS and after and before not in ("c", "s", "p", "t", "g"):
                out.append("h")
        elif c == "k":
            if before != "c":
                out.append("k")
        elif c == "p":
            if after == "h":
                out.append("f")
                step = 2
            else:
                out.append("p")
        elif c == "q":
            out.append("k")
        elif c == "s":
            if after == "h":
                out.append("x")
                step = 2
            elif after == "i" and later in ("o", "a"):
                out.append("x")
            else:
                out.append("s")
        elif c == "t":
            if after == "i" and later in ("o", "a"):
                out.append("x")
            elif after == "h":
                out.append("0")
                step = 2
            elif not (after == "c" and later == "h"):
                out.append("t")
        elif c == "v":
            out.append("f")
        elif c in "wy":
            if after in _VOWELS and after:
                out.append(c)
        elif c == "x":
            out.append("ks")
        elif c == "z":
            out.append("s")
        else:
            out.append(c)
        i += step
    return "".join(out).upper()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bits of a Python integer as the row."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / total length."""
    total = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one, ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    best = 0.0
    for start in range(-n + 1, len(long_)):
        window = long_[max(start, 0) : start + n]
        if window and (len(window) == n or start < 0 or start + n > len(long_)):
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = " ".join(sorted(left & right))
    only_a, only_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if both and (not only_a or not only_b):
        return 100.0
    with_a = f"{both} {only_a}".strip()
    with_b = f"{both} {only_b}".strip()
    scores = [ratio(with_a, with_b)]
    if both:
        scores += [ratio(both, with_a), ratio(both, with_b)]
    return max(scores)


def weighted_ratio(a: str, b: str) -> float:
    """The usual blend: plain ratio, token ratios at 0.95, partial ones at 0.9 or 0.6 when the
    lengths differ."""
    if not a or not b:
        return 0.0
    size = max(len(a), len(b)) / min(len(a), len(b))
    tokens = max(token_sort_ratio(a, b), token_set_ratio(a, b))
    if size < 1.5:
        return max(ratio(a, b), tokens * 0.95)
    scale = 0.9 if size <= 8.0 else 0.6
    sorted_a, sorted_b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    shared = set(a.split()) & set(b.split())
    partial_tokens = 100.0 if shared else partial_ratio(sorted_a, sorted_b)
    return max(ratio(a, b), partial_ratio(a, b) * scale, partial_tokens * 0.95 * scale)


def phonetic_score(query: set[str], words: set[str]) -> float:
    """Mean over query words of the best Jaro-Winkler, at least 0.85 on the same sound; words
    under three letters do not take part."""
    sounds = {w: metaphone(w) for w in words if len(w) >= 3}
    best = []
    for q in query:
        if len(q) < 3:
            continue
        code = metaphone(q)
        scores = [
            max(jaro_winkler(q, w), 0.85) if code and code == sound else jaro_winkler(q, w)
            for w, sound in sounds.items()
        ]
        best.append(max(scores, default=0.0))
    return 100.0 * sum(best) / len(best) if best else 0.0


def fuzzy_score(query: str, text: str) -> tuple[float, float, bool]:
    """(score, phonetic score, all query words present), both texts in lower case."""
    wanted, words = set(query.split()), set(text.split())
    overlap = 100.0 * len(wanted & words) / len(wanted | words) if wanted and words else 0.0
    sound = phonetic_score(wanted, words)
    present = wanted <= words
    score = (
        0.30 * weighted_ratio(query, text)
        + 0.20 * token_set_ratio(query, text)
        + 0.15 * token_sort_ratio(query, text)
        + 0.15 * partial_ratio(query, text)
        + 0.10 * overlap
        + 0.10 * sound
        + (10 if present else 0)
    )
    return min(100.0, score), sound, present
