"""String columns: labels, tokens, tags, snippets, repair."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of words in posts.
WORD_LETTERS = "a-zA-ZàâäéèêëïîôöùûüÿñçÀÂÄÉÈÊËÏÎÔÖÙÛÜŸÑÇ"
NON_WORD = r"[^\p{L}\p{N}_\s]"
NAME_PATTERN = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b"
# ASCII punctuation.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def sanitize_label(label: Column) -> Column:
    """The two characters backslash and n become a space."""
    return F.replace(label, F.lit("\\n"), F.lit(" "))


def sanitize_description(description: Column, label: Column) -> Column:
    return sanitize_label(F.coalesce(F.when(description != "", description), label))


# Letters without a decomposition, and Greek and Cyrillic letters, with what they become.
SPECIAL_LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ŧ": "t", "ı": "i", "ŋ": "n", "ĸ": "k", "ə": "e",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "",
    "э": "e", "ю": "iu", "я": "ia", "і": "i", "є": "ie", "ґ": "g",
}
#: Blocks whose letters fold by rule: Latin with its extensions, Greek, Cyrillic.
FOLDED_BLOCKS = (range(0xC0, 0x250), range(0x370, 0x482), range(0x48A, 0x530), range(0x1E00, 0x2000))


def _folds() -> dict[str, str]:
    """Each letter of the blocks without its marks, spelled in ASCII; letters that cannot be are left out."""
    out = {}
    for code in (c for block in FOLDED_BLOCKS for c in block):
        letter = chr(code)
        bare = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        spelled = "".join(SPECIAL_LETTERS.get(c) or (SPECIAL_LETTERS.get(c.lower()) or "").capitalize() if not c.isascii() else c for c in bare)
        known = all(c.isascii() or c.lower() in SPECIAL_LETTERS for c in bare)
        if letter.isalpha() and known and spelled != letter and spelled.strip() == spelled:
            out[letter] = spelled
    return out


def _bare() -> dict[str, str]:
    """Letters that decompose into an ASCII letter and marks."""
    pairs = ((chr(c), unicodedata.normalize("NFKD", chr(c))) for block in FOLDED_BLOCKS for c in block)
    bare = ((k, "".join(c for c in v if not unicodedata.combining(c))) for k, v in pairs)
    return {k: v for k, v in bare if k != v and len(v) == 1 and v.isascii() and v.isalpha()}


FOLDS, BARE = _folds(), _bare()
_ONE = {k: v for k, v in FOLDS.items() if len(v) == 1}
_MORE = {k: v for k, v in FOLDS.items() if len(v) != 1}


def fold_accents(text: Column) -> Column:
    """Letters without accents, Greek and Cyrillic in Latin spelling, as built-in expressions, each letter by itself:
    only pieces between blanks that hold a letter beyond ASCII are looked up letter by letter."""
    beyond = r"[^\x00-\x7F]"
    pieces = F.transform(F.split(text, " ", -1), lambda x: F.when(x.rlike(beyond), _folded(x)).otherwise(x))
    return F.when(text.rlike(beyond), F.array_join(pieces, " ")).otherwise(text)


def _folded(text: Column) -> Column:
    """Letters that become none or several are rare and only looked for where one of them stands."""
    bare = F.when(text.rlike(r"\p{Mn}"), F.regexp_replace(text, r"\p{Mn}", "")).otherwise(text)
    folded = F.translate(bare, "".join(_ONE), "".join(_ONE.values()))
    several = folded
    for letter, spelled in _MORE.items():
        several = F.replace(several, F.lit(letter), F.lit(spelled))
    return F.when(folded.rlike("[" + "".join(_MORE) + "]"), several).otherwise(folded)


def fold_text(text: str) -> str:
    """The same for a parameter, such as a query."""
    return "".join(FOLDS.get(c, c) for c in text if unicodedata.category(c) != "Mn")


def clean_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NON_WORD, " ")


def tokens(text: Column) -> Column:
    """Word tokens of the cleaned text."""
    return F.filter(F.split(clean_text(text), r"\s+", -1), lambda x: x != "")


def first_tokens(text: Column, n: int, letters: int = 400) -> Column:
    """The first n word tokens: of the first letters where more than n begin there, so that none is cut, else of all."""
    head = tokens(F.substring(text, 1, letters))
    return F.when(F.size(head) > n, F.slice(head, 1, n)).otherwise(F.slice(tokens(text), 1, n))


def letter_tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters, as posts are tokenised."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD_LETTERS}]+)"), F.lit(1))


def hashtags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def mentions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"@([\p{L}\p{N}_.\-]+)"), F.lit(1)), F.lower)


def capitalised_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME_PATTERN), F.lit(0))


def initial(label: Column) -> Column:
    return F.lower(F.substring(label, 1, 1))


def truncate_words(text: Column, words: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+", -1), lambda x: x != ""), 1, words), " ")


def slugify(text: Column, default: str = "sans_titre") -> Column:
    """Identifier from a title: letters without marks, others than ASCII dropped; quotes, hyphens and punctuation dropped,
    blanks to single underscores, at most 120 characters."""
    plain = F.regexp_replace(F.translate(text, "".join(BARE), "".join(BARE.values())), r"[^\x00-\x7F]", "")
    plain = F.regexp_replace(plain, r"[\"'\-]", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9_\s]", ""), r"\s+", " "))
    plain = F.regexp_replace(F.regexp_replace(plain, " ", "_"), "_+", "_")
    cut = F.substring(plain, 1, 120)
    return F.coalesce(F.when(cut != "", cut), F.lit(default))


def clean_label(text: Column, default: str = "Sans titre") -> Column:
    """Straight double quotes become alternating guillemets."""
    pieces = F.transform(
        F.split(text, '"', -1),
        lambda x, i: F.when(i == 0, x)
        .when(i % 2 == 1, F.concat(F.lit("«"), x))
        .otherwise(F.concat(F.lit("»"), x)),
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(
        F.trim(F.array_join(pieces, ""))
    )


def link_target(text: Column) -> tuple[Column, Column]:
    """(display, key) of `label <key>`, `prefix<<key>>` or `key`; display is null when it must
    come from the object."""
    text = F.trim(text)
    prefixed = text.contains("<<") & text.contains(">>")
    labelled = text.contains("<") & text.contains(">")
    key = (
        F.when(prefixed, F.trim(F.regexp_extract(text, r"^.*<<(.*)..$", 1)))
        .when(labelled, F.trim(F.regexp_extract(text, r"^.*<(.*).$", 1)))
        .otherwise(text)
    )
    display = F.when(prefixed, F.regexp_extract(text, r"^(.*)<<.*$", 1)).when(
        labelled, F.trim(F.regexp_extract(text, r"^(.*)<.*$", 1))
    )
    return display, key


def context(text: Column, query: str, distance: int = 60, highlight: str = "") -> Column:
    """Snippets of `distance` characters round the first hit of each query word, joined by dots.

    Every highlighted word is wrapped in the whole snippet built so far."""
    lowered = F.lower(text)
    return context_at(text, [(word, F.instr(lowered, word.lower()) - 1) for word in query.split(" ")], distance, highlight)


def context_at(text: Column, hits: Sequence[tuple[str, Column]], distance: int = 60, highlight: str = "") -> Column:
    """The same for words whose first places are known, -1 where there is none."""
    out = F.lit("")
    for word, at in hits:
        low = F.greatest(at - distance, F.lit(0))
        high = F.least(at + distance, F.length(text))
        piece = F.substring(text, low + 1, high - low)
        grown = F.concat(out, F.when(out != "", "...").otherwise(""), piece)
        if highlight:
            hit = F.substring(text, at + 1, F.lit(len(word)))
            before, after = highlight.split("%s")
            grown = F.replace(grown, hit, F.concat(F.lit(before), hit, F.lit(after)))
        out = F.when(at >= 0, grown).otherwise(out)
    return out


def highlight_terms(text: Column, query: str, tag: str = "mark") -> Column:
    """Wrap every query word, whatever its case."""
    words = query.split()
    if not words:
        return text
    quoted = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words)
    return F.regexp_replace(text, f"(?i)({quoted})", f"<{tag}>$1</{tag}>")


def repair_text(text: Column, bad: Sequence[str] = ()) -> Column:
    """Delete bad phrases, drop empty lines, end every line with punctuation."""

    def fix(line: Column) -> Column:
        for phrase in bad:
            line = F.replace(line, F.lit(phrase), F.lit(""))
        return line

    lines = F.filter(F.transform(F.split(text, "\n", -1), fix), lambda x: x != "")
    closed = F.transform(
        lines,
        lambda x: F.when(
            F.instr(F.lit(PUNCTUATION), F.substring(x, -1, 1)) > 0, x
        ).otherwise(F.concat(x, F.lit("."))),
    )
    return F.array_join(closed, "\n")
