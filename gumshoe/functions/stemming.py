"""Stems of words by language: endings are cut inside the regions R1, R2 and RV of a word.

The rules follow the published Snowball definitions of the four languages. Words come lower-case and without
accents, as the index has them, so the endings are stated without accents too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VOWELS = frozenset("aeiouy")
SPANISH_VOWELS = frozenset("aeiou")


def _after(word: str, start: int, vowels: frozenset[str] = VOWELS) -> int:
    """Where the region after the first other letter that follows a vowel begins, from a place on."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _ending(word: str, endings: Iterable[str]) -> str:
    """The longest of the endings that the word has, or ''."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _has(word: str, region: int, ending: str) -> bool:
    """Whether the word ends so, inside the region."""
    return word.endswith(ending) and len(word) - len(ending) >= region


def _cut(word: str, region: int, *endings: str) -> str:
    """Without the first of the endings that lies in the region."""
    for ending in endings:
        if _has(word, region, ending):
            return word[: -len(ending)]
    return word


# --- English -----------------------------------------------------------------------------

# Words with a stem of their own, words left as they are, and beginnings after which R1 starts.
EN_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
EN_KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
EN_KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
EN_BEGINNINGS = ("gener", "commun", "arsen")
EN_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
EN_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
EN_STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _short_syllable(word: str) -> bool:
    """Whether the word ends in a vowel between two other letters, or is a vowel and another letter."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-2] in VOWELS and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-3] not in VOWELS


def english(word: str) -> str:
    if len(word) <= 2 or word in EN_KEPT:
        return word
    if word in EN_WORDS:
        return EN_WORDS[word]
    # A y that begins the word or follows a vowel is no vowel.
    letters = list(word)
    for i, c in enumerate(letters):
        if c == "y" and (i == 0 or letters[i - 1] in VOWELS):
            letters[i] = "Y"
    word = "".join(letters)
    r1 = next((len(b) for b in EN_BEGINNINGS if word.startswith(b)), 0) or _after(word, 0)
    r2 = _after(word, r1)
    vowel = lambda w: any(c in VOWELS for c in w)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and vowel(word[:-2]):
        word = word[:-1]
    if word in EN_KEPT_LATER:
        return word

    ending = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if _has(word, r1, ending):
            word = word[: -len(ending)] + "ee"
    elif ending and vowel(word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            word = word[:-1]
        elif r1 >= len(word) and _short_syllable(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    ending = _ending(word, EN_STEP_2)
    if ending and _has(word, r1, ending):
        before = word[: -len(ending)]
        if ending == "ogi":
            fits = before.endswith("l")
        else:
            fits = ending != "li" or before[-1:] in "cdeghkmnrt"
        if fits:
            word = before + EN_STEP_2[ending]
    ending = _ending(word, EN_STEP_3)
    if ending and _has(word, r2 if ending == "ative" else r1, ending):
        word = word[: -len(ending)] + EN_STEP_3[ending]
    ending = _ending(word, EN_STEP_4)
    if ending and _has(word, r2, ending) and (ending != "ion" or word[-4:-3] in "st"):
        word = word[: -len(ending)]
    if _has(word, r2, "e") or _has(word, r1, "e") and not _short_syllable(word[:-1]):
        word = word[:-1]
    elif _has(word, r2, "l") and word.endswith("ll"):
        word = word[:-1]
    return word.replace("Y", "y")


# --- German ------------------------------------------------------------------------------


def german(word: str) -> str:
    letters = list(word)
    for i in range(1, len(letters) - 1):
        if letters[i] in "uy" and letters[i - 1] in VOWELS and letters[i + 1] in VOWELS:
            letters[i] = letters[i].upper()
    word = "".join(letters)
    first = _after(word, 0)
    r1, r2 = max(first, 3), _after(word, first)

    ending = _ending(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if ending == "s":
        if _has(word, r1, "s") and word[-2:-1] in "bdfghklmnrt":
            word = word[:-1]
    elif ending and _has(word, r1, ending):
        word = word[: -len(ending)]
        if ending in ("e", "en", "es") and word.endswith("niss"):
            word = word[:-1]
    ending = _ending(word, ("en", "er", "est", "st"))
    if ending == "st":
        if _has(word, r1, "st") and len(word) >= 6 and word[-3] in "bdfghklmnt":
            word = word[:-2]
    elif ending and _has(word, r1, ending):
        word = word[: -len(ending)]

    ending = _ending(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if ending and _has(word, r2, ending):
        before = word[: -len(ending)]
        if ending in ("end", "ung"):
            word = before
            if _has(word, r2, "ig") and not word.endswith("eig"):
                word = word[:-2]
        elif ending in ("ig", "ik", "isch"):
            word = word if before.endswith("e") else before
        elif ending in ("lich", "heit"):
            word = _cut(before, r1, "er", "en")
        else:
            word = _cut(before, r2, "lich", "ig")
    return word.lower()


# --- Spanish -----------------------------------------------------------------------------

# Endings of each step.
ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ES_BEFORE_PRONOUNS = ("iendo", "ando", "ar", "er", "ir")
ES_NOUNS = (
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos"
).split()
ES_ACTIONS = "adora ador acion adoras adores aciones ante antes ancia ancias".split()
ES_REPLACED = {"logia": "log", "logias": "log", "ucion": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
ES_OTHERS = "amente mente idad idades iva ivo ivas ivos".split()
ES_Y_VERBS = "ya ye yan yen yeron yendo yo yas yes yais yamos".split()
ES_VERBS = (
    "arian arias aran aras ariais aria areis ariamos aremos ara are erian erias eran eras eriais eria ereis eriamos eremos era ere "
    "irian irias iran iras iriais iria ireis iriamos iremos ira ire aba ada ida ia iera ad ed id ase iese aste iste an aban ian ieran "
    "asen iesen aron ieron ado ido ando iendo io ar er ir as abas adas idas ias ieras ases ieses is ais abais iais arais ierais aseis "
    "ieseis asteis isteis ados idos amos abamos iamos imos aramos ieramos iesemos asemos"
).split()
ES_SHORT_VERBS = ("en", "es", "eis", "emos")


def _spanish_rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    vowel = [c in SPANISH_VOWELS for c in word]
    if not vowel[1]:
        return next((i + 1 for i in range(2, len(word)) if vowel[i]), len(word))
    if vowel[0]:
        return next((i + 1 for i in range(2, len(word)) if not vowel[i]), len(word))
    return 3


def _without_gu(word: str, rv: int) -> str:
    return word[:-1] if word.endswith("gu") and len(word) - 1 >= rv else word


def spanish(word: str) -> str:
    r1 = _after(word, 0, SPANISH_VOWELS)
    r2, rv = _after(word, r1, SPANISH_VOWELS), _spanish_rv(word)

    ending = _ending(word, ES_PRONOUNS)
    if ending:
        before = word[: -len(ending)]
        verb = _ending(before, (*ES_BEFORE_PRONOUNS, "yendo"))
        if verb and _has(before, rv, verb) and (verb != "yendo" or before.endswith("uyendo")):
            word = before

    start = word
    ending = _ending(word, (*ES_NOUNS, *ES_ACTIONS, *ES_REPLACED, *ES_OTHERS))
    before = word[: len(word) - len(ending)]
    if ending == "amente":
        if len(before) >= r1:
            word = before
            if _has(word, r2, "iv"):
                word = _cut(word[:-2], r2, "at")
            else:
                word = _cut(word, r2, "os", "ic", "ad")
    elif ending and len(before) >= r2:
        if ending in ES_REPLACED:
            word = before + ES_REPLACED[ending]
        elif ending in ES_ACTIONS:
            word = _cut(before, r2, "ic")
        elif ending == "mente":
            word = _cut(before, r2, "ante", "able", "ible")
        elif ending in ("idad", "idades"):
            word = _cut(before, r2, "abil", "ic", "iv")
        elif ending in ES_OTHERS:
            word = _cut(before, r2, "at")
        else:
            word = before
    if word == start:
        ending = _ending(word[rv:], ES_Y_VERBS)
        if ending and word[: -len(ending)].endswith("u"):
            word = word[: -len(ending)]
        else:
            ending = _ending(word[rv:], (*ES_VERBS, *ES_SHORT_VERBS))
            if ending:
                word = word[: -len(ending)]
                if ending in ES_SHORT_VERBS:
                    word = word[:-1] if word.endswith("gu") else word
    ending = _ending(word[rv:], ("os", "a", "o", "i", "e"))
    if ending:
        word = word[: -len(ending)]
        if ending == "e":
            word = _without_gu(word, rv)
    return word


# --- French ------------------------------------------------------------------------------

# Endings of each step; I, U and Y stand for letters that are no vowels where they are.
FR_NOUNS = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
FR_ACTIONS = "atrice ateur ation atrices ateurs ations".split()
FR_REPLACED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
FR_OTHERS = "ement ements ite ites if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
FR_I_VERBS = (
    "imes it ites i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant "
    "issante issantes issants isse issent isses issez issiez issions issons"
).split()
FR_E_VERBS = "ee ees er era erai eraIent erais erait eras erent erez eriez erions erons eront ez iez".split()
FR_A_VERBS = "ames at ates a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _french_marked(word: str) -> str:
    letters = list(word)
    for i, c in enumerate(letters):
        before, after = letters[i - 1] if i else "", word[i + 1] if i + 1 < len(word) else ""
        if c == "u" and (before == "q" or before in VOWELS and before and after and after in VOWELS):
            letters[i] = "U"
        elif c == "i" and before and before in VOWELS and after and after in VOWELS:
            letters[i] = "I"
        elif c == "y" and (before and before in VOWELS or after and after in VOWELS):
            letters[i] = "Y"
    return "".join(letters)


def _french_rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[0] in VOWELS and word[1] in VOWELS or word.startswith(("par", "col", "tap")):
        return 3
    return next((i + 1 for i in range(1, len(word)) if word[i] in VOWELS), len(word))


def _or_else(word: str, ending: str, region: int, other: str) -> str:
    """Without the ending in the region, with another one outside."""
    if not word.endswith(ending):
        return word
    return word[: -len(ending)] if _has(word, region, ending) else word[: -len(ending)] + other


def french(word: str) -> str:
    word = _french_marked(word)
    r1 = _after(word, 0)
    r2, rv = _after(word, r1), _french_rv(word)
    start, verbs_too = word, False
    ending = _ending(word, (*FR_NOUNS, *FR_ACTIONS, *FR_REPLACED, *FR_OTHERS))
    before = word[: len(word) - len(ending)]
    at = len(before)
    if ending in FR_NOUNS:
        word = before if at >= r2 else word
    elif ending in FR_ACTIONS:
        word = _or_else(before, "ic", r2, "iqU") if at >= r2 else word
    elif ending in FR_REPLACED:
        word = before + FR_REPLACED[ending] if at >= r2 else word
    elif ending in ("ement", "ements"):
        if at >= rv:
            word = before
            if _has(word, r2, "iv"):
                word = _cut(word[:-2], r2, "at")
            elif word.endswith("eus"):
                word = word[:-3] if _has(word, r2, "eus") else word[:-1] + "x" if _has(word, r1, "eus") else word
            elif _has(word, r2, "abl") or _has(word, r2, "iqU"):
                word = word[:-3]
            elif _has(word, rv, "ier"):
                word = word[:-2]
    elif ending in ("ite", "ites"):
        if at >= r2:
            word = before
            if word.endswith("abil"):
                word = _or_else(word, "abil", r2, "abl")
            elif word.endswith("ic"):
                word = _or_else(word, "ic", r2, "iqU")
            else:
                word = _cut(word, r2, "iv")
    elif ending in ("if", "ive", "ifs", "ives"):
        if at >= r2:
            word = before
            if _has(word, r2, "at"):
                word = _or_else(word[:-2], "ic", r2, "iqU")
    elif ending == "eaux":
        word = word[:-1]
    elif ending == "aux":
        word = before + "al" if at >= r1 else word
    elif ending in ("euse", "euses"):
        word = before if at >= r2 else before + "eux" if at >= r1 else word
    elif ending in ("issement", "issements"):
        word = before if at >= r1 and before[-1:] not in VOWELS else word
    elif ending in ("amment", "emment"):
        word, verbs_too = (before + ("ant" if ending[0] == "a" else "ent"), True) if at >= rv else (word, False)
    elif ending:
        if at > rv and before[-1:] in VOWELS:
            word, verbs_too = before, True

    if word == start or verbs_too:
        was = word
        ending = _ending(word[rv:], FR_I_VERBS)
        if ending and len(word) - len(ending) > rv and word[-len(ending) - 1] not in VOWELS:
            word = word[: -len(ending)]
        else:
            ending = _ending(word[rv:], ("ions", *FR_E_VERBS, *FR_A_VERBS))
            if ending == "ions":
                word = _cut(word, r2, "ions")
            elif ending:
                word = word[: -len(ending)]
                if ending in FR_A_VERBS and _has(word, rv, "e"):
                    word = word[:-1]
        if word == was:
            if word.endswith("s") and len(word) > 1 and word[-2] not in "aious":
                word = word[:-1]
            ending = _ending(word[rv:], ("ion", "ier", "iere", "e"))
            if ending == "ion":
                word = word[:-3] if _has(word, r2, "ion") and word[-4:-3] in ("s", "t") else word
            elif ending in ("ier", "iere"):
                word = word[: -len(ending)] + "i"
            elif ending:
                word = word[:-1]
        elif word.endswith("Y"):
            word = word[:-1] + "i"
    elif word.endswith("Y"):
        word = word[:-1] + "i"
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    return word.lower()


STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "fr": french, "de": german, "es": spanish}


def stem_word(word: str, language: str | None) -> str:
    """Stem of a folded word; in a language without rules, and with digits in it, the word itself."""
    rules = STEMMERS.get(language or "")
    return rules(word) if rules and word.isalpha() else word


def with_stems(terms: DataFrame) -> DataFrame:
    """(term, lang, stem) for distinct (term, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems = [stem_word(t, language) for t, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(stems, pa.string())], names=["term", "lang", "stem"])

    return terms.select("term", "lang").mapInArrow(run, "term string, lang string, stem string")
