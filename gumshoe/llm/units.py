"""Units of a text whose byte-level tokens do not depend on their surroundings, and a cache over them.

The split pattern of the byte-level vocabularies lets a match begin with one blank or consist of white
space. So a run of white space and the run of other characters behind it always begin and end a
match: the ids of a text are those of its units, one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from gumshoe.llm.common import Recent

# The code points with the Unicode property White_Space.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
RUNS = re.compile(f"[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+")
ADJACENT = re.compile(f"[{WHITE}]{{2}}")


def unit_lists(text: str) -> Iterator[tuple[bool, list[str]]]:
    """The units of a text in order, in lists; True if each of a list stands for itself behind a blank.

    Where no two white-space characters meet, lines and blanks are cut by plain splits, which
    are several times as fast as a pattern.
    """
    if ADJACENT.search(text):
        yield False, RUNS.findall(text)
        return
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        yield False, (["\n", first] if i else [first])
        yield True, rest


class UnitEncoder:
    """Encodes texts unit by unit with `encode`, remembering what it gave for a unit."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.bare = Recent(lambda unit: encode(unit) if unit else b"")
        self.spaced = Recent(lambda unit: encode(" " + unit))

    def __call__(self, text: str) -> bytes:
        bare, spaced, out = self.bare.__getitem__, self.spaced.__getitem__, []
        for blank, units in unit_lists(text):
            out.extend(map(spaced if blank else bare, units))
        return b"".join(out)
