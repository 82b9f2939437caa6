"""Splitting of texts where byte-level BPE with the usual pattern can never join: before white space."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

from .common import Recent

#: The pattern of the byte-level tokenizers used here (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Unicode's White_Space property, which the libraries take for \s.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_UNEVEN = re.compile(f"(?:^| )(?:[{SPACE}]|$)|[{SPACE}](?= )|[{SPACE}]$")


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` for the regex module, with the libraries' white space."""
    out, inside = "", False
    for part in re.findall(r"\\.|.", pattern, re.S):
        inside = (inside or part == "[") and part != "]"
        out += {r"\s": SPACE if inside else f"[{SPACE}]", r"\S": f"[^{SPACE}]"}.get(part, part)
    return regex.compile(out)


class UnitMemo:
    """``make(unit)`` for the units of a text: white space with the text behind it up to the next white space.

    No match of the pattern goes from text to white space, and what it does with white space depends on what follows,
    so units can be looked up on their own. Results are kept in bounded memos.
    """

    def __init__(self, make: Callable[[str], object], at_most: int = 200_000, longest: int | None = None):
        self.plain = Recent(make, at_most, longest)
        self.spaced = Recent(lambda word: make(" " + word), at_most, longest)

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(text)

    def __call__(self, text: str) -> list:
        if not text:
            return []
        if _UNEVEN.search(text):
            return list(map(self.plain.__getitem__, _UNIT.findall(text)))
        first, *words = text.split(" ")
        return [self.plain[first], *map(self.spaced.__getitem__, words)]
