"""Pre-tokens of byte-level BPE: contractions, letter runs, digit runs, other runs and white space.

A white-space run together with the non-space run after it (a *unit*) splits into pre-tokens by itself: no pre-token
holds a non-space character before a space, and look-ahead reaches one character. Units repeat, so results are kept
by unit.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

#: White space as the tokenizers' regular-expression engines define it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNIT = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Any white space or control sign that the quick way cannot take.
_ODD = re.compile("[\t\x0b\x0c\r\x00\x1c-\x1f\x85\xa0  -     　]|[ \n][ \n]")


@lru_cache(maxsize=4)
def compiled(pattern: str):
    """The pattern with its \\s and \\S written out, so that every engine's idea of white space is the same here."""
    written = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(written)


def units(text: str) -> list[str]:
    """The units of a text, in order; they concatenate to the text."""
    if not text:
        return []
    if _ODD.search(text) is None:
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return cut if cut[0] else cut[1:]
    return _UNIT.findall(text)
