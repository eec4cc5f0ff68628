"""Words and terms of a text, as Python patterns and as Spark columns.

A *word* is a maximal run of letters or digits, lower-cased; a *term* a maximal run of letters. Digits include all numeric
characters (superscripts and Roman numerals too); combining marks are neither.
"""

from __future__ import annotations

import re
import sys
import unicodedata

WORD = re.compile(r"[^\W_]+")
_numeric = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")]


def _ranges(chars: list[str]) -> str:
    out, start, last = [], None, None
    for o in map(ord, chars):
        if start is None:
            start = o
        elif o != last + 1:
            out.append((start, last))
            start = o
        last = o
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: ``\w`` without decimal digits, underscore and the other numerics leaves letters.
LETTERS = re.compile(rf"[^\W\d_{_ranges(_numeric)}]+")
#: The same two classes, and any other character that isn't white space, for Spark's (Java's) expressions.
JAVA_WORD = r"[\p{L}\p{N}]+"
JAVA_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\x0b\x1c-\x1f\x85\p{Z}]"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def terms(text: str) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []
