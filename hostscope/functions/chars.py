"""Character classes derived by rule, rendered as Java-regex classes.

Python's str.strip/isspace/isdigit and JavaScript's trim/\\s use their own
character sets; Spark's ``trim`` only strips U+0020 and ``\\s`` is ASCII.
The classes are computed from the Python runtime (or stated for JS) so the
Spark expressions agree with the semantics they stand in for.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache


def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in sorted(codepoints):
        if out and cp == out[-1][1] + 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def java_class(codepoints: list[int], negate: bool = False) -> str:
    """Render code points as a Java regex character class."""
    parts = []
    for lo, hi in _ranges(codepoints):
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
    return "[" + ("^" if negate else "") + "".join(parts) + "]"


@lru_cache(maxsize=None)
def python_space_points() -> tuple[int, ...]:
    return tuple(cp for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


@lru_cache(maxsize=None)
def python_extra_digit_points() -> tuple[int, ...]:
    """Code points where ``str.isdigit`` is true outside category Nd."""
    return tuple(
        cp
        for cp in range(sys.maxunicode + 1)
        if chr(cp).isdigit() and unicodedata.category(chr(cp)) != "Nd"
    )


@lru_cache(maxsize=None)
def nfkc_delimiter_class() -> str:
    """Class of the non-ASCII characters whose NFKC form holds a URL delimiter
    (``/ ? # @ :``).  None of these delimiters composes with a following mark, so a
    text's NFKC form holds one exactly if a character's does."""
    return java_class([
        cp for cp in range(0x80, sys.maxunicode + 1)
        if not 0xD800 <= cp <= 0xDFFF and set("/?#@:") & set(unicodedata.normalize("NFKC", chr(cp)))
    ])


# FIXED VALUES: ECMAScript WhiteSpace + LineTerminator (used by trim and \s).
JS_SPACE_POINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008,
    0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)


def py_space_class() -> str:
    return java_class(list(python_space_points()))


def py_digit_class() -> str:
    """Java class equal to Python ``str.isdigit`` for one character."""
    extra = java_class(list(python_extra_digit_points()))
    return "[\\p{Nd}" + extra[1:-1] + "]"


def js_space_class() -> str:
    return java_class(list(JS_SPACE_POINTS))
