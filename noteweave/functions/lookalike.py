"""One consistent form for text that looks the same but differs in characters.

``plain`` gives the form a reader sees: nothing invisible, ordinary blanks,
hyphens and width, composed accents, and the letters of each word from one
script. It is the identity on printable ASCII.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are drawn like a Latin letter, and that letter.
CYRILLIC = "асԁеһіјӏорԛѕѵԝхуАВСЕԌНІЈКМОРԚЅТѴԜХУӀ"
CYRILLIC_AS = "acdehijlopqsvwxyABCEGHIJKMOPQSTVWXYI"
GREEK = "ονιαρυγϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ"
GREEK_AS = "oviapuycjABEZHIKMNOPTYXCJ"
ARMENIAN = "օսոհցզյՕՍՏ"
ARMENIAN_AS = "ounhgqjOUS"

PROTOTYPE = {o: p for os, ps in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS)) for o, p in zip(os, ps, strict=True)}
#: Latin letter to its look-alike, for words whose other letters are Cyrillic or Greek.
_INTO = {
    "cyrillic": {p: o for o, p in zip(CYRILLIC, CYRILLIC_AS)},
    "greek": {p: o for o, p in zip(GREEK, GREEK_AS)},
}

_HYPHENS = "\u2010\u2011\ufe63\uff0d"
_FILLERS = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
_PRINTABLE = re.compile(r"[\x20-\x7e]*")
_ALPHABETS = re.compile("[\u0370-\u058f\u1f00-\u1fff]")


class _Clean(dict):
    """Character to its visible form, worked out on first use."""

    def __missing__(self, code: int):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if ch in "\t\n\r\v\f\x85\u2800" or kind in ("Zs", "Zl", "Zp"):
            out = " "
        elif ch in _HYPHENS:
            out = "-"
        elif kind in ("Cf", "Cc") or ch in _FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            out = ""
        elif 0xFF01 <= code <= 0xFFEF:
            out = unicodedata.normalize("NFKC", ch)
        else:
            out = ch
        self[code] = out
        return out


_CLEAN = _Clean()


def visible(s: str) -> str:
    """``s`` without invisible characters, with ordinary blanks, hyphens and width."""
    return s.translate(_CLEAN)


def _script(ch: str) -> str:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c <= 0x1EFF:
        return "latin"
    if 0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "greek"
    if 0x400 <= c <= 0x52F:
        return "cyrillic"
    if 0x530 <= c <= 0x58F:
        return "armenian"
    return "other"


def _one_script(word: str) -> str:
    """``word`` (decomposed) in the one script all its letters can be read as.

    Latin is tried first, then Cyrillic and Greek; a word that fits no single
    script is left alone.
    """
    scripts = {_script(ch) for ch in word if ch.isalpha()}
    if len(scripts) < 2 or "other" in scripts:
        return word
    for target in ("latin", "cyrillic", "greek"):
        if target not in scripts:
            continue
        out = []
        for ch in word:
            if ch.isalpha() and _script(ch) != target:
                ch = PROTOTYPE.get(ch) if target == "latin" else _INTO[target].get(PROTOTYPE.get(ch, ch))
                if ch is None:
                    break
            out.append(ch)
        else:
            return "".join(out)
    return word


# A word for this purpose: letters with their combining marks.
_WORD = re.compile(r"[^\W\d_][^\W\d_\u0300-\u036f]*(?:[\u0300-\u036f]+[^\W\d_]*)*")


def plain(s: str | None) -> str | None:
    """The plain text ``s`` looks like; None stays None."""
    if s is None or _PRINTABLE.fullmatch(s):
        return s
    s = visible(s)
    if _ALPHABETS.search(s):
        s = _WORD.sub(lambda m: _one_script(m[0]), unicodedata.normalize("NFD", s))
    return unicodedata.normalize("NFC", s)


def _mapped(f):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in values.to_pylist()], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def not_plain_ascii(c: Column) -> Column:
    """True where ``plain`` can change the value at all."""
    return c.rlike(r"[^\x20-\x7e]")


def plain_col(c: Column) -> Column:
    """``plain`` as a column; only values beyond printable ASCII go to Python."""
    return F.when(not_plain_ascii(c), _mapped(plain)(F.when(not_plain_ascii(c), c))).otherwise(c)
