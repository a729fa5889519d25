"""Evaluation texts leaking into training text: one Aho-Corasick automaton.

All runs of ``words`` normalised words of the evaluation texts are the patterns
of one automaton over word numbers. Each document is scanned once; markup is
stepped over, what long markup holds is scanned as a text of its own, and
every hit is mapped back to character offsets of the original text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run that counts as a leak.
WORDS = 12
#: Patterns of one automaton; more evaluation text is scanned in further passes.
MAX_PATTERNS = 400_000

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(
    r"""<!--.*?-->
  | <ref\b[^<>]*?(?:/>|>.*?</ref>) | <sup>.*?</sup> | </?[A-Za-z!][^<>]*>
  | !\[[^\]\n]*\]\([^()\n]*\) | \]\([^()\n]*\) | \[\^[^\]\s]+\] | \[https?://[^\s\]]*
  | \[\[(?:[^\[\]|\n]*\|)+ | \{\{lang\|[^{}|\n]*\| | \{\{(?:small|quote|big|nowrap|abbr)\| | \{\{[^{}]*\}\}
  | ~?\\(?:footnote|cite\w*|ref|label|href)\*?\{[^{}]*\} | \\[A-Za-z]+\*?
  | &(?:\#\d+|\#x[0-9A-Fa-f]+|[A-Za-z]\w+); | (?<![\w&/])\#[A-Za-z][\w/-]* | __[A-Z]{3,}__
  """,
    re.S | re.X,
)
_MARKUP_SIGNS = re.compile(r"[<\[{\\&#]|__")
_BEYOND = re.compile(r"[^\x00-\x7fÀ-ſ]")
# Openers that reach to a closer however far away, and what is written for one without any: as long, and a mark no more.
_FAR = (("<!--", "-->", "    "), ("<ref", "</ref>", "<rif"), ("<sup>", "</sup>", "<sop>"))


def _without_open_ends(s: str) -> str:
    """``s`` with openers that nothing closes written otherwise, so that no search for a closer runs to the end twice."""
    for opener, closer, instead in _FAR:
        if opener in s:
            last = s.rfind(closer) + 1
            s = s[:last] + s[last:].replace(opener, instead)
    return s


def _read(s: str) -> tuple[str, list[tuple[int, int]]]:
    """``s`` with blanks for its markup, and where markup with words of its own stood."""
    inside: list[tuple[int, int]] = []

    def hide(m: re.Match) -> str:
        inside.append(m.span())
        return " " * len(m[0])

    if _MARKUP_SIGNS.search(s):
        s = _MARKUP.sub(hide, _without_open_ends(s))
    return s, inside


def _settled(text: str) -> tuple[str, list[int] | None]:
    """Composed text without invisible characters, and each character's original offset."""
    if not _BEYOND.search(text):
        return text, None
    out: list[str] = []
    at: list[int] = []
    start = 0
    n = len(text)
    while start < n:
        end = start + 1
        while end < n and unicodedata.combining(text[end]):
            end += 1
        piece = text[start:end]
        piece = piece if piece.isascii() else "".join(c for c in unicodedata.normalize("NFKC", piece) if unicodedata.category(c) != "Cf")
        out.append(piece)
        at += [start] * len(piece)
        start = end
    return "".join(out), at


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words a reader sees, offsets in the original."""
    s, at = _settled(text)
    s, _ = _read(s)
    found = [(m[0].casefold(), m.start(), m.end()) for m in _WORD.finditer(s)]
    return found if at is None else [(w, at[i], at[j - 1] + 1) for w, i, j in found]


class Scanner:
    """The automaton over the runs of the given (item, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS):
        self.words = words
        self.ids: dict[str, int] = {}
        runs: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            numbers = [self.ids.setdefault(w, len(self.ids) + 1) for w, _, _ in words_of(text)]
            for i in range(len(numbers) - words + 1):
                of = runs.setdefault(tuple(numbers[i : i + words]), [])
                if not of or of[-1] != item:
                    of.append(item)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for run, of in runs.items():
            self.auto.add_word(run, of)
        self.empty = not runs
        if runs:
            self.auto.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, words) of each longest stretch of runs of one item."""
        if self.empty:
            return []
        s, at = _settled(text)
        found: list[tuple[int, int, int, int]] = []
        parts = [(s, 0)]
        while parts:
            part, offset = parts.pop()
            seen, inside = _read(part)
            found += [(item, i + offset, j + offset, n) for item, i, j, n in self._stretches(seen)]
            # what markup holds (a note, a template, a comment) is a text of its own
            parts += [(part[i + 1 : j - 1], offset + i + 1) for i, j in inside if j - i > 2 * self.words and len(_WORD.findall(part, i, j)) >= self.words]
        if at is None:
            return found
        return [(item, at[i], at[j - 1] + 1, n) for item, i, j, n in found]

    def _stretches(self, s: str) -> list[tuple[int, int, int, int]]:
        get = self.ids.get
        # each word folded as in words_of; a fold of the whole text first could part a word
        numbers = tuple([get(w, 0) for w in (_WORD.findall(s.lower()) if s.isascii() else map(str.casefold, _WORD.findall(s)))])
        if len(numbers) < self.words:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for last, of in self.auto.iter(numbers):
            for item in of:
                open_ = stretches.setdefault(item, [])
                if open_ and open_[-1][1] == last - 1:
                    open_[-1][1] = last
                else:
                    open_.append([last - self.words + 1, last])
        if not stretches:
            return []
        spans = [m.span() for m in _WORD.finditer(s)]
        return [(item, spans[i][0], spans[j][1], j - i + 1) for item, open_ in stretches.items() for i, j in open_]


_SCANNERS: dict[int, Scanner] = {}


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, item, start_char, end_char, n_words): every stretch of at least ``words`` words shared with an item.

    Case, punctuation, blanks, line breaks and markup do not count. Items of
    fewer words cannot leak; NULL and empty texts on either side give nothing;
    two items with the same run are both reported. The evaluation set is held
    out by hand and small: it is collected and cut into blocks of at most
    MAX_PATTERNS runs, one scan of the documents for each block, so a larger
    set costs passes and never memory. Documents are never shuffled.
    """
    held = [(r[0], r[1]) for r in items.select(item, item_text).filter(F.col(item_text).isNotNull()).distinct().orderBy(item).toLocalIterator()]
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for one in held:
        n = len(one[1]) // 2
        if size + n > MAX_PATTERNS * 4 and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(one)
        size += n
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"`{key}` {key_type}, `{item}` {item_type}, start_char int, end_char int, n_words int"
    rows = docs.select(key, F.col(text).cast("string")).filter(F.col(text).isNotNull())
    key_arrow = pa.string() if key_type == "string" else None
    item_arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[item_type]

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        mark = hash((tuple(block), words))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = _SCANNERS.get(mark)
            if scanner is None:
                _SCANNERS.clear()
                scanner = _SCANNERS[mark] = Scanner(block, words)
            for batch in batches:
                take: list[int] = []
                found: list[tuple[int, int, int, int]] = []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    if hits := scanner.hits(t):
                        found += hits
                        take += [i] * len(hits)
                cols = list(zip(*found, strict=True)) if found else [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], item_arrow), *(pa.array(c, pa.int32()) for c in cols[1:])],
                    [key, item, "start_char", "end_char", "n_words"],
                )

        return rows.mapInArrow(run, schema)

    out = scan(blocks[0])
    for block in blocks[1:]:
        out = out.unionByName(scan(block))
    return out
