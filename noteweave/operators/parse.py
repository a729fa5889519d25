"""Markdown notes to rows: headings, tags, blocks, links, title and aliases.

The scanner reads a text once, line by line. Lines count from 0 and include
front matter; columns and clip lengths are UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions.text import MAX_ALIASES, encode_path

_HEADING = re.compile(r"[ \t]{0,3}(#{1,6})(?:[ \t]+(.*))?\Z")
_CLOSING = re.compile(r"(?:\A|[ \t]+)#+[ \t]*\Z")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})(.*)\Z")
_ITEM = re.compile(r"[ \t]{0,3}(?:[-*+]|\d{1,9}[.)])(?:[ \t]|\Z)")
_QUOTE = re.compile(r"[ \t]{0,3}>")
_PIPE = re.compile(r"(?:[^\\|]|\\.)*\|")
_WIKI = re.compile(r"\[\[([^\[\]\n]*)\]\]")
_LINK = re.compile(r"\[([^\[\]]*)\]\((<[^<>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)([^()]*)\)")
_TAG = re.compile(r"#([A-Za-z0-9_/-]+)")
_NOTE_FILE = re.compile(r"(?i).+\.(?:md|markdown)")
_MARK = re.compile(r"[`\[#]")
_TAG_BEFORE = re.compile(r"[A-Za-z0-9_-]")


class Note(NamedTuple):
    title: str
    aliases: list[str]
    headings: list[tuple[str, int, int]]  # text, level, line
    tags: list[tuple[str, int]]  # tag, line
    blocks: list[tuple[str, int, int, int]]  # kind, first line, last line, weight
    links: list[tuple[str, str, str, str, int, int, str]]  # raw, heading, alias, kind, line, col, context


def note_like(target: str) -> bool:
    """Can a target name a note (see functions.text.is_note_like)?"""
    if ":" in target:
        return False
    base = target.strip(" \t").split("#", 1)[0]
    base = base[max(base.rfind("/"), base.rfind("\\")) + 1 :]
    return base != "" and ("." not in base or _NOTE_FILE.fullmatch(base) is not None)


def _unquote(s: str) -> str:
    s = s.strip(" \t")
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'" else s


def front_matter(lines: list[str]) -> tuple[int, str, list[str]]:
    """(lines used, title, aliases) of the block between '---' lines at the top; 0 lines if there is none."""
    if not lines or lines[0].removeprefix("﻿") != "---":
        return 0, "", []
    end = next((i for i in range(1, len(lines)) if lines[i].rstrip(" \t") in ("---", "...")), None)
    if end is None:
        return 0, "", []
    title, aliases, listing = "", [], False
    for line in lines[1:end]:
        if listing and re.match(r"[ \t]*-[ \t]+", line):
            aliases.append(_unquote(line.lstrip(" \t")[1:]))
            continue
        listing = False
        key, colon, value = line.partition(":")
        if not colon or key != key.strip():
            continue
        value = value.strip(" \t")
        if key == "title":
            title = _unquote(value)
        elif key in ("aliases", "alias"):
            if value.startswith("[") and value.endswith("]"):
                aliases += [_unquote(x) for x in value[1:-1].split(",")]
            elif value:
                aliases.append(_unquote(value))
            else:
                listing = True
    return end + 1, title, [a for a in aliases if a][:MAX_ALIASES]


def heading(line: str) -> tuple[int, str] | None:
    """(level, text) of an ATX heading line."""
    m = _HEADING.match(line) if "#" in line else None
    if not m:
        return None
    return len(m[1]), _CLOSING.sub("", m[2] or "").strip(" \t")


def block_kind(line: str) -> str:
    if _ITEM.match(line):
        return "list"
    if _QUOTE.match(line):
        return "blockquote"
    return "table" if _PIPE.match(line) else "paragraph"


def escaped(s: str, i: int) -> bool:
    """Does an odd run of backslashes stand before position ``i``?"""
    n = i
    while n and s[n - 1] == "\\":
        n -= 1
    return (i - n) % 2 == 1


def code_end(s: str, i: int) -> int:
    """Where the in-line code that opens at ``i`` ends; after the opener if it never closes."""
    n = i
    while n < len(s) and s[n] == "`":
        n += 1
    width, at = n - i, n
    while (at := s.find("`", at)) >= 0:
        end = at
        while end < len(s) and s[end] == "`":
            end += 1
        if end - at == width:
            return end
        at = end
    return n


def wikilink_parts(body: str) -> tuple[str, str, str]:
    """(target, heading, alias) of what stands between the brackets."""
    link, _, alias = body.partition("|")
    target, _, head = link.partition("#")
    return target.strip(" \t"), head.strip(" \t"), alias.strip(" \t")


def inline(line: str, number: int, tags: list, links: list) -> None:
    """Append the tags and links of one line, left to right; code and escapes are stepped over."""
    i = 0
    while mark := _MARK.search(line, i):
        i, c = mark.start(), mark[0]
        if c == "`" and not escaped(line, i):
            i = code_end(line, i)
            continue
        if c == "[" and not escaped(line, i):
            if m := _WIKI.match(line, i):
                target, head, alias = wikilink_parts(m[1])
                if note_like(target):
                    embed = i > 0 and line[i - 1] == "!"
                    col = len(line[: i - embed].encode())
                    links.append((target, head, alias, "embed" if embed else "wikilink", number, col, line))
                i = m.end()
                continue
            if (m := _LINK.match(line, i)) and not (i > 0 and line[i - 1] == "!"):
                url = m[2][1:-1] if m[2].startswith("<") else m[2]
                if note_like(url):
                    links.append((url, url.partition("#")[2], m[1], "markdown", number, len(line[:i].encode()), line))
                i = m.end()
                continue
        elif c == "#" and not escaped(line, i) and not (i > 0 and _TAG_BEFORE.match(line[i - 1])):
            if m := _TAG.match(line, i):
                if not m[1].endswith("/"):
                    tags.append((m[1], number))
                i = m.end()
                continue
        i += 1


def scan(text: str) -> Note:
    """All rows of one note."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    start, title, aliases = front_matter(lines)
    note = Note(title, aliases, [], [], [], [])
    kind, first, last, weight = "", 0, 0, 0
    fence = ""

    def flush() -> None:
        nonlocal kind
        if kind:
            note.blocks.append((kind, first, last, weight))
            kind = ""

    for number in range(start, len(lines)):
        line = lines[number]
        if fence:
            m = _FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip(" \t"):
                last, fence = number, ""
                flush()
            elif number < len(lines) - 1 or line:
                last, weight = number, weight + 1
            continue
        m = _FENCE.match(line) if "```" in line or "~~~" in line else None
        if m and not (m[1][0] == "`" and "`" in m[2]):
            flush()
            kind, first, last, weight, fence = "code", number, number, 0, m[1]
            continue
        if not line.strip(" \t"):
            flush()
            continue
        if head := heading(line):
            flush()
            note.headings.append((head[1], head[0], number))
        else:
            k = block_kind(line)
            if k != kind:
                flush()
                kind, first, weight = k, number, 0
            last, weight = number, weight + len(line.split())
        inline(line, number, note.tags, note.links)
    flush()
    return note


# -- readings of a line


def plain_inline(s: str) -> str:
    """In-line markdown as the text a reader sees."""
    out: list[str] = []
    i = 0
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s) and not s[i + 1].isalnum() and not s[i + 1].isspace():
            out.append(s[i + 1])
            i += 2
        elif c == "`":
            end = code_end(s, i)
            out.append(s[i:end].strip("`").strip() if s[end - 1] == "`" and end - i > 2 else s[i:end])
            i = end
        elif c in "![" and (m := _WIKI.match(s, i + (c == "!"))):
            target, head, alias = wikilink_parts(m[1])
            out.append(alias or target or head)
            i = m.end()
        elif c in "![" and (m := _LINK.match(s, i + (c == "!"))):
            out.append(plain_inline(m[1]))
            i = m.end()
        elif c == "*" or s.startswith("~~", i):
            i += 1 if c == "*" else 2
        elif c == "_" and not (0 < i < len(s) - 1 and s[i - 1].isalnum() and s[i + 1].isalnum()):
            i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def clip(s: str, most: int) -> str:
    """The first line in at most ``most`` bytes, whole characters, cut at a blank if one is near the end."""
    s = s.split("\n", 1)[0]
    raw = s.encode()
    if len(raw) <= most:
        return s
    cut = raw[:most].decode("utf-8", "ignore")
    blank = cut.rfind(" ")
    return cut[:blank] if blank * 3 >= len(cut) * 2 else cut


def excerpt(text: str, line: int, most: int = 160) -> str | None:
    """A short reading of the block that begins at a line; None if there is nothing to read.

    The first line with words within four is taken; a code fence is named by
    its info word; quote and cell marks, one bullet and a task box are left out.
    """
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    for s in lines[line : line + 4]:
        if m := _FENCE.match(s):
            if m[2].strip():
                return clip(m[2].strip(), most)
            continue
        if re.fullmatch(r"[ \t|:-]+", s) and "-" in s:
            continue
        s = re.sub(r"\A(?:[ \t]*[>|])+[ \t]*", "", s).strip(" \t|")
        s = re.sub(r"\A(?:[-*+]|\d{1,9}[.)])[ \t]+", "", s)
        s = re.sub(r"\A\[[ xX]\][ \t]+", "", s)
        s = re.sub(r"[ \t]*\|[ \t]*", " ", s)
        if s := plain_inline(s).strip():
            return clip(s, most)
    return None


def context(line: str) -> tuple[str, list[tuple[int, int]]]:
    """(visible text, spans) of a mention's line: link syntax collapsed, each link's text a span in bytes."""
    out, spans, size, i = [], [], 0, 0
    line = line.strip()
    while i < len(line):
        j = i + (line[i] == "!")
        m = _WIKI.match(line, j)
        if m:
            target, head, alias = wikilink_parts(m[1])
            text = alias or (f"{target} > {head}" if head and target else target or head)
        elif m := _LINK.match(line, j):
            text = m[1]
        if m and text:
            out.append(text)
            spans.append((size, size + len(text.encode())))
            size += len(text.encode())
            i = m.end()
            continue
        out.append(line[i])
        size += len(line[i].encode())
        i += 1
    return "".join(out), spans


def caret_context(text: str, at: int) -> tuple[str, str | None, bool, int, int] | None:
    """(prefix, heading, embed, from, to) of the open '[[' before byte ``at``; None if the caret is in no link.

    heading is None before a '#', and a block reference ('#^') gives None.
    from and to are the bytes a completion replaces.
    """
    raw = text.encode()
    head = raw[raw.rfind(b"\n", 0, at) + 1 : at]
    open_ = head.rfind(b"[[")
    if open_ < 0 or b"]]" in head[open_:] or b"|" in head[open_:]:
        return None
    body = head[open_ + 2 :]
    start = at - len(body)
    rest = raw[at : raw.find(b"\n", at) if raw.find(b"\n", at) >= 0 else len(raw)]
    stop = re.search(rb"\]\]|\[\[|\|", rest)
    end = at + (stop.start() if stop and stop[0] == b"]]" else 0)
    embed = open_ > 0 and head[open_ - 1 : open_] == b"!"
    prefix, mark, part = body.partition(b"#")
    if part.startswith(b"^"):
        return None
    return prefix.decode("utf-8", "replace"), part.decode("utf-8", "replace") if mark else None, embed, start, end


def relative(source: str, target: str) -> str:
    """The way from the folder of one path to another path."""
    a, b = source.split("/")[:-1], target.split("/")
    shared = 0
    while shared < len(a) and shared < len(b) - 1 and a[shared] == b[shared]:
        shared += 1
    return "../" * (len(a) - shared) + "/".join(b[shared:])


def convert_wikilinks(text: str, source: str, note_of: Callable[[str], str | None], media_of: Callable[[str], str | None]) -> str | None:
    """``text`` with each resolvable '[[x]]' as '[label](path#anchor)'; None if nothing changes.

    Embeds resolve against media only. Code, fences, escapes and links that
    resolve to nothing stay as they are; line ends are kept.
    """
    out: list[str] = []
    fence, changed = "", False
    lines = text.split("\n")
    start = front_matter([x.removesuffix("\r") for x in lines])[0]
    for number, full in enumerate(lines):
        line = full.removesuffix("\r")
        m = _FENCE.match(line)
        if number < start:
            out.append(full)
            continue
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
            out.append(full)
            continue
        if m and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
            out.append(full)
            continue
        parts, i = [], 0
        while i < len(line):
            if line[i] == "`" and not escaped(line, i):
                end = code_end(line, i)
                parts.append(line[i:end])
                i = end
                continue
            embed = line[i] == "!" and line.startswith("[[", i + 1)
            if (embed or line.startswith("[[", i)) and not escaped(line, i) and (w := _WIKI.match(line, i + embed)):
                target, head, alias = wikilink_parts(w[1])
                to = media_of(target) if embed else note_of(target) if note_like(target) else None
                if to:
                    way = relative(source, to) + (f"#{head}" if head and not embed else "")
                    way = f"<{way}>" if re.search(r"[\s()<>]", way) else way
                    parts.append(f"{'!' if embed else ''}[{alias or target}]({way})")
                    changed = True
                    i = w.end()
                    continue
            parts.append(line[i])
            i += 1
        out.append("".join(parts) + full[len(line) :])
    return "\n".join(out) if changed else None


# -- tables


_ROWS = {
    "headings": pa.list_(pa.struct([("text", pa.string()), ("level", pa.int32()), ("line", pa.int32())])),
    "tags": pa.list_(pa.struct([("tag", pa.string()), ("line", pa.int32())])),
    "blocks": pa.list_(pa.struct([("kind", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("weight", pa.int32())])),
    "links": pa.list_(pa.struct([("raw", pa.string()), ("heading", pa.string()), ("alias", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("context", pa.string())])),
}
_SCHEMA = (
    "note_key string, title string, aliases array<string>, headings array<struct<text:string,level:int,line:int>>, tags array<struct<tag:string,line:int>>, "
    "blocks array<struct<kind:string,line_start:int,line_end:int,weight:int>>, links array<struct<raw:string,heading:string,alias:string,kind:string,line:int,col:int,context:string>>"
)


def _lists(rows: list[list[tuple]], kind: pa.ListType) -> pa.ListArray:
    """Lists of tuples as an Arrow array, made column by column."""
    flat = list(chain.from_iterable(rows))
    columns = zip(*flat, strict=True) if flat else [()] * len(list(kind.value_type))
    structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type, strict=True)], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), structs, type=kind)


def scanned(docs: DataFrame, key: str = "note_key", text: str = "text") -> DataFrame:
    """One row per note with its child rows as arrays; NULL texts are read as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            notes = [scan(t or "") for t in batch.column(1).to_pylist()]
            cols = [batch.column(0), pa.array([n.title for n in notes], pa.string()), pa.array([n.aliases for n in notes], pa.list_(pa.string()))]
            for name, kind in _ROWS.items():
                cols.append(_lists([getattr(n, name) for n in notes], kind))
            yield pa.RecordBatch.from_arrays(cols, ["note_key", "title", "aliases", *_ROWS])

    return docs.select(F.col(key).cast("string").alias("note_key"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def child(notes: DataFrame, name: str) -> DataFrame:
    """The child rows ``name`` (headings, tags, blocks or links) with note_key and ord."""
    return notes.select("note_key", F.posexplode(name).alias("ord", "__c")).select("note_key", "ord", "__c.*")
