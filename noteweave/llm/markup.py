"""Markup residue in text documents: layout-aware rendering.

One text may mix Markdown, wiki, HTML and LaTeX. Code, formulas, tables and
hidden parts are set aside first, inline marks are resolved to what a reader
sees, HTML goes through a tree builder with implied end tags and visibility
rules, and what stands outside HTML blocks is read line by line. The result is
a list of blocks, written out with headings, lists, code, formulas and aligned
table cells recognisable.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING, LIST, CODE, FORMULA = "heading", "list", "code", "formula"
KINDS = (HEADING, LIST, CODE, FORMULA)

# Placeholders of parts that are set aside; these code points are removed from the input.
_OPEN, _CLOSE = "\ue000", "\ue001"
_SLOT = re.compile(f"{_OPEN}(\\d+){_CLOSE}")
_SLOT_LINE = re.compile(f"[ \\t:]*{_OPEN}(\\d+){_CLOSE}[ \\t.,;]*")
_PRIVATE = re.compile(f"[{_OPEN}{_CLOSE}]")

_FRONT = re.compile(r"\A\ufeff?---[ \t]*\n(?:[^\n]*\n)*?(?:---|\.\.\.)[ \t]*(?:\n|\Z)")
_ASIDE = re.compile(
    r"""
    (?P<fence>^[ ]{0,3}(?P<bar>`{3,}|~{3,})[^\n`]*\n(?P<body>(?:[^\n]*\n)*?)[ ]{0,3}(?P=bar)[`~]*[ \t]*(?:\n|\Z))
  | (?P<lone>^[ ]{0,3}(?:`{3,}|~{3,})[ \t]*\w*[ \t]*\n)
  | (?P<comment><!--.*?-->)
  | <(?P<raw>pre|source|syntaxhighlight|script|style|math|nowiki)\b(?P<attrs>[^<>]*)(?:/>|>(?P<inner>.*?)</(?P=raw)\s*>)
  | \\begin\{(?P<env>verbatim\*?|lstlisting|minted|equation\*?|align\*?|gather\*?|eqnarray\*?|displaymath|math|tabular\*?)\}(?P<content>.*?)\\end\{(?P=env)\}
  | (?P<table>^[ ]*\{\|.*?^[ ]*\|\})
  | \$\$(?P<display>[^$]+?)\$\$
  | \\\[(?P<bracket>.+?)\\\]
  | \\\((?P<paren>.+?)\\\)
  | (?<![\w$\\])\$(?P<dollar>[^\s$](?:[^$\n]*?[^\s$\\])?)\$(?![\w$])
  | ``(?P<quote>[^`\n]*?)''
  | (?<!`)(?P<tick>`{1,2})(?!`)(?P<span>[^`\n]+)(?P=tick)(?!`)
    """,
    re.M | re.S | re.X | re.I,
)
_ASIDE_NEEDS = re.compile(r"[`~]{3}|<(?:!--|pre|source|syntax|script|style|math|nowiki)|\\begin|\{\||\$|\\\[|\\\(|`", re.I)
# Where something set aside may begin, and what has to close it; the other openers close on their line or at the next such sign.
_OPENER = re.compile(
    r"""^[ ]{0,3}(?P<bar>`{3,}|~{3,}) | (?P<comment><!--) | <(?P<raw>pre|source|syntaxhighlight|script|style|math|nowiki)\b
  | \\begin\{(?P<env>[a-z]+\*?)\} | (?P<table>^[ ]*\{\|) | (?P<pair>\\[\[(]) | \$ | `""",
    re.M | re.X | re.I,
)


@lru_cache(1_000)
def _closer(kind: str) -> re.Pattern:
    if kind in ("comment", "table"):
        return re.compile("-->" if kind == "comment" else r"^[ ]*\|\}", re.M)
    if kind[0] in "`~":
        return re.compile(f"^[ ]{{0,3}}{kind}[`~]*[ \\t]*$", re.M)
    if kind[0] == "\\":
        return re.compile(r"\\\]" if kind == "\\[" else r"\\\)")
    return re.compile(rf"</{re.escape(kind)}\s*>|\\end\{{{re.escape(kind)}\}}", re.I)


_ASIDE_UNCLOSED = re.compile(
    r"""(?P<lone>^[ ]{0,3}(?:`{3,}|~{3,})[ \t]*\w*[ \t]*\n)
  | <(?P<raw>pre|source|syntaxhighlight|script|style|math|nowiki)\b(?P<attrs>[^<>]*)/>
    """,
    re.M | re.X | re.I,
)
_MATH_SIGN = re.compile(r"[\\^_={}+<>]|\A\d*[A-Za-z]\Z")

#: Elements that begin a block of text, and inline or structural ones that only mark it.
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li dt dd blockquote td th caption section article header footer main aside figcaption address".split())
_FRAMES = frozenset("html body ul ol dl table tr thead tbody tfoot figure nav form details summary center".split())
_HIDDEN = frozenset("head title ref template noscript".split())
_VOID = frozenset("br hr img wbr input meta link col area references".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var gallery ruby rt rp svg button iframe video audio".split())
_KNOWN = _BLOCKS | _FRAMES | _HIDDEN | _VOID | _INLINE
_TAG = re.compile(r"""<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))*)\s*(?P<self>/?)>|<!DOCTYPE[^<>]*>""", re.I)
_TAG_NEEDS = re.compile(r"<[A-Za-z/!]")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
#: Templates whose last value is text to be read; others are notes to the editors.
_SHOWN = frozenset("lang small quote big nowrap abbr em strong blockquote cquote sc smaller larger".split())
_WIKILINK = re.compile(r"!?\[\[([^\[\]|\n]*)(?:\|([^\[\]\n]*))?\]\]")
_MEDIA = re.compile(r"\s*(?:file|image|datei|fichier|archivo)\s*:", re.I)
_FILED = re.compile(r"\s*(?:category|kategorie|catégorie|categoría)\s*:", re.I)
_MDLINK = re.compile(r"(!?)\[([^\[\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)")
_EXTERNAL = re.compile(r"\[(?:https?|ftp|mailto)://?[^\s\]]+(?:[ \t]+([^\]\n]*))?\]")
_AUTOLINK = re.compile(r"<((?:https?|ftp)://[^\s<>]+)>")
_FOOTNOTE = re.compile(r"\[\^[^\]\s]{1,40}\]:?[ \t]?")
_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?![\s*)])([^*\n]+?)(?<![\s*(])\1(?![\w*])")
_SCORES = re.compile(r"(?<![\w_\\])(_{1,3})(?![\s_])([^_\n]+?)(?<![\s_])\1(?![\w_])")
_STRIKE = re.compile(r"(?<![~\w])~~(?![\s~])([^~\n]+?)(?<![\s~])~~(?!~)")
_MARKED = re.compile(r"(?<![=\w])==(?![\s=])([^=\n]+?)(?<![\s=])==(?![=\w])")
_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?!')(.+?)(?<!')\1(?!')")
_MAGIC = re.compile(r"__(?:[A-Z]{3,})__")
_HREF = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
_UNSEEN = re.compile(r"~?\\(?:footnote|cite[a-z]*|ref|eqref|pageref|label|index|nocite|bibliography|vspace|hspace)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}")
_WRAPPED = re.compile(r"\\(?:textbf|textit|textsc|textsf|textrm|texttt|textsl|emph|underline|mbox|text|enquote|uline|url|title|author|date)\*?\{([^{}]*)\}")
_SWITCH = re.compile(r"\{\\(?:it|bf|em|tt|sc|rm|sf|sl|itshape|bfseries|ttfamily|small|large|footnotesize)\b\s*([^{}]*)\}")
_SETUP = re.compile(r"\\(?:documentclass|usepackage|begin|end|maketitle|tableofcontents|newpage|noindent|centering|clearpage|bibliographystyle|pagestyle)\b\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*")
_PERCENT = re.compile(r"(?m)^%[^\n]*\n?")
_SECTION = re.compile(r"[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{(.*?)\}[ \t]*")
_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_WIKIHEAD = re.compile(r"(={1,6})[ \t]*([^=].*?|[^=])[ \t]*\1[ \t]*\Z")
_UNDER = re.compile(r" {0,3}(=+|-{2,})[ \t]*\Z")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*\Z")
_ITEM = re.compile(r"([ \t]*)([-+]|\*+|\d{1,9}[.)]|#+)[ \t]+(\[[ xX]\][ \t]+)?(.*)")
_LATEX_ITEM = re.compile(r"[ \t]*\\item\b(?:\[([^\]]*)\])?[ \t]*(.*)")
_ROWLIKE = re.compile(r"[ \t]*\|.*\|[ \t]*\Z")
_RULEROW = re.compile(r"[ \t]*\|?(?:[ \t]*:?-{2,}:?[ \t]*\|)+(?:[ \t]*:?-{2,}:?[ \t]*)?\Z")
_SPACES = re.compile(r"[ \t\n\r\f\v]+")


class Rendered:
    """Blocks of one text and what was found in it.

    blocks: (kind, level, text) with kind heading, item, code, formula, table,
    quote or para; level is a heading's depth, or twice an item's nesting, plus
    one if it is numbered: then its text begins with the number. found: the
    kinds of KINDS present. marked: any markup was there at all.
    """

    __slots__ = ("blocks", "found", "marked")

    def __init__(self):
        self.blocks: list[tuple[str, int, str]] = []
        self.found: set[str] = set()
        self.marked = False


def _grid(rows: list[list[str]]) -> str:
    width = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    return "\n".join(" | ".join(c.ljust(width[i]) for i, c in enumerate(r)).rstrip() for r in rows if r)


def _wiki_rows(src: str) -> list[list[str]]:
    rows: list[list[str]] = [[]]
    for line in src.split("\n")[1:-1]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line[:1] in ("|", "!") and not line.startswith("|+"):
            rows[-1] += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
    return [r for r in rows if r]


def _tex_rows(src: str) -> list[list[str]]:
    src = re.sub(r"\A\s*(?:\[[^\]]*\])?\{[^{}]*\}|\\hline|\\toprule|\\midrule|\\bottomrule", "", src)
    return [[c.strip() for c in r.split("&")] for r in re.split(r"\\\\", src) if r.strip()]


class _Reader:
    def __init__(self, text: str):
        self.out = Rendered()
        self.slots: list[tuple[str, str]] = []
        self.text = text

    def mark(self) -> None:
        self.out.marked = True

    # -- parts set aside

    def _slot(self, kind: str, text: str) -> str:
        self.slots.append((kind, text))
        return f"{_OPEN}{len(self.slots) - 1}{_CLOSE}"

    def _set_aside(self, s: str) -> str:
        """``s`` with every closed part set aside, in one pass. Where an opener fails the next closer of its
        kind is looked up and remembered, so texts full of unclosed openers are read in linear time."""
        parts: list[str] = []
        closers: dict[str, int] = {}  # where the next closer of a kind is, len(s) if there is none
        done = at = 0
        while o := _OPENER.search(s, at):
            kind = o.lastgroup and (o.lastgroup if o.lastgroup in ("comment", "table") else o[o.lastgroup].lower())
            kind = kind[:3] if kind and kind[0] in "`~" else kind
            dead = kind is not None and closers.get(kind, 0) == len(s)
            m = (_ASIDE_UNCLOSED if dead else _ASIDE).match(s, o.start())
            if kind and not dead and (m is None or m.lastgroup == "lone") and closers.get(kind, 0) < o.end():
                closer = _closer(kind).search(s, o.end())
                closers[kind] = closer.start() if closer else len(s)
            if m is None:
                at = o.end()
                continue
            parts += [s[done : m.start()], self._unclosed(m) if dead else self._aside(m)]
            done = at = m.end()
        return "".join(parts) + s[done:] if done else s

    def _unclosed(self, m: re.Match) -> str:
        """A fence without an end or an element closed in itself: marks, but nothing in them."""
        self.mark()
        return "\n" if m["lone"] is not None else ""

    def _aside(self, m: re.Match) -> str:
        kind = m.lastgroup
        g = m.group
        if g("fence") is not None:
            self.mark()
            return self._slot(CODE, g("body").rstrip("\n")) + "\n"
        if g("lone") is not None:
            self.mark()
            return "\n"
        if g("comment") is not None:
            self.mark()
            return ""
        if g("raw") is not None:
            self.mark()
            name, inner = g("raw").lower(), g("inner") or ""
            if name in ("script", "style"):
                return ""
            if name == "nowiki":
                return self._slot("text", inner)
            if name == "math":
                return self._slot(FORMULA, unescape(_TAG.sub("", inner)).strip())
            if g("inner") is None:
                return ""
            return "\n" + self._slot(CODE, unescape(_TAG.sub("", inner)).strip("\n")) + "\n"
        if g("env") is not None:
            self.mark()
            env = g("env").rstrip("*").lower()
            if env == "tabular":
                return "\n" + self._slot("table", _grid(_tex_rows(g("content")))) + "\n"
            kind = CODE if env in ("verbatim", "lstlisting", "minted") else FORMULA
            return "\n" + self._slot(kind, g("content").strip("\n")) + "\n"
        if g("table") is not None:
            self.mark()
            return self._slot("table", _grid(_wiki_rows(g("table"))))
        if g("quote") is not None:
            self.mark()
            return f"\u201c{g('quote')}\u201d"
        if g("span") is not None:
            self.mark()
            return self._slot("text", g("span"))
        if g("dollar") is not None:
            if not _MATH_SIGN.search(g("dollar")):
                return m[0]
            self.mark()
            return self._slot(FORMULA, g("dollar"))
        self.mark()
        return self._slot(FORMULA, next(x for x in (g("display"), g("bracket"), g("paren"), kind) if x is not None).strip())

    # -- inline marks

    def _sub(self, pattern: re.Pattern, to, s: str) -> str:
        s, n = pattern.subn(to, s)
        if n:
            self.out.marked = True
        return s

    def _entity(self, m: re.Match) -> str:
        if m[0][1] != "#" and m[0][1:] not in html5:
            return m[0]
        self.mark()
        return unescape(m[0])

    @staticmethod
    def _template(m: re.Match) -> str:
        name, *args = m[1].split("|")
        return args[-1].split("=", 1)[-1] if args and name.strip().lower() in _SHOWN else ""

    @staticmethod
    def _wikilink(m: re.Match) -> str:
        target, alias = m[1], m[2]
        if _FILED.match(target):
            return ""
        if _MEDIA.match(target):
            return (alias or "").rpartition("|")[2]
        return alias.rpartition("|")[2] if alias is not None else target

    def _inline(self, s: str) -> str:
        if "{{" in s:
            for _ in range(6):
                t = self._sub(_TEMPLATE, self._template, s)
                if t == s:
                    break
                s = t
        if "[" in s:
            if "[[" in s:
                s = self._sub(_WIKILINK, self._wikilink, s)
            if "](" in s:
                s = self._sub(_MDLINK, r"\2", s)
            if "[^" in s:
                s = self._sub(_FOOTNOTE, "", s)
            if "://" in s:
                s = self._sub(_EXTERNAL, lambda m: m[1] or "", s)
        if "\\" in s:
            if "\\href" in s:
                s = self._sub(_HREF, r"\1", s)
            for _ in range(3):
                t = self._sub(_WRAPPED, r"\1", self._sub(_SWITCH, r"\1", self._sub(_UNSEEN, "", s)))
                if t == s:
                    break
                s = t
            s = self._sub(_SETUP, "\n", s)
        if "%" in s:
            s = self._sub(_PERCENT, "", s)
        if "''" in s:
            s = self._sub(_QUOTES, r"\2", s)
        if "*" in s:
            s = self._sub(_STARS, r"\2", s)
        if "_" in s:
            if "__" in s:
                s = self._sub(_MAGIC, "", s)
            s = self._sub(_SCORES, r"\2", s)
        if "~~" in s:
            s = self._sub(_STRIKE, r"\1", s)
        if "==" in s:
            lines = s.split("\n")
            s = "\n".join(x if "==" not in x or _WIKIHEAD.match(x) else self._sub(_MARKED, r"\1", x) for x in lines)
        return s

    # -- HTML

    def _html(self, s: str) -> None:
        stack: list[str] = []
        numbers: list[int] = []  # the last number of each open list
        flow: list[str] = []
        block: list = []  # [element, kind, level, parts] of the open block
        cells: list[list[str]] = []
        hidden = 0
        out = self.out.blocks

        def close() -> None:
            nonlocal block
            if flow:
                self._lines("".join(flow))
                flow.clear()
            if block:
                text = _SPACES.sub(" ", "".join(block[3])).strip()
                if block[1] == "cell":
                    (cells[-1] if cells else cells.append([]) or cells[-1]).append(self._fill(text))
                elif text or block[1] == "item":
                    self._put(block[1], block[2], text)
                block = []

        def end_table() -> None:
            close()
            if cells:
                out.append(("table", 0, _grid(cells)))
                cells.clear()

        at = 0
        for m in _TAG.finditer(s):
            name = (m["name"] or "!doctype").lower()
            if name != "!doctype" and name not in _KNOWN:
                continue
            self.mark()
            if text := s[at : m.start()]:
                if hidden:
                    pass
                elif block:
                    if block[0] == "p" and (gap := re.search(r"\n[ \t]*\n", text)):
                        block[3].append(text[: gap.start()])
                        close()
                        flow.append(text[gap.end() :])
                    else:
                        block[3].append(text)
                else:
                    flow.append(text)
            at = m.end()
            if name == "!doctype" or name in _INLINE:
                continue
            if name in _VOID:
                if not hidden and name == "br":
                    (block[3] if block else flow).append(" " if block else "\n" if s[at : at + 1] != "\n" else "")
                elif name == "img" and not hidden:
                    alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", m["attrs"] or "")
                    (block[3] if block else flow).append(f" {alt[1]} " if alt else " ")
                elif name == "hr":
                    close()
                continue
            if m["end"]:
                if name in _HIDDEN:
                    hidden = max(0, hidden - 1)
                elif name in _BLOCKS:
                    if block and (block[0] == name or name in ("div", "blockquote", "li", "td", "th", "section", "article")):
                        close()
                elif name in ("table",):
                    end_table()
                elif name in ("html", "body"):
                    close()
                if name in ("ul", "ol"):
                    close()
                    if name in stack:
                        while numbers.pop() is not None and stack.pop() != name:
                            pass
                continue
            if name in _HIDDEN:
                if not m["self"]:
                    hidden += 1
                continue
            if name in _FRAMES:
                close()
                if name in ("ul", "ol"):
                    stack.append(name)
                    start = re.search(r"\bstart\s*=\s*[\"']?(\d{1,9})", m["attrs"] or "")
                    numbers.append(int(start[1]) - 1 if start else 0)
                elif name == "table":
                    end_table()
                elif name == "tr":
                    cells.append([])
                continue
            hidden = 0 if name != "p" else hidden
            close()  # a new block ends the open one: implied end tags
            if name[0] == "h" and name[1:].isdigit():
                self.out.found.add(HEADING)
                block = [name, "heading", int(name[1]), []]
            elif name == "li":
                self.out.found.add(LIST)
                ordered = bool(stack) and stack[-1] == "ol"
                if ordered:
                    numbers[-1] += 1
                block = [name, "item", (max(1, len(stack)) - 1) * 2 + ordered, [f"{numbers[-1]}. "] if ordered else []]
            elif name in ("td", "th"):
                block = [name, "cell", 0, []]
            else:
                block = [name, "quote" if name == "blockquote" else "para", 0, []]
        rest = s[at:]
        if block and not hidden:
            gap = re.search(r"\n[ \t]*\n", rest)
            block[3].append(rest[: gap.start()] if gap else rest)
            rest = rest[gap.end() :] if gap else ""
            close()
        if not hidden and rest:
            flow.append(rest)
        close()
        end_table()

    # -- lines outside HTML blocks

    def _fill(self, text: str) -> str:
        def back(m: re.Match) -> str:
            kind, body = self.slots[int(m[1])]
            if kind == FORMULA:
                self.out.found.add(FORMULA)
                return f"${body}$"
            if kind == CODE:
                self.out.found.add(CODE)
                return f"\n```\n{body}\n```\n"
            return body

        return _SLOT.sub(back, text) if _OPEN in text else text

    def _put(self, kind: str, level: int, text: str) -> None:
        self.out.blocks.append((kind, level, self._fill(text)))

    def _lines(self, s: str) -> None:
        lines = s.split("\n")
        n = len(lines)
        para: list[str] = []
        found, put = self.out.found, self._put
        in_list = False

        def flush() -> None:
            if para:
                put("para", 0, " ".join(x.strip() for x in para))
                para.clear()

        i = 0
        while i < n:
            line = lines[i]
            i += 1
            body = line.strip()
            if not body:
                flush()
                continue
            c = body[0]
            if c.isalpha() and line[0] == c:
                if para or i >= n or lines[i][:1] not in ("=", "-", " "):
                    if in_list and not para and self.out.blocks and self.out.blocks[-1][0] == "item" and i > 1 and lines[i - 2].strip():
                        kind, level, text = self.out.blocks.pop()
                        self.out.blocks.append((kind, level, f"{text} {self._fill(body)}"))
                        continue
                    if not para:
                        in_list = False
                    para.append(line)
                    if i < n and lines[i][:1] in ("=", "-") and _UNDER.match(lines[i]):
                        self.mark()
                        found.add(HEADING)
                        level = 1 if lines[i].lstrip()[0] == "=" else 2
                        put("heading", level, " ".join(x.strip() for x in para))
                        para.clear()
                        i += 1
                    continue
            if slot := _SLOT_LINE.fullmatch(line):
                kind, text = self.slots[int(slot[1])]
                if kind != "text":
                    flush()
                    if c == ":":
                        self.mark()
                    if kind in KINDS:
                        found.add(kind)
                    self.out.blocks.append((kind, 0, text))
                    in_list = False
                    continue
            if (line.startswith("    ") or line[0] == "\t") and not para and not in_list:
                take = [line]
                while i < n and (lines[i].startswith("    ") or lines[i][:1] == "\t" or (not lines[i].strip() and i + 1 < n and lines[i + 1].startswith("    "))):
                    take.append(lines[i])
                    i += 1
                self.mark()
                found.add(CODE)
                self.out.blocks.append(("code", 0, "\n".join(self._fill(x[4:] if x.startswith("    ") else x.lstrip("\t")) for x in take)))
                continue
            if c == "#":
                run = i
                while run < n and lines[run].startswith("# "):
                    run += 1
                if line.startswith("# ") and run > i:
                    flush()
                    self.mark()
                    found.add(LIST)
                    for number, x in enumerate(lines[i - 1 : run], 1):
                        put("item", 1, f"{number}. {x[2:].strip()}")
                    i = run
                    in_list = True
                    continue
                if head := _ATX.match(line):
                    flush()
                    self.mark()
                    found.add(HEADING)
                    put("heading", len(head[1]), head[2] or "")
                    in_list = False
                    continue
            if c == "=" and (head := _WIKIHEAD.match(body)):
                flush()
                self.mark()
                found.add(HEADING)
                put("heading", len(head[1]), head[2])
                in_list = False
                continue
            if c == "\\":
                if head := _SECTION.match(line):
                    flush()
                    self.mark()
                    found.add(HEADING)
                    put("heading", _LEVEL[head[1]], head[2])
                    if rest := line[head.end() :].strip():
                        para.append(rest)
                    in_list = False
                    continue
                if item := _LATEX_ITEM.match(line):
                    flush()
                    self.mark()
                    found.add(LIST)
                    put("item", 0, item[2])
                    in_list = True
                    continue
            if para and _UNDER.match(line) and len(body) > 1:
                self.mark()
                found.add(HEADING)
                put("heading", 1 if c == "=" else 2, " ".join(x.strip() for x in para))
                para.clear()
                continue
            if c in "-*_" and _RULE.match(line):
                flush()
                self.mark()
                in_list = False
                continue
            if c in "-+*0123456789" and (item := _ITEM.match(line)) and not (c.isdigit() and para and item[2][:-1] != "1"):
                flush()
                self.mark()
                found.add(LIST)
                indent = len(item[1].expandtabs(4)) // 2 + (len(item[2]) - 1 if c == "*" else 0)
                put("item", indent * 2 + c.isdigit(), (item[2][:-1] + ". " if c.isdigit() else "") + (item[3] or "") + item[4])
                in_list = True
                continue
            if c == ">":
                flush()
                self.mark()
                take = [body]
                while i < n and lines[i].lstrip().startswith(">"):
                    take.append(lines[i].strip())
                    i += 1
                put("quote", 0, " ".join(x.lstrip("> ") for x in take))
                in_list = False
                continue
            if c == "|" and _ROWLIKE.match(line) and ((i < n and _ROWLIKE.match(lines[i])) or _RULEROW.match(line)):
                flush()
                self.mark()
                take = [line]
                while i < n and _ROWLIKE.match(lines[i]):
                    take.append(lines[i])
                    i += 1
                rows = [[self._fill(x.strip()) for x in r.strip().strip("|").split("|")] for r in take if not _RULEROW.match(r)]
                put("table", 0, _grid(rows))
                in_list = False
                continue
            if c == ":" and not para and len(body) > 1:
                self.mark()
                body = line = body.lstrip(": ")
            if c == ";" and not para and len(body) > 2 and body[1] == " ":
                self.mark()
                body = line = body[2:]
            if not para:
                in_list = False
            para.append(line)
        flush()

    def run(self) -> Rendered:
        s = self.text
        if "\r" in s:
            s = s.replace("\r\n", "\n").replace("\r", "\n")
        s = _PRIVATE.sub("", s)
        if s.startswith(("---", "\ufeff---")) and (front := _FRONT.match(s)) and ":" in front[0]:
            self.mark()
            s = s[front.end() :]
        if _ASIDE_NEEDS.search(s):
            s = self._set_aside(s)
        if "<" in s and "://" in s:
            s = self._sub(_AUTOLINK, r"\1", s)
        s = self._inline(s)
        if "<" in s and _TAG_NEEDS.search(s):
            if "&" in s:
                s = re.sub(r"&lt;", "\ue002", s)
                if "\ue002" in s:
                    self.mark()
            s = s if "&" not in s else _ENTITY.sub(self._entity, s)
            self._html(s)
            if "\ue002" in s:
                self.out.blocks = [(k, n, t.replace("\ue002", "<")) for k, n, t in self.out.blocks]
        else:
            if "&" in s:
                s = _ENTITY.sub(self._entity, s)
            self._lines(s)
        if "\\" in s and self.out.marked:
            self.out.blocks = [b if b[0] in ("code", "formula") else (b[0], b[1], re.sub(r"\\([%&_#$*`\[\]])", r"\1", b[2])) for b in self.out.blocks]
        return self.out


def parse(text: str | None) -> Rendered:
    """Blocks and kinds of one text; None and '' give no blocks."""
    return _Reader(text or "").run()


def written(r: Rendered) -> str:
    """The blocks as clean text, a blank line between blocks but not between items."""
    parts: list[str] = []
    before = ""
    for kind, level, text in r.blocks:
        if kind == "heading":
            line = f"{'#' * max(1, level)} {text}"
        elif kind == "item":
            line = "  " * (level // 2) + (text if level % 2 else f"- {text}")
        elif kind == "code":
            line = f"```\n{text}\n```"
        elif kind == "formula":
            line = f"$$\n{text}\n$$"
        elif kind == "quote":
            line = f"> {text}"
        else:
            line = text
        if parts:
            parts.append("\n" if kind == before == "item" else "\n\n")
        parts.append(line)
        before = kind
    return "".join(parts)


def clean_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, marked, kinds, clean): every document as clean text.

    Texts are read whole. marked says whether any markup was found, kinds
    lists those of heading, list, code and formula. A NULL text gives clean
    NULL and marked false, an empty one ''. Rows are independent: one pass,
    no shuffle. Extra columns of the input are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, marked boolean, kinds array<string>, clean string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, kinds, clean = [], [], []
            for t in batch.column(1).to_pylist():
                r = parse(t)
                marked.append(r.marked)
                kinds.append(sorted(r.found))
                clean.append(None if t is None else written(r))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marked, pa.bool_()), pa.array(kinds, pa.list_(pa.string())), pa.array(clean, pa.string())], [key, "marked", "kinds", "clean"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def markup_kinds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind): 'any' for each marked document, and one row per kind in it. Texts are parsed, not written out."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, kinds = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                r = parse(t)
                if r.marked:
                    found = ["any", *sorted(r.found)]
                    take += [i] * len(found)
                    kinds += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(kinds, pa.string())], [key, "kind"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {key_type}, kind string").distinct()
