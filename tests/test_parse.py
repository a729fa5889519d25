"""The note scanner, readings of lines, conversion, outline."""

import pytest

from noteweave.operators import outline, parse


def test_front_matter_and_lines():
    n = parse.scan("---\ntitle: 'T'\naliases:\n  - a\n  - \"b\"\nother: x\n---\n# H\r\n")
    assert (n.title, n.aliases, n.headings) == ("T", ["a", "b"], [("H", 1, 7)])
    assert parse.scan("---\ntitle: x\nno end").title == ""
    assert parse.scan("﻿---\nalias: x\n...\n").aliases == ["x"]


def test_headings():
    assert parse.heading("## A b ##") == (2, "A b")
    assert parse.heading("   # x") == (1, "x") and parse.heading("    # x") is None
    assert parse.heading("#x") is None and parse.heading("#") == (1, "") and parse.heading("# a#") == (1, "a#")


def test_links_in_order_with_byte_columns():
    n = parse.scan("é [[A#h|x]] ![[B]] [t](c.md) ![i](p.png) [w](http://x) `[[no]]` \\[[esc]] [[img.png]]")
    assert [(r, h, a, k, c) for r, h, a, k, _, c, _ in n.links] == [("A", "h", "x", "wikilink", 3), ("B", "", "", "embed", 13), ("c.md", "", "t", "markdown", 20)]


def test_fences_hide_everything():
    n = parse.scan("````\n[[a]] #t\n```\n# h\n````\n~~~x\n[[b]]\n")
    assert (n.links, n.tags, n.headings) == ([], [], [])
    assert [b[0] for b in n.blocks] == ["code", "code"]


def test_blocks_and_weights():
    n = parse.scan("a b\nc\n- x\n- y z\n\n> q\n| a | b |\n")
    assert n.blocks == [("paragraph", 0, 1, 3), ("list", 2, 3, 5), ("blockquote", 5, 5, 2), ("table", 6, 6, 5)]


def test_tags():
    assert [t for t, _ in parse.scan("#a/b x#no # no #end/ (#ok) #1").tags] == ["a/b", "ok", "1"]


def test_empty_and_long():
    assert parse.scan("") == parse.Note("", [], [], [], [], [])
    assert len(parse.scan("[[x]] y\n" * 50_000).links) == 50_000


def test_conversion():
    notes, media = {"Foo": "n/Foo.md", "Sp": "a b.md"}.get, {"p.png": "img/p.png"}.get
    text = "[[Foo|f]] [[Sp#h]] ![[p.png]] [[No]] `[[Foo]]`\n```\n[[Foo]]\n```\r\n"
    out = parse.convert_wikilinks(text, "n/x.md", notes, media)
    assert out == "[f](Foo.md) [Sp](<../a b.md#h>) ![p.png](../img/p.png) [[No]] `[[Foo]]`\n```\n[[Foo]]\n```\r\n"
    assert parse.convert_wikilinks(out, "n/x.md", notes, media) is None


@pytest.mark.parametrize("text, want", [("- [x] do *it*", "do it"), ("```py\nx", "py"), ("> > a", "a"), ("|---|\n| a | b |", "a b"), ("", None), ("1. one", "one")])
def test_excerpt(text, want):
    assert parse.excerpt(text, 0) == want


def test_clip_and_context():
    assert parse.clip("hello wörld", 8) == "hello" and parse.clip("añb", 2) == "a" and parse.clip("ab", 2) == "ab"
    assert parse.context("x [[A|b]] [c](d)") == ("x b c", [(2, 3), (4, 5)])
    assert parse.plain_inline("**a** `b` [c](d) [[e|f]] g_h ~~i~~ \\*") == "a b c f g_h i *"


@pytest.mark.parametrize("text, at, want", [("[[ab", 4, ("ab", None, False, 2, 4)), ("![[a#b", 6, ("a", "b", True, 3, 6)), ("[[a]] x", 7, None), ("[[a#^b", 6, None), ("é [[x]] y", 6, ("x", None, False, 5, 6)), ("x", 1, None)])
def test_caret(text, at, want):
    assert parse.caret_context(text, at) == want


def test_outline(spark):
    text = "intro\n# A\n## B\nx\n## C\n### D\n# E\n[[n#c]] ![[e]] #t\n"
    notes = parse.scanned(spark.createDataFrame([("n.md", text), ("z.md", None)], "note_key string, text string"))
    links = parse.child(notes, "links")
    items = outline.items(parse.child(notes, "headings"), parse.child(notes, "blocks"), parse.child(notes, "tags"), links)
    got = {(r.kind, r.text): r.parent for r in items.collect()}
    at = {r.text: r.item for r in items.filter("kind = 'heading'").collect()}
    assert (got["heading", "A"], got["heading", "B"], got["heading", "C"], got["heading", "D"], got["heading", "E"]) == (0, at["A"], at["A"], at["C"], 0)
    assert got["embed", "e"] == got["tag", "t"] == at["E"]
    edges = outline.section_links(items, links).collect()
    assert [(e.from_item, e.to_item) for e in edges] == [(at["E"], at["C"])]


def test_child_rows_made_column_by_column_are_those_of_each_note():
    import pyarrow as pa
    from noteweave.operators import parse

    notes = [parse.scan(t) for t in ("", "# h\n\n- [[a]] ![[b é#c|d]] #t\n", "x", "```\n[[no]]\n```\n[q](n.md)")]
    for name, kind in parse._ROWS.items():
        fields = [f.name for f in kind.value_type]
        for some in (notes, notes[:1], []):
            want = pa.array([[dict(zip(fields, r, strict=True)) for r in getattr(n, name)] for n in some], kind)
            assert parse._lists([getattr(n, name) for n in some], kind).equals(want)
