"""Rendering of marked-up texts."""

import time

import pytest

from noteweave.llm import markup as M


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("# A\n\nx", {"heading"}), ("== A ==\nx", {"heading"}), ("Title\n=====\n", {"heading"}), ("<h2 class='t'>A</h2>", {"heading"}), ("\\section*{A}", {"heading"}),
        ("- a\n- b", {"list"}), ("* a\n** b", {"list"}), ("# a\n# b\n# c", {"list"}), ("1. a\n2. b", {"list"}), ("- [x] a", {"list"}), ("<ul><li>a<li>b</ul>", {"list"}), ("\\begin{itemize}\n  \\item a\n\\end{itemize}", {"list"}),
        ("```py\nx # y\n- z\n```", {"code"}), ("~~~\n# no\n~~~", {"code"}), ("a\n\n    x = 1\n    y\n", {"code"}), ("<pre><code>a &lt; b</code></pre>", {"code"}), ("<syntaxhighlight lang='c'>\n# x\n</syntaxhighlight>", {"code"}), ("\\begin{verbatim}\n- x\n\\end{verbatim}", {"code"}),
        ("where $e = m + 1$ holds", {"formula"}), ("$$\nx^2\n$$", {"formula"}), (":<math>x</math>", {"formula"}), ("\\[ x \\]", {"formula"}), ("<p>\\(x_0\\)</p>", {"formula"}), ("\\begin{equation}x\\end{equation}", {"formula"}),
        ("---\ntitle: x\ntags:\n  - y\n---\ntext", set()), ("<html><head><title>T</title></head><body>x</body></html>", set()), ("a `b` c", set()), ("a [[b]] c", set()), ("a <br> c", set()), ("a &amp; b", set()), ("{{stub}} a", set()), ("**a**", set()), ("a[^1] b", set()), ("''a''", set()), ("a~\\cite{x} b", set()),
    ],
)
def test_marked(text, kinds):
    r = M.parse(text)
    assert r.marked and r.found == kinds


@pytest.mark.parametrize(
    "text",
    [
        "", "plain words.\n\nNext part.", "It cost $5 then and $7 now.", "Growth of x^2, roughly.", "Q&A follows at noon.", "Footnote marks (*) are ours.", "Set max_line_width to 80.", "Keep 50% for later -- maybe.",
        "Rated #1 again [sic].", "Use A/B or A\\B paths.", "Sets {a, b} and {c}.", "About 2 * 3 = 6 boxes.", "If a < b and c > 3 the row stays.", "Pipes | are rare here.", "The C# port lags behind.", "Mail @bot or a@b.test", "Background\n\nText",
    ],
)
def test_plain_prose_stays(text):
    r = M.parse(text)
    assert not r.marked and not r.found
    assert M.written(r).split() == text.split()


def test_rendered():
    text = "<!-- c --><h1>T</h1>\n<p>a <b>b</b> c<br>d &mdash; e<p>f\n<table><tr><th>x</th><th>long</th></tr><tr><td>1</td><td>2</td></tr></table><script>no()</script>\n<ol><li>one</ol>"
    assert M.written(M.parse(text)) == "# T\n\na b c d — e\n\nf\n\nx | long\n1 | 2\n\n1. one"
    assert M.written(M.parse("== H ==\n* a\n** [[b|c]]\n\n{| class='w'\n|-\n! k !! v\n|-\n| 1 || 22\n|}\n{{cn|d}}''x''")) == "## H\n\n- a\n  - c\n\nk | v\n1 | 22\n\nx"
    assert M.written(M.parse("---\ntitle: q\n---\n# H #\n\n- a\n- b\n\n```\n<p>\n```\n\n$$\nx\n$$")) == "# H\n\n- a\n- b\n\n```\n<p>\n```\n\n$$\nx\n$$"
    assert M.written(M.parse("\\section{H}\n\\textbf{a} ``b'' \\emph{\\underline{c}}\n\\begin{tabular}{ll}\na & b \\\\\nc & d\n\\end{tabular}")) == "# H\n\na “b” c\n\na | b\nc | d"


def test_line_ends_and_length():
    assert M.written(M.parse("# a\r\n\r\n- b\r\n")) == "# a\n\n- b"
    long = "word <b>x</b> [[y]] " * 40_000
    assert len(M.written(M.parse(long)).split()) == 120_000
    assert M.parse("```\n" + "a\n" * 20_000).marked


def test_operator(spark):
    docs = spark.createDataFrame([(1, "# a", "x"), (1, "# a", "x"), (2, "b", "x"), (3, None, "x"), (4, "", "x"), (None, "- a", "x")], "doc_id long, text string, kind string")
    rows = {(r.doc_id, r.kind) for r in M.markup_kinds(docs).collect()}
    assert rows == {(1, "any"), (1, "heading"), (None, "any"), (None, "list")}
    clean = {r.doc_id: r.clean for r in M.clean_documents(docs).collect()}
    assert clean == {1: "# a", 2: "b", 3: None, 4: "", None: "- a"}
    assert M.markup_kinds(docs.limit(0)).count() == 0


def test_long_front_matter_is_no_content():
    keys = "".join(f"key{i}: value\n# note {i}\n" for i in range(400))
    r = M.parse(f"---\n{keys}---\nplain words\n")
    assert r.found == set() and M.written(r) == "plain words"


def test_numbers_of_items_are_kept():
    assert M.written(M.parse("3. three\n4) four\n10. ten\n")) == "3. three\n4. four\n10. ten"
    assert M.written(M.parse("<ol start='5'><li>a<li>b</ol><ol><li>c</ol>")) == "5. a\n6. b\n1. c"
    assert M.written(M.parse("# a\n# b\n")) == "1. a\n2. b"


def test_an_opener_that_fails_does_not_hide_a_later_one():
    assert M.parse("```a`b\ntext\n\n```\ncode\n```\n").found == {"code"}
    assert M.parse("<pre <b>x\n<pre>code</pre>").found == {"code"}
    assert M.parse("\\begin{align} x \\end{alig} \\begin{equation} y \\end{equation}").found == {"formula"}


@pytest.mark.parametrize("opener", ["\\begin{align} x ", "```\nx\n", "~~~ a\n", "~~~~ a b\n", "<pre> x ", "<!-- x ", "{|\n", "\\[ x ", "``` a`b\n"])
def test_unclosed_openers_take_linear_time(opener):
    def took(n):
        began = time.perf_counter()
        M.parse(opener * n)
        return time.perf_counter() - began

    took(500)
    assert took(40_000) < 30 * max(took(4_000), 0.004)


def test_kinds_without_writing(spark):
    docs = spark.createDataFrame([(1, "# a\n- b"), (1, "# a\n- b"), (2, "plain"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in M.markup_kinds(docs).collect()) == [(1, "any"), (1, "heading"), (1, "list")]
    assert M.markup_kinds(docs.limit(0)).count() == 0
