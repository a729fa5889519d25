"""Scalar functions and the plain form of look-alike text."""

import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from noteweave.functions import geometry as G
from noteweave.functions import text as T
from noteweave.functions.lookalike import plain


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


@pytest.mark.parametrize(
    "dirty, want",
    [
        ("\uff26\uff4f\uff4f\uff11", "Foo1"), ("cafe\u0301", "caf\u00e9"), ("a\u200bb\u00adc\ufeff", "abc"), ("a\u00a0b\u3000c\u2009d", "a b c d"), ("a\u2010b\u2011c", "a-b-c"), ("\u212bsen", "\u00c5sen"),
        ("\u041didden", "Hidden"), ("\u0585f", "of"), ("\u043e\u0437\u0435\u0440o", "\u043e\u0437\u0435\u0440\u043e"), ("\u212aelvin", "Kelvin"), ("\u0396ud\u0430", "Zuda"), ("a\tb\u0007", "a b"),
    ],
)
def test_plain(dirty, want):
    assert plain(dirty) == unicodedata.normalize("NFC", want) and plain(plain(dirty)) == plain(dirty)


@pytest.mark.parametrize("ordinary", ["", "abc - d_e", "Σκίτσο", "река", "メモ 笔记", "x² ½ № 7", "a – b", "Œuvre ﬁ", "Việt Łąka ß", "A" * 100_000])
def test_plain_leaves_ordinary_text(ordinary):
    assert plain(ordinary) == ordinary


def test_paths(spark):
    lit = F.lit
    cases = [
        (T.stem_of(lit("a/b/Foo.Bar.MD")), "Foo.Bar"), (T.dir_of(lit("a/b/c.md")), "a/b"), (T.dir_of(lit("c.md")), ""), (T.depth_of(lit("a/b/c.md")), 2),
        (T.joined_path(lit("a/b"), lit("../c/./d")), "a/c/d"), (T.joined_path(lit("a"), lit("../../c")), None), (T.joined_path(lit(""), lit("x\\y")), "x/y"), (T.joined_path(lit("a"), lit("..")), None),
        (T.shared_dirs(lit("a/b/c"), lit("a/b/d")), 2), (T.shared_dirs(lit(""), lit("a")), 0), (T.shared_dirs(lit("a/b"), lit("a/b")), 2),
        (T.relative_path(lit("a/b"), lit("a/c/x.md")), "../c/x.md"), (T.relative_path(lit(""), lit("a/x.md")), "a/x.md"), (T.relative_path(lit("a"), lit("x.md")), "../x.md"),
        (T.vault_relative(lit("/v/a/b.md"), "/v"), "a/b.md"), (T.vault_relative(lit("/v"), "/v"), None), (T.vault_relative(lit("/vx/a"), "/v"), None),
        (T.heading_anchor(lit("Hello,  World_x - Ünï!")), "hello-world-x-Ünï"), (T.sanitize_title(lit("[a] b")), "a b"), (T.sanitize_title(lit("[]")), "note"),
        (T.format_link(lit("A b"), lit("x y.md")), "[A b](x%20y.md)"), (T.fold(lit("CAFÉ")), "cafÉ"), (T.normalize(lit(" a/b.md/ ")), "a/b"), (T.normalize(lit("Foo.markdown")), "Foo"),
        (T.encoded_path(lit("é+a/b~")), "%C3%A9%2Ba/b~"), (T.percent_decoded(lit("a%20b%zz%4")), "a b%zz%4"), (T.size_bucket(lit(1024)), 10), (T.size_bucket(lit(1023)), 9), (T.size_bucket(lit(0)), None),
        (T.quantise_significant(lit(123456.0)), 123500.0), (T.quantise_significant(lit(0.0)), 0.0), (T.shown_title(lit(""), lit("s")), "s"),
        (T.folder_kinship(lit("a"), lit("a")), 1.0), (T.folder_kinship(lit(""), lit("")), 0.22), (T.folder_kinship(lit("a"), lit("a/b")), 0.55), (T.folder_kinship(lit(""), lit("a/b")), 0.08), (T.folder_kinship(lit("a/b"), lit("a/c")), 0.24), (T.folder_kinship(lit("a/b"), lit("c/d")), 0.0),
    ]
    for col, want in cases:
        got = value(spark, col)
        assert got == want or (isinstance(want, float) and math.isclose(got, want)), (got, want)


@pytest.mark.parametrize("target, like", [("Foo", True), ("Foo.md", True), ("a.b/Foo", True), ("Foo.png", False), (".md", False), ("#x", False), ("", False), ("http://x", False), ("Foo#a.b", True), ("a\\b.markdown", True), ("Foo/", False), (" Foo ", True), (" #x", False)])
def test_note_like(spark, target, like):
    from noteweave.operators.parse import note_like

    assert value(spark, T.is_note_like(F.lit(target))) == like == note_like(target)


def test_hilbert_is_a_curve(spark):
    n = 16
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    rows = sorted((r.d, r.x, r.y) for r in cells.withColumn("d", G.hilbert(F.col("x"), F.col("y"), 4)).collect())
    assert [d for d, _, _ in rows] == list(range(n * n))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


def test_hexagons(spark):
    for q in range(-3, 4):
        for r in range(-3, 4):
            x, y = G.hex_to_world(F.lit(q), F.lit(r), 2.0)
            assert tuple(value(spark, G.hex_from_world(x + 0.1, y - 0.1, 2.0))) == (q, r)
    assert value(spark, G.hex_distance(F.lit(0), F.lit(0), F.lit(2), F.lit(-3))) == 3
    assert [value(spark, G.hex_ring(F.lit(i))) for i in (0, 1, 6, 7, 18, 19)] == [0, 1, 1, 2, 2, 3]


def test_segments(spark):
    f = lambda *v: tuple(map(F.lit, v))
    assert value(spark, G.segments_cross(f(0, 0, 2, 2), f(0, 2, 2, 0))) is True
    assert value(spark, G.segments_cross(f(0, 0, 1, 1), f(2, 2, 3, 3))) is False
    c = value(spark, G.clipped(*f(-1.0, 0.5, 3.0, 0.5), (0, 0, 1, 1)))
    assert (c.t0, c.t1) == (0.25, 0.5)
    assert value(spark, G.clipped(*f(-1.0, 5.0, 3.0, 5.0), (0, 0, 1, 1))) is None
