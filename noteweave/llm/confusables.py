"""Visually identical text with different characters: confusables skeletons.

The skeleton of a text is what is left if only its looks count: decomposed,
nothing invisible, every character replaced by the prototype it is drawn like,
decomposed again. Two texts look alike exactly if their skeletons are equal.
A text is out of order if its skeleton group holds a plain text that it is not.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.lookalike import PROTOTYPE, not_plain_ascii, plain, plain_col, visible
from noteweave.session import cut

# Further letters that are drawn like Latin letters or digits, and what they look like.
LATIN = "ɑɡıǀƖɩʀꜱᴄᴏᴜᴠᴡᴢƽꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LATIN_AS = "agillirscouvwzsBPDTGKJCZFNLSRVHWXYAElOU"
CHEROKEE = "ᎪᎫᎬᎳᎷᎻᏀᏃᏎᏔᏙᏚᏞᏟᏢᏦᏧᎠᎡᎢᎥᏴᏒ"
CHEROKEE_AS = "AJEWMHGZ4WVSLCPKdDRTiBR"
# Printable ASCII that is drawn like other ASCII: the prototypes are small l, capital O, and r followed by n.
ASCII = "I1|0"
ASCII_AS = "lllO"
MULTI = {"m": "rn", "æ": "ae", "œ": "oe", "Æ": "AE", "Œ": "OE", "ƞ": "n", "ҽ": "e", "٠": ".", "۰": ".", "∕": "/", "⁄": "/", "∶": ":", "։": ":", "׃": ":", "‚": ",", "ʹ": "'", "ʼ": "'", "’": "'", "‘": "'", "′": "'", "`": "'", "´": "'", "−": "-", "–": "-", "ー": "-", "ߺ": "_"}

#: Kinds of compatibility characters that only another font, width or position tells from their plain form.
_FONTS = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>")


def prototypes(more: dict[str, str] | None = None) -> dict[int, str]:
    """Translation of characters to their prototypes, prototypes themselves resolved; ``more`` adds or replaces entries."""
    table = PROTOTYPE | dict(zip(LATIN, LATIN_AS, strict=True)) | dict(zip(CHEROKEE, CHEROKEE_AS, strict=True)) | dict(zip(ASCII, ASCII_AS, strict=True)) | MULTI | (more or {})
    return {ord(c): "".join(table.get(x, x) if x != c else x for x in p) for c, p in table.items()}


def read_confusables(path: str) -> dict[str, str]:
    """The entries of a file in the public confusables format: source ; target ; class, code points in hexadecimal."""
    out: dict[str, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = line.split("#", 1)[0].split(";")
            if len(parts) >= 2:
                source, target = ("".join(chr(int(c, 16)) for c in p.split()) for p in parts[:2])
                if len(source) == 1:
                    out[source] = target
    return out


PROTOTYPES = prototypes()


class _Unfont(dict):
    """Character to its plain font and width, worked out on first use; signs that look different (superscripts, fractions, circles) stay."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        while len(ch) == 1 and (kind := unicodedata.decomposition(ch).split(" "))[0] in _FONTS:
            ch = "".join(chr(int(c, 16)) for c in kind[1:])
        self[code] = ch
        return ch


_UNFONT = _Unfont()


def skeleton(s: str | None, table: dict[int, str] = PROTOTYPES) -> str | None:
    """Decompose, replace each character by its prototype, decompose again. None stays None."""
    if s is None:
        return None
    if not s.isascii() or not s.isprintable():
        s = unicodedata.normalize("NFD", visible(s).translate(_UNFONT))
    s = s.translate(table)
    return s if s.isascii() else unicodedata.normalize("NFD", s)


def _mapped(f):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in values.to_pylist()], pa.string())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def skeleton_col(c: Column, table: dict[int, str] | None = None) -> Column:
    """``skeleton`` as a column; printable ASCII stays in the JVM."""
    full = PROTOTYPES if table is None else table
    single = {chr(k): v for k, v in full.items() if k < 128 and len(v) == 1}
    in_jvm = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in full.items():
        if k < 128 and len(v) != 1:
            in_jvm = F.replace(in_jvm, F.lit(chr(k)), F.lit(v))
    return F.when(not_plain_ascii(c), _mapped(lambda s: skeleton(s, full))(F.when(not_plain_ascii(c), c))).otherwise(in_jvm)


def consistent(rows: DataFrame, value: str, table: dict[int, str] | None = None) -> DataFrame:
    """``rows`` with ``plain`` (the consistent form) and ``skeleton`` added.

    NULL stays NULL, '' stays ''. Values of printable ASCII are their own
    plain form and never leave the JVM. Columns of those names in the input
    are replaced. ``table`` replaces the look-alike table (``prototypes`` of
    ``read_confusables`` for the public one).
    """
    return rows.withColumns({"plain": plain_col(F.col(value)), "skeleton": skeleton_col(F.col(value), table)})


def groups(rows: DataFrame, value: str, table: dict[int, str] | None = None) -> DataFrame:
    """(skeleton, n_rows, n_spellings, plain): look-alike groups with more than one spelling.

    Rows are counted per distinct value before the skeleton is worked out, so
    a value that fills a third of the table costs one row per map task. plain
    is the plain form most rows have, ties to the smallest. NULLs belong to no
    group; an empty table gives none. The skeleton is shown composed.
    """
    values = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v IS NOT NULL")
    forms = consistent(values, "v", table).groupBy("skeleton", "plain").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    best = F.min_by("plain", F.struct(-F.col("n"), F.col("plain")))
    per = forms.groupBy("skeleton").agg(F.sum("n").alias("n_rows"), F.sum("k").alias("n_spellings"), best.alias("plain"))
    composed = F.when(not_plain_ascii(F.col("skeleton")), _mapped(lambda s: s and unicodedata.normalize("NFC", s))(F.when(not_plain_ascii(F.col("skeleton")), F.col("skeleton")))).otherwise(F.col("skeleton"))
    return per.filter("n_spellings > 1").select(composed.alias("skeleton"), "n_rows", "n_spellings", "plain")


def _readings(batches):
    for batch in batches:
        values = batch.column(0).to_pylist()
        forms = [plain(v) for v in values]
        columns = [batch.column(0), *(pa.array(c, pa.string()) for c in ([skeleton(v) for v in values], forms, [skeleton(f) for f in forms]))]
        yield pa.RecordBatch.from_arrays(columns, ["v", "skeleton", "form", "form_skeleton"])


def dirty_values(values: DataFrame) -> DataFrame:
    """(v): the values of ``values(v)`` that stand in a skeleton group beside a plain text that they are not.

    Each value brings the plain text it can be read as into the group of that
    text's skeleton. A value is out of order if its own group holds a plain
    text and the value is none of the group's plain texts. Two plain texts
    with one skeleton (a Latin and a Cyrillic word) leave each other alone.
    """
    read = cut(values.mapInArrow(_readings, "v string, skeleton string, form string, form_skeleton string"))
    of = lambda skeleton, text, is_text: F.struct(F.col(skeleton).alias("skeleton"), F.col(text).alias("v"), F.lit(is_text).alias("is_text"))
    members = read.select(F.explode(F.array(of("skeleton", "v", False), of("form_skeleton", "form", True))).alias("m")).select("m.*")
    members = members.groupBy("skeleton", "v").agg(F.max("is_text").alias("is_text"))
    texts = members.filter("is_text").select("skeleton").distinct()
    return members.filter("NOT is_text").join(texts, "skeleton", "left_semi").select("v")


def dirty_rows(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, row_id): rows whose value is not the plain text it looks like.

    ``tables`` lists (name, rows, id column, value column). Values are grouped
    by skeleton once each, however many rows hold them. Printable ASCII is
    plain by definition and is passed over first; NULL and '' are no case.
    Repeated rows give one row.
    """
    parts = [rows.select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("row_id"), F.col(value).alias("v")).filter(not_plain_ascii(F.col("v"))) for name, rows, key, value in tables]
    every = reduce(DataFrame.unionByName, parts)
    return every.join(dirty_values(every.select("v").distinct()), "v", "left_semi").select("tbl", "row_id").distinct()
