"""Scalar text and path functions, as column expressions where Spark can say them.

Paths use '/', are relative to the vault and keep '' for the vault itself.
Case folding and blanks are ASCII throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed limits: bytes of a path, of a typed prefix or heading, of a title; files read; aliases kept.
MAX_PATH, MAX_PREFIX, MAX_TITLE, MAX_FILE, MAX_ALIASES = 1024, 512, 256, 4 * 1024 * 1024, 32
#: Extensions of notes and of media files.
NOTE_EXTENSIONS = ("md", "markdown")
MEDIA_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "bmp", "avif")
_HEX = re.compile(rb"%([0-9A-Fa-f]{2})")


def arrow_map(f: Callable, kind: str = "string") -> Callable[[Column], Column]:
    """A Python function of one value as an Arrow column function."""
    to = {"string": pa.string(), "int": pa.int32()}[kind]

    def run(values):
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], to)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def fold(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, UPPER, LOWER)


def percent_decode(s: str) -> str:
    """Decode %XX; malformed escapes stay; bytes that are no UTF-8 become U+FFFD."""
    if "%" not in s:
        return s
    return _HEX.sub(lambda m: bytes([int(m[1], 16)]), s.encode()).decode("utf-8", "replace")


def percent_decoded(c: Column) -> Column:
    """``percent_decode`` as a column; only values with a percent sign go to Python."""
    return F.when(c.contains("%"), arrow_map(percent_decode)(F.when(c.contains("%"), c))).otherwise(c)


def encode_path(s: str) -> str:
    """Percent-encode each byte but ASCII letters and digits and / . _ - ~."""
    return "".join(chr(b) if chr(b).isalnum() and b < 128 or b in b"/._-~" else f"%{b:02X}" for b in s.encode())


def encoded_path(c: Column) -> Column:
    needs = c.rlike(r"[^A-Za-z0-9/._~-]")
    return F.when(needs, arrow_map(encode_path)(F.when(needs, c))).otherwise(c)


def base_name(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def without_extension(p: Column) -> Column:
    return F.regexp_replace(p, r"(?i)\.(markdown|md)$", "")


def stem_of(p: Column) -> Column:
    """Base name without a note extension."""
    return without_extension(base_name(p))


def dir_of(p: Column) -> Column:
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise("")


def depth_of(p: Column) -> Column:
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def is_note_file(p: Column) -> Column:
    return p.rlike(r"(?i)\.(md|markdown)$")


def is_media_file(p: Column) -> Column:
    return p.rlike(r"(?i)\.(" + "|".join(MEDIA_EXTENSIONS) + ")$")


def vault_relative(p: Column, root: str) -> Column:
    """``p`` without the root; NULL outside the root and for the root itself."""
    root = root.rstrip("/\\")
    rest = F.regexp_replace(F.substring(p, len(root) + 1, 1_000_000), r"^[/\\]+|[/\\]+$", "")
    inside = p.startswith(root + "/") | p.startswith(root + "\\")
    return F.when(inside & (rest != ""), rest)


def strip_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def normalize(c: Column) -> Column:
    """A link target trimmed of blanks, trailing separators and a note extension."""
    return without_extension(F.regexp_replace(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""), r"[/\\]+$", ""))


def is_path(c: Column) -> Column:
    return c.rlike(r"[/\\]")


def is_relative(c: Column) -> Column:
    return c.rlike(r"^\.{1,2}[/\\]")


def is_note_like(c: Column) -> Column:
    """Can the target name a note? Not empty, no anchor alone, no scheme, no foreign extension."""
    c = F.regexp_replace(c, r"^[ \t]+|[ \t]+$", "")
    base = F.element_at(F.split(strip_fragment(c), r"[/\\]"), -1)
    plain = ~base.contains(".") | base.rlike(r"(?i)^.+\.(md|markdown)$")
    return ~c.contains(":") & (base != "") & plain


def joined_path(base: Column, rest: Column) -> Column:
    """``rest`` seen from the folder ``base``, with '.' and '..' resolved.

    NULL where it climbs out of the vault, has over 64 segments or over
    MAX_PATH bytes, or names nothing.
    """
    parts = F.filter(F.split(F.concat(base, F.lit("/"), rest), r"[/\\]"), lambda x: (x != "") & (x != "."))
    walk = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    out = F.array_join(walk, "/")
    return F.when((F.size(parts) <= 64) & (F.octet_length(out) <= MAX_PATH) & (out != ""), out)


def shared_dirs(a: Column, b: Column) -> Column:
    """How many leading folders two folder paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: (x == y) & (x != ""))
    first = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def relative_path(source_dir: Column, target: Column) -> Column:
    """The way from a folder to a path: '../' for each folder to leave, then down."""
    shared = shared_dirs(source_dir, dir_of(target))
    up = F.when(source_dir == "", 0).otherwise(depth_of(source_dir) + 1) - shared
    down = F.array_join(F.slice(F.split(target, "/"), shared + 1, F.size(F.split(target, "/"))), "/")
    return F.concat(F.repeat(F.lit("../"), up), down)


def heading_anchor(c: Column) -> Column:
    """Anchor of a heading: lower ASCII, letters, digits and non-ASCII kept, the rest one dash between."""
    kept = F.regexp_replace(fold(c), r"[^a-z0-9 \t_\x{80}-\x{10FFFF}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \t_-]+", "-"), "^-|-$", "")


def sanitize_title(c: Column) -> Column:
    """Link text without brackets, 'note' if nothing is left."""
    t = F.regexp_replace(c, r"[\[\]]", "")
    return F.when(t == "", "note").otherwise(F.substring(t, 1, MAX_TITLE))


def format_link(title: Column, path: Column) -> Column:
    return F.concat(F.lit("["), sanitize_title(title), F.lit("]("), encoded_path(path), F.lit(")"))


def format_heading_link(title: Column, heading: Column, path: Column) -> Column:
    text = F.concat(sanitize_title(title), F.lit(" > "), sanitize_title(heading))
    return F.concat(F.lit("["), text, F.lit("]("), encoded_path(path), F.lit("#"), heading_anchor(heading), F.lit(")"))


def shown_title(title: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), stem)


def section_id(text: Column, occurrence: Column) -> Column:
    """A positive id of the n-th section of a text; never 0."""
    return F.greatest(F.xxhash64(text, occurrence).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)), F.lit(1).cast("long"))


def content_item_id(parent: Column, kind: Column, ordinal: Column) -> Column:
    """A positive id of the n-th item of a kind below a parent; never 0."""
    return F.greatest(F.xxhash64(parent, kind, ordinal).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)), F.lit(1).cast("long"))


def size_bucket(size: Column) -> Column:
    """floor(log2(size)) without floating point; NULL below 1."""
    return F.when(size >= 1, F.length(F.bin(size)) - 1)


def bucket_label(bucket: Column) -> Column:
    low, high = F.pow(F.lit(2), bucket).cast("long"), F.pow(F.lit(2), bucket + 1).cast("long") - 1
    return F.when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string")))


def quantise_significant(x: Column, digits: int = 4) -> Column:
    """``x`` to so many significant digits; 0 stays 0."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / step) * step)


def folder_kinship(a: Column, b: Column) -> Column:
    """How related two folders are, 0 to 1."""
    shared = shared_dirs(a, b)
    parent = ((a != "") & (dir_of(b) == a) & (b != "")) | ((b != "") & (dir_of(a) == b) & (a != ""))
    return (
        F.when(a == b, F.when(a == "", 0.22).otherwise(1.0))
        .when(parent, 0.55)
        .when((a == "") | (b == ""), 0.08)
        .when(shared == 0, 0.0)
        .otherwise(F.lit(0.12) + F.lit(0.12) * F.least(shared, F.lit(3)))
    )
