"""Lookups over an indexed vault: backlinks, completion, headings, media, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.session import beside


def current_notes(notes: DataFrame) -> DataFrame:
    """The latest landing of each living note (ties to the larger title and size)."""
    real = notes.filter("alive AND NOT phantom")
    latest = F.max_by(F.struct("path", "stem", "stem_fold", "title", "size", "mtime"), F.struct("landed_at", "mtime", "title", F.coalesce("size", F.lit(-1).cast("long"))))
    return real.groupBy("note_key").agg(latest.alias("n")).select("note_key", "n.*")


def note_by_path(notes: DataFrame, path: str) -> DataFrame:
    """The meta row of one note: key, shown title, size, mtime; no row if it does not exist."""
    return current_notes(notes.filter(F.col("path") == path)).select("note_key", T.shown_title(F.col("title"), F.col("stem")).alias("title"), "size", "mtime")


def backlinks(resolved: DataFrame) -> DataFrame:
    """(dst_key, src_key, line, col, ord, raw, heading, alias, kind, context): mentions of each real note.

    Order by dst_key, src_key, line, col to read them as a list.
    """
    return resolved.filter("resolved").select("dst_key", "src_key", "line", "col", "ord", "raw", "heading", "alias", "kind", *(c for c in resolved.columns if c == "context"))


def backlink_groups(resolved: DataFrame) -> DataFrame:
    """(dst_key, src_key, n_mentions, first_line): backlinks by source.

    Counted map-side first, so a hub with a tenth of all links is no hot task.
    """
    return backlinks(resolved).groupBy("dst_key", "src_key").agg(F.count(F.lit(1)).alias("n_mentions"), F.min("line").alias("first_line"))


def filter_groups(mentions: DataFrame, titles: DataFrame, query: str) -> DataFrame:
    """The backlink groups of which the path or any mention holds ``query`` in order, case ignored.

    Whole groups are kept; an empty query keeps all. ``titles`` is
    (src_key, title).
    """
    if not query:
        return mentions.select("dst_key", "src_key").distinct()
    pattern = "(?is)" + ".*".join("\\Q" + ch + "\\E" for ch in query)
    rows = mentions.join(titles, "src_key", "left")
    fields = ["src_key", "title", "raw", "alias", *(["context"] if "context" in mentions.columns else [])]
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.col(f).rlike(pattern), F.lit(False))
    return rows.filter(hit).select("dst_key", "src_key").distinct()


def context_lines(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """mentions with ``context``: the trimmed line of the source (texts: src_key, text) they stand on."""
    lines = F.split("text", "\n")
    line = F.when(F.col("line") < F.size(lines), F.element_at(lines, F.col("line") + 1))
    return mentions.join(texts, "src_key", "left").withColumn("context", F.trim(F.regexp_replace(line, "\r$", ""))).drop("text")


def complete(notes: DataFrame, aliases: DataFrame, prefix: str, limit: int) -> DataFrame:
    """(rank, name, note_key, is_alias): names that begin with a prefix, stems before aliases, in folded order.

    The prefix is taken as it is, folded; one of over MAX_PREFIX bytes gives none.
    """
    begins = lambda c: T.fold(F.col(c)).startswith(T.fold(F.lit(prefix)))
    # only notes one of whose names begins so are looked at further
    some = notes.filter(begins("stem")).select("note_key").unionByName(aliases.filter(begins("alias")).select("note_key")).distinct()
    real = current_notes(notes.join(some, "note_key", "left_semi")).select("note_key", F.col("stem").alias("name"), F.lit(False).alias("is_alias"))
    other = aliases.filter(begins("alias")).select("note_key", F.col("alias").alias("name")).distinct().join(real.select("note_key"), "note_key", "left_semi").withColumn("is_alias", F.lit(True))
    names = real.unionByName(other.select("note_key", "name", "is_alias")).withColumn("f", T.fold(F.col("name")))
    fits = F.col("f").startswith(T.fold(F.lit(prefix))) & F.lit(len(prefix.encode()) <= T.MAX_PREFIX)
    top = names.filter(fits).orderBy("is_alias", "f", "name", "note_key").limit(limit)
    rank = F.row_number().over(Window.orderBy("is_alias", "f", "name", "note_key"))  # at most ``limit`` rows
    return top.select(rank.alias("rank"), "name", "note_key", "is_alias")


def complete_headings(headings: DataFrame, note_key: str, part: str, limit: int) -> DataFrame:
    """Headings of one note that contain a text, folded, in document order."""
    own = headings.filter((F.col("note_key") == note_key) & T.fold(F.col("text")).contains(T.fold(F.lit(part))))
    return own.orderBy("line", "ord").limit(limit).select("text", "level", "line")


def complete_media(media: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Media files whose name or stem begins with a prefix, by folded name."""
    name = T.base_name(F.col("path"))
    files = media.select("path", name.alias("name"), T.fold(name).alias("f")).distinct()
    return files.filter(F.col("f").startswith(T.fold(F.lit(prefix)))).orderBy("f", "path").limit(limit).select("name", "path")


def completion_items(rows: DataFrame, source_path: str, cap: int = 64) -> DataFrame:
    """(rank, label, insert, detail): completion rows as links from a source note."""
    way = T.relative_path(T.dir_of(F.lit(source_path)), F.col("note_key"))
    return rows.filter(F.col("rank") <= cap).select("rank", F.col("name").alias("label"), T.format_link(F.col("name"), way).alias("insert"), F.col("note_key").alias("detail"))


def heading_items(rows: DataFrame, title: str, path: str, source_path: str, cap: int = 64) -> DataFrame:
    """(rank, label, insert, detail): headings (text, level, line) of the note at ``path`` as links from a source note.

    Labels are indented by level, detail is the path and the line counted from 1.
    """
    way = T.relative_path(T.dir_of(F.lit(source_path)), F.lit(path))
    rank = F.row_number().over(Window.orderBy("line"))  # at most ``cap`` rows
    top = rows.orderBy("line").limit(cap).withColumn("rank", rank)
    return top.select("rank", F.concat(indent(F.col("level")), "text").alias("label"), T.format_heading_link(F.lit(title), F.col("text"), way).alias("insert"), F.concat(F.lit(path + ":"), (F.col("line") + 1).cast("string")).alias("detail"))


def indent(level: Column) -> Column:
    """Blanks before a heading in a completion list."""
    return F.repeat(F.lit(" "), F.lit(2) * F.least(level - 1, F.lit(5)))


def outbound(resolved: DataFrame) -> DataFrame:
    """(src_key, dst_key): every link, repeats kept."""
    return resolved.select("src_key", "dst_key")


def neighbourhood(edges: DataFrame, node, budget: int) -> DataFrame:
    """(pos, node): a node and its neighbours by weight, at most ``budget`` rows, the node first."""
    ends = edges.filter((F.col("a") == node) | (F.col("b") == node)).select(F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")).alias("node"), "w")
    near = ends.filter(F.col("node") != node).groupBy("node").agg(F.sum("w").alias("w"))
    near = near.orderBy(F.col("w").desc_nulls_last(), "node").limit(max(0, budget - 1))
    pos = F.row_number().over(Window.orderBy(F.col("w").desc_nulls_last(), "node"))  # at most ``budget`` rows
    one = edges.sparkSession.createDataFrame([(0, node)], f"pos int, node {edges.schema['a'].dataType.simpleString()}")
    return one.unionByName(near.select(pos.alias("pos"), "node"))


def progress(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: n_notes, n_links, n_phantoms."""
    n = notes.filter("alive AND NOT phantom").agg(F.count_distinct("note_key").alias("n_notes"))
    r = resolved.agg(F.count_distinct("link_id").alias("n_links"), F.count_distinct(F.when(~F.col("resolved"), F.col("dst_key"))).alias("n_phantoms"))
    return beside(n, r)
