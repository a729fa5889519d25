"""Readings of note texts as tables: excerpts, contexts, carets, converted links.

The functions of ``parse`` on one text, run in Arrow batches over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.text import arrow_map
from noteweave.operators import parse


def clipped(c: Column, most: int) -> Column:
    """The first line of a text in at most ``most`` bytes."""
    return arrow_map(lambda s: parse.clip(s, most))(c)


def plain(c: Column) -> Column:
    """In-line markdown as the text a reader sees."""
    return arrow_map(parse.plain_inline)(c)


def wiki_markdown(c: Column, target: Callable[[str], str | None]) -> Column:
    """Wiki text as markdown; ``target`` maps a page title to a note name or None."""
    from noteweave.sources.mediawiki import wikitext_to_markdown

    return arrow_map(lambda s: wikitext_to_markdown(s, target))(c)


def _mapped(df: DataFrame, f: Callable[..., list[tuple]], schema: str, keep: int) -> DataFrame:
    """``f`` of the columns after the first ``keep`` gives the rows of each row, set beside those first columns."""
    names = [p.strip().split(" ")[0].strip("`") for p in schema.split(",")][keep:]
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[p.strip().split(" ")[1]] for p in schema.split(",")[keep:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[keep:]), strict=True)):
                found = f(*values)
                take += [i] * len(found)
                rows += found
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:keep]), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [*batch.schema.names[:keep], *names])

    return df.mapInArrow(run, schema)


def excerpts(notes: DataFrame, lines: DataFrame, most: int = 160) -> DataFrame:
    """(note_key, line, excerpt): a short reading of the block at each asked line; none where nothing is to be read.

    notes is (note_key, text), lines (note_key, line). The lines of a note are
    asked together, so its text travels once.
    """
    asked = lines.select("note_key", "line").distinct().groupBy("note_key").agg(F.sort_array(F.collect_list("line")).alias("lines"))  # of one note
    rows = notes.select("note_key", "text").join(asked, "note_key")
    return _mapped(rows, lambda text, at: [(i, e) for i in at if (e := parse.excerpt(text or "", i, most)) is not None], "note_key string, line int, excerpt string", 1)


def contexts(mentions: DataFrame) -> DataFrame:
    """mentions (note_key, ord, context) as (note_key, ord, shown, spans): link syntax collapsed, the
    bytes of each link's text as 'from-to', joined by commas."""

    def read(line: str | None) -> list[tuple]:
        text, spans = parse.context(line or "")
        return [(text, ",".join(f"{a}-{b}" for a, b in spans))]

    return _mapped(mentions.select("note_key", "ord", "context"), read, "note_key string, ord int, shown string, spans string", 2)


def carets(rows: DataFrame) -> DataFrame:
    """rows (id, text, at) as (id, prefix, heading, embed, start, stop): the open link a caret stands in; no row for none."""

    def read(text: str | None, at: int | None) -> list[tuple]:
        found = None if text is None or at is None else parse.caret_context(text, at)
        return [] if found is None else [found]

    return _mapped(rows.select(F.col("id").cast("string").alias("id"), "text", F.col("at").cast("int").alias("at")), read, "id string, prefix string, heading string, embed boolean, start int, stop int", 1)


def converted(notes: DataFrame, resolved: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(note_key, text): notes in which wiki links became markdown links; notes without a change have no row.

    notes is (note_key, text), the key being the path; resolved (src_key, raw,
    dst_path) names what the links of a note lead to, '' for nothing; media
    (src_key, raw, dst_path) the same for embeds.
    """
    pairs = lambda df, name: df.filter("dst_path <> ''").select(F.col("src_key").alias("note_key"), "raw", "dst_path").distinct().groupBy("note_key").agg(F.map_from_entries(F.collect_list(F.struct("raw", "dst_path"))).alias(name))
    rows = notes.select("note_key", "text").join(pairs(resolved, "links"), "note_key", "left")
    rows = rows.join(pairs(media, "media"), "note_key", "left") if media is not None else rows.withColumn("media", F.lit(None).cast("map<string,string>"))

    def read(key: str, text: str | None, links, embeds) -> list[tuple]:
        links, embeds = dict(links or ()), dict(embeds or ())
        new = parse.convert_wikilinks(text or "", key, links.get, embeds.get)
        return [] if new is None else [(new,)]

    return _mapped(rows.select("note_key", F.col("note_key").alias("key"), "text", "links", "media"), read, "note_key string, text string", 1)
