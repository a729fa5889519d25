"""Content graph of notes: items below headings, and links between sections.

All for all notes at once, with windows over one note at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.text import content_item_id, fold, heading_anchor, section_id

_RANK = {"heading": 0, "block": 1, "tag": 2, "embed": 3}


def items(headings: DataFrame, blocks: DataFrame, tags: DataFrame, links: DataFrame) -> DataFrame:
    """(note_key, item, kind, parent, level, text, line, weight, ordinal, id): the items of each note.

    item counts from 1 in reading order (0 is the root), ties on a line go
    heading, block, tag, embed. A heading hangs below the nearest earlier
    heading of smaller level, everything else below the last heading. ordinal
    counts equal kinds below one parent from 0. id stays the same when lines
    move: a heading is known by its folded text and how many of that text
    stand before it, other items by their heading, kind and ordinal.
    """
    h = headings.select("note_key", F.lit("heading").alias("kind"), F.lit(_RANK["heading"]).alias("rank"), "ord", "line", F.least(F.greatest("level", F.lit(1)), F.lit(6)).alias("level"), "text", F.lit(1).alias("weight"))
    b = blocks.select("note_key", "kind", F.lit(_RANK["block"]).alias("rank"), "ord", F.col("line_start").alias("line"), F.lit(0).alias("level"), F.lit("").alias("text"), F.greatest("weight", F.lit(1)).alias("weight"))
    t = tags.select("note_key", F.lit("tag").alias("kind"), F.lit(_RANK["tag"]).alias("rank"), "ord", "line", F.lit(0).alias("level"), F.col("tag").alias("text"), F.lit(1).alias("weight"))
    e = links.filter("kind = 'embed'").select("note_key", F.lit("embed").alias("kind"), F.lit(_RANK["embed"]).alias("rank"), "ord", "line", F.lit(0).alias("level"), F.when(F.col("alias") != "", F.col("alias")).otherwise(F.col("raw")).alias("text"), F.lit(1).alias("weight"))
    every = reduce(DataFrame.unionByName, (h, b, t, e))
    order = Window.partitionBy("note_key").orderBy("line", "rank", "ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("item", F.row_number().over(order))
    # the last heading of each level, kept running; no self-join
    for k in range(1, 7):
        every = every.withColumn(f"__h{k}", F.last(F.when((F.col("kind") == "heading") & (F.col("level") == k), F.col("item")), ignorenulls=True).over(before))
    own = F.when(F.col("kind") == "heading", F.col("level")).otherwise(7)
    above = F.greatest(*[F.when(own > k, F.coalesce(f"__h{k}", F.lit(0))).otherwise(0) for k in range(1, 7)])
    every = every.withColumn("parent", above).drop(*[f"__h{k}" for k in range(1, 7)])
    ordinal = F.row_number().over(Window.partitionBy("note_key", "parent", "kind").orderBy("item")) - 1
    every = every.withColumn("ordinal", ordinal)
    is_heading = F.col("kind") == "heading"
    same = F.row_number().over(Window.partitionBy("note_key", "kind", fold(F.col("text"))).orderBy("item")) - 1
    every = every.withColumn("__s", F.when(is_heading, section_id(fold(F.col("text")), same)))
    section = F.coalesce(F.last("__s", ignorenulls=True).over(Window.partitionBy("note_key").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    every = every.withColumn("id", F.coalesce("__s", content_item_id(section, F.col("kind"), F.col("ordinal"))))
    return every.select("note_key", "item", "kind", "parent", "level", "text", "line", "weight", "ordinal", "id")


def with_roots(items: DataFrame, titles: DataFrame) -> DataFrame:
    """``items`` with a root for each note of titles (note_key, title): item 0, id 0, kind root, no parent."""
    root = titles.select(
        "note_key", F.lit(0).alias("item"), F.lit("root").alias("kind"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("level"), F.col("title").alias("text"),
        F.lit(0).alias("line"), F.lit(1).alias("weight"), F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("id"),
    )
    return root.unionByName(items)


def section_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """(note_key, from_item, to_item): links of a note to its own headings, by text or anchor.

    ``links`` are self-links with a heading. They come from the section that
    holds their line; a section's link to itself is dropped.
    """
    heads = items.filter("kind = 'heading'").select("note_key", "item", "line", fold(F.col("text")).alias("t"), heading_anchor(F.col("text")).alias("a"))
    asked = links.filter("heading <> ''").select("note_key", "ord", "line", fold(F.col("heading")).alias("want"), heading_anchor(F.col("heading")).alias("want_a"))
    # as-of join: the last heading at or before the link's line
    both = asked.select("note_key", "line", F.lit(1).alias("is_link"), "ord", "want", "want_a", F.lit(None).cast("int").alias("item"))
    both = both.unionByName(heads.select("note_key", "line", F.lit(0).alias("is_link"), F.lit(0).alias("ord"), F.lit("").alias("want"), F.lit("").alias("want_a"), "item"))
    last = F.last("item", ignorenulls=True).over(Window.partitionBy("note_key").orderBy("line", "is_link", "ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("from_item", F.coalesce(last, F.lit(0))).filter("is_link = 1")
    h = heads.select(F.col("note_key").alias("n2"), F.col("item").alias("to_item"), "t", "a")
    hit = placed.join(h, (F.col("note_key") == F.col("n2")) & ((F.col("want") == F.col("t")) | (F.col("want_a") == F.col("a"))))
    best = hit.groupBy("note_key", "ord", "from_item").agg(F.min(F.struct((F.col("want") != F.col("t")).alias("by_anchor"), "to_item")).alias("b"))
    return best.select("note_key", "from_item", F.col("b.to_item").alias("to_item")).filter("from_item <> to_item").distinct()


def heading_lines(asked: DataFrame, headings: DataFrame) -> DataFrame:
    """(note_key, heading, line): where a heading stands, by folded text first, then by anchor; 0 if nowhere."""
    h = headings.select(F.col("note_key").alias("n2"), "ord", F.col("line").alias("at"), fold(F.col("text")).alias("t"), heading_anchor(F.col("text")).alias("a"))
    q = asked.select("note_key", "heading").distinct()
    same = (F.col("note_key") == F.col("n2")) & ((fold(F.col("heading")) == F.col("t")) | (heading_anchor(F.col("heading")) == F.col("a"))) & (F.octet_length("heading") <= 512)
    hit = q.join(h, same, "left")
    by_anchor = (fold(F.col("heading")) != F.col("t")).alias("by_anchor")
    best = hit.groupBy("note_key", "heading").agg(F.min(F.when(F.col("at").isNotNull(), F.struct(by_anchor, "ord", "at"))).alias("b"))
    return best.select("note_key", "heading", F.coalesce("b.at", F.lit(0)).alias("line"))
