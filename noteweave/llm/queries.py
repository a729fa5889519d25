"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.llm import canonical, confusables, contamination, cooccurrence, markup, mixing, pii
from noteweave.llm.sql import ORACLE  # noqa: F401
from noteweave.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = canonical.meant_entries(table(spark, d, "typed_links"), "typed_id", "raw", table(spark, d, "hub_titles"), "hub_id", "title", "aliases")
    return found.select("typed_id", F.col("entry").cast("int").alias("hub_id"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return canonical.map_values(table(spark, d, "typed_links"), "raw", table(spark, d, "hub_titles"), "hub_id", "title", "aliases")


def p1_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every title and alias typed as it stands, in capitals and as a link: (name, hub_id)."""
    hubs = table(spark, d, "hub_titles")
    names = hubs.select(F.explode(F.array_union(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("name IS NOT NULL AND trim(name) <> ''").distinct()
    typed = names.select("name", F.explode(F.array("name", F.upper("name"), F.concat(F.lit("[["), "name", F.lit("]]")))).alias("raw"))
    mapped = canonical.map_values(typed, "raw", hubs, "hub_id", "title", "aliases")
    found = typed.join(mapped.select(F.col("value").alias("raw"), "entry"), "raw")
    return found.groupBy("name").agg(F.min("entry").cast("int").alias("hub_id"), F.count("entry").alias("n_found"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.dirty_rows([
        ("links", table(spark, d, "links"), "link_id", "raw"),
        ("wiki_pages", table(spark, d, "wiki_pages"), "page_id", "title"),
        ("notes", table(spark, d, "notes"), "note_id", "title"),
    ])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "links").select(F.col("raw").alias("v"))
    values = values.unionByName(table(spark, d, "wiki_pages").select(F.col("title").alias("v")))
    values = values.unionByName(table(spark, d, "notes").select(F.col("title").alias("v")))
    return confusables.groups(values, "v")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.item_pairs(table(spark, d, "edges"), "a", "b", min_together=8, min_lift=4.0)
    return pairs.select(F.col("item_lo").alias("b_lo"), F.col("item_hi").alias("b_hi"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.item_pairs(table(spark, d, "edges"), "a", "b", min_together=8)
    rounded = [F.round(c, 6).alias(c) for c in ("expected", "lift", "conviction_lo_hi", "conviction_hi_lo")]
    return pairs.select(F.col("item_lo").alias("b_lo"), F.col("item_hi").alias("b_hi"), "n_together", "n_lo", "n_hi", *rounded)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(table(spark, d, "documents"))


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_self(spark: SparkSession, d: str) -> DataFrame:
    """Items that are found in their own text, whole."""
    items = table(spark, d, "eval_items")
    found = contamination.leaks(items.select(F.col("item_id").alias("doc_id"), "text"), items)
    return found.filter("doc_id = item_id").groupBy("item_id").agg(F.max("n_words").alias("n_words"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """By mix: uses beyond the repeats allowed, uses counted twice, sources with documents off by more than is promised:
    half a document of their own, and their share of what half documents of all sources add to the total."""
    weights = table(spark, d, "source_weights")
    chosen = cut(mixing.schedule(table(spark, d, "documents"), weights))
    most = weights.select("mix", "source", "max_repeats").distinct()
    beyond = chosen.join(most, ["mix", "source"]).groupBy("mix").agg(F.sum((F.col("repeat_no") >= F.col("max_repeats")).cast("int")).alias("n_beyond"))
    twice = chosen.groupBy("mix", "doc_id", "repeat_no").agg(F.count(F.lit(1)).alias("k")).groupBy("mix").agg(F.sum((F.col("k") > 1).cast("int")).alias("n_twice"))
    reached = mixing.shares(chosen, weights).filter("n_uses > 0")
    whole = reached.groupBy("mix").agg(F.sum("target_share").alias("there"), F.sum("n_tokens").alias("total"))
    longest = chosen.groupBy("mix", "source").agg(F.max("n_tokens").alias("longest"))
    slack = longest.groupBy("mix").agg((F.sum("longest") / 2).alias("slack"))
    part = F.col("target_share") / F.col("there")
    off = reached.join(whole, "mix").join(longest, ["mix", "source"]).join(slack, "mix").withColumn("want", part * F.col("total"))
    allowed = F.col("longest") / 2 + part * F.col("slack") + 0.01 * F.col("want") + 1
    off = off.groupBy("mix").agg(F.sum((F.abs(F.col("n_tokens") - F.col("want")) > allowed).cast("int")).alias("n_off"))
    return beyond.join(twice, "mix").join(off, "mix")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.schedule(table(spark, d, "documents"), table(spark, d, "source_weights"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "source_weights"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_spans(table(spark, d, "documents")).select("doc_id", "kind", "line_no").distinct()


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p1_titles": p1_titles,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_clean": p5_clean,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_self": p7_self,
    "p8_mix": p8_mix,
    "p8_checks": p8_checks,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}
