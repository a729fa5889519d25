"""Wiki dumps: pages, titles in one form, redirects, and wiki text as markdown."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions.text import LOWER, UPPER, arrow_map

_ENTITY = re.compile(r"&(?:(lt|gt|amp|quot|apos)|#(\d{1,8})|#[xX]([0-9A-Fa-f]{1,7}));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, text) of the pages of an XML dump; one row per page, split by Spark."""
    schema = "title string, ns string, redirect struct<_title:string>, revision struct<text:string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.select("title", "ns", F.col("redirect._title").alias("redirect"), F.col("revision.text").alias("text"))


def unescape(s: str) -> str:
    """The five XML entities and numeric references; others stay."""

    def back(m: re.Match) -> str:
        if m[1]:
            return _NAMED[m[1]]
        code = int(m[2]) if m[2] else int(m[3], 16)
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _ENTITY.sub(back, s)


def unescaped(c: Column) -> Column:
    return F.when(c.contains("&"), arrow_map(unescape)(F.when(c.contains("&"), c))).otherwise(c)


def canon(title: Column) -> Column:
    """A title with blanks for underscores, runs as one, trimmed, first ASCII letter in upper case."""
    t = F.regexp_replace(F.regexp_replace(title, r"^[ \t\n_]+|[ \t\n_]+$", ""), "[ _]+", " ")
    return F.concat(F.translate(F.substring(t, 1, 1), LOWER, UPPER), F.substring(t, 2, 1_000_000_000))


def safe_stem(title: Column) -> Column:
    """A title as a file name: unsafe characters and controls as '-', no blank or dot at the end."""
    return F.regexp_replace(F.regexp_replace(title, r'[\x00-\x1f<>:"/\\|?*#\[\]]', "-"), "[. ]+$", "")


def is_namespaced(title: Column) -> Column:
    """A leading colon, or a first colon not followed by a blank."""
    return title.rlike("^:|^[^:]+:([^ ]|$)")


def resolve_redirects(pages: DataFrame) -> DataFrame:
    """(page_id, title, leads_to, state): redirects followed one step.

    state is 'article' where the target is a living page, 'redirect' where it
    is itself a redirect, 'red' where no page has that title. Repeated landings
    of a page count once, the latest.
    """
    latest = pages.groupBy("page_id").agg(F.max_by(F.struct("title", "ns", "redirect", "alive"), F.struct("landed_at", "title")).alias("p")).select("page_id", "p.*")
    own = latest.withColumn("key", canon(F.col("title")))
    known = own.filter("alive AND ns = '0'").groupBy("key").agg(F.min((F.coalesce("redirect", F.lit("")) == "").cast("int")).alias("plain"))
    asked = own.filter("redirect IS NOT NULL AND redirect <> ''").withColumn("to", canon(F.substring_index("redirect", "#", 1)))
    j = asked.join(known.withColumnRenamed("key", "to"), "to", "left")
    state = F.when(F.col("plain").isNull(), "red").when(F.col("plain") == 1, "article").otherwise("redirect")
    return j.select("page_id", "title", F.col("to").alias("leads_to"), state.alias("state"))


def wikitext_to_markdown(text: str, target: Callable[[str], str | None]) -> str:
    """Wiki text as markdown: headings, bold and italic, lists and links kept; comments, references,
    templates and tables left out. ``target`` maps a page title to a note name, or None to drop the link."""
    s = re.sub(r"(?s)<!--.*?-->|<ref\b[^<>]*/>|<ref\b.*?</ref>", "", text)
    for open_, close in (("{{", "}}"), ("{|", "|}")):
        out, depth, i = [], 0, 0
        while i < len(s):
            if s.startswith(open_, i):
                depth += 1
                i += 2
            elif depth and s.startswith(close, i):
                depth -= 1
                i += 2
            else:
                if not depth:
                    out.append(s[i])
                i += 1
        s = "".join(out)

    def link(m: re.Match) -> str:
        name, _, label = m[1].partition("|")
        if re.match(r":|[A-Za-z][\w ]*:[^ ]", name):
            return ""
        to = target(name.split("#")[0])
        shown = (label or name) + m[2]
        return f"[[{to}|{shown}]]" if to and to != shown else f"[[{to}]]" if to else shown

    s = re.sub(r"\[\[([^\[\]]*)\]\]([a-z]*)", link, s)
    s = re.sub(r"\[(?:https?|ftp)://\S+ ([^\]]*)\]", r"\1", s)
    s = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\]", "", s)
    s = re.sub(r"(?m)^([*#]+)[ \t]*", lambda m: "  " * (len(m[1]) - 1) + ("- " if m[1][-1] == "*" else "1. "), s)
    s = re.sub(r"(?m)^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], s)
    s = s.replace("'''", "**").replace("''", "*")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"</?[a-zA-Z][^<>]*>", "", s)).strip() + "\n"


def import_report(pages: DataFrame) -> DataFrame:
    """One row: pages, articles, redirects, namespaced, collisions (stems used twice), bytes."""
    once = pages.groupBy("page_id").agg(F.max_by(F.struct("title", "ns", "redirect", "n_bytes"), F.struct("landed_at", "title")).alias("p")).select("page_id", "p.*")
    to = F.coalesce("redirect", F.lit(""))
    stems = once.filter((F.col("ns") == "0") & (to == "")).groupBy(safe_stem(canon(F.col("title"))).alias("stem")).agg((F.count(F.lit(1)) - 1).alias("extra"))
    collide = stems.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("collisions"))
    agg = once.agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(((F.col("ns") == "0") & (to == "")).cast("long")).alias("articles"),
        F.sum((to != "").cast("long")).alias("redirects"),
        F.sum(is_namespaced(F.col("title")).cast("long")).alias("namespaced"),
        F.sum("n_bytes").alias("bytes"),
    )
    return agg.withColumn("collisions", collide.scalar())


def write_vault(articles: DataFrame, path: str) -> None:
    """Articles (title, body, position) as markdown files ``stem.md`` of a folder; of one stem the first position wins.

    The folder has to be one every executor can write to. A file is written
    beside its place and moved there, so a task that runs again changes
    nothing and no reader sees half a file. Repeated positions go by title.
    """
    os.makedirs(path, exist_ok=True)
    first = articles.withColumn("stem", safe_stem(F.col("title"))).filter("stem <> ''").groupBy("stem").agg(F.min_by(F.struct("title", "body"), F.struct("position", "title", "body")).alias("p"))
    rows = first.select("stem", F.concat(F.lit("# "), F.col("p.title"), F.lit("\n\n"), F.coalesce("p.body", F.lit(""))).alias("text"))

    def write(part: Iterator) -> None:
        for stem, text in part:
            whole = os.path.join(path, f"{stem}.md")
            half = f"{whole}.{os.getpid()}.part"
            with open(half, "w", encoding="utf-8", newline="") as f:
                f.write(text)
            os.replace(half, whole)

    rows.foreachPartition(write)
