"""Queries of readings, conversions, lookups by path, upkeep of the index and small geometry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import geometry
from noteweave.functions import text as T
from noteweave.operators import outline, parse, query, reading, resolve
from noteweave.plans.graph_queries import positions
from noteweave.plans.text_queries import _CURRENT, _FOLD, _RESOLVE
from noteweave.session import cut, table
from noteweave.sources import shop
from noteweave.sources.shop import _LINKS, _SHOP
from noteweave.streaming import incremental


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    notes = shop.notes(spark, d)
    return notes, parse.scanned(notes)


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    notes, scanned = _scanned(spark, d)
    return reading.excerpts(notes, parse.child(scanned, "blocks").select("note_key", F.col("line_start").alias("line")))


def clipped_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", reading.clipped(F.col("p_name"), 8).alias("short"))


def mention_contexts(spark: SparkSession, d: str) -> DataFrame:
    notes, scanned = _scanned(spark, d)
    mentions = parse.child(scanned, "links").select(F.col("note_key").alias("src_key"), "ord", "line")
    lines = query.context_lines(mentions, notes.select(F.col("note_key").alias("src_key"), "text"))
    return reading.contexts(lines.select(F.col("src_key").alias("note_key"), "ord", "context"))


def caret_links(spark: SparkSession, d: str) -> DataFrame:
    s = F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))
    forms = [F.concat(F.lit("see [["), s), F.concat(F.lit("one\n![["), s, F.lit("#Led")), F.concat(F.lit("[["), s, F.lit("]] done")), F.concat(F.lit("[["), s, F.lit("#^b"))]
    rows = table(spark, d, "supplier").select(F.posexplode(F.array(*forms)).alias("form", "text"), "s_suppkey")
    return reading.carets(rows.select(F.concat_ws("/", F.col("s_suppkey").cast("string"), F.col("form").cast("string")).alias("id"), "text", F.octet_length("text").alias("at")))


def _shop_resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    notes = cut(shop.notes(spark, d))
    scanned = cut(parse.scanned(notes))
    real = scanned.select("note_key", F.col("note_key").alias("path"), T.stem_of(F.col("note_key")).alias("stem"), F.lit(True).alias("alive"), F.lit(False).alias("phantom"))
    aliases = scanned.select("note_key", F.explode("aliases").alias("alias"))
    links = parse.child(scanned, "links").select(F.col("note_key").alias("src_key"), "ord", "raw", "kind")
    return notes, resolve.resolved_links(links, real, aliases)


def converted_links(spark: SparkSession, d: str) -> DataFrame:
    notes, resolved = _shop_resolved(spark, d)
    return reading.converted(notes, resolved.filter("kind = 'wikilink' AND resolved").select("src_key", "raw", "dst_path"))


def _media(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").filter("raw IS NOT NULL").select(F.col("raw").alias("path")).distinct()
    return links.filter(T.is_media_file(F.col("path")))


def media_names(spark: SparkSession, d: str) -> DataFrame:
    return resolve.media_candidates(_media(spark, d))


def complete_media(spark: SparkSession, d: str) -> DataFrame:
    return query.complete_media(_media(spark, d), "f", 40)


def notes_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Looked up one by one: the first and the last path, and one that does not exist."""
    notes = table(spark, d, "notes")
    row = notes.filter("alive AND NOT phantom").agg(F.min("path"), F.max("path")).first()
    found = [query.note_by_path(notes, p) for p in (row[0], row[1], "no/such.md") if p is not None]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def heading_completion(spark: SparkSession, d: str) -> DataFrame:
    _, scanned = _scanned(spark, d)
    key = "supplier/Supplier-000000001.md"
    rows = query.complete_headings(parse.child(scanned, "headings"), key, "", 64)
    return query.heading_items(rows, "Supplier-000000001", key, "order/1.md")


def segments(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    q = p.select((F.col("node") - 1).alias("node"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = p.join(q, "node").select("node", "x", "y", "x2", "y2")
    box = (-0.1, -0.05, 0.1, 0.08)
    c = geometry.clipped(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"), box)
    crossing = geometry.segments_cross((F.col("x"), F.col("y"), F.col("x2"), F.col("y2")), (F.lit(box[0]), F.lit(box[1]), F.lit(box[2]), F.lit(box[3])))
    return j.select("node", F.round(c["t0"], 6).alias("t0"), F.round(c["t1"], 6).alias("t1"), crossing.alias("crosses"))


def marks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    radius = F.round(geometry.mark_radius(n.cast("double"), n % 3 == 0), 6)
    return spark.range(500).select("id", radius.alias("radius"), F.round(geometry.smoothstep(n / 500.0, 0.2, 0.7), 6).alias("smooth"), geometry.link_budget(n).alias("budget"), F.round(spatial_radius(n), 6).alias("estimated"))


def spatial_radius(n):
    from noteweave.operators.spatial import estimated_radius

    return estimated_radius(n.cast("double"), 1.5)


def wiki_markdown(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "wiki_pages").filter("ns = '0'").select("page_id").distinct()
    number = F.col("page_id").cast("string")
    text = F.concat(F.lit("<!-- c -->== Page "), number, F.lit(" ==\n'''Bold''' and ''thin''<ref>r</ref> {{t|{{u}}}}\n* [[Note "), number, F.lit("|here]]s\n** [[None]]\n# [http://u.example/x label] &\n{| class=x\n|-\n| cell\n|}\nend"))
    return p.select("page_id", reading.wiki_markdown(text, lambda t: f"{t}.md" if t.startswith("Note ") else None).alias("markdown"))


# -- upkeep: the notes landed before a day are stored, all notes are the new state

DAY = "2024-07-01 00:00:00"


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    notes = table(spark, d, "notes")
    return notes.filter(F.col("landed_at") < F.lit(DAY).cast("timestamp_ntz")), notes


def upserted(spark: SparkSession, d: str) -> DataFrame:
    old, new = _stored(spark, d)
    return incremental.upserts(old, new.filter("alive AND NOT phantom")).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("note_key").alias("first"), F.max("note_key").alias("last"))


def relink_plan(spark: SparkSession, d: str) -> DataFrame:
    """Links resolved again in part after rewrites alone give what resolving everything gives."""
    notes = table(spark, d, "notes")
    links = table(spark, d, "links").dropDuplicates(["link_id"])
    aliases = table(spark, d, "aliases")
    again = lambda part: resolve.resolved_links(part, notes, aliases).select("link_id", "src_key", "dst_key")
    before = again(links.withColumn("raw", F.when(F.col("src_key").startswith("daily/"), F.concat("raw", F.lit(" old"))).otherwise(F.col("raw"))))
    changed = notes.filter("note_key LIKE 'daily/%'").select(F.col("note_key").alias("path"), F.lit("rewrote").alias("outcome")).distinct()
    after = incremental.relinked(changed, False, links, again, before)
    return after.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst_key").alias("n_targets"), F.count_distinct("src_key").alias("n_sources"))


def retired_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "notes")
    resolved = resolve.resolved_links(table(spark, d, "links").dropDuplicates(["link_id"]), notes.withColumn("alive", F.lit(True)), table(spark, d, "aliases"))
    living = notes.filter("alive AND NOT phantom").select("note_key").distinct()
    gone = notes.filter("NOT alive AND NOT phantom").select("note_key", "stem").distinct().join(living, "note_key", "left_anti")
    return incremental.retired(gone, resolved)


def purged(spark: SparkSession, d: str) -> DataFrame:
    notes = table(spark, d, "notes")
    ghosts = notes.filter("phantom").select("stem").distinct()
    resolved = resolve.resolved_links(table(spark, d, "links").dropDuplicates(["link_id"]), notes, table(spark, d, "aliases"))
    return incremental.purged(ghosts, resolve.phantoms(resolved))


def replaced_headings(spark: SparkSession, d: str) -> DataFrame:
    """Child rows of rewritten notes replaced, counted by level."""
    notes, scanned = _scanned(spark, d)
    rows = parse.child(scanned, "headings")
    dirty = notes.filter("note_key LIKE 'part/%'").select("note_key", F.concat("text", F.lit("\n## More\n")).alias("text"))
    fresh = parse.child(parse.scanned(dirty), "headings")
    return incremental.replaced(rows, dirty, fresh).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def self_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a note to its own sections: every supplier links to its ledger and back."""
    s = F.replace(F.col("s_name"), F.lit("#"), F.lit("-"))
    text = F.concat(F.lit("# "), s, F.lit("\n\nsee [["), s, F.lit("#ledger]]\n\n## Ledger\n\nback to [["), s, F.lit("#"), s, F.lit("]] and [["), s, F.lit("#Ledger]]\n"))
    scanned = parse.scanned(table(spark, d, "supplier").select(F.concat(F.lit("supplier/"), s, F.lit(".md")).alias("note_key"), text.alias("text")))
    links = parse.child(scanned, "links")
    items = outline.items(parse.child(scanned, "headings"), parse.child(scanned, "blocks"), parse.child(scanned, "tags"), links)
    return outline.section_links(items, links)


QUERIES = {f.__name__: f for f in (
    excerpts, clipped_names, mention_contexts, caret_links, converted_links, media_names, complete_media, notes_by_path, heading_completion, segments, marks, wiki_markdown,
    upserted, relink_plan, retired_notes, purged, replaced_headings, self_links,
)}

_MEDIA = "media AS (SELECT DISTINCT raw AS path, split_part(raw, '/', -1) AS name FROM links WHERE regexp_matches(raw, '\\.(png|jpg|jpeg|gif|webp|svg|bmp|avif)$', 'i'))"
_WAY = "CASE WHEN regexp_matches({0}, '[\\s()<>]') THEN '<' || {0} || '>' ELSE {0} END"
_AFTER = "x2 - x AS dx, y2 - y AS dy"

ORACLE = {
    "excerpts": f"""WITH {_SHOP}
SELECT note_key, 2 AS line, 'sql' AS excerpt FROM r UNION ALL SELECT note_key, 6, 'use [[code]] and [[escaped]] here' FROM r
UNION ALL SELECT note_key, 6, 'in ' || r_name || ' #nation' FROM n UNION ALL SELECT note_key, 2, 'from ' || n_name || ' home' FROM s UNION ALL SELECT note_key, 6, 'balance' FROM s
UNION ALL SELECT note_key, 2, 'see nation and N' || k || ' #' || seg FROM c UNION ALL SELECT note_key, 2, 'needs Missing ' || size || ' #' || brand FROM p
UNION ALL SELECT note_key, 2, 'for ' || buyer FROM o UNION ALL SELECT note_key, 4, seller || ' ' || p_name FROM i WHERE nth = 0""",
    "clipped_names": """WITH c AS (SELECT p_partkey, p_name, left(p_name, 8) AS cut FROM part), b AS (SELECT *, length(cut) - length(regexp_extract(cut, '[^ ]*$')) - 1 AS blank FROM c)
SELECT p_partkey, CASE WHEN length(p_name) <= 8 THEN p_name WHEN blank * 3 >= length(cut) * 2 THEN left(cut, blank) ELSE cut END AS short FROM b""",
    "mention_contexts": f"""WITH {_SHOP}
SELECT note_key, 0 AS ord, 'in ' || r_name || ' #nation' AS shown, '3-' || (3 + length(r_name)) AS spans FROM n
UNION ALL SELECT note_key, 0, 'from home', '5-9' FROM s
UNION ALL SELECT note_key, unnest([0, 1]), 'see nation and N' || k || ' #' || seg, '4-10,15-' || (16 + length(k::VARCHAR)) FROM c
UNION ALL SELECT note_key, 0, 'needs Missing ' || size || ' #' || brand, '6-' || (14 + length(size::VARCHAR)) FROM p
UNION ALL SELECT note_key, 0, 'for ' || buyer, '4-' || (4 + length(buyer)) FROM o
UNION ALL SELECT note_key, unnest([1 + 2 * nth, 2 + 2 * nth]), '- ' || seller || ' ' || p_name, '2-' || (2 + length(seller)) || ',' || (3 + length(seller)) || '-' || (3 + length(seller) + length(p_name)) FROM i""",
    "caret_links": """WITH n AS (SELECT s_suppkey, replace(s_name, '#', '-') AS s FROM supplier)
SELECT s_suppkey || '/0' AS id, s AS prefix, NULL AS heading, false AS embed, 6 AS start, 6 + length(s) AS stop FROM n
UNION ALL SELECT s_suppkey || '/1', s, 'Led', true, 7, 7 + length(s) + 4 FROM n""",
    "converted_links": f"""WITH {_SHOP}, way AS (
  SELECT note_key, '../region/' || r_name || '.md' AS w, '[' || r_name || ']' AS label FROM n UNION ALL SELECT note_key, '../nation/' || n_name || '.md', '[home]' FROM s
  UNION ALL SELECT note_key, '../../nation/' || n_name || '.md', '[N' || k || ']' FROM c),
link AS (SELECT note_key, label || '(' || {_WAY.format("w")} || ')' AS l FROM way)
SELECT note_key, '---' || chr(10) || 'title: Nation ' || k || chr(10) || 'aliases: [N' || k || ']' || chr(10) || '---' || chr(10) || '# ' || n.stem || chr(10) || chr(10) || 'in ' || l || ' #nation' || chr(10) AS text FROM n JOIN link USING (note_key)
UNION ALL SELECT note_key, '# ' || stem || chr(10) || chr(10) || 'from ' || l || chr(10) || chr(10) || '## Ledger' || chr(10) || chr(10) || '- balance' || chr(10) FROM s JOIN link USING (note_key)
UNION ALL SELECT note_key, '# ' || stem || chr(10) || chr(10) || 'see [nation](../../nation/' || n_name || '.md#top) and ' || l || ' #' || seg || chr(10) FROM c JOIN link USING (note_key)
UNION ALL SELECT o.note_key, '# ' || o.stem || chr(10) || chr(10) || 'for [' || buyer || '](../' || c.note_key || ')' || chr(10) || chr(10) ||
  coalesce((SELECT string_agg('- [' || seller || '](../supplier/' || seller || '.md) ![[' || p_name || ']]' || chr(10), '' ORDER BY nth) FROM i WHERE i.note_key = o.note_key), '') FROM o JOIN c ON c.stem = buyer""",
    "media_names": f"WITH {_MEDIA} SELECT path, name FROM media UNION SELECT path, regexp_replace(name, '\\.[^.]*$', '') FROM media",
    "complete_media": f"WITH {_MEDIA} SELECT name, path FROM media WHERE starts_with({_FOLD.format("name")}, 'f') ORDER BY {_FOLD.format('name')}, path LIMIT 40",
    "notes_by_path": f"WITH n AS (SELECT note_key, path, coalesce(nullif(title, ''), stem) AS title, size, mtime FROM {_CURRENT}) SELECT note_key, title, size, mtime FROM n WHERE path IN (SELECT min(path) FROM n UNION SELECT max(path) FROM n)",
    "heading_completion": """SELECT unnest([1, 2]) AS rank, unnest(['Supplier-000000001', '  Ledger']) AS label,
  unnest(['[Supplier-000000001 > Supplier-000000001](../supplier/Supplier-000000001.md#supplier-000000001)', '[Supplier-000000001 > Ledger](../supplier/Supplier-000000001.md#ledger)']) AS "insert",
  unnest(['supplier/Supplier-000000001.md:1', 'supplier/Supplier-000000001.md:5']) AS detail""",
    "segments": """WITH p AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT p.node, p.x, p.y, q.x AS x2, q.y AS y2, q.x - p.x AS dx, q.y - p.y AS dy FROM p JOIN p q ON q.node = p.node + 1),
e AS (SELECT *, unnest([-dx, dx, -dy, dy]) AS pp, unnest([x + 0.1, 0.1 - x, y + 0.05, 0.08 - y]) AS qq FROM s),
t AS (SELECT node, greatest(0.0, max(CASE WHEN pp < 0 THEN qq / pp END)) AS t0, least(1.0, min(CASE WHEN pp > 0 THEN qq / pp END)) AS t1, bool_or(pp = 0 AND qq < 0) AS outside FROM e GROUP BY node),
o AS (SELECT node, dx * (-0.05 - y) - dy * (-0.1 - x) AS d1, dx * (0.08 - y) - dy * (0.1 - x) AS d2, 0.2 * (y + 0.05) - 0.13 * (x + 0.1) AS d3, 0.2 * (y2 + 0.05) - 0.13 * (x2 + 0.1) AS d4 FROM s)
SELECT node, CASE WHEN NOT outside AND t0 <= t1 THEN round(t0, 6) END AS t0, CASE WHEN NOT outside AND t0 <= t1 THEN round(t1, 6) END AS t1, d1 * d2 < 0 AND d3 * d4 < 0 AS crosses FROM t JOIN o USING (node)""",
    "marks": """SELECT i AS id, round(least(40.0, 4.0 + 2.5 * sqrt(i + 1.0)) * CASE WHEN i % 3 = 0 THEN 0.7 ELSE 1 END, 6) AS radius,
  round(t * t * (3 - 2 * t), 6) AS smooth, greatest(200, i * 5 // 2)::INT AS budget, round(1.5 * sqrt(i / pi()), 6) AS estimated
FROM (SELECT i, greatest(0.0, least(1.0, (i / 500.0 - 0.2) / 0.5)) AS t FROM range(500) r(i))""",
    "wiki_markdown": """SELECT DISTINCT page_id, '## Page ' || page_id || chr(10) || '**Bold** and *thin* ' || chr(10) || '- [[Note ' || page_id || '.md|heres]]' || chr(10) || '  - None' || chr(10) || '1. label &' || chr(10) || chr(10) || 'end' || chr(10) AS markdown
FROM wiki_pages WHERE ns = '0'""",
    "upserted": f"""WITH incoming AS (SELECT DISTINCT note_key, path, stem_fold FROM notes WHERE alive AND NOT phantom),
stored AS (SELECT * FROM notes WHERE landed_at < TIMESTAMP '{DAY}'),
said AS (SELECT note_key, CASE WHEN path IN (SELECT path FROM stored WHERE NOT phantom) THEN 'updated' WHEN stem_fold IN (SELECT stem_fold FROM stored WHERE phantom) THEN 'promoted' ELSE 'inserted' END AS action FROM incoming)
SELECT action, count(*) AS n, min(note_key) AS first, max(note_key) AS last FROM said GROUP BY action""",
    "relink_plan": f"WITH {_RESOLVE} SELECT count(*) AS n, count(DISTINCT dst_key) AS n_targets, count(DISTINCT src_key) AS n_sources FROM resolved",
    "retired_notes": f"""WITH {_RESOLVE.replace("FROM notes WHERE alive AND NOT phantom", "FROM notes WHERE NOT phantom")},
dead AS (SELECT DISTINCT note_key, stem FROM notes WHERE NOT alive AND NOT phantom AND note_key NOT IN (SELECT note_key FROM notes WHERE alive AND NOT phantom))
SELECT 'phantom:' || {_FOLD.format("stem")} AS note_key, stem, count(*) AS inbound FROM dead JOIN resolved ON dst_key = dead.note_key WHERE NOT contains(stem, ':') AND NOT contains(stem, '.') AND stem <> '' GROUP BY dead.note_key, stem""",
    "purged": f"""WITH {_RESOLVE}, ghosts AS (SELECT DISTINCT stem FROM notes WHERE phantom)
SELECT stem FROM ghosts WHERE {_FOLD.format("stem")} NOT IN (SELECT {_FOLD.format("ghost")} FROM resolved WHERE NOT resolved) OR contains(stem, ':') OR contains(stem, '.') OR contains(stem, '#') OR stem = ''""",
    "replaced_headings": f"WITH {_SHOP} SELECT 1 AS level, count(*) AS n FROM stems UNION ALL SELECT 2, (SELECT count(*) FROM s) + (SELECT count(*) FROM p)",
    "self_links": """SELECT 'supplier/' || replace(s_name, '#', '-') || '.md' AS note_key, unnest([1, 3]) AS from_item, unnest([3, 1]) AS to_item FROM supplier""",
}
