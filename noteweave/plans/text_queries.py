"""Queries of the text, parsing, resolution and lookup operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import text as T
from noteweave.operators import outline, parse, query, resolve
from noteweave.session import table
from noteweave.sources import shop


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").dropDuplicates(["link_id"])
    return resolve.resolved_links(links, table(spark, d, "notes"), table(spark, d, "aliases"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    n = query.current_notes(table(spark, d, "notes"))
    p = F.col("path")
    return n.select(
        "note_key",
        T.stem_of(p).alias("stem"),
        T.dir_of(p).alias("dir"),
        T.depth_of(p).alias("depth"),
        T.fold(p).alias("folded"),
        T.heading_anchor(F.col("stem")).alias("anchor"),
        T.shown_title(F.col("title"), F.col("stem")).alias("shown"),
        T.size_bucket(F.col("size")).alias("bucket"),
        T.bucket_label(T.size_bucket(F.col("size"))).alias("bucket_label"),
        T.quantise_significant(F.col("size").cast("double")).alias("rough_size"),
        T.folder_kinship(T.dir_of(p), F.lit("archive/2024")).alias("kinship"),
        T.vault_relative(F.concat(F.lit("/vault/"), p), "/vault").alias("in_vault"),
        T.relative_path(F.lit("archive/2024"), p).alias("from_archive"),
    )


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links").dropDuplicates(["link_id"]).filter("raw IS NOT NULL")
    raw = F.col("raw")
    return links.select(
        "link_id",
        T.is_note_like(raw).alias("note_like"),
        resolve.target_of(raw).alias("target"),
        T.is_path(resolve.target_of(raw)).alias("is_path"),
        T.joined_path(T.dir_of(F.col("src_key")), resolve.target_of(raw)).alias("joined"),
        resolve.phantom_stem(raw).alias("phantom_stem"),
    )


def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    return resolve.candidates(table(spark, d, "notes"), table(spark, d, "aliases"))


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    asked = resolve.asked_targets(table(spark, d, "links")).filter(~T.is_path(F.col("target")))
    found = resolve.resolve_names(asked.select("target", "source_dir").distinct(), resolve.candidates(table(spark, d, "notes"), table(spark, d, "aliases")))
    return found.select("target", "source_dir", "dst_path", "ambiguous", "pass")


def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    asked = resolve.asked_targets(table(spark, d, "links")).filter(T.is_path(F.col("target")))
    found = resolve.resolve_paths(asked.select("target", "source_dir").distinct(), table(spark, d, "notes"))
    return found.select("target", "source_dir", "dst_path", "pass")


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("link_id", "dst_key", "ambiguous", "resolved")


def resolve_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).filter("ambiguous").groupBy("dst_key").agg(F.count(F.lit(1)).alias("n"))


def link_status(spark: SparkSession, d: str) -> DataFrame:
    r = resolve.status(_resolved(spark, d), table(spark, d, "notes"))
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst_key").alias("n_targets"))


def phantoms(spark: SparkSession, d: str) -> DataFrame:
    return resolve.phantoms(_resolved(spark, d))


def note_counts(spark: SparkSession, d: str) -> DataFrame:
    return query.progress(table(spark, d, "notes"), _resolved(spark, d))


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return query.backlinks(_resolved(spark, d)).select("dst_key", "src_key", "line", "col", "ord", "raw", "kind")


def backlink_groups(spark: SparkSession, d: str) -> DataFrame:
    return query.backlink_groups(_resolved(spark, d))


def backlink_filter(spark: SparkSession, d: str) -> DataFrame:
    titles = query.current_notes(table(spark, d, "notes")).select(F.col("note_key").alias("src_key"), "title")
    mentions = query.backlinks(_resolved(spark, d))
    return query.filter_groups(mentions, titles, "ledger")


def complete_notes(spark: SparkSession, d: str) -> DataFrame:
    return query.complete(table(spark, d, "notes"), table(spark, d, "aliases"), "Ba", 64)


def completion_items(spark: SparkSession, d: str) -> DataFrame:
    return query.completion_items(complete_notes(spark, d), "archive/2024/here.md")


def outbound(spark: SparkSession, d: str) -> DataFrame:
    return query.outbound(_resolved(spark, d)).groupBy("src_key").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("dst_key").alias("n_targets"))


def note_edges(spark: SparkSession, d: str) -> DataFrame:
    r = _resolved(spark, d).filter("resolved AND src_key <> dst_key")
    return r.groupBy(F.least("src_key", "dst_key").alias("a"), F.greatest("src_key", "dst_key").alias("b")).agg(F.count(F.lit(1)).alias("n"))


# -- the shop vault: notes written from the relational tables, so that SQL knows what parsing must find


def _shop(spark: SparkSession, d: str) -> DataFrame:
    return parse.scanned(shop.notes(spark, d))


def scan_notes(spark: SparkSession, d: str) -> DataFrame:
    return _shop(spark, d).select("note_key", "title", F.concat_ws("|", "aliases").alias("aliases"))


def scan_headings(spark: SparkSession, d: str) -> DataFrame:
    return parse.child(_shop(spark, d), "headings")


def scan_tags(spark: SparkSession, d: str) -> DataFrame:
    return parse.child(_shop(spark, d), "tags")


def scan_blocks(spark: SparkSession, d: str) -> DataFrame:
    return parse.child(_shop(spark, d), "blocks").groupBy("note_key", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


def scan_links(spark: SparkSession, d: str) -> DataFrame:
    return parse.child(_shop(spark, d), "links").select("note_key", "ord", "raw", "heading", "alias", "kind", "col")


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _shop(spark, d)
    links = parse.child(n, "links")
    return outline.items(parse.child(n, "headings"), parse.child(n, "blocks"), parse.child(n, "tags"), links), links


def outline_items(spark: SparkSession, d: str) -> DataFrame:
    items, _ = _items(spark, d)
    titles = shop.notes(spark, d).select("note_key", T.stem_of(F.col("note_key")).alias("title"))
    titles = titles.withColumn("title", F.when(F.col("note_key").startswith("order/"), F.concat(F.lit("Order "), "title")).otherwise(F.col("title")))
    return outline.with_roots(items, titles).select("note_key", "item", "kind", "parent", "level", "text", "line", "ordinal")


def outline_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids are positive, one for each item of a note, and stay when every line moves down by two."""
    items, _ = _items(spark, d)
    moved = parse.scanned(shop.notes(spark, d).select("note_key", F.when(F.col("text").startswith("---"), F.col("text")).otherwise(F.concat(F.lit("\n\n"), "text")).alias("text")))
    later = outline.items(parse.child(moved, "headings"), parse.child(moved, "blocks"), parse.child(moved, "tags"), parse.child(moved, "links"))
    both = items.select("note_key", "item", "id").join(later.select("note_key", "item", F.col("id").alias("id2")), ["note_key", "item"], "full")
    return both.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("note_key", "id").alias("n_ids"), F.sum((F.col("id") <= 0).cast("int")).alias("n_not_positive"), F.sum((~F.col("id").eqNullSafe(F.col("id2"))).cast("int")).alias("n_changed"))


def outline_edges(spark: SparkSession, d: str) -> DataFrame:
    items, _ = _items(spark, d)
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("parent") > 0).cast("long")).alias("below_heading"), F.sum("weight").alias("weight"))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    n = _shop(spark, d)
    asked = n.select("note_key", F.explode(F.array(F.lit("LEDGER"), F.lit("ledger"), F.lit("nowhere"))).alias("heading"))
    return outline.heading_lines(asked, parse.child(n, "headings"))


def complete_headings(spark: SparkSession, d: str) -> DataFrame:
    return query.complete_headings(parse.child(_shop(spark, d), "headings"), "supplier/Supplier-000000001.md", "Dg", 10)


def shop_backlinks(spark: SparkSession, d: str) -> DataFrame:
    """Backlinks of every note of the shop vault, parsed and resolved."""
    scanned = _shop(spark, d)
    notes = scanned.select("note_key", F.col("note_key").alias("path"), T.stem_of(F.col("note_key")).alias("stem"), F.lit(True).alias("alive"), F.lit(False).alias("phantom"))
    aliases = scanned.select("note_key", F.explode("aliases").alias("alias"))
    links = parse.child(scanned, "links").select(F.col("note_key").alias("src_key"), "ord", "raw")
    r = resolve.resolved_links(links, notes, aliases).filter("resolved")
    return r.groupBy("dst_key").agg(F.count(F.lit(1)).alias("n_links"), F.count_distinct("src_key").alias("n_sources"))


QUERIES = {f.__name__: f for f in (
    path_functions, link_targets, candidate_names, resolve_names, resolve_paths, resolve_links, resolve_ambiguous, link_status, phantoms, note_counts,
    backlinks, backlink_groups, backlink_filter, complete_notes, completion_items, outbound, note_edges,
    scan_notes, scan_headings, scan_tags, scan_blocks, scan_links, outline_items, outline_ids, outline_edges, heading_lines, complete_headings, shop_backlinks,
)}

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"
_BARE = "regexp_replace({}, '\\.(markdown|md)$', '', 'i')"
_CURRENT = "(SELECT * FROM notes WHERE alive AND NOT phantom QUALIFY row_number() OVER (PARTITION BY note_key ORDER BY landed_at DESC, mtime DESC, title DESC, coalesce(size, -1) DESC) = 1)"
_NORM = "regexp_replace(regexp_replace(regexp_replace({}, '^[ \\t]+|[ \\t]+$', '', 'g'), '[/\\\\]+$', ''), '\\.(markdown|md)$', '', 'i')"
_BASE = "split_part(replace(split_part(regexp_replace({0}, '^[ \\t]+|[ \\t]+$', '', 'g'), '#', 1), '\\', '/'), '/', -1)"
_NOTE_LIKE = f"(NOT contains({{0}}, ':') AND {_BASE} <> '' AND (NOT contains({_BASE}, '.') OR regexp_matches({_BASE}, '^.+\\.(md|markdown)$', 'i')))"
_JOINED = """list_reduce(list_filter(string_split_regex({0} || '/' || {1}, '[/\\\\]'), lambda x: x <> '' AND x <> '.'),
  lambda acc, x: CASE WHEN acc IS NULL THEN NULL WHEN x <> '..' THEN acc || '/' || x WHEN acc = '' THEN NULL ELSE regexp_replace(acc, '/[^/]*$', '') END, '')"""
_SHARED = "len(list_filter(range(1, 1 + least(len(string_split({0}, '/')), len(string_split({1}, '/')))), lambda i: {0} <> '' AND string_split({0}, '/')[1:i] = string_split({1}, '/')[1:i]))"

_RESOLVE = f"""
once AS (SELECT DISTINCT link_id, src_key, ord, raw, heading, alias, kind, line, col, context FROM links WHERE raw IS NOT NULL),
asked AS (SELECT * FROM (SELECT *, {_NORM.format("split_part(url_decode(raw), '#', 1)")} AS target, {_DIR.format("src_key")} AS source_dir FROM once WHERE {_NOTE_LIKE.format("raw")}) WHERE target <> ''),
pairs AS (SELECT DISTINCT target, source_dir, regexp_matches(target, '[/\\\\]') AS by_path FROM asked),
living AS (SELECT DISTINCT note_key, path, stem FROM notes WHERE alive AND NOT phantom),
names AS (
  SELECT note_key, path, stem AS name, false AS is_alias FROM living WHERE stem <> ''
  UNION ALL SELECT DISTINCT note_key, path, alias, true FROM (SELECT DISTINCT note_key, alias FROM aliases) JOIN (SELECT DISTINCT note_key, path FROM living) USING (note_key) WHERE alias <> ''),
name_hits AS (
  SELECT target, source_dir, note_key, path, CASE WHEN name = target AND NOT is_alias THEN 1 WHEN name = target THEN 2 WHEN NOT is_alias THEN 3 ELSE 4 END AS pass, {_DIR.format("path")} AS dir
  FROM pairs JOIN names ON {_FOLD.format("name")} = {_FOLD.format("target")} WHERE NOT by_path),
name_best AS (
  SELECT target, source_dir, note_key AS dst_key, path AS dst_path, pass, n > 1 AS ambiguous FROM (
    SELECT *, count(DISTINCT path) OVER (PARTITION BY target, source_dir, pass) AS n,
      row_number() OVER (PARTITION BY target, source_dir ORDER BY pass, dir <> source_dir, length(path) - length(replace(path, '/', '')), -({_SHARED.format("dir", "source_dir")}), path, note_key) AS rn
    FROM name_hits) WHERE rn = 1),
ways AS (
  SELECT target, source_dir, 0 AS from_root, {_JOINED.format("source_dir", "target")} AS way FROM pairs WHERE by_path
  UNION ALL SELECT target, source_dir, 2, {_JOINED.format("''", "target")} FROM pairs WHERE by_path AND source_dir <> '' AND NOT regexp_matches(target, '^\\.{{1,2}}[/\\\\]')),
path_hits AS (
  SELECT target, source_dir, from_root + CASE WHEN {_BARE.format("path")} = ltrim(way, '/') THEN 1 ELSE 2 END AS pass, path, note_key
  FROM ways JOIN living ON {_FOLD.format(_BARE.format("path"))} = {_FOLD.format("ltrim(way, '/')")} WHERE way <> ''),
path_best AS (SELECT target, source_dir, note_key AS dst_key, path AS dst_path, pass, false AS ambiguous FROM path_hits QUALIFY row_number() OVER (PARTITION BY target, source_dir ORDER BY pass, path, note_key) = 1),
best AS (SELECT * FROM name_best UNION ALL SELECT * FROM path_best),
resolved AS (
  SELECT link_id, src_key, ord, raw, heading, alias, kind, line, col, context, dst_key IS NOT NULL AS resolved, coalesce(ambiguous, false) AS ambiguous,
    split_part({_NORM.format("raw")}, '/', -1) AS ghost, coalesce(dst_key, 'phantom:' || {_FOLD.format("split_part(" + _NORM.format("raw") + ", '/', -1)")}) AS dst_key
  FROM asked LEFT JOIN best USING (target, source_dir))"""

_COMPLETE = f"""
real AS (SELECT note_key, stem AS name, false AS is_alias FROM {_CURRENT}),
names AS (SELECT * FROM real UNION ALL SELECT DISTINCT note_key, alias, true FROM aliases WHERE note_key IN (SELECT note_key FROM real)),
ranked AS (SELECT row_number() OVER (ORDER BY is_alias, {_FOLD.format("name")}, name, note_key) AS rank, name, note_key, is_alias FROM names WHERE starts_with({_FOLD.format("name")}, 'ba'))"""

ORACLE = {
    "path_functions": f"""SELECT note_key, {_BARE.format("split_part(path, '/', -1)")} AS stem, {_DIR.format("path")} AS dir, length(path) - length(replace(path, '/', '')) AS depth, {_FOLD.format("path")} AS folded,
  regexp_replace(regexp_replace(regexp_replace({_FOLD.format("stem")}, '[^a-z0-9 \\t_\\x{{80}}-\\x{{10FFFF}}-]', '', 'g'), '[ \\t_-]+', '-', 'g'), '^-|-$', '', 'g') AS anchor,
  coalesce(nullif(title, ''), stem) AS shown, CASE WHEN size >= 1 THEN length(bin(size)) - 1 END AS bucket,
  CASE WHEN size = 1 THEN '1' WHEN size > 1 THEN (1::BIGINT << (length(bin(size)) - 1)) || '-' || ((1::BIGINT << length(bin(size))) - 1) END AS bucket_label,
  CASE WHEN size = 0 THEN 0.0 ELSE round(size / pow(10.0, floor(log10(size)) - 3)) * pow(10.0, floor(log10(size)) - 3) END AS rough_size,
  CASE WHEN dir = 'archive/2024' THEN 1.0 WHEN dir = 'archive' OR regexp_matches(dir, '^archive/2024/[^/]+$') THEN 0.55 WHEN dir = '' THEN 0.08 WHEN {_SHARED.format("dir", "'archive/2024'")} = 0 THEN 0 ELSE 0.12 + 0.12 * least(3, {_SHARED.format("dir", "'archive/2024'")}) END::DOUBLE AS kinship,
  path AS in_vault,
  repeat('../', 2 - {_SHARED.format("'archive/2024'", "dir")}) || array_to_string(string_split(path, '/')[1 + {_SHARED.format("'archive/2024'", "dir")}:], '/') AS from_archive
FROM (SELECT *, {_DIR.format("path")} AS dir FROM {_CURRENT})""",
    "link_targets": f"""SELECT link_id, {_NOTE_LIKE.format("raw")} AS note_like, target, regexp_matches(target, '[/\\\\]') AS is_path,
  nullif(ltrim({_JOINED.format(_DIR.format("src_key"), "target")}, '/'), '') AS joined, split_part({_NORM.format("raw")}, '/', -1) AS phantom_stem
FROM (SELECT DISTINCT link_id, src_key, raw, {_NORM.format("split_part(url_decode(raw), '#', 1)")} AS target FROM links WHERE raw IS NOT NULL)""",
    "candidate_names": f"WITH {_RESOLVE} SELECT note_key, path, name, is_alias FROM names",
    "resolve_names": f"WITH {_RESOLVE} SELECT target, source_dir, dst_path, ambiguous, pass FROM name_best",
    "resolve_paths": f"WITH {_RESOLVE} SELECT target, source_dir, dst_path, pass FROM path_best",
    "resolve_links": f"WITH {_RESOLVE} SELECT link_id, dst_key, ambiguous, resolved FROM resolved",
    "resolve_ambiguous": f"WITH {_RESOLVE} SELECT dst_key, count(*) AS n FROM resolved WHERE ambiguous GROUP BY dst_key",
    "link_status": f"WITH {_RESOLVE} SELECT CASE WHEN NOT resolved THEN 'unresolved' WHEN ambiguous THEN 'ambiguous' ELSE 'resolved' END AS status, count(*) AS n, count(DISTINCT dst_key) AS n_targets FROM resolved GROUP BY 1",
    "phantoms": f"WITH {_RESOLVE} SELECT dst_key AS note_key, min(ghost) AS stem, {_FOLD.format('min(ghost)')} AS stem_fold, count(*) AS inbound FROM resolved WHERE NOT resolved AND {_NOTE_LIKE.format('ghost')} GROUP BY dst_key",
    "note_counts": f"WITH {_RESOLVE} SELECT (SELECT count(DISTINCT note_key) FROM living) AS n_notes, count(DISTINCT link_id) AS n_links, count(DISTINCT CASE WHEN NOT resolved THEN dst_key END) AS n_phantoms FROM resolved",
    "backlinks": f"WITH {_RESOLVE} SELECT dst_key, src_key, line, col, ord, raw, kind FROM resolved WHERE resolved",
    "backlink_groups": f"WITH {_RESOLVE} SELECT dst_key, src_key, count(*) AS n_mentions, min(line) AS first_line FROM resolved WHERE resolved GROUP BY dst_key, src_key",
    "backlink_filter": f"""WITH {_RESOLVE} SELECT DISTINCT dst_key, src_key FROM resolved LEFT JOIN (SELECT note_key, title FROM {_CURRENT}) t ON t.note_key = src_key
WHERE resolved AND (lower(src_key) LIKE '%l%e%d%g%e%r%' OR lower(title) LIKE '%l%e%d%g%e%r%' OR lower(raw) LIKE '%l%e%d%g%e%r%' OR lower(alias) LIKE '%l%e%d%g%e%r%' OR lower(context) LIKE '%l%e%d%g%e%r%')""",
    "complete_notes": f"WITH {_COMPLETE} SELECT * FROM ranked WHERE rank <= 64",
    "completion_items": f"""WITH {_COMPLETE}, near AS (SELECT *, {_DIR.format("note_key")} AS dir FROM ranked WHERE rank <= 64),
way AS (SELECT *, repeat('../', 2 - {_SHARED.format("'archive/2024'", "dir")}) || array_to_string(string_split(note_key, '/')[1 + {_SHARED.format("'archive/2024'", "dir")}:], '/') AS way FROM near)
SELECT rank, name AS label, '[' || coalesce(nullif(regexp_replace(name, '[\\[\\]]', '', 'g'), ''), 'note') || '](' || replace(url_encode(way), '%2F', '/') || ')' AS "insert", note_key AS detail FROM way""",
    "outbound": f"WITH {_RESOLVE} SELECT src_key, count(*) AS n_links, count(DISTINCT dst_key) AS n_targets FROM resolved GROUP BY src_key",
    "note_edges": f"WITH {_RESOLVE} SELECT least(src_key, dst_key) AS a, greatest(src_key, dst_key) AS b, count(*) AS n FROM resolved WHERE resolved AND src_key <> dst_key GROUP BY 1, 2",
    **shop.ORACLE,
}
