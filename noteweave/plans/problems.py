"""Queries of the general problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators import references, tree_aggregate
from noteweave.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate.frequent_nodes(table(spark, d, "edges"))


def p2_node_stats(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges")
    stats = tree_aggregate.node_stats(edges)
    return stats.withColumn("sum_w", F.round("sum_w", 4))


def _reference_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("links", "wiki_pages", "notes", "aliases", "hub_titles")]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_rows(*_reference_tables(spark, d)).select("tbl", "row_id").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_reference_tables(spark, d))


def p6_masks(spark: SparkSession, d: str) -> DataFrame:
    return references.mask_report(*_reference_tables(spark, d))


QUERIES = {"p2_found": p2_found, "p2_node_stats": p2_node_stats, "p6_found": p6_found, "p6_report": p6_report, "p6_masks": p6_masks}

_ENDS = """WITH ends AS (
  SELECT 'a' AS side, a AS node, b AS other, w FROM edges
  UNION ALL SELECT 'b', b, a, w FROM edges)"""

_INVISIBLE = "[\\x{ad}\\x{61c}\\x{180e}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{2064}\\x{2066}-\\x{206f}\\x{feff}\\x{34f}\\x{fe00}-\\x{fe0f}]"
_BLANK = "[\\t\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
# The look-alikes of the SQL, a foreign letter and the Latin one it is drawn like; written apart from the operator's table.
_PAIRS = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ѴV ӀI аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa γy ιi νv οo ρp υu ϲc ϳj ՕO ՍU ՏS օo սu ոn հh ցg զq յj"
).split()
_FOREIGN, _AS_LATIN = "".join(p[0] for p in _PAIRS), "".join(p[1] for p in _PAIRS)
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def clean_sql(x: str) -> str:
    """SQL for a text without invisible characters, with ordinary blanks, hyphens and width, composed."""
    return f"nfc_normalize(translate(regexp_replace(regexp_replace(regexp_replace({x}, '{_INVISIBLE}', '', 'g'), '{_BLANK}', ' ', 'g'), '[\\x{{2010}}\\x{{2011}}]', '-', 'g'), '{_WIDE}', '{_NARROW}'))"


def plain_sql(x: str) -> str:
    """SQL for the plain form of a text whose foreign words hold no Latin look-alikes."""
    words = f"regexp_extract_all({clean_sql(x)}, '\\p{{L}}+|\\P{{L}}+')"
    mixed = f"CASE WHEN regexp_matches(v, '\\p{{Latin}}') AND regexp_matches(v, '[\\p{{Greek}}\\p{{Cyrillic}}\\p{{Armenian}}]') THEN translate(v, '{_FOREIGN}', '{_AS_LATIN}') ELSE v END"
    return f"array_to_string(list_transform({words}, lambda v: {mixed}), '')"


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HUBS = "SELECT title AS name FROM hub_titles UNION SELECT unnest(aliases) FROM hub_titles"


def _page_title_sql(x: str) -> str:
    t = f"trim(regexp_replace(split_part({plain_sql(x)}, '#', 1), '[ _]+', ' ', 'g'))"
    return f"(CASE WHEN {t} SIMILAR TO '[a-z].*' THEN upper(substr({t}, 1, 1)) || substr({t}, 2) ELSE {t} END)"


_ORPHANS = f"""
link_refs AS (
  SELECT link_id, seen_at AS moment, meant, regexp_replace(split_part(trim(split_part(meant, '#', 1)), '/', -1), '\\.md$', '', 'i') AS name
  FROM (SELECT link_id, seen_at, {plain_sql("url_decode(raw)")} AS meant FROM links WHERE raw IS NOT NULL)),
named AS (
  SELECT link_id, moment, {_FOLD.format("name")} AS name FROM link_refs
  WHERE name <> '' AND NOT contains(meant, ':') AND NOT contains(name, '.')),
living AS (SELECT note_key, stem, landed_at FROM notes WHERE alive AND NOT phantom),
targets AS (
  SELECT {_FOLD.format(plain_sql("stem"))} AS name, landed_at AS since FROM living
  UNION ALL SELECT {_FOLD.format(plain_sql("alias"))}, landed_at FROM aliases JOIN living USING (note_key)
  UNION ALL SELECT {_FOLD.format(plain_sql("name"))}, TIMESTAMP '0001-01-01' FROM ({_HUBS})),
first_target AS (SELECT name, min(since) AS since FROM targets GROUP BY name),
page_refs AS (SELECT page_id, landed_at AS moment, {_page_title_sql("redirect")} AS name FROM wiki_pages WHERE redirect <> ''),
page_targets AS (
  SELECT {_page_title_sql("title")} AS name, landed_at AS since FROM wiki_pages WHERE ns = '0' AND alive
  UNION ALL SELECT {_page_title_sql("name")}, TIMESTAMP '0001-01-01' FROM ({_HUBS})),
first_page AS (SELECT name, min(since) AS since FROM page_targets GROUP BY name),
orphan AS (
  SELECT 'links' AS tbl, link_id AS row_id, moment FROM named LEFT JOIN first_target USING (name) WHERE since IS NULL OR since > moment
  UNION ALL SELECT 'wiki_pages', page_id, moment FROM page_refs LEFT JOIN first_page USING (name) WHERE since IS NULL OR since > moment)"""

ORACLE = {
    "p2_found": f"{_ENDS} SELECT side, node FROM ends WHERE node IS NOT NULL GROUP BY side, node HAVING count(*) * 100 >= (SELECT count(*) FROM edges)",
    "p2_node_stats": f"{_ENDS} SELECT side, node, count(*) AS n_rows, count(DISTINCT other) AS n_neighbours, round(sum(w), 4) AS sum_w FROM ends WHERE node IS NOT NULL GROUP BY side, node",
    "p6_found": f"WITH {_ORPHANS} SELECT DISTINCT tbl, row_id FROM orphan",
    "p6_masks": f"""WITH {_ORPHANS},
refs AS (
  SELECT 'links' AS tbl, link_id AS row_id, CASE WHEN link_id IN (SELECT link_id FROM named) THEN '1' ELSE '0' END || CASE WHEN seen_at IS NULL THEN '0' ELSE '1' END AS mask FROM links
  UNION ALL SELECT 'wiki_pages', page_id, CASE WHEN name = '' THEN '0' ELSE '1' END || CASE WHEN moment IS NULL THEN '0' ELSE '1' END FROM page_refs),
lost AS (SELECT tbl, mask, count(DISTINCT row_id) AS n_orphans FROM refs JOIN (SELECT DISTINCT tbl, row_id FROM orphan) USING (tbl, row_id) GROUP BY 1, 2)
SELECT tbl, mask, count(DISTINCT row_id) AS n_refs, coalesce(any_value(n_orphans), 0) AS n_orphans FROM refs LEFT JOIN lost USING (tbl, mask) GROUP BY 1, 2""",
    "p6_report": f"""WITH {_ORPHANS},
refs AS (SELECT 'links' AS tbl, link_id AS row_id, moment FROM named UNION ALL SELECT 'wiki_pages', page_id, moment FROM page_refs),
counted AS (SELECT tbl, strftime(moment, '%Y-%m') AS month, count(DISTINCT row_id) AS n_refs FROM refs GROUP BY 1, 2),
lost AS (SELECT tbl, strftime(moment, '%Y-%m') AS month, count(DISTINCT row_id) AS n_orphans FROM orphan GROUP BY 1, 2)
SELECT tbl, month, n_refs, coalesce(n_orphans, 0) AS n_orphans FROM counted LEFT JOIN lost USING (tbl, month)""",
}
