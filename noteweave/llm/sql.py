"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from noteweave.plans.problems import clean_sql, plain_sql

_PAIRS = """
pairs AS (SELECT DISTINCT a, b FROM edges WHERE a <> b),
items AS (SELECT b, count(*) AS n FROM pairs GROUP BY b),
total AS (SELECT count(DISTINCT a) AS n FROM pairs),
kept AS (SELECT a, b FROM pairs JOIN items USING (b) WHERE n >= 8),
together AS (SELECT x.b AS b_lo, y.b AS b_hi, count(*) AS t FROM kept x JOIN kept y ON x.a = y.a AND x.b < y.b GROUP BY 1, 2 HAVING count(*) >= 8),
scored AS (
  SELECT b_lo, b_hi, t, l.n AS n_lo, h.n AS n_hi, total.n AS n
  FROM together JOIN items l ON l.b = b_lo JOIN items h ON h.b = b_hi, total)"""

# The look-alikes of the SQL for skeletons, a character and its prototype; written apart from the operator's table.
_ALIKE = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ѴV ӀI аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ѵv ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ αa γy ιi νv οo ρp υu ϲc ϳj ՕO ՍU ՏS օo սu ոn հh ցg զq յj "
    "ёë ЁË їï ЇÏ άá ΆÁ έé ΈÉ όó ΌÓ ύú ΎÝ ίí ΊÍ ıi ɡg –- −- ’' ‘' `' ´'"
).split()


def _skeleton_sql(clean: str) -> str:
    """SQL for the composed skeleton of a text that is clean of invisible and wide characters."""
    letters = f"translate({clean}, '{''.join(p[0] for p in _ALIKE)}', '{''.join(p[1] for p in _ALIKE).replace(chr(39), chr(39) * 2)}')"
    folded = f"replace(replace(replace(replace(replace(replace({letters}, '№', 'No'), 'æ', 'ae'), 'œ', 'oe'), 'Æ', 'AE'), 'Œ', 'OE'), 'ﬁ', 'fi')"
    return f"replace(translate({folded}, 'I1|0', 'lllO'), 'm', 'rn')"


ORACLE = {
    "p1_titles": """WITH names AS (SELECT hub_id, title AS name FROM hub_titles UNION SELECT hub_id, unnest(aliases) FROM hub_titles)
SELECT name, min(hub_id) AS hub_id, 3 AS n_found FROM names WHERE trim(name) <> '' GROUP BY name""",
    "p7_self": """SELECT item_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n_words FROM eval_items WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) >= 12""",
    "p8_checks": "SELECT DISTINCT mix, 0 AS n_beyond, 0 AS n_twice, 0 AS n_off FROM source_weights WHERE mix IS NOT NULL",
    "p3_groups": f"""WITH every AS (SELECT raw AS v FROM links UNION ALL SELECT title FROM wiki_pages UNION ALL SELECT title FROM notes),
vals AS (SELECT v, count(*) AS n FROM every WHERE v IS NOT NULL GROUP BY v),
forms AS (SELECT {plain_sql("v")} AS plain, {_skeleton_sql(clean_sql("v"))} AS skeleton, sum(n) AS n, count(*) AS k FROM vals GROUP BY 1, 2)
SELECT skeleton, sum(n) AS n_rows, sum(k) AS n_spellings, arg_min(plain, (-n, plain)) AS plain FROM forms GROUP BY skeleton HAVING sum(k) > 1""",
    "p3_found": f"""WITH every AS (
  SELECT 'links' AS tbl, link_id AS row_id, raw AS v FROM links
  UNION ALL SELECT 'wiki_pages', page_id, title FROM wiki_pages
  UNION ALL SELECT 'notes', note_id, title FROM notes)
SELECT DISTINCT tbl, CAST(row_id AS BIGINT) AS row_id FROM every WHERE v <> {plain_sql("v")}""",
    "p4_found": f"WITH {_PAIRS} SELECT b_lo, b_hi FROM scored WHERE t * n >= 4 * n_lo * n_hi",
    "p4_pairs": f"""WITH {_PAIRS} SELECT b_lo, b_hi, t AS n_together, n_lo, n_hi,
  round(n_lo::DOUBLE * n_hi / n, 6) AS expected, round(t::DOUBLE * n / (n_lo::DOUBLE * n_hi), 6) AS lift,
  round((1 - n_hi::DOUBLE / n) / CASE WHEN t < n_lo THEN 1 - t::DOUBLE / n_lo END, 6) AS conviction_lo_hi,
  round((1 - n_lo::DOUBLE / n) / CASE WHEN t < n_hi THEN 1 - t::DOUBLE / n_hi END, 6) AS conviction_hi_lo
FROM scored""",
}
