"""A vault written from the relational tables.

A line with an unescaped pipe is a table row by the block rule, so a piped
link makes one. Each row of region, nation, supplier, customer, part and
orders becomes a note whose text links to others by foreign key, so whatever
is parsed from it can be checked with SQL on the tables. '#' in names would
begin a fragment and is written '-'. Regions hold a fence, code inside a line
and an escaped link, orders a list with a link and an embed for each line
item, in the order of line number, part and supplier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.session import table


def _plain(c: str) -> Column:
    return F.replace(F.col(c), F.lit("#"), F.lit("-"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(note_key, text): the shop vault."""
    region, nation, supplier, customer, part, orders, lineitem = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"))
    named = nation.select(F.col("n_nationkey").alias("nk"), "n_name")
    r_name, n_name = F.col("r_name"), F.col("n_name")
    stem = _plain("name")
    items = lineitem.join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(supplier.select("s_suppkey", _plain("s_name").alias("s")), F.col("l_suppkey") == F.col("s_suppkey"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", _text("- [[", F.col("s"), "]] ![[", F.col("p_name"), "]]\n").alias("line"))
    lists = items.groupBy("l_orderkey").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])).alias("lines"))  # of one order
    buyers = orders.join(customer.select("c_custkey", _plain("c_name").alias("c")), F.col("o_custkey") == F.col("c_custkey")).join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    number = F.col("o_orderkey").cast("string")
    parts = [
        buyers.select(_text("order/", number, ".md").alias("note_key"), _text("# Order ", number, "\n\nfor [[", F.col("c"), "]]\n\n", F.coalesce("lines", F.lit(""))).alias("text")),
        region.select(_text("region/", r_name, ".md").alias("note_key"), _text("# ", r_name, "\n\n```sql\n# no [[nowhere]]\n```\n\nuse `[[code]]` and \\[[escaped]] here\n").alias("text")),
        nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            _text("nation/", n_name, ".md").alias("note_key"),
            _text("---\ntitle: Nation ", F.col("n_nationkey").cast("string"), "\naliases: [N", F.col("n_nationkey").cast("string"), "]\n---\n# ", n_name, "\n\nin [[", r_name, "]] #nation\n").alias("text"),
        ),
        supplier.withColumnRenamed("s_name", "name").join(named, F.col("s_nationkey") == F.col("nk")).select(
            _text("supplier/", stem, ".md").alias("note_key"), _text("# ", stem, "\n\nfrom [[", n_name, "|home]]\n\n## Ledger\n\n- balance\n").alias("text")
        ),
        customer.withColumnRenamed("c_name", "name").join(named, F.col("c_nationkey") == F.col("nk")).select(
            _text("customer/", F.col("c_mktsegment"), "/", stem, ".md").alias("note_key"),
            _text("# ", stem, "\n\nsee [nation](../../nation/", n_name, ".md#top) and [[N", F.col("nk").cast("string"), "]] #", F.col("c_mktsegment"), "\n").alias("text"),
        ),
        part.select(
            _text("part/", F.col("p_partkey").cast("string"), "/", F.col("p_name"), ".md").alias("note_key"),
            _text("# ", F.col("p_name"), "\n\nneeds [[Missing ", F.col("p_size").cast("string"), "]] #", _plain("p_brand"), "\n").alias("text"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


_SHOP = """
s AS (SELECT 'supplier/' || replace(s_name, '#', '-') || '.md' AS note_key, replace(s_name, '#', '-') AS stem, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT 'customer/' || c_mktsegment || '/' || replace(c_name, '#', '-') || '.md' AS note_key, replace(c_name, '#', '-') AS stem, n_name, n_nationkey AS k, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT 'part/' || p_partkey || '/' || p_name || '.md' AS note_key, p_name AS stem, p_size AS size, replace(p_brand, '#', '-') AS brand FROM part),
n AS (SELECT 'nation/' || n_name || '.md' AS note_key, n_name AS stem, r_name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey),
r AS (SELECT 'region/' || r_name || '.md' AS note_key, r_name AS stem FROM region),
o AS (SELECT 'order/' || o_orderkey || '.md' AS note_key, 'Order ' || o_orderkey AS stem, replace(c_name, '#', '-') AS buyer FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (SELECT 'order/' || l_orderkey || '.md' AS note_key, replace(s_name, '#', '-') AS seller, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS nth
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
stems AS (SELECT note_key, stem, 0 AS line FROM r UNION ALL SELECT note_key, stem, 4 FROM n UNION ALL SELECT note_key, stem, 0 FROM s UNION ALL SELECT note_key, stem, 0 FROM c UNION ALL SELECT note_key, stem, 0 FROM p UNION ALL SELECT note_key, stem, 0 FROM o),
parts AS (
  SELECT note_key, 0 AS rank, 'code' AS kind, 2 AS line, 1 AS weight, '' AS text FROM r UNION ALL SELECT note_key, 0, 'paragraph', 6, 5, '' FROM r
  UNION ALL SELECT note_key, 0, 'paragraph', 6, 2 + len(string_split(r_name, ' ')), '' FROM n
  UNION ALL SELECT note_key, 0, 'table', 2, 1 + len(string_split(n_name, ' ')), '' FROM s UNION ALL SELECT note_key, 0, 'list', 6, 2, '' FROM s
  UNION ALL SELECT note_key, 0, 'paragraph', 2, 5, '' FROM c UNION ALL SELECT note_key, 0, 'paragraph', 2, 4, '' FROM p
  UNION ALL SELECT note_key, 0, 'paragraph', 2, 2, '' FROM o
  UNION ALL SELECT note_key, 0, 'list', 4, sum(2 + len(string_split(p_name, ' '))), '' FROM i GROUP BY note_key
  UNION ALL SELECT note_key, 1, 'tag', 6, 1, 'nation' FROM n UNION ALL SELECT note_key, 1, 'tag', 2, 1, seg FROM c UNION ALL SELECT note_key, 1, 'tag', 2, 1, brand FROM p
  UNION ALL SELECT note_key, 2, 'embed', 4 + nth, 1, p_name FROM i),
every AS (
  SELECT note_key, -1 AS rank, 'heading' AS kind, line, 1 AS weight, stem AS text, 1 AS level FROM stems UNION ALL SELECT note_key, -1, 'heading', 4, 1, 'Ledger', 2 FROM s
  UNION ALL SELECT note_key, rank, kind, line, weight, text, 0 FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY note_key ORDER BY line, rank) AS item FROM every),
items AS (
  SELECT note_key, item, kind, level, text, line, weight, row_number() OVER (PARTITION BY note_key, parent, kind ORDER BY item) - 1 AS ordinal, parent FROM (
    SELECT *, CASE WHEN level = 1 THEN 0 WHEN level = 2 THEN 1 ELSE coalesce(max(CASE WHEN kind = 'heading' THEN item END) OVER (PARTITION BY note_key ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS parent FROM placed))"""

_LINKS = """
links_of AS (
  SELECT note_key, 0 AS ord, r_name AS raw, '' AS heading, '' AS alias, 'wikilink' AS kind, 3 AS col FROM n
  UNION ALL SELECT note_key, 0, n_name, '', 'home', 'wikilink', 5 FROM s
  UNION ALL SELECT note_key, 0, '../../nation/' || n_name || '.md#top', 'top', 'nation', 'markdown', 4 FROM c
  UNION ALL SELECT note_key, 1, 'N' || k, '', '', 'wikilink', 13 + length('../../nation/' || n_name || '.md#top') + 6 FROM c
  UNION ALL SELECT note_key, 0, 'Missing ' || size, '', '', 'wikilink', 6 FROM p
  UNION ALL SELECT note_key, 0, buyer, '', '', 'wikilink', 4 FROM o
  UNION ALL SELECT note_key, 1 + 2 * nth, seller, '', '', 'wikilink', 2 FROM i
  UNION ALL SELECT note_key, 2 + 2 * nth, p_name, '', '', 'embed', length(seller) + 7 FROM i),
towards AS (
  SELECT note_key AS src, 'region/' || r_name || '.md' AS dst_key FROM n UNION ALL SELECT note_key, 'nation/' || n_name || '.md' FROM s
  UNION ALL SELECT note_key, 'nation/' || n_name || '.md' FROM c UNION ALL SELECT note_key, 'nation/' || n_name || '.md' FROM c
  UNION ALL SELECT o.note_key, c.note_key FROM o JOIN c ON c.stem = buyer UNION ALL SELECT i.note_key, s.note_key FROM i JOIN s ON s.stem = seller
  UNION ALL SELECT i.note_key, first.note_key FROM i JOIN (SELECT stem, min(note_key) AS note_key FROM p GROUP BY stem) first ON first.stem = i.p_name)"""

ORACLE = {
    "scan_notes": f"WITH {_SHOP} SELECT note_key, '' AS title, '' AS aliases FROM stems WHERE note_key NOT LIKE 'nation/%' UNION ALL SELECT note_key, 'Nation ' || k, 'N' || k FROM n",
    "scan_headings": f"WITH {_SHOP} SELECT note_key, 0 AS ord, stem AS text, 1 AS level, line FROM stems UNION ALL SELECT note_key, 1, 'Ledger', 2, 4 FROM s",
    "scan_tags": f"WITH {_SHOP} SELECT note_key, 0 AS ord, text AS tag, line FROM parts WHERE kind = 'tag'",
    "scan_blocks": f"WITH {_SHOP} SELECT note_key, kind, count(*) AS n, sum(weight) AS weight FROM parts WHERE rank = 0 GROUP BY note_key, kind",
    "scan_links": f"WITH {_SHOP}, {_LINKS} SELECT note_key, ord, raw, heading, alias, kind, col FROM links_of",
    "outline_items": f"WITH {_SHOP} SELECT note_key, item, kind, parent, level, text, line, ordinal FROM items UNION ALL SELECT note_key, 0, 'root', NULL, 0, stem, 0, 0 FROM stems",
    "outline_edges": f"WITH {_SHOP} SELECT kind, count(*) AS n, sum((parent > 0)::INT) AS below_heading, sum(weight) AS weight FROM items GROUP BY kind",
    "outline_ids": f"WITH {_SHOP} SELECT count(*) AS n_items, count(*) AS n_ids, 0 AS n_not_positive, 0 AS n_changed FROM items",
    "heading_lines": f"""WITH {_SHOP}, asked AS (SELECT note_key, unnest(['LEDGER', 'ledger', 'nowhere']) AS heading FROM stems)
SELECT asked.note_key, heading, CASE WHEN asked.note_key LIKE 'supplier/%' AND heading <> 'nowhere' THEN 4 ELSE 0 END AS line FROM asked""",
    "complete_headings": f"WITH {_SHOP} SELECT 'Ledger' AS text, 2 AS level, 4 AS line FROM s WHERE note_key = 'supplier/Supplier-000000001.md'",
    "shop_backlinks": f"WITH {_SHOP}, {_LINKS} SELECT dst_key, count(*) AS n_links, count(DISTINCT src) AS n_sources FROM towards GROUP BY dst_key",
}
