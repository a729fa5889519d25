"""Queries of the graph operators, and their SQL.

The graph is the crawl of ``edges``; its nodes are all notes, all hubs and
every end of an edge. Positions are the first two numbers of the embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators import graph as G
from noteweave.operators import query
from noteweave.session import beside, cut, table


def nodes(spark: SparkSession, d: str) -> DataFrame:
    ends = table(spark, d, "edges").select(F.explode(F.array("a", "b")).alias("node"))
    every = table(spark, d, "notes").select(F.col("note_id").alias("node")).unionByName(table(spark, d, "hub_titles").select(F.col("hub_id").alias("node"))).unionByName(ends)
    return every.filter("node IS NOT NULL").distinct()


def _e(spark: SparkSession, d: str) -> DataFrame:
    return G.simple_edges(table(spark, d, "edges"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    real = table(spark, d, "notes").filter("alive AND NOT phantom")
    return real.groupBy(F.col("note_id").alias("node")).agg(F.min("path").alias("path"))


def _labels(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return nodes(spark, d).select("node", F.pmod("node", F.lit(k)).alias("label"))


def edges_undirected(spark: SparkSession, d: str) -> DataFrame:
    return _e(spark, d).select("a", "b", F.round("w", 6).alias("w"), "n")


def edge_directions(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_directions(table(spark, d, "edges")).groupBy("forward").agg(F.count(F.lit(1)).alias("n"))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    one = G.degrees(nodes(spark, d), _e(spark, d))
    many = G.degrees(nodes(spark, d), _e(spark, d), multigraph=True).withColumnRenamed("degree", "links")
    return one.join(many, "node")


def degree_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_summary(G.degrees(nodes(spark, d), _e(spark, d)))


def power_law(spark: SparkSession, d: str) -> DataFrame:
    return G.power_law(G.degrees(nodes(spark, d), _e(spark, d)))


def clustering(spark: SparkSession, d: str) -> DataFrame:
    return G.clustering(cut(_e(spark, d)))


def components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(nodes(spark, d), _e(spark, d))


def component_report(spark: SparkSession, d: str) -> DataFrame:
    return G.component_report(components(spark, d))


def component_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.component_histogram(components(spark, d))


def hub_fragility(spark: SparkSession, d: str) -> DataFrame:
    return G.hub_fragility(nodes(spark, d), cut(_e(spark, d)))


def folder_correlation(spark: SparkSession, d: str) -> DataFrame:
    return G.folder_correlation(_paths(spark, d), components(spark, d))


def degree_norm_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_normalised(_e(spark, d).withColumn("w", F.col("n").cast("double"))).select("a", "b", F.round("w", 6).alias("w"))


def path_chain(spark: SparkSession, d: str) -> DataFrame:
    return G.path_chain(_paths(spark, d))


def orphan_drawer(spark: SparkSession, d: str) -> DataFrame:
    return G.orphan_drawer(_paths(spark, d), G.degrees(nodes(spark, d), _e(spark, d)))


def modularity(spark: SparkSession, d: str) -> DataFrame:
    return G.modularity(_e(spark, d), _labels(spark, d))


def contracted(spark: SparkSession, d: str) -> DataFrame:
    return G.contracted(_e(spark, d), _labels(spark, d)).select("a", "b", F.round("w", 4).alias("w"))


def dense_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = nodes(spark, d).select("node", F.pmod(F.col("node") * 7 + 3, F.lit(11)).alias("label"))
    return G.dense_labels(labels)


def partition_overlap(spark: SparkSession, d: str) -> DataFrame:
    return G.partition_overlap(_labels(spark, d, 10), _labels(spark, d, 7))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(nodes(spark, d), cut(_e(spark, d)))


def shape_class(spark: SparkSession, d: str) -> DataFrame:
    e = cut(_e(spark, d))
    two = G.is_bipartite(nodes(spark, d), e).agg(F.min("bipartite").alias("two"))
    return beside(G.graph_stats(nodes(spark, d), e), two).select(G.shape_of(F.col("two")).alias("shape"))


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    return G.is_bipartite(nodes(spark, d), cut(_e(spark, d))).groupBy("bipartite").agg(F.count(F.lit(1)).alias("n"))


def cocitation(spark: SparkSession, d: str) -> DataFrame:
    return G.cocited(cut(_e(spark, d)))


def missing_edge(spark: SparkSession, d: str) -> DataFrame:
    return G.missing_edge(_e(spark, d), components(spark, d))


def cross_folder_links(spark: SparkSession, d: str) -> DataFrame:
    return G.cross_folder_links(_e(spark, d), _paths(spark, d))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return query.neighbourhood(_e(spark, d).withColumn("w", F.round("w", 6)), 1, 40)


def positions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("node"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def position_edges(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d)
    steps = p.select(F.col("node").alias("a"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(17))).alias("k"))
    e = steps.select("a", (F.col("a") + F.col("k")).alias("b"), F.lit(1.0).alias("w"), F.lit(1).alias("n"))
    return e.join(p.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "w", "n")


def link_spread(spark: SparkSession, d: str) -> DataFrame:
    return G.link_spread(position_edges(spark, d), positions(spark, d)).withColumns({c: F.round(c, 6) for c in ("mean_length", "crossing_pct")})


def bimodality(spark: SparkSession, d: str) -> DataFrame:
    return G.radial(positions(spark, d)).select("n", *[F.round(c, 4).alias(c) for c in ("skew", "kurt", "bimodality")])


def highways(spark: SparkSession, d: str) -> DataFrame:
    r = G.highways(position_edges(spark, d), positions(spark, d), positions(spark, d).select("node", "label"))
    return r.select("n_links", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def _turned(p: DataFrame) -> DataFrame:
    jitter = F.pmod(F.col("node"), F.lit(5)) * 0.01
    return p.select("node", (-F.col("y") * 2 + 1 + jitter).alias("x"), (F.col("x") * 2 - 3).alias("y"))


def procrustes(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d).select("node", "x", "y")
    return G.procrustes(p, _turned(p)).select("n", F.round("scale", 4).alias("scale"), F.round("angle", 4).alias("angle"), F.round("rms", 4).alias("rms"))


def displacement(spark: SparkSession, d: str) -> DataFrame:
    p = positions(spark, d).select("node", "x", "y")
    return G.displacement(p, _turned(p), 0.3).select("n", "moved", F.round("p50", 4).alias("p50"), F.round("p99", 4).alias("p99"))


QUERIES = {f.__name__: f for f in (
    edges_undirected, edge_directions, degrees, degree_summary, power_law, clustering, components, component_report, component_histogram, hub_fragility,
    folder_correlation, degree_norm_edges, path_chain, orphan_drawer, modularity, contracted, dense_labels, partition_overlap, graph_stats, shape_class,
    bipartite, cocitation, missing_edge, cross_folder_links, neighbourhood, link_spread, bimodality, highways, procrustes, displacement,
)}

_E = """
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(coalesce(w, 0)) AS w, count(*) AS n FROM edges WHERE a <> b GROUP BY 1, 2),
sym AS (SELECT a AS u, b AS v, w FROM e UNION ALL SELECT b, a, w FROM e),
nodes AS (SELECT note_id AS node FROM notes UNION SELECT hub_id FROM hub_titles UNION SELECT a FROM edges WHERE a IS NOT NULL UNION SELECT b FROM edges WHERE b IS NOT NULL),
deg AS (SELECT node, count(v) AS degree FROM nodes LEFT JOIN sym ON u = node GROUP BY node)"""
_CC = """
cc(node, component) USING KEY (node) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT t.node, min(s.component) FROM cc s JOIN sym ON sym.u = s.node JOIN recurring.cc t ON t.node = sym.v WHERE s.component < t.component GROUP BY t.node),
sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY component)"""
_PATHS = "paths AS (SELECT note_id AS node, min(path) AS path FROM notes WHERE alive AND NOT phantom GROUP BY note_id)"
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"


def _rank(table_: str, v: str, p: int) -> str:
    return f"(SELECT {v} FROM (SELECT {v}, row_number() OVER (ORDER BY {v}) - 1 AS i, count(*) OVER () AS k FROM {table_}) WHERE i = floor({p / 100} * (k - 1) + 0.5))"


_POS = """
pos AS (SELECT vec_id AS node, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
pe AS (SELECT a, b, 1.0 AS w FROM (SELECT node AS a, node + unnest([1, 3, 17]) AS b FROM pos) WHERE b IN (SELECT node FROM pos)),
pd AS (SELECT u, count(*) AS d FROM (SELECT a AS u FROM pe UNION ALL SELECT b FROM pe) GROUP BY u),
placed AS (SELECT pe.a, pe.b, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS len, p.label AS la, q.label AS lb FROM pe JOIN pos p ON p.node = pe.a JOIN pos q ON q.node = pe.b),
turned AS (SELECT node, -y * 2 + 1 + (node % 5) * 0.01 AS x2, x * 2 - 3 AS y2 FROM pos)"""
_LABELS = "labels AS (SELECT node, node % 10 AS label FROM nodes)"
_CON = "con AS (SELECT least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, sum(w) AS w FROM e JOIN labels x ON x.node = e.a JOIN labels y ON y.node = e.b GROUP BY 1, 2)"
_C2 = "(n * (n - 1) // 2)"
_STATS = f"""WITH RECURSIVE {_E}, {_CC},
pooled AS (SELECT CASE WHEN degree = 0 THEN -1 ELSE component END AS c FROM cc JOIN deg USING (node)),
stats AS (SELECT count(*) AS n, sum(degree) // 2 AS m, max(degree) AS max_degree, round(avg(degree), 9) AS mean_degree, count(*) FILTER (degree = 0) AS isolates, count(*) FILTER (degree = 1) AS leaves,
  (SELECT count(DISTINCT c) FROM pooled) AS components, (SELECT count(*) FROM sizes WHERE size > 1) AS nontrivial, (SELECT max(size) FROM sizes) AS largest FROM deg)"""


def _fragile(k: int) -> str:
    return f"""
top{k} AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT {k}),
left{k} AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM top{k})),
sym{k} AS (SELECT u, v FROM sym WHERE u NOT IN (SELECT node FROM top{k}) AND v NOT IN (SELECT node FROM top{k})),
cc{k}(node, component) USING KEY (node) AS (
  SELECT node, node FROM left{k} UNION
  SELECT t.node, min(s.component) FROM cc{k} s JOIN sym{k} y ON y.u = s.node JOIN recurring.cc{k} t ON t.node = y.v WHERE s.component < t.component GROUP BY t.node),
size{k} AS (SELECT count(*) AS size FROM cc{k} GROUP BY component),
row{k} AS (SELECT {k} AS k, sum(size) AS n_left, count(*) AS n_components, max(size) AS largest, round(100.0 * max(size) / sum(size), 6) AS largest_pct FROM size{k})"""


ORACLE = {
    "edges_undirected": f"WITH {_E} SELECT a, b, round(w, 6) AS w, n FROM e",
    "edge_directions": "SELECT forward, count(*) AS n FROM (SELECT max(a < b) AS forward FROM edges WHERE a <> b GROUP BY least(a, b), greatest(a, b)) GROUP BY forward",
    "degrees": f"WITH {_E}, multi AS (SELECT x, sum(n) AS links FROM (SELECT a AS x, n FROM e UNION ALL SELECT b, n FROM e) GROUP BY x) SELECT node, degree, coalesce(links, 0) AS links FROM deg LEFT JOIN multi ON x = node",
    "degree_summary": f"WITH {_E} SELECT count(*) AS n, round(avg(degree), 6) AS mean, max(degree) AS max, count(*) FILTER (degree = 0) AS orphans, round(100.0 * count(*) FILTER (degree = 0) / count(*), 6) AS orphan_pct, {', '.join(_rank('deg', 'degree', p) + f' AS p{p}' for p in (50, 90, 99))} FROM deg",
    "power_law": f"""WITH {_E}, linked AS (SELECT degree FROM deg WHERE degree > 0), xm AS (SELECT greatest(2, {_rank('linked', 'degree', 70)}) AS x_min),
tail AS (SELECT x_min, count(*) AS n, sum(ln(degree / (x_min - 0.5))) AS s FROM linked, xm WHERE degree >= x_min GROUP BY x_min)
SELECT x_min, n AS n_tail, CASE WHEN n >= 50 THEN round(1 + n / s, 6) END AS alpha FROM tail""",
    "clustering": f"""WITH {_E}, tri AS (SELECT x.a AS p, x.b AS q, z.b AS r FROM e x JOIN e z ON z.a = x.b JOIN e y ON y.a = x.a AND y.b = z.b),
per AS (SELECT node, count(*) AS closed FROM (SELECT p AS node FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY node)
SELECT node, degree, coalesce(closed, 0) AS closed, round(2.0 * coalesce(closed, 0) / (degree * (degree - 1)), 9) AS coefficient FROM deg LEFT JOIN per USING (node) WHERE degree BETWEEN 2 AND 400""",
    "missing_edge": f"""WITH RECURSIVE {_E}, {_CC}, sized AS (SELECT component, count(*) AS size FROM cc GROUP BY component HAVING count(*) > 2),
able AS (SELECT cc.node AS a, component FROM cc JOIN sized USING (component) JOIN deg ON deg.node = cc.node WHERE degree BETWEEN 1 AND size - 2 ORDER BY 1 LIMIT 1),
far AS (SELECT a, cc.node AS b FROM able JOIN cc USING (component) WHERE cc.node <> a AND cc.node NOT IN (SELECT v FROM sym WHERE u = a))
SELECT least(a, min(b)) AS a, greatest(a, min(b)) AS b FROM far GROUP BY far.a""",
    "components": f"WITH RECURSIVE {_E}, {_CC} SELECT node, component FROM cc",
    "component_report": f"WITH RECURSIVE {_E}, {_CC} SELECT sum(size) AS n_nodes, count(*) AS n_components, max(size) AS largest, round(100.0 * max(size) / sum(size), 6) AS largest_pct FROM sizes",
    "component_histogram": f"WITH RECURSIVE {_E}, {_CC} SELECT length(bin(size)) - 1 AS bucket, count(*) AS n_components FROM sizes GROUP BY 1",
    "hub_fragility": f"WITH RECURSIVE {_E}, {', '.join(map(_fragile, (1, 2, 5, 10, 25, 50)))} {' UNION ALL '.join(f'SELECT * FROM row{k}' for k in (1, 2, 5, 10, 25, 50))}",
    "folder_correlation": f"""WITH RECURSIVE {_E}, {_CC}, {_PATHS}, p AS (SELECT component, {_DIR.format('path')} AS dir, split_part(path, '/', 1) AS top FROM paths JOIN cc USING (node)),
g AS (SELECT (SELECT coalesce(sum{_C2}, 0) FROM (SELECT count(*) AS n FROM p GROUP BY component)) AS in_all, (SELECT coalesce(sum{_C2}, 0) FROM (SELECT count(*) AS n FROM p GROUP BY component, dir)) AS in_dir,
  (SELECT coalesce(sum{_C2}, 0) FROM (SELECT count(*) AS n FROM p GROUP BY component, top)) AS in_top, (SELECT coalesce(sum{_C2}, 0) FROM (SELECT count(*) AS n FROM p GROUP BY dir)) AS dir,
  (SELECT coalesce(sum{_C2}, 0) FROM (SELECT count(*) AS n FROM p GROUP BY top)) AS top, (SELECT {_C2} FROM (SELECT count(*) AS n FROM p)) AS every)
SELECT true AS same_component, in_all AS n_pairs, in_dir AS same_dir, in_top AS same_top FROM g UNION ALL SELECT false, every - in_all, dir - in_dir, top - in_top FROM g""",
    "degree_norm_edges": f"""WITH {_E}, d AS (SELECT node, degree FROM deg WHERE degree > 0), k AS (SELECT round(avg(degree) / pow(10.0, floor(log10(avg(degree))) - 3)) * pow(10.0, floor(log10(avg(degree))) - 3) AS k FROM d)
SELECT a, b, round(n * sqrt(k * k / (x.degree * y.degree)), 6) AS w FROM e JOIN d x ON x.node = a JOIN d y ON y.node = b, k""",
    "path_chain": f"WITH {_PATHS} SELECT a, b, 0.25::DOUBLE AS w FROM (SELECT node AS a, lead(node) OVER (ORDER BY path, node) AS b FROM paths) WHERE b IS NOT NULL",
    "orphan_drawer": f"""WITH {_E}, {_PATHS}, lost AS (SELECT node, path, {_DIR.format('path')} AS dir FROM paths JOIN deg USING (node) WHERE degree = 0), first AS (SELECT dir, arg_min(node, (path, node)) AS rep FROM lost GROUP BY dir)
SELECT rep AS a, node AS b FROM lost JOIN first USING (dir) WHERE node <> rep UNION ALL SELECT rep, b FROM (SELECT rep, lead(rep) OVER (ORDER BY dir) AS b FROM first) WHERE b IS NOT NULL""",
    "modularity": f"""WITH {_E}, {_LABELS}, {_CON}, m AS (SELECT sum(w) AS m FROM con), tot AS (SELECT label, sum(w) AS tot FROM (SELECT a AS label, w FROM con UNION ALL SELECT b, w FROM con) GROUP BY label), ins AS (SELECT a AS label, w AS inside FROM con WHERE a = b)
SELECT round(sum(coalesce(inside, 0) / m - (tot / (2 * m)) ** 2), 9) AS q, round(sum(coalesce(inside, 0) / m), 9) AS intra_fraction FROM tot LEFT JOIN ins USING (label), m""",
    "contracted": f"WITH {_E}, {_LABELS}, {_CON} SELECT a, b, round(w, 4) AS w FROM con",
    "dense_labels": f"WITH {_E}, l AS (SELECT node, (node * 7 + 3) % 11 AS label FROM nodes), f AS (SELECT label, dense_rank() OVER (ORDER BY min(node)) - 1 AS dense FROM l GROUP BY label) SELECT node, dense AS label FROM l JOIN f USING (label)",
    "partition_overlap": f"WITH {_E} SELECT node % 10 AS old, node % 7 AS new, count(*) AS n FROM nodes GROUP BY 1, 2",
    "graph_stats": f"{_STATS} SELECT *, round(2.0 * m / (n::DOUBLE * (n - 1)), 12) AS density, m + nontrivial + isolates <= n AS forest FROM stats",
    "shape_class": f"""{_STATS}, dn AS (SELECT node FROM nodes UNION ALL SELECT -node - 1 FROM nodes), ds AS (SELECT u, -v - 1 AS v FROM sym UNION ALL SELECT -v - 1, u FROM sym),
c2(node, component) USING KEY (node) AS (SELECT node, node FROM dn UNION SELECT t.node, min(s.component) FROM c2 s JOIN ds ON ds.u = s.node JOIN recurring.c2 t ON t.node = ds.v WHERE s.component < t.component GROUP BY t.node),
two AS (SELECT bool_and(x.component <> y.component) AS two FROM c2 x JOIN c2 y ON y.node = -x.node - 1 WHERE x.node >= 0),
f AS (SELECT *, m + nontrivial + isolates <= n AS forest, 2.0 * m / (n::DOUBLE * (n - 1)) AS density, max_degree / n AS hub FROM stats, two)
SELECT CASE WHEN n = 0 OR m = 0 OR (nontrivial = 0 AND 2 * isolates >= n) THEN 'orphans' WHEN n >= 4 AND hub >= 0.4 AND leaves / n >= 0.6 THEN 'star' WHEN (n >= 8 AND density >= 0.55) OR (n >= 5 AND density >= 0.8) THEN 'clique'
  WHEN nontrivial >= 3 AND largest / n < 0.55 THEN 'islands' WHEN max_degree <= 2 AND nontrivial <= 2 AND m + 2 >= n - isolates THEN 'chain' WHEN forest AND nontrivial <= 2 THEN 'tree'
  WHEN NOT forest AND max_degree <= 4 AND mean_degree BETWEEN 2.4 AND 4.2 THEN 'grid' WHEN NOT forest AND two THEN 'bipartite' WHEN mean_degree > 0.5 AND max_degree >= 8 * mean_degree AND hub < 0.4 THEN 'scale_free'
  WHEN forest THEN 'tree' ELSE 'messy' END AS shape FROM f""",
    "bipartite": f"""WITH RECURSIVE {_E}, dn AS (SELECT node FROM nodes UNION ALL SELECT -node - 1 FROM nodes), ds AS (SELECT u, -v - 1 AS v FROM sym UNION ALL SELECT -v - 1, u FROM sym),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM dn UNION SELECT t.node, min(s.component) FROM cc s JOIN ds ON ds.u = s.node JOIN recurring.cc t ON t.node = ds.v WHERE s.component < t.component GROUP BY t.node),
j AS (SELECT least(x.component, y.component) AS c, min(x.component <> y.component) AS bipartite FROM cc x JOIN cc y ON y.node = -x.node - 1 WHERE x.node >= 0 GROUP BY 1)
SELECT bipartite, count(*) AS n FROM j GROUP BY bipartite""",
    "cocitation": f"WITH {_E}, s AS (SELECT u, v FROM sym JOIN deg ON node = u WHERE degree BETWEEN 2 AND 128) SELECT x.v AS a, y.v AS b, count(*) AS shared FROM s x JOIN s y ON x.u = y.u AND x.v < y.v WHERE (x.v, y.v) NOT IN (SELECT (a, b) FROM e) GROUP BY 1, 2 HAVING count(*) >= 3",
    "cross_folder_links": f"""WITH {_E}, {_PATHS}, j AS (SELECT a, b, {_DIR.format('x.path')} <> {_DIR.format('y.path')} AS far FROM e JOIN paths x ON x.node = a JOIN paths y ON y.node = b),
ends AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM j UNION ALL SELECT b FROM j) GROUP BY node)
SELECT (SELECT count(*) FROM j) AS n_links, (SELECT sum(far::INT) FROM j) AS n_cross, arg_max(node, (degree, -node)) AS busiest, max(degree) AS degree FROM ends""",
    "neighbourhood": f"WITH {_E} SELECT 0 AS pos, 1 AS node UNION ALL SELECT * FROM (SELECT row_number() OVER (ORDER BY round(w, 6) DESC, v) AS pos, v FROM sym WHERE u = 1) WHERE pos <= 39",
    "link_spread": f"""WITH {_POS}, ext AS (SELECT greatest(max(x) - min(x), max(y) - min(y)) AS ext FROM pos), l AS (SELECT len / ext AS part, greatest(p.d, q.d) AS busy FROM placed JOIN pd p ON p.u = a JOIN pd q ON q.u = b, ext)
SELECT CASE WHEN busy <= 8 THEN 8 WHEN busy <= 32 THEN 32 WHEN busy <= 128 THEN 128 WHEN busy <= 512 THEN 512 ELSE 0 END AS bucket, count(*) AS n_links, round(avg(part), 6) AS mean_length, round(100.0 * avg(CASE WHEN part > 0.25 THEN 1 ELSE 0 END), 6) AS crossing_pct FROM l GROUP BY 1""",
    "bimodality": f"""WITH {_POS}, mid AS (SELECT avg(x) AS cx, avg(y) AS cy FROM pos), r AS (SELECT sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM pos, mid), mm AS (SELECT avg(r) AS m FROM r),
mo AS (SELECT count(*) AS n, avg((r - m) ** 2) AS m2, avg((r - m) ** 3) AS m3, avg((r - m) ** 4) AS m4 FROM r, mm), k AS (SELECT n, m3 / m2 ** 1.5 AS s, m4 / m2 ** 2 AS k FROM mo)
SELECT n, round(s, 4) AS skew, round(k, 4) AS kurt, round((s ** 2 + 1) / k, 4) AS bimodality FROM k""",
    "highways": f"""WITH {_POS}, sz AS (SELECT label, count(*) AS k FROM pos GROUP BY label), v AS (SELECT round(len / (sqrt(p.k) + sqrt(q.k)), 9) AS v FROM placed JOIN sz p ON p.label = la JOIN sz q ON q.label = lb WHERE la <> lb)
SELECT count(*) AS n_links, round({_rank('v', 'v', 50)}, 6) AS p50, round({_rank('v', 'v', 90)}, 6) AS p90 FROM v""",
    "procrustes": f"""WITH {_POS}, j AS (SELECT x, y, x2, y2 FROM pos JOIN turned USING (node)), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(x2) AS mx2, avg(y2) AS my2 FROM j),
s AS (SELECT count(*) AS n, sum((x - mx) * (x2 - mx2) + (y - my) * (y2 - my2)) AS d, sum((x - mx) * (y2 - my2) - (y - my) * (x2 - mx2)) AS c, sum((x - mx) ** 2 + (y - my) ** 2) AS aa, sum((x2 - mx2) ** 2 + (y2 - my2) ** 2) AS bb FROM j, m)
SELECT n, round(sqrt(d * d + c * c) / aa, 4) AS scale, round(atan2(c, d), 4) AS angle, round(sqrt(greatest(0.0, bb - (d * d + c * c) / aa) / n), 4) AS rms FROM s""",
    "displacement": f"""WITH {_POS}, j AS (SELECT x2 - x AS dx, y2 - y AS dy FROM pos JOIN turned USING (node)), m AS (SELECT avg(dx) AS mx, avg(dy) AS my FROM j), v AS (SELECT round(sqrt((dx - mx) ** 2 + (dy - my) ** 2), 6) AS v FROM j, m)
SELECT count(*) AS n, count(*) FILTER (v > 0.3) AS moved, round({_rank('v', 'v', 50)}, 4) AS p50, round({_rank('v', 'v', 99)}, 4) AS p99 FROM v""",
}
