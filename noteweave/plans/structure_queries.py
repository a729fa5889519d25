"""Queries of the spatial, clustering, synthetic, wiki and incremental operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import geometry
from noteweave.operators import cluster, graph, parse, query, resolve, spatial
from noteweave.plans.graph_queries import nodes, positions
from noteweave.plans.text_queries import _RESOLVE
from noteweave.session import beside, cut, table
from noteweave.sources import mediawiki, synth
from noteweave.streaming import incremental


def _pos(spark: SparkSession, d: str) -> DataFrame:
    return positions(spark, d).select("node", F.col("label").cast("long").alias("component"), "x", "y")


def _e(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_edges(table(spark, d, "edges"))


def hilbert_order(spark: SparkSession, d: str) -> DataFrame:
    return spatial.curve_order(spatial.hilbert_keys(_pos(spark, d))).select("component", "pos", "node", "key")


def curve_spacing(spark: SparkSession, d: str) -> DataFrame:
    return spatial.curve_spacing(spatial.curve_order(spatial.hilbert_keys(_pos(spark, d))))


def curve_cells(spark: SparkSession, d: str) -> DataFrame:
    return spatial.curve_cells(spatial.curve_order(spatial.hilbert_keys(_pos(spark, d))))


def hex_cells(spark: SparkSession, d: str) -> DataFrame:
    h = _pos(spark, d).withColumn("h", geometry.hex_from_world(F.col("x"), F.col("y"), 0.1))
    return h.groupBy(F.col("h.q").alias("q"), F.col("h.r").alias("r")).agg(F.count(F.lit(1)).alias("n")).withColumn("ring", geometry.hex_distance(F.col("q"), F.col("r"), F.lit(0), F.lit(0)))


def ring_histogram(spark: SparkSession, d: str) -> DataFrame:
    return spatial.rings(_pos(spark, d))


def component_extents(spark: SparkSession, d: str) -> DataFrame:
    return spatial.component_extents(_pos(spark, d)).select("component", "n", *[F.round(c, 6).alias(c) for c in ("x", "y", "radius")])


def robust_radius(spark: SparkSession, d: str) -> DataFrame:
    return spatial.robust_radius(_pos(spark, d)).withColumn("radius", F.round("radius", 6))


def _two_levels(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("node", F.explode(F.array(F.struct(F.lit(0).alias("level"), F.pmod("node", F.lit(64)).alias("label")), F.struct(F.lit(1).alias("level"), F.pmod("node", F.lit(8)).alias("label")))).alias("l")).select("l.level", "node", "l.label")


def cell_web(spark: SparkSession, d: str) -> DataFrame:
    return spatial.cell_pairs(_e(spark, d), _two_levels(spark, d)).withColumn("w", F.round("w", 4))


def heaviest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return spatial.heaviest(cell_web(spark, d).filter("level = 0"), 5)


def _cells(spark: SparkSession, d: str) -> DataFrame:
    p = _pos(spark, d)
    low = spatial.cell_shapes(p.select(F.col("component").alias("cell"), "node"), p).withColumn("parent", F.lit(1000) + F.pmod("cell", F.lit(3)))
    top = spatial.cell_shapes(p.select((F.lit(1000) + F.pmod("component", F.lit(3))).cast("long").alias("cell"), "node"), p).withColumn("parent", F.lit(-1))
    return low.unionByName(top)


def sibling_overlap(spark: SparkSession, d: str) -> DataFrame:
    return spatial.sibling_overlap(_cells(spark, d))


def six_fold_order(spark: SparkSession, d: str) -> DataFrame:
    return spatial.six_fold(_cells(spark, d)).withColumn("psi", F.round("psi", 4))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    p = _pos(spark, d)
    leaf = spatial.curve_cells(spatial.curve_order(spatial.hilbert_keys(p)))
    fine = leaf.select(F.lit(0).alias("level"), "node", (F.col("component") * 1_000_000_000 + F.col("leaf")).alias("label"))
    coarse = p.select(F.lit(1).alias("level"), "node", F.col("component").alias("label"))
    return cut(spatial.tree_of(fine.unionByName(coarse), p))


def lod_cut(spark: SparkSession, d: str) -> DataFrame:
    return spatial.lod_cut(_tree(spark, d), 100.0, 8.0, 400).select("cell", "parent", "depth", "n")


def lod_links(spark: SparkSession, d: str) -> DataFrame:
    from noteweave.plans.graph_queries import position_edges

    t = _tree(spark, d)
    shown = cut(spatial.lod_cut(t, 100.0, 8.0, 400))
    budget = shown.agg(geometry.link_budget(F.count(F.lit(1))).alias("k")).first()["k"]
    return spatial.lifted_links(position_edges(spark, d), spatial.cut_of_notes(t, shown), budget)


def lod_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row on cuts of the whole and of a window: notes, notes no shown cell stands for, notes with several, notes of the window without one, cells beyond the budget."""
    t = _tree(spark, d)
    shown = cut(spatial.lod_cut(t, 100.0, 8.0, 400))
    box = (-0.05, -0.05, 0.05, 0.05)
    window = cut(spatial.lod_cut(t, 400.0, 8.0, 200, box))
    stands, inside = cut(spatial.cut_of_notes(t, shown)), spatial.cut_of_notes(t, window)
    notes = t.filter("node IS NOT NULL").select("node", "x", "y")
    row = notes.agg(F.count(F.lit(1)).alias("n_notes"))
    row = beside(row, notes.join(stands, "node", "left_anti").agg(F.count(F.lit(1)).alias("n_uncovered")))
    row = beside(row, stands.groupBy("node").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n_twice")))
    row = beside(row, notes.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])).join(inside, "node", "left_anti").agg(F.count(F.lit(1)).alias("n_unseen")))
    over = shown.agg(F.greatest(F.count(F.lit(1)) - 400, F.lit(0)).alias("n_over"))
    return beside(row, over)


def zoom_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: notes, notes without a zoom, notes whose way down has a jump below zero or none."""
    t = _tree(spark, d)
    row = spatial.resolve_zoom(t, 8.0).agg(F.count(F.lit(1)).alias("n_notes"), F.sum(F.coalesce((F.col("zoom") < 0).cast("int"), F.lit(1))).alias("n_without"))
    return beside(row, spatial.descent_travel(t).agg(F.sum(F.coalesce((F.col("travel") < 0).cast("int"), F.lit(1))).alias("n_backward"), F.count(F.lit(1)).alias("n_ways")))


def layout_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row on the layout: nodes, nodes without a place, and whether linked nodes of a group lie nearer than nodes of a group do."""
    from noteweave.plans.graph_queries import position_edges

    labels = _pos(spark, d).select("node", F.col("component").alias("label"))
    e = position_edges(spark, d)
    p = cut(spatial.force_layout(e, labels)).join(labels, "node")
    q = p.select(F.col("node").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("label").alias("l2"))
    apart = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    linked = e.join(p.withColumnRenamed("node", "a"), "a").join(q, "b").filter("label = l2").agg(F.avg(apart).alias("linked"))
    mid = p.groupBy("label").agg(F.avg("x").alias("x2"), F.avg("y").alias("y2"))
    spread = p.join(mid, "label").agg((2 * F.avg(apart)).alias("spread"))
    row = labels.join(p.select("node", "x", "y"), "node", "left").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum((F.col("x").isNull() | F.isnan("x") | F.isnan("y")).cast("int")).alias("n_unplaced"))
    return beside(beside(row, linked), spread).select("n_nodes", "n_unplaced", (F.col("linked") < F.col("spread")).alias("nearer"))


def resolve_zoom(spark: SparkSession, d: str) -> DataFrame:
    return spatial.resolve_zoom(_tree(spark, d), 8.0)


def layout(spark: SparkSession, d: str) -> DataFrame:
    labels = _pos(spark, d).select("node", F.col("component").alias("label"))
    from noteweave.plans.graph_queries import position_edges

    return spatial.force_layout(position_edges(spark, d), labels)


def _note_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Living notes and all that link to them as nodes, resolved links between two notes as edges."""
    links = table(spark, d, "links").dropDuplicates(["link_id"])
    notes = table(spark, d, "notes")
    r = resolve.resolved_links(links, notes, table(spark, d, "aliases")).filter("resolved")
    ends = r.select(F.xxhash64("src_key").alias("a"), F.xxhash64("dst_key").alias("b"), F.lit(1.0).alias("w"))
    e = cut(graph.simple_edges(ends))
    every = resolve.living(notes).select(F.xxhash64("note_key").alias("node")).unionByName(e.select(F.explode(F.array("a", "b")).alias("node")))
    return cut(every.distinct()), e


def communities(spark: SparkSession, d: str) -> DataFrame:
    n, e = _note_graph(spark, d)
    return cluster.communities(n, e)


def _checked(n: DataFrame, e: DataFrame, levels: DataFrame) -> DataFrame:
    """One row on labels of levels: nodes, nodes without a label on the finest, groups in several parts, labels that
    are no node of their group, and levels that do not have fewer groups than the one below."""
    levels = cut(levels)
    fine = levels.filter("level = 0").select("node", "label")
    parts = cluster.connected_parts(e, fine).withColumnRenamed("label", "part").join(fine, "node").groupBy("label").agg(F.count_distinct("part").alias("k"))
    groups = levels.groupBy("level").agg(F.count_distinct("label").alias("k"))
    above = groups.select((F.col("level") - 1).alias("level"), F.col("k").alias("k2"))
    row = n.agg(F.count(F.lit(1)).alias("n_nodes"))
    row = beside(row, n.join(fine, "node", "left_anti").agg(F.count(F.lit(1)).alias("n_unlabelled")))
    row = beside(row, parts.filter("k > 1").agg(F.count(F.lit(1)).alias("n_apart")))
    row = beside(row, levels.groupBy("level", "label").agg(F.min("node").alias("low")).filter("low <> label AND label <> -1").agg(F.count(F.lit(1)).alias("n_misnamed")))
    return beside(row, groups.join(above, "level").filter("k2 >= k").agg(F.count(F.lit(1)).alias("n_idle_levels")))


def community_checks(spark: SparkSession, d: str) -> DataFrame:
    n, e = _note_graph(spark, d)
    return _checked(n, e, cluster.communities(n, e))


def community_checks_parallel(spark: SparkSession, d: str) -> DataFrame:
    """The same where every component above 20 edges begins with parallel moves."""
    n, e = _note_graph(spark, d)
    return _checked(n, e, cluster.communities(n, e, 20))


def communities_parallel(spark: SparkSession, d: str) -> DataFrame:
    return cluster.parallel_moves(_e(spark, d))


def community_gain(spark: SparkSession, d: str) -> DataFrame:
    """One row better: do the communities, the parallel ones and the regions all beat one group a node, by modularity?"""
    n, e = _note_graph(spark, d)
    found = cut(cluster.communities(n, e))
    labels = [found.filter("level = 0").select("node", "label"), cluster.parallel_moves(e), cluster.region_labels(found), n.select("node", F.col("node").alias("label"))]
    q = [graph.modularity(e, x).first()["q"] for x in labels]
    return spark.createDataFrame([(all(x > q[3] + 0.1 for x in q[:3]), q[1] > q[0] - 0.1)], "better boolean, parallel_is_near boolean")


def coarsening_ladder(spark: SparkSession, d: str) -> DataFrame:
    n, e = _note_graph(spark, d)
    reports = [cluster.ladder_report(cluster.coarsening(n, e, arity), arity).withColumn("arity", F.lit(arity)) for arity in (4, 7)]
    return reports[0].unionByName(reports[1])


def ladder_checks(spark: SparkSession, d: str) -> DataFrame:
    """For arity 4 and 7: nodes, nodes on no level, groups of more than arity groups of the level below."""
    n, e = _note_graph(spark, d)
    rows = []
    for arity in (4, 7):
        levels = cut(cluster.coarsening(n, e, arity))
        below = levels.select((F.col("level") + 1).alias("level"), "node", F.col("label").alias("low"))
        wide = levels.filter("label <> -1").join(below, ["level", "node"], "left").groupBy("level", "label").agg(F.count_distinct(F.coalesce("low", "node")).alias("k")).filter(F.col("k") > arity)
        row = n.agg(F.lit(arity).alias("arity"), F.count(F.lit(1)).alias("n_nodes"))
        row = beside(row, n.join(levels.filter("level = 0"), "node", "left_anti").agg(F.count(F.lit(1)).alias("n_unlabelled")))
        rows.append(beside(row, wide.agg(F.count(F.lit(1)).alias("n_wide"))))
    return rows[0].unionByName(rows[1])


def ladder_tree(spark: SparkSession, d: str) -> DataFrame:
    """One row on the tree of cells: notes in it, cells with a single child, cells that reach beyond their parent, notes missing in their run."""
    n, e = _note_graph(spark, d)
    levels = cut(cluster.coarsening(n, e).filter("label <> -1"))
    tree = cut(cluster.tree_cells(levels))
    kids = tree.groupBy("parent_first", "parent_last").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("inside")).filter("parent_first IS NOT NULL")
    row = tree.filter("depth = 0").agg(F.sum("n").alias("n_notes"))
    row = beside(row, kids.filter("k = 1 AND inside = parent_last - parent_first + 1").agg(F.count(F.lit(1)).alias("n_single")))
    row = beside(row, tree.filter("parent_first IS NOT NULL AND (first < parent_first OR last > parent_last)").agg(F.count(F.lit(1)).alias("n_beyond")))
    return beside(row, tree.filter("n <> last - first + 1").agg(F.count(F.lit(1)).alias("n_gaps")))


def region_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.region_labels(cut(communities(spark, d)))


def region_sizes(spark: SparkSession, d: str) -> DataFrame:
    """One row on regions after specks were merged and large groups split: nodes, nodes lost, specks left that have a neighbour."""
    n, e = _note_graph(spark, d)
    found = cluster.region_labels(cut(cluster.communities(n, e)))
    merged = cluster.merged_specks(cut(found), e, 8)
    split = cut(cluster.split_oversized(merged, e, 256))
    sizes = merged.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    c = graph.contracted(e, merged).filter("a <> b")
    near = c.select(F.explode(F.array("a", "b")).alias("label")).distinct()
    row = n.agg(F.count(F.lit(1)).alias("n_nodes"))
    row = beside(row, n.join(split, "node", "left_anti").agg(F.count(F.lit(1)).alias("n_lost")))
    return beside(row, sizes.filter("k < 8").join(near, "label").agg(F.count(F.lit(1)).alias("n_specks")))


def heavy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row on heavy-edge matching of the note graph: nodes, groups above four, groups not joined by links."""
    _, e = _note_graph(spark, d)
    labels = cut(cluster.heavy_groups(e))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    parts = cluster.connected_parts(e, labels).withColumnRenamed("label", "part").join(labels, "node").groupBy("label").agg(F.count_distinct("part").alias("k"))
    row = labels.agg(F.count(F.lit(1)).alias("n_nodes"))
    row = beside(row, sizes.filter("k > 4").agg(F.count(F.lit(1)).alias("n_large")))
    return beside(row, parts.filter("k > 1").agg(F.count(F.lit(1)).alias("n_apart")))


def matched_groups(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return graph.matched_groups(n.select("node", F.pmod("node", F.lit(10)).alias("label")), n.select("node", F.pmod("node", F.lit(3)).alias("label")))


def sibling_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.sibling_pairs(_e(spark, d), _two_levels(spark, d)).withColumn("w", F.round("w", 4))


def outside_pull(spark: SparkSession, d: str) -> DataFrame:
    return graph.outside_pull(_e(spark, d), _two_levels(spark, d)).withColumn("w", F.round("w", 4))


def level_report(spark: SparkSession, d: str) -> DataFrame:
    return graph.level_report(_e(spark, d), _two_levels(spark, d))


def community_shapes(spark: SparkSession, d: str) -> DataFrame:
    return graph.community_shapes(cut(_e(spark, d)), nodes(spark, d).select("node", F.floor(F.col("node") / 16).alias("label")))


def cocitation_ratio(spark: SparkSession, d: str) -> DataFrame:
    from noteweave.plans.graph_queries import position_edges

    return graph.cocitation_ratio(position_edges(spark, d), positions(spark, d), 2)


def descent_travel(spark: SparkSession, d: str) -> DataFrame:
    return spatial.descent_travel(_tree(spark, d))


def hex_spiral(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select("id", geometry.hex_spiral(F.col("id")).alias("h")).select("id", "h.q", "h.r")


def chain_synth(spark: SparkSession, d: str) -> DataFrame:
    return synth.chain(spark, 5000, skip=7)


def motif_synth(spark: SparkSession, d: str) -> DataFrame:
    return synth.motifs(spark, 5000)


def hub_synth(spark: SparkSession, d: str) -> DataFrame:
    return synth.hub(spark, 5000)


def synth_summary(spark: SparkSession, d: str) -> DataFrame:
    from functools import reduce

    out = []
    for shape in ("islands", "bipartite", "scale_free", "communities"):
        g = synth.graph(spark, f"synth:5000:{shape}:6")
        out.append(g.agg(F.lit(shape).alias("shape"), F.count(F.lit(1)).alias("m"), F.count_distinct("a").alias("n_a")))
    return reduce(DataFrame.unionByName, out)


def synth_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row on a made vault: notes, links lost between graph and parsed text, whether bridges join components and about a tenth of notes lies elsewhere."""
    e = cut(synth.graph(spark, "synth:3000:islands:4"))
    every = spark.range(3000).select(F.col("id").alias("node"))
    c = cut(graph.components(every, e))
    scanned = parse.scanned(synth.documents(spark, 3000, e))
    links = parse.child(scanned, "links").select(F.regexp_extract("note_key", "([0-9]+)", 1).cast("long").alias("a"), F.regexp_extract("raw", "([0-9]+)", 1).cast("long").alias("b"))
    after = graph.components(every, e.unionByName(synth.bridges(c, 0.05)))
    paths = synth.folder_paths(c).select("node", F.regexp_extract("path", "^(.*)/", 1).alias("dir")).join(c, "node")
    home = paths.groupBy("component", "dir").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.max("k").alias("most"), F.sum("k").alias("size"))
    row = scanned.agg(F.count(F.lit(1)).alias("n_notes"))
    row = beside(row, e.join(links, ["a", "b"], "left_anti").agg(F.count(F.lit(1)).alias("n_lost")))
    row = beside(row, after.agg((F.count_distinct("component") < c.select("component").distinct().count()).alias("joined")))
    return beside(row, home.agg((1 - F.sum("most") / F.sum("size")).between(0.02, 0.15).alias("leaked")))


def wiki_titles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "wiki_pages").select("page_id", "title").distinct()
    return p.select("page_id", mediawiki.canon(F.col("title")).alias("title"), mediawiki.safe_stem(mediawiki.canon(F.col("title"))).alias("stem"), mediawiki.is_namespaced(F.col("title")).alias("namespaced"))


def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    return mediawiki.resolve_redirects(table(spark, d, "wiki_pages"))


def wiki_import_report(spark: SparkSession, d: str) -> DataFrame:
    return mediawiki.import_report(table(spark, d, "wiki_pages"))


def _state(spark: SparkSession, d: str, upto: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("ts") < F.lit(upto).cast("timestamp_ntz"))
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("v")).select("user_id", "v.*")
    return last.select(F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.concat_ws(":", "event_type", F.col("value").cast("decimal(12,2)").cast("string")).alias("hash"), F.col("ts").alias("mtime"))


CUTS = ("2024-01-02 00:00:00", "2024-01-05 00:00:00")


def incremental_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return incremental.outcomes(_state(spark, d, CUTS[0]), _state(spark, d, CUTS[1]))


def missing_rows(spark: SparkSession, d: str) -> DataFrame:
    return incremental.missing(_state(spark, d, CUTS[1]), _state(spark, d, CUTS[0]), complete=True).select("path", "hash")


def _link_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    links = table(spark, d, "links").dropDuplicates(["link_id"]).filter("raw IS NOT NULL").select("src_key", F.col("raw").alias("dst_key"), "seen_at")
    at = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    return links.filter(F.col("seen_at").cast("timestamp_ntz") < at).drop("seen_at"), links.drop("seen_at")


def same_edges(spark: SparkSession, d: str) -> DataFrame:
    return incremental.same_edges(*_link_states(spark, d))


def dirty_overlay(spark: SparkSession, d: str) -> DataFrame:
    old, new = _link_states(spark, d)
    overlay = new.filter("src_key LIKE 'daily/%'")
    return incremental.with_overlay(old, overlay).groupBy("src_key").agg(F.count(F.lit(1)).alias("n"))


def link_signatures(spark: SparkSession, d: str) -> DataFrame:
    old, new = _link_states(spark, d)
    a, b = incremental.link_signatures(old), incremental.link_signatures(new).withColumnRenamed("signature", "s2")
    j = a.join(b, "node", "full")
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("signature").eqNullSafe(F.col("s2")).cast("long")).alias("n_same"))


def event_routes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, ".png").when(F.col("event_id") % 7 == 0, ".txt").otherwise(".md")).alias("path"),
        F.when(F.col("event_id") % 11 == 0, "rename").otherwise("write").alias("kind"),
        F.concat(F.lit("old/"), F.col("user_id").cast("string"), F.lit(".md")).alias("old_path"),
        F.lit(False).alias("truncated"),
    )
    return incremental.pending(incremental.routed(e))


def note_meta(spark: SparkSession, d: str) -> DataFrame:
    return query.current_notes(table(spark, d, "notes")).select("note_key", "size", "stem_fold")


QUERIES = {f.__name__: f for f in (
    hilbert_order, curve_spacing, curve_cells, hex_cells, ring_histogram, component_extents, robust_radius, cell_web, heaviest_neighbours, sibling_overlap, six_fold_order,
    lod_cut, lod_links, lod_checks, zoom_checks, layout_checks, resolve_zoom, layout, communities, community_checks, community_checks_parallel, communities_parallel, community_gain, coarsening_ladder, ladder_checks, ladder_tree, region_labels, region_sizes, heavy_pairs, matched_groups, sibling_pairs, outside_pull, level_report, community_shapes, cocitation_ratio, descent_travel, hex_spiral, chain_synth, motif_synth, hub_synth, synth_summary, synth_checks,
    wiki_titles, redirect_resolve, wiki_import_report, incremental_outcomes, missing_rows, same_edges, dirty_overlay, link_signatures, event_routes, note_meta,
)}

_P = "p AS (SELECT vec_id AS node, label::BIGINT AS component, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_WEB = """e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(coalesce(w, 0)) AS w FROM edges WHERE a <> b GROUP BY 1, 2),
web AS (SELECT 0 AS level, least(a % 64, b % 64) AS u, greatest(a % 64, b % 64) AS v, round(sum(w), 4) AS w FROM e WHERE a % 64 <> b % 64 GROUP BY 1, 2, 3
  UNION ALL SELECT 1, least(a % 8, b % 8), greatest(a % 8, b % 8), round(sum(w), 4) FROM e WHERE a % 8 <> b % 8 GROUP BY 1, 2, 3)"""
_CELLS = f"""{_P}, m AS (SELECT component AS cell, 1000 + component % 3 AS parent, x, y FROM p UNION ALL SELECT 1000 + component % 3, -1, x, y FROM p),
mid AS (SELECT cell, parent, avg(x) AS x, avg(y) AS y FROM m GROUP BY cell, parent), cells AS (SELECT mid.*, (SELECT max(sqrt((m.x - mid.x) ** 2 + (m.y - mid.y) ** 2)) FROM m WHERE m.cell = mid.cell) AS radius FROM mid)"""
_T = "regexp_replace(regexp_replace({}, '^[ \\t\\n_]+|[ \\t\\n_]+$', '', 'g'), '[ _]+', ' ', 'g')"


def _canon(x: str) -> str:
    t = _T.format(x)
    return f"(CASE WHEN regexp_matches({t}, '^[a-z]') THEN upper(substr({t}, 1, 1)) || substr({t}, 2) ELSE {t} END)"


_SAFE = "regexp_replace(regexp_replace({}, '[\\x00-\\x1f<>:\"/\\\\|?*#\\[\\]]', '-', 'g'), '[. ]+$', '')"
_LATEST = "latest AS (SELECT * FROM wiki_pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY landed_at DESC, title DESC) = 1)"
_STATE = "SELECT 'user/' || user_id || '.md' AS path, event_type || ':' || value::DECIMAL(12, 2) AS hash, ts AS mtime FROM events WHERE ts < TIMESTAMP '{}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_STATES = f"o AS ({_STATE.format(CUTS[0])}), n AS ({_STATE.format(CUTS[1])})"
_LINKS = "l AS (SELECT DISTINCT link_id, src_key, raw, seen_at FROM links WHERE raw IS NOT NULL)"

_NOTE_GRAPH = f"""{_RESOLVE},
linked AS (SELECT DISTINCT least(src_key, dst_key) AS a, greatest(src_key, dst_key) AS b FROM resolved WHERE resolved AND src_key <> dst_key),
ends AS (SELECT a AS node FROM linked UNION SELECT b FROM linked),
members AS (SELECT DISTINCT note_key AS node FROM living UNION SELECT node FROM ends)"""
_HILBERT = f"""{_P}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
grid AS (SELECT node, component, p.x AS px, p.y AS py, greatest(0, least(65535, floor((p.x - x0) / (x1 - x0) * 65535)))::BIGINT AS x, greatest(0, least(65535, floor((p.y - y0) / (y1 - y0) * 65535)))::BIGINT AS y FROM p, box),
walk AS (
  SELECT node, x, y, 0::BIGINT AS key, 32768::BIGINT AS s FROM grid UNION ALL
  SELECT node, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN 65535 - y ELSE y END ELSE x END, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN 65535 - x ELSE x END ELSE y END,
    key + s * s * xor(3 * ((x & s) > 0)::BIGINT, ((y & s) > 0)::BIGINT), s >> 1 FROM walk WHERE s > 0),
curve AS (SELECT component, row_number() OVER (PARTITION BY component ORDER BY key, node) - 1 AS pos, node, key, px, py FROM walk JOIN grid USING (node) WHERE s = 0)"""

ORACLE = {
    "community_checks": f"WITH {_NOTE_GRAPH} SELECT count(*) AS n_nodes, 0 AS n_unlabelled, 0 AS n_apart, 0 AS n_misnamed, 0 AS n_idle_levels FROM members",
    "community_checks_parallel": f"WITH {_NOTE_GRAPH} SELECT count(*) AS n_nodes, 0 AS n_unlabelled, 0 AS n_apart, 0 AS n_misnamed, 0 AS n_idle_levels FROM members",
    "lod_checks": "SELECT count(*) AS n_notes, 0 AS n_uncovered, 0 AS n_twice, 0 AS n_unseen, 0 AS n_over FROM embeddings",
    "zoom_checks": "SELECT count(*) AS n_notes, 0 AS n_without, 0 AS n_backward, count(*) AS n_ways FROM embeddings",
    "layout_checks": "SELECT count(*) AS n_nodes, 0 AS n_unplaced, true AS nearer FROM embeddings",
    "synth_checks": "SELECT 3000 AS n_notes, 0 AS n_lost, true AS joined, true AS leaked",
    "community_gain": "SELECT true AS better, true AS parallel_is_near",
    "ladder_checks": f"WITH {_NOTE_GRAPH} SELECT unnest([4, 7]) AS arity, count(*) AS n_nodes, 0 AS n_unlabelled, 0 AS n_wide FROM members",
    "ladder_tree": f"WITH {_NOTE_GRAPH} SELECT count(*) AS n_notes, 0 AS n_single, 0 AS n_beyond, 0 AS n_gaps FROM ends",
    "region_sizes": f"WITH {_NOTE_GRAPH} SELECT count(*) AS n_nodes, 0 AS n_lost, 0 AS n_specks FROM members",
    "heavy_pairs": f"WITH {_NOTE_GRAPH} SELECT count(*) AS n_nodes, 0 AS n_large, 0 AS n_apart FROM ends",
    "matched_groups": """WITH RECURSIVE nodes AS (SELECT note_id AS node FROM notes UNION SELECT hub_id FROM hub_titles UNION SELECT a FROM edges WHERE a IS NOT NULL UNION SELECT b FROM edges WHERE b IS NOT NULL),
o AS (SELECT node % 10 AS old, node % 3 AS new, count(*) AS n FROM nodes GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, old, new) AS i FROM o),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS olds, []::BIGINT[] AS news, []::BIGINT[] AS taken UNION ALL
  SELECT j, CASE WHEN ok THEN list_append(olds, old) ELSE olds END, CASE WHEN ok THEN list_append(news, new) ELSE news END, CASE WHEN ok THEN list_append(taken, j) ELSE taken END
  FROM (SELECT w.olds, w.news, w.taken, r.i AS j, r.old, r.new, NOT list_contains(olds, r.old) AND NOT list_contains(news, r.new) AS ok FROM walk w JOIN ranked r ON r.i = w.i + 1))
SELECT old, new, n FROM ranked WHERE list_contains((SELECT taken FROM walk ORDER BY i DESC LIMIT 1), i)""",
    "hilbert_order": f"WITH RECURSIVE {_HILBERT} SELECT component, pos, node, key FROM curve",
    "curve_spacing": f"""WITH RECURSIVE {_HILBERT}, gaps AS (SELECT component, sqrt((lead(px) OVER w - px) ** 2 + (lead(py) OVER w - py) ** 2) AS g FROM curve WINDOW w AS (PARTITION BY component ORDER BY pos)),
r AS (SELECT component, g, row_number() OVER (PARTITION BY component ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY component) AS n FROM gaps WHERE g IS NOT NULL)
SELECT component, n AS n_gaps, g AS spacing FROM r WHERE i = n // 2""",
    "hex_cells": f"""WITH {_P}, f AS (SELECT x / (0.1 * sqrt(3)) - y / 0.15 / 2 AS fq, y / 0.15 AS fr FROM p),
r AS (SELECT fq, fr, round_even(fq, 0) AS q, round_even(fr, 0) AS r, round_even(-fq - fr, 0) AS s FROM f),
d AS (SELECT *, abs(q - fq) AS dq, abs(r - fr) AS dr, abs(s + fq + fr) AS ds FROM r),
c AS (SELECT (CASE WHEN dq > dr AND dq > ds THEN -r - s ELSE q END)::INT AS q, (CASE WHEN dq > dr AND dq > ds THEN r WHEN dr > ds THEN -q - s ELSE r END)::INT AS r FROM d)
SELECT q, r, count(*) AS n, (abs(q) + abs(r) + abs(q + r)) // 2 AS ring FROM c GROUP BY q, r""",
    "hex_spiral": """WITH k AS (SELECT i AS id, ceil((sqrt(12 * i + 9) - 3) / 6)::INT AS k FROM range(1000) t(i)),
j AS (SELECT id, k, CASE WHEN k > 0 THEN (id - (3 * k * (k - 1) + 1)) // k ELSE -1 END AS side, CASE WHEN k > 0 THEN (id - (3 * k * (k - 1) + 1)) % k ELSE 0 END AS i FROM k)
SELECT id, CASE side WHEN 0 THEN k - i WHEN 1 THEN -i WHEN 2 THEN -k WHEN 3 THEN i - k WHEN 4 THEN i WHEN 5 THEN k ELSE 0 END AS q,
  CASE side WHEN 0 THEN i WHEN 1 THEN k WHEN 2 THEN k - i WHEN 3 THEN -i WHEN 4 THEN -k WHEN 5 THEN i - k ELSE 0 END AS r FROM j""",
    "ring_histogram": f"WITH {_P}, f AS (SELECT max(x * x + y * y) AS far FROM p) SELECT least(7, floor((x * x + y * y) / far * 8))::INT AS ring, count(*) AS n FROM p, f GROUP BY 1",
    "component_extents": f"WITH {_P}, m AS (SELECT component, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY component) SELECT component, n, round(cx, 6) AS x, round(cy, 6) AS y, round(max(sqrt((p.x - cx) ** 2 + (p.y - cy) ** 2)), 6) AS radius FROM p JOIN m USING (component) GROUP BY component, n, cx, cy",
    "robust_radius": f"""WITH {_P}, m AS (SELECT component, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY component),
r AS (SELECT component, n, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r, row_number() OVER (PARTITION BY component ORDER BY sqrt((x - cx) ** 2 + (y - cy) ** 2)) - 1 AS i FROM p JOIN m USING (component))
SELECT component, n, round(r, 6) AS radius FROM r WHERE i = least(n * 99 // 100, n - 1)""",
    "cell_web": f"WITH {_WEB} SELECT * FROM web",
    "heaviest_neighbours": f"WITH {_WEB}, s AS (SELECT u, v, w FROM web WHERE level = 0 UNION ALL SELECT v, u, w FROM web WHERE level = 0) SELECT * FROM (SELECT u, v, w, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS rank FROM s) WHERE rank <= 5",
    "sibling_overlap": f"WITH {_CELLS}, d AS (SELECT a.radius + b.radius - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM cells a JOIN cells b ON a.parent = b.parent AND a.cell < b.cell) SELECT count(*) AS n_pairs, round(100.0 * avg(CASE WHEN d > 0 THEN 1 ELSE 0 END), 6) AS overlap_pct, round(avg(CASE WHEN d > 0 THEN d END), 6) AS penetration FROM d",
    "six_fold_order": f"WITH {_CELLS}, t AS (SELECT c.parent, 6 * atan2(c.y - u.y, c.x - u.x) AS t FROM cells c JOIN cells u ON u.cell = c.parent) SELECT parent, count(*) AS n, round(sqrt(avg(cos(t)) ** 2 + avg(sin(t)) ** 2), 4) AS psi FROM t GROUP BY parent",
    "sibling_pairs": f"""WITH {_WEB}, t AS (SELECT CASE WHEN a % 8 <> b % 8 THEN 1 ELSE 0 END AS level, CASE WHEN a % 8 <> b % 8 THEN 8 ELSE 64 END AS k, a, b, w FROM e WHERE a % 64 <> b % 64)
SELECT level, least(a % k, b % k) AS u, greatest(a % k, b % k) AS v, round(sum(w), 4) AS w FROM t GROUP BY 1, 2, 3""",
    "outside_pull": f"""WITH {_WEB}, x AS (SELECT 0 AS level, a % 64 AS u, b % 64 AS v, w FROM e UNION ALL SELECT 1, a % 8, b % 8, w FROM e)
SELECT level, label, round(sum(w), 4) AS w FROM (SELECT level, u AS label, w FROM x WHERE u <> v UNION ALL SELECT level, v, w FROM x WHERE u <> v) GROUP BY 1, 2""",
    "level_report": f"""WITH {_WEB}, x AS (SELECT 0 AS level, a % 64 AS u, b % 64 AS v, w FROM e UNION ALL SELECT 1, a % 8, b % 8, w FROM e),
m AS (SELECT level, sum(w) AS m, sum(CASE WHEN u = v THEN w ELSE 0 END) AS inside FROM x GROUP BY level), t AS (SELECT level, label, sum(w) AS tot FROM (SELECT level, u AS label, w FROM x UNION ALL SELECT level, v, w FROM x) GROUP BY 1, 2),
nodes AS (SELECT note_id AS node FROM notes UNION SELECT hub_id FROM hub_titles UNION SELECT a FROM edges WHERE a IS NOT NULL UNION SELECT b FROM edges WHERE b IS NOT NULL),
s AS (SELECT level, count(*) AS groups, max(k) AS largest FROM (SELECT 0 AS level, node % 64 AS g, count(*) AS k FROM nodes GROUP BY 2 UNION ALL SELECT 1, node % 8, count(*) FROM nodes GROUP BY 2) GROUP BY level)
SELECT s.level, groups, largest, round(inside / m - (SELECT sum((tot / (2 * m.m)) ** 2) FROM t WHERE t.level = s.level), 9) AS q, round(inside / m, 9) AS intra_fraction FROM s JOIN m USING (level)""",
    "chain_synth": "SELECT i AS a, i + 1 AS b FROM range(4999) t(i) UNION ALL SELECT i, i + 7 FROM range(4993) t(i) WHERE i % 7 = 0",
    "motif_synth": """WITH n AS (SELECT i, i % 22 AS p, i - i % 22 AS base FROM range(5000) t(i)), m AS (SELECT i, CASE WHEN p < 2 THEN base WHEN p < 5 THEN base + 2 WHEN p < 11 THEN base + 5 WHEN p < 15 THEN base + 11 ELSE base + 15 END AS s,
  CASE WHEN p < 2 THEN 2 WHEN p < 5 THEN 3 WHEN p < 11 THEN 6 WHEN p < 15 THEN 4 ELSE 7 END AS k FROM n)
SELECT least(i, b) AS a, greatest(i, b) AS b FROM (SELECT i, k, CASE WHEN i = s + k - 1 THEN s ELSE i + 1 END AS b FROM m) WHERE b < 5000 AND NOT (k = 2 AND b < i)""",
    "hub_synth": "SELECT 0 AS a, i AS b FROM range(1, 5000) t(i)",
    "wiki_titles": f"SELECT page_id, c AS title, {_SAFE.format('c')} AS stem, regexp_matches(title, '^:|^[^:]+:([^ ]|$)') AS namespaced FROM (SELECT DISTINCT page_id, title, {_canon('title')} AS c FROM wiki_pages)",
    "redirect_resolve": f"""WITH {_LATEST}, own AS (SELECT *, {_canon('title')} AS key FROM latest), known AS (SELECT key, min(CASE WHEN coalesce(redirect, '') = '' THEN 1 ELSE 0 END) AS plain FROM own WHERE alive AND ns = '0' GROUP BY key),
asked AS (SELECT page_id, title, {_canon("split_part(redirect, '#', 1)")} AS dest FROM own WHERE redirect <> '')
SELECT page_id, title, dest AS leads_to, CASE WHEN plain IS NULL THEN 'red' WHEN plain = 1 THEN 'article' ELSE 'redirect' END AS state FROM asked LEFT JOIN known ON known.key = dest""",
    "wiki_import_report": f"""WITH {_LATEST}, s AS (SELECT count(*) - 1 AS extra FROM latest WHERE ns = '0' AND coalesce(redirect, '') = '' GROUP BY {_SAFE.format(_canon('title'))})
SELECT count(*) AS pages, count(*) FILTER (ns = '0' AND coalesce(redirect, '') = '') AS articles, count(*) FILTER (redirect <> '') AS redirects, count(*) FILTER (regexp_matches(title, '^:|^[^:]+:([^ ]|$)')) AS namespaced, sum(n_bytes)::BIGINT AS bytes, (SELECT sum(extra)::BIGINT FROM s) AS collisions FROM latest""",
    "incremental_outcomes": f"""WITH {_STATES} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'vanished' WHEN o.hash <> n.hash THEN 'rewrote' WHEN o.mtime = n.mtime THEN 'unchanged' ELSE 'touched' END AS outcome FROM o FULL JOIN n ON o.path = n.path""",
    "missing_rows": f"WITH {_STATES} SELECT path, hash FROM n WHERE path NOT IN (SELECT path FROM o)",
    "same_edges": f"""WITH {_LINKS}, a AS (SELECT src_key, raw, count(*) AS n1 FROM l WHERE seen_at < TIMESTAMP '2025-06-01' GROUP BY 1, 2), b AS (SELECT src_key, raw, count(*) AS n2 FROM l GROUP BY 1, 2)
SELECT src_key, bool_and(n1 IS NOT DISTINCT FROM n2) AS same FROM a FULL JOIN b USING (src_key, raw) GROUP BY src_key""",
    "dirty_overlay": f"WITH {_LINKS} SELECT src_key, count(*) AS n FROM l WHERE seen_at < TIMESTAMP '2025-06-01' OR src_key LIKE 'daily/%' GROUP BY src_key",
    "link_signatures": f"""WITH {_LINKS}, o AS (SELECT src_key AS x, raw AS y FROM l WHERE seen_at < TIMESTAMP '2025-06-01'), n AS (SELECT src_key AS x, raw AS y FROM l),
a AS (SELECT x, list_sort(list(y)) AS s FROM (SELECT x, y FROM o UNION SELECT y, x FROM o) GROUP BY x), b AS (SELECT x, list_sort(list(y)) AS s FROM (SELECT x, y FROM n UNION SELECT y, x FROM n) GROUP BY x)
SELECT count(*) AS n, count(*) FILTER (a.s IS NOT DISTINCT FROM b.s) AS n_same FROM a FULL JOIN b USING (x)""",
    "event_routes": """WITH e AS (SELECT event_id, 'user/' || user_id || CASE WHEN event_id % 5 = 0 THEN '.png' WHEN event_id % 7 = 0 THEN '.txt' ELSE '.md' END AS path, 'old/' || user_id || '.md' AS old FROM events),
r AS (SELECT path FROM e UNION ALL SELECT old FROM e WHERE event_id % 11 = 0) SELECT path, min(CASE WHEN path LIKE '%.png' THEN 'sweep' ELSE 'read' END) AS action FROM r WHERE path NOT LIKE '%.txt' GROUP BY path""",
    "note_meta": "SELECT note_key, size, stem_fold FROM notes WHERE alive AND NOT phantom QUALIFY row_number() OVER (PARTITION BY note_key ORDER BY landed_at DESC, mtime DESC, title DESC, coalesce(size, -1) DESC) = 1",
}
