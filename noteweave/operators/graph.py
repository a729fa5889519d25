"""Statistics of the link graph: degrees, components, clustering, partitions, shapes.

Edges are (a, b, w). ``simple_edges`` gives the undirected graph without
loops and repeats that most measures take; nodes is (node).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.text import dir_of, quantise_significant, size_bucket
from noteweave.session import beside, cut

PERCENTILES = (50, 90, 99)


def simple_edges(edges: DataFrame) -> DataFrame:
    """(a, b, w, n) with a < b: undirected distinct pairs, summed weight, number of rows.

    Loops and rows with a NULL end are dropped; a NULL weight counts as 0.
    """
    some = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return some.select(lo, hi, F.coalesce("w", F.lit(0.0)).alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def edge_directions(edges: DataFrame) -> DataFrame:
    """(a, b, forward): distinct undirected pairs and whether the smaller direction occurs."""
    some = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    return some.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.col("a") < F.col("b")).alias("forward"))


def both_ways(e: DataFrame) -> DataFrame:
    """(u, v, w): each undirected edge from both ends."""
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "w"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    return e.select(F.explode(ends).alias("e")).select("e.*")


def degrees(nodes: DataFrame, e: DataFrame, multigraph: bool = False) -> DataFrame:
    """(node, degree) of every node; with ``multigraph`` repeated edges count each time."""
    one = F.col("n") if multigraph else F.lit(1)
    ends = e.select(F.explode(F.array("a", "b")).alias("node"), one.alias("n")).groupBy("node").agg(F.sum("n").alias("degree"))
    return nodes.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def at_rank(histogram: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], buckets: int = 4096) -> DataFrame:
    """(keys, n, names): values of given ranks, from 0, in a histogram (keys, v, c).

    ``ranks`` maps a name to the rank as a function of n. Values fall into
    equal ranges, the ranges are counted and added up, and only inside a range
    are values ordered, so neither a table nor a key is ranked by one task.
    """
    h = histogram.groupBy(*keys, "v").agg(F.sum("c").alias("c"))
    ends = h.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.sum("c").alias("n"))
    j = h.join(ends, keys) if keys else beside(h, ends)
    part = (F.col("v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets
    j = j.withColumn("__b", F.when(F.col("__hi") > F.col("__lo"), F.floor(part)).otherwise(0).cast("long"))
    per = j.groupBy(*keys, "__b").agg(F.sum("c").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = j.join(per.select(*keys, "__b", before.alias("__before")), [*keys, "__b"])
    inside = F.sum("c").over(Window.partitionBy(*keys, "__b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumn("__upto", F.col("__before") + inside)
    return j.groupBy(*keys).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("__upto") > rank(F.col("n")), F.col("v"))).alias(name) for name, rank in ranks.items()])


def ranked(histogram: DataFrame, value: str, count: str, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """One row p50, p90, ...: nearest-rank percentiles of a (value, count) histogram, rank round(p / 100 * (n - 1))."""
    h = histogram.select(F.col(value).alias("v"), F.col(count).alias("c"))
    of = lambda p: lambda n: F.floor(F.lit(p / 100) * (n - 1) + 0.5)
    return at_rank(h, [], {f"p{p}": of(p) for p in percents}).drop("n")


def degree_summary(d: DataFrame) -> DataFrame:
    """One row: n, mean, p50, p90, p99, max, orphans, orphan_pct."""
    h = d.groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    agg = h.agg(
        F.sum("c").alias("n"),
        F.round(F.sum(F.col("degree") * F.col("c")) / F.sum("c"), 6).alias("mean"),
        F.max("degree").alias("max"),
        F.sum(F.when(F.col("degree") == 0, F.col("c")).otherwise(0)).alias("orphans"),
    )
    agg = agg.withColumn("orphan_pct", F.round(100.0 * F.col("orphans") / F.col("n"), 6))
    return beside(agg, ranked(h, "degree", "c"))


def power_law(d: DataFrame, least: int = 50) -> DataFrame:
    """One row x_min, n_tail, alpha: exponent by maximum likelihood, NULL below ``least`` nodes in the tail.

    x_min is the larger of 2 and the 70th percentile of the degrees above 0.
    """
    h = d.filter("degree > 0").groupBy("degree").agg(F.count(F.lit(1)).alias("c"))
    x = ranked(h, "degree", "c", (70,)).select(F.greatest("p70", F.lit(2)).alias("x_min"))
    tail = beside(h, x).filter("degree >= x_min")
    agg = tail.groupBy("x_min").agg(F.sum("c").alias("n_tail"), F.sum(F.col("c") * F.log(F.col("degree") / (F.col("x_min") - 0.5))).alias("s"))
    return agg.select("x_min", "n_tail", F.when(F.col("n_tail") >= least, F.round(1 + F.col("n_tail") / F.col("s"), 6)).alias("alpha"))


def clustering(e: DataFrame, low: int = 2, high: int = 400) -> DataFrame:
    """(node, degree, closed, coefficient): local clustering of nodes of degree low to high.

    Each triangle is found once, from the pair of edges at its end of lowest
    degree, so a hub never fans out: wedges per edge are bounded by the square
    root of twice the edges.
    """
    sym = both_ways(e).select("u", "v")
    deg = sym.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    du, dv = deg.withColumnsRenamed({"u": "a", "d": "da"}), deg.withColumnsRenamed({"u": "b", "d": "db"})
    ends = e.select("a", "b").join(du, "a").join(dv, "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    up = ends.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("t"))
    wedge = up.alias("x").join(up.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("x.t") < F.col("y.t"))).select(F.col("x.s").alias("s"), F.col("x.t").alias("a"), F.col("y.t").alias("b"))
    triangles = wedge.join(e.select("a", "b"), ["a", "b"]).select(F.explode(F.array("s", "a", "b")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("closed"))
    out = deg.filter(F.col("d").between(low, high)).join(triangles, "u", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    return out.select(F.col("u").alias("node"), F.col("d").alias("degree"), "closed", F.round(2 * F.col("closed") / (F.col("d") * (F.col("d") - 1)), 9).alias("coefficient"))


def components(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node.

    Large-star and small-star steps in turn until nothing changes, a number of
    rounds logarithmic in the nodes; each round is written to the checkpoint
    folder. Minima are
    taken map-side first, and after a large step a hub's edges point at few
    nodes, so hot nodes cool down as it goes.
    """
    now = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def large(pairs: DataFrame) -> DataFrame:
        sym = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return sym.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()

    def small(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        out = moved.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u <> v").distinct()

    mark = None
    while True:
        now = cut(small(large(now)))
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == mark:
            break
        mark = (row["n"], row["h"])
    low = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(low, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(c: DataFrame) -> DataFrame:
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def component_report(c: DataFrame) -> DataFrame:
    """One row: n_nodes, n_components, largest, largest_pct."""
    s = component_sizes(c)
    return s.agg(F.sum("size").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest")).withColumn("largest_pct", F.round(100.0 * F.col("largest") / F.col("n_nodes"), 6))


def component_histogram(c: DataFrame) -> DataFrame:
    """(bucket, n_components): components by floor(log2(size))."""
    return component_sizes(c).groupBy(size_bucket(F.col("size")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_components"))


def pooled_components(c: DataFrame, d: DataFrame) -> DataFrame:
    """(node, component) with all isolated nodes in one component, -1."""
    return c.join(d, "node").select("node", F.when(F.col("degree") == 0, F.lit(-1)).otherwise(F.col("component")).alias("component"))


def hub_fragility(nodes: DataFrame, e: DataFrame, ks: tuple[int, ...] = (1, 2, 5, 10, 25, 50)) -> DataFrame:
    """(k, n_left, n_components, largest, largest_pct) after the k nodes of highest degree are removed."""
    k_of = {i: k for i, k in enumerate(ks)}
    d = degrees(nodes, e)
    top = d.orderBy(F.col("degree").desc(), "node").limit(max(ks)).collect()  # as many rows as nodes are removed
    rank = {r["node"]: i for i, r in enumerate(sorted(top, key=lambda r: (-r["degree"], r["node"])))}
    # one graph for each k beside the others, a node of graph i being node * len(ks) + i
    gone = nodes.sparkSession.createDataFrame([(n, [i for i, k in k_of.items() if r >= k]) for n, r in rank.items()], f"node {nodes.schema['node'].dataType.simpleString()}, kept array<int>")
    every = F.array(*[F.lit(i) for i in k_of])
    kept = nodes.join(F.broadcast(gone), "node", "left").select(F.col("node").cast("long").alias("node"), F.coalesce("kept", every).alias("kept"))  # max(ks) rows
    copies = cut(kept.select(F.explode("kept").alias("i"), "node").select((F.col("node") * len(ks) + F.col("i")).alias("node")))
    lost = lambda end: F.broadcast(gone.select(F.col("node").alias(end), F.col("kept").alias(f"k{end}")))
    links = e.select("a", "b").join(lost("a"), "a", "left").join(lost("b"), "b", "left")
    links = links.select("a", "b", F.explode(F.array_intersect(F.coalesce("ka", every), F.coalesce("kb", every))).alias("i"))
    links = links.select(*[(F.col(c).cast("long") * len(ks) + F.col("i")).alias(c) for c in ("a", "b")])
    c = components(copies, links).withColumn("i", F.pmod("node", F.lit(len(ks))))
    sizes = c.groupBy("i", "component").agg(F.count(F.lit(1)).alias("size"))
    report = sizes.groupBy("i").agg(F.sum("size").alias("n_left"), F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"))
    return report.select(F.element_at(F.array(*[F.lit(k) for k in ks]), (F.col("i") + 1).cast("int")).alias("k"), "n_left", "n_components", "largest", F.round(100.0 * F.col("largest") / F.col("n_left"), 6).alias("largest_pct"))


def folder_correlation(paths: DataFrame, c: DataFrame) -> DataFrame:
    """(same_component, n_pairs, same_dir, same_top): pairs of notes, and how many share a folder.

    paths is (node, path). Counted by groups, C(n, 2), so no pair is formed.
    """
    p = paths.join(c, "node").select("component", dir_of(F.col("path")).alias("dir"), F.substring_index("path", "/", 1).alias("top"))
    pairs = lambda *by: p.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("x"))
    parts = {"in_all": ("component",), "in_dir": ("component", "dir"), "in_top": ("component", "top"), "dir": ("dir",), "top": ("top",)}
    row = p.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("all"))
    for name, by in parts.items():
        row = beside(row, pairs(*by).withColumnRenamed("x", name))
    yes = F.struct(F.lit(True).alias("same_component"), F.col("in_all").alias("n_pairs"), F.col("in_dir").alias("same_dir"), F.col("in_top").alias("same_top"))
    no = F.struct(F.lit(False).alias("same_component"), (F.col("all") - F.col("in_all")).alias("n_pairs"), (F.col("dir") - F.col("in_dir")).alias("same_dir"), (F.col("top") - F.col("in_top")).alias("same_top"))
    return row.select(F.explode(F.array(yes, no)).alias("r")).select("r.*")


def degree_normalised(e: DataFrame, power: float = 0.5) -> DataFrame:
    """(a, b, w): weights times (K^2 / (da * db))^power, K the mean degree to 4 digits."""
    d = both_ways(e).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    k = d.agg(quantise_significant(F.avg("d")).alias("k"))
    j = beside(e.join(d.withColumnsRenamed({"u": "a", "d": "da"}), "a").join(d.withColumnsRenamed({"u": "b", "d": "db"}), "b"), k)
    return j.select("a", "b", (F.col("w") * F.pow(F.col("k") * F.col("k") / (F.col("da") * F.col("db")), F.lit(power))).alias("w"))


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``seq``, its place from 0 in the order of ``by``: sorted by ranges, the ranges counted and added up."""
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut(placed.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("k"))
    before = counts.select("__p", F.coalesce(F.sum("k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # one row per range
    return placed.join(before, "__p").withColumn("seq", F.col("__b") + F.col("__i")).drop("__p", "__i", "__b")


def _next(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the next row in an order; NULL in the last. No window holds all rows."""
    placed = cut(in_order(df, order))
    after = placed.select((F.col("seq") - 1).alias("seq"), F.col(value).alias(out))
    return placed.join(after, "seq", "left").drop("seq")


def path_chain(paths: DataFrame, weight: float = 0.25) -> DataFrame:
    """(a, b, w): consecutive notes by path, none if no path has a folder.

    Ranked inside each folder and across folders separately, so no window
    holds all notes: the successor of a folder's last note is found among the
    folders' first notes.
    """
    p = paths.select("node", "path")
    top = F.substring_index("path", "/", 1)
    key = p.withColumn("bucket", F.when(F.col("path").contains("/"), F.concat(top, F.lit("/"))).otherwise(F.col("path")))
    w = Window.partitionBy("bucket").orderBy("path", "node")
    inner = key.withColumn("b", F.lead("node").over(w)).withColumn("first", F.row_number().over(w) == 1)
    heads = inner.filter("first").select("bucket", F.col("node").alias("head"))
    across = _next(heads, "bucket", "head", "next").select("bucket", "next")
    linked = inner.join(across, "bucket").select(F.col("node").alias("a"), F.coalesce("b", "next").alias("b")).filter("b IS NOT NULL")
    some = p.agg(F.max(F.col("path").contains("/")).alias("some"))
    return beside(linked, some).filter("some").select("a", "b", F.lit(weight).alias("w"))


def orphan_drawer(paths: DataFrame, d: DataFrame) -> DataFrame:
    """(a, b): isolated notes tied to the first of their folder, and those to the next folder's first."""
    lost = paths.join(d.filter("degree = 0"), "node").select("node", "path", dir_of(F.col("path")).alias("dir"))
    first = lost.groupBy("dir").agg(F.min_by("node", F.struct("path", "node")).alias("rep"))
    star = lost.join(first, "dir").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    chain = _next(first, "dir", "rep", "b").select(F.col("rep").alias("a"), "b").filter("b IS NOT NULL")
    return star.unionByName(chain)


# -- partitions


def contracted(e: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, w) between the groups of labels (node, label); inner edges are self weights a = b."""
    la, lb = labels.withColumnsRenamed({"node": "a", "label": "la"}), labels.withColumnsRenamed({"node": "b", "label": "lb"})
    j = e.join(la, "a").join(lb, "b")
    return j.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.sum("w").alias("w"))


def modularity(e: DataFrame, labels: DataFrame) -> DataFrame:
    """One row q, intra_fraction: modularity and the share of weight inside groups."""
    c = contracted(e, labels)
    m = c.agg(F.sum("w").alias("m"))
    inner = c.filter("a = b").select(F.col("a").alias("label"), F.col("w").alias("inside"))
    total = c.select(F.explode(F.array("a", "b")).alias("label"), "w").groupBy("label").agg(F.sum("w").alias("tot"))
    j = beside(total.join(inner, "label", "left"), m)
    q = F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("tot") / (2 * F.col("m")), F.lit(2)))
    return j.agg(F.round(q, 9).alias("q"), F.round(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m")), 9).alias("intra_fraction"))


def dense_labels(labels: DataFrame) -> DataFrame:
    """(node, label): labels renumbered from 0 by their smallest node."""
    first = labels.groupBy("label").agg(F.min("node").alias("head"))
    return labels.join(in_order(first, "head").select("label", F.col("seq").alias("dense")), "label").select("node", F.col("dense").alias("label"))


def partition_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(old, new, n): how many nodes two labelings share."""
    return a.withColumnRenamed("label", "old").join(b.withColumnRenamed("label", "new"), "node").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n"))


def matched_groups(a: DataFrame, b: DataFrame) -> DataFrame:
    """(old, new, n): groups of two labelings matched one to one, greedily by overlap, ties to the smaller labels.

    In each round every pair that is the best of both its groups is taken and
    the rows of both groups leave, which gives what one walk in order gives.
    """
    left = cut(partition_overlap(a, b))
    done = None
    while not left.isEmpty():
        rank = F.struct(F.col("n"), -F.col("old"), -F.col("new"))
        best = lambda c: left.groupBy(c).agg(F.max(rank).alias(f"best_{c}"))
        j = left.join(best("old"), "old").join(best("new"), "new")
        taken = cut(j.filter((rank == F.col("best_old")) & (rank == F.col("best_new"))).select("old", "new", "n"))
        done = taken if done is None else done.unionByName(taken)
        left = cut(left.join(taken.select("old"), "old", "left_anti").join(taken.select("new"), "new", "left_anti").select("old", "new", "n"))
    return left if done is None else done


def notes_flipped(a: DataFrame, b: DataFrame) -> int:
    """Nodes that change group when groups are matched greedily by overlap."""
    kept = matched_groups(a, b).agg(F.sum("n")).first()[0] or 0
    return a.join(b.select("node"), "node").count() - kept


def region_level(levels: DataFrame, n: int) -> DataFrame:
    """One row level: the coarsest of (level, node, label) with at least max(n / 80, 8) groups."""
    per = levels.groupBy("level").agg(F.count_distinct("label").alias("k"))
    return per.filter(F.col("k") >= max(n / 80, 8)).agg(F.max("level").alias("level"))


# -- shapes


def is_bipartite(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(component, bipartite): no odd cycle, found in the graph of (node, side) pairs.

    Side 1 of node v is -(v + 1); ends of an edge lie on different sides.
    """
    double = e.select(F.col("a").cast("long"), (-F.col("b").cast("long") - 1).alias("b")).unionByName(e.select((-F.col("a").cast("long") - 1).alias("a"), F.col("b").cast("long")))
    both = nodes.select(F.explode(F.array(F.col("node").cast("long"), -F.col("node").cast("long") - 1)).alias("node"))
    c = components(both, double.select("a", "b"))
    plus = c.filter("node >= 0").select("node", F.col("component").alias("p"))
    minus = c.filter("node < 0").select((-F.col("node") - 1).alias("node"), F.col("component").alias("q"))
    return plus.join(minus, "node").groupBy(F.least("p", "q").alias("component")).agg(F.min(F.col("p") != F.col("q")).alias("bipartite"))


def graph_stats(nodes: DataFrame, e: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """One row: n, m, components (isolated nodes pooled), nontrivial, largest, degrees, isolates, leaves, density, forest."""
    d = degrees(nodes, e)
    c = components(nodes, e) if c is None else c
    s = component_sizes(pooled_components(c, d)).agg(F.count(F.lit(1)).alias("components"))
    real = component_sizes(c).agg(F.sum(F.when(F.col("size") > 1, 1).otherwise(0)).alias("nontrivial"), F.max("size").alias("largest"))
    agg = d.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("degree") / 2).cast("long").alias("m"),
        F.max("degree").alias("max_degree"),
        F.round(F.avg("degree"), 9).alias("mean_degree"),
        F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolates"),
        F.sum(F.when(F.col("degree") == 1, 1).otherwise(0)).alias("leaves"),
    )
    row = beside(beside(agg, s), real)
    density = F.when(F.col("n") > 1, F.round(2.0 * F.col("m") / (F.col("n").cast("double") * (F.col("n") - 1)), 12)).otherwise(0.0)
    every = F.col("nontrivial") + F.col("isolates")
    return row.withColumn("density", density).withColumn("forest", F.col("m") + every <= F.col("n"))


# From which share or count on a graph counts as a shape.
STAR_FROM, STAR_HUB, STAR_LEAVES = 4, 0.4, 0.6
DENSE_FROM, DENSE, COMPLETE_FROM, COMPLETE = 8, 0.55, 5, 0.8
ISLANDS_FROM, ISLAND_SHARE = 3, 0.55
GRID_MAX, GRID_MEAN = 4, (2.4, 4.2)
HUB_RATIO, HUB_SHARE = 8, 0.4


def shape_of(bipartite: Column | None = None) -> Column:
    """Name of a graph's shape from the columns of ``graph_stats``, first rule that fits.

    Without ``bipartite`` that shape is never given.
    """
    n, m, k = F.col("n"), F.col("m"), F.col("nontrivial")
    hub, few, cyclic = F.col("max_degree") / n, k <= 2, ~F.col("forest")
    rules = [
        ("orphans", (n == 0) | (m == 0) | ((k == 0) & (2 * F.col("isolates") >= n))),
        ("star", (n >= STAR_FROM) & (hub >= STAR_HUB) & (F.col("leaves") / n >= STAR_LEAVES)),
        ("clique", ((n >= DENSE_FROM) & (F.col("density") >= DENSE)) | ((n >= COMPLETE_FROM) & (F.col("density") >= COMPLETE))),
        ("islands", (k >= ISLANDS_FROM) & (F.col("largest") / n < ISLAND_SHARE)),
        ("chain", (F.col("max_degree") <= 2) & few & (m + 2 >= n - F.col("isolates"))),
        ("tree", F.col("forest") & few),
        ("grid", cyclic & (F.col("max_degree") <= GRID_MAX) & F.col("mean_degree").between(*GRID_MEAN)),
        ("bipartite", cyclic & (F.lit(False) if bipartite is None else bipartite)),
        ("scale_free", (F.col("mean_degree") > 0.5) & (F.col("max_degree") >= HUB_RATIO * F.col("mean_degree")) & (hub < HUB_SHARE)),
        ("tree", F.col("forest")),
    ]
    name = F.lit("messy")
    for shape, fits in reversed(rules):
        name = F.when(fits, shape).otherwise(name)
    return name


def cocited(e: DataFrame, least: int = 3, most_degree: int = 128) -> DataFrame:
    """(a, b, shared): unlinked pairs with ``least`` common neighbours of degree up to ``most_degree``.

    The degree bound is part of the measure and bounds the pairs of a node.
    """
    sym = both_ways(e).select("u", "v")
    small = sym.groupBy("u").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d").between(2, most_degree)).select("u")
    own = sym.join(small, "u").groupBy("u").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    first = own.select("vs", F.posexplode("vs").alias("at", "a"))
    pair = first.select("a", F.explode(F.slice("vs", F.col("at") + 2, F.size("vs"))).alias("b"))
    many = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least)
    return many.join(e.select("a", "b"), ["a", "b"], "left_anti")


def missing_edge(e: DataFrame, c: DataFrame) -> DataFrame:
    """One row a, b: the smallest pair of unlinked nodes in one component of three or more.

    Only the lowest nodes of each component can make the smallest pair: the
    lowest node of degree below size - 1 and its lowest stranger.
    """
    sizes = component_sizes(c).filter("size > 2")
    d = both_ways(e).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    able = c.join(sizes, "component").join(d, F.col("node") == F.col("u")).filter("d < size - 1")
    low = able.groupBy("component").agg(F.min("node").alias("a")).orderBy("a").limit(1)
    near = both_ways(e).select(F.col("u").alias("a"), F.col("v").alias("b"))
    other = c.join(F.broadcast(low), "component").filter("node <> a").select("a", F.col("node").alias("b"))
    return other.join(near, ["a", "b"], "left_anti").groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def cross_folder_links(e: DataFrame, paths: DataFrame) -> DataFrame:
    """One row n_links, n_cross, busiest, degree: links between notes, those between folders, and the note
    with most of them (ties to the smallest)."""
    p = paths.select("node", dir_of(F.col("path")).alias("dir"))
    j = e.join(p.withColumnsRenamed({"node": "a", "dir": "da"}), "a").join(p.withColumnsRenamed({"node": "b", "dir": "db"}), "b")
    ends = j.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    most = ends.agg(F.max_by("node", F.struct(F.col("degree"), -F.col("node"))).alias("busiest"), F.max("degree").alias("degree"))
    return beside(j.agg(F.count(F.lit(1)).alias("n_links"), F.sum((F.col("da") != F.col("db")).cast("long")).alias("n_cross")), most)


# -- measures of positions (node, x, y)


def _placed(e: DataFrame, pos: DataFrame) -> DataFrame:
    p = pos.select("node", "x", "y")
    return e.join(p.withColumnsRenamed({"node": "a", "x": "ax", "y": "ay"}), "a").join(p.withColumnsRenamed({"node": "b", "x": "bx", "y": "by"}), "b")


def _length() -> Column:
    return F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2)))


def link_spread(e: DataFrame, pos: DataFrame) -> DataFrame:
    """(bucket, n_links, mean_length, crossing_pct) by the busier end's degree; lengths as parts of the extent.

    bucket is the upper bound 8, 32, 128, 512 or 0 for more; a link crosses if
    it is longer than a quarter of the extent.
    """
    ext = pos.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    d = both_ways(e).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    j = _placed(e, pos).join(d.withColumnsRenamed({"u": "a", "d": "da"}), "a").join(d.withColumnsRenamed({"u": "b", "d": "db"}), "b")
    j = beside(j, ext)
    busy = F.greatest("da", "db")
    bucket = F.when(busy <= 8, 8).when(busy <= 32, 32).when(busy <= 128, 128).when(busy <= 512, 512).otherwise(0)
    part = _length() / F.col("extent")
    return j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_links"), F.round(F.avg(part), 9).alias("mean_length"), F.round(100 * F.avg((part > 0.25).cast("double")), 9).alias("crossing_pct"))


def radial(pos: DataFrame) -> DataFrame:
    """One row n, skew, kurt, bimodality of the distances from the centroid; 0 below 8 points."""
    mid = pos.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = beside(pos, mid).select(F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))).alias("r"))
    s = r.agg(F.count(F.lit(1)).alias("n"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))
    b = F.when(F.col("n") >= 8, (F.pow("skew", F.lit(2)) + 1) / F.col("kurt")).otherwise(0.0)
    return s.select("n", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), F.round(b, 6).alias("bimodality"))


def highways(e: DataFrame, pos: DataFrame, labels: DataFrame) -> DataFrame:
    """One row n_links, p50, p90 of the lengths between groups over the roots of their sizes."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    sized = labels.join(size, "label")
    j = _placed(e, pos).join(sized.withColumnsRenamed({"node": "a", "label": "la", "k": "ka"}), "a").join(sized.withColumnsRenamed({"node": "b", "label": "lb", "k": "kb"}), "b").filter("la <> lb")
    v = j.select(F.round(_length() / (F.sqrt("ka") + F.sqrt("kb")), 9).alias("v"))
    h = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    return beside(h.agg(F.sum("c").alias("n_links")), ranked(h, "v", "c", (50, 90)))


def procrustes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row n, scale, angle, rms: best turn and scale of one layout onto another, and what is left."""
    j = before.join(after.withColumnsRenamed({"x": "x2", "y": "y2"}), "node")
    mid = j.agg(*[F.avg(c).alias(f"m{c}") for c in ("x", "y", "x2", "y2")])
    z = beside(j, mid).select(*[(F.col(c) - F.col(f"m{c}")).alias(c) for c in ("x", "y", "x2", "y2")])
    s = z.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x") * F.col("x2") + F.col("y") * F.col("y2")).alias("dot"),
        F.sum(F.col("x") * F.col("y2") - F.col("y") * F.col("x2")).alias("cross"),
        F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("aa"),
        F.sum(F.col("x2") * F.col("x2") + F.col("y2") * F.col("y2")).alias("bb"),
    )
    fit = F.sqrt(F.col("dot") * F.col("dot") + F.col("cross") * F.col("cross"))
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("bb") - fit * fit / F.col("aa")) / F.col("n"))
    return s.select("n", F.round(fit / F.col("aa"), 6).alias("scale"), F.round(F.atan2("cross", "dot"), 6).alias("angle"), F.round(left, 6).alias("rms"))


def displacement(before: DataFrame, after: DataFrame, slot: float = 1.0) -> DataFrame:
    """One row n, p50, p99, moved: how far nodes moved beyond the mean shift, and how many over a slot."""
    j = before.join(after.withColumnsRenamed({"x": "x2", "y": "y2"}), "node").select((F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    mean = j.agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    v = beside(j, mean).select(F.round(F.sqrt(F.pow(F.col("dx") - F.col("mx"), F.lit(2)) + F.pow(F.col("dy") - F.col("my"), F.lit(2))), 6).alias("v"))
    h = v.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    return beside(h.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") > slot, F.col("c")).otherwise(0)).alias("moved")), ranked(h, "v", "c", (50, 99)))


# -- hierarchies and probes


def sibling_pairs(e: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, u, v, w): weight between siblings, each link counted once at the coarsest level that parts its ends.

    levels is (level, node, label), 0 the finest.
    """
    a, b = levels.withColumnsRenamed({"node": "a", "label": "u"}), levels.withColumnsRenamed({"node": "b", "label": "v"})
    apart = e.join(a, "a").join(b, ["level", "b"]).filter("u <> v")
    top = apart.groupBy("a", "b").agg(F.max(F.struct("level", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")).alias("t"))
    return top.groupBy(F.col("t.level").alias("level"), F.col("t.u").alias("u"), F.col("t.v").alias("v")).agg(F.sum("t.w").alias("w"))


def outside_pull(e: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, label, w): weight of the links that leave each cell."""
    a, b = levels.withColumnsRenamed({"node": "a", "label": "u"}), levels.withColumnsRenamed({"node": "b", "label": "v"})
    apart = e.join(a, "a").join(b, ["level", "b"]).filter("u <> v")
    return apart.select("level", F.explode(F.array("u", "v")).alias("label"), "w").groupBy("level", "label").agg(F.sum("w").alias("w"))


def level_report(e: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, groups, largest, q, intra_fraction): each level of a clustering at a glance."""
    a, b = levels.withColumnsRenamed({"node": "a", "label": "u"}), levels.withColumnsRenamed({"node": "b", "label": "v"})
    j = e.join(a, "a").join(b, ["level", "b"])
    ends = j.select("level", "w", F.explode(F.array("u", "v")).alias("label")).groupBy("level", "label").agg(F.sum("w").alias("tot"))
    inner = j.groupBy("level").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("inside"))
    null = ends.join(inner, "level").groupBy("level").agg(F.sum(F.pow(F.col("tot") / (2 * F.col("m")), F.lit(2))).alias("null"))
    size = levels.groupBy("level", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("level").agg(F.count(F.lit(1)).alias("groups"), F.max("k").alias("largest"))
    part = F.col("inside") / F.col("m")
    return size.join(inner, "level").join(null, "level").select("level", "groups", "largest", F.round(part - F.col("null"), 9).alias("q"), F.round(part, 9).alias("intra_fraction"))


def community_shapes(e: DataFrame, labels: DataFrame, least: int = 4) -> DataFrame:
    """(shape, n): communities of at least ``least`` nodes by the shape of their inner graph."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    la, lb = labels.withColumnsRenamed({"node": "a", "label": "label"}), labels.withColumnsRenamed({"node": "b", "label": "lb"})
    inner = cut(e.join(la, "a").join(lb, "b").filter("label = lb").select("label", "a", "b", "w", "n"))
    nodes = cut(labels.join(size.select("label"), "label").select("label", "node"))
    deg = inner.select("label", F.explode(F.array("a", "b")).alias("node")).groupBy("label", "node").agg(F.count(F.lit(1)).alias("d"))
    d = nodes.join(deg, ["label", "node"], "left").withColumn("degree", F.coalesce("d", F.lit(0)))
    agg = d.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree"), F.sum((F.col("degree") == 0).cast("int")).alias("isolates"), F.sum((F.col("degree") == 1).cast("int")).alias("leaves")
    )
    c = components(nodes.select("node"), inner.select("a", "b")).join(nodes, "node")
    parts = c.groupBy("label", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("label").agg(F.sum((F.col("k") > 1).cast("int")).alias("nontrivial"), F.max("k").alias("largest"))
    stats = agg.join(parts, "label").withColumn("forest", F.col("m") + F.col("nontrivial") + F.col("isolates") <= F.col("n"))
    stats = stats.withColumn("density", F.when(F.col("n") > 1, 2.0 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0))
    return stats.groupBy(shape_of().alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def cocitation_ratio(e: DataFrame, pos: DataFrame, least: int = 3) -> DataFrame:
    """One row n_pairs, ratio: median distance of random pairs over that of co-cited unlinked pairs.

    Each node is paired with the node a hash of its id points to in the order
    of hashes; medians have rank n / 2.
    """
    near = _placed(cocited(e, least), pos).select(F.round(_length(), 9).alias("v"))
    slot = pos.select("node", "x", "y", F.pmod(F.xxhash64("node"), F.lit(1 << 20)).alias("h"))
    other = slot.groupBy(F.pmod(F.xxhash64("h"), F.lit(1 << 10)).alias("s")).agg(F.min_by(F.struct("x", "y"), "node").alias("o"))
    rand = slot.withColumn("s", F.pmod(F.col("h"), F.lit(1 << 10))).join(other, "s").select(F.round(F.sqrt(F.pow(F.col("x") - F.col("o.x"), F.lit(2)) + F.pow(F.col("y") - F.col("o.y"), F.lit(2))), 9).alias("v"))
    hist = lambda d: d.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    hn = hist(near)
    row = beside(hn.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_pairs")), ranked(hn, "v", "c", (50,)))
    return beside(row, ranked(hist(rand), "v", "c", (50,)).withColumnRenamed("p50", "r50")).select("n_pairs", F.round(F.col("r50") / F.when(F.col("p50") > 0, F.col("p50")), 6).alias("ratio"))


def stability_probe(nodes: DataFrame, e: DataFrame, cluster_of) -> tuple[int, int]:
    """(nodes flipped, nodes): how many nodes change group when one missing link is added.

    ``cluster_of(nodes, edges)`` gives (node, label).
    """
    extra = missing_edge(e, components(nodes, e)).select("a", "b", F.lit(1.0).alias("w"))
    before, after = cut(cluster_of(nodes, e)), cut(cluster_of(nodes, e.select("a", "b", "w").unionByName(extra)))
    return notes_flipped(before, after), before.count()


def border_gap(weight: Column, reference: Column, ocean: Column) -> Column:
    """Room between two frames: all of ``ocean`` without links, none from half the reference weight on."""
    return ocean * (F.lit(1.0) - F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight / (reference / 2))))
