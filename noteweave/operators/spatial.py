"""Spatial hierarchy and level of detail over placed nodes.

Positions are (node, component, x, y); cells are (cell, parent, depth, x, y,
radius, n) with parent -1 at the top.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.functions.geometry import hilbert, quantise
from noteweave.operators.graph import at_rank
from noteweave.session import beside, cut

#: Cells never reach across multiples of this place along the curve, in components of every size; a stretch is one task.
STRETCH = 4_096


def hilbert_keys(pos: DataFrame, bits: int = 16) -> DataFrame:
    """pos with ``key``: the place of each node along the Hilbert curve of the whole plane."""
    box = pos.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = beside(pos, box)
    return p.withColumn("key", hilbert(quantise(F.col("x"), F.col("x0"), F.col("x1"), bits), quantise(F.col("y"), F.col("y0"), F.col("y1"), bits), bits)).drop("x0", "x1", "y0", "y1")


def curve_order(keyed: DataFrame) -> DataFrame:
    """keyed with ``pos``: the rank of a node in its component along the curve, ties by node.

    Ranked inside slices of the curve whose counts are added up first, so a
    component of any size is spread over tasks.
    """
    sliced = keyed.withColumn("slice", F.floor(F.col("key") / (1 << 24)))
    counts = sliced.groupBy("component", "slice").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("component").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("component", "slice").orderBy("key", "node"))
    return sliced.withColumn("i", inside).join(counts.select("component", "slice", before.alias("b")), ["component", "slice"]).withColumn("pos", (F.col("b") + F.col("i") - 1).cast("long")).drop("slice", "i", "b")


def curve_spacing(ordered: DataFrame) -> DataFrame:
    """(component, n_gaps, spacing): gaps between neighbours on the curve; spacing is the gap of rank n/2."""
    nxt = ordered.select("component", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    gap = ordered.join(nxt, ["component", "pos"]).select("component", F.sqrt(F.pow(F.col("x2") - F.col("x"), F.lit(2)) + F.pow(F.col("y2") - F.col("y"), F.lit(2))).alias("g"))
    h = gap.groupBy("component", F.col("g").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return at_rank(h, ["component"], {"spacing": lambda n: F.floor(n / 2)}).withColumnRenamed("n", "n_gaps")


def chunk(gaps: list[float], arity: int) -> list[int]:
    """Ends of runs of arity/2 to arity nodes, each cut at the widest gap in reach; gaps[i] follows node i."""
    n, ends, start = len(gaps) + 1, [], 0
    low = max(1, arity // 2)
    while n - start > arity:
        reach = range(start + low, min(start + arity, n - low) + 1)
        cut_ = max(reach, key=lambda i: (gaps[i - 1], -i)) if reach else start + arity
        ends.append(cut_)
        start = cut_
    ends.append(n)
    return ends


def curve_cells(ordered: DataFrame, arity: int = 8, stretch: int = STRETCH) -> DataFrame:
    """(component, pos, node, leaf): nodes in leaf cells of arity/2 to arity, never across components.

    Every ``stretch`` places along the curve cells end, whatever the size of
    the component, and stretches are chunked one by one.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        xs, ys = pdf.x.tolist(), pdf.y.tolist()
        gaps = [((xs[i + 1] - xs[i]) ** 2 + (ys[i + 1] - ys[i]) ** 2) ** 0.5 for i in range(len(xs) - 1)]
        leaf, start = [], int(pdf.pos.iloc[0])
        begin = 0
        for end in chunk(gaps, arity):
            leaf += [start + begin] * (end - begin)
            begin = end
        return pd.DataFrame({"component": pdf.component, "pos": pdf.pos, "node": pdf.node, "leaf": leaf})

    key = F.floor(F.col("pos") / stretch)
    return ordered.withColumn("part", key).select("component", "part", "pos", "node", "x", "y").groupBy("component", "part").applyInPandas(one, "component long, pos long, node long, leaf long")


def cell_shapes(members: DataFrame, pos: DataFrame) -> DataFrame:
    """(cell, n, x, y, radius): centre and bounding radius of each cell from members (cell, node)."""
    j = members.join(pos.select("node", "x", "y"), "node")
    mid = j.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = j.join(mid, "cell").groupBy("cell").agg(F.max(F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2)))).alias("radius"))
    return mid.join(far, "cell").select("cell", "n", F.col("cx").alias("x"), F.col("cy").alias("y"), "radius")


def cell_pairs(e: DataFrame, levels: DataFrame) -> DataFrame:
    """(level, u, v, w): links lifted onto the cells of every level of (level, node, label)."""
    a, b = levels.withColumnsRenamed({"node": "a", "label": "u"}), levels.withColumnsRenamed({"node": "b", "label": "v"})
    j = e.join(a, "a").join(b, ["level", "b"]).filter("u <> v")
    return j.groupBy("level", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))


def heaviest(pairs: DataFrame, cap: int) -> DataFrame:
    """(u, v, w, rank): the ``cap`` heaviest neighbours of each cell (a top-k, by weight, then neighbour)."""
    sym = pairs.select("u", "v", "w").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("w").desc(), "v"))
    return sym.withColumn("rank", rank).filter(F.col("rank") <= cap)


def sibling_overlap(cells: DataFrame) -> DataFrame:
    """One row n_pairs, overlap_pct, penetration: sibling cells whose discs meet, and how deep on average.

    Pairs are counted, not formed. Discs that meet are found on a grid of
    twice the siblings' largest radius, where they lie in one square or in two
    that touch.
    """
    c = cells.select("parent", "cell", "x", "y", "radius")
    per = c.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), (2 * F.max("radius")).alias("side"))
    n = per.agg(F.coalesce(F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("long")), F.lit(0)).alias("n_pairs"))
    at = lambda v: F.when(F.col("side") > 0, F.floor(F.col(v) / F.col("side"))).otherwise(0)
    g = c.join(per, "parent").select("parent", "cell", "x", "y", "radius", at("x").alias("gx"), at("y").alias("gy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    o = g.select("parent", "gx", "gy", F.col("cell").alias("cell2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("radius").alias("r2"))
    near = g.withColumn("s", F.explode(steps)).withColumn("gx", F.col("gx") + F.col("s.i")).withColumn("gy", F.col("gy") + F.col("s.j"))
    depth = F.col("radius") + F.col("r2") - F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2)) + F.pow(F.col("y") - F.col("y2"), F.lit(2)))
    meet = near.join(o, ["parent", "gx", "gy"]).filter("cell < cell2").select(depth.alias("d")).filter("d > 0")
    row = beside(n, meet.agg(F.count(F.lit(1)).alias("meet"), F.avg("d").alias("deep")))
    return row.select("n_pairs", F.round(100.0 * F.col("meet") / F.when(F.col("n_pairs") > 0, F.col("n_pairs")), 6).alias("overlap_pct"), F.round("deep", 6).alias("penetration"))


def six_fold(cells: DataFrame) -> DataFrame:
    """(parent, n, psi): how hexagonal the children of a cell lie around its centre, 0 to 1."""
    up = cells.select(F.col("cell").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    t = cells.join(up, "parent").select("parent", (6 * F.atan2(F.col("y") - F.col("py"), F.col("x") - F.col("px"))).alias("t"))
    return t.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.pow(F.avg(F.cos("t")), F.lit(2)) + F.pow(F.avg(F.sin("t")), F.lit(2))), 6).alias("psi"))


def rings(pos: DataFrame, k: int = 8) -> DataFrame:
    """(ring, n): nodes by equal-area rings about the origin, radius scaled to the farthest node."""
    far = pos.agg(F.max(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("far"))
    r2 = (F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("far")
    return beside(pos, far).groupBy(F.least(F.lit(k - 1), F.floor(r2 * k)).cast("int").alias("ring")).agg(F.count(F.lit(1)).alias("n"))


def component_extents(pos: DataFrame) -> DataFrame:
    """(component, n, x, y, radius): centre and reach of each component."""
    return cell_shapes(pos.select(F.col("component").alias("cell"), "node"), pos).withColumnRenamed("cell", "component")


def robust_radius(pos: DataFrame) -> DataFrame:
    """(component, n, radius): distance of rank 99 n / 100 from the centre of each component."""
    mid = pos.groupBy("component").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = F.round(F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))), 9)
    h = pos.join(mid, "component").groupBy("component", r.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return at_rank(h, ["component"], {"radius": lambda n: F.least(F.floor(n * 99 / 100), n - 1)})


# -- level of detail


def tree_of(levels: DataFrame, pos: DataFrame) -> DataFrame:
    """(cell, parent, depth, node, x, y, radius, n): cells of (level, node, label), notes at the bottom.

    Cells are named 'level:label', notes 'n:node'; the top has parent ''.
    """
    top = levels.agg((F.max("level") + 1).alias("top"))
    named = beside(levels, top).select("node", "top", "level", F.concat(F.col("level").cast("string"), F.lit(":"), F.col("label").cast("string")).alias("cell"))
    shapes = cell_shapes(named.select("cell", "node"), pos)
    up = named.select("node", (F.col("level") - 1).alias("level"), F.col("cell").alias("parent"))
    links = named.join(up, ["node", "level"], "left").groupBy("cell").agg(F.coalesce(F.max("parent"), F.lit("")).alias("parent"), F.max(F.col("top") - F.col("level")).alias("depth"))
    cells = links.join(shapes, "cell").select("cell", "parent", "depth", F.lit(None).cast("long").alias("node"), "x", "y", "radius", "n")
    leaf = named.filter("level = 0").join(pos.select("node", "x", "y"), "node").select(F.concat(F.lit("n:"), F.col("node").cast("string")).alias("cell"), F.col("cell").alias("parent"), (F.col("top") + 1).alias("depth"), "node", "x", "y", F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n"))
    return cells.unionByName(leaf)


def lod_cut(tree: DataFrame, zoom: float, split_px: float, budget: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The cells shown: starting at the top, visible cells that look larger than split_px are opened
    while the cut stays within the budget; the largest classes of round(20 log2 r) go first.

    A loop over depths, each a filter and a join on parent; a class whose
    opening would exceed the budget stays closed with all below it.
    """
    seen = F.lit(True) if box is None else (F.col("x") + F.col("radius") >= box[0]) & (F.col("x") - F.col("radius") <= box[2]) & (F.col("y") + F.col("radius") >= box[1]) & (F.col("y") - F.col("radius") <= box[3])
    tree = cut(tree.filter(seen))
    kids = tree.groupBy("parent").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("parent", "cell")
    level = tree.filter("parent = ''")
    left = budget - level.count()
    closed = None
    while True:
        want = level.join(kids, "cell", "left").withColumn("class", F.when((F.col("k") > 0) & (F.col("radius") * zoom > split_px), F.round(20 * F.log2("radius")).cast("int")))
        cost = want.filter("class IS NOT NULL").groupBy("class").agg(F.sum(F.col("k") - 1).alias("cost"))
        spent = F.sum("cost").over(Window.orderBy(F.col("class").desc()))  # one row per class of radius
        price = cost.withColumn("spent", spent).filter(F.col("spent") <= left).agg(F.min("class").alias("low"), F.max("spent").alias("spent")).first()
        low = price["low"]
        opened = want.filter(F.lit(False) if low is None else F.col("class") >= low)
        keep = want.filter(F.lit(True) if low is None else F.col("class").isNull() | (F.col("class") < low)).select(*tree.columns)
        closed = keep if closed is None else closed.unionByName(keep)
        if low is None:
            break
        left -= price["spent"]
        level = cut(tree.join(opened.select(F.col("cell").alias("parent")), "parent").select(*tree.columns))
    return closed


def cut_of_notes(tree: DataFrame, shown: DataFrame) -> DataFrame:
    """(node, cell): the shown cell that stands for each note, by walking up from the notes."""
    up = tree.select(F.col("cell").alias("at"), F.col("parent").alias("next"))
    marks = shown.select(F.col("cell").alias("at"), F.lit(True).alias("hit"))
    walk = tree.filter("node IS NOT NULL").select("node", F.col("cell").alias("at"))
    depth = tree.agg(F.max("depth")).first()[0] or 0
    done = None
    for _ in range(depth + 1):
        step = cut(walk.join(marks, "at", "left"))
        here = step.filter("hit").select("node", F.col("at").alias("cell"))
        done = here if done is None else done.unionByName(here)
        walk = step.filter("hit IS NULL").join(up, "at").filter("next <> ''").select("node", F.col("next").alias("at"))
    return done


def lifted_links(e: DataFrame, cut_cells: DataFrame, k: int) -> DataFrame:
    """(u, v, w, n): the ``k`` strongest links between shown cells (a top-k by weight, then cells)."""
    a, b = cut_cells.withColumnsRenamed({"node": "a", "cell": "u"}), cut_cells.withColumnsRenamed({"node": "b", "cell": "v"})
    j = e.join(a, "a").join(b, "b").filter("u <> v")
    g = j.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("w").desc(), "u", "v").limit(k)


def resolve_zoom(tree: DataFrame, split_px: float) -> DataFrame:
    """(node, zoom): the zoom from which a note's cell is opened, so that the note itself is seen."""
    up = tree.select(F.col("cell").alias("parent"), F.col("radius").alias("r"))
    return tree.filter("node IS NOT NULL").join(up, "parent").select("node", F.when(F.col("r") > 0, F.lit(split_px) / F.col("r")).otherwise(0.0).alias("zoom"))


def descent_travel(tree: DataFrame) -> DataFrame:
    """(node, travel): the widest jump between a cell's centre and its parent's on the way down to each note."""
    up = tree.select(F.col("cell").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"))
    jump = tree.join(up, "parent").select("cell", F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2))).alias("jump"))
    step = cut(tree.join(jump, "cell", "left").select(F.col("cell").alias("at"), F.col("parent").alias("next"), F.coalesce("jump", F.lit(0.0)).alias("jump")))
    walk = tree.filter("node IS NOT NULL").select("node", F.col("cell").alias("at"), F.lit(0.0).alias("travel"))
    depth = tree.agg(F.max("depth")).first()[0] or 0
    for _ in range(depth):
        walk = cut(walk.join(step, "at", "left").select("node", F.coalesce("next", F.lit("")).alias("at"), F.greatest("travel", F.coalesce("jump", F.lit(0.0))).alias("travel")))
    return walk.select("node", "travel")


def estimated_radius(n: Column, spacing: float = 1.0) -> Column:
    """Radius of a disc that holds ``n`` notes at a spacing."""
    return F.lit(spacing) * F.sqrt(n / math.pi)


def repulsion(xy, soft: float = 0.05):
    """Sum of d / (d^2 + soft) from all other points, for each point (LAY2): far cells of a pyramid of
    grids act by their mean, points of the same and the adjacent finest cells one by one."""
    import numpy as np

    n = len(xy)
    low = xy.min(0)
    side = max((xy.max(0) - low).max(), 1e-9) * (1 + 1e-9)
    depth = 2
    while True:
        m = 1 << depth
        fine = np.minimum(((xy - low) / side * m).astype(np.int64), m - 1)
        count = np.bincount(fine[:, 0] * m + fine[:, 1], minlength=m * m)
        if (count.astype(float) ** 2).sum() <= 8 * n or m * m > 4 * n:
            break
        depth += 1
    out = np.zeros_like(xy)
    for level in range(2, depth + 1):
        m = 1 << level
        at = fine >> (depth - level)
        key = at[:, 0] * m + at[:, 1]
        held = np.bincount(key, minlength=m * m)
        mean = np.stack([np.bincount(key, xy[:, i], m * m) for i in (0, 1)], 1) / np.maximum(held, 1)[:, None]
        for ox in range(-2, 4):
            for oy in range(-2, 4):
                to = (at >> 1) * 2 + (ox, oy)
                far = (np.abs(to - at).max(1) > 1) & (to.min(1) >= 0) & (to.max(1) < m)
                i = np.flatnonzero(far)
                k = to[i, 0] * m + to[i, 1]
                d = xy[i] - mean[k]
                out[i] += d * (held[k] / ((d**2).sum(1) + soft))[:, None]
    m = 1 << depth
    key = fine[:, 0] * m + fine[:, 1]
    order = np.argsort(key, kind="stable")
    start = np.concatenate([[0], np.cumsum(count)])
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            to = fine + (ox, oy)
            i = np.flatnonzero((to.min(1) >= 0) & (to.max(1) < m))
            k = to[i, 0] * m + to[i, 1]
            ends = np.cumsum(count[k])
            first = 0
            while first < len(i):  # about 2 M pairs at once
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + 2_000_000, "right")))
                c = count[k[first:last]]
                s = np.repeat(i[first:last], c)
                t = order[np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[k[first:last]], c)]
                d = xy[s] - xy[t]
                d /= ((d**2).sum(1) + soft)[:, None]
                out[:, 0] += np.bincount(s, d[:, 0], n)
                out[:, 1] += np.bincount(s, d[:, 1], n)
                first = last
    return out


def _inside(e: DataFrame, labels: DataFrame, rounds: int, most: int) -> DataFrame:
    """(label, node, dx, dy): each group of labels (label, node) solved about its own centre."""
    import numpy as np

    turn = 2.399963229728653  # golden angle
    size = cut(labels.groupBy("label").agg(F.count(F.lit(1)).alias("k")))
    large = not size.filter(F.col("k") > most).isEmpty()
    if large:
        rank = F.row_number().over(Window.partitionBy("label").orderBy("node")) - 1
        part = F.xxhash64("label", F.when(F.col("k") > most, F.floor(F.col("r") / most)).otherwise(F.lit(0)))
        of = cut(labels.withColumn("r", rank).join(size, "label").select("label", "node", part.alias("part"), "k"))
    else:
        of = labels.select("label", "node", F.col("label").alias("part"))
    la, lb = of.select(F.col("node").alias("a"), "label", F.col("part").alias("pa")), of.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("part").alias("pb"))
    inner = e.select("a", "b").join(la, "a").join(lb, "b").filter("label = lb").select("label", F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"), "pa", "pb")
    none = F.lit(None).cast("double")
    own = F.col("node").cast("long")
    rows = of.select("label", "part", F.lit("node").alias("kind"), own.alias("u"), own.alias("v"), none.alias("ax"), none.alias("ay"))  # no NULL in v, or pandas makes it a float
    rows = rows.unionByName(inner.filter("pa = pb").select("label", F.col("pa").alias("part"), F.lit("link").alias("kind"), "u", "v", none.alias("ax"), none.alias("ay")))
    if large:
        across = cut(inner.filter("pa <> pb"))
        between = across.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        spread = 2.0 * math.sqrt(most)
        mid = _inside(between, of.filter(F.col("k") > most).select("label", F.col("part").alias("node")).distinct(), rounds, most)
        mid = cut(mid.select(F.col("node").alias("part"), (F.col("dx") * spread).alias("mx"), (F.col("dy") * spread).alias("my")))
        to = mid.withColumnsRenamed({"part": "other", "mx": "ox", "my": "oy"})
        ends = F.array(F.struct(F.col("u"), F.col("pa").alias("part"), F.col("pb").alias("other")), F.struct(F.col("v").alias("u"), F.col("pb").alias("part"), F.col("pa").alias("other")))
        pulled = across.select("label", F.explode(ends).alias("x")).select("label", "x.*").join(mid, "part").join(to, "other")
        rows = rows.unionByName(pulled.select("label", "part", F.lit("outer").alias("kind"), "u", F.col("u").alias("v"), (F.col("ox") - F.col("mx")).alias("ax"), (F.col("oy") - F.col("my")).alias("ay")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(pdf.u[pdf.kind == "node"].unique())
        n = len(ids)
        i = np.arange(n)
        xy = np.stack([np.sqrt(i + 0.5) * np.cos(i * turn), np.sqrt(i + 0.5) * np.sin(i * turn)], 1)
        link, out = pdf[pdf.kind == "link"], pdf[pdf.kind == "outer"]
        if n > 1 and len(link) + len(out):
            s, t = np.searchsorted(ids, link.u.to_numpy()), np.searchsorted(ids, link.v.to_numpy())
            o, goal = np.searchsorted(ids, out.u.to_numpy()), out[["ax", "ay"]].to_numpy()
            goal = goal * np.minimum(1.0, np.sqrt(n) / np.maximum(np.linalg.norm(goal, axis=1, keepdims=True), 1e-9))  # no farther than the rim
            stride = max(1.0, math.sqrt(n) / 40)  # of a larger disc, nodes have farther to go
            for r in range(rounds):
                move = repulsion(xy) * 0.3
                pull = xy[t] - xy[s]
                np.add.at(move, s, pull * 0.1)
                np.add.at(move, t, -pull * 0.1)
                np.add.at(move, o, (goal - xy[o]) * 0.1)
                step = np.linalg.norm(move, axis=1, keepdims=True)
                xy += move / np.maximum(step, 1e-9) * np.minimum(step, stride * (1.0 - r / rounds))
            xy -= xy.mean(0)
            far = np.linalg.norm(xy, axis=1).max()
            xy *= np.sqrt(n) / max(far, 1e-9)
        return pd.DataFrame({"label": pdf.label.iloc[0], "part": pdf.part.iloc[0], "node": ids, "dx": xy[:, 0], "dy": xy[:, 1]})

    solved = rows.groupBy("part").applyInPandas(solve, "label long, part long, node long, dx double, dy double")
    if not large:
        return solved.drop("part")
    whole = solved.join(mid, "part", "left").select("label", "node", (F.col("dx") + F.coalesce("mx", F.lit(0.0))).alias("dx"), (F.col("dy") + F.coalesce("my", F.lit(0.0))).alias("dy"))
    whole = cut(whole)
    reach = whole.groupBy("label").agg(F.max(F.hypot("dx", "dy")).alias("far")).join(size, "label")
    scale = F.when(F.col("k") > most, F.sqrt("k") / F.col("far")).otherwise(1.0)
    return whole.join(reach, "label").select("label", "node", (F.col("dx") * scale).alias("dx"), (F.col("dy") * scale).alias("dy"))


def force_layout(e: DataFrame, labels: DataFrame, rounds: int = 60, most: int = 50_000) -> DataFrame:
    """(node, x, y): territories placed on a spiral, notes inside by springs and repulsion.

    Each group of labels (node, label) is solved by one task. A group above
    ``most`` nodes is first split by id into parts of as many; the parts are
    placed by the same solve over the links between them, then each part is
    solved with its outer links pulling towards the centres of their parts.
    Deterministic.
    """
    order = labels.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy(F.col("k").desc(), "label").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per group
    turn = 2.399963229728653  # golden angle
    place = order.withColumn("i", F.sqrt(before + F.col("k") / 2)).withColumn("j", F.row_number().over(Window.orderBy(F.col("k").desc(), "label")))
    place = place.select("label", (F.col("i") * F.cos(F.col("j") * turn) * 1.6).alias("cx"), (F.col("i") * F.sin(F.col("j") * turn) * 1.6).alias("cy"))
    inside = _inside(e, labels, rounds, most)
    return inside.join(place, "label").select("node", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"))
