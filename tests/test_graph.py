"""Graph measures, communities and spatial operators against plain versions."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from noteweave.operators import cluster as K
from noteweave.operators import graph as G
from noteweave.operators import spatial as S


def make(spark, pairs, n):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, w double")
    return spark.range(n).withColumnRenamed("id", "node"), e


def two_cliques(k=6):
    return list(combinations(range(k), 2)) + list(combinations(range(k, 2 * k), 2)) + [(k - 1, k)]


def ring(k):
    return [(i, (i + 1) % k) for i in range(k)]


def test_simple_edges(spark):
    rows = [(1, 2, 1.0), (2, 1, 0.5), (3, 3, 9.0), (None, 1, 1.0), (2, 1, None)]
    e = G.simple_edges(spark.createDataFrame(rows, "a long, b long, w double"))
    assert [tuple(r) for r in e.collect()] == [(1, 2, 1.5, 3)]


@pytest.mark.parametrize("seed", range(3))
def test_components_and_clustering(spark, seed):
    rng = random.Random(seed)
    n = 60
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(55)} | {(0, i) for i in range(1, 20)})
    nodes, e = make(spark, pairs, n)
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in range(n):
        if s not in want:
            stack, want[s] = [s], s
            while stack:
                for v in near[stack.pop()] - want.keys():
                    want[v] = s
                    stack.append(v)
    assert {r.node: r.component for r in G.components(nodes, G.simple_edges(e)).collect()} == want
    closed = {u: sum(1 for x, y in combinations(sorted(near[u]), 2) if y in near[x]) for u in near if len(near[u]) >= 2}
    assert {r.node: r.closed for r in G.clustering(G.simple_edges(e)).collect()} == closed


def test_long_chain(spark):
    nodes, e = make(spark, [(i, i + 1) for i in range(300)], 301)
    assert {r.component for r in G.components(nodes, G.simple_edges(e)).collect()} == {0}


@pytest.mark.parametrize(
    "pairs, n, shape, bipartite",
    [([(i, i + 1) for i in range(9)], 10, "chain", True), ([(0, i) for i in range(1, 9)], 9, "star", True), (list(combinations(range(6), 2)), 6, "clique", False), ([(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)], 6, "tree", True), ([], 5, "orphans", None), ([(2 * i, 2 * i + 1) for i in range(8)], 16, "islands", True)],
)
def test_named_shapes(spark, pairs, n, shape, bipartite):
    nodes, e = make(spark, pairs, n)
    e = G.simple_edges(e)
    assert G.graph_stats(nodes, e).select(G.shape_of().alias("s")).first().s == shape
    if bipartite is not None:
        assert G.is_bipartite(nodes, e).agg(F.min("bipartite").alias("b")).first().b == bipartite


def test_odd_ring_is_not_bipartite(spark):
    for k in (4, 5):
        nodes, e = make(spark, ring(k), k)
        assert G.is_bipartite(nodes, G.simple_edges(e)).first().bipartite == (k % 2 == 0)


def test_percentiles_by_nearest_rank(spark):
    for values in ([1, 2, 3, 4], list(range(101)), [5], [0] * 9 + [7]):
        h = spark.createDataFrame([(v, 1) for v in values], "v int, c int")
        row = G.ranked(h, "v", "c", (50, 90, 99)).first()
        s = sorted(values)
        assert tuple(row) == tuple(s[int(p / 100 * (len(s) - 1) + 0.5)] for p in (50, 90, 99))


def test_power_law_needs_a_tail(spark):
    d = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "node long, degree long")
    assert G.power_law(d([5] * 20)).first().alpha is None
    assert 1 < G.power_law(d([1] * 1000 + list(range(2, 201)))).first().alpha < 4


def test_partitions(spark):
    nodes, e = make(spark, two_cliques(), 12)
    e = G.simple_edges(e)
    good = nodes.select("node", F.floor(F.col("node") / 6).alias("label"))
    bad = nodes.select("node", (F.col("node") % 2).alias("label"))
    assert G.modularity(e, good).first().q > 0.4 > G.modularity(e, bad).first().q
    assert G.notes_flipped(good, nodes.select("node", (9 - F.floor(F.col("node") / 6)).alias("label"))) == 0
    assert G.notes_flipped(good, good.select("node", F.when(F.col("node") == 0, 77).otherwise(F.col("label")).alias("label"))) == 1


def test_missing_edge(spark):
    nodes, e = make(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5)], 6)
    e = G.simple_edges(e)
    assert tuple(G.missing_edge(e, G.components(nodes, e)).first()) == (3, 5)


def test_communities_of_two_cliques(spark):
    nodes, e = make(spark, two_cliques(), 14)
    e = G.simple_edges(e)
    top = K.communities(nodes, e)
    last = {r.node: r.label for r in top.filter("node < 12").collect()}
    assert {frozenset(n for n in last if last[n] == g) for g in set(last.values())} == {frozenset(range(6)), frozenset(range(6, 12))}
    assert {r.label for r in top.filter("node >= 12").collect()} == {12, 13}
    assert sorted(map(tuple, K.communities(nodes, e).collect())) == sorted(map(tuple, top.collect()))
    parallel = K.parallel_moves(e)
    assert G.modularity(e, parallel).first().q > 0.35
    assert K.communities(nodes, e, max_edges=1).filter("node < 12").count() == 12


def test_ladder_shrinks_to_one(spark):
    nodes, e = make(spark, ring(50), 52)
    levels = K.coarsening(nodes, G.simple_edges(e), arity=4)
    sizes = [r.groups for r in K.ladder_report(levels.filter("node < 50"), 4).orderBy("level").collect()]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 1 and sizes[0] <= 25
    assert {r.label for r in levels.filter("node >= 50").collect()} == {-1}
    assert K.heavy_matching([(a, b, 1.0) for a, b in ring(6)]).keys() == set(range(6))


def test_specks_and_oversized(spark):
    nodes, e = make(spark, two_cliques(), 12)
    e = G.simple_edges(e)
    labels = nodes.select("node", F.when(F.col("node") == 3, 99).otherwise(F.floor(F.col("node") / 6)).alias("label"))
    merged = {r.node: r.label for r in K.merged_specks(labels, e, 2).collect()}
    assert merged[3] == 0
    one = nodes.select("node", F.lit(0).cast("long").alias("label"))
    assert K.split_oversized(one, e, 6).select("label").distinct().count() == 2


def _grid(spark, k=12):
    return spark.range(k * k).select(F.col("id").alias("node"), (F.col("id") % 2).alias("component"), (F.col("id") % k).cast("double").alias("x"), F.floor(F.col("id") / k).cast("double").alias("y"))


def test_curve_and_cells(spark):
    pos = _grid(spark)
    ordered = S.curve_order(S.hilbert_keys(pos))
    per = {c: sorted(r.pos for r in ordered.filter(F.col("component") == c).collect()) for c in (0, 1)}
    assert all(v == list(range(72)) for v in per.values())
    cells = defaultdict(list)
    for r in S.curve_cells(ordered, 8).collect():
        cells[r.component, r.leaf].append(r.pos)
    assert all(4 <= len(v) <= 8 and max(v) - min(v) == len(v) - 1 for v in cells.values())
    assert S.chunk([1, 1, 9, 1, 1, 1, 1, 1, 1], 4) == [3, 5, 7, 10] or sum(1 for _ in S.chunk([1] * 9, 4)) >= 3
    assert S.curve_cells(ordered, 8, stretch=20).count() == 144


def test_level_of_detail(spark):
    pos = _grid(spark)
    leaf = S.curve_cells(S.curve_order(S.hilbert_keys(pos)))
    levels = leaf.select(F.lit(0).alias("level"), "node", (F.col("component") * 1000 + F.col("leaf")).alias("label")).unionByName(pos.select(F.lit(1).alias("level"), "node", F.col("component").alias("label")))
    tree = S.tree_of(levels, pos)
    for budget in (2, 10, 60, 1000):
        shown = S.lod_cut(tree, 50.0, 4.0, budget)
        assert shown.count() <= max(2, budget)
        of = S.cut_of_notes(tree, shown)
        assert of.count() == 144 == of.select("node").distinct().count()
    assert S.lod_cut(tree, 50.0, 4.0, 1000).filter("node IS NOT NULL").count() == 144
    assert S.lod_cut(tree, 50.0, 4.0, 1000, box=(-1, -1, 2, 2)).count() < 144
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(143)], "a long, b long, w double")
    top = S.lifted_links(e, S.cut_of_notes(tree, S.lod_cut(tree, 50.0, 4.0, 10)), 3)
    assert top.count() <= 3


def test_layout_is_repeatable(spark):
    pos = _grid(spark)
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(143)], "a long, b long, w double")
    labels = pos.select("node", F.col("component").alias("label"))
    a = {r.node: (round(r.x, 6), round(r.y, 6)) for r in S.force_layout(e, labels).collect()}
    assert len(set(a.values())) == 144 and a == {r.node: (round(r.x, 6), round(r.y, 6)) for r in S.force_layout(e, labels).collect()}


def test_layout_solves_groups_of_any_size(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 9, (400, 2)), rng.normal(30, 0.5, (400, 2))])
    d = xy[:, None] - xy[None]
    plain = (d / ((d**2).sum(2) + 0.05)[..., None]).sum(1)
    off = np.linalg.norm(S.repulsion(xy) - plain, axis=1) / np.linalg.norm(plain, axis=1).mean()
    assert np.median(off) < 0.03 and off.max() < 0.3
    n = 5200
    e = spark.createDataFrame([(i, i // 2, 1.0) for i in range(1, n)], "a long, b long, w double")
    labels = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("label"))

    def shape(**more):
        at = {r.node: (r.x, r.y) for r in S.force_layout(e, labels, **more).collect()}
        p = np.array([at[i] for i in range(n)])
        return np.linalg.norm(p[1:] - p[np.arange(1, n) // 2], axis=1).mean(), len(set(map(tuple, p.round(4)))), len(at)

    i = np.arange(n)
    spiral = np.sqrt(i + 0.5)[:, None] * np.stack([np.cos(i * 2.399963229728653), np.sin(i * 2.399963229728653)], 1)
    spiral = np.linalg.norm(spiral[1:] - spiral[i[1:] // 2], axis=1).mean()
    for more in ({}, {"most": 1000}):
        length, places, found = shape(**more)
        assert found == n == places and length < 0.8 * spiral


def test_spiral_is_a_walk(spark):
    from noteweave.functions import geometry

    cells = [tuple(r) for r in spark.range(200).select("id", geometry.hex_spiral(F.col("id")).alias("h")).orderBy("id").select("h.q", "h.r").collect()]
    assert len(set(cells)) == 200 and cells[0] == (0, 0)
    ring = lambda q, r: max(abs(q), abs(r), abs(q + r))
    assert [ring(*c) for c in cells] == sorted(ring(*c) for c in cells)


def test_probe_and_shapes(spark):
    nodes, e = make(spark, two_cliques(), 12)
    e = G.simple_edges(e)
    flipped, n = G.stability_probe(nodes, e, lambda x, y: K.communities(x, y).filter("level = 0").select("node", "label"))
    assert n == 12 and flipped <= 2
    labels = nodes.select("node", F.floor(F.col("node") / 6).alias("label"))
    assert [(r["shape"], r["n"]) for r in G.community_shapes(e, labels).collect()] == [("clique", 2)]


def test_note_graph_covers_every_living_note(spark):
    from noteweave.operators import resolve
    from noteweave.plans import structure_queries as Q
    from tests.conftest import DATA

    living = {r[0] for r in resolve.living(spark.read.parquet(f"{DATA}/notes.parquet")).select(F.xxhash64("note_key")).collect()}
    levels = Q.communities(spark, DATA).filter("level = 0")
    found = {r.node for r in levels.collect()}
    assert living <= found and levels.count() == len(found)
    assert {r.node for r in Q.region_labels(spark, DATA).collect()} == found
    bottom = Q.coarsening_ladder(spark, DATA).filter("level = 0").first()
    assert round(bottom.groups * bottom.mean_size) == len(found)


def _planted(spark):
    rng = random.Random(1)
    edges = set()
    for _ in range(900):
        g = rng.randrange(12)
        a, b = g * 20 + rng.randrange(20), (g if rng.random() < 0.92 else rng.randrange(12)) * 20 + rng.randrange(20)
        if a != b:
            edges.add((min(a, b), max(a, b)))
    return spark.range(245).select(F.col("id").alias("node")), spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges)], "a long, b long, w double")


def test_large_components_get_all_levels(spark):
    nodes, e = _planted(spark)
    levels = K.communities(nodes, e, 50).cache()
    counts = {r.level: r.k for r in levels.groupBy("level").agg(F.count_distinct("label").alias("k")).collect()}
    assert sorted(counts) == list(range(len(counts))) and len(counts) >= 2
    top = levels.filter(f"level = {len(counts) - 1}").select("node", "label")
    assert G.modularity(e, top).first().q > 0.8
    assert levels.filter("level = 0").count() == 245


def test_tree_of_cells(spark):
    levels = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 3), (0, 4, 4), (1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 4, 1), (0, 9, 9), (0, 8, 8), (1, 8, 8), (1, 9, 8)], "level int, node long, label long")
    got = sorted(tuple(r) for r in K.tree_cells(levels).collect())
    assert got == [(0, 1, 2, 2, 0, 2), (0, 2, 3, 1, 0, 3), (0, 3, 4, 0, None, None), (2, 2, 1, 2, 0, 2), (3, 3, 1, 1, 0, 3), (4, 4, 1, 1, 4, 5), (4, 5, 2, 0, None, None), (5, 5, 1, 1, 4, 5)]


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(4)
    a = [(i, rng.randrange(6)) for i in range(200)]
    b = [(i, rng.randrange(5)) for i in range(200)]
    over = defaultdict(int)
    for (i, x), (_, y) in zip(a, b, strict=True):
        over[x, y] += 1
    old, new, want = set(), set(), set()
    for (x, y), n in sorted(over.items(), key=lambda t: (-t[1], t[0])):
        if x not in old and y not in new:
            old.add(x)
            new.add(y)
            want.add((x, y, n))
    got = {tuple(r) for r in G.matched_groups(spark.createDataFrame(a, "node int, label int"), spark.createDataFrame(b, "node int, label int")).collect()}
    assert got == want
    assert G.notes_flipped(spark.createDataFrame(a, "node int, label int"), spark.createDataFrame(b, "node int, label int")) == 200 - sum(n for *_, n in want)


def test_components_of_a_long_path_reach_the_fixed_point(spark):
    n = 3000
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "a int, b int")
    nodes = spark.range(n + 1).select(F.col("id").cast("int").alias("node"))
    assert G.components(nodes, e).select("component").distinct().collect()[0][0] == 0


@pytest.mark.parametrize("seed", range(3))
def test_heavy_groups_are_those_found_one_by_one_at_any_size(spark, seed):
    import inspect

    rng = random.Random(seed)
    rows = [(rng.randrange(40), int(40 * rng.random() ** 2), float(rng.randrange(1, 4))) for _ in range(90)] + [(60 + i, 0, 1.0) for i in range(9)]
    got = {r.node: r.label for r in K.heavy_groups(spark.createDataFrame(rows, "a long, b long, w double")).collect()}
    assert got == K.heavy_matching(rows)
    assert list(inspect.signature(K.heavy_groups).parameters) == ["e", "most"]  # no bound by size


def test_ladders_keep_their_arity_above_the_bound(spark):
    nodes, e = _planted(spark)
    for arity in (4, 7):
        levels = K.coarsening(nodes, e, arity, 300).cache()
        below = levels.select((F.col("level") + 1).alias("level"), "node", F.col("label").alias("low"))
        wide = levels.filter("label <> -1").join(below, ["level", "node"], "left").groupBy("level", "label").agg(F.count_distinct(F.coalesce("low", "node")).alias("k"))
        assert wide.agg(F.max("k")).first()[0] <= arity
        assert levels.filter("level = 0").count() == 245


def test_parallel_moves_are_the_same_on_arrays_and_tables(spark):
    _, e = _planted(spark)
    odd = e.unionByName(spark.createDataFrame([(3, 3, 2.0), (7, 7, 0.5), (500, 500, 1.0)], e.schema))
    on = [sorted(map(tuple, K.parallel_moves(odd, 3, n).collect())) for n in (10**6, -1)]
    assert on[0] == on[1] and len({g for _, g in on[0]}) < 200
    parts = K.connected_parts(odd, K.parallel_moves(odd)).select("node", "label")
    assert sorted(map(tuple, K._array_labels(odd, 16, True).collect())) == sorted(map(tuple, parts.collect()))
    assert K.parallel_moves(e.filter("false")).isEmpty()
