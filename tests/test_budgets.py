"""Reports and cuts of the full size of the reference."""

from noteweave.functions import geometry
from noteweave.operators import graph as G
from noteweave.plans import graph_queries as Q
from noteweave.plans import structure_queries as S
from pyspark.sql import functions as F
from tests.conftest import DATA


def brute(nodes, pairs, k):
    degree = {n: 0 for n in nodes}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    gone = set(sorted(nodes, key=lambda n: (-degree[n], n))[:k])
    top = {n: n for n in nodes if n not in gone}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        if a in top and b in top:
            top[root(a)] = root(b)
    size = {}
    for n in top:
        size[root(n)] = size.get(root(n), 0) + 1
    return k, len(top), len(size), max(size.values())


def test_fragility_of_every_k(spark):
    nodes = [r.node for r in Q.nodes(spark, DATA).collect()]
    pairs = [(r.a, r.b) for r in G.simple_edges(spark.read.parquet(f"{DATA}/edges.parquet")).collect()]
    rows = Q.hub_fragility(spark, DATA).collect()
    assert sorted((r.k, r.n_left, r.n_components, r.largest) for r in rows) == [brute(nodes, pairs, k) for k in (1, 2, 5, 10, 25, 50)]


def test_links_by_the_budget_of_shown_cells(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(S.spatial, "lifted_links", lambda e, of, k: asked.append(k))
    S.lod_links(spark, DATA)
    shown = S.lod_cut(spark, DATA).agg(geometry.link_budget(F.count(F.lit(1))).alias("k")).first().k
    assert asked == [shown] and shown > 200
