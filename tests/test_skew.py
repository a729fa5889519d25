"""Tree aggregation."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from noteweave.operators import tree_aggregate as T

SCHEMA = "a int, b int, w double"


def brute(rows):
    n, nbr, w = defaultdict(int), defaultdict(set), defaultdict(list)
    for a, b, x in rows:
        for side, node, other in (("a", a, b), ("b", b, a)):
            if node is not None:
                k = side, node
                n[k] += 1
                if other is not None:
                    nbr[k].add(other)
                if x is not None:
                    w[k].append(x)
    return {k: (n[k], len(nbr[k]), round(sum(w[k]), 6) if w[k] else None) for k in n}


def got(df):
    return {(r.side, r.node): (r.n_rows, r.n_neighbours, None if r.sum_w is None else round(r.sum_w, 6)) for r in df.collect()}


def test_hot_keys_nulls_repeats(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None, rng.randrange(3, 50)]), rng.choice([7, 7, None, rng.randrange(50)]), rng.choice([None, 0.5, 1.25])) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for chunk, fan in ((64, 2), (10, 3), (100_000, 16)):
        assert got(T.node_stats(df, chunk, fan)) == brute(rows)


def test_depth_changes_only_the_balance(spark):
    rows = [(1, i % 5, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(T.node_stats(df)) == got(T.node_stats(df, 3, 2)) == brute(rows)
    assert [T.tree_depth(n, 16) for n in (0, 1, 16, 17, 256, 257, 10**6)] == [1, 1, 1, 2, 2, 3, 5]


def test_chunks_have_a_fixed_size_and_mark_hot_keys(spark):
    df = spark.createDataFrame([(i % 2 * (i % 1500),) for i in range(10_000)], "k int").coalesce(1)
    level = T.chunk_states(df, ["k"], {"n": ("sum", F.lit(1).cast("long"))}, 4_000)
    assert sorted(r[1] for r in level.groupBy("__chunk").agg(F.sum("n")).collect()) == [2000, 4000, 4000]
    assert {r.k for r in level.filter("__hot").collect()} == {0}
    kinds = {"n": ("sum", F.col("k").cast("long")), "lo": ("min", F.col("k")), "hi": ("max", F.col("k"))}
    assert [tuple(r) for r in T.tree_aggregate(df.withColumn("g", F.lit(None).cast("string")), ["g"], kinds, 700, 2).collect()] == [(None, sum(i % 2 * (i % 1500) for i in range(10_000)), 0, 1499)]


def test_empty_and_all_null(spark):
    assert T.node_stats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert T.frequent_nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(T.node_stats(spark.createDataFrame([(None, None, None)], SCHEMA))) == {}


def test_frequent_counts_all_rows_and_ties(spark):
    rows = [(1, 2, 1.0)] + [(None, None, None)] * 99
    found = {(r.side, r.node) for r in T.frequent_nodes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {("a", 1), ("b", 2)}
    assert T.frequent_nodes(spark.createDataFrame([*rows, (None, None, None)], SCHEMA)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 2, 1.0, "x", 5, 6)], SCHEMA + ", side string, n_rows int, __chunk int")
    assert got(T.node_stats(df)) == {("a", 1): (1, 1, 1.0), ("b", 2): (1, 1, 1.0)}
