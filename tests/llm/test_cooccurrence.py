"""Pairs of items against brute force."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from noteweave.llm import cooccurrence as C


def brute(rows, least, lift):
    baskets = defaultdict(set)
    for a, b in rows:
        if a is not None and b is not None and a != b:
            baskets[a].add(b)
    n, single, pair = len(baskets), Counter(), Counter()
    for items in baskets.values():
        single.update(items)
        pair.update(combinations(sorted(items), 2))
    return {(x, y): (t, single[x], single[y], n) for (x, y), t in pair.items() if t >= least and t * n >= lift * single[x] * single[y]}


def got(df):
    return {(r.item_lo, r.item_hi): (r.n_together, r.n_lo, r.n_hi, r.n_records) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 5, 64])
def test_against_brute_force(spark, most):
    rng = random.Random(most)
    rows = [(rng.randrange(30), min(rng.randrange(25), rng.randrange(25))) for _ in range(600)] + [(99, b) for b in range(40)] + [(None, 1), (1, None), (3, 3)]
    rows += rows[:100]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "a int, b int, n int, weight int")
    for least, lift in ((1, 0.0), (2, 1.2), (3, 4.0)):
        assert got(C.item_pairs(df, "a", "b", least, lift, most)) == brute(rows, least, lift)


def test_large_baskets_collapse_too(spark, monkeypatch):
    rows = [(r, b) for r in range(20) for b in range(100, 100 + 90 + r % 3)] + [(r, b) for r in range(50, 60) for b in range(100, 103)]
    df = spark.createDataFrame(rows, "a int, b int")
    want = brute(rows, 1, 0.0)
    assert got(C.item_pairs(df, "a", "b")) == want
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert got(C.item_pairs(df, "a", "b")) == want


def test_measures(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 11), (3, 12), (4, 10)], "a int, b int")
    r = C.item_pairs(df, "a", "b").first()
    assert (r.n_together, r.expected, round(r.lift, 6)) == (2, 1.5, 1.333333)
    assert (round(r.conviction_lo_hi, 6), r.conviction_hi_lo) == (1.5, None)


def test_empty_single_and_strings(spark):
    assert C.item_pairs(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0
    assert C.item_pairs(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"), "a", "b").count() == 0
    assert got(C.item_pairs(spark.createDataFrame([("r", "x"), ("r", "y")], "a string, b string"), "a", "b")) == {("x", "y"): (1, 1, 1, 1)}
