"""Orphan references."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noteweave.operators import references as R

KEYS = "x int, y int"


def rows(df):
    return sorted(((r.x, r.y) for r in df.collect()), key=repr)


@pytest.fixture
def tables(spark):
    refs = spark.createDataFrame([(1, 1), (1, 2), (1, None), (9, None), (None, 2), (None, 8), (None, None), (1, 2), (5, 5)], KEYS)
    targets = spark.createDataFrame([(1, 1), (3, 2), (5, None), (1, 1)], KEYS)
    return refs, targets


def test_simple(tables):
    assert rows(R.orphans(*tables, ["x", "y"], "simple")) == [(1, 2), (1, 2), (5, 5)]


def test_partial(tables):
    assert rows(R.orphans(*tables, ["x", "y"], "partial")) == sorted([(1, 2), (1, 2), (5, 5), (9, None), (None, 8)], key=repr)


def test_full(tables):
    assert rows(R.orphans(*tables, ["x", "y"], "full")) == sorted([(1, 2), (1, 2), (5, 5), (1, None), (9, None), (None, 2), (None, 8)], key=repr)
    with pytest.raises(ValueError):
        R.orphans(*tables, ["x", "y"], "most")


def test_semantics_mask_by_mask(spark, tables):
    rules = {(True, True): R.MATCH, (True, False): R.ORPHAN, (False, True): R.NOTHING, (False, False): R.ORPHAN}
    assert rows(R.orphans(*tables, ["x", "y"], rules)) == sorted([(1, 2), (1, 2), (5, 5), (1, None), (9, None), (None, None)], key=repr)
    with pytest.raises(ValueError):
        R.orphans(*tables, ["x", "y"], {(True, True): R.MATCH})


def test_a_mask_is_one_join_without_or(spark, tables):
    plan = R.orphans(*tables, ["x", "y"], "partial")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 3 and " OR " not in plan


def test_times(spark):
    refs = spark.createDataFrame([(1, 5), (1, 1), (1, None), (2, 5), (3, 5)], "k int, at int")
    targets = spark.createDataFrame([(1, 3), (1, 4), (3, None)], "k int, since int")
    left = R.orphans(refs, targets, ["k"], "partial", "at", "since")
    assert sorted((r.k, r.at) for r in left.collect()) == [(1, 1), (2, 5), (3, 5)]


def test_without_a_time_the_rest_is_matched(spark):
    refs = spark.createDataFrame([(3, None), (3, 5), (4, None), (None, 5), (None, None)], "k int, at int")
    targets = spark.createDataFrame([(3, None), (None, 1)], "k int, since int")
    assert sorted((r.k, r.at) for r in R.orphans(refs, targets, ["k"], R.LINK_MATCH, "at", "since").collect()) == [(3, 5), (4, None)]
    assert sorted(((r.k, r.at) for r in R.orphans(refs, targets, ["k"], R.PAGE_MATCH, "at", "since").collect()), key=repr) == [(3, 5), (4, None), (None, 5), (None, None)]
    assert sorted(((r.k, r.at) for r in R.orphans(refs, targets, ["k"], "simple", "at", "since").collect()), key=repr) == [(3, 5)]


def test_empty_tables_and_extra_columns(spark):
    refs = spark.createDataFrame([(1, "a")], "k int, since string")
    none = refs.limit(0)
    assert R.orphans(none, refs, ["k"]).count() == 0
    left = R.orphans(refs, none, ["k"])
    assert left.columns == ["k", "since"] and left.count() == 1


def test_link_name(spark):
    cases = {
        "Foo": "foo", "a/b/Foo.MD#x": "foo", " Foo%20Bar.md ": "foo bar", "http://x.y": None, "Foo#a:b": None, "img.png": None, "#top": None, "": None, "  ": None,
        "Ｆｏｏ": "foo", "F​oo Bar": "foo bar", "Fоo": "foo", "100% Foo": "100% foo", "Foo%2Fbar": "bar", "Café%C3%A9": "caféé", "x²": "x²",
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").union(spark.createDataFrame([(None, None)], "raw string, want string"))
    for r in df.withColumn("got", R.link_name(F.col("raw"))).collect():
        assert r.got == r.want, r.raw


def test_page_title(spark):
    cases = {"foo_bar": "Foo bar", "  foo  bar__x#y": "Foo bar x", "#x": None, "": None, "éa": "éa", "Зона": "Зона"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    for r in df.withColumn("got", R.page_title(F.col("raw"))).collect():
        assert r.got == r.want, r.raw


def test_report_and_rows(spark):
    t = datetime(2024, 5, 1)
    late = datetime(2024, 6, 1)
    notes = spark.createDataFrame([("a.md", "A", True, False, late), ("b.md", "B", True, False, t), ("c.md", "C", False, False, t), ("p", "P", True, True, t)], "note_key string, stem string, alive boolean, phantom boolean, landed_at timestamp")
    aliases = spark.createDataFrame([("b.md", "Bee")], "note_key string, alias string")
    hubs = spark.createDataFrame([("Hub", None), ("Other", ["H2"])], "title string, aliases array<string>")
    links = spark.createDataFrame([(1, "A", t), (2, "B", t), (3, "C", t), (4, "P", t), (5, "bee", t), (6, "hub", t), (7, "h2", t), (8, "x.png", t), (9, None, t), (1, "A", t), (10, "a", late)], "link_id long, raw string, seen_at timestamp")
    pages = spark.createDataFrame([(1, "One", "0", "two", True, t), (2, "Two", "0", None, True, late), (3, "Three", "0", "hub#x", True, t), (4, "Four", "0", "#only", True, late), (5, "Five", "0", "two", True, late), (6, "X", "1", "", True, t)], "page_id long, title string, ns string, redirect string, alive boolean, landed_at timestamp")
    found = {(r.tbl, r.row_id) for r in R.orphan_rows(links, pages, notes, aliases, hubs).collect()}
    assert found == {("links", 1), ("links", 3), ("links", 4), ("wiki_pages", 1), ("wiki_pages", 4)}
    report = {(r.tbl, r.month): (r.n_refs, r.n_orphans) for r in R.orphan_report(links, pages, notes, aliases, hubs).collect()}
    assert report == {("links", "2024-05"): (7, 3), ("links", "2024-06"): (1, 0), ("wiki_pages", "2024-05"): (2, 1), ("wiki_pages", "2024-06"): (2, 1)}
