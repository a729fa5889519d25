"""Vault folders, wiki dumps, synthetic graphs, incremental maintenance, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noteweave.sources import mediawiki as W
from noteweave.sources import synth as Y
from noteweave.sources import vault as V
from noteweave.streaming import incremental as I


def test_vault_listing_and_skip(spark, tmp_path):
    for name, text in {"a.md": "# a", "b/c.markdown": "[[a]]", "b/p.PNG": "x", ".hidden/d.md": "no", "b/.e.md": "no", "f.txt": "t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    seen = V.listing(spark, str(tmp_path)).cache()
    assert {(r.path, r.kind) for r in seen.collect()} == {("a.md", "note"), ("b/c.markdown", "note"), ("b/p.PNG", "media"), ("f.txt", "other")}
    assert {r.path for r in V.unread(seen, seen.filter("path = 'a.md'")).collect()} == {"b/c.markdown"}
    assert {r.note_key: r.text for r in V.contents(spark, str(tmp_path), seen.filter("path = 'a.md'")).collect()} == {"a.md": "# a"}
    assert [tuple(r) for r in V.media(seen).collect()] == [("b/p.PNG", "p", "p", "p.png")]
    there, gone = V.scoped(seen, spark.createDataFrame([("a.md",), ("z.md",)], "path string"))
    assert [r.path for r in there.collect()] == ["a.md"] and [r.path for r in gone.collect()] == ["z.md"]
    seen.unpersist()


def test_wiki_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A_b</title><ns>0</ns><revision><text>== H ==\n'''x''' [[C d|e]]s</text></revision></page><page><title>R</title><ns>0</ns><redirect title='A b'/><revision><text/></revision></page></mediawiki>")
    rows = {r.title: r for r in W.read_dump(spark, str(tmp_path / "d.xml")).collect()}
    assert rows["R"].redirect == "A b" and rows["A_b"].redirect is None
    md = W.wikitext_to_markdown(rows["A_b"].text, {"C d": "C d"}.get)
    assert md == "## H\n**x** [[C d|es]]\n"
    assert W.wikitext_to_markdown("a<!-- n --> {{t|{{u}}}}b [[X]] [http://u w] [[File:x.png]]<ref>r</ref>", lambda t: None) == "a b X w\n"
    assert W.unescape("a &lt;b&gt; &#65;&#x42; &amp;amp; &nope;") == "a <b> AB &amp; &nope;"


def test_written_vault(spark, tmp_path):
    arts = spark.createDataFrame([("A/b", "one", 2), ("A-b", "zero", 1), ("C", "x", 3)], "title string, body string, position int")
    W.write_vault(arts, str(tmp_path / "out"))
    files = {f.name: f.read_text(encoding="utf-8") for f in (tmp_path / "out").iterdir()}
    assert files == {"A-b.md": "# A-b\n\nzero", "C.md": "# C\n\nx"}
    W.write_vault(arts, str(tmp_path / "out"))
    assert {r.note_key for r in V.contents(spark, str(tmp_path / "out"), V.listing(spark, str(tmp_path / "out"))).collect()} == set(files)


def test_extensions_in_any_case_are_read(spark, tmp_path):
    names = {"a.md", "b.MD", "c.Md", "d.mD", "e.MARKDOWN", "f.Markdown", "g.markDown"}
    for name in names | {"h.mdx", "i.txt"}:
        (tmp_path / name).write_text("x")
    seen = V.listing(spark, str(tmp_path))
    assert {r.path for r in seen.filter("kind = 'note'").collect()} == names
    assert {r.note_key for r in V.contents(spark, str(tmp_path), seen.filter("kind = 'note'")).collect()} == names


def test_a_root_with_too_many_files_is_an_error(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.md").write_text("x")
    assert V.count_files(spark, str(tmp_path)) == 5 and V.listing(spark, str(tmp_path), 5).count() == 5
    with pytest.raises(ValueError):
        V.listing(spark, str(tmp_path), 4)


@pytest.mark.parametrize("spec, want", [("synth:10", (10, "scale_free", 4.0)), ("synth:5:chain", (5, "chain", 4.0)), ("synth:5:islands:99", (5, "islands", 64.0))])
def test_specs(spec, want):
    assert Y.parse_spec(spec) == want
    for bad in ("x:1", "synth", "synth:5:blob", "synth:-1", "synth:a"):
        with pytest.raises(ValueError):
            Y.parse_spec(bad)


def test_synthetic_shapes(spark):
    from noteweave.operators import graph as G

    for shape in Y.SHAPES:
        a = sorted(map(tuple, Y.graph(spark, f"synth:300:{shape}:4", 3).collect()))
        assert a == sorted(map(tuple, Y.graph(spark, f"synth:300:{shape}:4", 3).collect())) and all(x != y for x, y in a) and len(set(a)) == len(a)
    e = Y.graph(spark, "synth:3000:scale_free:6", 1)
    deg = G.both_ways(e.withColumn("w", F.lit(1.0))).groupBy("u").count().agg(F.max("count").alias("m"), F.avg("count").alias("a")).first()
    assert 4 < deg.a < 7 and deg.m > 15 * deg.a
    c = Y.communities(spark, 3000, 8, 1, 0.1)
    inside = c.filter(F.floor(F.col("a") / 256) == F.floor(F.col("b") / 256)).count()
    assert inside > 0.8 * c.count()
    comp = spark.range(300).select(F.col("id").alias("node"), (F.col("id") % 6).alias("component"))
    assert 0 < Y.bridges(comp, 0.2).count() < 120
    p = Y.folder_paths(comp, 0.0)
    assert p.join(comp, "node").groupBy("component").agg(F.count_distinct(F.regexp_replace("path", "/[^/]*$", "")).alias("k")).agg(F.max("k")).first()[0] == 1
    from noteweave.operators import parse

    docs = Y.documents(spark, 20, Y.chain(spark, 20))
    assert parse.child(parse.scanned(docs), "links").count() == 19


STATE = "path string, hash string, mtime int"


def test_outcomes(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 1)], STATE)
    new = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), ("c", "2", 2), ("e", "1", 1)], STATE)
    out = I.outcomes(old, new)
    assert {r.path: r.outcome for r in out.collect()} == {"a": "unchanged", "b": "touched", "c": "rewrote", "d": "vanished", "e": "added"}
    named = spark.createDataFrame([("c",)], "path string")
    assert I.is_structural(out.filter("path = 'c'"), named.limit(0)).first()[0] is False
    assert I.is_structural(out.filter("path = 'c'"), named).first()[0] is True
    assert I.is_structural(out.filter("path = 'e'"), named).first()[0] is True
    assert I.missing(old, new, complete=False).count() == 0 and [r.path for r in I.missing(old, new, complete=True).collect()] == ["d"]


def test_scoped_relink_equals_full(spark):
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "src_key string, raw string")
    resolve = lambda ls: ls.select("src_key", F.upper("raw").alias("dst_key"))
    before = resolve(spark.createDataFrame([("a", "old"), ("b", "x")], "src_key string, raw string"))
    changed = spark.createDataFrame([("a", "rewrote")], "path string, outcome string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(I.relinked(changed, False, links, resolve, before)) == rows(I.relinked(changed, True, links, resolve, before)) == rows(resolve(links))


def test_edges_signatures_overlay(spark):
    e = "src_key string, dst_key string"
    old = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x")], e)
    new = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], e)
    assert {r.src_key: r.same for r in I.same_edges(old, new).collect()} == {"a": False, "b": True, "c": False}
    s = lambda df: {r.node: r.signature for r in I.link_signatures(df).collect()}
    assert s(old)["x"] == s(new)["x"] and s(new)["y"] != s(new)["x"]
    over = I.with_overlay(old, spark.createDataFrame([("a", "z")], e))
    assert sorted(map(tuple, over.collect())) == [("a", "z"), ("b", "x")]


def test_retired_notes_live_on(spark):
    gone = spark.createDataFrame([("a.md", "A b"), ("b.md", "B")], "note_key string, stem string")
    links = spark.createDataFrame([("a.md",), ("a.md",)], "dst_key string")
    assert [tuple(r) for r in I.retired(gone, links).collect()] == [("phantom:a b", "A b", 2)]


def test_event_stream(spark, tmp_path):
    schema = "path string, kind string, old_path string, truncated boolean"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a.md", "write", None, False), ("a.md", "write", None, False), ("p.png", "write", None, False), ("n.md", "rename", "o.md", False), ("d", "dir", None, False), ("x.txt", "write", None, None)], schema).write.mode("overwrite").parquet(str(tmp_path / "in"))
    got = []
    q = I.follow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df, n: got.extend(map(tuple, df.collect())), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(got) == [("a.md", "read"), ("d", "sweep"), ("n.md", "read"), ("o.md", "read"), ("p.png", "sweep")]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert I.current(spark, root) is None
    with pytest.raises(FileNotFoundError):
        I.load(spark, root, "notes")
    for v in (1, 2):
        I.publish({"notes": spark.range(v)}, root, v, {"note_count": v})
    assert I.current(spark, root)["note_count"] == 2 and I.load(spark, root, "notes").count() == 2


def test_old_and_new_landings(spark):
    from noteweave.operators.query import current_notes

    t = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [("a.md", "a.md", "a", "a", "old", 1, t[0], t[0], True, False), ("a.md", "a.md", "a", "a", "new", None, t[1], t[1], True, False), ("b.md", "b.md", "b", "b", "", 1, t[0], t[0], False, False)]
    n = spark.createDataFrame(rows, "note_key string, path string, stem string, stem_fold string, title string, size long, mtime timestamp, landed_at timestamp, alive boolean, phantom boolean")
    assert [(r.note_key, r.title) for r in current_notes(n).collect()] == [("a.md", "new")]
