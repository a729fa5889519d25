"""Resolution of targets against a plain reading of the rules."""

import random

import pytest

from noteweave.operators import parse, query, resolve

PATHS = ["Foo.md", "a/Foo.md", "a/b/foo.md", "Bar.md", "c/Baz Qux.md", "c/d/Deep.md", "a/Deep.md", "x/y/z/Only.md"]
ALIASES = [("Bar.md", "Foo"), ("Bar.md", "Barry"), ("c/Baz Qux.md", "BAR"), ("x/y/z/Only.md", "only one")]


def brute(target, source):
    """Nested loops over all candidates."""
    t = parse.re.sub(r"(?i)\.(markdown|md)$", "", target.split("#")[0].strip().rstrip("/\\"))
    here = source.rpartition("/")[0]
    fold = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    if "/" in t:
        for base in [here] if t.startswith(("./", "../")) else [here, ""] if here else [""]:
            parts = []
            for p in f"{base}/{t}".split("/"):
                if p == "..":
                    if not parts:
                        parts = None
                        break
                    parts.pop()
                elif p not in ("", "."):
                    parts.append(p)
            if not parts:
                continue
            way = "/".join(parts)
            for same in (lambda a, b: a == b, lambda a, b: fold(a) == fold(b)):
                hits = sorted(p for p in PATHS if same(p[:-3], way))
                if hits:
                    return hits[0], False
        return None
    names = [(p, p.rpartition("/")[2][:-3], 0) for p in PATHS] + [(p, a, 1) for p, a in ALIASES]
    for test in (lambda n, al: n == t and not al, lambda n, al: n == t and al, lambda n, al: fold(n) == fold(t) and not al, lambda n, al: fold(n) == fold(t) and al):
        hits = {p for p, n, al in names if test(n, al)}
        if hits:

            def near(p):
                d = p.rpartition("/")[0]
                shared = 0
                for x, y in zip(d.split("/"), here.split("/")):
                    if x != y or not x:
                        break
                    shared += 1
                return d != here, p.count("/"), -shared, p

            return min(hits, key=near), len(hits) > 1
    return None


@pytest.fixture
def vault(spark):
    notes = spark.createDataFrame([(p, p, p.rpartition("/")[2][:-3], True, False) for p in PATHS] + [("dead.md", "dead.md", "dead", False, False)], "note_key string, path string, stem string, alive boolean, phantom boolean")
    return notes, spark.createDataFrame(ALIASES, "note_key string, alias string")


def test_joined_equals_nested_loops(spark, vault):
    rng = random.Random(3)
    targets = ["Foo", "foo", "FOO", "Barry", "bar", "Baz Qux", "Foo#h", "Foo.md", "./Foo", "../Foo", "../../Foo", "a/foo", "b/foo.md", "Deep", "d/Deep", "/Foo", "only ONE", "nope", "dead", "c/baz qux"]
    sources = ["Foo.md", "a/s.md", "a/b/s.md", "c/d/s.md", "q/s.md"]
    rows = [(i, s, t) for i, (s, t) in enumerate((s, t) for s in sources for t in targets)]
    rng.shuffle(rows)
    links = spark.createDataFrame([(i, s, t, 0, "", "", "wikilink") for i, s, t in rows], "link_id long, src_key string, raw string, ord int, heading string, alias string, kind string")
    got = {r.link_id: (r.dst_path, r.ambiguous) if r.resolved else None for r in resolve.resolved_links(links, *vault).collect()}
    assert got == {i: brute(t, s) for i, s, t in rows}


def test_phantoms_keep_the_target_as_written(spark, vault):
    links = spark.createDataFrame([(1, "s.md", "New.md#bar"), (2, "s.md", "a/X"), (3, "s.md", "b/x"), (4, "s.md", "pic.png"), (5, "s.md", None), (2, "s.md", "a/X")], "link_id long, src_key string, raw string")
    r = resolve.resolved_links(links, *vault)
    assert {x.dst_key for x in r.collect()} == {"phantom:new.md#bar", "phantom:x"}
    ghosts = {x.stem_fold: (x.stem, x.inbound) for x in resolve.phantoms(r).collect()}
    assert ghosts["x"] == ("X", 3)


def test_completion_takes_marks_literally(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    notes = spark.createDataFrame([(f"{s}.md", f"{s}.md", s, s.lower(), "", 1, t, t, True, False) for s in ("100% x", "100a", "Zed", "ab_c", "abxc")], "note_key string, path string, stem string, stem_fold string, title string, size long, mtime timestamp, landed_at timestamp, alive boolean, phantom boolean")
    aliases = spark.createDataFrame([("Zed.md", "100 alias"), ("gone.md", "100 ghost")], "note_key string, alias string")
    names = lambda p, k=9: [r.name for r in query.complete(notes, aliases, p, k).orderBy("rank").collect()]
    assert names("100") == ["100% x", "100a", "100 alias"] and names("100%") == ["100% x"] and names("AB_") == ["ab_c"] and names("100", 1) == ["100% x"]
    assert names("x" * 600) == []


def test_a_name_in_every_folder_costs_rows_in_proportion(spark):
    """One stem in n folders, asked from n others: rows in the joins grow with n, not with n squared."""
    n = 400
    names = spark.createDataFrame([(f"d{i}/e/index.md", f"d{i}/e/index.md", "index", False) for i in range(n)] + [("x/index.md", "x/index.md", "index", False)], "note_key string, path string, name string, is_alias boolean")
    asked = spark.createDataFrame([("index", f"d{i}/e") for i in range(0, n, 2)] + [("index", f"d{i}/f/g") for i in range(n)] + [("INDEX", "x/y")], "target string, source_dir string")
    got = {(r.target, r.source_dir): (r.dst_path, r.ambiguous, r["pass"]) for r in resolve.resolve_names(asked, names).collect()}
    assert got["index", "d4/e"] == ("d4/e/index.md", True, 1) and got["index", "d5/f/g"] == ("x/index.md", True, 1) and got["INDEX", "x/y"] == ("x/index.md", True, 3)
    assert len(got) == n + n // 2 + 1
    joined = resolve.resolve_names(asked, names)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
