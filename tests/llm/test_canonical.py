"""Mapping typed values to a canonical list."""

import pytest

from noteweave.llm import canonical as C

HUBS = [(1, "Grey Viradarik Handbook", ["Viradarik", "Gizafevum Commission"]), (2, "Château of Hajefibes", ["Mafegugok"]), (3, "Zavasetis Peninsula", None), (4, "Pehanetan Railway", []), (5, "Sabuzaben Conference", None), (6, "Commission of Sabuzaben", None)]
INDEX = C.Index([(h, n) for h, t, a in HUBS for n in [t, *(a or [])]])


@pytest.mark.parametrize(
    "value, entry",
    [
        ("Grey Viradarik Handbook", 1), ("grey  viradarik handbook", 1), ("GREY VIRADARIK HDBK", 1), ("Grey Viradarik Hdbk.md", 1), ("Viradaric", 1), ("[[Viradarik", 1), ("todo: Viradraik", 1),
        ("Gisaphevum Comm.", 1), ("Chateau Hajefibes", 2), ("Château oph Hajefibes", 2), ("notes/Mafeguugok#top", 2), ("Zavasetis%20Pen.", 3), ("ZavasetisPeninsula", 3), ("Peninsula, Zavasetis!", 3),
        ("ZAVASETISPENINSUAL", 3), ("Gｒey Viradarik Handbook", 1), ("Grey Viradarik Handbo", 1), ("The Pehanetan Rwy", 4), ("CommissionofSabuzaben", 6), ("Zavasetis eninsula", 3), ("ZavasetisP eninsula", 3), ("Château opth Hajefibes", 2), ("Sabuzaben Conf.", 5),
        ("Pehanetan Spillway", None), ("Viradarik Festival", None), ("Bacudopir Handbook", None), ("Handbook", None), ("aaa", None), ("2024-05-03", None), ("", None), ("  ", None), (None, None), ("???", None),
    ],
)
def test_meaning(value, entry):
    m = INDEX.match(value)
    assert (m and m[0]) == entry


def test_ties_match_nothing():
    index = C.Index([(1, "Alpha Station"), (2, "Alpha Station")])
    assert index.match("Alpha Station") is None
    assert C.Index([]).match("Alpha") is None


def test_edits_against_plain_distance():
    assert C.edits("abcd", "abdc") == 1 and C.edits("", "abc") == 3 and C.edits("kitten", "sitting") == 3 and C.edits("a", "a") == 0


def test_recall_of_retrieval_against_brute_force():
    import math

    values = ["Grey Viradrik Handbok", "Zavasetis Pen", "Hajefibes Chateau", "Pehanetan Railwy"]
    for v in values:
        words = C.ascii_words(v)
        a = C.grams(words)
        scores = []
        for name in INDEX.names:
            b = C.grams(name)
            x = {g: INDEX.idf.get(g, INDEX.rare) * (1 + math.log(n)) for g, n in a.items()}
            y = {g: INDEX.idf[g] * (1 + math.log(n)) for g, n in b.items()}
            dot = sum(x[g] * y[g] for g in x.keys() & y.keys())
            scores.append(dot / math.sqrt(sum(t * t for t in x.values()) * sum(t * t for t in y.values())))
        want = {i: round(s, 9) for i, s in enumerate(scores) if s >= C.NEAR}
        assert {i: round(s, 9) for s, i in INDEX.retrieve(words)} == want


def test_short_names_are_names():
    index = C.Index([(1, "Go"), (2, "R"), (3, "UX"), (4, "Rust")])
    assert [index.match(v) and index.match(v)[0] for v in ("Go", "go", "R", "[[UX]]", "rust", "C", "x")] == [1, 1, 2, 3, 4, None, None]


def test_acceptance_is_the_cosine():
    name, weight = ["grey", "viradarik"], {"grey": 1.0, "viradarik": 3.0}
    assert C.compare(name, ["grey", "viradarik"], weight, 5.0) == (1.0, True)
    cosine, spelt = C.compare(name, ["viradarik"], weight, 5.0)
    assert not spelt and abs(cosine - 3 / 10**0.5) < 1e-9
    cosine, spelt = C.compare(name, ["grey", "viradarik", "station"], weight, 5.0)
    assert not spelt and abs(cosine - 10 / (10 * 35) ** 0.5) < 1e-9
    found = [(1, name), (2, ["grey", "viradarin"])]
    assert C.decide(["grey", "viradarik"], found, weight, 5.0)[0] == 1
    assert C.decide(["grey", "viradarik"], found, weight, 5.0, threshold=1.1) is None
    assert C.decide(["grey", "viradarik"], found, weight, 5.0, margin=0.5) is None


def _tables(spark):
    typed = [(1, "Viradarik"), (1, "Viradarik"), (2, "viradarik?"), (3, None), (4, ""), (5, "aaa"), (6, "Zavasetis Peninsula" + " x" * 50_000), (7, "Mafegugok"), (8, "aaa")]
    values = spark.createDataFrame([(i, v, "e", 0.5) for i, v in typed], "typed_id long, raw string, entry string, margin double")
    hubs = spark.createDataFrame([(*h, "v") for h in HUBS], "hub_id int, title string, aliases array<string>, value string")
    return values, hubs


@pytest.mark.parametrize("most", [C.MAX_NAMES, 0])
def test_operator_on_both_ways(spark, most):
    values, hubs = _tables(spark)
    got = {(r.value[:30] if r.value else r.value): (r.n_rows, r.entry) for r in C.map_values(values, "raw", hubs, "hub_id", "title", "aliases", max_names=most).collect()}
    assert got == {"Viradarik": (2, 1), "viradarik?": (1, 1), None: (1, None), "": (1, None), "aaa": (2, None), ("Zavasetis Peninsula" + " x" * 50)[:30]: (1, 3), "Mafegugok": (1, 2)}


def test_both_ways_give_the_same_rows(spark):
    values = ["Grey Viradarik Hdbk", "Viradaric", "gizafevum comision", "Chateau Hajefibes", "Zavasetis eninsula", "Pehanetan Spillway", "Sabuzaben Conf", "Comission of Sabuzaben", "Conference", "R", "Hajefibes", "the", "?"]
    df = spark.createDataFrame([(v,) for v in values], "raw string")
    hubs = spark.createDataFrame([*HUBS, (7, "R", ["The R"]), (8, "Pehanetan Station", None)], "hub_id int, title string, aliases array<string>")
    rows = [sorted((tuple(r) for r in C.map_values(df, "raw", hubs, "hub_id", "title", "aliases", max_names=most).collect()), key=repr) for most in (C.MAX_NAMES, 0)]
    assert rows[0] == rows[1] and sum(r[2] is not None for r in rows[0]) == 8


def test_rows_and_empty_tables(spark):
    values, hubs = _tables(spark)
    rows = sorted((r.typed_id, r.entry) for r in C.meant_entries(values, "typed_id", "raw", hubs, "hub_id", "title", "aliases").collect())
    assert rows == [(1, 1), (2, 1), (6, 3), (7, 2)]
    assert C.meant_entries(values.limit(0), "typed_id", "raw", hubs, "hub_id", "title", "aliases").count() == 0
    assert C.meant_entries(values, "typed_id", "raw", hubs.limit(0), "hub_id", "title", "aliases").count() == 0
    renamed = values.select(values.typed_id.alias("value"), "raw")
    assert C.meant_entries(renamed, "value", "raw", hubs, "hub_id", "title", "aliases").count() == 4
