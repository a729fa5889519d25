"""Look-alike rows and groups."""

import pytest

from noteweave.functions.lookalike import plain
from noteweave.llm import confusables as C


@pytest.mark.parametrize(
    "one, other",
    [
        ("Сора", "Copa"), ("C​opa", "Copa"), ("𝐩aypal", "paypal"), ("ℙaypal", "Paypal"), ("paypaI", "paypal"), ("paypa1", "paypal"), ("O0", "OO"), ("rnodern", "modern"), ("Ｆｏｏ", "Foo"),
        ("é", "é"), ("Ηello", "Hello"), ("ꓐob", "Bob"), ("ᎪΒС", "ABC"), ("ɡo", "go"), ("a’b", "a'b"), ("ﬁn", "fin"), ("ｱ", "ア"),
    ],
)
def test_skeleton_is_equal_for_lookalikes(one, other):
    assert C.skeleton(one) == C.skeleton(other)


@pytest.mark.parametrize("one, other", [("abc", "abd"), ("x²", "x2"), ("½", "1/2"), ("①", "1"), ("река", "reka"), ("é", "e"), ("", " ")])
def test_skeleton_tells_others_apart(one, other):
    assert C.skeleton(one) != C.skeleton(other)


def test_skeleton_is_stable():
    for s in ["", "modern 10|I", "Ｆоо é", "x" * 50_000 + "о"]:
        assert C.skeleton(C.skeleton(s)) == C.skeleton(s) and C.skeleton(plain(s)) == C.skeleton(s)
    assert C.skeleton(None) is None


def test_a_table_from_a_file(tmp_path):
    path = tmp_path / "confusables.txt"
    path.write_text("﻿# public format\n05AD ;\t0596 ;\tMA\t# * x\n2488 ;\t006C 002E ;\tMA\n0068 0069 ; 0061 ; MA\n\n", encoding="utf-8")
    more = C.read_confusables(str(path))
    assert more == {"֭": "֖", "⒈": "l."}
    assert C.skeleton("a⒉֭", C.prototypes(more)) == C.skeleton("a⒉֖", C.prototypes(more))


def test_rows(spark):
    rows = [(1, "Foo"), (1, "Foo"), (2, "Fоo"), (2, "Fоo"), (3, None), (4, ""), (5, "река"), (6, "a b"), (7, "x²"), (8, "Ｆoo" * 20_000), (9, "Сора"), (10, "é"), (11, "é"), (12, "–")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "id int, v string, plain string, tbl int")
    found = {(r.tbl, r.row_id) for r in C.dirty_rows([("t", df, "id", "v"), ("u", df.limit(0), "id", "v")]).collect()}
    assert found == {("t", 2), ("t", 6), ("t", 8), ("t", 11)}


def test_groups(spark):
    values = ["Copa", "Сора", "Copa", "C​opa", "x", None, "é", "é", "modern", "rnodern", "Bill", "BiIl", "BiIl"]
    got = {r.skeleton: (r.n_rows, r.n_spellings, r.plain) for r in C.groups(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got == {"Copa": (4, 3, "Copa"), "é": (2, 2, "é"), "rnodern": (2, 2, "modern"), "Bill": (3, 2, "BiIl")}
    assert C.groups(spark.createDataFrame([], "v string"), "v").count() == 0


def test_columns_agree_with_the_function(spark):
    values = ["modern 10|I", "Fоo", "", None, "a\tb", "𝐩aypal"]
    df = spark.createDataFrame([(v, "old") for v in values], "v string, plain string")
    got = {r.v: (r.plain, r.skeleton) for r in C.consistent(df, "v").collect()}
    assert got == {v: (plain(v), C.skeleton(v)) for v in values}
