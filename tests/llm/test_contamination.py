"""Leaked evaluation passages against a plain search."""

import random
import time

from noteweave.llm import contamination as C

WORDS = [f"w{i}" for i in range(12)]


def brute(text, item, n):
    a, b = [w for w, _, _ in C.words_of(text)], [w for w, _, _ in C.words_of(item)]
    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in runs for i in range(len(a) - n + 1))


def test_random_texts():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=30))) for i in range(10)]
    s = C.Scanner(items, 4)
    for _ in range(60):
        text = ", ".join(rng.choices(WORDS, k=60))
        assert {h[0] for h in s.hits(text)} == {i for i, t in items if brute(text, t, 4)}


ITEM = "Under low light, the greenhouse of Sokovekus flooded 20 temporary reservoirs. Notes on the parser: northern."


def test_markup_case_and_line_breaks_do_not_count():
    s = C.Scanner([(7, ITEM)])
    for text in (
        ITEM.upper(),
        ITEM.replace(" ", "\n"),
        ITEM.replace("greenhouse", "**green­house**").replace("flooded", "[flooded](../refs/x.md)"),
        ITEM.replace("low", "<em>low</em>").replace("flooded", "flooded<ref name='n'>Ledger, p. 4</ref>").replace("20", "20[^1]"),
        ITEM.replace("low", "{{lang|xx|low}}").replace("the greenhouse", "[[Index|the]] ![chart](c.png) greenhouse{{cn|date=May}}"),
        ITEM.replace("low", "\\textbf{low}").replace("of", "of~\\cite{led24}"),
        ITEM.replace(",", " &mdash;").replace("Sokovekus", "Sok​ovekus"),
    ):
        assert [h[0] for h in s.hits(f"Before. {text} After.")] == [7], text


def test_words_that_fold_beyond_lower_case():
    for odd in ("Straße", "ΟΔΟΣ", "İzmir"):
        item = ITEM.replace("greenhouse", odd)
        s = C.Scanner([(7, item)])
        for text in (item, item.replace(odd, odd.upper()) if odd != "İzmir" else item):
            ((found, start, end, n),) = s.hits("é " + text + " y")
            assert found == 7 and n == 16 and ("é " + text)[start:end].startswith("Under low") and ("é " + text)[start:end].endswith("northern")


def test_what_markup_holds_is_read_as_a_text_of_its_own():
    s = C.Scanner([(7, ITEM)])
    long = "word " * 40
    for text in (f"a <ref name='n'>{ITEM}</ref> b", f"<!-- {ITEM} -->", f"{{{{cite|title={ITEM}}}}}", f"<img alt='{ITEM}'>", f"a <ref>{long}{ITEM}</ref> b"):
        ((item, start, end, n),) = s.hits(text)
        assert item == 7 and n == 16 and text[start:end].startswith("Under low") and text[start:end].endswith("northern")
    for hidden in (f"<ref>{long}</ref>", f"<!-- {long} -->", f"{{{{note|{long}}}}}", "[^" + "x" * 90 + "]"):
        assert [h[3] for h in s.hits(ITEM.replace("flooded", hidden + "flooded"))] == [16], hidden


def test_open_ends_take_linear_time():
    for opener in ("<!-- a ", "<ref>a ", "<sup>a "):
        began = time.perf_counter()
        assert len(C.words_of(opener * 50_000)) >= 50_000
        assert time.perf_counter() - began < 5


def test_offsets_lead_back_to_the_original():
    text = "x é " + ITEM.replace("low", "<b>low</b>") + " y"
    ((item, start, end, n),) = C.Scanner([(7, ITEM)]).hits(text)
    assert text[start:end].startswith("Under <b>low</b>") and text[start:end].endswith("northern") and n == 16


def test_too_short_and_broken_runs():
    eleven = " ".join(ITEM.split()[:11])
    assert C.Scanner([(7, ITEM)]).hits(eleven) == []
    assert C.Scanner([(7, eleven)]).hits(ITEM) == []
    assert C.Scanner([(7, ITEM)]).hits(ITEM.replace("flooded", "drowned")) == []
    assert C.Scanner([]).hits(ITEM) == []


def test_operator(spark):
    docs = spark.createDataFrame([(1, "a " + ITEM, 0), (1, "a " + ITEM, 0), (2, "nothing", 0), (3, None, 0), (4, "", 0), (5, "b " * 200_000 + ITEM, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "q"), (8, ITEM.lower(), "q"), (7, ITEM, "q"), (9, None, "q"), (10, "", "q")], "item_id int, text string, n_words string")
    assert {(r.doc_id, r.item_id) for r in C.leaks(docs, items).collect()} == {(d, i) for d in (1, 5) for i in (7, 8)}
    assert C.leaks(docs.limit(0), items).count() == 0 and C.leaks(docs, items.limit(0)).count() == 0


def test_more_patterns_than_one_automaton_holds(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=40))) for i in range(12)]
    docs = [(d, items[d % 12][1] + " x") for d in range(24)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = {tuple(r) for r in C.leaks(a, b).collect()}
    monkeypatch.setattr(C, "MAX_PATTERNS", 40)
    assert {tuple(r) for r in C.leaks(a, b).collect()} == whole and len(whole) >= 24
