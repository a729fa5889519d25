"""Personal information: candidates, estimation, spans, placeholders."""

import random

import numpy as np
import pytest

from noteweave.llm import pii as P

LINES = {
    "email": ["Contact: emily.tolescu@kirrow.example", "a @ b.test", "anna [at] notes [dot] test", "jo AT post DOT example", "x&#64;mx2.brastow.test", "greta+vault@kirrow.example", "ANNA@notes.test"],
    "phone": ["tel +34 900 55 74 45", "T: 030/23125-203", "Call 0049-30-23125-57 now", "(415) 555-0125", "617 555 0134 ext. 24", "+1.617.555.0189", "13035550142", "01 99 00 48 46", "+44 (0)20 7946 0368", "020 7946 0138"],
    "id_number": ["passport no. X4490628", "Passport: ZZ990087", "SSN 928-74-6602", "social security number 000 97 6635", "Steuer-ID 00 494 546 136", "DNI 00277843R", "national ID 972011-07812-R", "insurance number QQ 39 16 41 C", "ID card #598129213", "driving licence OSTRA2597601"],
    "address": ["98 Saltpen Rd., Apt 9, Nassing 26203", "Orrelstraße 172, 63187 Sundhavn", "Dunfoldweg 191b, 96548 Ostering", "Calle Mossway 88, 5.º B, Nassing", "110 bis, rue de Orrel, 98375 Velmouth", "P.O. Box 735, Velmouth", "Mossway Lane 46, Sundhavn", "227 Saltpen Avenue", "Flat 11, Brindle House, 190 Dunfold Close, Corvella"],
    "person": ["Mei Lundescu", "Author: Quentin A. Yarstead", "PAULA PELLBERRY", "Ask Ulltorin, Ingrid about it", "Dr. Kesttorin", "Signé : L. Pellvane", "Victor Marroberry-Dravello"],
}
NOT = ["The Saint Wanda Bay chart is out of date.", "The ferry to Port Pierre left at 14:35.", "Build 2.71.9 of 2024-06-16", "ISBN 978-0-00-843966-1", "Ticket 507-62665 is closed.", "Total 1 477 518 units.", "Coordinates 0.5932, -12.2858", "Mention @outline-bot in the thread.", "Version note: see the Ferrow Street survey.", "Page 51 of 984, line 517.", "Commit 0x967966af", "See section 4.2 (a).", "Its loom kept 388 units, so the tide stayed cheap."]


def corpus():
    lines = [(k, line) for k, ls in LINES.items() for line in ls] + [(None, line) for line in NOT]
    return [(i, f"Intro words.\n\n{line}\nMore words.", k) for i, (k, line) in enumerate(lines * 3)]


def test_found_lines(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(900, None, 0), (901, "", 0)], "doc_id long, text string, line_no int")
    found = {(r.doc_id, r.kind) for r in P.find_spans(docs).collect()}
    assert {r.line_no for r in P.find_spans(docs).collect()} == {3}
    for i, text, kind in rows:
        assert (i, kind) in found or kind is None, text
        assert kind is not None or not any(d == i for d, _ in found), text
    assert P.find_spans(docs.limit(0)).count() == 0


def test_placeholders_keep_the_rest(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus()] + [(900, None), (901, ""), (902, "a b\r\n" * 20_000 + "x@y.test")], "doc_id long, text string")
    clean = {r.doc_id: (r.clean, r.n_spans) for r in P.redact(docs).collect()}
    assert clean[900] == (None, 0) and clean[901] == ("", 0) and clean[902] == ("a b\r\n" * 20_000 + "[EMAIL]", 1)
    assert clean[0] == ("Intro words.\n\nContact: [EMAIL]\nMore words.", 1)
    for i, text, kind in corpus():
        if kind is None:
            assert clean[i] == (text, 0)
        else:
            assert P.PLACEHOLDER[kind] in clean[i][0] and clean[i][0].startswith("Intro words.\n\n") and clean[i][0].endswith("\nMore words.")


def test_long_text_with_many_spans():
    text = "tel +34 900 55 74 45, anna@b.test, Mei Lundescu, 98 Orrel Lane\n" * 5_000
    assert len(P.candidates(text)) >= 20_000


def test_estimation_finds_the_unreliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.85, 0.55])
    votes = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    rows, weight = np.unique(votes, axis=0, return_counts=True)
    p, table = P.estimate(rows, weight.astype(float))
    assert np.all(np.diff(table[:, 1, 2]) < 0.02)
    guess = dict(zip(map(tuple, rows), p > 0.5))
    assert np.mean([guess[tuple(v)] == t for v, t in zip(votes, truth)]) > 0.9


def test_classifier_learns_soft_labels():
    rows = [[0], [1], [0, 1], []] * 30
    w = P.train(rows, np.array([0.95, 0.1, 0.9, 0.05] * 30), 2)
    assert list(P.scores(rows[:4], w) > 0) == [True, False, True, False]


def test_no_candidates():
    assert P.Classifier([], []).votes == {k: {} for k in P.KINDS}
    assert P.candidates("") == [] and P.candidates("plain words only.") == []


def test_what_no_list_names_is_proposed():
    text = "Oluwaseun Adeyemi wrote to Xiaoming Zhang. Siobhan Gallagher and Thabo Mbeki agreed.\n14 Kungsgatan\nvia Garibaldi 12, Milano\nRua Augusta 1500, Lisboa\n" + "a" * 90 + "@post.test\n"
    found = {(k, text[s:e]) for k, s, e, *_ in P.candidates(text)}
    assert found == {("person", n) for n in ("Oluwaseun Adeyemi", "Xiaoming Zhang", "Siobhan Gallagher", "Thabo Mbeki")} | {("address", n) for n in ("14 Kungsgatan", "via Garibaldi 12", "Rua Augusta 1500")} | {("email", "a" * 90 + "@post.test")}


def test_names_outside_the_gazetteer_are_found(spark):
    """Names of one half of the given names are in no list: what stands beside them tells them."""
    rng = random.Random(3)
    names = sorted(P.GIVEN_NAMES)
    ends = ["berry", "stead", "quist", "oval", "dahl"]
    frames = ["Written by {}.", "{} said so at noon.", "{}, x{}@post.test", "Ask {} about it.", "Thanks to {} for the list."]
    things = ["Ledger", "Outline", "Turbine", "Lantern", "Glacier", "Notebook"]
    docs, truth = [], {}
    for i in range(600):
        first = names[i % len(names)].title()
        name = f"{first} {rng.choice(['Pell', 'Zim', 'Kest', 'Grav', 'Tol', 'Marr'])}{rng.choice(ends)}"
        truth[i] = names[i % len(names)] in names[::2]
        docs.append((i, f"{rng.choice(things)} {rng.choice(things)}\n\n{rng.choice(frames).format(name, i)}\n\n{rng.choice(things)} Number\n{rng.choice(things)} {rng.choice(things)}"))
    found = {(r.doc_id, r.line_no) for r in P.find_spans(spark.createDataFrame(docs, "doc_id long, text string"), given=frozenset(names[::2])).filter("kind = 'person'").collect()}
    unlisted = [i for i, listed in truth.items() if not listed]
    assert sum((i, 3) in found for i in truth) >= 0.85 * len(truth)
    assert sum((i, 3) in found for i in unlisted) >= 0.75 * len(unlisted)
    assert sum(line != 3 for _, line in found) <= 0.02 * len(found)


def test_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "tel +34 900 55 74 45"), (1, "x@y.test"), (1, "x@y.test"), (1, "Dr. Kesttorin said no")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kind) for r in P.find_spans(docs).collect()) == [(0, "phone"), (1, "email"), (1, "email"), (1, "person")]
    assert sorted(r.clean for r in P.redact(docs).collect()) == ["[EMAIL]", "[EMAIL]", "[PERSON] said no", "tel [PHONE]"]


@pytest.mark.parametrize("text, line", [("a\nb\n+34 900 55 74 45", 3), ("x@y.test", 1)])
def test_lines_count_from_one(spark, text, line):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.line_no for r in P.span_candidates(docs).collect()] == [line]
