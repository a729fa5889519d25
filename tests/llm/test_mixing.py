"""Source schedules."""

import os
import random

import pytest

from noteweave.llm import mixing as X

pytestmark = pytest.mark.skipif(not os.path.exists(X.TOKENIZER), reason="no public tokenizer files")


def tables(spark, weights, sizes=(("a", 400), ("b", 60), ("c", 5)), seed=1):
    rng = random.Random(seed)
    docs, k = [], 0
    for source, n in sizes:
        for _ in range(n):
            k += 1
            docs.append((k, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(1, 60))), source, 1))
    docs += [(9001, None, "a", 1), (9002, "", "a", 1), (9003, "x", None, 1), (9004, "x", "unlisted", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, slot int"), spark.createDataFrame(weights, "mix string, source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    docs, w = tables(spark, [("m", "a", 0.5, 1), ("m", "b", 0.4, 4), ("m", "c", 0.1, 8), ("n", "a", 0.9, 2), ("n", "gone", 0.1, 3), (None, "a", 1.0, 1), ("m", "a", 0.5, 1)])
    chosen = X.schedule(docs, w)
    rows = chosen.collect()
    cap = {("m", "a"): 1, ("m", "b"): 4, ("m", "c"): 8, ("n", "a"): 2}
    assert all(0 <= r.repeat_no < cap[r.mix, r.source] for r in rows)
    assert len({(r.mix, r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    s = {(r.mix, r.source): r for r in X.shares(chosen, w).collect()}
    longest = 120
    for mix, source, want in (("m", "a", 0.5), ("m", "b", 0.4), ("m", "c", 0.1), ("n", "a", 1.0)):
        total = sum(r.n_tokens for k, r in s.items() if k[0] == mix)
        assert abs(s[mix, source].actual_share - want) <= longest / 2 / total + 0.002
    assert s["n", "gone"].n_tokens == 0
    again = {(r.mix, r.slot, r.doc_id, r.repeat_no) for r in X.schedule(docs, w).collect()}
    assert again == {(r.mix, r.slot, r.doc_id, r.repeat_no) for r in rows}


def test_every_prefix_is_mixed(spark):
    docs, w = tables(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 9)])
    rows = sorted(X.schedule(docs, w).collect(), key=lambda r: r.slot)
    total = sum(r.n_tokens for r in rows)
    seen, half = {"a": 0, "b": 0}, 0
    for r in rows:
        seen[r.source] += r.n_tokens
        half += r.n_tokens
        if half > total / 4:
            assert abs(seen["a"] / half - 0.5) < 0.06


def test_prefix_shares_at_some_size(spark):
    docs, w = tables(spark, [("m", "a", 0.7, 1), ("m", "b", 0.25, 9), ("m", "c", 0.05, 40)], (("a", 6000), ("b", 800), ("c", 60)))
    rows = sorted(X.schedule(docs, w).collect(), key=lambda r: r.slot)
    total, seen, at = sum(r.n_tokens for r in rows), {"a": 0, "b": 0, "c": 0}, 0
    for r in rows:
        seen[r.source] += r.n_tokens
        at += r.n_tokens
        if at > total / 20:
            for source, want in (("a", 0.7), ("b", 0.25), ("c", 0.05)):
                assert abs(seen[source] / at - want) <= 150 / at + 0.002
    assert all(abs(seen[s] / total / want - 1) <= 0.02 for s, want in (("a", 0.7), ("b", 0.25), ("c", 0.05)))


def test_more_slots_where_blocks_would_be_large(spark, monkeypatch):
    docs, w = tables(spark, [("m", "a", 0.5, 1), ("m", "b", 0.5, 9)])
    few = X.schedule(docs, w, n_slots=10, block_tokens=10**9).collect()
    many = X.schedule(docs, w, n_slots=10, block_tokens=100).collect()
    assert len({r.slot for r in few}) <= 10 and len({r.slot for r in many}) > 50
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert sorted(X.schedule(docs, w, n_slots=10, block_tokens=100).collect()) == sorted(many)


def test_running_total_in_small_buckets(spark):
    rows = [("g", i % 7, i, i * 3 % 11) for i in range(200)] + [("h", 0, 0, 5)]
    df = spark.createDataFrame(rows, "g string, k int, i int, v int")
    got = {(r.g, r.i): r.before for r in X.running_total(df, "g", "k", ["i"], "v", "before").collect()}
    before = 0
    for g, _, i, v in sorted(rows[:-1], key=lambda r: (r[1], r[2])):
        assert got[g, i] == before
        before += v
    assert got["h", 0] == 0


def test_empty(spark):
    docs, w = tables(spark, [("m", "a", 1.0, 1)])
    assert X.schedule(docs.limit(0), w).count() == 0 and X.schedule(docs, w.limit(0)).count() == 0
    assert X.shares(X.schedule(docs.limit(0), w), w).first().actual_share == 0.0


def test_token_counts_are_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "hello world " * 30_000, "a"), (2, None, "a"), (3, "", "a")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_tokens for r in X.count_tokens(docs).collect()} == {1: len(X._encoding(X.TOKENIZER).encode_ordinary("hello world " * 30_000)), 2: 0, 3: 0}
