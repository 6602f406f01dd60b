import random

import numpy as np
import pytest

from colonnade.llm.mixture import PATTERN, _pivot, mixture, token_counts

DOCS = "doc_id bigint, text string, source string"
TARGETS = "source string, target_share double, max_repeats int"


def documents(n=600, seed=4):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma", "42"]) for _ in range(r.randrange(1, 60))), r.choice(["Big", " big", "mid ", "small", None, "unlisted"] if i % 3 else ["big"])) for i in range(n)]
    return rows + [(n, None, "big"), (n + 1, "", "big"), (n + 2, "word " * 3000, "mid"), (5, "a row with an id again", "big")]


@pytest.mark.parametrize("total", [None, 5000])
def test_shares(spark, total):
    docs = spark.createDataFrame(documents(), DOCS).repartition(7).selectExpr("*", "1 as id", "2 as tokens", "3 as p")
    targets = spark.createDataFrame([("big", 0.5, 1), ("MID", 0.3, 4), ("small ", 0.15, 2), ("absent", 0.05, 3)], TARGETS)
    copies, report = mixture(spark, docs, targets, total_tokens=total)
    rows, shares = copies.collect(), {r.source: r for r in report.collect()}
    assert set(shares) == {"big", "mid", "small", "absent"} and shares["absent"].actual_share == 0
    assert all(0 <= r.copies <= {"big": 1, "mid": 4, "small": 2}[r.source] for r in rows)
    whole = sum(r.tokens * r.copies for r in rows)
    assert whole == sum(r.mixed_tokens for r in shares.values())
    longest = {s: max(r.tokens for r in rows if r.source == s) for s in ("big", "mid", "small")}
    aim = min(min(shares[s].max_repeats * shares[s].tokens / shares[s].target_share for s in longest) * 0.95, total or 1e18)
    for s, longest_ in longest.items():
        assert abs(shares[s].mixed_tokens - aim * shares[s].target_share / 0.95) <= longest_ + 1


def test_same_again(spark):
    docs = spark.createDataFrame(documents(), DOCS).coalesce(2)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.6, 2)], TARGETS)
    one, two = (sorted(tuple(r) for r in mixture(spark, docs, targets)[0].collect()) for _ in range(2))
    assert one == two


def test_empty_tables(spark):
    none, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 1)], TARGETS)
    copies, report = mixture(spark, none, targets)
    assert copies.count() == 0 and [(r.source, r.actual_share) for r in report.collect()] == [("a", 0.0)]
    copies, report = mixture(spark, spark.createDataFrame(documents(20), DOCS), spark.createDataFrame([], TARGETS))
    assert copies.count() == 0 and report.count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id bigint, text string")
    got = {r.id: r.tokens for r in token_counts(df, "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


def test_pivot_keeps_mass():
    r = np.random.default_rng(2)
    ids, tokens, probs, source = np.arange(500), r.integers(1, 90, 500).astype(float), r.random(500), r.integers(0, 4, 500)
    p = _pivot(ids, tokens, probs, source, 3)
    for s in range(4):
        of = source == s
        assert ((p[of] > 0) & (p[of] < 1)).sum() <= 1 and abs((tokens * (p - probs))[of].sum()) < 1e-6


def test_pivot_is_fair():
    """Over many seeds each document is chosen as often as its probability says."""
    probs = np.array([0.5, 0.25, 0.75, 0.5, 0.3, 0.7])
    n = sum(_pivot(np.arange(6), np.array([3.0, 1, 4, 1, 5, 9]), probs, np.zeros(6, int), seed) for seed in range(4000))
    assert np.abs(n / 4000 - probs).max() < 0.04


def test_requested_and_used_tokens(spark):
    docs = spark.createDataFrame(documents(), DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.5, 1)], TARGETS)
    for asked in (None, 100, 10**9):
        r = {x.source: x for x in mixture(spark, docs, targets, total_tokens=asked)[1].collect()}
        assert r["big"].requested_tokens == asked and r["big"].feasible_tokens == r["mid"].feasible_tokens > 1000
        assert r["big"].used_tokens == min(asked or 10**9, r["big"].feasible_tokens)
        assert sorted(x.limiting for x in r.values()) == [False, True]


def test_same_pattern_as_the_vocabulary():
    public = pytest.importorskip("public_tokenizers")
    assert PATTERN == public.PATTERN
