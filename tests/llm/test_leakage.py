import random

import numpy as np
import pytest

from colonnade.llm import leakage
from colonnade.llm.leakage import LeakParameters, edit_distance, leaked_passages


def table(seed=1):
    r = random.Random(seed)
    vocab = [f"word{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(20))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for d in range(60):
        t = [r.choice(vocab) for _ in range(r.randrange(40))]
        w = items[d % 12][1].split()
        n = r.randrange(8, 20)
        at = r.randrange(len(w) - n + 1)
        docs.append((d, " ,. ".join(t + w[at : at + n] + t).upper()))
    return docs + [(100, None), (101, ""), (102, items[0][1].replace("w", "ｗ")), (103, " ".join(vocab * 300) + " " + items[3][1]), (104, items[0][1]), (105, items[0][1])], items


def brute(docs, items, w=12, edits=0):
    def windows(t):
        x = (t or "").lower().replace("ｗ", "w").replace(",", " ").replace(".", " ").split()
        return [x[k : k + w] for k in range(len(x) - w + 1)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    of = {i: windows(t) for i, t in items}
    out = set()
    for d, t in docs:
        ws = windows(t)
        for i, iw in of.items():
            if any((a == b) if not edits else distance(a, b) <= edits for a in ws for b in iw):
                out.add((d, i))
    return out


def run(spark, docs, items, p=None):
    a = spark.createDataFrame(docs, "d bigint, text string").selectExpr("d", "text", "'x' as id", "1 as words", "2 as key")
    b = spark.createDataFrame(items, "i int, text string")
    return [tuple(r) for r in leaked_passages(spark, a, "d", "text", b, "i", "text", p).collect()]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_exact_windows(spark, limit):
    docs, items = table()
    got = run(spark, docs, items, LeakParameters(broadcast_windows=limit))
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_windows_with_edits(spark):
    """Up to two edits: nothing wrong comes out, and at least nine tenths of what is there."""
    docs, items = table(3)
    docs = [(d, t) for d, t in docs[:40]]
    r = random.Random(8)
    docs = [(d, " ".join(x if r.random() > 0.04 else "zz" for x in t.split())) for d, t in docs]
    want, got = brute(docs, items, edits=2), set(run(spark, docs, items, LeakParameters(max_edits=2)))
    assert got <= want and len(got) >= 0.9 * len(want) > 10


def test_empty_tables(spark):
    docs, items = table()
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], [5, 5, 5, 5]], np.uint64)
    b = np.array([[1, 2, 3, 4], [2, 3, 4, 9], [1, 9, 3, 4], [1, 2, 3, 4]], np.uint64)
    assert edit_distance(a, b).tolist() == [0, 2, 1, 4]


def test_equal_windows_have_equal_keys():
    p = LeakParameters(max_edits=1)
    flat = np.arange(1, 60, dtype=np.uint64)
    both = np.concatenate([flat, flat])
    for r, s in enumerate(leakage._sampled(p, 11)):
        keys = leakage.window_keys(both, np.array([3, 62]), p, r, s)
        assert keys[0] == keys[1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_measured_repetitions(edits):
    """The measured number of repetitions finds other edited windows as often as it says."""
    p = LeakParameters(max_edits=edits)
    words = np.random.default_rng(1).integers(1, 2**63, (2000, 12), dtype=np.uint64)
    n, recall = leakage.repetitions(words[:1000], p)
    a, b = words[1000:].reshape(-1), leakage.edited(words[1000:], edits, 77)
    assert n <= p.most_repetitions and recall >= p.target_recall and (edit_distance(words[1000:], b) <= edits).all()
    met = np.zeros(1000, bool)
    for r, s in enumerate(leakage._sampled(p, n)):
        met |= leakage.window_keys(a, np.arange(1000) * 12, p, r, s) == leakage.window_keys(b.reshape(-1), np.arange(1000) * 12, p, r, s)
    assert met.mean() >= p.target_recall - 0.03


def test_unreachable_recall():
    words = np.random.default_rng(1).integers(1, 2**63, (200, 12), dtype=np.uint64)
    with pytest.raises(ValueError):
        leakage.repetitions(words, LeakParameters(max_edits=2, most_repetitions=2))
