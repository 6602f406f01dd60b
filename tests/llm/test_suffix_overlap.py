import random
import re

import pytest

from colonnade.llm.suffix_overlap import cross_split_pairs

SHAPE = "id bigint, split string, q string, e string"


def brute(rows):
    out = set()
    for f, at in (("q", 2), ("e", 3)):
        sets = [(r[0], (r[1] or "").strip().lower(), set(re.findall("[a-z0-9_]+", (r[at] or "").lower()))) for r in rows]
        for i, s, a in sets:
            for j, u, b in sets:
                o = len(a & b)
                if s == "train" and u in ("dev", "test") and min(len(a), len(b)) >= 10 and 10 * o >= 8 * (len(a) + len(b) - o):
                    out.add((f, i, j))
    return out


def table(n=40, seed=1):
    r = random.Random(seed)
    common = [f"c{k}" for k in range(12)]
    rows, i = [], 0
    for f in range(n):
        base = r.sample(common, 7) + [f"w{f}_{k}" for k in range(r.randrange(4, 14))]
        for _ in range(4):
            t = base[:]
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = f"n{r.randrange(10**6)}"
            r.shuffle(t)
            rows.append((i, r.choice(["train", " Train", "DEV ", "test", None, "other"]), " ".join(t), r.choice([None, "", "short hint", " ".join(t[::-1])])))
            i += 1
    return rows


@pytest.mark.parametrize(("run_rows", "span"), [(4000, 2), (2, 2), (4000, 1), (4000, 3)])
def test_against_brute_force(spark, run_rows, span):
    rows = table() + [(900, "train", " ".join(f"l{k}" for k in range(5000)), None), (901, "dev", " ".join(f"l{k}" for k in range(4900)), None)]
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as key", "2 as side", "3 as text", "4 as field")
    got = cross_split_pairs(spark, df, "id", "split", ["q", "e"], run_rows=run_rows, span=span).collect()
    assert {(r.field, r.train_id, r.eval_id) for r in got} == brute(rows) and len(got) == len(brute(rows))
    assert all(0.8 <= r.similarity <= 1 and 0 < r.coverage <= 1 for r in got)


def test_copies(spark):
    t = " ".join(f"a{k}" for k in range(11))
    rows = [(i, "train" if i % 2 else "test", t, None) for i in range(20)] + [(3, "train", t, None)]
    got = cross_split_pairs(spark, spark.createDataFrame(rows, SHAPE), "id", "split", ["q"]).select("train_id", "eval_id").distinct().count()
    assert got == 100


def test_one_side_and_empty(spark):
    rows = [(1, "train", "a b c d e f g h i j", None), (2, None, "a b c d e f g h i j", None)]
    assert cross_split_pairs(spark, spark.createDataFrame(rows, SHAPE), "id", "split", ["q", "e"]).count() == 0
    assert cross_split_pairs(spark, spark.createDataFrame([], SHAPE), "id", "split", ["q", "e"]).count() == 0


@pytest.mark.parametrize("run_rows", [4000, 2])
def test_coverage_of_whole_texts(spark, run_rows):
    """A copy is covered whole at any length; a text with words of its own by the share of the others."""
    rows = []
    for i, n in enumerate((10, 30, 60, 300)):
        t = [f"w{i}_{k}" for k in range(n)]
        rows += [(3 * i, "train", " ".join(t), None), (3 * i + 1, "dev", " ".join(t[::-1]), None), (3 * i + 2, "test", " ".join([*t[1:], f"x{i}"]), None)]
    got = cross_split_pairs(spark, spark.createDataFrame(rows, SHAPE), "id", "split", ["q"], run_rows=run_rows).collect()
    want = {(3 * i, 3 * i + 1): 1.0 for i in range(4)} | {(3 * i, 3 * i + 2): 1 - 1 / n for i, n in enumerate((10, 30, 60, 300))}
    assert {(r.train_id, r.eval_id): r.coverage for r in got} == pytest.approx(want)


def test_spans_that_need_not_be_shared(spark):
    with pytest.raises(ValueError):
        cross_split_pairs(spark, spark.createDataFrame([], SHAPE), "id", "split", ["q"], span=4)
