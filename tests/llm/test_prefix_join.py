import random

import pytest

from colonnade.llm import prefix_join
from colonnade.llm.prefix_join import similar_set_pairs
from colonnade.plans.scratch import Scratch

SHAPE = "id bigint, vals array<string>, d string, t string"


def clean(v):
    return {x.strip().lower() for x in v or [] if x is not None} - {""}


def brute(rows, threshold=0.6, least=5):
    sets = [(i, clean(v), (d, t)) for i, v, d, t in rows if len(clean(v)) >= least]
    out = set()
    for k, (i, a, s) in enumerate(sets):
        for j, b, u in sets[k + 1 :]:
            o = len(a & b)
            if s != u and o * 1000 >= threshold * 1000 * (len(a) + len(b) - o):
                out.add((min(i, j), max(i, j)))
    return out


def table(seed=2):
    r = random.Random(seed)
    rows, i = [], 0
    for f in range(30):
        base = [f"x{f}_{k}" for k in range(r.randrange(4, 30))] + r.sample([f"hot{k}" for k in range(8)], 4)
        for c in range(4):
            v = [x for x in base if r.random() > 0.12] + [f"y{r.randrange(10**5)}" for _ in range(r.randrange(3))]
            rows.append((i, [x.upper() + " " if r.random() < 0.3 else "\t" + x for x in v] + v[:2] + [None, " "], f"d{c % 3}", f"t{f}"))
            i += 1
    for k in range(40):  # sets of hot values only
        rows.append((i, r.sample([f"hot{k}" for k in range(8)], 6), f"d{k}", "h"))
        i += 1
    return rows + [(i, None, "d", "t"), (i + 1, [], "d", "t"), (i + 2, [None, ""], None, None)]


def test_against_brute_force(spark):
    rows = table()
    df = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 as key", "2 as toks", "3 as side")
    got = [tuple(x) for x in similar_set_pairs(spark, df, "id", "vals", ["d", "t"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@pytest.mark.parametrize("partners", [0, 10])
def test_longer_prefixes(spark, partners):
    """With few partners allowed, the records with frequent values go through two and three shared values."""
    rows = table(5)
    sets = {i: clean(v) for i, v, _, _ in rows if len(clean(v)) >= 5}
    keyed = spark.createDataFrame([(i, v) for i, v in rows_of(sets)], "key bigint, v array<string>").selectExpr("key", "transform(v, x -> xxhash64(x)) as toks")
    got = {tuple(x) for x in prefix_join.similar_sets(spark, keyed, 0.6, Scratch(spark), partners=partners).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 6 * len(sets[a] | sets[b])}
    assert got == want


def rows_of(sets):
    return [(i, sorted(v)) for i, v in sets.items()]


def test_equal_sets_and_equal_columns(spark):
    v = ["a", "b", "c", "d", "e"]
    rows = [(1, v, "d", "t"), (2, v[::-1], "d", "t"), (3, v + ["A "], "d", "u"), (4, v[:4], "d", "v")]
    got = {tuple(x) for x in similar_set_pairs(spark, spark.createDataFrame(rows, SHAPE), "id", "vals", ["d", "t"]).collect()}
    assert got == {(1, 3), (2, 3)}


def test_two_tables(spark):
    v = ["a", "b", "c", "d", "e"]
    one = spark.createDataFrame([(1, v, "d", "t"), (2, v, "d", "u")], SHAPE)
    two = spark.createDataFrame([(1, v, "e", "t"), (5, [*v, "f"], "e", "w"), (6, ["q"] * 9, "e", "w")], SHAPE)
    got = {tuple(x) for x in similar_set_pairs(spark, one, "id", "vals", [], other=two).collect()}
    assert got == {(1, 1), (1, 5), (2, 1), (2, 5)}


def test_empty_table(spark):
    assert similar_set_pairs(spark, spark.createDataFrame([], SHAPE), "id", "vals", ["d", "t"]).count() == 0
