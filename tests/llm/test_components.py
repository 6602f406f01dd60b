import random

import pytest

from colonnade.llm.components import connected_components, key_groups, linked_columns


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return {v: find(v) for v in up}


def graphs():
    r = random.Random(3)
    path = [(i, i + 1) for i in range(100, 170)]
    ring = [(i, i + 1) for i in range(200, 230)] + [(230, 200)]
    star = [(300, i) for i in range(301, 340)]
    clique = [(i, j) for i in range(400, 408) for j in range(i)if j >= 400]
    lollipop = [(500, 501), (501, 502), (502, 500), (502, 503), (503, 504), (504, 505)]
    theta = [(600, 601), (601, 602), (602, 603), (600, 604), (604, 603), (600, 605), (605, 606), (606, 603)]
    noise = [(r.randrange(700, 900), r.randrange(700, 900)) for _ in range(150)]
    dirt = [(5, 5), (None, 6), (7, None), (101, 100), (100, 101)]
    return path + ring + star + clique + lollipop + theta + noise + dirt


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_all_shapes(spark, one_task):
    edges = graphs()
    got = connected_components(spark, spark.createDataFrame(edges, "src bigint, dst bigint"), one_task=one_task).collect()
    assert len(got) == len({r.v for r in got})
    assert {r.v: r.component for r in got} == brute(edges)


def test_without_edges(spark):
    assert connected_components(spark, spark.createDataFrame([], "src bigint, dst bigint")).count() == 0
    assert key_groups(spark, spark.createDataFrame([("x", "x"), (None, "y")], "a string, b string")).count() == 0


def test_keys_in_many_spellings(spark):
    rows = [("D", " T1", "`A`", "t2", "B "), ("d", '"t2"', "[b]", "T3", "c"), ("d", "t9", "z", "T9", "`Z`"), ("d", "t1", None, "t2", "b"), ("d", "t1", "  ", "t2", "q"), (None, "t1", "a", "t2", "q")]
    df = spark.createDataFrame(rows, "db string, ta string, ca string, tb string, cb string").selectExpr("*", "'x' as key", "1 as a", "2 as group_key")
    got = key_groups(spark, linked_columns(df, "db", (("ta", "ca"), ("tb", "cb")))).collect()
    assert {tuple(r) for r in got} == {("d.t1.a", "d.t1.a"), ("d.t2.b", "d.t1.a"), ("d.t3.c", "d.t1.a")}
