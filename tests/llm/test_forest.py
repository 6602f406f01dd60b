import random
import re

import numpy as np
import pytest

from colonnade.llm.forest import ForestParameters, _Trie, near_duplicate_groups


def brute(rows, threshold=0.8, least=10):
    sets = {i: frozenset(re.findall("[a-z0-9_]+", t.lower())) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            o = len(sets[a] & sets[b])
            if o * 10 >= threshold * 10 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() if len(g) > 1 for i in g}


def families(n_families, size, seed, words=24, edits=3):
    r = random.Random(seed)
    rows, i = [], 0
    common = [f"c{k}" for k in range(30)]
    for f in range(n_families):
        base = r.sample(common, words // 2) + [f"w{f}_{k}" for k in range(words // 2)]
        for _ in range(size):
            t = base[:]
            for _ in range(r.randrange(edits + 1)):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            r.shuffle(t)
            rows.append((i, " ".join(t)))
            i += 1
    return rows


def test_finds_what_brute_force_finds(spark):
    rows = families(40, 5, 1) + [(1000, None), (1001, ""), (1002, "select 1"), (1003, "x " * 50), (1004, " ".join(f"v{k}" for k in range(20000))), (1005, " ".join(f"v{k}" for k in range(20000)))]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("id", "text", "1 as key", "2 as words", "'x' as component", "3 as group_id")
    got = {r.id: r.group_id for r in near_duplicate_groups(spark, df, "id", "text").collect()}
    assert got == brute(rows)
    assert got[1005] == 1004


def test_copies_and_repeated_rows(spark):
    text = " ".join(f"a{k}" for k in range(12))
    rows = [(i, text.upper() if i % 2 else text) for i in range(300)] + [(7, text), (900, "b " + text)]
    got = {r.id: r.group_id for r in near_duplicate_groups(spark, spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    assert got == {i: 0 for i in [*range(300), 900]}


def test_one_family_in_large_leaves(spark):
    """Nodes far above the limit: all members come out with one group, and an outsider in the same leaves with its own."""
    rows = families(1, 400, 5, edits=2) + families(10, 3, 6)[:0]
    p = ForestParameters(node_rows=4)
    got = {r.id: r.group_id for r in near_duplicate_groups(spark, spark.createDataFrame(rows, "id bigint, text string"), "id", "text", p).collect()}
    truth = brute(rows)
    assert len(truth) > 390 and sum(got.get(i) == g for i, g in truth.items()) >= 0.99 * len(truth) and set(got) <= set(truth)


def test_records_of_common_words_only(spark):
    """Records whose words are all frequent have nothing in the first forest that tells them apart."""
    r = random.Random(9)
    pool = [f"k{i}" for i in range(40)]
    rows = [(i, " ".join(r.sample(pool, 18))) for i in range(200)]
    rows += [(1000 + i, rows[i][1].rsplit(" ", 1)[0]) for i in range(60)]
    got = {x.id: x.group_id for x in near_duplicate_groups(spark, spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()}
    truth = brute(rows)
    assert set(got) <= set(truth) and sum(got.get(i) == g for i, g in truth.items()) >= 0.97 * len(truth)


def test_empty_table(spark):
    assert near_duplicate_groups(spark, spark.createDataFrame([], "id bigint, text string"), "id", "text").count() == 0


@pytest.mark.parametrize("chunk", [7, 50, 10_000])
def test_trie_in_chunks(chunk):
    """The pairs and the large leaves of a sorted partition do not depend on how it is cut into batches."""
    r = np.random.default_rng(4)
    n = 600
    part = np.sort(r.integers(0, 4, n)).astype(np.int64)
    label = np.array([int(a) << 48 | int(b) << 32 | int(c) << 16 | int(d) for a, b, c, d in zip(part, r.integers(0, 4, n), r.integers(0, 5, n), np.where(r.random(n) < 0.5, 0, r.integers(0, 9, n)))], np.uint64)
    key = np.arange(n, dtype=np.int64)
    order = np.lexsort((key, label, part))
    part, label, key = part[order], label[order], key[order]
    sketch = np.zeros(n, np.uint64)

    def run(step):
        t, pairs, hot = _Trie(ForestParameters(node_rows=6)), set(), set()
        for at in range(0, n, step):
            p, h = t.feed(*(x[at : at + step] for x in (part, label, key, sketch)), False)
            for a, b in p:
                pairs |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y}
            for leaf, k, lead in h:
                hot |= set(zip(leaf.tolist(), k.tolist(), lead.tolist()))
        p, h = t.feed(*(x[:0] for x in (part, label, key, sketch)), True)
        for a, b in p:
            pairs |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist()) if x != y}
        for leaf, k, lead in h:
            hot |= set(zip(leaf.tolist(), k.tolist(), lead.tolist()))
        return pairs, {(a, b) for a, b, _ in hot}

    whole, cut = run(n), run(chunk)
    assert whole[0] and whole[1] and cut == whole


def test_pairs_of_crowded_nodes(spark):
    """Similar records that share few of their uncommon words, in nodes that are full of other records, on one task and in blocks."""
    r = random.Random(3)
    common, pool = [f"c{k}" for k in range(23)], [f"u{k}" for k in range(100)]
    rows = []
    for f in range(400):
        both = r.sample(pool, 4)
        rows += [(2 * f + k, " ".join(common + both + r.sample([w for w in pool if w not in both], 3))) for k in (0, 1)]
    truth = brute(rows)
    df = spark.createDataFrame(rows, "id bigint, text string")
    for block_rows in (20_000, 5):
        p = ForestParameters(node_rows=1, common_share=0.2, block_rows=block_rows)
        got = {x.id: x.group_id for x in near_duplicate_groups(spark, df, "id", "text", p).collect()}
        assert set(got) <= set(truth) and sum(got.get(i) == g for i, g in truth.items()) >= 0.99 * len(truth)


def edited(n_families, size, seed, common=31, rare=9, edits=4):
    """Families of records of ``common`` frequent and ``rare`` rare words, each but the first with some rare words replaced."""
    r = random.Random(seed)
    frequent = [f"c{k}" for k in range(common)]
    rows = []
    for f in range(n_families):
        base = [f"w{f}_{k}" for k in range(rare)]
        for m in range(size):
            words = base[:]
            for k in r.sample(range(rare), edits if m else 0):
                words[k] = f"e{f}_{m}_{k}"
            rows.append((f * size + m, " ".join(frequent + words)))
    return rows


@pytest.mark.parametrize(("n_families", "size"), [(100, 18), (30, 90), (12, 270), (5, 900)])
def test_recall_does_not_fall_with_the_size_of_families(spark, n_families, size):
    """Each record is similar to the first of its family (0.82) and to no more; the share of them that are in its group."""
    rows = edited(n_families, size, size)
    p = ForestParameters(common_share=0.5)
    got = {x.id: x.group_id for x in near_duplicate_groups(spark, spark.createDataFrame(rows, "id bigint, text string"), "id", "text", p).collect()}
    assert all(g == i // size * size for i, g in got.items())
    assert len(got) >= 0.95 * len(rows)


def test_recall_with_inserted_words(spark):
    """40 words and the same with 10 rare words inserted, a similarity of exactly 0.8."""
    frequent = [f"c{k}" for k in range(38)]
    rows = []
    for f in range(300):
        words = frequent + [f"w{f}_{k}" for k in range(2)]
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join(words + [f"n{f}_{k}" for k in range(10)]))]
    p = ForestParameters(common_share=0.5)
    got = {x.id: x.group_id for x in near_duplicate_groups(spark, spark.createDataFrame(rows, "id bigint, text string"), "id", "text", p).collect()}
    truth = brute(rows)
    assert sum(i in got for i in truth) >= 0.95 * len(truth)


def test_splitting_hot_prefixes_changes_nothing(spark):
    """A template that a third of the records follow: its nodes are split over tasks at every level, with the same groups."""
    rows = edited(1, 400, 8) + [(10_000 + i, t) for i, t in edited(200, 4, 9)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    groups = [
        {x.id: x.group_id for x in near_duplicate_groups(spark, df, "id", "text", ForestParameters(common_share=0.5, node_rows=8, hot_share=h)).collect()}
        for h in (1.1, 0.02)
    ]
    assert len(groups[0]) >= 0.99 * len(rows) and groups[0] == groups[1]
