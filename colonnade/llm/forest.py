"""Problem 1: near-duplicate records by a MinHash LSH forest with exact verification.

A record is its set of words. Each of several trees orders all records by a label, a sequence of MinHash values, so that
records which agree on a prefix of the label lie next to each other: the sorted form of a prefix trie. A record is
compared with the records of the longest-lived node that is still small: matched prefixes are shortened, level by
level, as far as the node stays within ``node_rows``; ``tree_count`` gives the trees that reach ``target_recall`` at the
threshold. Pairs are pre-filtered by a sketch, which drops none that are similar, and then verified on the full word
sets. Nodes that stay large down to the last level hold long families of near copies: their records are tied to the node's first record.

``tree_count`` counts a pair as found once it shares a node of ``sure_level`` levels, so the recall must not depend on how
many rows such a node has. Those that are too large to be compared at once are completed in a second pass: all of their
pairs that are not yet in one group are compared, by an exact bound on the words that may differ and then on the full
sets. A prefix that holds much of a tree, known from a sample, is split over tasks by its next level and counts as large.

Two forests are built. The first takes its MinHash over the words that fewer than ``common_share`` of the records use,
since the words shared by most queries say nothing; the second over all words, with longer labels, for the records whose
uncommon words do not bound the similarity from below (``rare_similarity``): a pair is certain in the first forest if that
bound holds at either end, and else both of its ends are in the second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.components import connected_components
from colonnade.plans.scratch import Scratch

LEVELS = 4
TREE_BITS = 26  #: bits of a label's first level that ``part`` holds, so that first nodes are apart up to billions of sets
SIZE = np.uint64(0xFFFF)  #: bits of a sketch that hold the size of the set; the other 48 are parities of its hashed words
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ForestParameters:
    threshold: float = 0.8
    min_words: int = 10
    target_recall: float = 0.99
    rare_similarity: float = 0.3  #: similarity of the uncommon words down to which the first forest alone reaches the target
    full_depth: int = 2  #: MinHash values in one level of the second forest
    common_share: float = 0.01
    node_rows: int = 96
    block_rows: int = 20_000  #: rows of a large node that one task compares with the rest of the node
    hot_share: float = 0.002  #: share of a tree's rows from which a prefix is split over tasks by its next level
    sample_sets: int = 20_000  #: sets in the sample that finds such prefixes

    def tree_count(self, similarity: float, depth: int) -> int:
        """Trees after which a pair of that similarity has shared a prefix of that depth with the target's probability."""
        return math.ceil(math.log(1 - self.target_recall) / math.log(1 - similarity**depth))

    @property
    def rare_trees(self) -> int:
        return self.tree_count(self.rare_similarity, 1)

    @property
    def full_trees(self) -> int:
        return self.tree_count(self.threshold, 2 * self.full_depth)

    def sure_level(self, part: np.ndarray) -> np.ndarray:
        """Levels that a pair is to share in the tree of each row, as the number of trees assumes."""
        return np.where(part >> TREE_BITS < self.rare_trees, 1, 2)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets with these sketches may have the similarity; never false for sets that have it.

        Two sets differ in at least as many words as their parity bits do, and in at most (n + m) (1 - t) / (1 + t) words if
        their similarity is t or more.
        """
        t = round(self.threshold * 1000)
        n, m = (a & SIZE).astype(np.int64), (b & SIZE).astype(np.int64)
        differ = np.bitwise_count((a ^ b) & ~SIZE).astype(np.int64)
        fits = (differ * (1000 + t) <= (n + m) * (1000 - t)) & (np.minimum(n, m) * 1000 >= np.maximum(n, m) * t)
        return fits | (np.maximum(n, m) == int(SIZE))


def word_sets(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, key, words): the distinct words of a text as 64-bit hashes, for texts with enough of them; key is equal for equal sets."""
    found = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9_]+"), F.lit(0))
    words = F.array_sort(F.transform(F.array_distinct(found), lambda w: F.xxhash64(w)))
    sets = df.select(F.col(id_col).alias("id"), words.alias("words")).where(F.size("words") >= min_words)
    return sets.select("id", F.xxhash64("words").alias("key"), "words")


def common_words(sets: DataFrame, share: float) -> np.ndarray:
    """Sorted hashes of the words in more than about ``share`` of the sets, at most (words per set) / share of them.

    Each task passes on only the words that more than half of ``share`` of its own sets have; a word that is common in all
    sets is so in some task, and the counts of all tasks are summed.
    """

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, rows = np.empty(0, np.int64), np.empty(0, np.int64), 0

        def merge(parts):
            allw = np.concatenate([p[0] for p in parts])
            w, inv = np.unique(allw, return_inverse=True)
            return w, np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(w)).astype(np.int64)

        for batch in batches:
            rows += batch.num_rows
            w, c = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            words, counts = merge([(words, counts), (w, c)]) if len(words) else (w, c)
            if len(words) > 4_000_000:  # lossy counting: what is this rare so far cannot reach half of the share
                keep = counts > share / 8 * rows
                words, counts = words[keep], counts[keep]
        keep = counts > share / 2 * rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(words[keep]), pa.array(counts[keep]), pa.array(np.zeros(keep.sum(), np.int64))], ["w", "c", "rows"]
        )
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([rows])], ["w", "c", "rows"])

    got = sets.select("words").mapInArrow(heavy, "w bigint, c bigint, rows bigint").groupBy("w").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows"))
    total = got.where("w is null").agg(F.sum("rows")).first()[0] or 0
    frequent = got.where(F.col("w").isNotNull() & (F.col("c") > share / 2 * total))
    return np.sort(np.array([r[0] for r in frequent.select("w").collect()], dtype=np.int64))


def _mins(values: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each seed and each slice of ``values`` the smallest hash, as uint32."""
    out = np.empty((len(seeds), len(starts)), np.uint32)
    for i, s in enumerate(seeds):
        out[i] = np.minimum.reduceat(((values ^ (values >> np.uint64(29))) * s >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _seeds(n: int, stream: int) -> np.ndarray:
    return np.random.default_rng([20, stream]).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labels(sets: DataFrame, common: np.ndarray, p: ForestParameters, hot: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(part, label, key, sketch): a row for each distinct set and tree. part is the tree with more bits of the first level.

    ``hot`` has, for each level, the prefixes that are known to be large. The number of levels of a row whose prefixes are is
    in the upper half of part.

    Trees share their hash functions: the deeper levels of a tree are the first ones of the trees after it. The levels that a
    pair has to share (``sure_level``) are of different functions in each tree, so the trees stay independent there.
    """
    rare_sure, full_sure = 1, 2 * p.full_depth
    rare_seeds = _seeds(max(p.rare_trees * rare_sure, LEVELS), 1)
    full_seeds = _seeds(max(p.full_trees * full_sure, LEVELS * p.full_depth), 2)
    threshold, rare_similarity = p.threshold, p.rare_similarity
    hot = hot or {}

    def pack(mins: np.ndarray, tree: int, sure: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """One uint64 of four 16-bit levels, and more bits of the first; a level mixes ``depth`` MinHash values."""
        label, first = np.zeros(mins.shape[1], np.uint64), None
        for level in range(LEVELS):
            mixed = np.zeros(mins.shape[1], np.uint64)
            for k in range(depth):
                mixed = (mixed + mins[(tree * sure + level * depth + k) % len(mins)] + np.uint64(1)) * GOLDEN
                mixed ^= mixed >> np.uint64(31)
            label = label << np.uint64(16) | (mixed & np.uint64(0xFFFF))
            first = mixed >> np.uint64(64 - TREE_BITS) if first is None else first
        return label, first.astype(np.int64)

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keys = whole.column(0).to_numpy()
            _, first = np.unique(keys, return_index=True)  # copies of a set collapse before anything is shuffled
            for at in range(0, len(first), 4000):
                batch = whole.take(pa.array(np.sort(first[at : at + 4000])))
                keys, lists = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.asarray(lists.value_lengths())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                pos = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
                rare = (common[pos] != flat) if len(common) else np.ones(len(flat), bool)
                flat = flat.view(np.uint64)
                bits = np.uint64(1) << (np.uint64(16) + (flat ^ flat >> np.uint64(29)) * GOLDEN % np.uint64(48))
                sketch = np.bitwise_xor.reduceat(bits, starts) | np.minimum(sizes, int(SIZE)).astype(np.uint64)
                n_rare = np.add.reduceat(rare.astype(np.int64), starts)
                some = np.flatnonzero(n_rare)
                # A partner may lack (1 - t) n words; if those can be so many of the uncommon ones that the similarity of the
                # rest falls below ``rare_similarity``, and the partner is in the same case, only the second forest is sure.
                gone = np.floor(sizes * (1 - threshold) + 1e-9)
                poor = np.flatnonzero(gone > (1 - rare_similarity) * n_rare + 1e-9)

                def rows(tree: int, who: np.ndarray, packed: tuple[np.ndarray, np.ndarray]):
                    label, first = packed
                    part = (np.int64(tree) << np.int64(TREE_BITS) | first).astype(np.int32)
                    deep = np.zeros(len(who), np.int64)
                    for level in range(1, LEVELS + 1):
                        known = hot.get(level)
                        if known is None or not len(known):
                            break
                        here = prefix_id(part, label, level)
                        pos = np.minimum(np.searchsorted(known, here), len(known) - 1)
                        deep[(known[pos] == here) & (deep == level - 1)] = level
                    cols = [pa.array(deep << np.int64(32) | part), pa.array(label.view(np.int64)), pa.array(keys[who]), pa.array(sketch[who].view(np.int64))]
                    return pa.RecordBatch.from_arrays(cols, ["part", "label", "key", "sketch"])

                if len(some):
                    at_rare = np.concatenate([[0], np.cumsum(n_rare[some])[:-1]])
                    values = flat[rare]
                    m = _mins(values, at_rare, rare_seeds)
                    for t in range(p.rare_trees):
                        yield rows(t, some, pack(m, t, rare_sure, 1))
                if len(poor):
                    inside = np.zeros(len(keys), bool)
                    inside[poor] = True
                    values = flat[np.repeat(inside, sizes)]
                    at_poor = np.concatenate([[0], np.cumsum(sizes[poor])[:-1]])
                    m = _mins(values, at_poor, full_seeds)
                    for t in range(p.full_trees):
                        yield rows(p.rare_trees + t, poor, pack(m, t, full_sure, p.full_depth))

    return sets.select("key", "words").mapInArrow(forest, "part bigint, label bigint, key bigint, sketch bigint")


def prefix_id(part: np.ndarray, label: np.ndarray, level: int) -> np.ndarray:
    """A hash of the first ``level`` levels of labels."""
    x = (part.astype(np.uint64) << np.uint64(36)) ^ (label >> np.uint64(16 * (LEVELS - level))) * GOLDEN ^ np.uint64(level)
    return (x ^ x >> np.uint64(31)) * GOLDEN


def hot_prefixes(sets: DataFrame, common: np.ndarray, p: ForestParameters) -> dict[int, np.ndarray]:
    """For each level the sorted prefixes of about ``hot_share`` of a tree's rows or more, found in a sample of about
    ``sample_sets`` sets. They only decide how rows are partitioned, and which nodes are large without being counted."""
    n = sets.count()
    every = max(1, n // p.sample_sets)
    rows = labels(sets.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0), common, p)
    least = max(p.node_rows + 1 if every == 1 else 2, p.hot_share * n / every)
    trees, levels = p.rare_trees + p.full_trees, np.arange(1, LEVELS + 1)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, label = batch.column(0).to_numpy().astype(np.int32), batch.column(1).to_numpy().view(np.uint64)
            each = [np.unique(prefix_id(part, label, int(k)).view(np.int64), return_counts=True) for k in levels]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(levels, [len(e[0]) for e in each])), pa.array(np.concatenate([e[0] for e in each])), pa.array(np.concatenate([e[1] for e in each]))],
                ["level", "id", "n"],
            )

    counts = rows.select("part", "label").mapInArrow(ids, "level bigint, id bigint, n bigint").groupBy("level", "id").agg(F.sum("n").alias("n"))
    # at most 1 / hot_share prefixes of a level and tree can be so large
    found = counts.where(F.col("n") >= least).limit(int(LEVELS * trees / p.hot_share)).collect()
    return {int(k): np.sort(np.array([r["id"] for r in found if r["level"] == k], np.int64).view(np.uint64)) for k in levels}


class _Trie:
    """Walks the rows of one sorted partition; keeps at most the rows of one unfinished small node."""

    def __init__(self, p: ForestParameters):
        self.p, self.rows = p, p.node_rows
        self.wide: list[tuple] = []  #: (node, key) of the rows in large nodes of the sure level, until the caller takes them
        self.rest: tuple[np.ndarray, ...] | None = None
        self.large: dict[int, tuple] = {}  #: level -> prefix of a node that was seen to be large before it ended
        self.leader: tuple | None = None  #: prefix, key and sketch of the first record of the large leaf that is open

    def prefixes(self, part, label, level):
        return part, label >> np.uint64(16 * (LEVELS - level))

    def feed(self, part, label, key, sketch, last: bool):
        if self.rest is not None:
            part, label, key, sketch = (np.concatenate([a, b]) for a, b in zip(self.rest, (part, label, key, sketch)))
        n = len(key)
        if not n:
            self.rest = None
            return [], []
        fresh = np.ones(n, bool)  # the same set from several tasks counts once
        fresh[1:] = (part[1:] != part[:-1]) | (label[1:] != label[:-1]) | (key[1:] != key[:-1])
        if not fresh.all():
            part, label, key, sketch = part[fresh], label[fresh], key[fresh], sketch[fresh]
            n = len(key)
        start, end = np.arange(n), np.arange(n) + 1
        todo = np.ones(n, bool)
        hold = n  # rows from here on wait for more
        sure = self.p.sure_level(part & 0xFFFFFFFF)
        wide = part >> 32 >= sure  # other tasks have rows of that node
        pairs, hot = [], []
        for level in range(1, LEVELS + 1):
            pa_, lb = self.prefixes(part, label, level)
            new = np.ones(n, bool)
            new[1:] = (pa_[1:] != pa_[:-1]) | (lb[1:] != lb[:-1])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, n))
            node = np.cumsum(new) - 1
            big = size > self.rows
            if self.large.get(level) == (pa_[0], lb[0]):
                big[0] = True
            if big[-1] and not last:
                self.large[level] = (pa_[-1], lb[-1])
            elif not last:
                self.large.pop(level, None)
            take = todo & ~big[node]
            start[take], end[take] = begin[node[take]], begin[node[take]] + size[node[take]]
            todo &= ~take
            wide |= big[node] & (sure == level)
            if not last and not big[-1] and hold == n:
                hold = begin[-1]  # the last node that is not known to be large may go on
            if level == LEVELS and todo.any():
                hot_rows = np.flatnonzero(todo)
                leaders = begin[node[hot_rows]]
                lk, ls = key[leaders], sketch[leaders]
                if self.leader is not None and self.leader[:2] == (pa_[0], lb[0]):
                    same = node[hot_rows] == 0
                    lk, ls = np.where(same, self.leader[2], lk), np.where(same, self.leader[3], ls)
                ids = (part[hot_rows].view(np.uint64) << np.uint64(40)) ^ (label[hot_rows] * GOLDEN)
                hot.append((ids.view(np.int64), key[hot_rows], lk))
                tied = self.p.near(ls, sketch[hot_rows])
                pairs.append((lk[tied], key[hot_rows[tied]]))
                self.leader = (pa_[-1], lb[-1], lk[-1], ls[-1]) if big[-1] and not last else None
        rows = np.flatnonzero(wide & (np.arange(n) < hold))
        if len(rows):
            second = np.where(sure[rows] == 2, label[rows] >> np.uint64(32) & np.uint64(0xFFFF), np.uint64(0))
            self.wide.append(((part[rows] & 0xFFFFFFFF) << np.int64(16) | second.astype(np.int64), key[rows]))
        ready = ~todo & (np.arange(n) < hold)
        stop = np.where(ready, end, 0)
        alive = np.flatnonzero(stop - 1 > np.arange(n))
        step = 1
        while len(alive):
            other = alive + step
            near = self.p.near(sketch[alive], sketch[other])
            if near.any():
                pairs.append((key[alive[near]], key[other[near]]))
            step += 1
            alive = alive[stop[alive] > alive + step]
        self.rest = None if last or hold == n else (part[hold:], label[hold:], key[hold:], sketch[hold:])
        return pairs, hot


def candidates(rows: DataFrame, p: ForestParameters) -> DataFrame:
    """(kind, a, b): kind 0 for candidate pairs of keys, kind 1 for (large node of the sure level, key) memberships."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, n, seen = _Trie(p), [], 0, np.empty(0, dtype=[("a", np.int64), ("b", np.int64)])

        def out(kind, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b)], ["kind", "a", "b"])

        def flush(last: bool):
            nonlocal held, n, seen
            cols = [np.concatenate([h[i] for h in held]) if held else np.empty(0, t) for i, t in enumerate((np.int64, np.uint64, np.int64, np.uint64))]
            held, n = [], 0
            pairs, _ = trie.feed(*cols, last)
            if pairs:
                a, b = np.concatenate([x[0] for x in pairs]), np.concatenate([x[1] for x in pairs])
                both = np.empty(len(a), dtype=seen.dtype)
                both["a"], both["b"] = np.minimum(a, b), np.maximum(a, b)
                both = both[both["a"] != both["b"]]
                seen = np.unique(np.concatenate([seen, both]))  # the trees of one task find many pairs again
                if len(seen) > 200_000 or last:
                    yield out(0, seen["a"], seen["b"])
                    seen = seen[:0]
            elif last and len(seen):
                yield out(0, seen["a"], seen["b"])
            for node, key in trie.wide:
                yield out(1, node, key)
            trie.wide = []

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)))
            n += batch.num_rows
            if n >= 40_000:
                yield from flush(False)
        yield from flush(True)

    # a row goes where the first of its prefixes that is not known to be large goes; a large leaf is salted by its keys
    deep = F.shiftright("part", 32)
    below = F.expr(f"shiftrightunsigned(label, cast(16 * greatest({LEVELS} - shiftright(part, 32) - 1, 0) as int))")
    slot = F.when(deep == 0, F.col("part")).otherwise(F.xxhash64("part", below, F.when(deep == LEVELS, F.shiftrightunsigned("key", 58)).otherwise(0)))
    ordered = rows.repartition(slot).sortWithinPartitions("part", "label", "key")
    return ordered.mapInArrow(walk, "kind tinyint, a bigint, b bigint")


def across(wide: DataFrame, sets: DataFrame, roots: DataFrame, p: ForestParameters) -> DataFrame:
    """(a, b): the pairs of each large node that are in different components and may have the similarity.

    ``wide`` has (node, key). Two sets differ in at least as many words as the parities of their hashed words do, so the bound
    drops no pair. Members of one component never meet, which keeps a long family from being squared. A node above
    ``block_rows`` is cut into blocks. The members of its largest component stay in their blocks, and only the others are
    copied to every block, so a node that one family fills costs its size times the rows outside the family.
    """
    t = round(p.threshold * 1000)
    names = ["node", "block", "mine", "major", "component", "key", "size", "b0", "b1"]
    bits = [F.expr(f"aggregate(words, 0L, (b, w) -> if((w & 64) = {64 * i}, b ^ shiftleft(1L, cast(w & 63 as int)), b))").alias(f"b{i}") for i in (0, 1)]
    one = sets.groupBy("key").agg(F.first("words").alias("words")).select("key", F.size("words").alias("size"), *bits)
    one = one.join(roots.select(F.col("v").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = wide.distinct().join(one, "key")
    per = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    nodes = per.groupBy("node").agg(F.sum("n").alias("n"), F.count("*").alias("components"), F.max_by("component", F.struct("n", "component")).alias("top")).where("components > 1")
    rows = rows.join(nodes.select("node", "top", F.ceil(F.col("n") / p.block_rows).cast("int").alias("blocks")), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("major", F.col("component") == F.col("top"))
    every = F.when(F.col("major"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("block", F.explode(every)).withColumn("mine", F.col("own") == F.col("block"))

    def compare(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, _, mine, major, component, key, size, b0, b1 = cols
        own = np.flatnonzero(mine)
        step = max(1, 1_000_000 // len(key))
        for at in range(0, len(own), step):
            i = own[at : at + step]
            # sorted by component: a tile within one leaves that component out
            j = np.flatnonzero(component != component[i[0]]) if component[i[0]] == component[i[-1]] else np.arange(len(key))
            differ = np.bitwise_count(b0[i, None] ^ b0[None, j]).astype(np.int32) + np.bitwise_count(b1[i, None] ^ b1[None, j])
            r, c = np.nonzero(differ * (1000 + t) <= (size[i, None] + size[None, j]) * (1000 - t))
            x, y = i[r], j[c]
            # two rows of this block meet twice here; two rows outside the largest component meet in the blocks of both
            keep = (component[x] != component[y]) & np.where(mine[y], x < y, major[x] | (key[x] < key[y]))
            if keep.any():
                a, b = key[x[keep]], key[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the block that is open

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from compare([np.concatenate(x) for x in zip(*held)])
                held.clear()

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)] + [batch.column(k).to_numpy().view(np.uint64) for k in (7, 8)]
            if not batch.num_rows:
                continue
            begin = np.concatenate([[0], np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1])
            for s, e in zip(begin, np.append(begin[1:], batch.num_rows)):
                if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][s], cols[1][s]):
                    yield from flush()
                held.append([x[s:e] for x in cols])
        yield from flush()

    ordered = rows.select(*names).repartition("node", "block").sortWithinPartitions("node", "block", "component")
    return ordered.mapInArrow(work, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of keys whose word sets have at least the similarity."""
    one = sets.groupBy("key").agg(F.first("words").alias("words"))
    left = one.select(F.col("key").alias("a"), F.col("words").alias("wa"))
    right = one.select(F.col("key").alias("b"), F.col("words").alias("wb"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    # s >= t * u, in whole numbers of a thousandth, so that no rounding decides a tie
    t = round(threshold * 1000)
    return both.where(shared * 1000 >= t * (F.size("wa") + F.size("wb") - shared)).select("a", "b")


def near_duplicate_groups(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, p: ForestParameters | None = None) -> DataFrame:
    """(id, group_id) of each record in a group of two or more; group_id is the smallest id of the group.

    Two records are linked if their word sets have at least ``min_words`` words each and at least ``threshold`` similarity.
    Null, empty and short texts are in no group. Equal sets are one vertex, so copies never form pairs. Ids are to be
    unique; rows that repeat an id count once. Other columns of ``df`` are ignored.
    """
    p = p or ForestParameters()
    scratch = Scratch(spark)
    sets = scratch.keep(word_sets(df, id_col, text_col, p.min_words), "sets")
    common = common_words(sets, p.common_share)
    hot = hot_prefixes(sets, common, p)
    found = scratch.keep(candidates(labels(sets, common, p, hot), p), "found")
    links = scratch.keep(verified(found.where("kind = 0"), sets, p.threshold), "links")
    edges = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    roots = scratch.keep(connected_components(spark, edges, scratch, reduce_above=1_000_000), "roots")
    wide = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("key"))
    if not wide.isEmpty():
        more = scratch.keep(verified(across(wide, sets, roots, p), sets, p.threshold), "more")
        if not more.isEmpty():
            edges = edges.union(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            roots = scratch.keep(connected_components(spark, edges, scratch, reduce_above=1_000_000), "roots")
    scratch.drop(found)
    per_key = sets.select("id", "key").distinct()
    keys = per_key.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    keys = keys.join(roots.select(F.col("v").alias("key"), "component"), "key", "left").select("key", "least", "n", F.coalesce("component", "key").alias("root"))
    groups = keys.groupBy("root").agg(F.min("least").alias("group_id"), F.sum("n").alias("size")).where("size >= 2")
    of_key = keys.join(groups, "root").select("key", "group_id")
    return per_key.join(of_key, "key").select("id", "group_id")
