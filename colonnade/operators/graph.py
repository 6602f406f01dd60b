"""Connected components of links between columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.scratch import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def canonical(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .where("src < dst")
        .distinct()
    )


def star_labels(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, root) of the vertices of ``edges`` by alternating large-star and small-star steps until the edges stay the same."""
    state = None
    while True:
        around = both_ways(edges)
        low = around.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = around.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(low, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").union(low.select("src", F.col("m").alias("dst"))).distinct()
        after = scratch.keep(small.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "stars")
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1000003)).first())
        scratch.drop(edges)
        edges = after
        if now == state:
            return edges.select(F.col("src").alias("v"), F.col("dst").alias("root"))
        state = now


def union_labels(edges: DataFrame) -> DataFrame:
    """(v, root) by union-find in a single task, for an edge table whose size has been checked."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        vs = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array([find(v) for v in vs], pa.int64())], ["v", "root"])

    return edges.select("src", "dst").coalesce(1).mapInArrow(solve, "v bigint, root bigint")


def solve(edges: DataFrame, scratch: Scratch, one_task: int = 1_000_000) -> DataFrame:
    """(v, root) of the vertices of canonical edges; vertices that are their own root may be missing."""
    edges = scratch.keep(edges, "core")
    return scratch.keep(union_labels(edges) if edges.count() <= one_task else star_labels(edges, scratch), "labels")


def number_keys(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, id) of all keys of the pairs (a, b), ids in the order of the keys, and the pairs as edges (src, dst).

    Ranges of keys are sorted each for itself; an id has the number of its range in the upper bits.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = scratch.keep(keys.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("id")), "ids")
    edges = pairs.join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b")
    return ids, edges.select("src", "dst")


def column_groups(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(key, group_key) of the keys linked by ``links`` (a, b): the smallest key of each group. Null ends and loops link nothing."""
    scratch = Scratch(spark)
    pairs = scratch.keep(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "pairs")
    ids, edges = number_keys(pairs, scratch)
    labels = solve(canonical(edges), scratch).select(F.col("v").alias("id"), "root")
    rooted = ids.join(labels, "id", "left").select("key", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("key").alias("group_key"))
    return rooted.join(least, "root").select("key", "group_key")
