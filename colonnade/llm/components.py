"""Problem 5: one group identifier for all records linked by pairwise matches.

The graph is reduced before it is solved: vertices of degree one are stripped and chains of degree-two vertices are
compressed by list ranking (pointer doubling over directed arcs), again and again while that shrinks the edge list; the
core that is left is labelled, by one task if its checked size is small, else by alternating large-star and small-star
steps; then labels go back to the removed vertices in reverse order. Every step is a join or an aggregation over the
whole edge table and ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators.graph import both_ways, canonical, number_keys, star_labels, union_labels
from colonnade.plans.scratch import Scratch


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end among the vertices ``gone.v``."""
    return edges.join(gone.select(F.col("v").alias("src")), "src", "left_anti").join(
        gone.select(F.col("v").alias("dst")), "dst", "left_anti"
    ).select("src", "dst")


def strip_leaves(edges: DataFrame) -> DataFrame:
    """(v, parent) of every vertex of degree one; of two that only have each other, the smaller one stays."""
    around = both_ways(edges).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"), F.min("dst").alias("parent"))
    leaves = around.where("deg = 1").select("v", "parent")
    other = leaves.select(F.col("v").alias("parent"), F.col("parent").alias("back"))
    return leaves.join(other, "parent", "left").where("back is null or v > parent").select("v", "parent")


def rank_chains(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int] | None:
    """List ranking of the chains of degree-two vertices: (v, parent) for each of them, the edges that replace the chains, and their number.

    A row stands for the arc that leaves ``y`` towards one neighbour and holds how far it has been followed. One round
    replaces the followed stretch by the stretch of the vertex it ended at, so a chain of length n takes log2(n) rounds.
    """
    around = both_ways(edges).groupBy(F.col("src").alias("y")).agg(
        F.count("*").alias("deg"), F.min("dst").alias("lo"), F.max("dst").alias("hi")
    )
    inner = scratch.keep(around.where("deg = 2").select("y", "lo", "hi"), "inner")
    n = inner.count()
    if not n:
        return None
    ends = inner.select(F.col("y").alias("cur"), F.lit(True).alias("open"))
    arcs = inner.select("y", F.col("hi").alias("other"), F.col("lo").alias("cur"), F.col("y").alias("before"), F.col("y").alias("low")).union(
        inner.select("y", F.col("lo").alias("other"), F.col("hi").alias("cur"), F.col("y").alias("before"), F.col("y").alias("low"))
    )
    arcs = scratch.keep(arcs.join(ends, "cur", "left").select("y", "other", "cur", "before", "low", F.coalesce("open", F.lit(False)).alias("open")), "arcs")
    state = None
    while True:
        now = arcs.where("open").agg(F.count("*"), F.sum(F.xxhash64("y", "low") % 1000003)).first()
        if not now[0] or tuple(now) == state:
            break  # what is still open then are rings, and each arc knows its ring's smallest vertex
        state = tuple(now)
        nxt = arcs.select(
            F.col("y").alias("cur"), F.col("other").alias("before"), F.col("cur").alias("cur2"), F.col("before").alias("before2"), F.col("low").alias("low2"), F.col("open").alias("open2")
        )
        moved = arcs.where("open").join(nxt, ["cur", "before"]).select(
            "y", "other", F.col("cur2").alias("cur"), F.col("before2").alias("before"), F.least("low", "low2").alias("low"), F.col("open2").alias("open")
        )
        done = arcs.where("not open").select("y", "other", "cur", "before", "low", "open")
        after = scratch.keep(done.union(moved), "arcs")
        scratch.drop(arcs)
        arcs = after
    per = arcs.groupBy("y").agg(
        F.min("cur").alias("e1"), F.max("cur").alias("e2"), F.max("open").alias("ring"), F.min("low").alias("low")
    )
    per = scratch.keep(per, "chains")
    gone = per.select(F.col("y").alias("v"), F.when(F.col("ring"), F.col("low")).otherwise(F.col("e1")).alias("parent"))
    links = per.where("not ring and e1 <> e2").select(F.col("e1").alias("src"), F.col("e2").alias("dst")).distinct()
    return gone, links, n


def connected_components(
    spark: SparkSession, edges: DataFrame, scratch: Scratch | None = None, least_gain: float = 0.1, one_task: int = 1_000_000, reduce_above: int = 0
) -> DataFrame:
    """(v, component) of every vertex of ``edges`` (src bigint, dst bigint); component is the smallest vertex of the group.

    Edges may repeat, be turned round or be loops; a vertex with only loops or null ends is in no group. Reduction goes
    on while a round of it removes at least ``least_gain`` of the edges and more than ``reduce_above`` are left. A core of at
    most ``one_task`` edges is solved by one task.
    """
    scratch = scratch or Scratch(spark)
    edges = whole = scratch.keep(canonical(edges.where("src is not null and dst is not null")), "edges")
    size = edges.count()
    removed: list[DataFrame] = []
    while size > reduce_above:
        before = size
        leaves = scratch.keep(strip_leaves(edges), "leaves")
        removed.append(leaves)
        edges = scratch.keep(_without(edges, leaves), "edges")
        if ranked := rank_chains(edges, scratch):
            gone, links, _ = ranked
            removed.append(gone)
            edges = scratch.keep(canonical(_without(edges, gone).union(links)), "edges")
        size = edges.count()
        if before - size < least_gain * before:
            break
    labels = spark.createDataFrame([], "v bigint, root bigint")
    if size:
        labels = scratch.keep(union_labels(edges), "core") if size <= one_task else star_labels(scratch.keep(edges, "core"), scratch)
    for gone in reversed(removed):
        at = labels.select(F.col("v").alias("parent"), "root")
        back = gone.join(at, "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
        labels = scratch.keep(labels.union(back), "labels")
    vertices = both_ways(whole).select(F.col("src").alias("v")).distinct()
    full = vertices.join(labels.distinct(), "v", "left").select("v", F.coalesce("root", "v").alias("root"))
    full = scratch.keep(full, "rooted")
    least = full.groupBy("root").agg(F.min("v").alias("component"))
    return full.join(least, "root").select("v", "component")


def column_part(c: str) -> Column:
    """A database, table or column name without case, surrounding blanks and one pair of identifier quotes; empty becomes null."""
    bare = F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    inner = F.regexp_extract(bare, r"(?s)^(?:`(.*)`|\"(.*)\"|\[(.*)\])$", 0)
    open_ = F.when(inner != "", F.substring(bare, 2, 1_000_000).substr(F.lit(1), F.length(bare) - 2)).otherwise(bare)
    return F.nullif(F.regexp_replace(open_, r"(?U)^\s+|\s+$", ""), F.lit(""))


def linked_columns(df: DataFrame, database: str, ends: tuple[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """(a, b): the column keys of each row with two complete ends; a row that links a column to itself is kept."""
    keys = [F.concat_ws(".", column_part(database), column_part(t), column_part(c)) for t, c in ends]
    whole = [column_part(x).isNotNull() for x in (database, *ends[0], *ends[1])]
    for w in whole:
        df = df.where(w)
    return df.select(keys[0].alias("a"), keys[1].alias("b"))


def key_groups(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(key, group_key) of every key linked to another one by ``links`` (a string, b string), directly or through others.

    group_key is the group's smallest key by character code. Null ends and links of a key with itself link nothing, so a
    key with no other link has no row; repeated and turned-round links change nothing.
    """
    scratch = Scratch(spark)
    pairs = scratch.keep(links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ids, edges = number_keys(pairs, scratch)
    groups = connected_components(spark, edges, scratch)
    named = groups.join(ids.select(F.col("id").alias("v"), "key"), "v")
    return named.join(ids.select(F.col("id").alias("component"), F.col("key").alias("group_key")), "component").select("key", "group_key")
