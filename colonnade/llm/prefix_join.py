"""Problem 2: all similar pairs between set-valued records by an extended-prefix join.

The values of a set are ordered from rare to frequent. Two sets with a similarity of at least t share at least l of the
first n - ceil(t n) + l values of either, for every l they have in common. A record starts with l = 1. Where its prefix
values are frequent, so that joining on them would compare it with too many others, it moves on to the longer prefix of
l = 2 and then l = 3 and is joined on combinations of two or three prefix values, which far fewer records share. The
choice is made by the summed number of partners and costs no pair: a record that stays at level l probes the index of
all records that reached level l, and those that move on meet each other at the next level. Candidates that the sizes
and positions cannot rule out are verified on the whole sets. Equal sets are joined as one set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.scratch import Scratch

#: Surrounding white space as a reader of the values would strip it, with the four separators of ASCII.
EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f\x{a0}]+|[\s\x1c-\x1f\x{a0}]+$"
LEVELS = 3


def value_set(values: Column) -> Column:
    """The distinct values without surrounding white space, in lower case, without nulls and empties; null stays null."""
    clean = F.transform(values, lambda v: F.lower(F.regexp_replace(v, EDGE_BLANKS, "")))
    return F.array_distinct(F.filter(clean, lambda v: v.isNotNull() & (v != "")))


def _ordered(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, n, toks): the values of each distinct set as hashes, from rare to frequent."""
    one = sets.groupBy("key").agg(F.first("toks").alias("toks"))
    rows = one.select("key", F.explode("toks").alias("tok"))
    df = rows.groupBy("tok").agg(F.count("*").alias("df"))
    sorted_ = rows.join(df, "tok").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("v"))
    return scratch.keep(sorted_.select("key", F.size("v").alias("n"), F.col("v.tok").alias("toks")), "ordered")


def _combinations(level: int, threshold: float) -> Column:
    """For each choice of ``level`` values of the prefix (hash, position of the last one)."""
    p = F.least(F.col("n"), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + level).cast("int"))
    prefix = F.slice("toks", 1, p)
    if level == 1:
        return F.transform(prefix, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("pos")))
    indexed = F.transform(prefix, lambda x, i: F.struct(x.alias("x"), i.alias("pos")))

    def after(i: Column) -> Column:
        return F.slice(indexed, i + 2, F.greatest(p - i - 1, F.lit(0)))

    if level == 2:
        return F.flatten(F.transform(indexed, lambda a: F.transform(after(a["pos"]), lambda b: F.struct(F.xxhash64(a["x"], b["x"]).alias("h"), b["pos"].alias("pos")))))
    return F.flatten(
        F.flatten(
            F.transform(
                indexed,
                lambda a: F.transform(
                    after(a["pos"]),
                    lambda b: F.transform(after(b["pos"]), lambda c: F.struct(F.xxhash64(a["x"], b["x"], c["x"]).alias("h"), c["pos"].alias("pos"))),
                ),
            )
        )
    )


def _number_of_combinations(n: Column, level: int, threshold: float) -> Column:
    p = n - F.ceil(n * threshold - 1e-9) + level
    return {1: p, 2: p * (p - 1) / 2, 3: p * (p - 1) * (p - 2) / 6}[level]


def similar_sets(spark: SparkSession, sets: DataFrame, threshold: float, scratch: Scratch, partners: int = 400, combinations: int = 20_000) -> DataFrame:
    """(a, b) with a < b: the keys of all two different sets of ``sets`` (key bigint, toks array<bigint>) with at least that similarity.

    A record moves to the next level if its prefix values have more than ``partners`` partners in all and its combinations
    there are at most ``combinations``, so that the join of the next level is the cheaper one.
    """
    ordered = _ordered(sets, scratch)
    rows, found = ordered, None
    for level in range(1, LEVELS + 1):
        index = rows.select("key", "n", F.explode(_combinations(level, threshold)).alias("c")).select("key", "n", "c.h", "c.pos")
        shared = index.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
        index = scratch.keep(index.join(shared, "h"), f"index{level}")
        if level < LEVELS:
            heavy = index.groupBy("key").agg(F.sum(F.col("df") - 1).alias("cost"), F.first("n").alias("n"))
            heavy = heavy.where((F.col("cost") > partners) & (_number_of_combinations(F.col("n"), level + 1, threshold) <= combinations))
            heavy = scratch.keep(heavy.select("key"), "heavy")
            probe = index.join(heavy, "key", "left_anti")
        else:
            probe = index
        left = probe.select("h", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
        right = index.select("h", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
        both = left.join(right, "h").where(
            (F.col("a") != F.col("b"))
            & (F.col("nb") >= F.col("na") * threshold - 1e-9)
            & (F.col("na") >= F.col("nb") * threshold - 1e-9)
            & (level + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1 >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
        )
        both = scratch.keep(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs{level}")
        scratch.drop(index)
        found = both if found is None else found.union(both)
        if level < LEVELS:
            rows = rows.join(heavy, "key", "left_semi")
            if heavy.isEmpty():
                break
    body = ordered.select("key", "toks")
    joined = (
        found.distinct()
        .join(body.select(F.col("key").alias("a"), F.col("toks").alias("ta")), "a")
        .join(body.select(F.col("key").alias("b"), F.col("toks").alias("tb")), "b")
    )
    overlap = F.size(F.array_intersect("ta", "tb"))
    whole = round(threshold * 1000)
    return joined.where(overlap * 1000 >= whole * (F.size("ta") + F.size("tb") - overlap)).select("a", "b")


def similar_set_pairs(
    spark: SparkSession,
    df: DataFrame,
    id_col: str,
    values_col: str,
    same_cols: list[str],
    threshold: float = 0.6,
    min_values: int = 5,
    other: DataFrame | None = None,
) -> DataFrame:
    """(id_a, id_b) of all pairs of records whose value sets have at least ``min_values`` values and ``threshold`` similarity.

    Within one table id_a < id_b, and two records that agree in all of ``same_cols`` are no pair (two nulls agree). With
    ``other``, a table of the same columns, the pairs are those between the tables, id_a from ``df``. Null sets, and sets
    with too few values after cleaning, are in no pair. Ids are to be unique. Records with equal sets are a pair. They are
    one set in the join and are expanded at the end, since the result has a row for each pair.
    """
    scratch = Scratch(spark)

    def side(d: DataFrame, which: int) -> DataFrame:
        same = F.struct(*[F.col(c) for c in same_cols]).alias("same") if same_cols else F.col(id_col).alias("same")
        toks = F.array_sort(F.transform(value_set(F.col(values_col)), lambda v: F.xxhash64(v)))
        return d.select(F.col(id_col).alias("id"), F.xxhash64(same).alias("same"), toks.alias("toks"), F.lit(which).alias("side"))

    every = side(df, 0) if other is None else side(df, 0).union(side(other, 1))
    every = scratch.keep(every.where(F.size("toks") >= min_values).withColumn("key", F.xxhash64("toks")), "sets")
    members = every.select("key", "id", "same", "side")
    pairs = scratch.keep(similar_sets(spark, every.select("key", "toks"), threshold, scratch), "similar")
    keys = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("a"), F.col("key").alias("b"))
    pairs = pairs.union(keys)
    left = members.select(F.col("key").alias("a"), F.col("id").alias("ia"), F.col("same").alias("sa"), F.col("side").alias("da"))
    right = members.select(F.col("key").alias("b"), F.col("id").alias("ib"), F.col("same").alias("sb"), F.col("side").alias("db"))
    full = pairs.join(left, "a").join(right, "b")
    if other is None:
        full = full.where("(a <> b or ia < ib) and sa <> sb") if same_cols else full.where("a <> b or ia < ib")
        return full.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    full = full.where("da <> db and (a <> b or da = 0)")
    if same_cols:
        full = full.where("sa <> sb")
    return full.select(F.when(F.col("da") == 0, F.col("ia")).otherwise(F.col("ib")).alias("id_a"), F.when(F.col("da") == 0, F.col("ib")).otherwise(F.col("ia")).alias("id_b"))
