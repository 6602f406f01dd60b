"""Stored records and metadata: deduplication, versions, merges, upserts and plans of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StringType

from colonnade.plans.scratch import Scratch

# Priorities of the sources of a field's value.
PRIORITY = {"ddl": 4, "profiling": 4, "manual": 3, "historical": 2, "join_path": 2, "llm": 1}


def priority(source: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def is_empty(c: Column) -> Column:
    """Null, or nothing but blanks."""
    return c.isNull() | (F.trim(c) == "")


def empty_value(df: DataFrame, c: str) -> Column:
    """Whether a column of any type holds nothing: null, NaN, a text of blanks, a list or map without elements."""
    kind = df.schema[c].dataType
    if isinstance(kind, StringType):
        return is_empty(F.col(c))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    if isinstance(kind, (ArrayType, MapType)):
        return F.col(c).isNull() | (F.size(c) == 0)
    return F.col(c).isNull()


def dedup_sessions(existing: DataFrame, new: DataFrame, session: Column, key: list[Column], order: str) -> DataFrame:
    """The rows of ``new`` that are stored when they come one by one in the order of ``order`` (unique): a row whose session or
    whose key is stored already is left out. A null session equals no other.

    In each round the rows that are first of both their session and their key are stored, and the rows that share one with
    them fall out; the first of all rows always is, so the rounds end. Rounds end in a written table.
    """
    scratch = Scratch(new.sparkSession)
    names = [f"_k{i}" for i in range(len(key))]
    part = F.xxhash64(*names)
    ids = new.withColumns(dict(zip(names, key))).select(F.col(order).alias("_o"), session.alias("_s"), *names)
    known = existing.withColumns(dict(zip(names, key)))
    open_ = ids.join(known.select(*names).distinct(), names, "left_anti").join(known.select(session.alias("_s")).where("_s is not null").distinct(), "_s", "left_anti")
    open_ = scratch.keep(open_.select("_o", F.coalesce(F.col("_s"), F.concat(F.lit("\0"), F.col("_o").cast("string"))).alias("_s"), part.alias("_k")), "open")
    kept = None
    while not open_.isEmpty():
        first_s, first_k = open_.groupBy("_s").agg(F.min("_o").alias("_os")), open_.groupBy("_k").agg(F.min("_o").alias("_ok"))
        won = scratch.keep(open_.join(first_s, "_s").join(first_k, "_k").where("_o = _os and _o = _ok").select("_o", "_s", "_k"), "won")
        kept = won if kept is None else kept.union(won)
        rest = open_.join(won.select("_s"), "_s", "left_anti").join(won.select("_k"), "_k", "left_anti")
        open_ = scratch.keep(rest.select("_o", "_s", "_k"), "open")
    return new.limit(0) if kept is None else new.join(kept.select(F.col("_o").alias(order)), order, "left_semi")


def dedup_records(existing: DataFrame, new: DataFrame, key: list[Column], order: str) -> DataFrame:
    """The rows of ``new`` to append: of equal keys the first by ``order``, unless an existing row has the key."""
    names = [f"_k{i}" for i in range(len(key))]
    known = existing.select(*[k.alias(n) for k, n in zip(key, names)]).distinct()
    fresh = new.withColumns(dict(zip(names, key))).join(known, names, "left_anti")
    w = Window.partitionBy(*names).orderBy(order)
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *names)


def resolve_versions(versions: DataFrame) -> DataFrame:
    """(entity, field, value, source): versions (entity, field, value, source, seq) folded in the order of ``seq``.

    A value is taken if its source's priority is not below the best so far, which counts refused and overwritten versions
    too, or if the current value is empty.
    """
    item = F.struct("seq", "value", "source", priority(F.col("source")).alias("p"))
    ordered = versions.groupBy("entity", "field").agg(F.array_sort(F.collect_list(item)).alias("v"))
    start = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source"), F.lit(-1).alias("best"))

    def step(s: Column, x: Column) -> Column:
        take = (x["p"] >= s["best"]) | is_empty(s["value"])
        return F.struct(F.when(take, x["value"]).otherwise(s["value"]).alias("value"), F.when(take, x["source"]).otherwise(s["source"]).alias("source"), F.greatest(s["best"], x["p"]).alias("best"))

    folded = ordered.select("entity", "field", F.aggregate("v", start, step).alias("s"))
    return folded.select("entity", "field", "s.value", "s.source")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; a value that is not null in ``new`` replaces the old one."""
    values = [c for c in old.columns if c not in keys]
    joined = old.join(new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values]), keys, "full")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in values])


def append_unique(old: Column, new: Column) -> Column:
    """Two lists joined, each element kept where it comes first."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


def merge_pairs(pairs: DataFrame, zero_is_null: bool = True) -> DataFrame:
    """One row for each unordered pair of ``pairs`` (a, b, method, score): all methods in order, best score, number of rows.

    The stored form keeps no score of exactly 0.
    """
    best = F.max("score")
    got = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "method", "score").groupBy("a", "b").agg(
        F.array_sort(F.collect_set("method")).alias("methods"), (F.nullif(best, F.lit(0.0)) if zero_is_null else best).alias("score"), F.count("*").alias("rows")
    )
    return got


def correct_complement(wrong: DataFrame, correct: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each wrong record its keys' first correct record: (*keys, record, correct_record)."""
    first = correct.groupBy(*keys).agg(F.min(order).alias("correct_record"))
    return wrong.join(first, keys).select(*keys, F.col(order).alias("record"), "correct_record")


def missing_fields(required: DataFrame, current: DataFrame) -> DataFrame:
    """Requirements (entity, field, priority) whose current value (entity, field, value, source) is empty or out-ranked."""
    have = current.select("entity", "field", F.col("value").alias("_v"), priority(F.col("source")).alias("_p"))
    got = required.join(have, ["entity", "field"], "left")
    reason = F.when(is_empty(F.col("_v")), "missing").when(F.col("_p") < F.col("priority"), "outranked")
    return got.select("entity", "field", reason.alias("reason")).where("reason is not null")


def newest_years(records: DataFrame, ts: str, years: int = 3) -> DataFrame:
    """The records of the newest ``years`` years that occur; on a table partitioned by year this prunes partitions."""
    last = records.agg(F.max(F.year(ts)).alias("_last"))
    return records.crossJoin(F.broadcast(last)).where(F.year(ts) > F.col("_last") - years).drop("_last")


def last_share(rows: DataFrame, by: str, order: str, percent: int) -> DataFrame:
    """The last ``percent`` of each group's rows in the order of ``order``, one at least."""
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    counts = counts.withColumnRenamed(by, "_g")
    got = ranked(rows, by, order, descending=True).join(counts, F.col(by).eqNullSafe(F.col("_g"))).drop("_g")
    return got.where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * percent / 100))).drop("_n", "_r")


def ranked(rows: DataFrame, by: str, order: str, descending: bool = False) -> DataFrame:
    """``rows`` with ``_r``, the place of each in its group by ``order``, a number. Groups may be of any size: rows are ranked within
    ranges of ``order``, and the ranges before it in the group are counted, so no task sorts a whole group."""
    place = F.col(order).desc() if descending else F.col(order).asc()
    bounds = rows.stat.approxQuantile(order, [i / 64 for i in range(1, 64)], 0.01)
    step = F.array(*[F.lit(float(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
    parts = rows.withColumn("_p", F.size(F.filter(step, lambda b: b < F.col(order))))
    inside = F.row_number().over(Window.partitionBy(by, "_p").orderBy(place))
    counts = parts.groupBy(by, "_p").agg(F.count("*").alias("_c"))
    along = Window.partitionBy(by).orderBy(F.desc("_p") if descending else F.asc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col(by).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_b"))
    return parts.withColumn("_i", inside).join(before, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).withColumn("_r", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b", "_g", "_q")


def session_ids(rows: DataFrame, by: str, order: str, existing: DataFrame) -> DataFrame:
    """``rows`` with ``session``: counters of each group that go on after the largest of ``existing`` (by, last)."""
    got = ranked(rows, by, order).join(existing, by, "left")
    return got.withColumn("session", F.concat(F.col(by), F.lit("_"), F.lpad((F.coalesce("last", F.lit(0)) + F.col("_r")).cast("string"), 6, "0"))).drop("_r", "last")
