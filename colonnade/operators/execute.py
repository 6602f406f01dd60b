"""Running SQL text: outcome, preview, time, and the five ways to compare two results.

SQL text goes through the session's parser and analyzer, which report most errors before a task runs. One aggregation over
the result tells empty and all-null results from others. Comparisons are joins or set operations over whole results.
"""

from __future__ import annotations

import threading
import uuid
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("success", "timeout", "empty_result", "all_null_result", "execution_error")


class Outcome(NamedTuple):
    result_type: str
    rows: int | None
    error: str | None
    result: DataFrame | None


def classify(df: DataFrame) -> DataFrame:
    """(rows, result_type) of a result, from one aggregation."""
    some = F.coalesce(*[F.when(F.col(f"`{c}`").isNotNull(), 1) for c in df.columns]) if df.columns else F.lit(None)
    n = df.agg(F.count("*").alias("rows"), F.count(some).alias("filled"))
    kind = F.when(F.col("rows") == 0, "empty_result").when(F.col("filled") == 0, "all_null_result").otherwise("success")
    return n.select("rows", kind.alias("result_type"))


def read_only(spark: SparkSession, sql: str) -> bool:
    """Whether the text is one query: commands and writes, also below a WITH, are none. Text that does not parse raises the parser's error."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    base = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [spark._jvm.java.lang.Class.forName(base + k, True, loader) for k in ("Command", "ParsedStatement")]
    stack = [plan]
    while stack:
        node = stack.pop()
        if any(k.isInstance(node) for k in kinds):
            return False
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return True


def run(spark: SparkSession, sql: str, timeout: float = 30.0) -> Outcome:
    """Runs a query for at most ``timeout`` seconds and says how it ended; the result itself stays distributed.

    Nothing but queries is run: text that would change or list anything is an ``execution_error``.

    The query runs in a thread of its own under a tag. After the timeout its jobs are cancelled, and the call returns
    whether or not their tasks have ended by then.
    """
    tag, ended = f"run-{uuid.uuid4().hex}", []

    def work() -> None:
        spark.addTag(tag)
        try:
            text = sql.strip().rstrip(";")
            if not read_only(spark, text):
                ended.append(Outcome("execution_error", None, "only queries are run", None))
                return
            df = positional(spark.sql(text))
            rows, kind = classify(df).first()
            ended.append(Outcome(kind, rows, None, df))
        except PySparkException as e:
            ended.append(Outcome("execution_error", None, str(e).split("\n")[0], None))
        except Exception as e:  # what is cancelled does not always come back as Spark's own error
            ended.append(Outcome("execution_error", None, type(e).__name__, None))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(timeout)
    if ended:
        return ended[0]
    spark.interruptTag(tag)
    return Outcome("timeout", None, None, None)


def positional(df: DataFrame) -> DataFrame:
    """The columns named by position, so that results compare without names and repeated names do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def preview(df: DataFrame, order: list[str], rows: int = 5, width: int = 100) -> DataFrame:
    """The first rows by ``order`` with texts cut to ``width`` characters."""
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(F.col(c), 1, width), F.lit("..."))).otherwise(F.col(c)).alias(c)
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.orderBy(*order).limit(rows).select(*[cut(c) if c in text else F.col(c) for c in df.columns])


def _strings(df: DataFrame) -> list[Column]:
    """Cells as text: numbers by their double value, null as NULL."""
    number = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    out = []
    for f in positional(df).schema.fields:
        c = F.col(f.name)
        out.append(F.coalesce((c.cast("double") if f.dataType.simpleString().startswith(number) else c).cast("string"), F.lit("NULL")))
    return out


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def ex_set_equal(a: DataFrame, b: DataFrame) -> bool:
    """Sets of rows as sets of cells: row order, repeats, column order and repeated cells do not count."""
    key = lambda d: positional(d).select(F.array_sort(F.array_distinct(F.array(*_strings(d)))).alias("r")).distinct()
    return _same_rows(key(a), key(b))


def bag_equal(a: DataFrame, b: DataFrame) -> bool:
    """Bags of rows as bags of cells: row order and column order do not count."""
    key = lambda d: positional(d).select(F.array_sort(F.array(*_strings(d))).alias("r"))
    return _same_rows(key(a), key(b))


def positional_equal(a: DataFrame, b: DataFrame) -> bool:
    """Bags of rows cell by cell; names and row order do not count."""
    if len(a.columns) != len(b.columns):
        return False
    key = lambda d: positional(d).select(F.array(*_strings(d)).alias("r"))
    return _same_rows(key(a), key(b))


def positional_set_equal(a: DataFrame, b: DataFrame) -> bool:
    """Equal numbers of rows and equal sets of rows."""
    if len(a.columns) != len(b.columns) or a.count() != b.count():
        return False
    key = lambda d: positional(d).select(F.array(*_strings(d)).alias("r")).distinct()
    return _same_rows(key(a), key(b))


def result_key(df: DataFrame) -> DataFrame:
    """(result_key): one hash of the set of rows, the same for equal sets whatever their order.

    The hashes of the distinct rows are summed modulo two primes in a distributed aggregation, so no task holds all rows.
    """
    rows = positional(df).select(F.xxhash64(*_strings(df)).alias("h")).distinct()
    parts = [F.coalesce(F.sum(F.pmod("h", F.lit(p)).cast("decimal(38,0)")), F.lit(0)).cast("string") for p in (2147483647, 2147483629)]
    return rows.agg(F.md5(F.concat_ws("|", F.count("*").cast("string"), *parts)).alias("result_key"))


def usual_times(log: DataFrame, by: list[str], ms: str) -> DataFrame:
    """``log`` with null for the runs beyond three population deviations. The statistics come from a grouped aggregation that is
    joined back, so that a group with many runs does not meet in one task."""
    stats = log.groupBy(*by).agg(F.avg(ms).alias("_m"), F.stddev_pop(ms).alias("_s"))
    inside = F.abs(F.col(ms) - F.col("_m")) <= 3 * F.col("_s") + 1e-9
    return log.join(stats, by).withColumn(ms, F.when(inside, F.col(ms))).drop("_m", "_s")


def trimmed_time(log: DataFrame, by: list[str], ms: str) -> DataFrame:
    """Mean time of each statement without runs beyond three population deviations; infinity where no run succeeded."""
    kept = usual_times(log, by, ms)
    return kept.groupBy(*by).agg(F.coalesce(F.avg(ms), F.lit(float("inf"))).alias("mean_ms"), F.count(ms).alias("runs"))


def repeat_times(spark: SparkSession, sql: str, repeats: int = 10, timeout: float = 30.0) -> float:
    """Mean milliseconds of the runs of a query that do not fail, without outliers; infinity if all fail."""
    import time

    taken = []
    for _ in range(repeats):
        began = time.perf_counter()
        if run(spark, sql, timeout).result_type not in ("execution_error", "timeout"):
            taken.append((time.perf_counter() - began) * 1000)
    if not taken:
        return float("inf")
    middle = sum(taken) / len(taken)
    spread = (sum((t - middle) ** 2 for t in taken) / len(taken)) ** 0.5
    kept = [t for t in taken if abs(t - middle) <= 3 * spread + 1e-9]
    return sum(kept) / len(kept)


class Runs:
    """Runs queries and remembers the outcomes of the last ``most`` different ones by (text, timeout)."""

    def __init__(self, spark: SparkSession, most: int = 1000):
        self.spark, self.most, self.known = spark, most, {}

    def run(self, sql: str, timeout: float = 30.0) -> Outcome:
        key = " ".join(sql.split()), timeout
        self.known[key] = got = self.known.pop(key, None) or run(self.spark, sql, timeout)
        while len(self.known) > self.most:
            self.known.pop(next(iter(self.known)))
        return got

    def first_rows(self, sql: str, most: int, timeout: float = 30.0) -> list[tuple]:
        """At most ``most`` rows of a query's result; none if it fails."""
        got = self.run(sql, timeout).result
        return [] if got is None else [tuple(r) for r in got.limit(most).collect()]

    def check(self, sql: str, timeout: float = 30.0) -> dict[str, bool]:
        """The two checks that need a run: whether the text runs at all, and whether its result is one to keep."""
        kind = self.run(sql, timeout).result_type
        return {"syntax": kind in ("success", "empty_result", "all_null_result"), "result": kind == "success"}

    def choose(self, texts: list[str], timeout: float = 30.0) -> str | None:
        """The first text of the most frequent result among those that run with one to keep, or among all that run."""
        done = [(t, self.run(t, timeout)) for t in texts]
        for kinds in (("success",), ("success", "empty_result", "all_null_result")):
            keys = [(t, result_key(o.result).first()[0]) for t, o in done if o.result_type in kinds]
            if keys:
                each = [k for _, k in keys]
                return max(keys, key=lambda x: each.count(x[1]))[0]
        return None
