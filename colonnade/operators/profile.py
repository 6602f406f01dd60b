"""Column profiles from one scan of each table.

``cells`` counts the values of each named column by itself, in its own type, and returns rows of (table_name, column_name,
value, n). Every column is read once, no row is multiplied, and partial aggregation keeps hot values from ever meeting in
one task; what needs distinct values starts from there. Counts and extrema alone come from one wide aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NUMBER = r"^[0-9]+\.?[0-9]*$"  # no sign, and a digit first
KEY = ["table_name", "column_name"]


def cells(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    out = None
    for t, cols in columns.items():
        for c in cols:
            counts = tables[t].groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
            rows = counts.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), "n")
            out = rows if out is None else out.union(rows)
    return out


def value_counts(cell_rows: DataFrame) -> DataFrame:
    """(table_name, column_name, value, n), null as a value of its own; rows that are counted already stay as they are."""
    if "n" in cell_rows.columns:
        return cell_rows
    return cell_rows.groupBy(*KEY, "value").agg(F.count("*").alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) and the sum over all tables."""
    out = None
    for t, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        out = one if out is None else out.union(one)
    return out.union(out.agg(F.lit("(all)"), F.sum("row_count")))


def column_stats(cell_rows: DataFrame) -> DataFrame:
    """Non-null count, distinct count and null count of each column."""
    return value_counts(cell_rows).groupBy(*KEY).agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("total_count"),
        F.count("value").alias("distinct_count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
    )


def basic_profile(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """total, non-null and null counts and extrema as text, from one aggregation over the table."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        v = F.col(c) + 0.0 if df.schema[c].dataType.typeName() in ("double", "float") else F.col(c)  # one zero instead of two
        aggs += [F.count(c).alias(f"c{i}"), F.min(v).cast("string").alias(f"l{i}"), F.max(v).cast("string").alias(f"h{i}")]
    each = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("non_null"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)]
    wide = df.agg(*aggs).select("n", F.explode(F.array(*each)).alias("p"))
    return wide.select(
        F.lit(table).alias("table_name"), "p.column_name", F.col("n").alias("total_count"), F.col("p.non_null").alias("non_null_count"),
        (F.col("n") - F.col("p.non_null")).alias("null_count"), F.col("p.low").alias("min_value"), F.col("p.high").alias("max_value"),
    )


def top_values(cell_rows: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of each column with their rank, ties by value."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "value")
    counts = value_counts(cell_rows.where("value is not null"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*KEY, "value", F.col("n").alias("frequency"), "rank")


def length_stats(cell_rows: DataFrame) -> DataFrame:
    """Shortest, longest and mean length of the distinct values."""
    each = value_counts(cell_rows.where("value is not null"))
    n = F.length("value")
    return each.groupBy(*KEY).agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.substring(a, F.lit(1), F.array_max(same))


def fixity(cell_rows: DataFrame, least: int = 3) -> DataFrame:
    """The prefix and suffix that all distinct non-empty values of a column share, if there are two values or more and it
    has ``least`` characters. The prefix of a set is that of its smallest and largest member."""
    each = value_counts(cell_rows.where("value <> ''"))
    got = each.groupBy(*KEY).agg(
        F.count("*").alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.min(F.reverse("value")).alias("rlo"), F.max(F.reverse("value")).alias("rhi")
    )
    got = got.where("k >= 2").select(*KEY, common_prefix(F.col("lo"), F.col("hi")).alias("p"), F.reverse(common_prefix(F.col("rlo"), F.col("rhi"))).alias("s"))
    keep = lambda c: F.when(F.length(c) >= least, F.col(c))
    return got.select(*KEY, keep("p").alias("fixed_prefix"), keep("s").alias("fixed_suffix"))


def semantic_type(family: Column, distinct: Column, total: Column) -> Column:
    """Unknown, Datetime, Categorical, Identifier, Numerical or Free_Text, the first that fits; total counts nulls too."""
    share = distinct / total
    return (
        F.when((total == 0) | distinct.isNull(), "Unknown")
        .when(family == "time", "Datetime")
        .when((family == "number") & (distinct <= 20), "Categorical")
        .when((family == "number") & (share > 0.95), "Identifier")
        .when(family == "number", "Numerical")
        .when((family == "text") & (distinct <= 100) & (share < 0.6), "Categorical")
        .when((family == "text") & (share > 0.95), "Identifier")
        .when(family == "text", "Free_Text")
        .otherwise("Unknown")
    )


def key_uniqueness(cell_rows: DataFrame) -> DataFrame:
    """Whether a column is unique, how much it repeats, and whether it can be a primary key or a join key."""
    got = value_counts(cell_rows).groupBy(*KEY).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("distinct_count")
    )
    rate = F.when(F.col("non_null") > 0, 1 - F.col("distinct_count") / F.col("non_null")).otherwise(0.0)
    unique = (F.col("non_null") == F.col("distinct_count")) & (F.col("non_null") > 0)
    return got.select(
        *KEY, "total", "non_null", "distinct_count", unique.alias("is_unique"), F.round(rate, 4).alias("duplication_rate"),
        (unique & (F.col("non_null") == F.col("total"))).alias("can_be_pk"), (rate < 0.1).alias("can_be_join_key"),
    )


def value_examples(cell_rows: DataFrame, n: int = 3, longest: int = 100) -> DataFrame:
    """The first ``n`` distinct non-empty values of at most ``longest`` characters."""
    each = value_counts(cell_rows.where((F.col("value") != "") & (F.length("value") <= longest)))
    w = Window.partitionBy(*KEY).orderBy("value")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*KEY, "value", "rank")


def text_domain(cell_rows: DataFrame, longest: int = 100) -> DataFrame:
    """Distinct values of text columns for a value index, without columns of only UUIDs or only numbers."""
    each = value_counts(cell_rows.where((F.col("value") != "") & (F.length("value") <= longest)))
    plain = each.groupBy(*KEY).agg((F.bool_and(F.col("value").rlike(UUID)) | F.bool_and(F.col("value").rlike(NUMBER))).alias("skip"))
    return each.join(F.broadcast(plain.where("not skip")), KEY, "left_semi").select(*KEY, "value")


def prefix_sample(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return df.orderBy(*order).limit(n)


def systematic_sample(df: DataFrame, key: str, rate: int) -> DataFrame:
    """Each row whose integer key is divisible by ``rate``."""
    return df.where(F.pmod(F.col(key), F.lit(rate)) == 0)


def random_values(cell_rows: DataFrame, n: int) -> DataFrame:
    """``n`` distinct values of each column in the order of their MD5 hashes, which repeats on every run."""
    each = value_counts(cell_rows.where("value is not null"))
    w = Window.partitionBy(*KEY).orderBy(F.md5("value"), "value")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*KEY, "value")


def usefulness(cell_rows: DataFrame, least: float = 0.1) -> DataFrame:
    """Share of values that are neither null nor '' nor 'null', and whether it reaches ``least``."""
    filled = F.when(F.coalesce(F.lower(F.trim("value")), F.lit("")).isin("", "null"), 0).otherwise(1)
    got = value_counts(cell_rows).groupBy(*KEY).agg((F.sum(filled * F.col("n")) / F.sum("n")).alias("r"))
    return got.select(*KEY, F.round("r", 6).alias("filled_share"), (F.col("r") >= least).alias("useful"))


def describe(profile: DataFrame) -> DataFrame:
    """A sentence on each column from its total, null and distinct counts and extrema."""
    text = F.concat_ws(
        " ", F.format_string("Column %s of %s has %d rows and %d distinct values.", "column_name", "table_name", "total_count", "distinct_count"),
        F.when(F.col("null_count") > 0, F.format_string("%d are null.", "null_count")),
        F.when(F.col("min_value").isNotNull(), F.format_string("It ranges from %s to %s.", "min_value", "max_value")),
    )
    return profile.select(*KEY, text.alias("description"))
