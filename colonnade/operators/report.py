"""Texts and reports made of tables: schema texts, samples as markdown, join texts, differences of two columns, drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.operators import profile, relate


def _ordered(items: Column, sep: str) -> Column:
    """The texts of structs (order, text) in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["text"]), sep)


def schema_text(columns: DataFrame, pks: DataFrame, fks: DataFrame) -> DataFrame:
    """(table_name, text): of each table its columns, keys first, and a line for each foreign key. columns have (table_name,
    column_name, ordinal, data_type)."""
    marked = columns.join(pks.select("table_name", "column_name", F.lit(True).alias("pk")), ["table_name", "column_name"], "left")
    line = F.concat(F.lit("  "), "column_name", F.lit(" "), F.upper("data_type"), F.when(F.col("pk"), " PRIMARY KEY").otherwise(""))
    body = marked.groupBy("table_name").agg(_ordered(F.struct(F.col("pk").isNull().alias("late"), F.col("ordinal").alias("o"), line.alias("text")), "\n").alias("body"))
    link = F.concat(F.lit("  "), F.concat_ws(".", "table_name", "column_name"), F.lit(" -> "), F.concat_ws(".", "target_table", "target_column"))
    ends = fks.groupBy("table_name").agg(_ordered(F.struct("fk_id", "seq", link.alias("text")), "\n").alias("links"))
    text = F.concat_ws("\n", F.concat(F.lit("Table "), "table_name"), "body", F.when(F.col("links").isNotNull(), F.lit("Foreign keys:")), "links")
    return body.join(ends, "table_name", "left").select("table_name", text.alias("text"))


def facets(columns: DataFrame) -> DataFrame:
    """(doc, facet, text) of columns (doc, table_name, column_name, description, examples): names with their words apart, the
    description, and the values."""
    words = lambda c: F.regexp_replace(c, r"[_\W]+|(?<=[a-z])(?=[A-Z])", " ")
    each = F.array(
        F.struct(F.lit("names").alias("facet"), F.concat_ws(" ", words(F.col("table_name")), words(F.col("column_name"))).alias("text")),
        F.struct(F.lit("description").alias("facet"), F.col("description").alias("text")),
        F.struct(F.lit("values").alias("facet"), F.concat_ws(", ", "examples").alias("text")),
    )
    return columns.select("doc", F.inline(each)).where("text is not null and text <> ''")


def markdown(df: DataFrame, order: list[str], rows: int = 5, columns: int = 8, width: int = 40) -> DataFrame:
    """(text): the first rows by ``order`` as a markdown table, further columns left out and long cells cut."""
    names = df.columns[:columns]
    cell = lambda c: F.coalesce(F.when(F.length(F.col(c).cast("string")) > width, F.concat(F.substring(F.col(c).cast("string"), 1, width), F.lit("..."))).otherwise(F.col(c).cast("string")), F.lit("NULL"))
    clean = lambda c: F.regexp_replace(F.regexp_replace(cell(c), r"\|", "/"), r"\s+", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[clean(c) for c in names]), F.lit(" |"))
    head = f"| {' | '.join(names)} |\n|{'---|' * len(names)}"
    body = df.orderBy(*order).limit(rows).select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], line.alias("text"))
    key = F.struct(*[F.col(f"_o{i}") for i in range(len(order))])
    text = body.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("o"), "text"))), lambda x: x["text"]), "\n").alias("t"))
    return text.select(F.concat_ws("\n", F.lit(head), F.nullif("t", F.lit(""))).alias("text"))


def key_sample(df: DataFrame, keys: list[str], rows: int = 5, others: int = 5) -> DataFrame:
    """The first whole rows by their keys: the key columns and then the first others."""
    rest = [c for c in df.columns if c not in keys][:others]
    return df.select(*keys, *rest).orderBy(*keys).limit(rows)


def join_text(fks: DataFrame) -> DataFrame:
    """(text): a line for each join between the tables, in order."""
    line = F.concat(F.concat_ws(".", "table_name", "column_name"), F.lit(" = "), F.concat_ws(".", "target_table", "target_column"))
    return fks.agg(_ordered(F.struct("fk_id", "seq", line.alias("text")), "\n").alias("text"))


def guidance_text(rows: DataFrame) -> DataFrame:
    """``rows`` with ``guidance`` from (column_a, column_b, topology, constraint_type, sensitivity), each null if not known."""
    kind = F.when(F.col("topology") == "mutually_exclusive", "they hold different values").when(F.col("topology").like("%subset%"), "one holds a part of the other's values").when(F.col("topology") == "overlapping", "their values overlap")
    text = F.concat_ws(
        " ", F.format_string("%s and %s are easily confused:", "column_a", "column_b"), F.concat(kind, F.lit(".")), F.concat(F.lit("Always "), "constraint_type", F.lit(".")),
        F.when(F.col("sensitivity") == "high", "The choice changes the result.").when(F.col("sensitivity") == "low", "The choice rarely changes the result.").when(F.col("sensitivity") == "context_dependent", "Whether the choice changes the result depends on the value."),
    )
    return rows.withColumn("guidance", text)


def difference(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """One row on joining two columns: uniqueness of both, fan-out, completeness, and the verdict with its advice."""
    cells = lambda d, c, t: d.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
    unique = lambda d, c, t: profile.key_uniqueness(cells(d, c, t)).select(F.col("is_unique").alias(f"{t}_unique"), F.col("duplication_rate").alias(f"{t}_duplication"))
    fan = relate.fanout(left, left_col, right, right_col).select("max_fanout", F.round("match_ratio", 6).alias("match_ratio"), "fanout_risk", "filter_risk", "mapping", "major_difference")
    gap = relate.completeness(left, left_col, right, right_col).select("missing_values", "missing_share", F.col("risk").alias("missing_risk"))
    row = unique(left, left_col, "left").crossJoin(unique(right, right_col, "right")).crossJoin(fan).crossJoin(gap)
    advice = F.when(~F.col("major_difference"), "any join").when((F.col("max_fanout") > 1) & (F.col("match_ratio") < 0.9), "left join after grouping the right side").when(F.col("max_fanout") > 1, "group the right side first").otherwise("left join")
    return row.withColumn("advice", advice)


def drill_down(df: DataFrame, column: str, value: object, by: str) -> DataFrame:
    """(group, rows, share): the rows with one value, by another column."""
    hit = df.where(F.col(column) == F.lit(value))
    total = hit.agg(F.count("*").alias("all"))
    return hit.groupBy(F.col(by).alias("group")).agg(F.count("*").alias("rows")).crossJoin(total).select("group", "rows", F.round(F.col("rows") / F.col("all"), 6).alias("share"))


def to_number(c: Column) -> Column:
    """A number written with a currency sign, thousands commas or a percent sign; null if it is none."""
    return F.regexp_replace(c.cast("string"), r"[$,%\s]", "").try_cast("double")


def sql_literal(value: Column, family: Column) -> Column:
    """A value as it is to stand in a query: a number as it is if the column is numeric and it reads as one, else in quotes."""
    return F.when((family == "number") & to_number(value).isNotNull(), F.regexp_replace(value, r"[$,%\s]", "")).otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))
