"""Relationships between columns: containment, similarity, cardinality, fan-out, one-to-one, constraints.

Comparisons of many columns start from the distinct (column, value) rows and join them on the value, so that only columns
that share a value ever meet. Values that very many columns share would make the join quadratic in the columns, not in the
rows; columns with few values are taken out before the join, as the rules for join keys do anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.operators.profile import KEY

# Name parts that mark a column as a category, a measurement, a description or a key.
TYPE_WORDS = ["type", "category", "class", "kind", "status", "state", "level", "grade", "rank", "tier", "option", "mode", "style"]
METRIC_WORDS = ["size", "count", "total", "amount", "quantity", "price", "cost", "rate", "percent", "ratio", "weight", "height", "width", "length", "sum", "avg", "min", "max", "mean", "median"]
TEXT_WORDS = ["desc", "description", "note", "comment", "text"]
KEY_WORDS = ["id", "code", "key", "ref", "uuid", "num", "number", "index"]
FLAG_STARTS = ["is", "has"]


def has_any(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike("|".join(words))


def starts_with(name: Column, words: list[str]) -> Column:
    return F.lower(name).rlike("^(" + "|".join(words) + ")")


def skip_reason(name_a: Column, name_b: Column, distinct_a: Column, distinct_b: Column) -> Column:
    """Why two columns are no join candidates, or null. The first rule that applies gives the reason."""
    kind = {w: (has_any(name_a, x), has_any(name_b, x)) for w, x in (("type", TYPE_WORDS), ("metric", METRIC_WORDS), ("key", KEY_WORDS), ("text", TEXT_WORDS))}
    flag = starts_with(name_a, FLAG_STARTS), starts_with(name_b, FLAG_STARTS)
    attribute = [flag[i] | kind["text"][i] | kind["type"][i] for i in (0, 1)]
    metric, key = kind["metric"], kind["key"]
    return (
        F.when((distinct_a <= 2) | (distinct_b <= 2), "boolean_or_binary")
        .when((distinct_a <= 5) | (distinct_b <= 5), "low_cardinality_attribute")
        .when(kind["type"][0] | kind["type"][1], "type_attribute_not_join_key")
        .when((metric[0] & key[1]) | (metric[1] & key[0]), "metric_to_id_mismatch")
        .when(metric[0] & metric[1] & (F.lower(name_a) != F.lower(name_b)), "both_are_metrics")
        .when(attribute[0] & attribute[1], "both_are_attributes")
        .when(attribute[0] | attribute[1], "attribute_column_not_join_key")
    )


def similarity_reason(name_a: Column, name_b: Column, distinct_a: Column, distinct_b: Column, same_semantic: Column, same_type: Column | None = None) -> Column:
    """Why two columns that are no join look alike; ``same_semantic`` is their common semantic type or null, ``same_type`` their
    common data type."""
    flags = F.lower(same_type) == "boolean" if same_type is not None else F.lit(False)
    return (
        F.when(distinct_a <= 2, "boolean_or_binary:a")
        .when(distinct_b <= 2, "boolean_or_binary:b")
        .when(distinct_a <= 5, F.concat(F.lit("low_cardinality:"), distinct_a, F.lit("_values")))
        .when(distinct_b <= 5, F.concat(F.lit("low_cardinality:"), distinct_b, F.lit("_values")))
        .when(flags, "same_boolean_flag")
        .when(same_semantic.isNotNull(), F.concat(F.lit("same_semantic_type:"), same_semantic))
        .when(has_any(name_a, TYPE_WORDS) | has_any(name_b, TYPE_WORDS), "type_attribute_not_join_key")
        .when(starts_with(name_a, [*FLAG_STARTS, "desc"]) | starts_with(name_b, [*FLAG_STARTS, "desc"]), "attribute_naming_pattern")
        .otherwise("value_overlap")
    )


def shared_features(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """A map of what the shapes of two columns have in common: lengths that are equal or at most 2 apart (0 counts as none), and
    equal prefix, suffix, data type and semantic type. ``a`` and ``b`` have min_length, max_length, fixed_prefix,
    fixed_suffix, data_type and semantic_type."""
    pairs = []
    for c in ("min_length", "max_length"):
        both = (a[c] > 0) & (b[c] > 0)
        pairs.append(F.when(both & (a[c] == b[c]), F.struct(F.lit(f"same_{c}").alias("k"), a[c].cast("string").alias("v"))))
        near = F.concat_ws(" vs ", a[c].cast("string"), b[c].cast("string"))
        pairs.append(F.when(both & (a[c] != b[c]) & (F.abs(a[c] - b[c]) <= 2), F.struct(F.lit(f"similar_{c}").alias("k"), near.alias("v"))))
    for c, name in (("fixed_prefix", "shared_prefix"), ("fixed_suffix", "shared_suffix"), ("data_type", "same_data_type"), ("semantic_type", "same_semantic_type")):
        pairs.append(F.when((a[c] == b[c]) & (a[c] != ""), F.struct(F.lit(name).alias("k"), a[c].alias("v"))))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def completeness(left: DataFrame, left_col: str, right: DataFrame, right_col: str, samples: int = 20) -> DataFrame:
    """One row: the left column's distinct values, those that the right one lacks, their share, the first of them, the nulls of
    the right column, and the risk: none for a share of 0, low up to 0.05, medium up to 0.2, else high."""
    a = left.where(F.col(left_col).isNotNull()).select(F.col(left_col).alias("value")).distinct()
    b = right.where(F.col(right_col).isNotNull()).select(F.col(right_col).alias("value")).distinct().withColumn("hit", F.lit(1))
    n = a.join(b, "value", "left").agg(F.count("*").alias("left_values"), F.count(F.when(F.col("hit").isNull(), 1)).alias("missing_values"))
    first = missing_values(left, left_col, right, right_col).orderBy("value").limit(samples).agg(F.array_sort(F.collect_list(F.col("value").cast("string"))).alias("samples"))
    nulls = right.agg(F.count(F.when(F.col(right_col).isNull(), 1)).alias("right_nulls"))
    share = F.when(F.col("left_values") > 0, F.col("missing_values") / F.col("left_values")).otherwise(0.0)
    risk = F.when(share == 0, "none").when(share <= 0.05, "low").when(share <= 0.2, "medium").otherwise("high")
    return n.crossJoin(first).crossJoin(nulls).select("left_values", "missing_values", F.round(share, 6).alias("missing_share"), "samples", "right_nulls", risk.alias("risk"))


def names_similar(name_a: Column, name_b: Column) -> Column:
    """Both id-like or both code-like; name-like columns never are."""
    ids, codes = ["id", "identifier", "key"], ["code", "cd"]
    return (has_any(name_a, ids) & has_any(name_b, ids)) | (has_any(name_a, codes) & has_any(name_b, codes))


def distinct_values(cell_rows: DataFrame, normalise: bool = False) -> DataFrame:
    """(table_name, column_name, value) without repeats and nulls; trimmed, lower-cased and non-empty if ``normalise``."""
    rows = cell_rows.where("value is not null")
    if normalise:
        rows = rows.withColumn("value", F.lower(F.trim("value"))).where("value <> ''")
    return rows.select(*KEY, "value").distinct()


def overlaps(values: DataFrame, families: DataFrame | None = None, min_distinct: int = 0, same_table: bool = False) -> DataFrame:
    """(table_a, column_a, table_b, column_b, n_a, n_b, n_common) of columns with a common value, a before b.

    ``families`` (table_name, column_name, family) keeps columns of different type families apart.
    """
    sizes = values.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > min_distinct)
    if families is not None:
        sizes = sizes.join(F.broadcast(families), KEY)
    else:
        sizes = sizes.withColumn("family", F.lit("any"))
    sized = values.join(sizes, KEY).select(F.struct(*KEY).alias("c"), "n", "family", "value")
    a = sized.select(F.col("c").alias("ca"), F.col("n").alias("n_a"), "family", "value")
    b = sized.select(F.col("c").alias("cb"), F.col("n").alias("n_b"), "family", "value")
    order = F.col("ca") < F.col("cb")
    if not same_table:
        order = order & (F.col("ca.table_name") != F.col("cb.table_name"))
    got = a.join(b, ["value", "family"]).where(order).groupBy("ca", "cb", "n_a", "n_b").agg(F.count("*").alias("n_common"))
    return got.select(
        F.col("ca.table_name").alias("table_a"), F.col("ca.column_name").alias("column_a"), F.col("cb.table_name").alias("table_b"), F.col("cb.column_name").alias("column_b"),
        "n_a", "n_b", "n_common",
    )


def containment() -> Column:
    return F.col("n_common") / F.least("n_a", "n_b")


def jaccard() -> Column:
    return F.col("n_common") / (F.col("n_a") + F.col("n_b") - F.col("n_common"))


def verified_joins(pairs: DataFrame, uniqueness: DataFrame, inclusion: float = 0.95, strip: str = r"^[a-z]_") -> DataFrame:
    """Directed join paths among overlapping columns: enough of the source's values are in the target, the target is unique,
    and the names agree without the table's prefix (``strip``)."""
    one = pairs.select("table_a", "column_a", "table_b", "column_b", "n_a", "n_common")
    two = pairs.select(F.col("table_b").alias("table_a"), F.col("column_b").alias("column_a"), F.col("table_a").alias("table_b"), F.col("column_a").alias("column_b"), F.col("n_b").alias("n_a"), "n_common")
    unique = uniqueness.where("is_unique").select(F.col("table_name").alias("table_b"), F.col("column_name").alias("column_b"))
    both = one.union(two).where((F.col("n_common") / F.col("n_a") >= inclusion) & (F.regexp_replace("column_a", strip, "") == F.regexp_replace("column_b", strip, "")))
    both = both.join(F.broadcast(unique), ["table_b", "column_b"], "left_semi")
    return both.select(
        F.col("table_a").alias("source_table"), F.col("column_a").alias("source_column"), F.col("table_b").alias("target_table"), F.col("column_b").alias("target_column"),
        (F.col("n_common") / F.col("n_a")).alias("inclusion"), "n_common",
    )


def topology_class() -> Column:
    """Of two value sets by their containments and similarity; equal sets count as A in B."""
    a, b = F.col("n_common") / F.col("n_a"), F.col("n_common") / F.col("n_b")
    return F.when(a > 0.95, "A_subset_of_B").when(b > 0.95, "B_subset_of_A").when(jaccard() < 0.1, "mutually_exclusive").otherwise("overlapping")


def set_topology(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row on two value sets (value), trimmed and lower-cased: sizes, containments, similarity and class."""
    clean = lambda d: d.select(F.lower(F.trim(F.col("value").cast("string"))).alias("value")).where("value <> ''").distinct()
    both = clean(left).withColumn("a", F.lit(1)).join(clean(right).withColumn("b", F.lit(1)), "value", "full")
    n = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n_common"))
    return n.select("n_a", "n_b", "n_common", (F.col("n_common") / F.col("n_a")).alias("a_in_b"), (F.col("n_common") / F.col("n_b")).alias("b_in_a"), jaccard().alias("jaccard"), topology_class().alias("topology"))


def cardinality(source: DataFrame, source_cols: list[str], target: DataFrame, target_cols: list[str]) -> DataFrame:
    """One row on an equi-join: matched distinct keys, the most partners of a key on either side, and the cardinality.

    Both sides are grouped by key before they meet, so a hot key is one row. Null keys match nothing. Lookup: a target of
    fewer than 100 rows with fewer than 50 matched keys.
    """
    key = [f"k{i}" for i in range(len(source_cols))]
    s = source.groupBy(*[F.col(c).alias(k) for c, k in zip(source_cols, key)]).agg(F.count("*").alias("s"))
    t = target.groupBy(*[F.col(c).alias(k) for c, k in zip(target_cols, key)]).agg(F.count("*").alias("t"))
    got = s.join(t, key).agg(F.count("*").alias("matched"), F.coalesce(F.max("s"), F.lit(0)).alias("max_source"), F.coalesce(F.max("t"), F.lit(0)).alias("max_target"))
    rows = target.agg(F.count("*").alias("target_rows"))
    return got.crossJoin(rows).withColumn(
        "cardinality",
        F.when(F.col("matched") == 0, "none")
        .when((F.col("target_rows") < 100) & (F.col("matched") < 50), "Lookup")
        .when((F.col("max_source") <= 1) & (F.col("max_target") <= 1), "1:1")
        .when((F.col("max_source") > 1) & (F.col("max_target") > 1), "N:M")
        .when(F.col("max_target") > 1, "1:N")
        .otherwise("N:1"),
    )


def fanout(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """One row on a left join by value: fan-out per distinct left value (left times right rows), match ratio, estimated rows,
    mapping type and risks."""
    a = left.where(F.col(left_col).isNotNull()).groupBy(F.col(left_col).alias("k")).agg(F.count("*").alias("l"))
    b = right.where(F.col(right_col).isNotNull()).groupBy(F.col(right_col).alias("k")).agg(F.count("*").alias("r"))
    per = a.join(b, "k", "left").select("l", F.coalesce("r", F.lit(0)).alias("r"), (F.col("l") * F.coalesce("r", F.lit(0))).alias("f"))
    n = per.agg(
        F.count("*").alias("left_values"), F.count(F.when(F.col("f") > 0, 1)).alias("matched_values"), F.coalesce(F.max("f"), F.lit(0)).alias("max_fanout"),
        F.avg("f").alias("avg_fanout"), F.coalesce(F.max("r"), F.lit(0)).alias("right_multiplicity"), F.sum("f").alias("estimated_rows"),
    )
    ratio = F.when(F.col("left_values") > 0, F.col("matched_values") / F.col("left_values")).otherwise(0.0)
    return n.select(
        "*", ratio.alias("match_ratio"),
        F.when(F.col("max_fanout") <= 1, "low").when(F.col("max_fanout") <= 5, "medium").otherwise("high").alias("fanout_risk"),
        F.when(ratio >= 0.95, "low").when(ratio >= 0.8, "medium").otherwise("high").alias("filter_risk"),
        F.when(F.col("matched_values") == 0, "none").when(F.col("max_fanout") <= 1, "one_to_one").otherwise("one_to_many").alias("mapping"),
        ((F.col("max_fanout") > 1) | (ratio < 0.9)).alias("major_difference"),
    )


def missing_values(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """(value): distinct values of the left column that the right one lacks."""
    return left.where(F.col(left_col).isNotNull()).select(F.col(left_col).alias("value")).distinct().join(right.select(F.col(right_col).alias("value")), "value", "left_anti")


def common_values(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    a = left.where(F.col(left_col).isNotNull()).select(F.col(left_col).alias("value"))
    return a.intersect(right.select(F.col(right_col).alias("value")))


def one_to_one(rows: DataFrame, a: str, b: str, tolerance: float = 0.05) -> DataFrame:
    """One row: distinct a, b and (a, b) over rows with both, and whether the columns map one to one within the tolerance."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    n = pairs.agg(F.countDistinct("a").alias("n_a"), F.countDistinct("b").alias("n_b"), F.count("*").alias("n_ab"))
    near = lambda c: F.abs(1 - F.col("n_ab") / F.col(c)) <= tolerance
    return n.withColumn("one_to_one", (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & near("n_a") & near("n_b"))


def constraint(rows: DataFrame, a: str, b: str, most: float = 0.05, least_rows: int = 10) -> DataFrame:
    """One row: the order constraint between two numeric columns that fewer than ``most`` of the rows break, ``A <= B`` tested
    first, and whether the columns are equal throughout."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = rows.where(x.isNotNull() & y.isNotNull())
    n = both.agg(F.count("*").alias("n"), F.avg((x > y).cast("int")).alias("above"), F.avg((x < y).cast("int")).alias("below"), F.avg((x != y).cast("int")).alias("unequal"))
    kind = F.when(F.col("n") < least_rows, None).when(F.col("above") < most, "A <= B").when(F.col("below") < most, "A >= B").when(F.col("unequal") < most, "A == B")
    return n.select("n", kind.alias("constraint_type"), (F.col("unequal") == 0).alias("is_equal"))


def result_sensitivity(rows: DataFrame, key: str, a: str, b: str, values: int = 10, least: int = 5) -> DataFrame:
    """Whether filtering by a or by b selects the same rows of one table, over the first common values.

    One row: common values used, their mean similarity of selected rows, and high, low, context_dependent or insufficient.
    """
    one = rows.where(F.col(a).isNotNull()).select(F.col(key).alias("k"), F.col(a).cast("string").alias("v"))
    two = rows.where(F.col(b).isNotNull()).select(F.col(key).alias("k"), F.col(b).cast("string").alias("v"))
    common = one.select("v").intersect(two.select("v")).orderBy("v").limit(values)
    x = one.join(F.broadcast(common), "v").withColumn("x", F.lit(1))
    y = two.join(F.broadcast(common), "v").withColumn("y", F.lit(1))
    per = x.join(y, ["v", "k"], "full").groupBy("v").agg((F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)) / F.count("*")).alias("j"))
    n = per.agg(F.count("*").alias("common_values"), F.avg("j").alias("m"))
    kind = F.when(F.col("common_values") < least, "insufficient").when(F.col("m") > 0.9, "low").when(F.col("m") < 0.1, "high").otherwise("context_dependent")
    return n.select("common_values", F.round("m", 6).alias("mean_jaccard"), kind.alias("sensitivity"))
