"""Relationship queries over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators import catalog, profile, relate
from colonnade.plans.profile_queries import CELLS, FAMILY_SQL, TEXTS, TEXT_COLUMNS, cells, load
from colonnade.plans.scratch import Scratch
from colonnade.plans.registry import query
from colonnade.sources.tables import table

SIZED = f"""d as (select distinct table_name, column_name, {{value}} as value from {CELLS} where value is not null {{where}}),
  n as (select table_name, column_name, {FAMILY_SQL} as family, count(*) as n from d group by all),
  o as (select a.table_name as table_a, a.column_name as column_a, b.table_name as table_b, b.column_name as column_b, x.n as n_a, y.n as n_b, count(*) as n_common
    from d a join d b on a.value = b.value and (a.table_name, a.column_name) < (b.table_name, b.column_name)
    join n x on x.table_name = a.table_name and x.column_name = a.column_name join n y on y.table_name = b.table_name and y.column_name = b.column_name
    where x.family = y.family {{pairs}} group by all)"""
RAW = SIZED.format(value="value", where="", pairs="and a.table_name <> b.table_name and x.n > 5 and y.n > 5")
NORMAL = SIZED.format(value="lower(trim(value))", where="and trim(value) <> ''", pairs="and x.n > 5 and y.n > 5")


def families(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.columns_frame(spark, load(spark, directory)).select("table_name", "column_name", "family")


def key_overlaps(spark: SparkSession, directory: str) -> DataFrame:
    """Overlaps of columns of different tables with more than five values."""
    return relate.overlaps(relate.distinct_values(cells(spark, directory)), families(spark, directory), 5)


@query(f"with {RAW} select table_a, column_a, table_b, column_b, n_common, round(n_common / least(n_a, n_b), 6) as containment from o where n_common / least(n_a, n_b) >= 0.6")
def value_containment(spark: SparkSession, directory: str) -> DataFrame:
    got = key_overlaps(spark, directory).withColumn("containment", relate.containment()).where("containment >= 0.6")
    return got.select("table_a", "column_a", "table_b", "column_b", "n_common", F.round("containment", 6).alias("containment"))


@query(f"""with {RAW},
  u as (select table_name, column_name from {CELLS} group by all having count(value) = count(distinct value)),
  p as (select table_a, column_a, table_b, column_b, n_a, n_common from o union all select table_b, column_b, table_a, column_a, n_b, n_common from o)
  select table_a as source_table, column_a as source_column, table_b as target_table, column_b as target_column, round(n_common / n_a, 6) as inclusion, n_common
  from p join u on u.table_name = table_b and u.column_name = column_b where n_common / n_a >= 0.95 and column_a[3:] = column_b[3:]""")
def verified_join_paths(spark: SparkSession, directory: str) -> DataFrame:
    rows = Scratch(spark).keep(cells(spark, directory), "cells")  # counted once, read for overlaps and for uniqueness
    overlaps = relate.overlaps(relate.distinct_values(rows), families(spark, directory), 5)
    got = relate.verified_joins(overlaps, profile.key_uniqueness(rows))
    return got.withColumn("inclusion", F.round("inclusion", 6))


@query(f"with {NORMAL} select table_a, column_a, table_b, column_b, round(n_common / (n_a + n_b - n_common), 6) as jaccard from o where n_common / (n_a + n_b - n_common) >= 0.6")
def value_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    values = relate.distinct_values(cells(spark, directory), normalise=True)
    got = relate.overlaps(values, families(spark, directory), 5, same_table=True).withColumn("jaccard", relate.jaccard()).where("jaccard >= 0.6")
    return got.select("table_a", "column_a", "table_b", "column_b", F.round("jaccard", 6).alias("jaccard"))


def _like(words, c):
    return f"regexp_matches(lower({c}), '{'|'.join(words)}')"


def _starts(words, c):
    return f"regexp_matches(lower({c}), '^({'|'.join(words)})')"


_ATTR = {c: f"({_starts(relate.FLAG_STARTS, c)} or {_like(relate.TEXT_WORDS, c)} or {_like(relate.TYPE_WORDS, c)})" for c in ("a.column_name", "b.column_name")}
A, B = "a.column_name", "b.column_name"


@query(f"""with n as (select table_name, column_name, count(distinct value) as n from {CELLS} group by all)
  select a.table_name as table_a, a.column_name as column_a, b.table_name as table_b, b.column_name as column_b, case
    when a.n <= 2 or b.n <= 2 then 'boolean_or_binary' when a.n <= 5 or b.n <= 5 then 'low_cardinality_attribute'
    when {_like(relate.TYPE_WORDS, A)} or {_like(relate.TYPE_WORDS, B)} then 'type_attribute_not_join_key'
    when ({_like(relate.METRIC_WORDS, A)} and {_like(relate.KEY_WORDS, B)}) or ({_like(relate.METRIC_WORDS, B)} and {_like(relate.KEY_WORDS, A)}) then 'metric_to_id_mismatch'
    when {_like(relate.METRIC_WORDS, A)} and {_like(relate.METRIC_WORDS, B)} and lower({A}) <> lower({B}) then 'both_are_metrics'
    when {_ATTR[A]} and {_ATTR[B]} then 'both_are_attributes' when {_ATTR[A]} or {_ATTR[B]} then 'attribute_column_not_join_key' end as reason
  from n a join n b on a.table_name < b.table_name""")
def join_skip_reason(spark: SparkSession, directory: str) -> DataFrame:
    """The rule that rules each pair of columns out; the frame of all columns is small whatever the tables hold."""
    stats = profile.column_stats(cells(spark, directory))
    a = stats.select(F.col("table_name").alias("table_a"), F.col("column_name").alias("column_a"), F.col("distinct_count").alias("a"))
    b = stats.select(F.col("table_name").alias("table_b"), F.col("column_name").alias("column_b"), F.col("distinct_count").alias("b"))
    pairs = a.join(b, F.col("table_a") < F.col("table_b"))
    reason = relate.skip_reason(F.col("column_a"), F.col("column_b"), F.col("a"), F.col("b"))
    return pairs.select("table_a", "column_a", "table_b", "column_b", reason.alias("reason"))


@query(f"""with n as (select table_name, column_name, {FAMILY_SQL} as family, count(*) as t, count(distinct value) as n from {CELLS} group by all),
  s as (select *, case when family = 'time' then 'Datetime' when family = 'number' then case when n <= 20 then 'Categorical' when n / t > 0.95 then 'Identifier' else 'Numerical' end
    when n <= 100 and n / t < 0.6 then 'Categorical' when n / t > 0.95 then 'Identifier' else 'Free_Text' end as sem from n)
  select a.table_name as table_a, a.column_name as column_a, b.table_name as table_b, b.column_name as column_b, case
    when a.n <= 2 then 'boolean_or_binary:a' when b.n <= 2 then 'boolean_or_binary:b' when a.n <= 5 then 'low_cardinality:' || a.n || '_values' when b.n <= 5 then 'low_cardinality:' || b.n || '_values'
    when a.sem = b.sem then 'same_semantic_type:' || a.sem when {_like(relate.TYPE_WORDS, A)} or {_like(relate.TYPE_WORDS, B)} then 'type_attribute_not_join_key'
    when {_starts(["is", "has", "desc"], A)} or {_starts(["is", "has", "desc"], B)} then 'attribute_naming_pattern' else 'value_overlap' end as reason,
    (regexp_matches({A}, 'id|identifier|key') and regexp_matches({B}, 'id|identifier|key')) or (regexp_matches({A}, 'code|cd') and regexp_matches({B}, 'code|cd')) as names_similar
  from s a join s b on a.table_name < b.table_name""")
def similarity_reason(spark: SparkSession, directory: str) -> DataFrame:
    stats = profile.column_stats(cells(spark, directory)).join(families(spark, directory), ["table_name", "column_name"])
    semantic = profile.semantic_type(F.col("family"), F.col("distinct_count"), F.col("total_count") + F.col("null_count"))
    stats = stats.withColumn("sem", semantic)
    a, b = (stats.select(F.col("table_name").alias(f"table_{x}"), F.col("column_name").alias(f"column_{x}"), F.col("distinct_count").alias(x), F.col("sem").alias(f"sem_{x}")) for x in "ab")
    same = F.when(F.col("sem_a") == F.col("sem_b"), F.col("sem_a"))
    names = F.col("column_a"), F.col("column_b")
    reason = relate.similarity_reason(*names, F.col("a"), F.col("b"), same)
    return a.join(b, F.col("table_a") < F.col("table_b")).select("table_a", "column_a", "table_b", "column_b", reason.alias("reason"), relate.names_similar(*names).alias("names_similar"))


_LCP = "(select max(i) from range(0, 200) r(i) where i <= least(length({0}), length({1})) and {0}[1:i] = {1}[1:i])"
SHAPES = f"""d as (select distinct table_name, column_name, value from {CELLS} where value is not null),
  n as (select table_name, column_name, {FAMILY_SQL} as family, count(*) as t, count(distinct value) as n from {CELLS} group by all),
  l as (select table_name, column_name, min(length(value)) as lo, max(length(value)) as hi from d group by all),
  e as (select table_name, column_name, min(value) as a, max(value) as b, min(reverse(value)) as ra, max(reverse(value)) as rb from (select * from d where value <> '' and (table_name, column_name) in (select table_name, column_name from {TEXTS})) group by all having count(*) >= 2),
  x as (select *, {_LCP.format('a', 'b')} as p, {_LCP.format('ra', 'rb')} as q from e),
  sh as (select n.table_name, n.column_name, lo, hi, case when p >= 3 then a[1:p] end as pre, case when q >= 3 then reverse(ra[1:q]) end as suf, family,
    case when family = 'time' then 'Datetime' when family = 'number' then case when n <= 20 then 'Categorical' when n / t > 0.95 then 'Identifier' else 'Numerical' end
      when n <= 100 and n / t < 0.6 then 'Categorical' when n / t > 0.95 then 'Identifier' else 'Free_Text' end as sem
    from n join l using (table_name, column_name) left join x using (table_name, column_name))"""


@query(f"""with {SHAPES} select a.table_name as table_a, a.column_name as column_a, b.table_name as table_b, b.column_name as column_b, concat_ws(';',
    case when a.lo = 0 or b.lo = 0 then null when a.lo = b.lo then 'same_min_length=' || a.lo when abs(a.lo - b.lo) <= 2 then 'similar_min_length=' || a.lo || ' vs ' || b.lo end,
    case when a.hi = 0 or b.hi = 0 then null when a.hi = b.hi then 'same_max_length=' || a.hi when abs(a.hi - b.hi) <= 2 then 'similar_max_length=' || a.hi || ' vs ' || b.hi end,
    case when a.pre = b.pre then 'shared_prefix=' || a.pre end, case when a.suf = b.suf then 'shared_suffix=' || a.suf end, case when a.family = b.family then 'same_data_type=' || a.family end,
    case when a.sem = b.sem then 'same_semantic_type=' || a.sem end) as features from sh a join sh b on a.table_name < b.table_name""")
def shared_shape_features(spark: SparkSession, directory: str) -> DataFrame:
    """What the shapes of two columns have in common; the frame of all columns is small whatever the tables hold."""
    rows = Scratch(spark).keep(cells(spark, directory), "cells")
    stats = profile.column_stats(rows).join(families(spark, directory), ["table_name", "column_name"])
    semantic = profile.semantic_type(F.col("family"), F.col("distinct_count"), F.col("total_count") + F.col("null_count"))
    texts = stats.where("family = 'text'").select("table_name", "column_name")
    fixed = profile.fixity(rows.join(texts, ["table_name", "column_name"], "left_semi"))
    shapes = stats.select("table_name", "column_name", F.col("family").alias("data_type"), semantic.alias("semantic_type"))
    shapes = shapes.join(profile.length_stats(rows), ["table_name", "column_name"]).join(fixed, ["table_name", "column_name"], "left")
    kinds = ("min_length", "max_length", "fixed_prefix", "fixed_suffix", "data_type", "semantic_type")
    a, b = (shapes.select(F.col("table_name").alias(f"table_{x}"), F.col("column_name").alias(f"column_{x}"), *[F.col(k).alias(f"{k}_{x}") for k in kinds]) for x in "ab")
    both = a.join(b, F.col("table_a") < F.col("table_b"))
    features = relate.shared_features(*({k: F.col(f"{k}_{x}") for k in kinds} for x in "ab"))
    text = F.array_join(F.transform(F.map_entries(features), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return both.select("table_a", "column_a", "table_b", "column_b", text.alias("features"))


def _cardinality_sql(s, sc, t, tc):
    return f"""select '{s}' as source_table, '{sc}' as source_column, '{t}' as target_table, matched, max_source, max_target, target_rows,
      case when matched = 0 then 'none' when target_rows < 100 and matched < 50 then 'Lookup' when max_source <= 1 and max_target <= 1 then '1:1' when max_source > 1 and max_target > 1 then 'N:M' when max_target > 1 then '1:N' else 'N:1' end as cardinality
      from (select count(*) as matched, coalesce(max(a), 0) as max_source, coalesce(max(b), 0) as max_target from (select {sc} as k, count(*) as a from {s} group by all) x join (select {tc} as k, count(*) as b from {t} group by all) y using (k)),
      (select count(*) as target_rows from {t})"""


@query(" union all ".join(_cardinality_sql(s, sc[0], t, tc[0]) for s, sc, t, tc in catalog.FOREIGN_KEYS))
def fk_cardinality(spark: SparkSession, directory: str) -> DataFrame:
    tables = load(spark, directory)
    each = [
        relate.cardinality(tables[s], sc, tables[t], tc).select(
            F.lit(s).alias("source_table"), F.lit(sc[0]).alias("source_column"), F.lit(t).alias("target_table"), "matched", "max_source", "max_target", "target_rows", "cardinality"
        )
        for s, sc, t, tc in catalog.FOREIGN_KEYS
    ]
    return reduce(DataFrame.union, each)


@query("""with a as (select c_custkey as k, count(*) as l from customer where c_custkey is not null group by all), b as (select user_id as k, count(*) as r from events where user_id is not null group by all),
  p as (select l, coalesce(r, 0) as r, l * coalesce(r, 0) as f from a left join b using (k)),
  n as (select count(*) as left_values, count(*) filter (f > 0) as matched_values, max(f) as max_fanout, avg(f) as avg_fanout, max(r) as right_multiplicity, sum(f)::bigint as estimated_rows from p)
  select left_values, matched_values, max_fanout, round(avg_fanout, 6) as avg_fanout, right_multiplicity, estimated_rows, round(matched_values / left_values, 6) as match_ratio,
    case when max_fanout <= 1 then 'low' when max_fanout <= 5 then 'medium' else 'high' end as fanout_risk, case when matched_values / left_values >= 0.95 then 'low' when matched_values / left_values >= 0.8 then 'medium' else 'high' end as filter_risk,
    case when matched_values = 0 then 'none' when max_fanout <= 1 then 'one_to_one' else 'one_to_many' end as mapping, max_fanout > 1 or matched_values / left_values < 0.9 as major_difference from n""")
def join_fanout(spark: SparkSession, directory: str) -> DataFrame:
    got = relate.fanout(table(spark, directory, "customer"), "c_custkey", table(spark, directory, "events"), "user_id")
    return got.withColumns({"avg_fanout": F.round("avg_fanout", 6), "match_ratio": F.round("match_ratio", 6)})


@query("select distinct o_orderkey as value from orders where o_orderkey not in (select c_custkey from customer where c_custkey is not null)")
def completeness_missing(spark: SparkSession, directory: str) -> DataFrame:
    return relate.missing_values(table(spark, directory, "orders"), "o_orderkey", table(spark, directory, "customer"), "c_custkey")


@query("""with a as (select distinct o_orderkey as v from orders where o_orderkey is not null), m as (select v from a where v not in (select user_id from events where user_id is not null))
  select n as left_values, k as missing_values, round(k / n, 6) as missing_share, (select string_agg(v::varchar, ',' order by v::varchar) from (select v from m order by v limit 20)) as samples, nulls as right_nulls,
    case when k = 0 then 'none' when k / n <= 0.05 then 'low' when k / n <= 0.2 then 'medium' else 'high' end as risk
  from (select (select count(*) from a) as n, (select count(*) from m) as k, (select count(*) from events where user_id is null) as nulls)""")
def completeness(spark: SparkSession, directory: str) -> DataFrame:
    got = relate.completeness(table(spark, directory, "orders"), "o_orderkey", table(spark, directory, "events"), "user_id")
    return got.withColumn("samples", F.array_join("samples", ","))


@query("select user_id as value from events where user_id is not null intersect select o_custkey from orders")
def common_values(spark: SparkSession, directory: str) -> DataFrame:
    return relate.common_values(table(spark, directory, "events"), "user_id", table(spark, directory, "orders"), "o_custkey")


def _one_sql(rows, a, b, name):
    return f"""select '{name}' as pair, n_a, n_b, n_ab, n_a >= 2 and n_b >= 2 and abs(1 - n_ab / n_a) <= 0.05 and abs(1 - n_ab / n_b) <= 0.05 as one_to_one from
      (select count(distinct a) as n_a, count(distinct b) as n_b, count(*) as n_ab from (select distinct {a} as a, {b} as b from {rows} where {a} is not null and {b} is not null))"""


@query(_one_sql("customer", "c_custkey", "c_name", "customer key and name") + " union all " + _one_sql("part", "p_brand", "p_type", "part brand and type"))
def one_to_one_same_table(spark: SparkSession, directory: str) -> DataFrame:
    c = relate.one_to_one(table(spark, directory, "customer"), "c_custkey", "c_name").select(F.lit("customer key and name").alias("pair"), "*")
    return c.union(relate.one_to_one(table(spark, directory, "part"), "p_brand", "p_type").select(F.lit("part brand and type"), "*"))


@query(_one_sql("customer join nation on c_nationkey = n_nationkey", "c_nationkey", "n_name", "customer nation and its name"))
def one_to_one_fk_join(spark: SparkSession, directory: str) -> DataFrame:
    joined = table(spark, directory, "customer").select("c_nationkey").join(table(spark, directory, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return relate.one_to_one(joined, "c_nationkey", "n_name").select(F.lit("customer nation and its name").alias("pair"), "*")


CONSTRAINTS = [("lineitem", "l_discount", "l_quantity"), ("lineitem", "l_quantity", "l_extendedprice"), ("lineitem", "l_quantity", "l_quantity"), ("part", "p_retailprice", "p_size"), ("lineitem", "l_suppkey", "l_linenumber")]


@query(" union all ".join(
    f"""select '{t}' as table_name, '{a}' as column_a, '{b}' as column_b, n, case when n < 10 then null when x < 0.05 then 'A <= B' when y < 0.05 then 'A >= B' when z < 0.05 then 'A == B' end as constraint_type, z = 0 as is_equal
    from (select count(*) as n, avg(({a} > {b})::int) as x, avg(({a} < {b})::int) as y, avg(({a} <> {b})::int) as z from {t} where {a} is not null and {b} is not null)""" for t, a, b in CONSTRAINTS))
def logical_constraints(spark: SparkSession, directory: str) -> DataFrame:
    each = [relate.constraint(table(spark, directory, t), a, b).select(F.lit(t).alias("table_name"), F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), "n", "constraint_type", "is_equal") for t, a, b in CONSTRAINTS]
    return reduce(DataFrame.union, each)


@query("""with a as (select distinct lower(trim(user_id::varchar)) as v from events where user_id is not null), b as (select distinct lower(trim(c_custkey::varchar)) as v from customer where c_custkey is not null),
  n as (select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from a join b using (v)) as n_common)
  select n_a, n_b, n_common, round(n_common / n_a, 6) as a_in_b, round(n_common / n_b, 6) as b_in_a, round(n_common / (n_a + n_b - n_common), 6) as jaccard,
    case when n_common / n_a > 0.95 then 'A_subset_of_B' when n_common / n_b > 0.95 then 'B_subset_of_A' when n_common / (n_a + n_b - n_common) < 0.1 then 'mutually_exclusive' else 'overlapping' end as topology from n""")
def set_topology(spark: SparkSession, directory: str) -> DataFrame:
    got = relate.set_topology(table(spark, directory, "events").selectExpr("user_id as value"), table(spark, directory, "customer").selectExpr("c_custkey as value"))
    return got.withColumns({c: F.round(c, 6) for c in ("a_in_b", "b_in_a", "jaccard")})


@query("""with a as (select o_orderkey as k, o_orderkey::varchar as v from orders), b as (select o_orderkey as k, o_custkey::varchar as v from orders where o_custkey is not null),
  c as (select v from a intersect select v from b order by v limit 10), x as (select a.* from a join c using (v)), y as (select b.* from b join c using (v)),
  p as (select v, count(*) filter (x.k is not null and y.k is not null) / count(*) as j from x full join y using (v, k) group by v)
  select count(*) as common_values, round(avg(j), 6) as mean_jaccard, case when count(*) < 5 then 'insufficient' when avg(j) > 0.9 then 'low' when avg(j) < 0.1 then 'high' else 'context_dependent' end as sensitivity from p""")
def result_sensitivity(spark: SparkSession, directory: str) -> DataFrame:
    return relate.result_sensitivity(table(spark, directory, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_orderkey", "o_custkey")
