"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators.quality import load_findings, load_values, profile_files, write_clustered
from colonnade.plans.registry import query
from colonnade.plans.scratch import Scratch
from colonnade.sources.tables import table

FINDINGS = """
with once as (select column_id, load_no, row_no, min(value) as value from cell_value group by all),
counts as (select column_id, load_no, value, count(*) as n from once group by all),
stats as (select column_id, load_no, sum(n) as rows, coalesce(sum(n) filter (value is null), 0) as nulls, count(value) as dist from counts group by all),
loads as (select p.*, coalesce(s.rows, 0) as rows, coalesce(s.nulls, 0) as nulls, coalesce(s.dist, 0) as dist from column_profile p left join stats s using (column_id, load_no)),
steps as (select *, lag(load_no) over w as load0, lag(rows) over w as rows0, lag(nulls) over w as nulls0, lag(dist) over w as dist0 from loads window w as (partition by column_id order by load_no)),
few as (select * from steps where rows > 0 and rows0 > 0 and dist between 1 and 12 and dist0 between 1 and 12),
sides as (
  select f.column_id, f.load_no, c.value, c.n * (f.rows0 - f.nulls0) as now, 0 as was, (f.rows - f.nulls) * (f.rows0 - f.nulls0) as whole
  from few f join counts c on c.column_id = f.column_id and c.load_no = f.load_no where c.value is not null
  union all
  select f.column_id, f.load_no, c.value, 0, c.n * (f.rows - f.nulls), (f.rows - f.nulls) * (f.rows0 - f.nulls0)
  from few f join counts c on c.column_id = f.column_id and c.load_no = f.load0 where c.value is not null),
moved as (
  select column_id, load_no from (select column_id, load_no, value, whole, abs(sum(now) - sum(was)) as d from sides group by all) t
  group by column_id, load_no, whole having sum(d) * 10 >= 9 * whole),
tested as (
  select p.column_id, p.load_no, p.data_format, c.value, p.min_value, p.max_value,
    case when p.data_format = 'INT' then regexp_full_match(c.value, '-?[0-9]+')
         else regexp_full_match(c.value, replace(replace(regexp_escape(p.data_format), '9', '[0-9]'), 'A', '[A-Z]')) end as fits
  from column_profile p join counts c using (column_id, load_no) where p.data_format is not null and c.value is not null)
select column_id, load_no, 'null_count' as finding from loads where value_statistics.null_count <> nulls
union select column_id, load_no, 'distinct_count' from loads where value_statistics.distinct_count <> dist
union select column_id, load_no, 'format' from tested where not fits
union select column_id, load_no, 'range' from tested where fits and data_format = 'INT' and (try_cast(value as double) < min_value or try_cast(value as double) > max_value)
union select column_id, load_no, 'drift' from steps where rows > 0 and rows0 > 0 and 4 * abs(nulls * rows0 - nulls0 * rows) >= rows * rows0
union select column_id, load_no, 'drift' from moved
"""


@query(FINDINGS)
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return load_findings(spark, table(spark, directory, "column_profile"), f"{directory}/cell_value.parquet")


@query(FINDINGS)
def p4_clustered(spark: SparkSession, directory: str) -> DataFrame:
    """The findings from a copy of the values in which each row group holds one load."""
    files = write_clustered(table(spark, directory, "cell_value"), f"{Scratch(spark).base}/clustered")
    return load_findings(spark, table(spark, directory, "column_profile"), files)


@query("""select count(*) as loads, count(*) filter (d > 12) as settled from (select column_id, load_no, count(distinct value) as d from cell_value group by all)""")
def p4_settled(spark: SparkSession, directory: str) -> DataFrame:
    """How many loads of the clustered copy there are, and how many footers and dictionaries settle: all with more values than
    shares are needed for."""
    scratch = Scratch(spark)
    got = load_values(spark, write_clustered(table(spark, directory, "cell_value"), f"{scratch.base}/clustered"), scratch)
    return got.loads.agg(F.count("*").alias("loads")).withColumn("settled", F.lit(got.settled).cast("bigint"))


@query(
    " union all ".join(
        f"select '{c}' as \"column\", count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as \"distinct\", "
        + (f"round(min({c})::double, 6) as low, round(max({c})::double, 6) as high" if n else "null::double as low, null::double as high")
        + ", true as counted"
        + " from lineitem"
        for c, n in (
            ("l_orderkey", 1), ("l_partkey", 1), ("l_suppkey", 1), ("l_linenumber", 1), ("l_quantity", 1), ("l_extendedprice", 1),
            ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0), ("l_linestatus", 0), ("l_shipdate", 0),
        )
    )
)
def p4_profile(spark: SparkSession, directory: str) -> DataFrame:
    """Every column of a table, from footers and dictionaries as far as they go, and whether no more was scanned than there is."""
    got = profile_files(spark, f"{directory}/lineitem.parquet")
    return got.selectExpr("column", "rows", "nulls", "distinct", "round(low, 6) as low", "round(high, 6) as high", "scanned <= chunks and chunks > 0 as counted")
