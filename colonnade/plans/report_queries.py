"""Queries of reports, facets, hybrids and past episodes, and windows of user SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.functions import sqltext, text as T
from colonnade.operators import catalog, match, report, retrieve
from colonnade.operators.keyword import Keywords
from colonnade.plans import profile_queries as pq, retrieve_queries as rq, sqltext_queries as xq
from colonnade.plans.registry import query
from colonnade.sources.tables import table

_BM = f"(with {rq.BM25} select query, doc, score from bm where score > 0)"
_SOURCE = _BM.replace("lower(text)", "lower(source)").replace("where text is not null", "where source is not null")
_ALL = rq.BM25.replace("query_id % 100 = 0 and ", "")  # of every question
_REL = "(select query, doc, score / max(score) over (partition by query) as score from {0})"


@query(f"""with f as (select query, doc, score * 1.0 as score from {_REL.format(_BM)} union all select query, doc, score * 0.5 from {_REL.format(_SOURCE)}), b as (select query, doc, round(max(score), 6) as score from f group by all)
  select query, doc, score from b qualify row_number() over (partition by query order by score desc, doc) <= 10""")
def facet_search(spark: SparkSession, directory: str) -> DataFrame:
    """Documents by their texts and, at half the weight, by their sources."""
    d = table(spark, directory, "documents")
    facets = d.where("text is not null").select(F.col("doc_id").alias("doc"), F.lit("text").alias("facet"), "text")
    facets = facets.union(d.where("source is not null").select("doc_id", F.lit("source"), "source"))
    return match.facet_search(facets, rq.questions(spark, directory), {"text": 1.0, "source": 0.5}, 10).drop("rank")


@query(f"""with {_ALL}, {rq.SPARSE}, b as (select query, doc, score / max(score) over (partition by query) as k from bm where score > 0),
  h as (select query, doc, round(0.5 * coalesce(k, 0) + 0.5 * coalesce(score, 0), 6) as score from b full join sp using (query, doc)) select * from h qualify row_number() over (partition by query order by score desc, doc) <= 10""")
def hybrid_search(spark: SparkSession, directory: str) -> DataFrame:
    """Documents for every question by keyword and vector scores in equal parts."""
    asked = table(spark, directory, "nl2sql_query").where("question is not null").selectExpr("query_id as query", "question as text")
    return Keywords(spark, rq.documents(spark, directory), asked, sparse=True).hybrid(10, 0.5)


_SKELETON = xq.sql_skeleton.__name__  # the skeleton's SQL is that of its own query


def _episode_sql() -> str:
    from colonnade.plans.registry import ORACLE

    return f"""with sk as ({ORACLE[_SKELETON]}), tk as (select record_id, t || ' ' || (row_number() over (partition by record_id, t) - 1) as t from (select record_id, unnest(string_split(skeleton, ' ')) as t from sk) where t <> ''),
  bag as (select record_id, list(t) as shape from tk group by all),
  r as (select record_id, lower(database_id) as db, label, {rq.tokens_sql('user_query')} as words, shape from episodic_record join bag using (record_id) where user_query is not null and database_id is not null),
  p as (select a.record_id as query, b.record_id as doc, list_distinct(a.words) as x, list_distinct(b.words) as y, a.shape as u, b.shape as v from r a join r b using (db) where a.record_id % 100 = 0 and b.label),
  s as (select query, doc, round(0.6 * (0.6 * case when len(list_distinct(list_concat(x, y))) = 0 then 1 else len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) end + 0.4 * case when least(len(x), len(y)) = 0 then 0 else len(list_intersect(x, y)) / least(len(x), len(y)) end)
    + 0.4 * len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))), 6) as score from p)
  select query, doc, score from s where score > 0 qualify row_number() over (partition by query order by score desc, doc) <= 5"""


@query(_episode_sql())
def same_database_episodes(spark: SparkSession, directory: str) -> DataFrame:
    """The right records of its own database that are most like every hundredth record."""
    r = table(spark, directory, "episodic_record").where("user_query is not null and database_id is not null and generated_sql is not null")
    r = r.select("record_id", "label", F.lower("database_id").alias("db"), F.array_join(T.tokens(F.col("user_query")), " ").alias("words"), sqltext.skeleton(F.col("generated_sql")).alias("shape")).where("trim(shape) <> ''")
    asked = r.where("record_id % 100 = 0").selectExpr("record_id as query", "db", "words", "shape")
    return match.same_database(asked, r.where("label").selectExpr("record_id as doc", "db", "words", "shape"), 5)


@query("""with a as (select count(*) as n, count(o_custkey) as k, count(distinct o_custkey) as d from orders), b as (select count(*) as n, count(c_custkey) as k, count(distinct c_custkey) as d from customer),
  f as (select max(l * coalesce(r, 0)) as max_fanout, round(count(*) filter (r > 0) / count(*), 6) as match_ratio, count(*) filter (r is null) as missing_values, count(*) as n from (select o_custkey as k, count(*) as l from orders where o_custkey is not null group by all) left join (select c_custkey as k, count(*) as r from customer group by all) using (k))
  select a.k = a.d and a.k > 0 as left_unique, round(1 - a.d / a.k, 4) as left_duplication, b.k = b.d and b.k > 0 as right_unique, max_fanout, match_ratio, missing_values, max_fanout > 1 or match_ratio < 0.9 as major_difference,
    case when not (max_fanout > 1 or match_ratio < 0.9) then 'any join' when max_fanout > 1 and match_ratio < 0.9 then 'left join after grouping the right side' when max_fanout > 1 then 'group the right side first' else 'left join' end as advice from a, b, f""")
def query_difference(spark: SparkSession, directory: str) -> DataFrame:
    got = report.difference(table(spark, directory, "orders"), "o_custkey", table(spark, directory, "customer"), "c_custkey")
    return got.select("left_unique", "left_duplication", "right_unique", "max_fanout", "match_ratio", "missing_values", "major_difference", "advice")


@query("""select o_orderpriority as "group", count(*) as rows, round(count(*) / sum(count(*)) over (), 6) as share from orders where o_orderstatus = 'F' group by all""")
def value_drill_down(spark: SparkSession, directory: str) -> DataFrame:
    return report.drill_down(table(spark, directory, "orders"), "o_orderstatus", "F", "o_orderpriority")


@query("select '| n_nationkey | n_name | n_regionkey |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) order by n_nationkey) as text from (select * from nation order by n_nationkey limit 5)")
def markdown_sample(spark: SparkSession, directory: str) -> DataFrame:
    return report.markdown(table(spark, directory, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("select c_custkey, c_name, c_nationkey, c_mktsegment from customer order by c_custkey limit 5")
def key_sample(spark: SparkSession, directory: str) -> DataFrame:
    return report.key_sample(table(spark, directory, "customer").select("c_name", "c_custkey", "c_nationkey", "c_mktsegment"), ["c_custkey"])


@query(f"select string_agg(table_name || '.' || column_name || ' = ' || target_table || '.' || target_column, chr(10) order by fk_id) as text from {pq.FK_SQL}")
def join_text(spark: SparkSession, directory: str) -> DataFrame:
    return report.join_text(catalog.foreign_keys_frame(spark))


@query("""select event_id, lag(event_type) over w as before, lead(event_type) over w as after, count(*) over (w rows between 2 preceding and current row) as near, rank() over w as place from events window w as (partition by user_id order by event_id)""")
def event_windows(spark: SparkSession, directory: str) -> DataFrame:
    """What user SQL does with windows: neighbours, frames and ranks."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    frame = w.rowsBetween(-2, 0)
    return table(spark, directory, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.count("*").over(frame).alias("near"), F.rank().over(w).cast("bigint").alias("place"))
