"""Queries over SQL text and question text.

What is read off parse trees is checked against the trees of the checking engine's own parser: their JSON form is searched
for node kinds, names and aliases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import sqlparse, sqltext, text as T
from colonnade.operators import select
from colonnade.plans.registry import query
from colonnade.sources.tables import table


def _sql(p: str) -> str:
    return p.replace("'", "''")


def _masked(c: str) -> str:
    for p in T.VALUE_PATTERNS:
        c = f"regexp_replace({c}, '{_sql(p)}', '{T.VALUE}', 'g')"
    return c


WHERE = "from episodic_record where generated_sql is not null"
#: Parse trees as text in lower case, without positions; ``ok`` if there is one.
TREES = f"""trees as materialized (select *, starts_with(j, '{{"error":false') as ok from (select record_id, label, lower(database_id) as db, user_query,
  lower(regexp_replace(json_serialize_sql(regexp_replace(generated_sql, '```[a-zA-Z]*', ' ', 'g')), '"query_location(_length)?":[0-9]+,?', '', 'g')) as j {WHERE}))"""
BASE_TABLE = '"type":"base_table","alias":"([^"]*)","sample":null,"schema_name":"[^"]*","table_name":"([^"]*)"'
CTES = """regexp_extract_all(j, '"key":"([^"]*)","value":\\{"aliases"', 1)"""
TABLES = f"list_sort(list_distinct(list_filter(regexp_extract_all(j, '{BASE_TABLE}', 2), lambda t: not list_contains({CTES}, t))))"


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(j, '{pattern}'))"


def records(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "episodic_record").where("generated_sql is not null").select("record_id", "database_id", "user_query", "label", F.col("generated_sql").alias("s"))


def analysed(spark: SparkSession, directory: str) -> DataFrame:
    """The records with the analysis of their SQL, those that are queries."""
    return sqlparse.analyse(records(spark, directory), "s", "a")


@query(f"select query_id, {_masked('question')} as masked from nl2sql_query where question is not null")
def mask_values(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "nl2sql_query").where("question is not null").select("query_id", T.mask_values(F.col("question")).alias("masked"))


@query(f"""select record_id, md5(generated_sql || ' and strftime(''%Y'', d) >= ''' || (1900 + record_id % 9000) || ''' and strftime(''%m'', d) = ' || record_id % 12 || ' and x = 20051') as rewritten {WHERE}""")
def time_rewrite(spark: SparkSession, directory: str) -> DataFrame:
    """Every recorded query with comparisons of dates added, and the years in them quoted."""
    more = F.concat(F.col("s"), F.lit(" and strftime('%Y', d) >= "), (1900 + F.col("record_id") % 9000).cast("string"), F.lit(" and strftime('%m', d) = "), (F.col("record_id") % 12).cast("string"), F.lit(" and x = 20051"))
    return records(spark, directory).select("record_id", F.md5(sqltext.quote_time(more)).alias("rewritten"))


@query(f"""with {TREES} select record_id, case when ok then 5 * ({_n('"class":"window"')} > 0)::int + 3 * ({_n('"key":"[^"]*","value":[{]"aliases"')} > 0)::int + 3 * {_n('"type":"set_operation_node"')}
  + 3 * {_n('"type":"subquery"')} + {_n('"type":"join"')} + ({_n('"having":[{]')} > 0)::int else 100 end::int as score from trees""")
def complexity_score(spark: SparkSession, directory: str) -> DataFrame:
    return analysed(spark, directory).select("record_id", F.col("a.complexity").alias("score"))


_TAG_PATTERNS = {
    "aggregate": '"group_expressions":[\\[][{]|"function_name":"(count|count_star|sum|avg|max|min)"', "calc": '"function_name":"/"', "deduplication": '"type":"distinct_modifier"', "filter": '"having":[{]',
    "join": '"type":"join"', "limit": '"type":"limit_modifier"', "sorting": '"type":"order_modifier","orders":[\\[][{]', "subquery": '"type":"subquery"', "window": '"class":"window"',
}


@query(f"with {TREES} select record_id, concat_ws(','," + ", ".join(f"case when {_n(p)} > 0 then '{tag}' end" for tag, p in _TAG_PATTERNS.items()) + ") as tags from trees where ok")
def intent_tags(spark: SparkSession, directory: str) -> DataFrame:
    a = analysed(spark, directory).where("a.parsed")
    return a.select("record_id", F.array_join(F.array_sort(F.array_distinct("a.intents.tag")), ",").alias("tags"))


_TYPE_PATTERNS = {
    "group_by": '"group_expressions":[\\[][{]', "having": '"having":[{]', "limit": '"type":"limit_modifier"', "order_by_desc": '"type":"descending"', "division": '"function_name":"/"',
    "in_subquery": '"subquery_type":"any"', "exists": '"subquery_type":"(not_)?exists"', "left_join": '"join_type":"left"',
}


@query(f"with {TREES} " + " union all ".join(f"select record_id, '{t}' as intent, {_n(p)}::bigint as n from trees where ok and {_n(p)} > 0" for t, p in _TYPE_PATTERNS.items()))
def intent_counts(spark: SparkSession, directory: str) -> DataFrame:
    """How often each of some kinds of intents occurs in a query."""
    a = analysed(spark, directory).select("record_id", F.explode("a.intents.type").alias("intent"))
    return a.where(F.col("intent").isin(*_TYPE_PATTERNS)).groupBy("record_id", "intent").agg(F.count("*").alias("n"))


@query(f"with {TREES} select record_id, array_to_string({TABLES}, ',') as tables from trees where ok")
def tables_of_sql(spark: SparkSession, directory: str) -> DataFrame:
    return analysed(spark, directory).where("a.parsed").select("record_id", F.array_join("a.tables", ",").alias("tables"))


REF = '{"class":"column_ref","type":"column_ref","alias":"[^"]*","column_names":[\\[]"([^"]*)","([^"]*)"[\\]][}]'
#: The table behind an alias, or the name itself.
OWNER = "coalesce(ts[list_position(als, {0})], {0})"
EQUAL = f'"type":"compare_equal","alias":"","left":{REF},"right":{REF}'
JOINS = f"""named as (select *, regexp_extract_all(j, '{BASE_TABLE}', 1) as als, regexp_extract_all(j, '{BASE_TABLE}', 2) as ts from trees where ok),
  eq as (select record_id, db, label, als, ts, unnest(regexp_extract_all(j, '{EQUAL}')) as e from named),
  parts as (select record_id, db, als, ts, regexp_extract(e, '{EQUAL}', 1) as a, regexp_extract(e, '{EQUAL}', 2) as ca, regexp_extract(e, '{EQUAL}', 3) as b, regexp_extract(e, '{EQUAL}', 4) as cb from eq),
  conds as (select distinct record_id, db, {OWNER.format('a')} || '.' || ca as x, {OWNER.format('b')} || '.' || cb as y from parts)"""


def joins_of(spark: SparkSession, directory: str) -> DataFrame:
    """(record_id, db, x, y): the equalities of columns in the joins of each query, x before y."""
    j = analysed(spark, directory).select("record_id", F.lower("database_id").alias("db"), F.explode("a.joins").alias("j"))
    x, y = F.concat_ws(".", "j.left_table", "j.left_column"), F.concat_ws(".", "j.right_table", "j.right_column")
    return j.select("record_id", "db", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()


@query(f"with {TREES}, {JOINS} select least(x, y) || ' = ' || greatest(x, y) as condition, count(*) as records from conds group by all")
def join_conditions(spark: SparkSession, directory: str) -> DataFrame:
    return joins_of(spark, directory).groupBy(F.concat_ws(" = ", "x", "y").alias("condition")).agg(F.count("*").alias("records"))


@query(f"""with {TREES}, {JOINS}, used as (select db, least(x, y) as x, greatest(x, y) as y, count(*) as records from conds where db is not null group by all),
  told as (select distinct lower(trim(database_id)) as db, least(s, t) as x, greatest(s, t) as y from (select database_id, lower(trim(source_table)) || '.' || lower(trim(source_column)) as s, lower(trim(target_table)) || '.' || lower(trim(target_column)) as t from join_candidate) where s is not null and t is not null)
  select used.* from used anti join told using (db, x, y)""")
def undeclared_joins(spark: SparkSession, directory: str) -> DataFrame:
    """Joins that queries use and that no stored join candidate of their database names, in either direction."""
    used = joins_of(spark, directory).where("db is not null").groupBy("db", "x", "y").agg(F.count("*").alias("records"))
    clean = lambda c: F.lower(F.trim(c))
    s, t = F.concat(clean("source_table"), F.lit("."), clean("source_column")), F.concat(clean("target_table"), F.lit("."), clean("target_column"))
    told = table(spark, directory, "join_candidate").select(clean("database_id").alias("db"), F.least(s, t).alias("x"), F.greatest(s, t).alias("y")).where(s.isNotNull() & t.isNotNull())
    return used.join(told, ["db", "x", "y"], "left_anti").select("db", "x", "y", "records")


_KEEP = ", ".join(f"'{k}'" for k in sqltext.KEYWORDS)


@query(f"""with p as (select record_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(lower(generated_sql), '''[^'']*''|`[^`]*`|"[^"]*"', ' x ', 'g'), '[a-z_][a-z0-9_.]*|[0-9][0-9.]*|[<>=!]+|[(),*/+-]'),
    lambda t: case when t in ({_KEEP}) or not regexp_matches(t, '^[a-z0-9_]') then t else '_' end), ' ') as t {WHERE})
  select record_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '_( _)+', '_', 'g'), '_ as _', '_', 'g'), '_( , _)+', '_', 'g'), '_( join _ on _ = _)+', '_ join _', 'g') as skeleton from p""")
def sql_skeleton(spark: SparkSession, directory: str) -> DataFrame:
    return records(spark, directory).select("record_id", sqltext.skeleton(F.col("s")).alias("skeleton"))


MASKED = "lower(trim(regexp_replace(regexp_replace(regexp_replace(generated_sql, '''[^'']*''', '?', 'g'), '\\b\\d+(\\.\\d+)?\\b', '?', 'g'), '\\s+', ' ', 'g')))"


@query(f"""with k as (select record_id, label, lower(database_id) as db, user_query as q, generated_sql as s, {MASKED} as m {WHERE} and user_query is not null and database_id is not null)
  select w.record_id as wrong, c.record_id as correct from k w join k c using (db, q) where not w.label and c.label and w.m = c.m and w.s <> c.s""")
def value_only_differences(spark: SparkSession, directory: str) -> DataFrame:
    """Wrong and right records of one question whose SQL differs in nothing but values."""
    r = records(spark, directory).where("user_query is not null and database_id is not null")
    k = r.select("record_id", "label", F.lower("database_id").alias("db"), F.col("user_query").alias("q"), "s", sqltext.mask_literals(F.col("s")).alias("m"))
    wrong = k.where("not label").select("db", "q", "m", F.col("record_id").alias("wrong"), F.col("s").alias("ws"))
    right = k.where("label").select("db", "q", "m", F.col("record_id").alias("correct"), F.col("s").alias("cs"))
    return wrong.join(right, ["db", "q", "m"]).where("ws <> cs").select("wrong", "correct")


def _linking(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Tables of the right and of the wrong records of each question."""
    r = analysed(spark, directory).where("user_query is not null and database_id is not null")
    k = r.select(F.concat_ws("|", F.lower("database_id"), "user_query").alias("question"), "label", F.explode("a.tables").alias("table_name"))
    return k.where("label").select("question", "table_name"), k.where("not label").select("question", "table_name")


LINKS = f"""{TREES}, k as (select db || '|' || user_query as question, label, unnest({TABLES}) as table_name from trees where ok and user_query is not null and db is not null),
  g as (select distinct question, table_name from k where label), l as (select distinct question, table_name, 1 as hit from k where not label)"""


@query(f"""with {LINKS}, p as (select question, count(*) as n, count(hit) as hit from g left join l using (question, table_name) group by all)
  select round(sum((hit / n)::decimal(38, 12))::double / count(*), 6) as macro_recall, round(sum(hit) / sum(n), 6) as micro_recall from p""")
def linking_recall(spark: SparkSession, directory: str) -> DataFrame:
    gold, linked = _linking(spark, directory)
    return select.linking_recall(gold, linked, ["table_name"]).select(F.round("macro_recall", 6).alias("macro_recall"), F.round("micro_recall", 6).alias("micro_recall"))


@query(f"""with {LINKS} select question, table_name, case when hit is null then 'missing' when g.table_name is null then 'extra' end as difference
  from (select question, table_name, true as gold from g) g full join l using (question, table_name) where (hit is null or gold is null) and question in (select question from g) and question in (select question from l)""".replace("when g.table_name is null", "when gold is null"))
def table_differences(spark: SparkSession, directory: str) -> DataFrame:
    """Tables that the right records of a question use and the wrong ones lack, and the reverse."""
    gold, linked = (d.distinct() for d in _linking(spark, directory))
    keys = gold.select("question").join(linked.select("question"), "question", "left_semi").distinct()
    both = gold.withColumn("gold", F.lit(True)).join(linked.withColumn("hit", F.lit(True)), ["question", "table_name"], "full").join(keys, "question", "left_semi")
    return both.where("gold is null or hit is null").select("question", "table_name", F.when(F.col("hit").isNull(), "missing").otherwise("extra").alias("difference"))


#: Columns of a query as table.column, for queries whose columns all name their table.
COLUMNS = f"""named as (select *, regexp_extract_all(j, '{BASE_TABLE}', 1) as als, regexp_extract_all(j, '{BASE_TABLE}', 2) as ts from trees where ok),
  refs as (select record_id, als, ts, unnest(regexp_extract_all(j, '"column_names":[\\[]("[^\\]]*")[\\]]', 1)) as r from named where len({CTES}) = 0 and {_n('"type":"subquery"')} = 0 and {_n('"type":"set_operation_node"')} = 0),
  whole as (select record_id, als, ts, regexp_extract_all(r, '"([^"]*)"', 1) as p from refs),
  cols as (select distinct record_id, case when len(p) = 2 then {OWNER.format('p[1]')} || '.' || p[2] when len(ts) = 1 then ts[1] || '.' || p[1] else '.' || p[1] end as c from whole)"""


@query(f"with {TREES}, {COLUMNS} select record_id, string_agg(c, ',' order by c) as columns from cols group by all")
def columns_of_sql(spark: SparkSession, directory: str) -> DataFrame:
    """The columns of each query without subqueries, set operations and common table expressions."""
    a = analysed(spark, directory).where("a.parsed and not exists(a.intents, i -> i.tag = 'subquery') and not a.logic like '%[WITH %' and not a.logic rlike '\\\\[(UNION|INTERSECT|EXCEPT)'")
    c = F.transform("a.columns", lambda x: F.concat_ws(".", x["table_name"], x["column_name"]))
    return a.select("record_id", F.array_join(F.array_sort(F.array_distinct(c)), ",").alias("columns")).where("columns <> ''")


@query()
def schema_overlap(spark: SparkSession, directory: str) -> DataFrame:
    """Overlap of the tables and of the columns of the right and the wrong records of each question."""
    r = analysed(spark, directory).where("a.parsed and user_query is not null and database_id is not null")
    columns = F.transform("a.columns", lambda x: F.concat_ws(".", x["table_name"], x["column_name"]))
    k = r.select(F.concat_ws("|", F.lower("database_id"), "user_query").alias("question"), "label", F.col("a.tables").alias("t"), columns.alias("c"))

    def each(c: str, label: str, name: str):
        """Different elements; a list for each question, element by element, as long as its queries."""
        return k.where(label).select("question", F.explode(c).alias("e")).distinct().groupBy("question").agg(F.collect_list("e").alias(name))

    rows = each("t", "label", "x").join(each("t", "not label", "y"), "question")
    for name, label in (("ca", "label"), ("cb", "not label")):
        rows = rows.join(each("c", label, name), "question", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return select.schema_overlap(rows, "x", "y", "ca", "cb").select("question", F.round("overlap", 6).alias("overlap"))


@query("select query_id, lower(trim(regexp_replace(split, '\\s+', ' ', 'g'))) as split, trim(regexp_replace(replace(translate(evidence, chr(13) || chr(10), '  '), 'commonsense evidence:', ''), ' +', ' ', 'g')) as evidence from nl2sql_query where evidence is not null and split is not null")
def description_normalize(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "nl2sql_query").where("evidence is not null and split is not null")
    return r.select("query_id", T.normalise_sql(F.col("split")).alias("split"), T.normalise_description(F.col("evidence")).alias("evidence"))


@query()
def sql_checks(spark: SparkSession, directory: str) -> DataFrame:
    """The rule checks that each recorded query fails; a look-behind in one of them has no form in the checking engine."""
    got = records(spark, directory).select("record_id", sqltext.checks(F.col("s")).alias("failed"))
    return got.where("failed <> ''")


@query()
def sql_rewrites(spark: SparkSession, directory: str) -> DataFrame:
    """Each recorded query with its tables' aliases resolved, and as the chain of its steps."""
    return analysed(spark, directory).where("a.parsed").select("record_id", "a.qualified", "a.logic")
