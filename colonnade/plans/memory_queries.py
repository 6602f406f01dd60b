"""Queries over stored records and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import text as T
from colonnade.operators import graph, memory
from colonnade.plans.registry import mean, mean_sql, query
from colonnade.sources.tables import table

NORM_Q = "regexp_replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), '[[:punct:]\\s]+$', '')"
NORM_S = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
Q_SQL, S_SQL = NORM_Q.format("user_query"), NORM_S.format("generated_sql")


@query(f"select record_id, {Q_SQL} as question, md5({S_SQL}) as sql_hash from episodic_record where user_query is not null")
def question_normalize(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "episodic_record").where("user_query is not null")
    return r.select("record_id", T.normalise_question(F.col("user_query")).alias("question"), F.md5(T.normalise_sql(F.col("generated_sql"))).alias("sql_hash"))


def _keys(r: DataFrame) -> DataFrame:
    return r.select("record_id", "label", F.lower("database_id").alias("db"), T.normalise_question(F.col("user_query")).alias("q"), T.normalise_sql(F.col("generated_sql")).alias("s"))


KEYED = f"k as (select record_id, label, lower(database_id) as db, {Q_SQL} as q, {S_SQL} as s from episodic_record where database_id is not null and user_query is not null and generated_sql is not null)"


@query(f"""with {KEYED}, e as (select distinct db, q, s from k where label is not null)
  select min(record_id) as record_id from k where label is null and not exists (select 1 from e where e.db = k.db and e.q = k.q and e.s = k.s) group by db, q, s""")
def record_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Unlabelled records that are new against the labelled ones."""
    k = _keys(table(spark, directory, "episodic_record").where("database_id is not null and user_query is not null and generated_sql is not null"))
    got = memory.dedup_records(k.where("label is not null"), k.where("label is null"), [F.col("db"), F.col("q"), F.col("s")], "record_id")
    return got.select("record_id")


SOURCES = "case when load_no % 3 = 0 then 'ddl' when load_no % 3 = 1 then 'manual' else 'llm' end"


@query(f"""with v as (select column_id, load_no, {SOURCES} as source, case when load_no % 3 = 0 then 4 when load_no % 3 = 1 then 3 else 1 end as p, data_type as value from column_profile),
  l as (select column_id, list({{'v': value, 's': source, 'b': p}} order by load_no) as l from v group by all),
  r as (select column_id, list_reduce(l, lambda a, x: case when x.b >= a.b or a.v is null or trim(a.v) = '' then {{'v': x.v, 's': x.s, 'b': greatest(a.b, x.b)}} else {{'v': a.v, 's': a.s, 'b': greatest(a.b, x.b)}} end) as r from l)
  select column_id::varchar as entity, 'data_type' as field, r.v as value, r.s as source from r""")
def version_resolve(spark: SparkSession, directory: str) -> DataFrame:
    versions = table(spark, directory, "column_profile").selectExpr("cast(column_id as string) as entity", "'data_type' as field", "data_type as value", f"{SOURCES} as source", "load_no as seq")
    return memory.resolve_versions(versions)


PAIR_SQL = "(select lower(trim(database_id || '.' || table_a || '.' || column_a)) as a, lower(trim(database_id || '.' || table_b || '.' || column_b)) as b, coalesce(split_part(similarity_reason, ':', 1), '-') as method, similarity_score as score from similar_column_pair where column_a is not null and column_b is not null)"


@query(f"select least(a, b) as a, greatest(a, b) as b, array_to_string(list_sort(list(distinct method)), ',') as methods, nullif(max(score), 0.0) as score, count(*) as rows from {PAIR_SQL} group by least(a, b), greatest(a, b)")
def pair_merge(spark: SparkSession, directory: str) -> DataFrame:
    got = memory.merge_pairs(_pairs(spark, directory))
    return got.withColumn("methods", F.array_join("methods", ","))


def _pairs(spark: SparkSession, directory: str) -> DataFrame:
    p = table(spark, directory, "similar_column_pair").where("column_a is not null and column_b is not null")
    key = lambda t, c: F.lower(F.trim(F.concat(F.col("database_id"), F.lit("."), F.col(t), F.lit("."), F.col(c))))
    method = F.coalesce(F.split_part("similarity_reason", F.lit(":"), F.lit(1)), F.lit("-"))
    return p.select(key("table_a", "column_a").alias("a"), key("table_b", "column_b").alias("b"), method.alias("method"), F.col("similarity_score").alias("score"))


@query(f"""with recursive e as (select distinct a, b from {PAIR_SQL} where a <> b), s as (select a, b from e union select b, a from e),
  r(k, m) as (select a, a from s union select s.b, r.m from r join s on s.a = r.k) select k as column_key, min(m) as group_key from r group by k""")
def column_components(spark: SparkSession, directory: str) -> DataFrame:
    """Columns linked by stored pairs, as the names are written but for case and outer blanks."""
    return graph.column_groups(spark, _pairs(spark, directory).select("a", "b")).withColumnRenamed("key", "column_key")


@query(f"""with recursive e as (select distinct a, b from {PAIR_SQL} where a <> b), s as (select a, b from e union select b, a from e),
  r(k, m) as (select a, a from s union select s.b, r.m from r join s on s.a = r.k), g as (select k, min(m) as group_key from r group by k)
  select group_key, count(*) as pairs, round(min(score), 6) as low, round(max(score), 6) as high, {mean_sql("score")} as mean from {PAIR_SQL} p join g on g.k = p.a where p.a <> p.b group by all""")
def cluster_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Scores of the stored pairs inside each group of linked columns."""
    pairs = _pairs(spark, directory)
    groups = graph.column_groups(spark, pairs.select("a", "b"))
    inside = pairs.where("a <> b").join(groups.withColumnRenamed("key", "a"), "a")
    return inside.groupBy("group_key").agg(F.count("*").alias("pairs"), F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"), mean("score").alias("mean"))


@query(f"select round(min(x), 6) as low, round(max(x), 6) as high, {mean_sql('x')} as mean, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.75), 6) as p75, round(quantile_cont(x, 0.9), 6) as p90, count(*) filter (x >= 0.9) as above from (select similarity_score as x from similar_column_pair)")
def score_statistics(spark: SparkSession, directory: str) -> DataFrame:
    x = F.col("similarity_score")
    q = F.percentile(x, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    got = table(spark, directory, "similar_column_pair").agg(F.min(x).alias("low"), F.max(x).alias("high"), mean("similarity_score").alias("mean"), q.alias("q"), F.count(F.when(x >= 0.9, 1)).alias("above"))
    return got.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "mean")], *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("median", "p75", "p90"))], "above")


@query(f"""with {KEYED}, c as (select db, q, min(record_id) as correct_record from k where label group by all)
  select k.db, k.q, record_id as record, correct_record from k join c using (db, q) where not label""")
def correct_complement(spark: SparkSession, directory: str) -> DataFrame:
    k = _keys(table(spark, directory, "episodic_record").where("database_id is not null and user_query is not null and generated_sql is not null"))
    return memory.correct_complement(k.where("not label"), k.where("label"), ["db", "q"], "record_id")


@query(f"""with {KEYED}, w as (select db, q, record_id as wrong, s as ws from k where not label), c as (select db, q, record_id as correct, s as cs from k where label),
  p as (select w.wrong, c.correct, string_split(ws, ' ') as x, string_split(cs, ' ') as y from w join c using (db, q)),
  tx as (select wrong, correct, t, count(*) as n from (select wrong, correct, unnest(x) as t from p) group by all), ty as (select wrong, correct, t, count(*) as n from (select wrong, correct, unnest(y) as t from p) group by all),
  m as (select wrong, correct, sum(least(tx.n, ty.n)) as shared from tx join ty using (wrong, correct, t) group by all)
  select p.wrong, p.correct, round(coalesce(shared, 0) / (len(x) + len(y) - coalesce(shared, 0)), 6) as similarity from p left join m using (wrong, correct)""")
def multiset_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    """Every wrong with every right record of one question, and how similar their SQL is."""
    k = _keys(table(spark, directory, "episodic_record").where("database_id is not null and user_query is not null and generated_sql is not null"))
    k = k.where("label is not null").select("db", "q", "record_id", "label", T.bag_tokens(F.col("s")).alias("bag"))  # once for each record
    wrong = k.where("not label").select("db", "q", F.col("record_id").alias("wrong"), F.col("bag").alias("x"))
    right = k.where("label").select("db", "q", F.col("record_id").alias("correct"), F.col("bag").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return wrong.join(right, ["db", "q"]).select("wrong", "correct", F.round(shared / (F.size("x") + F.size("y") - shared), 6).alias("similarity"))


@query("""select coalesce(n.query_id, o.query_id) as query_id, coalesce(n.question, o.question) as question, coalesce(n.evidence, o.evidence) as evidence from
  (select query_id, question, null::varchar as evidence from nl2sql_query where lower(trim(split)) <> 'test') o full join (select query_id, null::varchar as question, evidence from nl2sql_query where lower(trim(split)) <> 'dev') n using (query_id)""")
def metadata_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """Questions without evidence, updated with evidence without questions: null overwrites nothing."""
    r = table(spark, directory, "nl2sql_query").withColumn("sp", F.lower(F.trim("split")))
    none = F.lit(None).cast("string")
    return memory.upsert(r.where("sp <> 'test'").select("query_id", "question", none.alias("evidence")), r.where("sp <> 'dev'").select("query_id", none.alias("question"), "evidence"), ["query_id"])


@query("select record_id, year(ts)::int as year from episodic_record where ts is not null and year(ts) > (select max(year(ts)) from episodic_record) - 1")
def newest_records(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "episodic_record").select("record_id", "ts").where("ts is not null")
    return memory.newest_years(r, "ts", 1).select("record_id", F.year("ts").alias("year"))


@query("""select query_id from (select query_id, lower(db_id) as db, row_number() over (partition by lower(db_id) order by query_id desc) as r, count(*) over (partition by lower(db_id)) as n from nl2sql_query)
  where r <= greatest(1, floor(n * 10 / 100))""")
def last_share(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "nl2sql_query").select("query_id", F.lower("db_id").alias("db"))
    return memory.last_share(r, "db", "query_id", 10).select("query_id")


@query("""with o as (select lower(database_id) as db, count(*) as last from episodic_record where label is not null and database_id is not null group by all)
  select record_id, lower(database_id) || '_' || lpad((coalesce(last, 0) + row_number() over (partition by lower(database_id) order by record_id))::varchar, 6, '0') as session
  from episodic_record left join o on o.db = lower(database_id) where label is null and database_id is not null""")
def session_counter(spark: SparkSession, directory: str) -> DataFrame:
    r = table(spark, directory, "episodic_record").where("database_id is not null").select("record_id", "label", F.lower("database_id").alias("db"))
    last = r.where("label is not null").groupBy("db").agg(F.count("*").alias("last"))
    return memory.session_ids(r.where("label is null"), "db", "record_id", last).select("record_id", "session")


@query("""with v as (select database_id as entity, 'description' as field, description as value, 'llm' as source from database_metadata union all select database_id, 'domain', domain, 'manual' from database_metadata)
  select entity, field, case when value is null or trim(value) = '' then 'missing' else 'outranked' end as reason from v where value is null or trim(value) = '' or source = 'llm'""")
def generation_plan(spark: SparkSession, directory: str) -> DataFrame:
    """Which fields of the databases' metadata are missing or come from a source below the required one."""
    m = table(spark, directory, "database_metadata")
    one = m.select(F.col("database_id").alias("entity"), F.lit("description").alias("field"), F.col("description").alias("value"), F.lit("llm").alias("source"))
    two = m.select(F.col("database_id").alias("entity"), F.lit("domain").alias("field"), F.col("domain").alias("value"), F.lit("manual").alias("source"))
    current = one.union(two)
    return memory.missing_fields(current.select("entity", "field", F.lit(3).alias("priority")), current)


@query("""select entity, array_to_string(list(distinct_v order by first_n), '|') as definition from (select lower(db_id) as entity, trim(evidence) as distinct_v, min(query_id) as first_n from nl2sql_query where evidence is not null and trim(evidence) <> '' group by all) group by all""")
def append_merge(spark: SparkSession, directory: str) -> DataFrame:
    """All hints of a database, each once, in the order of their first appearance."""
    r = table(spark, directory, "nl2sql_query").where("trim(evidence) <> ''").select(F.lower("db_id").alias("entity"), F.trim("evidence").alias("e"), "query_id")
    firsts = r.groupBy("entity", "e").agg(F.min("query_id").alias("n"))
    return firsts.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]), "|").alias("definition"))


@query(f"select method, count(*) as rows, count(score) as scored, count(distinct (least(a, b), greatest(a, b))) as pairs from {PAIR_SQL} group by all")
def pair_statistics(spark: SparkSession, directory: str) -> DataFrame:
    """For each way of discovery: stored rows, those with a score, and different pairs."""
    p = _pairs(spark, directory).withColumn("pair", F.struct(F.least("a", "b"), F.greatest("a", "b")))
    each = p.groupBy("method", "pair").agg(F.count("*").alias("rows"), F.count("score").alias("scored"))
    return each.groupBy("method").agg(F.sum("rows").alias("rows"), F.sum("scored").alias("scored"), F.count("*").alias("pairs"))


@query(f"select k as column_key, count(*) as rows, max(score) as best from (select a as k, score from {PAIR_SQL} union all select b, score from {PAIR_SQL} where a <> b) group by all")
def pairs_of_column(spark: SparkSession, directory: str) -> DataFrame:
    """How many stored pairs touch a column on either side, and the best score among them."""
    p = _pairs(spark, directory)
    ends = p.select(F.col("a").alias("column_key"), "score").union(p.where("a <> b").select("b", "score"))
    return ends.groupBy("column_key").agg(F.count("*").alias("rows"), F.max("score").alias("best"))


@query(f"""with d as (select distinct {NORM_Q.format("question")} as q from nl2sql_query where lower(trim(split)) in ('dev', 'test') and question is not null)
  select query_id from nl2sql_query where lower(trim(split)) = 'train' and question is not null and {NORM_Q.format("question")} not in (select q from d)""")
def question_exclusion(spark: SparkSession, directory: str) -> DataFrame:
    """Training questions without those that an evaluation split asks in the same words."""
    r = table(spark, directory, "nl2sql_query").where("question is not null").select("query_id", F.lower(F.trim("split")).alias("sp"), T.normalise_question(F.col("question")).alias("q"))
    return r.where("sp = 'train'").join(r.where("sp in ('dev', 'test')").select("q"), "q", "left_anti").select("query_id")


@query(f"""with p as (select lower(database_id) as db, {Q_SQL} as q, max(record_id) as record_id from episodic_record where database_id is not null and user_query is not null group by all)
  select query_id, record_id, record_id is null as missing from (select query_id, lower(db_id) as db, {NORM_Q.format("question")} as q from nl2sql_query where question is not null) g left join p using (db, q)""")
def prediction_merge(spark: SparkSession, directory: str) -> DataFrame:
    """Every gold question with the last record that answers it, and whether there is none."""
    r = table(spark, directory, "episodic_record").where("database_id is not null and user_query is not null")
    last = r.select(F.lower("database_id").alias("db"), T.normalise_question(F.col("user_query")).alias("q"), "record_id").groupBy("db", "q").agg(F.max("record_id").alias("record_id"))
    gold = table(spark, directory, "nl2sql_query").where("question is not null").select("query_id", F.lower("db_id").alias("db"), T.normalise_question(F.col("question")).alias("q"))
    return gold.join(last, ["db", "q"], "left").select("query_id", "record_id", F.col("record_id").isNull().alias("missing"))


@query("select query_id, keyword from (select query_id, unnest(list_distinct(list_concat([lower(evidence)], string_split(lower(evidence), ' ')))) as keyword from nl2sql_query where evidence is not null) where keyword <> ''")
def keyword_union(spark: SparkSession, directory: str) -> DataFrame:
    """A phrase and its words as one set of keywords."""
    r = table(spark, directory, "nl2sql_query").where("evidence is not null").select("query_id", F.lower("evidence").alias("e"))
    words = F.array_distinct(F.concat(F.array("e"), F.split("e", " ")))
    return r.select("query_id", F.explode(words).alias("keyword")).where("keyword <> ''")


@query("select database_id, count(*) as columns, count(distinct lower(table_name)) as tables, max(total_rows) as total_rows from column_values_signature left join database_metadata using (database_id) group by all")
def database_info(spark: SparkSession, directory: str) -> DataFrame:
    """Stored columns and tables of each database with its described size."""
    c = table(spark, directory, "column_values_signature").groupBy("database_id", F.lower("table_name").alias("t")).agg(F.count("*").alias("columns"))
    per = c.groupBy("database_id").agg(F.sum("columns").alias("columns"), F.count("*").alias("tables"))
    return per.join(table(spark, directory, "database_metadata").select("database_id", "total_rows"), "database_id", "left")
