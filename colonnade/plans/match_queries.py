"""Queries that match values, names and stored pairs, and those of the metadata store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators import catalog, graph, match, memory, select, store
from colonnade.plans import memory_queries as mq, profile_queries as pq, retrieve_queries as rq, select_queries as sq
from colonnade.plans.registry import mean, mean_sql, query
from colonnade.sources.tables import table

PH = f"ph as (select distinct query, lower(trim(phrase)) as p from {rq.PHRASES_SQL} where trim(phrase) <> ''), ix as {rq.INDEX_SQL}"
RUNS = "list_transform(range(1, length({0}) + 1), lambda i: (' ' || {0} || ' ')[i:i + 2])"
NEAREST = f"""{PH}, pv as materialized (select p, t, count(*)::double as w from (select distinct p from ph), unnest({RUNS.format('p')}) u(t) group by all), iv as materialized (select norm, t, count(*)::double as w from (select distinct norm from ix), unnest({RUNS.format('norm')}) u(t) group by all),
  cs as materialized (select p, norm, round(d / (np * ni), 6) as score from (select p, norm, sum(a.w * b.w) as d from pv a join iv b using (t) group by all) join (select p, sqrt(sum(w * w)) as np from pv group by all) using (p) join (select norm, sqrt(sum(w * w)) as ni from iv group by all) using (norm) where score >= 0.3),
  nv as (select p, table_name, column_name, value, score, row_number() over (partition by p, table_name, column_name order by score desc, value) as rank from cs join ix using (norm) qualify rank <= 3)"""


@query(f"with {NEAREST} select query, table_name, column_name, value, score, rank from nv join ph using (p)")
def nearest_values(spark: SparkSession, directory: str) -> DataFrame:
    return match.nearest_values(rq.index(spark, directory), rq.phrases(spark, directory))


@query(f"with {NEAREST} select distinct query, table_name, column_name from nv join ph using (p) where 1 - score < 0.05")
def value_linked_columns(spark: SparkSession, directory: str) -> DataFrame:
    return match.linked_by_value(nearest_values(spark, directory))


@query(f"with {NEAREST} select query, table_name, column_name, string_agg(distinct value, '|' order by value) as values, max(score) as best from nv join ph using (p) group by all")
def values_of_columns(spark: SparkSession, directory: str) -> DataFrame:
    return match.values_of_columns(nearest_values(spark, directory)).withColumn("values", F.array_join("values", "|"))


@query(f"""with {PH}, tk as (select distinct t, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) as ts from (select p as t from ph union select norm from ix)), w as materialized (select t, ts, unnest(ts) as k from tk),
  pr as (select distinct a.t as p, b.t as norm, a.ts as x, b.ts as y from w a join w b using (k) where a.t <> b.t and a.t in (select p from ph) and b.t in (select norm from ix)),
  sc as (select p, norm, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as score from pr where score >= 0.5),
  best as (select p, table_name, column_name, value, score from sc join ix using (norm) qualify row_number() over (partition by p, table_name, column_name order by score desc, value) = 1)
  select query, table_name, column_name, value, score from best join ph using (p)""")
def fuzzy_values(spark: SparkSession, directory: str) -> DataFrame:
    return match.fuzzy_matches(rq.index(spark, directory), rq.phrases(spark, directory))


@query("""with k as (select distinct lower(database_id) as db, column_name from column_profile where column_name is not null), a as (select distinct lower(database_id) as db, column_a as column_name from similar_column_pair where column_a is not null and database_id is not null)
  select a.db as database_id, a.column_name, min(k.column_name) as known_name from a left join k on a.db = k.db and lower(a.column_name) = lower(k.column_name) group by all""")
def resolved_names(spark: SparkSession, directory: str) -> DataFrame:
    """Columns of stored pairs under the name that the profile has for them, without regard to case."""
    known = table(spark, directory, "column_profile").select("database_id", "column_name").where("column_name is not null")
    asked = table(spark, directory, "similar_column_pair").where("database_id is not null and column_a is not null").select(F.lower("database_id").alias("database_id"), F.col("column_a").alias("column_name")).distinct()
    return match.resolve_names(asked, known, ["database_id"], "column_name")


_PLAIN = "regexp_replace(lower({0}), '[^a-z0-9_]', '', 'g')"


@query(f"""with k as (select distinct lower(database_id) as database_id, column_name as known_name, {_PLAIN.format('column_name')} as q from column_profile where column_name is not null),
  a as (select distinct lower(database_id) as database_id, column_a as column_name, {_PLAIN.format('column_a')} as p from similar_column_pair where column_a is not null and database_id is not null),
  r as (select database_id, column_name, known_name, round(case when p = q then 1.0 else 1 - levenshtein(p, q) / greatest(length(p), length(q), 1) end, 6) as ratio from a join k using (database_id))
  select * from r where ratio >= 0.8 qualify row_number() over (partition by database_id, column_name order by ratio desc, known_name) = 1""")
def closest_names(spark: SparkSession, directory: str) -> DataFrame:
    low = lambda n, c: table(spark, directory, n).where(f"{c} is not null and database_id is not null").select(F.lower("database_id").alias("database_id"), F.col(c).alias("column_name"))
    return match.closest_names(low("similar_column_pair", "column_a"), low("column_profile", "column_name"), "database_id", "column_name")


@query(f"select least(a, b) as a, greatest(a, b) as b, {mean_sql('score')} as mean_score, count(*) as details from {mq.PAIR_SQL} where a <> b group by least(a, b), greatest(a, b)")
def pair_means(spark: SparkSession, directory: str) -> DataFrame:
    """Each unordered pair of columns with the mean of its scores."""
    p = mq._pairs(spark, directory).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return p.groupBy("a", "b").agg(mean("score").alias("mean_score"), F.count("*").alias("details"))


_GROUPS = f"""e as (select distinct a, b from {mq.PAIR_SQL} where a <> b), s as (select a, b from e union select b, a from e), r(k, m) as (select a, a from s union select s.b, r.m from r join s on s.a = r.k), g as (select k, min(m) as group_key from r group by k)"""


@query(f"with recursive {_GROUPS} select group_key, count(*) as size from g group by all having count(*) >= 5")
def large_clusters(spark: SparkSession, directory: str) -> DataFrame:
    return match.clusters(graph.column_groups(spark, mq._pairs(spark, directory).select("a", "b")), 5)


@query(f"with recursive {_GROUPS}, q as (select distinct a from {mq.PAIR_SQL} p join similar_column_pair t on p.a = lower(trim(t.database_id || '.' || t.table_a || '.' || t.column_a)) where t.pair_id % 100 = 0) select x.k as key, y.k as similar from q join g x on x.k = q.a join g y using (group_key) where x.k <> y.k")
def similar_columns(spark: SparkSession, directory: str) -> DataFrame:
    """The columns grouped with those of every hundredth stored pair."""
    groups = graph.column_groups(spark, mq._pairs(spark, directory).select("a", "b"))
    key = F.lower(F.trim(F.concat_ws(".", "database_id", "table_a", "column_a")))
    asked = table(spark, directory, "similar_column_pair").where("pair_id % 100 = 0 and database_id is not null and table_a is not null and column_a is not null and column_b is not null").select(key.alias("key")).distinct()
    return match.similar_columns(groups, asked)


@query(f"""with k as (select distinct lower(trim(database_id || '.' || table_name || '.' || column_name)) as column_key from column_profile)
  select column_key from k where column_key is not null and column_key not in (select a from {mq.PAIR_SQL} where a is not null union select b from {mq.PAIR_SQL} where b is not null)""")
def unique_columns(spark: SparkSession, directory: str) -> DataFrame:
    """Profiled columns that no stored pair names."""
    key = F.lower(F.trim(F.concat("database_id", F.lit("."), "table_name", F.lit("."), "column_name")))
    columns = table(spark, directory, "column_profile").select(key.alias("column_key")).where("column_key is not null").distinct()
    return store.unique_columns(columns, mq._pairs(spark, directory).select("a", "b"))


_KEY_PAIRS = " union all ".join(f"select '{t}.{k}' as k, '{t}.{c}' as x" for t, ks in catalog.PRIMARY_KEYS if t in pq.COLUMNS for k in ks for c in pq.COLUMNS[t] if c != k)
_FK_PAIRS = " union all ".join(f"select '{t}.{c[0]}', '{tt}.{cc[0]}'" for t, c, tt, cc in catalog.FOREIGN_KEYS)


@query(f"select distinct least(k, x) as a, greatest(k, x) as b from ({_KEY_PAIRS} union all {_FK_PAIRS})")
def collision_exclusions(spark: SparkSession, directory: str) -> DataFrame:
    columns = catalog.columns_frame(spark, pq.load(spark, directory))
    return match.exclusions(columns, catalog.primary_keys_frame(spark), catalog.foreign_keys_frame(spark))


@query(f"with {sq.VALID} select question, representative as candidate from s qualify row_number() over (partition by question order by group_size desc, representative) = 1")
def best_candidate(spark: SparkSession, directory: str) -> DataFrame:
    """The first candidate of the largest group of each question."""
    groups = select.consensus(sq.candidates(spark, directory))
    return groups.groupBy("question").agg(F.max_by("representative", F.struct("group_size", -F.col("representative"))).alias("candidate"))


@query("select query_id from (select query_id, row_number() over (partition by lower(db_id) order by query_id) as r, count(*) over (partition by lower(db_id)) as n from nl2sql_query) where r <= floor(n * 25 / 100)")
def first_share(spark: SparkSession, directory: str) -> DataFrame:
    """The first quarter of each database's questions."""
    rows = table(spark, directory, "nl2sql_query").select("query_id", F.lower("db_id").alias("db"))
    counts = rows.groupBy("db").agg(F.count("*").alias("n")).withColumnRenamed("db", "g")
    got = memory.ranked(rows, "db", "query_id").join(counts, F.col("db").eqNullSafe(F.col("g")))
    return got.where(F.col("_r") <= F.floor(F.col("n") * 25 / 100)).select("query_id")


def _store(spark: SparkSession, directory: str) -> DataFrame:
    """The metadata of all databases, columns and join candidates as writes."""
    d = table(spark, directory, "database_metadata").where("database_id is not null")
    out = store.writes(d, "database", store.entity(F.col("database_id")), "manual", F.lit(1))
    c = table(spark, directory, "column_profile").where("database_id is not null and table_name is not null and column_name is not null")
    c = c.withColumns({"null_count": F.col("value_statistics.null_count"), "distinct_count": F.col("value_statistics.distinct_count")})
    source = F.when(F.col("load_no") % 2 == 0, "ddl").otherwise("llm")
    return out.union(store.writes(c, "column", store.entity(*[F.col(x) for x in ("database_id", "table_name", "column_name")]), source, F.col("column_id") * 1000 + F.col("load_no")))


_COLS = "select lower(trim(database_id)) || '.' || lower(trim(table_name)) || '.' || lower(trim(column_name)) as entity, column_id * 1000 + load_no as seq, data_type, value_statistics.null_count as nulls, value_statistics.distinct_count as distincts from column_profile where database_id is not null and table_name is not null and column_name is not null"


@query(f"""with c as ({_COLS}) select entity, arg_max(nulls, seq) filter (nulls is not null)::varchar as null_count, arg_max(distincts, seq) filter (distincts is not null)::varchar as distinct_count from c group by all having count(nulls) + count(distincts) > 0""")
def metadata_projection(spark: SparkSession, directory: str) -> DataFrame:
    """The counts that the store now holds for each column."""
    return store.project(store.current(_store(spark, directory)), "column", ["null_count", "distinct_count"])


@query("select 'database' as kind, count(description) + count(domain) + count(total_tables) + count(total_rows) as fields from database_metadata where database_id is not null")
def metadata_after_clearing(spark: SparkSession, directory: str) -> DataFrame:
    """Fields per kind after the types and both counts of all columns are cleared."""
    s = _store(spark, directory)
    for f in ("data_type", "null_count", "distinct_count"):
        s = store.clear(s, "column", f)
    return store.current(s).groupBy("kind").agg(F.count("*").alias("fields"))


@query("""select lower(trim(source_table)) || '(' || lower(trim(source_column)) || ')->' || lower(trim(target_table)) || '(' || lower(trim(target_column)) || ')' as entity, arg_max(similarity_score, candidate_id) filter (similarity_score is not null) as score, count(*) as writes
  from join_candidate where source_table is not null and source_column is not null and target_table is not null and target_column is not null group by entity""")
def relationship_upsert(spark: SparkSession, directory: str) -> DataFrame:
    """Join candidates as relationships by tables and columns: the last score that is not null counts."""
    j = table(spark, directory, "join_candidate").where("source_table is not null and source_column is not null and target_table is not null and target_column is not null")
    key = store.relationship_entity(F.col("source_table"), F.array("source_column"), F.col("target_table"), F.array("target_column"))
    last = F.max_by("similarity_score", F.when(F.col("similarity_score").isNotNull(), F.col("candidate_id")))
    return j.groupBy(key.alias("entity")).agg(last.alias("score"), F.count("*").alias("writes"))
