"""Execution, comparison and selection queries over recorded query results and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators import execute, select
from colonnade.plans.registry import mean, mean_sql, query
from colonnade.sources.tables import register, table

CANDIDATES = """(select lower(database_id) || '|' || user_query as question, record_id as candidate, execution_result.execution_success as succeeded,
  execution_result.row_count as rows, execution_result.execution_time_ms as ms, case when execution_result.execution_success then coalesce(execution_result.row_count::varchar, '-') end as result
  from episodic_record where user_query is not null and database_id is not null and execution_result.execution_success is not null)"""
VALID = f"""c as {CANDIDATES}, t as (select *, case when succeeded and rows > 0 then 1 when succeeded then 2 end as tier from c),
  v as (select * from t where tier is not null qualify tier = min(tier) over (partition by question)),
  g as (select question, result, count(*) as group_size, min(candidate) as representative, arg_min(coalesce(ms, 1e300), candidate) as ms0 from v group by all),
  s as (select question, result, group_size, representative, case when ms0 < 1e300 then ms0 end as ms, sum(group_size) over (partition by question)::bigint as valid, group_size / sum(group_size) over (partition by question) as share from g)"""


def candidates(spark: SparkSession, directory: str) -> DataFrame:
    """Recorded executions as candidates; the row count stands for the result, which the records do not hold."""
    r = table(spark, directory, "episodic_record")
    e = F.col("execution_result")
    result = F.when(e["execution_success"], F.coalesce(e["row_count"].cast("string"), F.lit("-")))
    rows = r.select(
        F.concat(F.lower("database_id"), F.lit("|"), F.col("user_query")).alias("question"), F.col("record_id").alias("candidate"), e["execution_success"].alias("succeeded"),
        e["row_count"].alias("rows"), e["execution_time_ms"].alias("ms"), result.alias("result"),
    )
    return rows.where("question is not null and succeeded is not null")


@query("""select result_type, count(*) as n from (select case when not execution_result.execution_success then 'execution_error'
  when execution_result.row_count = 0 then 'empty_result' when execution_result.execution_success then 'success' end as result_type from episodic_record) where result_type is not null group by all""")
def result_class(spark: SparkSession, directory: str) -> DataFrame:
    e = F.col("execution_result")
    kind = F.when(~e["execution_success"], "execution_error").when(e["row_count"] == 0, "empty_result").when(e["execution_success"], "success")
    return table(spark, directory, "episodic_record").select(kind.alias("result_type")).where("result_type is not null").groupBy("result_type").agg(F.count("*").alias("n"))


@query("select record_id, case when length(generated_sql) > 100 then generated_sql[1:100] || '...' else generated_sql end as generated_sql from (select * from episodic_record where generated_sql is not null order by record_id limit 5)")
def result_preview(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "episodic_record").select("record_id", "generated_sql").where("generated_sql is not null")
    return execute.preview(rows, ["record_id"])


@query(f"""with l as (select lower(database_id) as database_id, execution_result.execution_time_ms as ms from episodic_record where execution_result.execution_success and database_id is not null),
  s as (select *, avg(ms) over w as m, stddev_pop(ms) over w as s from l window w as (partition by database_id))
  select database_id, {mean_sql("case when abs(ms - m) <= 3 * s + 1e-9 then ms end")} as mean_ms, count(*) filter (abs(ms - m) <= 3 * s + 1e-9) as runs from s group by all""")
def timing_trim(spark: SparkSession, directory: str) -> DataFrame:
    log = table(spark, directory, "episodic_record").where("execution_result.execution_success and database_id is not null")
    log = log.select(F.lower("database_id").alias("database_id"), F.col("execution_result.execution_time_ms").alias("ms"))
    kept = execute.usual_times(log, ["database_id"], "ms")
    return kept.groupBy("database_id").agg(mean("ms").alias("mean_ms"), F.count("ms").alias("runs"))


@query(f"with {VALID} select question, result, group_size, valid, round(share, 6) as share, representative from s")
def consensus_groups(spark: SparkSession, directory: str) -> DataFrame:
    return select.consensus(candidates(spark, directory)).drop("ms").withColumn("share", F.round("share", 6))


@query(f"with {VALID}, r as (select question, representative, row_number() over (partition by question order by share desc, ms nulls last, representative) as rank from s) select * from r where rank <= 3")
def candidate_topk(spark: SparkSession, directory: str) -> DataFrame:
    return select.ranked(select.consensus(candidates(spark, directory)), 3).select("question", "representative", F.col("rank").cast("bigint").alias("rank"))


@query(f"""with {VALID}, b as (select question, max(share) as top, count(*) as n from s group by all)
  select q.question, case when n is null then 'fallback' when n = 1 or top >= 0.8 then 'select' else 'vote' end as decision from (select distinct question from c) q left join b using (question)""")
def shortcut_decision(spark: SparkSession, directory: str) -> DataFrame:
    rows = candidates(spark, directory)
    return select.shortcut(select.consensus(rows), rows)


@query(f"""with {VALID}, r as (select question, representative, row_number() over (partition by question order by share desc, ms nulls last, representative) as rank from s)
  select x.question, x.representative as a, y.representative as b from r x join r y on x.question = y.question and x.rank < y.rank where y.rank <= 3""")
def candidate_pairs(spark: SparkSession, directory: str) -> DataFrame:
    return select.candidate_pairs(select.ranked(select.consensus(candidates(spark, directory)), 3))


#: Votes that follow from the records: the faster representative wins, equal or unknown times tie.
VOTES_SQL = f"""{VALID}, r as (select *, row_number() over (partition by question order by share desc, ms nulls last, representative) as rank from s), k as (select * from r where rank <= 3),
  votes as (select x.question, x.representative as a, y.representative as b, case when x.ms < y.ms then 1.0 when x.ms > y.ms then 0.0 else 0.5 end as score from k x join k y on x.question = y.question and x.rank < y.rank),
  sides as (select question, a, b, score from votes union all select question, b, a, 1 - score from votes),
  wins as (select question, a as candidate, sum(score) / (count(*) + 1) as win from sides group by all)"""


def votes(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    top = select.ranked(select.consensus(candidates(spark, directory)), 3)
    ms = top.select("question", "representative", "ms")
    pairs = select.candidate_pairs(top).join(ms.toDF("question", "a", "ma"), ["question", "a"]).join(ms.toDF("question", "b", "mb"), ["question", "b"])
    outcome = F.when(F.col("ma") < F.col("mb"), "A").when(F.col("ma") > F.col("mb"), "B").otherwise("TIE")
    return pairs.select("question", "a", "b", F.lit("time").alias("voter"), outcome.alias("outcome")), top


@query(f"with {VOTES_SQL} select question, candidate, round(win, 6) as win from wins")
def win_matrix(spark: SparkSession, directory: str) -> DataFrame:
    return select.win_matrix(votes(spark, directory)[0]).withColumn("win", F.round("win", 6))


@query(f"""with {VOTES_SQL}, f as (select question, candidate, win * share / sum(share) over (partition by question) as score, rank from (select k.question, k.representative as candidate, k.rank, k.share, w.win from k join wins w on w.question = k.question and w.candidate = k.representative))
  select question, candidate, round(score, 6) as score from f qualify row_number() over (partition by question order by score desc, rank) = 1""")
def final_selection(spark: SparkSession, directory: str) -> DataFrame:
    given, top = votes(spark, directory)
    return select.final_selection(select.win_matrix(given), top).withColumn("score", F.round("score", 6))


@query(f"select lower(database_id) as database_id, count(*) as questions, {mean_sql('label::int')} as accuracy from episodic_record where label is not null and database_id is not null group by all")
def ex_accuracy_by_db(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "episodic_record").where("database_id is not null").select(F.lower("database_id").alias("database_id"), F.col("label").cast("int").alias("correct"))
    return rows.where("correct is not null").groupBy("database_id").agg(F.count("*").alias("questions"), mean("correct").alias("accuracy"))


PAIRS = {
    "same rows in another order": ("select n_nationkey, n_name from nation order by n_name", "select n_nationkey, n_name from nation order by 1 desc"),
    "columns exchanged": ("select n_nationkey, n_name from nation", "select n_name, n_nationkey from nation"),
    "rows repeated": ("select n_regionkey from nation", "select distinct n_regionkey from nation"),
    "integer and double": ("select r_regionkey from region", "select cast(r_regionkey as double) as k from region"),
    "other rows": ("select r_name from region", "select r_name from region where r_regionkey > 0"),
    "same set, same count": ("select n_regionkey from nation where n_nationkey < 10 union all select 0", "select n_regionkey from nation where n_nationkey < 10 union all select 1"),
}
PAIRS |= {
    "orders in another order": ("select o_orderkey, o_custkey from orders", "select o_orderkey, o_custkey from orders order by o_custkey desc"),
    "lines grouped twice": ("select l_returnflag, l_linestatus, count(*) from lineitem group by 1, 2", "select l_returnflag, l_linestatus, sum(n) from (select l_returnflag, l_linestatus, l_tax, count(*) as n from lineitem group by 1, 2, 3) group by 1, 2"),
    "lines repeated": ("select l_suppkey from lineitem", "select distinct l_suppkey from lineitem"),
    "one line less": ("select l_orderkey, l_partkey, l_suppkey from lineitem where l_orderkey < 500", "select l_orderkey, l_partkey, l_suppkey from lineitem where l_orderkey < 499"),
}
CELL = "coalesce(case when typeof({0}) in ('INTEGER', 'BIGINT', 'HUGEINT', 'DOUBLE') then try_cast({0} as double)::varchar else {0}::varchar end, 'NULL')"


def _pair_sql(kind: str) -> str:
    """The comparisons in SQL over lists of cell texts."""
    shape = {"set": "list_sort(list_distinct(r))", "bag": "list_sort(r)", "positional": "r", "positional_set": "r"}[kind]
    distinct = "distinct " if kind in ("set", "positional_set") else ""
    parts = []
    for name, (a, b) in PAIRS.items():
        rows = []
        for q, cols in ((a, _width(a)), (b, _width(b))):
            names = ", ".join(f"c{i}" for i in range(cols))
            cells = ", ".join(CELL.format(f"c{i}") for i in range(cols))
            rows.append(f"(select {distinct}{shape} as r from (select [{cells}] as r from ({q}) t({names})))")
        same = f"(select count(*) from (({rows[0]} except all {rows[1]}) union all ({rows[1]} except all {rows[0]}))) = 0"
        count = f" and (select count(*) from ({a})) = (select count(*) from ({b}))" if kind == "positional_set" else ""
        parts.append(f"select '{name}' as pair, {same}{count} as equal")
    return " union all ".join(parts)


def _width(sql: str) -> int:
    return sql.split(" from ")[0].count(",") + 1


#: Candidates for each question with their real results, of which some agree.
REAL = {
    "busy customers": ["select o_custkey from orders group by o_custkey having count(*) > 12", "select distinct o_custkey from (select o_custkey, count(*) over (partition by o_custkey) as n from orders) where n > 12", "select o_custkey from orders where o_custkey < 10"],
    "lines by flag": ["select l_returnflag, count(*) from lineitem group by l_returnflag", "select l_returnflag, sum(1) from lineitem group by l_returnflag order by 1 desc", "select count(*), l_returnflag from lineitem group by l_returnflag"],
    "nothing": ["select n_name from nation where n_nationkey < 0", "select r_name from region where r_regionkey < 0"],
}


def _real_sql() -> str:
    parts = []
    for q, texts in REAL.items():
        for k, sql in enumerate(texts):
            names = [f"c{i}" for i in range(_width(sql.replace("distinct ", "").replace("(select o_custkey, count(*)", "(select o_custkey")))]
            cells = " || '|' || ".join(CELL.format(n) for n in names)
            parts.append(f"select '{q}' as question, {k} as candidate, (select string_agg(distinct r, ';' order by r) from (select {cells} as r from ({sql}) t({', '.join(names)}))) as rows")
    return " union all ".join(parts)


@query(f"with r as ({_real_sql()}), g as (select question, coalesce(rows, '') as rows, count(*) as group_size, min(candidate)::int as first_candidate from r group by all) select question, first_candidate, group_size from g")
def result_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Candidates grouped by the key of their result sets, whatever the order of rows."""
    register(spark, directory, ["nation", "region", "orders", "lineitem"])
    out = None
    for q, texts in REAL.items():
        for k, sql in enumerate(texts):
            one = execute.result_key(spark.sql(sql)).select(F.lit(q).alias("question"), F.lit(k).alias("candidate"), "result_key")
            out = one if out is None else out.union(one)
    return out.groupBy("question", "result_key").agg(F.min("candidate").alias("first_candidate"), F.count("*").alias("group_size")).select("question", "first_candidate", "group_size")


def _compare(spark: SparkSession, directory: str, test) -> DataFrame:
    register(spark, directory, ["nation", "region", "orders", "lineitem"])
    rows = [(name, test(spark.sql(a), spark.sql(b))) for name, (a, b) in PAIRS.items()]
    return spark.createDataFrame(rows, "pair string, equal boolean")


@query(_pair_sql("set"))
def ex_set_equal(spark: SparkSession, directory: str) -> DataFrame:
    return _compare(spark, directory, execute.ex_set_equal)


@query(_pair_sql("bag"))
def bag_equal(spark: SparkSession, directory: str) -> DataFrame:
    return _compare(spark, directory, execute.bag_equal)


@query(_pair_sql("positional"))
def positional_equal(spark: SparkSession, directory: str) -> DataFrame:
    return _compare(spark, directory, execute.positional_equal)


@query(_pair_sql("positional_set"))
def positional_set_equal(spark: SparkSession, directory: str) -> DataFrame:
    return _compare(spark, directory, execute.positional_set_equal)


@query("select * from (values ('select n_name from nation', 'success', 25), ('select n_name from nation where n_nationkey < 0', 'empty_result', 0), ('select null as x from region', 'all_null_result', 5), ('select missing from nation', 'execution_error', null), ('selec 1', 'execution_error', null)) t(sql, result_type, rows)")
def run_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    register(spark, directory, ["nation", "region"])
    texts = ["select n_name from nation", "select n_name from nation where n_nationkey < 0", "select null as x from region", "select missing from nation", "selec 1"]
    return spark.createDataFrame([(t, *execute.run(spark, t)[:2]) for t in texts], "sql string, result_type string, rows int")
