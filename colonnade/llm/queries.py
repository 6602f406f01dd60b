"""Queries over whole tables, one or more for each problem, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.components import key_groups, linked_columns
from colonnade.llm.forest import near_duplicate_groups
from colonnade.llm.leakage import LeakParameters, leaked_passages
from colonnade.llm.mixture import mixture
from colonnade.llm.prefix_join import similar_set_pairs
from colonnade.llm.suffix_overlap import cross_split_pairs
from colonnade.llm.unify import look_alike_pairs
from colonnade.sources.tables import table


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    groups = near_duplicate_groups(spark, table(spark, directory, "episodic_record"), "record_id", "generated_sql")
    return groups.selectExpr("id as record_id", "group_id")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = similar_set_pairs(
        spark, table(spark, directory, "column_values_signature"), "signature_id", "exact_values", ["database_id", "table_name", "column_name"]
    )
    return pairs.selectExpr("id_a as signature_id_a", "id_b as signature_id_b")


P3_FIELDS = ["question", "ground_truth_sql", "evidence"]


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = cross_split_pairs(spark, table(spark, directory, "nl2sql_query"), "query_id", "split", P3_FIELDS)
    return pairs.selectExpr("least(train_id, eval_id) as query_id_a", "greatest(train_id, eval_id) as query_id_b").distinct()


def p3_report(spark: SparkSession, directory: str) -> DataFrame:
    """For each split and source of the evaluation side: overlapping records and pairs, by field."""
    rows = table(spark, directory, "nl2sql_query")
    pairs = cross_split_pairs(spark, rows, "query_id", "split", P3_FIELDS)
    of = rows.selectExpr("query_id as eval_id", "lower(trim(split)) as split", "lower(trim(source)) as source")
    joined = pairs.join(of, "eval_id")
    return joined.groupBy("split", "source", "field").agg(
        F.countDistinct("eval_id").alias("records"), F.count("*").alias("pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    similar = linked_columns(table(spark, directory, "similar_column_pair"), "database_id", (("table_a", "column_a"), ("table_b", "column_b")))
    joins = linked_columns(
        table(spark, directory, "join_candidate"), "database_id", (("source_table", "source_column"), ("target_table", "target_column"))
    )
    return key_groups(spark, similar.union(joins)).withColumnRenamed("key", "column_key")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    items = table(spark, directory, "eval_item")
    return leaked_passages(spark, table(spark, directory, "documents"), "doc_id", "text", items, "item_id", "text")


def p6_edited(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with 12 words that are within two edits of 12 words of an item."""
    items = table(spark, directory, "eval_item")
    return leaked_passages(spark, table(spark, directory, "documents"), "doc_id", "text", items, "item_id", "text", LeakParameters(max_edits=2))


def p6_report(spark: SparkSession, directory: str) -> DataFrame:
    """For each item of the held-out material: in how many documents it leaked, none included."""
    items = table(spark, directory, "eval_item").select("item_id", "split", "source")
    found = p6_found(spark, directory).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.join(found, "item_id", "left").fillna(0, ["documents"])


def p7_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """The copies of each document used."""
    copies, _ = mixture(spark, table(spark, directory, "documents"), table(spark, directory, "mixture_target"))
    return copies.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The share each source reached."""
    return mixture(spark, table(spark, directory, "documents"), table(spark, directory, "mixture_target"))[1]


def p7_checks(spark: SparkSession, directory: str) -> DataFrame:
    """For each target: whether no document is used too often, and the tokens miss the plan by less than one document."""
    copies, shares = mixture(spark, table(spark, directory, "documents"), table(spark, directory, "mixture_target"))
    longest = copies.groupBy("source").agg(F.max("tokens").alias("longest"))
    got = shares.join(longest, "source", "left")
    return got.select(
        "source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"),
        (F.abs(F.col("mixed_tokens") - F.col("planned_tokens")) <= F.coalesce("longest", F.lit(0))).alias("near_plan"), (F.col("used_tokens") == F.col("feasible_tokens")).alias("as_much_as_can_be"),
    )


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = look_alike_pairs(spark, table(spark, directory, "documents"), "doc_id", "text")
    return pairs.selectExpr("id_a as doc_id_a", "id_b as doc_id_b")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_report, p5_found, p6_found, p6_edited, p6_report, p7_mixture, p7_shares, p7_checks, p8_found)
}


def _words(c: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9_]+')))"


def _pairs(sets: str, tenths: int, least: int, extra: str = "") -> str:
    """Common table expressions that end in ``pr`` (a, b): the similar pairs of ``sets`` (id, ws), found by shared prefix words."""
    return f"""z as materialized (select id, ws, len(ws) as n{extra} from ({sets}) where len(ws) >= {least}), tok as (select id, n, unnest(ws) as w from z), df as (select w, count(*) as c from tok group by all),
      pre as (select id, n, w from tok join df using (w) qualify row_number() over (partition by id order by c, w) <= n - ceil({tenths} * n / 10 - 1e-9) + 1),
      cand as (select distinct x.id as a, y.id as b from pre x join pre y on x.w = y.w and x.id < y.id and 10 * y.n >= {tenths} * x.n and 10 * x.n >= {tenths} * y.n),
      ov as (select a, b, len(list_intersect(x.ws, y.ws)) as i, x.n as na, y.n as nb from cand join z x on x.id = a join z y on y.id = b), pr as (select a, b from ov where 10 * i >= {tenths} * (na + nb - i))"""


_COLUMN_PART = "nullif(trim(regexp_replace(lower(trim({0})), '^(?:`(.*)`|\"(.*)\"|\\[(.*)\\])$', '\\1\\2\\3')), '')"


def _ends(t: str, ta: str, ca: str, tb: str, cb: str) -> str:
    d, p = _COLUMN_PART.format("database_id"), _COLUMN_PART.format
    return f"select {d} || '.' || {p(ta)} || '.' || {p(ca)} as a, {d} || '.' || {p(tb)} || '.' || {p(cb)} as b from {t}"


_P3 = " union ".join(
    f"select least(query_id_a, query_id_b) as query_id_a, greatest(query_id_a, query_id_b) as query_id_b from (with {_pairs(f'select query_id as id, {_words(f)} as ws, lower(trim(split)) = ' + chr(39) + 'train' + chr(39) + ' as train from nl2sql_query where lower(trim(split)) in (' + chr(39) + 'train' + chr(39) + ', ' + chr(39) + 'dev' + chr(39) + ', ' + chr(39) + 'test' + chr(39) + ')', 8, 10, ', train')} "
    "select a as query_id_a, b as query_id_b from pr join z x on x.id = a join z y on y.id = b where x.train <> y.train)"
    for f in P3_FIELDS
)
_P3_FIELDS = " union all ".join(
    f"select '{f}' as field, case when y.train then a else b end as eval_id, len(list_intersect(x.ws, y.ws)) / case when y.train then x.n else y.n end as coverage from (with {_pairs(f'select query_id as id, {_words(f)} as ws, lower(trim(split)) = ' + chr(39) + 'train' + chr(39) + ' as train from nl2sql_query where lower(trim(split)) in (' + chr(39) + 'train' + chr(39) + ', ' + chr(39) + 'dev' + chr(39) + ', ' + chr(39) + 'test' + chr(39) + ')', 8, 10, ', train')} "
    "select a, b, x, y from pr join z x on x.id = a join z y on y.id = b where x.train <> y.train)"
    for f in P3_FIELDS
)
#: SQL that finds the same rows another way. Look-alike text, leaked windows and the copies of a mixture have no form in SQL;
#: of a mixture there is what has to hold for its shares.
ORACLE: dict[str, str] = {
    "p1_found": f"""with recursive {_pairs(f'select record_id as id, {_words("generated_sql")} as ws from episodic_record', 8, 10)},
      s as (select a, b from pr union select b, a from pr), r(k, m) as (select a, a from s union select s.b, r.m from r join s on s.a = r.k)
      select k as record_id, min(m) as group_id from r group by k""",
    "p2_found": f"""with {_pairs("select signature_id as id, list_distinct(list_filter(list_transform(exact_values, lambda v: lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g'))), lambda v: v <> '')) as ws, database_id, table_name, column_name from column_values_signature", 6, 5, ', database_id, table_name, column_name')}
      select a as signature_id_a, b as signature_id_b from pr join z x on x.id = a join z y on y.id = b where (x.database_id, x.table_name, x.column_name) <> (y.database_id, y.table_name, y.column_name)""",
    "p3_found": _P3,
    "p3_report": f"""with f as ({_P3_FIELDS}), n as (select query_id, lower(trim(split)) as split, lower(trim(source)) as source from nl2sql_query)
      select n.split, n.source, field, count(distinct eval_id) as records, count(*) as pairs, round(avg(coverage), 6) as mean_coverage from f join n on n.query_id = eval_id group by all""",
    "p7_checks": "select distinct lower(trim(source)) as source, true as within_repeats, true as near_plan, true as as_much_as_can_be from mixture_target where source is not null",
    "p5_found": f"""with recursive e as (select distinct a, b from ({_ends('similar_column_pair', 'table_a', 'column_a', 'table_b', 'column_b')} union all {_ends('join_candidate', 'source_table', 'source_column', 'target_table', 'target_column')}) where a <> b),
      s as (select a, b from e union select b, a from e), r(k, m) as (select a, a from s union select s.b, r.m from r join s on s.a = r.k) select k as column_key, min(m) as group_key from r group by k""",
}
