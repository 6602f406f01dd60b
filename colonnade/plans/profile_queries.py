"""Catalog and profiling queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.operators import catalog, profile
from colonnade.plans.registry import query
from colonnade.sources.tables import table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
#: All columns of the tables with their type families.
FAMILIES = {
    "region": {"r_regionkey": "number", "r_name": "text"},
    "nation": {"n_nationkey": "number", "n_name": "text", "n_regionkey": "number"},
    "customer": {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"},
    "supplier": {"s_suppkey": "number", "s_name": "text", "s_nationkey": "number", "s_acctbal": "number"},
    "part": {"p_partkey": "number", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "p_retailprice": "number"},
    "orders": {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "text", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text"},
    "lineitem": {
        "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number",
        "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
    "events": {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"},
}
DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
COLUMNS = {t: list(cs) for t, cs in FAMILIES.items()}
FAMILY_SQL = "case " + " ".join(f"when column_name in ({', '.join(repr(c) for cs in FAMILIES.values() for c, f in cs.items() if f == kind)}) then '{kind}'" for kind in ("number", "time")) + " else 'text' end"


def _end(f: str, c: str) -> str:
    return f"({f}({c}) + 0.0)::varchar" if c in DOUBLES else f"{f}({c})::varchar"


def load(spark: SparkSession, directory: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: table(spark, directory, n) for n in names}


def cells(spark: SparkSession, directory: str, columns=None) -> DataFrame:
    columns = columns or COLUMNS
    return profile.cells(load(spark, directory, columns), columns)


def cells_sql(columns=None) -> str:
    """The cells as SQL."""
    parts = [f"select '{t}' as table_name, '{c}' as column_name, {c}::varchar as value from {t}" for t, cs in (columns or COLUMNS).items() for c in cs]
    return "(" + " union all ".join(parts) + ")"


TEXT_COLUMNS = {t: k for t, cs in FAMILIES.items() if (k := [c for c, f in cs.items() if f == "text"])}
CELLS, TEXTS = cells_sql(), cells_sql(TEXT_COLUMNS)


@query(
    "with t as ("
    + " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES)
    + ") select * from t union all select '(all)', sum(row_count)::bigint from t"
)
def table_counts(spark: SparkSession, directory: str) -> DataFrame:
    return profile.table_counts(load(spark, directory))


@query(
    " union all ".join(
        f"select '{t}' as table_name, column_name, (row_number() over () - 1)::int as ordinal from (describe select * from {t})" for t in TABLES
    )
)
def table_columns(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.columns_frame(spark, load(spark, directory)).select("table_name", "column_name", "ordinal")


@query(f"select table_name, column_name, count(value) as total_count, count(distinct value) as distinct_count, count(*) - count(value) as null_count from {CELLS} group by all")
def column_stats(spark: SparkSession, directory: str) -> DataFrame:
    return profile.column_stats(cells(spark, directory))


@query(
    " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as total_count, count({c}) as non_null_count, count(*) - count({c}) as null_count, {_end('min', c)} as min_value, {_end('max', c)} as max_value from {t}"
        for t, cs in COLUMNS.items()
        for c in cs
    )
)
def column_profile(spark: SparkSession, directory: str) -> DataFrame:
    out = None
    for t, df in load(spark, directory).items():
        one = profile.basic_profile(t, df, COLUMNS[t])
        out = one if out is None else out.union(one)
    return out


@query(f"""select table_name, column_name, value, frequency, rank from (
  select *, row_number() over (partition by table_name, column_name order by frequency desc, value) as rank
  from (select table_name, column_name, value, count(*) as frequency from {CELLS} where value is not null group by all)) where rank <= 10""")
def column_topk(spark: SparkSession, directory: str) -> DataFrame:
    return profile.top_values(cells(spark, directory))


@query(f"""select table_name, column_name, min(length(value))::int as min_length, max(length(value))::int as max_length, round(avg(length(value)), 6) as avg_length
  from (select distinct * from {CELLS} where value is not null) group by all""")
def column_lengths(spark: SparkSession, directory: str) -> DataFrame:
    return profile.length_stats(cells(spark, directory)).withColumn("avg_length", F.round("avg_length", 6))


@query(f"""with d as (select distinct table_name, column_name, value from {TEXTS} where value <> ''),
  p as (select table_name, column_name, min(value) as lo, max(value) as hi, min(reverse(value)) as rlo, max(reverse(value)) as rhi from d group by all having count(*) >= 2),
  l as (select *, (select max(i) from range(0, 200) r(i) where i <= least(length(lo), length(hi)) and lo[1:i] = hi[1:i]) as a, (select max(i) from range(0, 200) r(i) where i <= least(length(rlo), length(rhi)) and rlo[1:i] = rhi[1:i]) as b from p)
  select table_name, column_name, case when a >= 3 then lo[1:a] end as fixed_prefix, case when b >= 3 then reverse(rlo[1:b]) end as fixed_suffix from l""")
def column_fixity(spark: SparkSession, directory: str) -> DataFrame:
    return profile.fixity(cells(spark, directory, TEXT_COLUMNS))


@query(f"""with s as (select table_name, column_name, count(*) as n, count(distinct value) as d from {CELLS} group by all)
  select table_name, column_name, case
    when n = 0 then 'Unknown'
    when {FAMILY_SQL} = 'time' then 'Datetime' when {FAMILY_SQL} = 'number' then case when d <= 20 then 'Categorical' when d / n > 0.95 then 'Identifier' else 'Numerical' end
    when d <= 100 and d / n < 0.6 then 'Categorical' when d / n > 0.95 then 'Identifier' else 'Free_Text' end as semantic_type from s""")
def column_semantic_type(spark: SparkSession, directory: str) -> DataFrame:
    tables = load(spark, directory)
    families = F.broadcast(catalog.columns_frame(spark, tables).select("table_name", "column_name", "family"))
    stats = profile.column_stats(profile.cells(tables, COLUMNS)).join(families, ["table_name", "column_name"])
    total = F.col("total_count") + F.col("null_count")
    return stats.select("table_name", "column_name", profile.semantic_type(F.col("family"), F.col("distinct_count"), total).alias("semantic_type"))


@query(f"""with s as (select table_name, column_name, count(*) as total, count(value) as non_null, count(distinct value) as distinct_count from {CELLS} group by all)
  select *, non_null = distinct_count and non_null > 0 as is_unique, round(case when non_null > 0 then 1 - distinct_count / non_null else 0 end, 4) as duplication_rate,
    non_null = distinct_count and non_null > 0 and non_null = total as can_be_pk, case when non_null > 0 then 1 - distinct_count / non_null else 0 end < 0.1 as can_be_join_key from s""")
def key_uniqueness(spark: SparkSession, directory: str) -> DataFrame:
    return profile.key_uniqueness(cells(spark, directory))


@query(f"""select table_name, column_name, value, rank from (select *, row_number() over (partition by table_name, column_name order by value) as rank
  from (select distinct * from {CELLS} where value <> '' and length(value) <= 100)) where rank <= 3""")
def value_examples(spark: SparkSession, directory: str) -> DataFrame:
    return profile.value_examples(cells(spark, directory))


@query(f"""with d as (select distinct * from {TEXTS} where value <> '' and length(value) <= 100),
  k as (select table_name, column_name from d group by all having not (bool_and(regexp_matches(value, '{profile.UUID}')) or bool_and(regexp_matches(value, '{profile.NUMBER}'))))
  select d.* from d join k using (table_name, column_name)""")
def text_value_domain(spark: SparkSession, directory: str) -> DataFrame:
    return profile.text_domain(cells(spark, directory, TEXT_COLUMNS))


@query("""select count(*) as rows, count(distinct l_suppkey) as suppliers, round(sum(l_quantity), 6) as quantity
  from (select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity limit 5000)""")
def prefix_sample_stats(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    first = profile.prefix_sample(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 5000)
    return first.agg(F.count("*").alias("rows"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 10 = 0")
def systematic_sample(spark: SparkSession, directory: str) -> DataFrame:
    return profile.systematic_sample(table(spark, directory, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 10)


@query(f"""select table_name, column_name, value from (select *, row_number() over (partition by table_name, column_name order by md5(value), value) as r
  from (select distinct * from {CELLS} where value is not null)) where r <= 20""")
def random_value_sample(spark: SparkSession, directory: str) -> DataFrame:
    return profile.random_values(cells(spark, directory), 20)


@query("""with c as (select 'documents' as table_name, 'lang' as column_name, lang as value from documents union all select 'documents', 'source', source from documents
    union all select 'nl2sql_query', 'evidence', evidence from nl2sql_query union all select 'nl2sql_query', 'split', split from nl2sql_query),
  r as (select table_name, column_name, avg(case when coalesce(lower(trim(value)), '') in ('', 'null') then 0 else 1 end) as r from c group by all)
  select table_name, column_name, round(r, 6) as filled_share, r >= 0.1 as useful from r""")
def column_usefulness(spark: SparkSession, directory: str) -> DataFrame:
    columns = {"documents": ["lang", "source"], "nl2sql_query": ["evidence", "split"]}
    return profile.usefulness(cells(spark, directory, columns))


@query(
    "select table_name, column_name, 'Column ' || column_name || ' of ' || table_name || ' has ' || n || ' rows and ' || d || ' distinct values.' "
    "|| case when n > k then ' ' || (n - k) || ' are null.' else '' end || case when lo is not null then ' It ranges from ' || lo || ' to ' || hi || '.' else '' end as description from ("
    + " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, count(*) as n, count({c}) as k, count(distinct {c}) as d, {_end('min', c)} as lo, {_end('max', c)} as hi from {t}"
        for t, cs in COLUMNS.items()
        for c in cs
    )
    + ")"
)
def column_description(spark: SparkSession, directory: str) -> DataFrame:
    tables = load(spark, directory)
    stats = profile.column_stats(cells(spark, directory)).select("table_name", "column_name", "distinct_count")
    basic = None
    for t, df in tables.items():
        one = profile.basic_profile(t, df, COLUMNS[t])
        basic = one if basic is None else basic.union(one)
    return profile.describe(basic.join(stats, ["table_name", "column_name"]))


FK_SQL = "(values " + ", ".join(f"({i}, '{t}', '{c[0]}', '{tt}', '{cc[0]}')" for i, (t, c, tt, cc) in enumerate(catalog.FOREIGN_KEYS)) + ") f(fk_id, table_name, column_name, target_table, target_column)"


@query(f"""select coalesce(o.table_name, i.table_name) as table_name, coalesce(out_degree, 0) as out_degree, coalesce(in_degree, 0) as in_degree from
  (select table_name, count(*) as out_degree from {FK_SQL} group by all) o full join (select target_table as table_name, count(*) as in_degree from {FK_SQL} group by all) i using (table_name)""")
def fk_topology(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.topology(catalog.foreign_keys_frame(spark))


@query("select * from (values ('customer', 'c_custkey'), ('customer', 'c_name'), ('customer', 'c_nationkey'), ('nation', 'n_name'), ('nation', 'n_nationkey'), ('orders', 'o_custkey'), ('orders', 'o_orderkey'), ('orders', 'o_totalprice')) t(table_name, column_name)")
def linked_schema_filter(spark: SparkSession, directory: str) -> DataFrame:
    """Columns linked to a question, with the keys that join their tables."""
    linked = spark.createDataFrame([("customer", "c_name"), ("nation", "n_name"), ("orders", "o_totalprice")], "table_name string, column_name string")
    columns = catalog.columns_frame(spark, load(spark, directory))
    got = catalog.filter_linked(columns, linked, catalog.primary_keys_frame(spark), catalog.foreign_keys_frame(spark))
    return got.select("table_name", "column_name")


@query(f"select table_name, column_name, target_table, target_column from {FK_SQL} where table_name in ('lineitem', 'orders', 'customer') and target_table in ('lineitem', 'orders', 'customer')")
def direct_joins(spark: SparkSession, directory: str) -> DataFrame:
    kept = spark.createDataFrame([("lineitem",), ("orders",), ("customer",)], "table_name string")
    return catalog.joins_between(catalog.foreign_keys_frame(spark), kept).select("table_name", "column_name", "target_table", "target_column")


STORED = [*TABLES, "documents", "embeddings", "episodic_record", "nl2sql_query", "column_values_signature", "column_profile", "cell_value", "similar_column_pair", "join_candidate", "database_metadata", "eval_item", "mixture_target"]


@query(f"""with c as ({" union all ".join(f"select '{t}' as t, column_name as c from (describe select * from {t})" for t in STORED)}),
  p as (select a.t as table_a, b.t as table_b, a.c as column_name, row_number() over (partition by a.t, b.t order by a.c) as r from c a join c b on lower(a.c) = lower(b.c) and a.t < b.t where lower(a.c) not in ('id', 'created_at', 'updated_at'))
  select table_a, table_b, column_name from p where r <= 5""")
def same_name_columns(spark: SparkSession, directory: str) -> DataFrame:
    return catalog.same_name_columns(catalog.columns_frame(spark, load(spark, directory, STORED)))


@query(f"""with c as ({" union all ".join(f"select '{t}' as table_name, column_name from (describe select * from {t})" for t in STORED)}), n as ({" union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in STORED)})
  select table_name, count(*) as columns, row_count from c join n using (table_name) group by all""")
def table_info(spark: SparkSession, directory: str) -> DataFrame:
    """Every stored table with its columns and rows; the tables are those the directory holds."""
    tables = {t: d for t, d in catalog.stored_tables(spark, directory).items() if t in STORED}
    counts = profile.table_counts(tables).where("table_name <> '(all)'")
    return catalog.columns_frame(spark, tables).groupBy("table_name").agg(F.count("*").alias("columns")).join(counts, "table_name")
