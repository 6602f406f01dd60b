"""Search queries: documents by every hundredth question, vectors by every hundredth vector, values by those of every hundredth row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.text import STOPWORDS
from colonnade.operators import retrieve
from colonnade.operators.keyword import Keywords
from colonnade.plans.profile_queries import COLUMNS, TEXTS, TEXT_COLUMNS, cells
from colonnade.plans.registry import query
from colonnade.sources.tables import table

STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({STOP_SQL}))"


BASE = f"""d as (select doc_id as doc, {tokens_sql('text')} as ts from documents where text is not null), q as (select query_id as query, list_distinct({tokens_sql('question')}) as ts from nl2sql_query where query_id % 100 = 0 and question is not null),
  p as (select doc, token, count(*) as tf from (select doc, unnest(ts) as token from d) group by all), df as (select token, count(*) as df from p group by all), l as (select doc, len(ts) as length from d),
  n as (select count(*) as n, avg(length) as mean from l), a as (select query, unnest(ts) as token from q)"""
BM25 = f"""{BASE}, bm as (select query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) as score from a join df using (token) join p using (token) join l using (doc), n group by all)"""
SPARSE = """w as (select doc, token, tf * ln(1 + n / df) as w from p join df using (token), n), u as (select doc, token, w / sqrt(sum(w * w) over (partition by doc)) as weight from w),
  qt as (select query, token, ln(1 + n / df) as w from a join df using (token), n), qu as (select query, token, w / sqrt(sum(w * w) over (partition by query)) as wq from qt),
  sp as (select query, doc, round(sum(wq * weight), 6) as score from qu join u using (token) group by all)"""


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "documents").where("text is not null").selectExpr("doc_id as doc", "text")


def questions(spark: SparkSession, directory: str) -> DataFrame:
    return table(spark, directory, "nl2sql_query").where("query_id % 100 = 0 and question is not null").selectExpr("query_id as query", "question as text")


def keywords(spark: SparkSession, directory: str, sparse: bool = False) -> Keywords:
    return Keywords(spark, documents(spark, directory), questions(spark, directory), sparse)


@query(f"with {BM25} select query, doc, score from bm where score > 0 qualify row_number() over (partition by query order by score desc, doc) <= 10")
def bm25_search(spark: SparkSession, directory: str) -> DataFrame:
    return keywords(spark, directory).top(10).drop("kind")


@query(f"with {BASE}, {SPARSE} select query, doc, score from sp qualify row_number() over (partition by query order by score desc, doc) <= 10")
def sparse_dot_search(spark: SparkSession, directory: str) -> DataFrame:
    return keywords(spark, directory, sparse=True).top(10, ("sparse",)).drop("kind")


@query("""select q.vec_id as query, d.vec_id as doc, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as score from embeddings q, embeddings d where q.vec_id % 100 = 0
  qualify row_number() over (partition by query order by score desc, doc) <= 10""")
def cosine_topk(spark: SparkSession, directory: str) -> DataFrame:
    e = table(spark, directory, "embeddings")
    docs = e.selectExpr("vec_id as doc", "embedding as vector")
    return retrieve.dense_search(spark, docs, e.where("vec_id % 100 = 0").selectExpr("vec_id as query", "embedding as vector"), 10).drop("rank")


#: (query, phrase): the texts of all rows with a key divisible by 100.
PHRASES_SQL = "(" + " union ".join(f"select '{t}.{c}.' || {COLUMNS[t][0]} as query, {c} as phrase from {t} where {COLUMNS[t][0]} % 100 = 0 and {c} is not null" for t, cs in TEXT_COLUMNS.items() for c in cs) + ") f"
INDEX_SQL = f"(select distinct lower(trim(value)) as norm, table_name, column_name, value from {TEXTS} where length(lower(trim(value))) >= 2)"


def phrases(spark: SparkSession, directory: str) -> DataFrame:
    """(query, phrase): the texts of all rows with a key divisible by 100; a query is a table, a column and a key."""
    out = None
    for t, columns in TEXT_COLUMNS.items():
        key = COLUMNS[t][0]
        each = [F.struct(F.concat_ws(".", F.lit(t), F.lit(c), F.col(key).cast("string")).alias("query"), F.col(c).alias("phrase")) for c in columns]
        one = table(spark, directory, t).where(F.col(key) % 100 == 0).select(F.inline(F.array(*each)))
        out = one if out is None else out.union(one)
    return out.where("phrase is not null").distinct()


def index(spark: SparkSession, directory: str) -> DataFrame:
    return retrieve.value_index(cells(spark, directory, TEXT_COLUMNS))


@query(f"select query, table_name, column_name, value, 1.0::double as score from {PHRASES_SQL} join {INDEX_SQL} on norm = lower(trim(phrase))")
def value_exact_match(spark: SparkSession, directory: str) -> DataFrame:
    return retrieve.exact_matches(index(spark, directory), phrases(spark, directory))


@query(f"""with m as (select query, table_name, column_name, value, least(length(norm), length(p)) / greatest(length(norm), length(p)) as ratio from (select query, lower(trim(phrase)) as p from {PHRASES_SQL} where length(lower(trim(phrase))) >= 3) join {INDEX_SQL}
    on length(norm) >= 3 and norm <> p and (contains(norm, p) or contains(p, norm)))
  select query, table_name, column_name, value, round(0.7 * ratio, 6) as score from m where ratio >= 0.4 qualify row_number() over (partition by query order by score desc, table_name, column_name, value) <= 20""")
def value_partial_match(spark: SparkSession, directory: str) -> DataFrame:
    return retrieve.partial_matches(index(spark, directory), phrases(spark, directory))


#: A hit counts as matched if its document is stored for the database that the question asks.
HITS = f"""{BM25}, {SPARSE}, m as (select query_id as query, doc_id as doc from nl2sql_query join documents on lower(db_id) = lower(database_id) where query_id % 100 = 0),
  b as (select * from bm where score > 0 qualify row_number() over (partition by query order by score desc, doc) <= 50), s as (select * from sp qualify row_number() over (partition by query order by score desc, doc) <= 50),
  h as (select *, 'bm25' as method from b union all select *, 'sparse' from s), k as (select *, row_number() over (partition by query, method order by score desc, doc) as rank from h),
  r as (select query, doc, sum(1 / (60 + rank)) as s from k group by all), f as (select r.query, r.doc, m.doc is not null as matched, round(s * case when m.doc is not null then 1.5 else 1 end, 8) as score from r left join m on m.query = r.query and m.doc = r.doc)"""


def fused(spark: SparkSession, directory: str) -> DataFrame:
    hits = keywords(spark, directory, sparse=True).top(50, ("bm25", "sparse")).withColumnRenamed("kind", "method")
    asked = table(spark, directory, "nl2sql_query").selectExpr("query_id as query", "lower(db_id) as qdb")
    stored = table(spark, directory, "documents").selectExpr("doc_id as doc", "lower(database_id) as ddb")
    hits = hits.join(asked, "query").join(stored, "doc").withColumn("matched", F.coalesce(F.col("qdb") == F.col("ddb"), F.lit(False)))
    return retrieve.rrf(hits.select("query", "method", "doc", "score", "matched"))


@query(f"with {HITS} select query, doc, matched, score from f where score >= 0.001")
def rrf_fusion(spark: SparkSession, directory: str) -> DataFrame:
    return fused(spark, directory)


@query(f"""with {HITS}, x as (select *, matched and row_number() over (partition by query, matched order by score desc, doc) <= 5 as kept from f where score >= 0.001)
  select query, doc, matched, score from x qualify row_number() over (partition by query order by kept desc, score desc, doc) <= 12""")
def value_aware_limit(spark: SparkSession, directory: str) -> DataFrame:
    return retrieve.value_aware_limit(fused(spark, directory), 12)


@query(f"""with {HITS}, e as (select query, doc, score from h qualify row_number() over (partition by query, method order by score desc, doc) <= 20), o as (select query, doc, max(score) as score from e group by all)
  select * from o qualify row_number() over (partition by query order by score desc, doc) <= 10""")
def union_topk(spark: SparkSession, directory: str) -> DataFrame:
    hits = keywords(spark, directory, sparse=True).top(50, ("bm25", "sparse")).withColumnRenamed("kind", "probe")
    return retrieve.union_top(hits, 10).drop("rank")


@query(f"""with {HITS}, x as (select query, doc, score, matched as same, row_number() over (partition by query, matched order by score desc, doc) as rank from f where score >= 0.001),
  y as (select * from x where rank <= case when same then 3 else 4 end) select query, doc, score, same, row_number() over (partition by query order by same desc, rank)::int as position from y""")
def two_path_topk(spark: SparkSession, directory: str) -> DataFrame:
    return retrieve.two_paths(fused(spark, directory).withColumnRenamed("matched", "same"), 3, 4)


@query(f"""with {BM25}, t as (select query, doc, score, row_number() over (partition by query order by score desc, doc) as rank from bm where score > 0 qualify rank <= 5), g as (select query, doc as target, score as st from t where rank = 2)
  select query, target as doc, doc as distractor, score from g join t using (query) where doc <> target and (score >= st or score / st >= 0.7 or abs(score - st) / greatest(score, st) <= 0.3)""")
def query_collisions(spark: SparkSession, directory: str) -> DataFrame:
    """Distractors of the second-best document of each question."""
    hits = keywords(spark, directory).top(5).drop("kind")
    return retrieve.collisions(hits, retrieve.top(hits, 2).where("rank = 2").select("query", "doc"))
