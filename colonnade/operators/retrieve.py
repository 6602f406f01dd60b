"""Search and ranking: keyword, sparse, dense and value matching, fused and limited.

Documents are (doc, text), queries (query, text); hits are (query, doc, score). A keyword search is a join of the query's
tokens with the postings of the documents, so documents that share no token are never met; token statistics cover all
documents. Scores are rounded before ranking, and ties go to the smaller document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.functions import text as T
from colonnade.plans.scratch import Scratch


def postings(docs: DataFrame) -> DataFrame:
    """(doc, token, tf)."""
    return docs.select("doc", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("tf"))


def top(hits: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best hits of each query with their rank."""
    w = Window.partitionBy(*(by or ["query"])).orderBy(F.desc("score"), "doc")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, post: DataFrame | None = None) -> DataFrame:
    """Okapi scores above 0 of the documents that share a token with a query; a document without tokens has length 0.

    ``post`` are the postings of the documents, if there are any already.
    """
    post = postings(docs) if post is None else post
    lengths = post.groupBy("doc").agg(F.sum("tf").alias("length"))
    whole = docs.where("text is not null").agg(F.count("*").alias("n")).crossJoin(lengths.agg(F.sum("length").alias("all"))).select("n", (F.col("all") / F.col("n")).alias("mean"))
    asked = queries.select("query", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))
    df = post.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    found = asked.join(df, "token").join(post, "token").join(lengths, "doc").crossJoin(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return found.groupBy("query", "doc").agg(F.sum(part).alias("score")).where("score > 0").withColumn("score", F.round("score", 6))


def relative(hits: DataFrame) -> DataFrame:
    """Scores divided by the best one of their query."""
    return hits.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query")))


def tfidf(docs: DataFrame, post: DataFrame | None = None) -> DataFrame:
    """(doc, token, weight): unit vectors of token weights, a stand-in for a learned sparse model."""
    post = postings(docs) if post is None else post
    df = post.groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    w = post.join(df, "token").crossJoin(F.broadcast(n)).select("doc", "token", (F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("w"))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select("doc", "token", (F.col("w") / F.col("norm")).alias("weight"))


def sparse_search(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot products of queries (query, token, weight) with documents (doc, token, weight) through the shared tokens."""
    q = queries.select("query", "token", F.col("weight").alias("wq"))
    return q.join(vectors, "token").groupBy("query", "doc").agg(F.round(F.sum(F.col("wq") * F.col("weight")), 6).alias("score"))


def dense_search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """The ``k`` documents (doc, vector) of largest cosine for each query (query, vector), exactly.

    Blocks of ``block`` queries travel to the documents; each batch of documents keeps its own ``k`` best for a query, and
    only those are shuffled. Null vectors and vectors without length match nothing.
    """
    rows = queries.where("vector is not null").select("query", "vector").orderBy("query").toLocalIterator()
    out, held = None, []

    def search(held: list) -> DataFrame:
        ids, q = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)
        length = np.linalg.norm(q, axis=1) if len(q) else np.empty(0)
        ids, q = ids[length > 0], q[length > 0] / length[length > 0, None] if len(q) else q
        sent = spark.sparkContext.broadcast((ids, q))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows or not len(ids):
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                doc = batch.column(0).to_numpy()[norm[:, 0] > 0]
                s = np.round(q @ (x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]).T, 6)
                best = np.stack([np.lexsort((doc, -row))[:k] for row in s])
                scores = np.take_along_axis(s, best, 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(doc[best].reshape(-1)), pa.array(scores.reshape(-1))], ["query", "doc", "score"])

        return docs.select("doc", "vector").mapInArrow(work, "query bigint, doc bigint, score double")

    for r in rows:
        held.append(r)
        if len(held) == block:
            out = search(held) if out is None else out.union(search(held))
            held = []
    if held or out is None:
        out = search(held) if out is None else out.union(search(held))
    return top(out, k)


def value_index(values: DataFrame, least: int = 2) -> DataFrame:
    """(norm, table_name, column_name, value) of (table_name, column_name, value): values by their trimmed lower-case form."""
    norm = F.lower(F.trim("value"))
    return values.select(norm.alias("norm"), "table_name", "column_name", "value").where(F.length("norm") >= least).distinct()


def exact_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """Values that equal a phrase (query, phrase), with score 1."""
    asked = phrases.select("query", F.lower(F.trim("phrase")).alias("norm"))
    return asked.join(index, "norm").select("query", "table_name", "column_name", "value", F.lit(1.0).alias("score"))


def partial_matches(index: DataFrame, phrases: DataFrame, least: int = 3, ratio: float = 0.4, factor: float = 0.7, k: int = 20, few: int = 200_000) -> DataFrame:
    """Values that contain a phrase or lie in one, equal ones left out: 0.7 times the ratio of lengths, the best ``k`` of a phrase.

    The parts of the longer text that are as long as some shorter text are looked up among these, so only matches meet. Queries
    with the same phrase search once; up to ``few`` phrases are sent to the values.
    """
    scratch = Scratch(index.sparkSession)
    asked = scratch.keep(phrases.select("query", F.lower(F.trim("phrase")).alias("phrase")).distinct().where(F.length("phrase") >= least), "asked")
    alone, index = asked.select("phrase").distinct(), scratch.keep(index, "index")
    keys = index.where(F.length("norm") >= least)

    def parts(c: str, other: DataFrame, o: str) -> Column:
        """The parts of a text that are shorter than it, not by more than ``ratio``, and as long as a text of the other side."""
        sizes = F.array(*[F.lit(r[0]) for r in other.select(F.length(o)).distinct().orderBy(F.length(o)).collect()]).cast("array<int>")
        fit = F.filter(sizes, lambda n: (n < F.length(c)) & (n >= ratio * F.length(c) - 1e-6))
        return F.array_distinct(F.flatten(F.transform(fit, lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(F.col(c), i, n)))))

    sent = F.broadcast(alone) if alone.count() <= few else alone
    inside = keys.withColumn("phrase", F.explode(parts("norm", alone, "phrase"))).join(sent, "phrase")
    around = alone.withColumn("norm", F.explode(parts("phrase", keys, "norm"))).join(keys, "norm")
    both = inside.unionByName(around)
    share = F.least(F.length("phrase"), F.length("norm")) / F.greatest(F.length("phrase"), F.length("norm"))
    got = both.select("phrase", "table_name", "column_name", "value", share.alias("ratio")).distinct().where(F.col("ratio") >= ratio)
    w = Window.partitionBy("phrase").orderBy(F.desc("score"), "table_name", "column_name", "value")
    got = got.withColumn("score", F.round(factor * F.col("ratio"), 6)).withColumn("rank", F.row_number().over(w))
    return got.where(F.col("rank") <= k).join(asked, "phrase").select("query", "table_name", "column_name", "value", "score")


def rrf(hits: DataFrame, k: int = 60, boost: float = 1.5, least: float = 0.001) -> DataFrame:
    """Reciprocal rank fusion of hits (query, method, doc, score, matched): one over k plus the rank, summed over the methods,
    times ``boost`` where a value matched."""
    ranked = top(hits, 2**31 - 1, ["query", "method"])
    got = ranked.groupBy("query", "doc").agg(F.sum(1 / (k + F.col("rank"))).alias("s"), F.max("matched").alias("matched"))
    score = F.round(F.col("s") * F.when(F.col("matched"), boost).otherwise(1.0), 8)
    return got.select("query", "doc", "matched", score.alias("score")).where(F.col("score") >= least)


def value_aware_limit(hits: DataFrame, k: int) -> DataFrame:
    """At most ``k`` hits of a query: up to max(k / 3, 5) with a matched value first, then the best others."""
    quota = max(k // 3, 5)
    by_match = Window.partitionBy("query", "matched").orderBy(F.desc("score"), "doc")
    first = hits.withColumn("_r", F.row_number().over(by_match)).withColumn("_kept", F.col("matched") & (F.col("_r") <= quota))
    order = Window.partitionBy("query").orderBy(F.desc("_kept"), F.desc("score"), "doc")
    return first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_r", "_kept", "_n")


def best_of_each(hits: DataFrame, by: list[str]) -> DataFrame:
    """The best score of each query and key."""
    return hits.groupBy("query", *by).agg(F.max("score").alias("score"))


def union_top(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several probes (query, probe, doc, score): the best max(10, 2 k) of a probe, each document once, the best ``k``."""
    each = top(hits, max(10, 2 * k), ["query", "probe"])
    return top(best_of_each(each, ["doc"]), k)


def two_paths(hits: DataFrame, k_same: int, k_cross: int) -> DataFrame:
    """Hits (query, doc, score, same): the best of the same database, then the best of others, each document once."""
    w = Window.partitionBy("query", "same").orderBy(F.desc("score"), "doc")
    got = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(F.col("same"), k_same).otherwise(k_cross))
    order = Window.partitionBy("query", "doc").orderBy(F.desc("same"), "rank")
    got = got.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return got.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("same"), "rank"))).drop("_n", "rank")


def collisions(hits: DataFrame, targets: DataFrame, ratio: float = 0.7, difference: float = 0.3, k: int = 5) -> DataFrame:
    """(query, doc, distractor, score): documents that score about as high as a query's target, which is among the best ``k``."""
    ranked = top(hits, k)
    target = ranked.join(targets, ["query", "doc"]).select("query", F.col("doc").alias("target"), F.col("score").alias("st"))
    pair = target.join(ranked, "query").where("doc <> target")
    close = (F.col("score") >= F.col("st")) | (F.col("score") / F.col("st") >= ratio) | (F.abs(F.col("score") - F.col("st")) / F.greatest("score", "st") <= difference)
    return pair.where(close).select("query", F.col("target").alias("doc"), F.col("doc").alias("distractor"), "score")
