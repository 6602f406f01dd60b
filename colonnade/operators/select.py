"""Choosing among candidates: consensus, ranking, votes and the final selection; accuracy and recall measures.

Candidates are rows (question, candidate, result, succeeded, rows, ms): ``result`` is a hash of the result set and null for
failed candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _question() -> WindowSpec:
    return Window.partitionBy("question")


def valid_candidates(candidates: DataFrame) -> DataFrame:
    """Of each question the successful candidates with rows; if it has none, all successful ones."""
    tier = F.when(F.col("succeeded") & (F.col("rows") > 0), 1).when(F.col("succeeded"), 2)
    got = candidates.withColumn("tier", tier).where("tier is not null")
    return got.withColumn("_best", F.min("tier").over(_question())).where("tier = _best").drop("_best")


def consensus(candidates: DataFrame) -> DataFrame:
    """(question, result, group_size, valid, share, representative, ms): the groups of equal results; the first candidate
    of a group represents it."""
    got = valid_candidates(candidates).groupBy("question", "result").agg(F.count("*").alias("group_size"), F.min_by(F.struct("candidate", "ms"), "candidate").alias("first"))
    total = F.sum("group_size").over(_question())
    return got.select("question", "result", "group_size", total.alias("valid"), (F.col("group_size") / total).alias("share"), F.col("first.candidate").alias("representative"), F.col("first.ms").alias("ms"))


def ranked(groups: DataFrame, k: int) -> DataFrame:
    """The ``k`` best groups of each question: larger share first, then the faster, then the earlier."""
    w = _question().orderBy(F.desc("share"), F.asc_nulls_last("ms"), "representative")
    return groups.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shortcut(groups: DataFrame, questions: DataFrame, enough: float = 0.8) -> DataFrame:
    """(question, decision): select without a judge if one group is left or the best one has enough of the share; vote;
    or fall back to the first candidate where none is valid."""
    best = groups.groupBy("question").agg(F.max("share").alias("top"), F.count("*").alias("groups"))
    decision = F.when(F.col("groups").isNull(), "fallback").when((F.col("groups") == 1) | (F.col("top") >= enough), "select").otherwise("vote")
    return questions.select("question").distinct().join(best, "question", "left").select("question", decision.alias("decision"))


def candidate_pairs(top: DataFrame) -> DataFrame:
    """(question, a, b): the ranked candidates of a question, two by two; at most k (k - 1) / 2 for each."""
    a = top.select("question", F.col("representative").alias("a"), F.col("rank").alias("ra"))
    b = top.select("question", F.col("representative").alias("b"), F.col("rank").alias("rb"))
    return a.join(b, "question").where("ra < rb").select("question", "a", "b")


def vote_scores(votes: DataFrame) -> DataFrame:
    """(question, a, b, voter, score) in both directions of votes (question, a, b, voter, outcome): A 1, B 0, TIE a half.

    Another outcome raises an error when the rows are computed.
    """
    won = F.when(F.col("outcome") == "A", 1.0).when(F.col("outcome") == "B", 0.0).when(F.col("outcome") == "TIE", 0.5).otherwise(F.raise_error(F.concat(F.lit("unknown vote "), F.coalesce("outcome", F.lit("null")))))
    one = votes.withColumn("score", won).select("question", "a", "b", "voter", "score")
    return one.union(one.select("question", F.col("b").alias("a"), F.col("a").alias("b"), "voter", (1 - F.col("score")).alias("score")))


def win_matrix(votes: DataFrame) -> DataFrame:
    """(question, candidate, win): the mean over voters, summed over the rivals and divided by all candidates, itself included."""
    cell = vote_scores(votes).groupBy("question", "a", "b").agg(F.avg("score").alias("s"))
    n = F.size(F.array_union(F.collect_set("b"), F.array(F.first("a"))))
    return cell.groupBy("question", "a").agg((F.sum("s") / n).alias("win")).withColumnRenamed("a", "candidate")


def final_selection(wins: DataFrame, top: DataFrame) -> DataFrame:
    """(question, candidate, score): the highest win times normalised share, the better rank first among equals."""
    weight = F.col("share") / F.sum("share").over(_question())
    got = top.select("question", F.col("representative").alias("candidate"), "rank", weight.alias("weight")).join(wins, ["question", "candidate"])
    got = got.withColumn("score", F.col("win") * F.col("weight"))
    w = _question().orderBy(F.desc("score"), "rank")
    return got.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("question", "candidate", "score")


def geometric_median(points: DataFrame, group: str, vector: str, iterations: int = 1000, tolerance: float = 1e-5) -> DataFrame:
    """(group, median) by Weiszfeld steps over the points of each group, which are to be few (the votes on one question)."""
    import numpy as np
    import pandas as pd

    def median(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        m = x.mean(0)
        for _ in range(iterations):
            d = np.maximum(np.linalg.norm(x - m, axis=1), 1e-12)
            n = (x / d[:, None]).sum(0) / (1 / d).sum()
            if np.linalg.norm(n - m) < tolerance:
                m = n
                break
            m = n
        return pd.DataFrame({group: [pdf[group].iloc[0]], "median": [m.tolist()]})

    return points.groupBy(group).applyInPandas(median, f"{group} {points.schema[group].dataType.simpleString()}, median array<double>")


def accuracy(results: DataFrame, by: str) -> DataFrame:
    """(by, questions, accuracy) of rows with ``correct``, null correct left out."""
    return results.where("correct is not null").groupBy(by).agg(F.count("*").alias("questions"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def linking_recall(gold: DataFrame, linked: DataFrame, keys: list[str]) -> DataFrame:
    """(macro_recall, micro_recall) of linked against gold elements, both (question, *keys); questions without gold count not."""
    found = linked.select("question", *keys).distinct().withColumn("_hit", F.lit(1))
    per = gold.select("question", *keys).distinct().join(found, ["question", *keys], "left").groupBy("question").agg(F.count("*").alias("n"), F.count("_hit").alias("hit"))
    return per.agg(F.avg(F.col("hit") / F.col("n")).alias("macro_recall"), (F.sum("hit") / F.sum("n")).alias("micro_recall"))


def schema_overlap(rows: DataFrame, tables_a: str, tables_b: str, columns_a: str, columns_b: str) -> DataFrame:
    """``rows`` with ``overlap``: 0.6 of the tables' and 0.4 of the columns' set similarity; two empty sets agree."""

    def similarity(a, b):
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)

    return rows.withColumn("overlap", 0.6 * similarity(F.col(tables_a), F.col(tables_b)) + 0.4 * similarity(F.col(columns_a), F.col(columns_b)))
