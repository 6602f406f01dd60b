"""Problem 7: combining sources to target weights by pivotal dependent rounding.

Sizes are tokens of a public tokenizer. For the whole mixture of W tokens a source with the share s and T tokens needs
each of its documents s W / T times: the whole part for all of them, and the fractional part as a probability. Pivotal
rounding settles those: of two documents with fractional probabilities one gives token mass to the other, in a random
direction that keeps both expectations, until the probability of one is 0 or 1. A task settles its documents in rounds, in
which all open documents of a source are paired at once; the one of each source that is left goes into a reduction tree
over the tasks, so no task and no driver sees a whole source, and the tokens of a source miss their target by less than
one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.scratch import Scratch

#: Public tokenizer file in the rank format, and the pattern of its first split; both are parameters of the operators. The
#: driver reads the file and sends it to the tasks, so it need not be on the executors.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_BYTES = 50_000_000  #: size of a vocabulary file that is sent to the tasks
FAN_IN = 64


def token_counts(df: DataFrame, id_col: str, text_col: str, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens): the tokens of each text; null and empty texts have none. Strings of special tokens count as text."""
    with open(ranks, "rb") as f:
        body = f.read(MOST_BYTES + 1)
    if len(body) > MOST_BYTES:
        raise ValueError(f"{ranks} is too large to be sent to the tasks")
    sent = df.sparkSession.sparkContext.broadcast(body)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        cache = tiktoken.__dict__.setdefault("_loaded_ranks", {})  # outlives the task in a reused worker
        if (ranks, pattern) not in cache:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
            cache[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        enc = cache[ranks, pattern]
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "tokens": np.array(n, np.int64)})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(work, f"id {rows.schema['id'].dataType.simpleString()}, tokens bigint")


def _uniform(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the two documents only, so that a repeated task makes the same choices."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed * 0x165667B19E3779F9 % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) / 2**53


def _pivot(ids: np.ndarray, tokens: np.ndarray, probs: np.ndarray, source: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities of which at most one for each source is neither 0 nor 1. In a round the open documents of a source
    are paired in their order, each pair settles one of its two or both, and one without a partner waits."""
    p = np.where(probs <= 1e-12, 0.0, np.where(probs >= 1 - 1e-12, 1.0, probs))
    turn = 0
    while True:
        turn += 1
        at = np.flatnonzero((p > 0) & (p < 1))
        at = at[np.argsort(source[at], kind="stable")]
        if not len(at):
            return p
        begin = np.concatenate([[0], np.flatnonzero(np.diff(source[at])) + 1])
        size = np.diff(np.append(begin, len(at)))
        place = np.arange(len(at)) - np.repeat(begin, size)
        first = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(size, size)))
        if not len(first):
            return p
        i, j = at[first], at[first + 1]
        ti, tj, pi, pj = tokens[i], tokens[j], p[i], p[j]
        up, down = np.minimum((1 - pi) * ti, pj * tj), np.minimum(pi * ti, (1 - pj) * tj)  # mass that can go to i, and to j
        to_i = _uniform(ids[i], ids[j], seed * 64 + turn) * (up + down) < down
        move = np.where(to_i, up, -down)
        full = np.where(to_i, (1 - pi) * ti <= pj * tj, pi * ti <= (1 - pj) * tj)  # i is the one that is settled
        p[i] = np.where(full, np.where(to_i, 1.0, 0.0), pi + move / ti)
        p[j] = np.where(full, pj - move / tj, np.where(to_i, 0.0, 1.0))
        for k in (i, j):
            p[k] = np.where(p[k] <= 1e-12, 0.0, np.where(p[k] >= 1 - 1e-12, 1.0, p[k]))


ROUNDED = "id bigint, source string, tokens bigint, p double"


def _round_partitions(rows: DataFrame, seed: int) -> DataFrame:
    """Each task rounds its rows source by source; p is 0 or 1 but for at most one row of each source."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the open document of each source
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            code = pd.factorize(pdf["source"])[0]
            pdf["p"] = _pivot(pdf["id"].to_numpy(np.int64), pdf["tokens"].to_numpy(np.float64), pdf["p"].to_numpy(np.float64).copy(), code, seed)
            open_ = (pdf["p"] > 0) & (pdf["p"] < 1)
            held = pdf[open_]
            yield pdf[~open_]
        if held is not None:
            yield held

    return rows.select("id", "source", "tokens", "p").mapInPandas(work, ROUNDED)


def mixture(
    spark: SparkSession, documents: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    total_tokens: int | None = None, seed: int = 7, ranks: str = RANKS, pattern: str = PATTERN,
) -> tuple[DataFrame, DataFrame]:
    """The copies (id, source, tokens, copies) of each document of a listed source, and the report of the shares reached.

    ``targets`` has (source, target_share, max_repeats), one row for each source; source names compare without case and
    surrounding blanks. The mixture has ``total_tokens``, or as many as the repeat limits allow; a larger number is lowered
    to that. A listed source without tokens reaches share 0 and the others keep their proportions. Documents of other
    sources, or without tokens, are not used; repeated ids are documents of their own. The report has, for each target,
    source, target_share, max_repeats, documents, tokens (available), planned_tokens, mixed_tokens, actual_share, most_repeats,
    and in every row requested_tokens (null if none were), feasible_tokens, the most that the repeat limits allow, and
    used_tokens, the smaller of the two; limiting is true for the sources whose limits set feasible_tokens.
    """
    scratch = Scratch(spark)

    def name(c):
        return F.lower(F.trim(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")))

    want = targets.select(name("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("most"))
    want = want.where("source is not null").dropDuplicates(["source"])
    named = documents.select(F.col(id_col).cast("bigint").alias("id"), name(source_col).alias("source"), F.col(text_col).alias("text"))
    few = F.broadcast if want.count() <= 100_000 else lambda d: d
    used = named.join(few(want.select("source")), "source")
    sized = token_counts(used.select(F.struct("id", "source").alias("id"), "text"), "id", "text", ranks, pattern)
    sized = scratch.keep(sized.select("id.id", "id.source", "tokens").where("tokens > 0"), "sized")
    per = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = want.join(per, "source", "left").fillna(0, ["tokens", "documents"])
    plan = plan.withColumn("part", F.when(F.col("tokens") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
    plan = scratch.keep(plan, "plan")
    limit = plan.agg(F.sum("part").alias("s"), F.min(F.expr("case when part > 0 then most * tokens / part end")).alias("w")).first()
    whole = (limit["w"] or 0.0) * (limit["s"] or 0.0)
    total = min(whole, total_tokens) if total_tokens is not None else whole
    ratio = total / limit["s"] if limit["s"] else 0.0
    plan = plan.withColumn("times", F.when(F.col("part") > 0, F.least(F.col("part") * ratio / F.col("tokens"), F.col("most").cast("double"))).otherwise(0.0))
    plan = plan.withColumn("limiting", F.col("part") * whole >= F.col("most") * F.col("tokens") * limit["s"] * (1 - 1e-12) if limit["s"] else F.lit(False))
    plan = plan.withColumn("limiting", F.coalesce(F.col("limiting") & (F.col("part") > 0), F.lit(False)))
    plan = plan.withColumn("base", F.floor(F.col("times") + 1e-9)).withColumn("frac", F.greatest(F.lit(0.0), F.col("times") - F.col("base")))
    plan = plan.withColumn("frac", F.when(F.col("frac") < 1e-9, 0.0).otherwise(F.col("frac")))
    listed = plan.select("source", "base", F.col("frac").alias("p"))
    rows = sized.join(few(listed.select("source", "p")), "source")
    rounded = scratch.keep(_round_partitions(rows, seed), "rounded")
    done = rounded.where("p = 0 or p = 1")
    rest = rounded.where("p > 0 and p < 1")
    level, steps = 0, []
    while True:
        most = rest.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        level += 1
        nodes = rest.withColumn("node", F.pmod(F.xxhash64("id", F.lit(level)), F.lit(max(1, most // FAN_IN + (most > FAN_IN)))))
        step = scratch.keep(_round_partitions(nodes.repartition("source", "node").sortWithinPartitions("source", "node", "id"), seed + level), "tree")
        steps.append(step)
        done = done.union(step.where("p = 0 or p = 1"))
        rest = step.where("p > 0 and p < 1")
    last = rest.withColumn("p", (F.abs(F.xxhash64("id", F.lit(seed))) % 1000003 / 1000003 < F.col("p")).cast("double"))
    copies = done.union(last).join(few(listed.select("source", "base")), "source")
    copies = scratch.keep(copies.select("id", "source", "tokens", (F.col("base") + F.col("p")).cast("bigint").alias("copies")), "copies")
    scratch.drop(sized, rounded, *steps)
    got = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_repeats"))
    report = plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "most_repeats"])
    sum_ = got.agg(F.sum("mixed_tokens").alias("all"))
    report = report.crossJoin(F.broadcast(sum_)).select(
        "source", F.col("share").alias("target_share"), F.col("most").alias("max_repeats"), "documents", "tokens",
        F.round(F.col("times") * F.col("tokens")).cast("bigint").alias("planned_tokens"), "mixed_tokens", F.coalesce(F.col("mixed_tokens") / F.nullif("all", F.lit(0)), F.lit(0.0)).alias("actual_share"), "most_repeats",
        F.lit(total_tokens).cast("bigint").alias("requested_tokens"), F.lit(whole).cast("bigint").alias("feasible_tokens"), F.lit(total).cast("bigint").alias("used_tokens"), "limiting",
    )
    return copies, report
