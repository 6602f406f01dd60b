"""Problem 3: records of evaluation splits that also appear, exactly or almost, in the training split.

Texts are compared as word sets, so the text of a record that goes into the suffix array is its canonical one: the distinct
words from rare to frequent. Two sets of similarity t differ in d words, at most (n + m) (1 - t) / (1 + t). In canonical
texts these break the common words into at most d + 1 spans, so among the first (s - 1) (d + 1) + 1 common words there is
a span of s words that both texts have without a break: every pair that is to be found shares a span of ``span`` words
that begins early in both texts (``last_start``). The suffixes that begin there are partitioned and sorted by their first
words; neighbours with a common prefix of ``span`` words or more form a run, and each pair of suffixes of a run from
different splits is a candidate, if their span cannot be extended to the left (else an earlier suffix of both has shown
it), and if the words before the span and the parity bitmaps of the two sets leave room for the similarity. These bounds
are exact, so no pair is lost. Candidates are verified on their word sets. The shared spans of a verified pair, merged over
the whole texts, are its common words, whose share of the evaluation text is the pair's coverage.

The texts as they stand would not do: there a pair of 0.8 similarity need not share any long span, since clauses change
places and aliases change everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.scratch import Scratch


def last_start(n: int | Column, threshold: float, span: int) -> Column:
    """The last position of a canonical text of ``n`` words at which the first shared span can begin.

    Before it, common words come in groups of at most s - 1, each ended by a word that only one text has. A text with x words
    of its own, whose partner has y, so shows its first span at most x + (s - 1) (x + y) words from the start. Of all (x, y)
    that the similarity allows, one with y = 0 or one with x = 0 puts it last.
    """
    return F.floor(n * max((1 - threshold) * span, (1 / threshold - 1) * (span - 1)) + 1e-9).cast("int")


def check_span(span: int, threshold: float, min_words: int) -> None:
    """Raises an error if two similar sets need not share a span of that many words."""
    for d in range(1000):  # words that are not in both; from some number on the similarity asks for ever more common words
        common = max(math.ceil(threshold * min_words - 1e-9), math.ceil(d * threshold / (1 - threshold) - 1e-9)) if threshold < 1 else min_words
        if common <= (span - 1) * (d + 1):
            raise ValueError(f"similar sets of {min_words} words and more need not share {span} words in a row")


def field_sets(df: DataFrame, id_col: str, side_col: str, fields: list[str], min_words: int) -> DataFrame:
    """(field, id, side, words): the distinct hashed words of each text that has enough of them."""
    parts = []
    for f in fields:
        found = F.regexp_extract_all(F.lower(F.col(f)), F.lit("[a-z0-9_]+"), F.lit(0))
        words = F.array_sort(F.transform(F.array_distinct(found), lambda w: F.xxhash64(w)))
        parts.append(F.struct(F.lit(f).alias("field"), words.alias("words")))
    rows = df.select(F.col(id_col).alias("id"), F.col(side_col).alias("side"), F.explode(F.array(*parts)).alias("f"))
    return rows.select("f.field", "id", "side", "f.words").where(F.size("words") >= min_words)


def _spans(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Runs of sorted suffixes with a common prefix: (train, eval) of the pairs across splits that may be similar.

    Holds one run of bounded length at a time; pairs go out in slices.
    """
    def pairs(run: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, side, pos, _, before, room, bits = run
        tr, ev = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(tr) or not len(ev):
            return
        step = max(1, 500_000 // len(tr))
        for at in range(0, len(ev), step):
            e = ev[at : at + step]
            a, b = np.tile(tr, len(e)), np.repeat(e, len(tr))
            most = room[a] + room[b]  # thousandths of a word that may differ
            fits = (pos[a] + pos[b]) * 1000 <= reach * most
            fits &= (before[a] != before[b]) | (before[a] == 0)
            fits &= np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).astype(np.int64) * 1000 <= most
            a, b = a[fits], b[fits]
            if not len(a):
                continue
            yield pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b])], ["train", "eval"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        cur = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            cur = [np.concatenate([a, b]) for a, b in zip(rest, cur)]
        cut = np.flatnonzero(cur[3][1:] != cur[3][:-1]) + 1
        begin = np.concatenate([[0], cut])
        for s, e in zip(begin[:-1], begin[1:]):
            if e - s > 1:
                yield from pairs([c[s:e] for c in cur])
        rest = [c[begin[-1] :] for c in cur]
    if rest is not None:
        yield from pairs(rest)


def cross_split_pairs(
    spark: SparkSession,
    df: DataFrame,
    id_col: str,
    split_col: str,
    fields: list[str],
    train: str = "train",
    evaluation: tuple[str, ...] = ("dev", "test"),
    threshold: float = 0.8,
    min_words: int = 10,
    run_rows: int = 4000,
    span: int = 2,
) -> DataFrame:
    """(field, train_id, eval_id, similarity, coverage) of all records of the two sides that agree in a field.

    coverage is the share of the evaluation text's distinct words that the training text has too, 1 for a copy. Split labels
    count without case and surrounding blanks; null or another label is on neither side. Null, empty and short texts
    agree with nothing. Equal word sets are one set per field and side until the end. Runs of the suffix array with more
    than ``run_rows`` suffixes are cut into blocks that meet pairwise as rows of a join instead of in one task. A greater
    ``span`` makes longer suffix lists and fewer candidates; one that similar sets need not share is an error.
    """
    check_span(span, threshold, min_words)
    scratch = Scratch(spark)
    label = F.lower(F.regexp_replace(F.col(split_col), r"(?U)^\s+|\s+$", ""))
    side = F.when(label == train, F.lit(0)).when(label.isin(*evaluation), F.lit(1))
    rows = df.select(F.col(id_col), *[F.col(f) for f in fields], side.cast("tinyint").alias("_side")).where("_side is not null")
    members = field_sets(rows, id_col, "_side", fields, min_words).withColumn("key", F.xxhash64("field", "words"))
    members = scratch.keep(members, "members")
    sets = members.groupBy("key", "side").agg(F.first("field").alias("field"), F.first("words").alias("words"))
    words = sets.select("key", "side", "field", F.explode("words").alias("w"))
    df_ = words.groupBy("field", "w").agg(F.count("*").alias("df"))
    ordered = words.join(df_, ["field", "w"]).groupBy("key", "side").agg(F.first("field").alias("field"), F.array_sort(F.collect_list(F.struct("df", "w"))).alias("v"))
    ordered = scratch.keep(ordered.select("key", "side", "field", F.col("v.w").alias("text")), "texts")
    # Of a set with n words and one with m, at most (n + m) (1 - t) / (1 + t) words are not in both.
    room = F.floor(F.size("text") * (1000 * (1 - threshold) / (1 + threshold)) + 1).cast("bigint").alias("room")
    bits = F.expr("aggregate(text, 0L, (b, w) -> b ^ shiftleft(1L, cast(w & 63 as int)))").alias("bits")
    starts = F.least(last_start(F.size("text"), threshold, span), F.size("text") - span)
    at = lambda i: F.struct(i.alias("pos"), F.xxhash64("field", F.slice("text", i + 1, span)).alias("run"), F.when(i > 0, F.get("text", i - 1)).otherwise(0).alias("before"))
    suffixes = ordered.select("key", "side", room, bits, F.explode(F.transform(F.sequence(F.lit(0), starts), at)).alias("s"))
    suffixes = suffixes.select("key", "side", "s.pos", "s.run", "s.before", "room", "bits")
    runs = suffixes.groupBy("run").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("lo = 0 and hi = 1")
    live = scratch.keep(suffixes.join(runs.select("run", "n"), "run"), "suffixes")
    # Before the first span of s words both have, a word of one text alone, or the end, follows at most s - 1 common ones.
    reach = 2 * span - 1
    sorted_ = live.where(F.col("n") <= run_rows).repartition("run").sortWithinPartitions("run").select("key", "side", "pos", "run", "before", "room", "bits")
    spans = sorted_.mapInArrow(lambda batches: _spans(batches, reach), "train bigint, eval bigint")
    large = live.where(F.col("n") > run_rows)
    # both sides are cut, and a block of one meets each block of the other
    salt = large.withColumn("blocks", F.ceil(F.col("n") / run_rows).cast("int")).withColumn("cut", F.ceil(F.sqrt("blocks")).cast("int"))
    mine = F.pmod(F.xxhash64("key"), "cut").cast("int")
    every = F.sequence(F.lit(0), F.col("cut") - 1)
    a = salt.where("side = 0").select("run", mine.alias("i"), F.explode(every).alias("j"), F.col("key").alias("train"), F.col("pos").alias("at_train"), F.col("before").alias("pa"), F.col("room").alias("ra"), F.col("bits").alias("ba"))
    b = salt.where("side = 1").select("run", F.explode(every).alias("i"), mine.alias("j"), F.col("key").alias("eval"), F.col("pos").alias("at_eval"), F.col("before").alias("pb"), F.col("room").alias("rb"), F.col("bits").alias("bb"))
    most = F.col("ra") + F.col("rb")
    fits = (F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) * 1000 <= most) & ((F.col("at_train") + F.col("at_eval")) * 1000 <= reach * most)
    fits = fits & ((F.col("pa") != F.col("pb")) | (F.col("pa") == 0))
    spans = spans.union(a.join(b, ["run", "i", "j"]).where(fits).select("train", "eval"))
    merged = scratch.keep(spans.distinct(), "spans")
    scratch.drop(live)
    body = ordered.select("key", "side", "text", "field")
    both = merged.join(body.where("side = 0").select(F.col("key").alias("train"), F.col("text").alias("ta")), "train").join(
        body.where("side = 1").select(F.col("key").alias("eval"), F.col("text").alias("tb"), "field"), "eval"
    )
    overlap = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - overlap
    good = both.where(overlap * 1000 >= round(threshold * 1000) * union).select(
        "train", "eval", "field", (overlap / union).alias("similarity"), (overlap / F.size("tb")).alias("coverage")
    )
    left = members.where("side = 0").select(F.col("key").alias("train"), F.col("id").alias("train_id"))
    right = members.where("side = 1").select(F.col("key").alias("eval"), F.col("id").alias("eval_id"))
    return good.join(left, "train").join(right, "eval").select("field", "train_id", "eval_id", "similarity", "coverage")
