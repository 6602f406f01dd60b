"""Problem 6: training documents that contain passages of held-out items.

Documents and items are cut into all windows of a passage's length in words. A window is embedded by the CGK random walk:
at step j the current word is written out and the walk moves on to the next word or stays, as a random bit of (j, word)
says; windows at a small edit distance come out at a small Hamming distance, equal windows come out equal. Bit sampling
then hashes some of the written positions. How many repetitions the target recall needs at the allowed number of edits is
measured on edited copies of item windows (with no edits allowed one repetition has a recall of 1). Windows that meet in a
repetition are verified by their exact edit distance. Text is first brought into the consistent form of problem 8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.unify import unify
from colonnade.plans.scratch import Scratch

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LeakParameters:
    window: int = 12
    max_edits: int = 0
    target_recall: float = 0.95
    samples: int = 6  #: written positions that one repetition hashes
    most_repetitions: int = 128
    measured_windows: int = 2000  #: item windows whose edited copies tell how many repetitions are needed
    broadcast_windows: int = 200_000  #: item windows up to which they travel to the documents, about 20 MB


def _sampled(p: LeakParameters, repetitions: int) -> list[np.ndarray]:
    rng = np.random.default_rng(6)
    # a walk has left the window after about 2 w of its 3 w steps, and what is written from then on tells nothing
    return [np.sort(rng.choice(2 * p.window, p.samples, replace=False)) for _ in range(repetitions)]


def edited(windows: np.ndarray, edits: int, seed: int = 8) -> np.ndarray:
    """Copies of the rows of a word matrix at an edit distance of at most ``edits``: words exchanged, or taken out at one place
    and put in at another, which counts twice."""
    rng = np.random.default_rng(seed)
    out = windows.copy()
    n, w = out.shape
    left = np.full(n, edits)
    while (left > 0).any():
        moved = (left >= 2) & (rng.random(n) < 0.5)
        for i in np.flatnonzero(left > 0):
            new = rng.integers(1, 2**63, dtype=np.uint64)
            if moved[i]:
                row = np.delete(out[i], rng.integers(w))
                out[i] = np.insert(row, rng.integers(w), new)
            else:
                out[i, rng.integers(w)] = new
        left -= np.where(moved, 2, 1)
    return out


def repetitions(windows: np.ndarray, p: LeakParameters) -> tuple[int, float]:
    """The number of repetitions at which edited copies of the windows, rows of words, meet them as often as the target says,
    and the share that then did. Raises an error if ``most_repetitions`` are not enough."""
    if not p.max_edits or not len(windows):
        return 1, 1.0
    pick = windows[np.linspace(0, len(windows) - 1, min(len(windows), p.measured_windows)).astype(int)]
    a, b = pick.reshape(-1), edited(pick, p.max_edits).reshape(-1)
    at, met = np.arange(len(pick)) * p.window, np.zeros(len(pick), bool)
    for r, s in enumerate(_sampled(p, p.most_repetitions)):
        met |= window_keys(a, at, p, r, s) == window_keys(b, at, p, r, s)
        if met.mean() >= p.target_recall:
            return r + 1, float(met.mean())
    raise ValueError(f"{p.most_repetitions} repetitions reach a recall of {met.mean():.2f} at {p.max_edits} edits; allow more, or hash fewer positions")


def window_keys(flat: np.ndarray, at: np.ndarray, p: LeakParameters, repetition: int, sample: np.ndarray) -> np.ndarray:
    """The sampled CGK hash of the windows of ``flat`` that begin at ``at``."""
    i = np.zeros(len(at), np.int64)
    key = np.full(len(at), repetition, np.uint64)
    wanted = set(sample.tolist())
    for j in range(int(sample[-1]) + 1):
        inside = i < p.window
        word = np.where(inside, flat[at + np.minimum(i, p.window - 1)], np.uint64(0))
        if j in wanted:
            key = (key ^ word) * MIX
            key ^= key >> np.uint64(29)
        step = (word ^ np.uint64((repetition * 4096 + j) * 0x632BE59BD9B4E019 % 2**64)) * MIX
        i += (step >> np.uint64(63)).astype(np.int64)
    return key


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two word matrices, for all rows at once."""
    n, w = a.shape
    before = np.tile(np.arange(w + 1, dtype=np.int16), (n, 1))
    for i in range(w):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        for j in range(w):
            change = before[:, j] + (a[:, i] != b[:, j])
            now[:, j + 1] = np.minimum(np.minimum(before[:, j + 1], now[:, j]) + 1, change)
        before = now
    return before[:, w]


def _near(a: np.ndarray, b: np.ndarray, p: LeakParameters) -> np.ndarray:
    if not p.max_edits:
        return (a == b).all(1)
    # windows within e edits have all but e words in common; few that meet by chance do
    close = np.flatnonzero((a[:, :, None] == b[:, None, :]).any(2).sum(1) >= p.window - p.max_edits)
    near = np.zeros(len(a), bool)
    near[close] = edit_distance(a[close], b[close]) <= p.max_edits
    return near


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = unify(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null"), "text", "text")
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return rows.select("id", F.transform(found, lambda w: F.xxhash64(w)).alias("words"))


def _windows(batch: pa.RecordBatch, p: LeakParameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the batch, where a window begins, and the row of each window."""
    lists = batch.column(1)
    size = np.asarray(lists.value_lengths(), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(size)), size)
    end = np.repeat(np.cumsum(size), size)
    at = np.flatnonzero(np.arange(len(flat)) + p.window <= end)
    return flat, at, row[at]


def _keyed(words: DataFrame, p: LeakParameters, sampled: list[np.ndarray]) -> DataFrame:
    """(key, id, words) of every window and repetition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, rows = _windows(batch, p)
            ids = batch.column(0)
            for lo in range(0, len(starts), 50_000):
                at = starts[lo : lo + 50_000]
                body = pa.array(flat[at[:, None] + np.arange(p.window)].reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * p.window), body)
                for r, s in enumerate(sampled):
                    key = pa.array(window_keys(flat, at, p, r, s).view(np.int64))
                    yield pa.RecordBatch.from_arrays([key, ids.take(pa.array(rows[lo : lo + 50_000])), lists], ["key", "id", "words"])

    return words.mapInArrow(work, f"key bigint, id {words.schema['id'].dataType.simpleString()}, words array<bigint>")


def leaked_passages(
    spark: SparkSession, documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, p: LeakParameters | None = None
) -> DataFrame:
    """(doc_id, item_id) of every document with a window of words within ``max_edits`` of a window of the item; each pair once.

    Words are runs of letters, digits and underscores in lower case. Null, empty and shorter texts hold no window. The
    item windows go to the documents if there are at most ``broadcast_windows``; else both sides are joined by their keys.
    """
    p = p or LeakParameters()
    scratch = Scratch(spark)
    asked = scratch.keep(_words(items, item_id, item_text), "words")
    some = scratch.keep(_keyed(asked, p, _sampled(p, 1)).select("words").distinct(), "windows").orderBy(F.xxhash64("words")).limit(p.measured_windows).toArrow()
    sampled = _sampled(p, repetitions(some["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, p.window), p)[0] if p.max_edits else 1)
    keyed = scratch.keep(_keyed(asked, p, sampled).distinct(), "items")
    n = keyed.count()
    docs = _words(documents, doc_id, doc_text)
    kinds = docs.schema["id"].dataType.simpleString(), keyed.schema["id"].dataType.simpleString()
    if n <= p.broadcast_windows:
        rows = keyed.toArrow()
        key = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        ids = rows["id"].combine_chunks().take(pa.array(order))
        body = rows["words"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, p.window)[order]
        sent = spark.sparkContext.broadcast((key, ids, body))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, body = sent.value
            if not len(key):
                return
            for batch in batches:
                flat, starts, rows = _windows(batch, p)
                got = []
                for lo in range(0, len(starts), 200_000):
                    at = starts[lo : lo + 200_000]
                    for r, s in enumerate(sampled):
                        mine = window_keys(flat, at, p, r, s)
                        left, right = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
                        hits = np.flatnonzero(right > left)
                        m = (right - left)[hits]
                        which = np.repeat(hits, m)
                        item = np.repeat(left[hits], m) + (np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m))
                        for c in range(0, len(which), 100_000):
                            w, i = which[c : c + 100_000], item[c : c + 100_000]
                            good = _near(flat[at[w][:, None] + np.arange(p.window)], body[i], p)
                            got.append(np.stack([rows[lo + w[good]], i[good]], 1))
                if got and len(found := np.concatenate(got)):
                    a, b = batch.column(0).take(pa.array(found[:, 0])), ids.take(pa.array(found[:, 1]))
                    yield from pa.table([a, b], ["doc_id", "item_id"]).group_by(["doc_id", "item_id"]).aggregate([]).to_batches()

        return docs.mapInArrow(work, f"doc_id {kinds[0]}, item_id {kinds[1]}").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).flatten().to_numpy().view(np.uint64).reshape(-1, p.window) for i in (2, 3))
            keep = pa.array(np.flatnonzero(_near(a, b, p)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["doc_id", "item_id"])

    pairs = _keyed(docs, p, sampled).select("key", F.col("id").alias("doc_id"), F.col("words").alias("a")).join(
        keyed.select("key", F.col("id").alias("item_id"), F.col("words").alias("b")), "key"
    )
    return pairs.select("doc_id", "item_id", "a", "b").mapInArrow(verify, f"doc_id {kinds[0]}, item_id {kinds[1]}").distinct()
