"""Problem 8: one consistent form for text that looks the same but is written with different characters.

The text of an Arrow batch becomes one numpy array of code points. Lookup tables, small sorted arrays built from the
Unicode character database by rule, give what each code point turns into; gathers with expansion offsets apply them,
marks are put in order and composed for all rows at once, and no string function is called for a row.

The form: full-width and half-width characters, composed and decomposed accents and joined letters are unified, blanks
and hyphens become one kind, characters that take no room go, and in a word with letters of two of the Latin, Greek,
Cyrillic and Armenian scripts the letters of the lesser script are replaced by the look-alikes of the other. Case, accents, raised
and enclosed characters, fractions and everything else a reader can see stay, and so do words of a single script.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.scratch import Scratch

# Letters that look alike, in the same order in each line; a blank where a script has none.
LATIN_C = "ABCEHIJKMOPSTXYaceijopsxyhdqwlGrv"
CYRILLIC = "АВСЕНІЈКМОРЅТХУасеіјорѕхуһԁԛԝӏԌгѵ"
LATIN_G = "ABEZHIKMNOPTXYovuaikpy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΧΥονυαικργ"
LATIN_A = "LOSUfghjnoqu"
ARMENIAN = "ԼՕՏՍքցհյոօզս"
# Hyphens that look like the ASCII one, and format characters that are visible.
HYPHENS = "‐‑﹣"
VISIBLE_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
NO_ROOM = [
    0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x2065, 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xFFF0, 0xFFF9),
    *range(0xE0100, 0xE01F0),
]
BLANKS = [0x2800]  #: blanks that are not of the category of blanks
CHUNK = 1_500_000  #: bytes of text worked on at once

OTHER, LATIN, GREEK_S, CYRILLIC_S, ARMENIAN_S = 0, 1, 2, 3, 4
SCRIPTS = {"LATIN": LATIN, "GREEK": GREEK_S, "CYRILLIC": CYRILLIC_S, "ARMENIAN": ARMENIAN_S}


def _target(cp: int) -> list[int] | None:
    """What the code point turns into before composition; None if it stays."""
    ch, kind = chr(cp), unicodedata.category(chr(cp))
    if kind == "Zs" or cp in BLANKS:
        return None if cp in (0x20, 0x1680) else [0x20]
    if ch in HYPHENS:
        return [0x2D]
    if cp in NO_ROOM or kind == "Cf" and cp not in VISIBLE_FORMAT:
        return []
    if kind == "Cc" and cp not in (0x09, 0x0A, 0x0D):
        return [0x0A] if cp == 0x85 else []
    if cp in (0x2028, 0x2029):
        return [0x0A]
    d = unicodedata.decomposition(ch)
    if not d or 0xAC00 <= cp < 0xD7A4:
        return None
    tag, parts = (d.split(" ", 1) + [""])[:2] if d[0] == "<" else ("", d)
    to = [int(x, 16) for x in parts.split()]
    letters = all(unicodedata.category(chr(x))[0] == "L" for x in to)
    if tag in ("", "<wide>", "<narrow>", "<noBreak>") or tag == "<compat>" and letters and (len(to) > 1 or cp == 0xB5):
        return [y for x in to for y in (_target(x) if _target(x) is not None else [x])]
    return None


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """The lookup tables as arrays sorted by code point."""
    src, off, flat, marks, classes, starts, seconds, whole = [], [0], [], [], [], [], [], []
    script = np.zeros(0x3000, np.uint8)
    word = np.zeros(0x3000, bool)
    # without the ideographs and the unassigned planes, where nothing changes
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        ch = chr(cp)
        if (to := _target(cp)) is not None:
            src.append(cp)
            flat += to
            off.append(len(flat))
        if c := unicodedata.combining(ch):
            marks.append(cp)
            classes.append(c)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            starts.append(a)
            seconds.append(b)
            whole.append(cp)
        if cp < 0x3000:
            word[cp] = ch.isalnum() or ch == "_" or unicodedata.category(ch) in ("Mn", "Mc")
            if ch.isalpha():
                name = unicodedata.name(ch, "").split(" ")[0]
                script[cp] = SCRIPTS.get(name, OTHER)
    pair = np.array(starts, np.uint64) << np.uint64(32) | np.array(seconds, np.uint64)
    order = np.argsort(pair)
    like = np.zeros((len(SCRIPTS) + 1, 0x3000), np.uint32)  # [script to write in, letter]
    for latin, other, which in ((LATIN_C, CYRILLIC, CYRILLIC_S), (LATIN_G, GREEK, GREEK_S), (LATIN_A, ARMENIAN, ARMENIAN_S)):
        for a, b in zip(latin, other, strict=True):
            like[which, ord(a)], like[LATIN, ord(b)] = ord(b), ord(a)
    for cp in np.flatnonzero(like[LATIN]):  # between other scripts by way of Latin
        for b in set(SCRIPTS.values()) - {LATIN, script[cp]}:
            like[b, cp] = like[b, like[LATIN, cp]]
    return {
        "src": np.array(src, np.uint32), "off": np.array(off, np.int64), "flat": np.array(flat, np.uint32), "mark": np.array(marks, np.uint32),
        "class": np.array(classes, np.uint8), "pair": pair[order], "whole": np.array(whole, np.uint32)[order], "script": script, "word": word, "like": like,
    }


def _look(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``sorted_`` and whether the values are there."""
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return at, sorted_[at] == values


def _expand(cps: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by what it turns into; row keeps the row number of each."""
    odd = np.flatnonzero((cps >= 0x7F) | (cps < 0x20))
    at, hit = _look(t["src"], cps[odd])
    odd, at = odd[hit], at[hit]
    cr = np.flatnonzero(cps == 0x0D)
    cr = cr[(cr + 1 < len(cps))]
    cr = cr[(cps[cr + 1] == 0x0A) & (row[cr + 1] == row[cr])]
    if not len(odd) and not len(cr):
        return cps, row
    size = np.ones(len(cps), np.int64)
    size[odd] = t["off"][at + 1] - t["off"][at]
    size[cr] = 0
    begin = np.cumsum(size) - size
    out = np.repeat(cps, size)
    n = size[odd]
    into = np.repeat(begin[odd], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    out[into] = t["flat"][np.repeat(t["off"][at], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
    return out, np.repeat(row, size)


def _one_script(cps: np.ndarray, row: np.ndarray, t: dict) -> np.ndarray:
    """Letters of the lesser script of a mixed word replaced by their look-alikes; the text is decomposed."""
    low = np.minimum(cps, 0x2FFF)
    inside = cps < 0x3000
    foreign = inside & (t["script"][low] >= GREEK_S)
    if not foreign.any():
        return cps
    rows = np.zeros(row[-1] + 1, bool)
    rows[row[foreign]] = True
    pos = np.flatnonzero(rows[row])
    sub, low, inside, r = cps[pos], low[pos], inside[pos], row[pos]
    word = np.where(inside, t["word"][low], True)
    cut = np.ones(len(pos), bool)
    cut[1:] = (word[1:] != word[:-1]) | (r[1:] != r[:-1])
    ids = np.cumsum(cut) - 1
    script = np.where(inside & word, t["script"][low], OTHER)
    n = ids[-1] + 1
    count = np.stack([np.bincount(ids[script == s], minlength=n) for s in range(len(SCRIPTS) + 1)])
    mixed = ((count[1:] > 0).sum(0) > 1)[ids] & (script > 0)
    if not mixed.any():
        return cps
    # how many letters each choice of script would leave without a look-alike, then how many it would change
    best, target = None, np.zeros(n, np.int64)
    for s in SCRIPTS.values():
        stuck = mixed & (script != s) & (t["like"][s, low] == 0)
        cost = np.bincount(ids[stuck], minlength=n) * 1_000_000
        cost = np.where(count[s] > 0, cost - count[s], 2**60)
        if best is None:
            best, target[:] = cost, s
        else:
            target[cost < best] = s
            best = np.minimum(best, cost)
    to = target[ids]
    new = t["like"][to, low]
    change = mixed & (script != to) & (new > 0)
    out = cps.copy()
    out[pos[change]] = new[change]
    return out


def _compose(cps: np.ndarray, row: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order, then base letters joined with the marks that they have a composed form with."""
    keep = np.ones(len(cps), bool)
    at, hit = _look(t["mark"], cps)
    mark = np.flatnonzero(hit)
    if len(mark):
        cls = t["class"][at[mark]]
        idx = np.arange(len(cps))
        base_of = np.maximum.accumulate(np.where(hit, -1, idx))[mark]
        order = np.lexsort((cls, base_of))
        cps = cps.copy()
        cps[mark] = cps[mark][order]
        cls = cls[order]
        same_row = (base_of >= 0) & (row[np.maximum(base_of, 0)] == row[mark])
        mark, cls, base_of = mark[same_row], cls[same_row], base_of[same_row]
        while len(mark):
            free = np.ones(len(mark), bool)  # a mark is blocked by one of its own class between it and the base
            free[1:] = (base_of[1:] != base_of[:-1]) | (cls[1:] != cls[:-1])
            found, ok = _look(t["pair"], cps[base_of].astype(np.uint64) << np.uint64(32) | cps[mark])
            ok &= free
            first = np.flatnonzero(ok)
            if not len(first):
                break
            first = first[np.unique(base_of[first], return_index=True)[1]]
            cps[base_of[first]] = t["whole"][found[first]]
            keep[mark[first]] = False
            left = np.ones(len(mark), bool)
            left[first] = False
            mark, cls, base_of = mark[left], cls[left], base_of[left]
    for lead in (True, False):  # Hangul: leading consonant and vowel, then a syllable without final and a final
        a, b = cps[:-1], cps[1:]
        if lead:
            fit = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        else:
            fit = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        p = np.flatnonzero(fit & (row[:-1] == row[1:]))
        if len(p):
            cps = cps.copy()
            cps[p] = 0xAC00 + ((cps[p] - 0x1100) * 21 + cps[p + 1] - 0x1161) * 28 if lead else cps[p] + cps[p + 1] - 0x11A7
            keep[p + 1] = False
            cps, row, keep = cps[keep], row[keep], np.ones(keep.sum(), bool)
    return (cps, row) if keep.all() else (cps[keep], row[keep])


def unify_array(texts: pa.Array, t: dict | None = None) -> pa.Array:
    """The texts in the consistent form; null stays null, and a text of nothing visible becomes empty."""
    t = t or tables()
    texts = texts.cast(pa.large_string())
    out = []
    n = len(texts)
    if not n:
        return pa.array([], pa.string())
    size = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, size[cuts[-1]] + CHUNK, "right")) - 1))
    data = texts.buffers()[2]
    for a, b in zip(cuts[:-1], cuts[1:]):
        o = size[a : b + 1]
        raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.empty(0, np.uint8)
        o = o - o[0]
        if len(raw):
            cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            begun = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[o]
            row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(begun))
            cps, row = _expand(cps, row, t)
            if len(cps) and cps.max() >= 0x80:
                cps = _one_script(cps, row, t)
                cps, row = _compose(cps, row, t)
            wide = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
            length = np.bincount(row, weights=wide, minlength=b - a).astype(np.int64) if len(cps) else np.zeros(b - a, np.int64)
            body = pa.py_buffer(cps.tobytes().decode("utf-32-le").encode("utf-8"))
        else:
            length, body = np.zeros(b - a, np.int64), pa.py_buffer(b"")
        offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64).tobytes())
        part = pa.Array.from_buffers(pa.large_string(), b - a, [None, offsets, body])
        if texts.null_count:
            part = pa.compute.if_else(texts.slice(a, b - a).is_valid(), part, pa.scalar(None, pa.large_string()))
        out.append(part)
    return pa.concat_arrays(out).cast(pa.string()) if sum(x.nbytes for x in out) < 2**30 else pa.concat_arrays(out)


def unify(df: DataFrame, text_col: str, out_col: str = "unified") -> DataFrame:
    """``df`` with the consistent form of ``text_col`` in ``out_col``, which may be ``text_col`` itself."""
    import pyarrow.compute  # noqa: F401  (for the executors' function)

    t = tables()
    schema = df.schema
    names = [f.name for f in schema.fields]
    place = names.index(text_col)
    target = names.index(out_col) if out_col in names else len(names)
    from pyspark.sql.types import StringType, StructField, StructType

    fields = list(schema.fields)
    fields[target:target + 1] = [StructField(out_col, StringType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            columns, heads = list(batch.columns), list(batch.schema.names)
            columns[target:target + 1] = [unify_array(batch.column(place), t)]
            heads[target:target + 1] = [out_col]
            yield pa.RecordBatch.from_arrays(columns, heads)

    return df.mapInArrow(work, StructType(fields))


def look_alike_pairs(spark: SparkSession, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of records whose texts are not empty, not equal, and equal in the consistent form.

    Null and empty texts are in no pair. Texts and forms are compared by their MD5 hashes, which are written once. Only
    different texts of one form are paired, and the records are joined to them last, so copies of a text add no pair among
    themselves.
    """
    scratch = Scratch(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text <> ''")
    rows = rows.select("id", F.unhex(F.md5("text")).alias("raw"), "text")
    formed = scratch.keep(unify(rows, "text", "text").select("id", "raw", F.unhex(F.md5("text")).alias("form")), "formed")
    kinds = formed.groupBy("form", "raw").agg(F.count("*").alias("n"))
    several = kinds.groupBy("form").agg(F.count("*").alias("k")).where("k > 1").select("form")
    members = formed.join(several, "form")
    raws = members.select("form", "raw").distinct()
    a = raws.select("form", F.col("raw").alias("ra"))
    b = raws.select("form", F.col("raw").alias("rb"))
    pairs = a.join(b, "form").where("ra < rb").select("ra", "rb")
    left = members.select(F.col("raw").alias("ra"), F.col("id").alias("ia"))
    right = members.select(F.col("raw").alias("rb"), F.col("id").alias("ib"))
    return pairs.join(left, "ra").join(right, "rb").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
