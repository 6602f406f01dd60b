"""Text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that no search counts.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with"]
VALUE, SCHEMA = "<unk>", "<mask>"
# Patterns of values in a question, in the order in which they are masked.
VALUE_PATTERNS = [
    r"'[^']*'", r'"[^"]*"', r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}/\d{2}/\d{4}\b", r"\b\d{2}-\d{2}-\d{4}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d+\.?\d*\b", r"\b\d+%\b", r"\$\d+(?:\.\d+)?\b",
]


def tokens(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case runs of letters and digits with two characters or more, without stop words, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(stopwords))


def normalise_question(c: Column) -> Column:
    """Blanks collapsed, lower case, punctuation at the end removed again and again."""
    flat = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.regexp_replace(flat, r"[\p{Punct}\s]+$", "")


def normalise_sql(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def mask_values(c: Column) -> Column:
    """Quoted texts, dates and numbers replaced by a mark."""
    for p in VALUE_PATTERNS:
        c = F.regexp_replace(c, p, VALUE)
    return c


def normalise_description(c: Column) -> Column:
    """Line ends as blanks, blanks collapsed, the words that announce evidence left out wherever they stand."""
    bare = F.replace(F.regexp_replace(c, r"[\r\n]", " "), F.lit("commonsense evidence:"), F.lit(""))
    return F.trim(F.regexp_replace(bare, r" +", " "))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements over all elements; two empty sets agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def keyword_similarity(a: Column, b: Column) -> Column:
    """0.6 of the set similarity and 0.4 of the share of the smaller set."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    overlap = F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)
    return 0.6 * set_similarity(a, b) + 0.4 * overlap


def bag_tokens(c: Column) -> Column:
    """The blank-separated tokens of a text, each with the number of its occurrence, so that the set of them is the bag of tokens."""
    sorted_ = F.array_sort(F.filter(F.split(c, r"\s+"), lambda t: t != ""))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        n = F.when(t == s["t"], s["n"] + 1).otherwise(0)
        return F.struct(t.alias("t"), n.alias("n"), F.concat(s["out"], F.array(F.concat_ws(" ", t, n))).alias("out"))

    return F.aggregate(sorted_, start, step, lambda s: s["out"])


def bag_similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts as bags of blank-separated tokens; an empty text agrees with nothing, two of blanks agree."""
    return F.when((a == "") | (b == ""), 0.0).otherwise(set_similarity(bag_tokens(a), bag_tokens(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def extract_result(c: Column) -> Column:
    """The text between result tags, else inside a code fence, else all of it."""
    tag = F.regexp_extract(c, r"(?s)<result>(.*?)</result>", 1)
    fence = F.regexp_extract(c, r"(?s)```(?:sql)?\s*(.*?)```", 1)
    return F.regexp_replace(F.when(tag != "", tag).when(fence != "", fence).otherwise(c), r"^\s+|\s+$", "")


def extract_json(c: Column) -> Column:
    """The outermost braces of a model's answer, or null if there are none."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def term_columns(c: Column) -> Column:
    """All ``table=..., column=...`` pairs of a term's context as (table, column)."""
    whole = F.regexp_extract_all(c, F.lit(r"table=\s*([^,;]+),\s*column=\s*([^,;]+)"), F.lit(0))
    return F.transform(whole, lambda t: F.struct(F.trim(F.regexp_extract(t, r"table=\s*([^,;]+),", 1)).alias("table"), F.trim(F.regexp_extract(t, r"column=\s*([^,;]+)", 1)).alias("column")))
