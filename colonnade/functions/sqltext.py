"""SQL text as Spark columns: schema-free skeletons, masks, rule checks and rewrites.

All of it is regular expressions, evaluated in the JVM for any number of rows. What needs the structure of a query is in
``sqlparse``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a skeleton keeps.
KEYWORDS = [
    "all", "and", "as", "asc", "avg", "between", "by", "case", "cast", "count", "cross", "desc", "distinct", "else", "end", "except", "exists", "from", "full", "group", "having",
    "in", "inner", "intersect", "is", "join", "left", "like", "limit", "max", "min", "not", "null", "offset", "on", "or", "order", "outer", "over", "partition", "right", "select",
    "sum", "then", "union", "when", "where", "with",
]
#: Checks: name -> pattern over the whole text. ``order_by_null`` is for capitals on one line only, and a sum or count inside
#: what it matches clears the text.
CHECKS = {
    "join": r"(?is)\bon\s+[\w.`\"]+\s*=\s*[\w.`\"]+\s+or\s+[\w.`\"]+\s*=|\bjoin\b[^()]*?\bon\s+[\w.`\"]+\s+in\s*\(",
    "order_by_limit": r"(?is)order\s+by\s+(min|max)\s*\([^)]*\)[^()]*\blimit\s+\d+",
    "select": r"(?is)\|\| ' ' \|\||select\s+[^()]*?\b\w+\.\*",
    "max_min": r"(?is)=\s*\(\s*select\s+(min|max)\s*\(|=\s*\(\s*select\b[^()]*\blimit\s+1\s*\)",
    "order_by_null": r"ORDER BY [^\n]*?(?<!DESC )LIMIT +[0-9]+",
}


def without_literals(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"'[^']*'", "''"))


def mask_literals(c: Column) -> Column:
    """Texts in quotes and numbers replaced, blanks collapsed, in lower case: equal for queries that differ in values only."""
    text = F.regexp_replace(F.regexp_replace(c, r"'[^']*'", "?"), r"\b\d+(\.\d+)?\b", "?")
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def skeleton(c: Column, keep: list[str] = KEYWORDS) -> Column:
    """Keywords, operators and brackets of a query, with ``_`` for everything else and for lists of it."""
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(c), r"'[^']*'|`[^`]*`|\"[^\"]*\"", " x "), F.lit(r"[a-z_][a-z0-9_.]*|[0-9][0-9.]*|[<>=!]+|[(),*/+-]"), F.lit(0))
    text = F.array_join(F.transform(parts, lambda t: F.when(t.isin(keep) | ~t.rlike("^[a-z0-9_]"), t).otherwise("_")), " ")
    for pattern, to in ((r"_( _)+", "_"), (r"_ as _", "_"), (r"_( , _)+", "_"), (r"_( join _ on _ = _)+", "_ join _")):
        text = F.regexp_replace(text, pattern, to)
    return text


def checks(c: Column) -> Column:
    """The names of the rule checks that a query fails, joined by commas."""
    sorted_ = F.regexp_extract_all(c, F.lit(CHECKS["order_by_null"]), F.lit(0))
    failed = {name: c.rlike(p) for name, p in CHECKS.items()}
    failed["order_by_null"] = (F.size(sorted_) > 0) & ~F.exists(sorted_, lambda m: F.contains(m, F.lit("SUM(")) | F.contains(m, F.lit("COUNT(")))
    return F.concat_ws(",", *[F.when(x, name) for name, x in failed.items()])


def quote_time(c: Column) -> Column:
    """Integers of four digits or more that are compared with a call of ``strftime`` put in quotes."""
    call = r"\bstrftime\s*\((?:[^()]|\([^()]*\))*\)"
    return F.regexp_replace(c, rf"({call}\s*(?:<>|!=|[<>=]=?)\s*)([0-9]{{4,}})\b", "$1'$2'")


def split_joined_texts(c: Column) -> Column:
    """Texts that a SELECT joins with a blank between made columns of their own."""
    return F.when(c.rlike(r"(?is)\bselect\b.*\|\| ' ' \|\|.*\bfrom\b"), F.replace(c, F.lit("|| ' ' ||"), F.lit(", "))).otherwise(c)


def repair_like(c: Column) -> Column:
    """LIKE patterns without a closing quote before the next clause, or in double quotes, brought into single quotes."""
    single = F.regexp_replace(c, r"(?i)\blike\s+\"([^\"]*)\"", "LIKE '$1'")
    return F.regexp_replace(single, r"(?i)\blike\s+'([^']*?)(\s+(?:and|or|order|group|limit)\b[^']*)$", "LIKE '$1'$2")
