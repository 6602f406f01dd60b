"""Typed metadata of databases, tables, columns, relationships and terms: versions, upserts, clearing, projection.

A store is a set of long rows (kind, entity, field, value, source, seq), one for each write; its current state is the fold of
``memory.resolve_versions``. Entities are dotted names in lower case. Nothing is changed in place: a write returns the rows
to append, and clearing returns the rows to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.operators import memory

SHAPE = "kind string, entity string, field string, value string, source string, seq bigint"
#: Fields of each kind of entity; fields of lists and maps are kept as JSON text.
FIELDS = {
    "database": ["description", "domain", "total_tables", "total_rows"],
    "table": ["description", "row_count", "primary_keys"],
    "column": ["data_type", "description", "null_count", "distinct_count", "semantic_type", "encoding_mapping", "semantic_tags"],
    "relationship": ["cardinality", "relationship_type", "description"],
    "term": ["definition", "formula", "related_columns"],
}
KEPT_UNVERSIONED = {"null_count", "distinct_count", "row_count", "total_rows", "total_tables"}  #: the newest value counts


def entity(*parts: Column) -> Column:
    return F.concat_ws(".", *[F.lower(F.trim(p)) for p in parts])


def relationship_entity(table: Column, columns: Column, target: Column, target_columns: Column) -> Column:
    """The key of a relationship: its tables and its lists of columns, in their order."""
    lists = [F.array_join(F.transform(c, lambda x: F.lower(F.trim(x))), ",") for c in (columns, target_columns)]
    return F.concat(F.lower(F.trim(table)), F.lit("("), lists[0], F.lit(")->"), F.lower(F.trim(target)), F.lit("("), lists[1], F.lit(")"))


def writes(rows: DataFrame, kind: str, name: Column, source: str | Column, seq: Column) -> DataFrame:
    """The rows to append for a table whose columns are fields of ``kind``; nulls write nothing, other columns are ignored."""
    fields = [f for f in FIELDS[kind] if f in rows.columns]
    each = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    long = rows.select(name.alias("entity"), (F.lit(source) if isinstance(source, str) else source).alias("source"), seq.cast("bigint").alias("seq"), F.explode(F.array(*each)).alias("f"))
    return long.select(F.lit(kind).alias("kind"), "entity", "f.field", "f.value", "source", "seq").where("value is not null")


def update(kind: str, name: str, field: str, value: str, source: str, store: DataFrame) -> DataFrame:
    """The row that sets one field, after everything that is stored."""
    if field not in FIELDS[kind]:
        raise ValueError(f"{field} is no field of a {kind}")
    last = store.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    return last.select(F.lit(kind).alias("kind"), F.lit(name.lower()).alias("entity"), F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(source).alias("source"), (F.col("last") + 1).alias("seq"))


def current(store: DataFrame) -> DataFrame:
    """(kind, entity, field, value, source): what counts now. Counts are the newest value, other fields follow the priorities."""
    plain = F.col("field").isin(*KEPT_UNVERSIONED)
    newest = store.where(plain & ~memory.is_empty(F.col("value"))).groupBy("kind", "entity", "field").agg(F.max_by(F.struct("value", "source"), "seq").alias("v"))
    newest = newest.select("kind", "entity", "field", "v.value", "v.source")
    keyed = store.where(~plain).withColumn("entity", F.struct("kind", "entity"))
    folded = memory.resolve_versions(keyed).select("entity.kind", "entity.entity", "field", "value", "source")
    return newest.union(folded)


def clear(store: DataFrame, kind: str, field: str, entities: DataFrame | None = None, versions: bool = True) -> DataFrame:
    """The store without a field of the given entities (entity), or of all. Without ``versions`` the history stays, and the
    field is emptied by a row after it, so that only a source of the same priority fills it before the value counts again."""
    of = (F.col("kind") == kind) & (F.col("field") == field)
    mine, rest = store.where(of), store.where(~of)
    if entities is not None:
        rest = rest.union(mine.join(entities.select("entity"), "entity", "left_anti").select(store.columns))
        mine = mine.join(entities.select("entity"), "entity", "left_semi").select(store.columns)
    if versions:
        return rest
    marks = mine.groupBy("kind", "entity", "field").agg(F.lit("").alias("value"), F.max_by("source", F.struct(memory.priority(F.col("source")), "seq")).alias("source"), (F.max("seq") + 1).alias("seq"))
    return store.union(marks.select(store.columns))


def delete_database(store: DataFrame, database: str) -> DataFrame:
    """The store without a database and all below it."""
    name = database.lower()
    return store.where((F.col("entity") != name) & ~F.startswith("entity", F.lit(name + ".")))


def project(state: DataFrame, kind: str, fields: list[str], entities: DataFrame | None = None) -> DataFrame:
    """(entity, *fields): the requested fields, a row for each entity that has one of them; all entities if none are given."""
    rows = state.where((F.col("kind") == kind) & F.col("field").isin(*fields) & ~memory.is_empty(F.col("value")))
    if entities is not None:
        rows = rows.join(entities.select("entity"), "entity", "left_semi")
    return rows.groupBy("entity").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def append_tags(old: Column, new: Column) -> Column:
    """Two lists of tags (type, content, source, ...) joined; of tags equal in these three the first is kept."""
    key = lambda t: F.struct(t["type"], t["content"], t["source"])
    both = F.concat(F.coalesce(old, F.slice(new, 1, 0)), F.coalesce(new, F.slice(old, 1, 0)))
    return F.filter(both, lambda t, i: F.array_position(F.transform(both, key), key(t)) == i + 1)


def unique_columns(columns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns (column_key) that are in none of the pairs (a, b)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("column_key"))
    return columns.join(ends, "column_key", "left_anti")


def filter_encodings(maps: DataFrame, mapping: str, samples: str, longest: int = 80, blanks: int = 10, least: int = 2) -> DataFrame:
    """``maps`` with the entries of ``mapping`` whose key is seen in the samples, equal or as a part, and whose key reads like no
    sentence; null if fewer than ``least`` are left."""
    words = lambda k: F.size(F.split(k, " ")) - 1
    seen = lambda k: F.exists(samples, lambda s: F.contains(F.lower(s), F.lower(k)))
    kept = F.map_filter(mapping, lambda k, v: (F.length(k) <= longest) & (words(k) <= blanks) & seen(k))
    return maps.withColumn(mapping, F.when(F.size(kept) >= least, kept))


def lookup(mapping: Column, text: Column) -> Column:
    """The entries of an encoding whose key or value is the text without case, as (key, value)."""
    low = F.lower(F.trim(text))
    return F.filter(F.map_entries(mapping), lambda e: (F.lower(e["key"]) == low) | (F.lower(e["value"]) == low))


def pattern_share(values: Column, pattern: str) -> tuple[Column, Column]:
    """Aggregates over a group: whether all non-null values match a pattern as a whole, and the share that does."""
    fits = F.regexp_like(values, F.lit(rf"\A(?:{pattern})\z"))
    return F.coalesce(F.bool_and(fits), F.lit(False)), F.avg(fits.cast("int"))


def terms(texts: DataFrame, c: str) -> DataFrame:
    """(term, definition) of the ``name = formula``, ``name refers to ...`` and ``name means ...`` statements of evidence texts."""
    parts = F.split(c, r"\s*;\s*")
    rows = texts.where(F.col(c).isNotNull()).select(*[x for x in texts.columns if x != c], F.explode(parts).alias("part"))
    pattern = r"(?i)^\s*(.+?)\s*(?:=|\brefers? to\b|\bmeans?\b|\bis calculated as\b)\s*(.+?)\s*\.?\s*$"
    return rows.select(*[x for x in texts.columns if x != c], F.lower(F.regexp_extract("part", pattern, 1)).alias("term"), F.regexp_extract("part", pattern, 2).alias("definition")).where("term <> '' and definition <> ''")
