"""Readers and writers of benchmark files, descriptions, insights and record stores."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.text import normalise_description

INSIGHT = """insight_id string, retrieval_key struct<nl_triggers: array<string>, sql_risk_atoms: array<string>>,
  guidance struct<intent: string, strategy_incorrect: struct<pattern: string, implication: string>, strategy_correct: struct<pattern: string, implication: string>, actionable_advice: string>,
  qualified_incorrect_sql string, qualified_correct_sql string, source_question_ids array<string>"""


def read_benchmark(spark: SparkSession, path: str, databases: list[str] | None = None) -> DataFrame:
    """(question_id, question, evidence, sql, difficulty, db_id) of a JSON array in either of two layouts.

    The layout without ids and evidence has its gold query under ``query``; its ids are positions in the file.
    """
    raw = spark.read.option("multiLine", True).json(path)
    if "SQL" in raw.columns or "question_id" in raw.columns:
        pick = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
        got = raw.select(F.col("question_id").cast("bigint").alias("question_id"), "question", pick("evidence").alias("evidence"), pick("SQL").alias("sql"), pick("difficulty").alias("difficulty"), "db_id")
    else:
        text = spark.read.option("wholetext", True).text(path)
        item = F.from_json("value", "array<struct<question: string, query: string, db_id: string>>")
        rows = text.select(F.posexplode(item).alias("question_id", "x"))
        got = rows.select(F.col("question_id").cast("bigint").alias("question_id"), "x.question", F.lit("").alias("evidence"), F.col("x.query").alias("sql"), F.lit(None).cast("string").alias("difficulty"), "x.db_id")
    return got.where(F.col("db_id").isin(databases)) if databases is not None else got


ENCODINGS = ("utf-8-sig", "utf-16", "cp1252", "latin-1")
DESCRIPTION = "table_name string, column_name string, expanded_name string, description string, data_format string, value_description string"


def read_descriptions(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Column descriptions of one CSV per table, names in lower case, texts normalised; the table is the file's name.

    A file is read in the first encoding that all of it decodes in, UTF-16 only with its mark. Rows without a column are left
    out; missing texts are empty, and "not useful" before the text on values is dropped.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, body in zip(batch["path"], batch["content"]):
                for e in encodings:
                    try:
                        if e == "utf-16" and body[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                            continue
                        text = body.decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    raise ValueError(f"{uri} is in none of {encodings}")
                rows = [{(k or "").strip(): v for k, v in r.items() if isinstance(v, str)} for r in csv.DictReader(io.StringIO(text, newline=""))]
                rows = [r for r in rows if r.get("original_column_name", "").strip()]
                name = uri.rsplit("/", 1)[-1].removesuffix(".csv").lower().strip()
                cell = lambda c: [r.get(c, "").strip() for r in rows]  # noqa: B023, E731
                yield pd.DataFrame({"table_name": name, "column_name": [c.lower() for c in cell("original_column_name")], "expanded_name": cell("column_name"), "description": cell("column_description"), "data_format": cell("data_format"), "value_description": cell("value_description")})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, DESCRIPTION)
    values = F.regexp_replace(normalise_description(F.col("value_description")), r"(?i)^not useful\s*", "")
    return raw.withColumns({"description": normalise_description(F.col("description")), "value_description": values})


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSIGHT).json(path)


def write_insights(insights: DataFrame, path: str) -> None:
    """Insights as JSON lines that ``read_insights`` reads; null fields are left out."""
    insights.write.mode("append").json(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Column pairs or clusters as a Parquet store with a folder for each database; a database that comes again is replaced."""
    pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("database_id").parquet(path)


def read_pairs(spark: SparkSession, path: str, database: str | None = None) -> DataFrame:
    """A store of pairs, or the one folder of a database."""
    store = spark.read.parquet(path)
    return store if database is None else store.where(F.col("database_id") == database)


def export_predictions(chosen: DataFrame, path: str) -> None:
    """(question_id, sql) as one JSON object a line, ``{"question_id": ..., "sql": ...}``, the last text of a question only."""
    last = chosen.groupBy("question_id").agg(F.max_by("sql", F.coalesce("seq", F.lit(0))).alias("sql")) if "seq" in chosen.columns else chosen.dropDuplicates(["question_id"])
    last.select(F.col("question_id").cast("string").alias("question_id"), "sql").write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; lists, maps and structs as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def few_shots(texts: DataFrame, c: str) -> DataFrame:
    """(question, sql) of a prompt's solved examples; the last question of a prompt is the one to solve and is left out."""
    pattern = r"/\* Answer the following: (.*?) \*/\s*(.*?)(?=/\*|$)"
    q = F.regexp_extract_all(F.col(c), F.lit("(?s)" + pattern), F.lit(1))
    s = F.regexp_extract_all(F.col(c), F.lit("(?s)" + pattern), F.lit(2))
    pairs = F.arrays_zip(q.alias("q"), s.alias("s"))
    got = texts.select("*", F.explode(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))).alias("_p"))
    return got.select(*texts.columns, F.trim(F.col("_p")["q"]).alias("question"), F.trim(F.regexp_replace(F.col("_p")["s"], r"\s+$", "")).alias("sql"))


def write_records(records: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends records to a store with a folder for each year, so that reading recent years opens only theirs."""
    records.withColumn("year", F.year(ts)).write.mode("append").partitionBy("year").parquet(path)


def read_recent(spark: SparkSession, path: str, years: int = 3) -> DataFrame:
    """The newest ``years`` years of a store; the filter on the partition column opens no other folder."""
    store = spark.read.parquet(path)
    last = store.agg(F.max("year")).first()[0]
    return store if last is None else store.where(F.col("year") > last - years)
