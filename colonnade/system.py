"""The system as one object: a bound catalog, stored rounds, retrieval, guidance, metadata and the models behind its steps."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import sqlparse, sqltext, text as T
from colonnade.operators import catalog, execute, match, memory, profile, retrieve, store


class Model(ABC):
    """A model behind a step. ``answer`` takes and gives a list of texts, so a client of a service can send batches."""

    @abstractmethod
    def answer(self, prompts: list[str | None]) -> list[str | None]: ...

    def map(self, df: DataFrame, prompt: str, out: str = "response") -> DataFrame:
        """``df`` with an answer for each prompt; a prompt that repeats in a batch is asked once, null is not asked."""
        from pyspark.sql.types import StringType, StructField, StructType

        model = self

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                asked = [p for p in pdf[prompt].drop_duplicates() if isinstance(p, str)]
                known = dict(zip(asked, model.answer(asked)))
                yield pdf.assign(**{out: [known.get(p) if isinstance(p, str) else None for p in pdf[prompt]]})

        return df.mapInPandas(work, StructType([*df.schema.fields, StructField(out, StringType())]))


class RuleModel(Model):
    """A function of the prompt in place of a model."""

    def __init__(self, rule: Callable[[str], str | None]):
        self.rule = rule

    def answer(self, prompts):
        return [self.rule(p) if p is not None else None for p in prompts]


class Checker(ABC):
    """A rule over a column of SQL text."""

    @abstractmethod
    def check(self, df: DataFrame, sql: str) -> DataFrame:
        """``df`` with the text ``failed``, empty if the query passes."""


class RuleChecker(Checker):
    def check(self, df, sql):
        return df.withColumn("failed", sqltext.checks(F.col(sql)))


class Linker(ABC):
    """Finds the stored columns that texts speak of."""

    @abstractmethod
    def link(self, df: DataFrame, text: str) -> DataFrame:
        """(*columns, table_name, column_name), a row for each linked column."""


class NameLinker(Linker):
    """Links every column whose table's and own name both occur in the text, whatever they are there."""

    def __init__(self, columns: list[tuple[str, str]]):
        self.columns = columns

    def link(self, df, text):
        pairs = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in self.columns])
        low = F.lower(text)
        found = F.filter(pairs, lambda p: F.contains(low, F.lower(p["table_name"])) & F.contains(low, F.lower(p["column_name"])))
        return df.select(*df.columns, F.inline(found))


class Generator(ABC):
    """Proposes queries: (*columns, sql), a row for each candidate."""

    @abstractmethod
    def generate(self, df: DataFrame) -> DataFrame: ...


def candidates_of(generators: list[Generator], df: DataFrame) -> DataFrame:
    """The candidates of several generators as one bag."""
    out = None
    for g in generators:
        got = g.generate(df)
        out = got if out is None else out.unionByName(got)
    return out


def linked_union(*links: DataFrame) -> DataFrame:
    """(table_name, column_name): what any of several linkers found, each once, names in lower case."""
    out = None
    for d in links:
        got = d.select(F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))
        out = got if out is None else out.union(got)
    return out.distinct()


class System:
    """Works on one bound database at a time; all state is DataFrames that are replaced, never changed."""

    def __init__(self, spark: SparkSession, records: DataFrame, metadata: DataFrame | None = None, insights: DataFrame | None = None):
        self.spark, self.records, self.insights = spark, records, insights
        self.metadata = metadata if metadata is not None else spark.createDataFrame([], store.SHAPE)
        self.database: str | None = None
        self.tables: dict[str, DataFrame] = {}
        self.runs = execute.Runs(spark)

    def bind_database(self, name: str, tables: dict[str, DataFrame]) -> System:
        self.database, self.tables = name.lower(), tables
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
        return self

    def _bound(self) -> str:
        if self.database is None:
            raise ValueError("no database is bound")
        return self.database

    def start_session(self) -> str:
        """The next session of the bound database."""
        db = self._bound()
        n = F.regexp_extract("session_id", r"_(\d+)$", 1).try_cast("int")
        last = self.records.where(F.lower("database_id") == db).agg(F.max(n)).first()[0] or 0
        return f"{db}_{last + 1:06d}"

    def store_round(self, rounds: DataFrame) -> DataFrame:
        """Adds the rounds (database_id, session_id, user_query, generated_sql, record_id, ...) that are not stored yet, and returns those."""
        key = [F.lower("database_id"), T.normalise_question(F.col("user_query")), T.normalise_sql(F.col("generated_sql"))]
        new = memory.dedup_records(self.records, rounds, key, "record_id")
        self.records = self.records.unionByName(new, allowMissingColumns=True)
        return new

    def retrieve_memory(self, questions: DataFrame, k: int = 20) -> DataFrame:
        """The ``k`` stored rounds that are most like each question (query, text) of the bound database, same database first."""
        db = self._bound()
        stored = self.records.where("user_query is not null and generated_sql is not null and database_id is not null")
        stored = stored.select(F.col("record_id").alias("doc"), F.lower("database_id").alias("db"), T.tokens(F.col("user_query")).alias("words"), T.bag_tokens(sqltext.skeleton(F.col("generated_sql"))).alias("shape"))
        asked = questions.select("query", F.lit(db).alias("db"), T.tokens(F.col("text")).alias("words"), F.array().cast("array<string>").alias("shape"))
        return retrieve.two_paths(match.episode_scores(asked, stored), k, k)

    def retrieve_sql_guidance(self, queries: DataFrame, k: int = 3) -> DataFrame:
        """The ``k`` insights (insight, wrong_shape, right_shape, atoms) that fit each query (query, shape, atoms) best."""
        if self.insights is None:
            raise ValueError("no insights are loaded")
        hits = match.guidance_scores(queries, self.insights).withColumnRenamed("insight", "doc")
        return retrieve.top(hits, k)

    def identify_mapping(self, df: DataFrame, sql: str) -> DataFrame:
        """``df`` with the tables, columns by clause, and joins of its queries, names settled by the bound tables."""
        return sqlparse.analyse(df, sql, "mapping", {t: d.columns for t, d in self.tables.items()})

    def get_schema_metadata(self, fields: list[str], entities: DataFrame | None = None) -> DataFrame:
        """(entity, *fields) of columns, all of the bound database if no entities are given."""
        got = store.project(store.current(self.metadata), "column", fields, entities)
        return got if entities is not None else got.where(F.startswith("entity", F.lit(self._bound() + ".")))

    def generate_metadata(self, source: str = "profiling") -> DataFrame:
        """Profiles the bound tables and adds what that tells; returns the rows that were added."""
        db = self._bound()
        columns = {t: [f.name for f in d.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")] for t, d in self.tables.items()}
        stats = profile.column_stats(profile.cells(self.tables, columns)).join(catalog.columns_frame(self.spark, self.tables), ["table_name", "column_name"])
        total = F.col("total_count") + F.col("null_count")
        rows = stats.select("table_name", "column_name", "data_type", "null_count", "distinct_count", profile.semantic_type(F.col("family"), F.col("distinct_count"), total).alias("semantic_type"))
        last = self.metadata.agg(F.max("seq")).first()[0] or 0
        new = store.writes(rows, "column", store.entity(F.lit(db), F.col("table_name"), F.col("column_name")), source, F.lit(last + 1))
        self.metadata = self.metadata.union(new)
        return new

    def import_metadata(self, descriptions: DataFrame, source: str = "manual") -> DataFrame:
        """Adds descriptions (table_name, column_name, description) under the closest bound names; returns what was added."""
        db = self._bound()
        known = self.spark.createDataFrame([(t, c) for t, d in self.tables.items() for c in d.columns], "table_name string, column_name string")
        tables = match.closest_names(descriptions.select(F.lit(db).alias("db"), "table_name"), known.select(F.lit(db).alias("db"), "table_name").distinct(), "db", "table_name")
        named = descriptions.join(tables.select("table_name", F.col("known_name").alias("_t")), "table_name").select(F.col("_t").alias("table_name"), "column_name", "description")
        columns = match.closest_names(named.select("table_name", "column_name"), known, "table_name", "column_name")
        rows = named.join(columns.select("table_name", "column_name", "known_name"), ["table_name", "column_name"])
        last = self.metadata.agg(F.max("seq")).first()[0] or 0
        new = store.writes(rows, "column", store.entity(F.lit(db), F.col("table_name"), F.col("known_name")), source, F.lit(last + 1))
        self.metadata = self.metadata.union(new)
        return new

    def delete_semantic_field(self, field: str, entities: DataFrame | None = None) -> None:
        self.metadata = store.clear(self.metadata, "column", field, entities)

    def unfinished(self, questions: DataFrame, done: DataFrame) -> DataFrame:
        """The questions (question_id) that have no finished row in ``done`` (question_id, succeeded)."""
        return questions.join(done.where("succeeded").select("question_id"), "question_id", "left_anti")

    def finalize_session(self) -> None:
        """Sessions hold nothing open."""
