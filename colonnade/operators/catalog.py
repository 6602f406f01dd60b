"""Tables, columns and constraints as DataFrames. Parquet has no keys, so constraints are given as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (table, key columns) and (table, columns, target table, target columns) of the star schema.
PRIMARY_KEYS = [
    ("region", ["r_regionkey"]), ("nation", ["n_nationkey"]), ("customer", ["c_custkey"]), ("supplier", ["s_suppkey"]),
    ("part", ["p_partkey"]), ("orders", ["o_orderkey"]), ("events", ["event_id"]), ("embeddings", ["vec_id"]),
]
FOREIGN_KEYS = [
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]), ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]), ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]), ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
]

TEXT_TYPES, NUMBER_TYPES = ("string", "char", "varchar"), ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def type_family(simple: str) -> str:
    """text, number, time, bytes or other, from a Spark type's simple name."""
    if simple.startswith(TEXT_TYPES):
        return "text"
    if simple.startswith(("date", "timestamp")):
        return "time"
    if simple.startswith(NUMBER_TYPES):
        return "number"
    return "bytes" if simple == "binary" else "other"


def stored_tables(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    """The Parquet tables of a directory by name, in order; each is a file or a folder ``name.parquet``."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found)
    return {n.removesuffix(".parquet"): spark.read.parquet(f"{directory}/{n}") for n in names if n.endswith(".parquet")}


def columns_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type, family) of all columns."""
    rows = [
        (t, f.name, i, f.dataType.simpleString(), type_family(f.dataType.simpleString()))
        for t, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string, family string")


def primary_keys_frame(spark: SparkSession, keys=PRIMARY_KEYS) -> DataFrame:
    rows = [(t, c, i) for t, cs in keys for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int")


def foreign_keys_frame(spark: SparkSession, keys=FOREIGN_KEYS) -> DataFrame:
    """A row for each column pair of a foreign key: (fk_id, seq, table_name, column_name, target_table, target_column)."""
    rows = [(i, s, t, c, tt, cc) for i, (t, cs, tt, tcs) in enumerate(keys) for s, (c, cc) in enumerate(zip(cs, tcs))]
    return spark.createDataFrame(rows, "fk_id int, seq int, table_name string, column_name string, target_table string, target_column string")


def repair_foreign_keys(fks: DataFrame, pks: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign keys without repeats; a missing target column becomes the target's key column, its only one or the one of the
    same name; keys to unknown columns are dropped."""
    single = pks.groupBy("table_name").agg(F.count("*").alias("n"), F.first("column_name").alias("only"))
    single = single.select(F.col("table_name").alias("target_table"), F.when(F.col("n") == 1, F.col("only")).alias("only"))
    same = pks.select(F.col("table_name").alias("target_table"), F.lower("column_name").alias("k"), F.col("column_name").alias("same"))
    full = fks.join(single, "target_table", "left").withColumn("k", F.lower("column_name")).join(same, ["target_table", "k"], "left")
    full = full.withColumn("target_column", F.coalesce("target_column", "only", "same")).where("target_column is not null")
    known = columns.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"))
    own = columns.select("table_name", "column_name")
    full = full.join(known, ["target_table", "target_column"], "left_semi").join(own, ["table_name", "column_name"], "left_semi")
    return full.select(*fks.columns).dropDuplicates(["table_name", "column_name", "target_table", "target_column"])


def grouped_foreign_keys(fks: DataFrame) -> DataFrame:
    """One row for each foreign key with its column lists in order."""
    pairs = F.array_sort(F.collect_list(F.struct("seq", "column_name", "target_column")))
    got = fks.groupBy("fk_id", "table_name", "target_table").agg(pairs.alias("p"))
    return got.select("table_name", F.col("p.column_name").alias("columns"), "target_table", F.col("p.target_column").alias("target_columns"))


def topology(fks: DataFrame) -> DataFrame:
    """(table_name, out_degree, in_degree): foreign keys that leave and reach each table."""
    out = fks.groupBy("table_name").agg(F.countDistinct("fk_id").alias("out_degree"))
    into = fks.groupBy(F.col("target_table").alias("table_name")).agg(F.countDistinct("fk_id").alias("in_degree"))
    return out.join(into, "table_name", "full").fillna(0, ["out_degree", "in_degree"])


def filter_linked(columns: DataFrame, linked: DataFrame, pks: DataFrame, fks: DataFrame) -> DataFrame:
    """The linked columns, with the primary keys of the kept tables and both ends of the foreign keys between them."""
    kept = linked.select("table_name").distinct()
    keys = pks.join(kept, "table_name", "left_semi").select("table_name", "column_name")
    target = kept.select(F.col("table_name").alias("target_table"))
    between = fks.join(kept, "table_name", "left_semi").join(target, "target_table", "left_semi")
    ends = between.select("table_name", "column_name").union(between.select("target_table", "target_column"))
    want = linked.select("table_name", "column_name").union(keys).union(ends).distinct()
    return columns.join(want, ["table_name", "column_name"], "left_semi")


def joins_between(fks: DataFrame, kept: DataFrame) -> DataFrame:
    """Foreign keys whose two ends are both among the given tables."""
    return fks.join(kept.select("table_name"), "table_name", "left_semi").join(kept.select(F.col("table_name").alias("target_table")), "target_table", "left_semi")


def ddl(df: DataFrame, table: str, pk: list[str] = (), fks: list[tuple] = ()) -> str:
    """CREATE TABLE text of a table with its keys."""
    parts = [f"  {f.name} {f.dataType.simpleString().upper()}" for f in df.schema.fields]
    if pk:
        parts.append(f"  PRIMARY KEY ({', '.join(pk)})")
    parts += [f"  FOREIGN KEY ({', '.join(c)}) REFERENCES {t} ({', '.join(tc)})" for c, t, tc in fks]
    return f"CREATE TABLE {table} (\n" + ",\n".join(parts) + "\n)"


def same_name_columns(columns: DataFrame, skip: tuple[str, ...] = ("id", "created_at", "updated_at"), most: int | None = 5) -> DataFrame:
    """Columns of one name in two tables, table_a before table_b; at most ``most`` names for each pair of tables."""
    a = columns.select(F.lower("column_name").alias("k"), F.col("table_name").alias("table_a"), F.col("column_name").alias("column_name"))
    b = columns.select(F.lower("column_name").alias("k"), F.col("table_name").alias("table_b"))
    got = a.where(~F.col("k").isin(*skip)).join(b, "k").where("table_a < table_b").select("table_a", "table_b", "column_name")
    if most is None:
        return got
    from pyspark.sql import Window

    w = Window.partitionBy("table_a", "table_b").orderBy("column_name")
    return got.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
