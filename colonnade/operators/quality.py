"""Problem 4: column-level data quality from footers, dictionaries and, where those do not suffice, the data.

``profile_files`` profiles every flat column of a Parquet table: nulls and numeric extrema come from the footers, distinct
values from the dictionary pages, and only column chunks without usable statistics or with pages outside the dictionary
are read. ``load_findings`` checks recorded statistics of many columns and loads against a table of their values in long
form: loads whose row groups hold nothing else are settled from footers and dictionaries, and the others are scanned.
``write_clustered`` writes such values so that every row group holds one load.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colonnade.plans.scratch import Scratch
from colonnade.sources.footers import dictionary, open_file, statistics

STORED = {"timestamp": pa.int64(), "date32[day]": pa.int32(), "time": pa.int64(), "string": pa.binary(), "large_string": pa.binary()}


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file) of the table's files, one task for every few of them."""
    files = spark.read.parquet(path).inputFiles() if isinstance(path, str) else path
    parts = max(1, min(len(files), 10_000))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(parts)


def _groups_of(files: DataFrame) -> DataFrame:
    """(file, row_group) of all row groups, spread over tasks whatever files they are in."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                with open_file(uri) as raw:
                    n = pq.ParquetFile(raw).metadata.num_row_groups
                yield pd.DataFrame({"file": uri, "row_group": np.arange(n, dtype=np.int32)})

    return _spread(files.mapInPandas(work, "file string, row_group int"))


def _spread(groups: DataFrame) -> DataFrame:
    """Row groups over a fixed number of tasks: their names are few bytes, so adaptive execution would put them all in one."""
    return groups.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism, "file", "row_group").sortWithinPartitions("file", "row_group")


def _stored(values: pa.Array) -> pa.Array:
    """Values as the file stores them, so that scanned ones equal those of a dictionary."""
    kind = str(values.type)
    for name, to in STORED.items():
        if kind.startswith(name):
            return values.cast(to)
    return values


def _text(values: pa.Array) -> list[str]:
    if pa.types.is_binary(values.type):
        return [v.hex() for v in values.to_pylist()]
    return [repr(v) for v in values.to_pylist()]


def profile_files(spark: SparkSession, path: str) -> DataFrame:
    """(column, rows, nulls, distinct, low, high, chunks, scanned) of every flat column of a Parquet table.

    low and high are the extrema of numeric columns as doubles, NaN left out, and null for other columns, all-null columns
    and empty tables; chunks and scanned tell how many column chunks there are and how many had to be read. Columns inside
    arrays and maps are left out. distinct counts values other than null, with NaN as one value.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, mine in batch.groupby("file"):
                with open_file(uri) as raw, open_file(uri) as again:
                    f = pq.ParquetFile(raw)
                    flat = [i for i in range(len(f.schema)) if f.schema.column(i).max_repetition_level == 0 and "." not in f.schema.column(i).path]
                    for g in mine["row_group"].tolist():
                        group = f.metadata.row_group(g)
                        for i in flat:
                            chunk = group.column(i)
                            name = chunk.path_in_schema
                            nulls, low, high = statistics(chunk)
                            numeric = chunk.physical_type in ("INT32", "INT64", "FLOAT", "DOUBLE") and f.schema.column(i).logical_type.type in ("NONE", "INT")
                            found = dictionary(again, chunk)
                            scan = found is None or nulls is None or numeric and low is None and nulls < group.num_rows
                            if scan:
                                column = f.read_row_group(g, columns=[name]).column(0)
                                column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                                nulls = column.null_count
                                found = _stored(pc.unique(column.drop_null()))
                                if numeric:
                                    finite = found.filter(pc.invert(pc.is_nan(found))) if pa.types.is_floating(found.type) else found
                                    e = pc.min_max(finite)
                                    low, high = e["min"].as_py(), e["max"].as_py()
                            if not numeric or nulls == group.num_rows:
                                low = high = None
                            texts = _text(found)
                            yield pd.DataFrame(
                                {
                                    "column": [name] * (len(texts) + 1), "value": [None, *texts],
                                    "rows": [group.num_rows, *[0] * len(texts)], "nulls": [nulls, *[0] * len(texts)],
                                    "low": [low, *[None] * len(texts)], "high": [high, *[None] * len(texts)],
                                    "chunks": [1, *[0] * len(texts)], "scanned": [int(scan), *[0] * len(texts)],
                                }
                            ).astype({"low": "float64", "high": "float64"})

    out = "column string, value string, rows bigint, nulls bigint, low double, high double, chunks bigint, scanned bigint"
    got = _groups_of(_files(spark, path)).mapInPandas(work, out)
    clean = got.withColumn("low", F.nanvl("low", F.lit(None).cast("double"))).withColumn("high", F.nanvl("high", F.lit(None).cast("double")))
    # one row for each column and value first, so that no task gets all values of a column
    each = clean.groupBy("column", "value").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("chunks").alias("chunks"), F.sum("scanned").alias("scanned"),
    )
    return each.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.count("value").alias("distinct"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("chunks").alias("chunks"), F.sum("scanned").alias("scanned"),
    )


class LoadValues(NamedTuple):
    loads: DataFrame  #: (column_id, load_no, rows, nulls, distinct)
    values: DataFrame  #: (column_id, load_no, value, n) of the distinct values; n is null where only a dictionary was read
    settled: int  #: loads that no scan was needed for


def _row_groups(spark: SparkSession, path: str | list[str], shares_up_to: int) -> DataFrame:
    """What the footers tell of each row group of the values: its only load, if it has one, and whether that settles it.

    That no row is delivered twice is told by a dictionary of as many row numbers as rows; where the writer kept none, the
    chunk of row numbers, and no other, is read for it.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for uri, mine in batch.groupby("file"):
                with open_file(uri) as raw, open_file(uri) as again:
                    f = pq.ParquetFile(again)
                    for g in mine["row_group"].tolist():
                        group = f.metadata.row_group(g)
                        at = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
                        (cn, c0, c1), (ln, l0, l1), (rn, r0, r1) = (statistics(at[k]) for k in ("column_id", "load_no", "row_no"))
                        nulls = statistics(at["value"])[0]
                        one = c0 is not None and c0 == c1 and l0 is not None and l0 == l1 and cn == 0 and ln == 0
                        settles, distinct, read = False, 0, 0
                        if one and nulls is not None and rn == 0 and r0 is not None and r1 - r0 + 1 >= group.num_rows:
                            values = dictionary(raw, at["value"])
                            if values is not None and len(values) > shares_up_to:
                                numbers = dictionary(raw, at["row_no"])
                                if numbers is None:
                                    numbers, read = pc.unique(f.read_row_group(g, columns=["row_no"]).column(0)), 1
                                settles, distinct = len(numbers) == group.num_rows, len(values)
                        out.append((uri, g, group.num_rows, one, settles, c0, c1, l0, l1, r0, r1, nulls, distinct, read))
            names = ["file", "row_group", "rows", "one", "settles", "c0", "c1", "load_no", "l1", "r0", "r1", "nulls", "distinct", "read"]
            yield pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("c0", "c1", "load_no", "l1", "r0", "r1", "nulls")})

    shape = "file string, row_group int, rows bigint, one boolean, settles boolean, c0 bigint, c1 bigint, load_no bigint, l1 bigint, r0 bigint, r1 bigint, nulls bigint, distinct bigint, read int"
    return _groups_of(_files(spark, path)).mapInPandas(work, shape)


def _loads_of(groups: DataFrame) -> DataFrame:
    """(column_id, load_no) of the loads that have rows in the row groups (file, row_group)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, mine in batch.groupby("file"):
                with open_file(uri) as raw:
                    f = pq.ParquetFile(raw)
                    for g in mine["row_group"].tolist():
                        yield f.read_row_group(g, columns=["column_id", "load_no"]).to_pandas().dropna().drop_duplicates().astype("int64")

    return _spread(groups).mapInPandas(work, "column_id bigint, load_no bigint").distinct()


def _dictionary_values(chunks: DataFrame) -> DataFrame:
    """(column_id, load_no, value) of the dictionaries of settled row groups."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, mine in batch.groupby("file"):
                with open_file(uri) as raw, open_file(uri) as again:
                    meta = pq.ParquetFile(again).metadata
                    parts = []
                    for r in mine.itertuples():
                        group = meta.row_group(r.row_group)
                        column = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema == "value")
                        parts.append((r.c0, r.load_no, [v.decode("utf-8") for v in dictionary(raw, column).to_pylist()]))
                sizes = [len(p[2]) for p in parts]
                yield pd.DataFrame({"column_id": np.repeat([p[0] for p in parts], sizes), "load_no": np.repeat([p[1] for p in parts], sizes), "value": [v for p in parts for v in p[2]]})

    chunks = _spread(chunks.select("file", "row_group", "c0", "load_no"))
    return chunks.mapInPandas(work, "column_id bigint, load_no bigint, value string").distinct()


def load_values(spark: SparkSession, path: str | list[str], scratch: Scratch, shares_up_to: int = 12) -> LoadValues:
    """Counts of each load of a table (column_id, load_no, row_no, value, ...), a row number delivered twice counted once.

    A load is settled without a scan if all its row groups hold only it, state their nulls, have disjoint row numbers each
    delivered once, and have a dictionary of more than ``shares_up_to`` values (with fewer the shares are needed). Of two
    deliveries of a row that differ, the smaller value counts, and a value before null. Rows without column_id, load_no or
    row_no are no rows of a load.
    """
    groups = scratch.keep(_row_groups(spark, path, shares_up_to), "row_groups")
    order = Window.partitionBy("c0", "load_no").orderBy("r0")
    alone = groups.where("one").withColumn("apart", F.coalesce(F.col("r0") > F.max("r1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    settled = alone.groupBy("c0", "load_no").agg(F.min(F.col("settles") & F.col("apart")).alias("ok"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls")).where("ok")
    # a load is open if a row group of several holds some of it; only the two columns that name loads are read of those
    several = _loads_of(groups.where("not one").select("file", "row_group")).withColumnRenamed("column_id", "c0")
    settled = settled.join(several, ["c0", "load_no"], "left_anti")
    settled = scratch.keep(settled.select(F.col("c0").alias("column_id"), "load_no", "rows", "nulls"), "settled")
    n_settled = settled.count()
    if path:
        table = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        table = spark.createDataFrame([], "column_id bigint, load_no int, row_no int, value string")
    if n_settled:
        keys = settled.select(F.col("column_id").alias("c0"), "load_no")
        rest = [r[0] for r in groups.join(keys, ["c0", "load_no"], "left_anti").select("file").distinct().collect()]
        table = spark.read.schema(table.schema).parquet(*rest) if rest else table.limit(0)
    cells = table.select(F.col("column_id").cast("bigint"), F.col("load_no").cast("bigint"), "row_no", "value")
    if n_settled:
        cells = cells.join(settled.select("column_id", "load_no"), ["column_id", "load_no"], "left_anti")
    cells = cells.where("column_id is not null and load_no is not null and row_no is not null")
    once = cells.groupBy("column_id", "load_no", "row_no").agg(F.min("value").alias("value"))
    counts = scratch.keep(once.groupBy("column_id", "load_no", "value").agg(F.count("*").alias("n")), "counts")
    loads = counts.groupBy("column_id", "load_no").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct")
    )
    values = counts.where("value is not null")
    if n_settled:
        keys = settled.select(F.col("column_id").alias("c0"), "load_no")
        read = scratch.keep(_dictionary_values(groups.join(keys, ["c0", "load_no"], "left_semi")), "dictionaries")
        each = read.groupBy("column_id", "load_no").agg(F.count("*").alias("distinct"))
        loads = loads.union(settled.join(each, ["column_id", "load_no"]).select("column_id", "load_no", "rows", "nulls", "distinct"))
        values = values.union(read.select("column_id", "load_no", "value", F.lit(None).cast("bigint").alias("n")))
    return LoadValues(loads, values, n_settled)


def format_pattern(c: Column) -> Column:
    """The regular expression of a format: INT, or 9 for a digit, A for a capital letter and other characters as they are."""
    each = F.transform(
        F.split(c, ""),
        lambda x: F.when(x == "9", "[0-9]").when(x == "A", "[A-Z]").when(x.rlike(r"^[A-Za-z0-9]$"), x).otherwise(F.when(x == "", "").otherwise(F.concat(F.lit("\\"), x))),
    )
    return F.when(c == "INT", r"\A-?[0-9]+\z").otherwise(F.concat(F.lit(r"\A"), F.array_join(each, ""), F.lit(r"\z")))


def write_clustered(cells: DataFrame, path: str, most_rows: int = 1_000_000) -> list[str]:
    """Writes values (column_id, load_no, row_no, value), a row of a load each, so that a row group holds rows of one load only.

    Returns the files. A load above ``most_rows`` has several row groups, with rising row numbers. Rows delivered twice are
    written once: the smaller value, and a value before null. Each try of a task writes files of its own, and only those of
    the tries that ended are returned, so a lost executor leaves nothing behind that counts.
    """
    keys = ["column_id", "load_no", "row_no"]
    rows = cells.select(F.col("column_id").cast("bigint"), F.col("load_no").cast("int"), F.col("row_no").cast("int"), "value").where("column_id is not null and load_no is not null and row_no is not null")
    once = rows.groupBy(*keys).agg(F.min("value").alias("value"))
    sorted_ = once.repartitionByRange("column_id", "load_no").sortWithinPartitions(*keys)
    shape = pa.schema([("column_id", pa.int64()), ("load_no", pa.int32()), ("row_no", pa.int32()), ("value", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        uri, writer, held, n = f"{path.rstrip('/')}/{uuid.uuid4().hex}.parquet", None, [], 0
        system, name = fs.FileSystem.from_uri(uri)
        for batch in batches:
            c, ln = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(ln) != 0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if writer is None:
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    writer = pq.ParquetWriter(system.open_output_stream(name), shape, compression="zstd")
                part = pa.Table.from_batches([batch.slice(s, e - s)]).cast(shape)
                if held and (held[-1]["column_id"][-1], held[-1]["load_no"][-1]) != (part["column_id"][0], part["load_no"][0]) or n + len(part) > most_rows:
                    if held:
                        writer.write_table(pa.concat_tables(held), row_group_size=n)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if writer is not None:
            writer.write_table(pa.concat_tables(held), row_group_size=n)
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["file"])

    return [r[0] for r in sorted_.mapInArrow(work, "file string").collect()]


def load_findings(spark: SparkSession, profile: DataFrame, values_path: str | list[str], null_shift: float = 0.25, value_shift: float = 0.45, shares_up_to: int = 12) -> DataFrame:
    """(column_id, load_no, finding) for each load of ``profile`` that its values contradict; each finding once.

    profile has (column_id, load_no, data_format, min_value, max_value, value_statistics), a row for each load; a load
    without values has no nulls and no distinct values and takes no part in drift. Findings: ``null_count``,
    ``distinct_count``, ``format``, ``range``, ``drift``. Statistics, formats and bounds that are null find nothing. Shares
    are compared in whole numbers, so that a shift of exactly the limit counts.
    """
    scratch = Scratch(spark)
    got = load_values(spark, values_path, scratch, shares_up_to)
    on = ["column_id", "load_no"]
    told = profile.select(
        F.col("column_id").cast("bigint"), F.col("load_no").cast("bigint"), "data_format", "min_value", "max_value",
        F.col("value_statistics.null_count").alias("told_nulls"), F.col("value_statistics.distinct_count").alias("told_distinct"),
    )
    loads = scratch.keep(told.join(got.loads, on, "left").fillna(0, ["rows", "nulls", "distinct"]), "loads")
    counted = [
        loads.where("told_nulls <> nulls").select(*on, F.lit("null_count").alias("finding")),
        loads.where("told_distinct <> distinct").select(*on, F.lit("distinct_count").alias("finding")),
    ]
    formats = loads.where("data_format is not null").select(*on, "data_format", "min_value", "max_value", format_pattern(F.col("data_format")).alias("pattern"))
    number = F.expr("try_cast(value as double)")
    tested = got.values.join(formats, on).select(*on, "data_format", F.regexp_like("value", "pattern").alias("fits"), ((number < F.col("min_value")) | (number > F.col("max_value"))).alias("outside"))
    kinds = F.array(F.when(~F.col("fits"), "format"), F.when(F.col("fits") & (F.col("data_format") == "INT") & F.col("outside"), "range"))
    formed = tested.select(*on, F.explode(F.array_compact(kinds)).alias("finding")).distinct()
    before = Window.partitionBy("column_id").orderBy("load_no")
    steps = loads.select(*on, "rows", "nulls", "distinct", *[F.lag(c).over(before).alias(f"{c}0") for c in ("load_no", "rows", "nulls", "distinct")])
    steps = scratch.keep(steps.where("rows > 0 and rows0 > 0"), "steps")
    most = round(null_shift * 1000)
    shifted = steps.where(F.abs(F.col("nulls") * F.col("rows0") - F.col("nulls0") * F.col("rows")) * 1000 >= most * F.col("rows") * F.col("rows0")).select(*on)
    few = steps.where(F.col("distinct").between(1, shares_up_to) & F.col("distinct0").between(1, shares_up_to))
    few = few.select(*on, "load_no0", (F.col("rows") - F.col("nulls")).alias("all"), (F.col("rows0") - F.col("nulls0")).alias("all0"))
    now = got.values.join(few, on).select(*on, "value", "all", "all0", F.col("n").alias("now"), F.lit(0).cast("bigint").alias("then"))
    then = got.values.withColumnRenamed("load_no", "load_no0").join(few, ["column_id", "load_no0"]).select(*on, "value", "all", "all0", F.lit(0).cast("bigint").alias("now"), F.col("n").alias("then"))
    both = now.union(then).groupBy(*on, "value", "all", "all0").agg(F.sum("now").alias("now"), F.sum("then").alias("then"))
    apart = both.groupBy(*on, "all", "all0").agg(F.sum(F.abs(F.col("now") * F.col("all0") - F.col("then") * F.col("all"))).alias("d"))
    moved = apart.where(F.col("d") * 1000 >= round(2000 * value_shift) * F.col("all") * F.col("all0")).select(*on)
    drift = shifted.union(moved).distinct().select(*on, F.lit("drift").alias("finding"))
    out = counted[0].union(counted[1]).union(formed).union(drift)
    return out.select("column_id", F.col("load_no").cast("int"), "finding")
