"""Streaming forms: record ingest without repeats, and windows over events.

The batch form of record deduplication compares with everything stored. On a stream the state is bounded by a watermark:
a record that comes again within it is dropped there, and what gets through is appended by the batch form in each
micro-batch, so that repeats from any time are dropped in the end. Windows are an extension beyond record ingest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colonnade.functions import text as T
from colonnade.operators import memory


def record_key(db: str = "database_id", question: str = "user_query", sql: str = "generated_sql") -> list:
    return [F.lower(F.col(db)), T.normalise_question(F.col(question)), T.normalise_sql(F.col(sql))]


def without_repeats(records: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream of records without those whose key came within the delay before."""
    names = ["_db", "_q", "_s"]
    keyed = records.withColumns(dict(zip(names, record_key()))).withWatermark(ts, delay)
    return keyed.dropDuplicatesWithinWatermark(names).drop(*names)


def append_new(read_store: Callable[[], DataFrame], write: Callable[[DataFrame], None], order: str = "record_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends what the store does not hold yet.

    A batch that is run again after a failure finds its rows in the store and appends nothing twice.
    """

    def each(batch: DataFrame, _: int) -> None:
        write(memory.dedup_records(read_store(), batch, record_key(), order))

    return each


def start_ingest(records: DataFrame, store: str, checkpoint: str, ts: str = "ts", delay: str = "10 minutes") -> StreamingQuery:
    """Ingests a stream of records into a Parquet store partitioned by year, until what is there has been read."""
    spark = records.sparkSession
    schema = records.schema

    def read() -> DataFrame:
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(schema).parquet(store)
        return spark.createDataFrame([], schema)

    def write(df: DataFrame) -> None:
        df.withColumn("year", F.year(ts)).write.mode("append").partitionBy("year").parquet(store)

    stream = without_repeats(records, ts, delay)
    return stream.writeStream.foreachBatch(append_new(read, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, ts: str, kind: str, value: str, length: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Count and sum of each kind in tumbling or sliding windows, for a batch or a stream."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    marked = events.withWatermark(ts, delay) if events.isStreaming else events
    got = marked.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("start"), kind, "n", "total")


def event_sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: the runs of events with no pause of ``gap``."""
    marked = events.withWatermark(ts, delay) if events.isStreaming else events
    got = marked.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return got.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
