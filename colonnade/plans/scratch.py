"""Intermediate tables in the checkpoint folder shared by all executors.

Iterative operators cut their lineage by writing a table and reading it back. The folder is the one the cluster names
in ``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []


def _root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="colonnade-"))
        atexit.register(shutil.rmtree, _local_root[0], ignore_errors=True)
    return f"file://{_local_root[0]}"


class Scratch:
    """Tables of one operator run; ``drop`` removes those no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{_root(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self.drop_all)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return it without its lineage."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                self._delete(path)

    def drop_all(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone by then
            pass
