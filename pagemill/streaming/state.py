"""State tables that micro-batches replace version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "_version"


class VersionedTable:
    """A Parquet folder with one sub-folder per micro-batch.

    Writing version n reads the newest version below n and overwrites n, so a batch that is tried
    again after a failure gives the same table. Old versions may be removed at any time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith(f"{VERSION}="))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self._versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{VERSION}={known[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.select(*[F.col(c) for c in df.columns]).write.mode("overwrite").parquet(f"{self.path}/{VERSION}={version}")
