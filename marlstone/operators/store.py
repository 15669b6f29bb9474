"""Versioned tables: each write is a new Parquet folder, and the highest finished one is current.

A version is finished when its ``_SUCCESS`` file is there, which Spark writes last, so readers never see half a version and a
writer may read the table that it replaces. One writer at a time; old versions are dropped on request.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class TableStore:
    def __init__(self, spark: SparkSession, root: str, prefix: str = "") -> None:
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _at(self, name: str) -> str:
        return f"{self.root}/{self.prefix}{name}"

    def versions(self, name: str) -> list[int]:
        fs, path = self._fs()
        top = path(self._at(name))
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(path(p, "_SUCCESS")))

    def names(self) -> list[str]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(s.getPath().getName()[len(self.prefix) :] for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith(self.prefix))

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The current version; an empty frame of the schema if there is none."""
        have = self.versions(name)
        if not have:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self._at(name)}/v{have[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        number = (self.versions(name) or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self._at(name)}/v{number}")
        return self.read(name)

    def change(self, name: str, step: Callable[[DataFrame], DataFrame], schema: T.StructType | None = None) -> DataFrame:
        return self.write(name, step(self.read(name, schema)))

    def vacuum(self, name: str, keep: int = 1) -> None:
        fs, path = self._fs()
        for number in self.versions(name)[:-keep]:
            fs.delete(path(f"{self._at(name)}/v{number}"), True)
