"""Keyed tables on plain Parquet: every change writes a new version and then points to it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """A table with a key. Readers see whole versions; a version that is being read is never overwritten. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _pointer(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def read(self) -> DataFrame | None:
        system, at = self._pointer()
        if not system.exists(at):
            return None
        version = self.spark.read.text(at.toString()).first()[0]
        return self.spark.read.parquet(f"{self.path}/{version}")

    def overwrite(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{version}")
        system, at = self._pointer()
        out = system.create(at, True)
        out.write(bytearray(version.encode()))
        out.close()

    def upsert(self, rows: DataFrame, newest: str | None = None) -> None:
        """Rows replace those of their key; of several new ones the one with the largest newest stays (the largest row, without one)."""
        if newest:
            order = Window.partitionBy(*self.keys).orderBy(F.desc(newest))
            rows = rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        else:
            rest = [c for c in rows.columns if c not in self.keys]
            rows = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*self.keys, "_row.*") if rest else rows.distinct()
        old = self.read()
        self.overwrite(rows if old is None else old.join(rows, self.keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> None:
        if (old := self.read()) is not None:
            self.overwrite(old.join(keys, self.keys, "left_anti"))

    def truncate(self) -> None:
        if (old := self.read()) is not None:
            self.overwrite(old.limit(0))
