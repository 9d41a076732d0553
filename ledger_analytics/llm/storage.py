"""Intermediate tables in the shared checkpoint folder, removed when no longer read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledger_analytics.llm.arrow import bounded_batches
from ledger_analytics.sources.materialize import checkpoint_root


class Stored:
    """Writes tables that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self._spark, self._paths = spark, {}

    def write(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The written table, and its number of rows as counted while writing."""
        path = f"{checkpoint_root(self._spark)}/llm/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        back = self._spark.read.schema(df.schema).parquet(path)
        self._paths[path] = back
        return back, back.count()

    def table(self, df: DataFrame) -> DataFrame:
        return self.write(df)[0]

    def keep(self, *tables: DataFrame) -> None:
        """Delete what has been written so far but for ``tables``."""
        for path, df in list(self._paths.items()):
            if not any(df is t for t in tables):
                self._delete(path)
                del self._paths[path]

    def _delete(self, path: str) -> None:
        jvm = self._spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(where, True)
