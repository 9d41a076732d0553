"""Cut lineage by writing a table to the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where none is set and Spark runs in one process (``local`` or ``local[n]``) a
    temporary folder is made; on a cluster a machine-local folder would be wrong.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="ledger-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Paths written in the scopes that are open, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that :func:`materialize` writes inside when the block ends, also by an
    error, but for those written with ``keep``: they belong to the block around, if any."""
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in written:
            hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Unlike a cached block the table survives the loss of executors, and unlike
    an RDD checkpoint later queries prune its columns and push filters to it.
    Inside of :func:`scratch` it lives as long as the block, or with ``keep`` longer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/ledger_analytics/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)  # before it is written, so that a half-written one goes too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
