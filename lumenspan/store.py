"""Tables that jobs write for their own later steps.

A step that is read more than once, or whose row order must stay fixed, is written as Parquet in the folder that the
cluster shares (``spark.checkpoint.dir``) and read again.  That cuts the lineage, and a lost executor costs at most
the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` where the cluster sets it.  Where it is unset a local session gets a folder of the
    application's own, which is then also the checkpoint folder; a cluster has to set it.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-lumenspan-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that a job wrote for itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Staged tables that are removed on leaving the ``with`` block, when what was made of them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __enter__(self) -> Scratch:
        return self

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        table = _written(df, path)
        self.tables.append((table, path))
        return table

    def drop(self, table: DataFrame | None) -> None:
        """Removes a table of this block that nothing reads any more; others are left alone."""
        for own, path in self.tables:
            if own is table:
                delete(self.spark, path)
        self.tables = [(own, path) for own, path in self.tables if own is not table]

    def __exit__(self, *error: object) -> None:
        for _, path in self.tables:
            delete(self.spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lumenspan-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and the table read from there."""
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_bytes(df: DataFrame) -> int:
    """About what ``df``'s rows take in memory; reads it once."""
    size = F.lit(16)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            size = size + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + 24 + 8 * F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0))
        else:
            size = size + 8
    return df.agg(F.sum(size)).first()[0] or 0


def broadcast_if_small(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``df`` with a hint: broadcast where its rows take ``limit`` bytes at most, otherwise joined by a shuffle."""
    return F.broadcast(df) if held_bytes(df) <= limit else df.hint("merge")
