"""Streams that append what is new to a table, and can be run again after a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> None:
    """Takes all files of ``source`` that have come since the last run and appends rows with new keys to ``target``.

    Each micro-batch is one file.  A batch that runs again after a stop finds its own rows in the target and leaves them
    out, as it does rows of keys that came before; of rows with one key in a batch one is taken.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(keys)
        there = batch.sparkSession.read.schema(batch.schema).parquet(target).select(*keys)
        new.join(there, keys, "left_anti").write.mode("append").parquet(target)

    spark.createDataFrame([], schema).write.mode("append").parquet(target)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
