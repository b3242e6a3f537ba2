"""Scans with checks, shard assignment, merge gates and violations queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.store import new_path, staged


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a given schema; blank lines are skipped, broken ones fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_dump(df: DataFrame, path: str, by: list[str]) -> None:
    """A column dump partitioned for pruning; existing output is left as it is, so reruns resume."""
    df.write.mode("ignore").partitionBy(*by).parquet(path)


def shard_of(i: Column, n: int, shards: int) -> Column:
    """Contiguous shards: shard s holds rows from floor(s * n / shards) on."""
    return F.floor(((i + 1) * shards - 1) / n).cast("long")


def merge_last(shards: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of several values of a key the one of the last file."""
    return shards.groupBy(key).agg(F.max_by(value, order).alias(value))


def row_violations(rows: DataFrame) -> DataFrame:
    """(eid, rule) of every broken rule of labelled examples; no row means valid."""
    checks = {
        "label is 0 or 1": F.coalesce(F.col("row_label").isin(0, 1), F.lit(False)),
        "code is not empty": F.length(F.coalesce("code", F.lit(""))) > 0,
        "positive has a class": (F.col("row_label") != 1) | F.col("cwe").isNotNull(),
        "negative has no class": (F.col("row_label") != 0) | F.col("cwe").isNull(),
    }
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in checks.items()]))
    return rows.select("eid", F.explode(broken).alias("rule"))


def written_jsonl(df: DataFrame) -> str:
    """Writes rows as JSON lines into the shared folder and gives the path."""
    path = new_path(df.sparkSession, "jsonl")
    df.write.json(path)
    return path


def numbered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``row``: the number of the line among all that aren't blank, by file and place in the file.

    Lines are numbered within the parts that files are read in; parts are offset by the counts of those before them.
    Lines that are no JSON object of the schema fail.
    """
    # Text files are split by line feeds in whole parts, each read by one task in order.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    lines = staged(lines.where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id()), "lines")
    parts = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row per part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.join(parts.select("f", "b", (before - F.col("first")).alias("shift")), ["f", "b"])
    parsed = F.from_json("value", F.lit(schema), {"mode": "FAILFAST"})
    return rows.select((F.col("at") + F.col("shift")).alias("row"), parsed.alias("r")).select("row", "r.*")


def projected_jsonl(spark: SparkSession, path: str, key: str, texts: list[str]) -> DataFrame:
    """Only the key and some text columns; a missing text is the empty one; a table without rows fails."""
    rows = read_jsonl(spark, path, ", ".join([key, *(f"{t} string" for t in texts)]))
    if rows.limit(1).count() == 0:
        raise ValueError(f"no rows in {path}")
    return rows.select(key.split()[0], *(F.coalesce(t, F.lit("")).alias(t) for t in texts))


def not_done(asked: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return asked.join(done, keys, "left_anti")


def stored_probe(probe: DataFrame) -> DataFrame:
    """A fitted probe (layer, w, b) written as a table and read again, as a later job would."""
    return staged(probe, "probe")


def scanned_leads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Leads with their position ``pos`` in their repository: by rank, those without one last; a missing path has none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    rows = read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)
    order = Window.partitionBy("repo_id").orderBy(F.coalesce("rank", F.lit(10**9)), "lead_id")
    return rows.withColumn("pos", F.row_number().over(order))


def span_violations(ex: DataFrame, spans: DataFrame) -> DataFrame:
    """(eid, key, s, e, rule) of every rule that a span breaks: its bounds, and overlap with one of its kind."""
    before = F.lag("e").over(Window.partitionBy("eid", "key").orderBy("s", "e"))
    rows = spans.join(ex.select("eid", F.length("code").alias("_n")), "eid").withColumn("_b", before)
    checks = {
        "starts before the text": F.col("s") < 0,
        "ends after the text": F.col("e") > F.col("_n"),
        "ends before it starts": F.col("e") < F.col("s"),
        "overlaps one of its kind": F.col("_b") > F.col("s"),
    }
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks.items()]))
    return rows.select("eid", "key", "s", "e", F.explode(broken).alias("rule"))
