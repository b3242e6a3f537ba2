"""Linear probes: centroid directions, scoring, and matrices of trained against tested classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.scalars import dot, sigmoid


def centroid_probe(acts: DataFrame, by: list[str]) -> DataFrame:
    """Per group the mean of positive vectors minus the mean of negative ones."""
    dims = acts.select(*by, "y", F.posexplode("x").alias("i", "v"))
    means = dims.groupBy(*by, "i").agg((F.avg(F.when(F.col("y") == 1, F.col("v"))) - F.avg(F.when(F.col("y") == 0, F.col("v")))).alias("w"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda z: z["w"])
    return means.groupBy(*by).agg(ordered.alias("w"))


def score_all(acts: DataFrame, probes: DataFrame, most_probes: int = 1000) -> DataFrame:
    """Every vector with every probe.  Probes are a small dimension; their number is checked before broadcasting."""
    n = probes.limit(most_probes + 1).count()
    if n > most_probes:
        raise ValueError(f"more than {most_probes} probes")
    return acts.crossJoin(F.broadcast(probes)).withColumn("score", dot(F.col("x"), F.col("w")))


def block_means(matrix: DataFrame) -> DataFrame:
    """Weighted mean AUC per pair of families, with and without the diagonal; undefined cells are left out."""
    ok = F.col("auc").isNotNull() & (F.col("n") > 0)
    off = ok & (F.col("train") != F.col("test"))
    mean = lambda c: F.sum(F.when(c, F.col("auc") * F.col("n"))) / F.nullif(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return matrix.groupBy("train_family", "test_family").agg(mean(ok).alias("mean_all"), mean(off).alias("mean_off_diagonal"))


def probabilities(acts: DataFrame, probe: DataFrame) -> DataFrame:
    """Every vector's probability by one probe (w, b), a table of one row."""
    one = F.broadcast(probe.select("w", "b").limit(1))
    return acts.crossJoin(one).withColumn("prob", sigmoid(dot(F.col("x"), F.col("w")) + F.col("b"))).drop("w", "b")


def rest_probes(vectors: DataFrame, label: str) -> DataFrame:
    """(label, w): each label's mean vector less the mean of all others, from sums per label."""
    sums = vectors.select(label, F.posexplode("x").alias("i", "v")).groupBy(label, "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = sums.groupBy("i").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    rest = (F.col("_s") - F.col("s")) / F.nullif(F.col("_n") - F.col("n"), F.lit(0))
    means = sums.join(whole, "i").select(label, "i", (F.col("s") / F.col("n") - rest).alias("w"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda z: z["w"]).alias("w"))
