"""Statistics over runs, scores and ids: spread, rank correlation, gates, sets, agreement and matrices of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.scalars import cosine
from lumenspan.operators.ranking import cumulative
from lumenspan.store import staged


def finite(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation over the values that are numbers, and how many these are."""
    x = finite(value)
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"))


def value_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n): the distinct numbers with their counts, which the functions below work on."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))


def _places(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds to (by, value, n) ``_upto``, the rows up to and with the value, and ``_all``, by buckets of values."""
    c = cumulative(counts.select(*by, F.col("value").alias("score"), F.col("n").alias("pos"), F.lit(0).cast("long").alias("neg")), by)
    return c.select(*by, F.col("score").alias("value"), F.col("pos").alias("n"), (F.col("P") - F.col("tp") + F.col("pos")).alias("_upto"), F.col("P").alias("_all"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """Exact percentiles, linear between neighbours, from counts per distinct value and cumulative counts.

    No group's values are put in order in one task: counts are summed first, and places come from buckets of values.
    """
    c = _places(value_counts(df, by, value), by)
    out = []
    for i, p in enumerate(shares):
        at = F.lit(p) * (F.col("_all") - 1)
        low, high = F.floor(at), F.ceil(at)
        # The k-th smallest value (from 0) is the first one whose cumulative count passes k.
        c = c.withColumn(f"_l{i}", F.when(F.col("_upto") > low, F.col("value"))).withColumn(f"_h{i}", F.when(F.col("_upto") > high, F.col("value")))
        x, y = F.min(f"_l{i}"), F.min(f"_h{i}")
        part = F.max(at - low)
        out.append((x + (y - x) * part).alias(f"p{round(p * 100):02d}"))
    return c.groupBy(*by).agg(*out, F.sum(F.col("value") * F.col("n")).alias("_s"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n")).withColumn(
        "mean", F.col("_s") / F.col("n")
    ).drop("_s")


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank from 1 by ``value``; ties share the mean of their places, rows with a null or NaN go.  Places are taken of distinct
    values, by buckets."""
    places = _places(value_counts(df.withColumn("_v", F.col(value)), [], "_v"), [])
    ranks = places.select(F.col("value").alias("_v"), (F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value).cast("double") == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("spearman"))


def above_share(df: DataFrame, score: str, label: str, threshold: DataFrame) -> DataFrame:
    """The share of negatives above a threshold given as a table of one row (thr)."""
    return df.where(F.col(label) == 0).crossJoin(F.broadcast(threshold)).agg(F.avg((F.col(score) > F.col("thr")).cast("double")).alias("share"))


def flip_rate(df: DataFrame, by: list[str], before: str, after: str, threshold: float = 0.5) -> DataFrame:
    """The share of scores below the threshold, before and after a calibration."""
    share = lambda c: F.avg((F.col(c) < threshold).cast("double"))
    return df.groupBy(*by).agg(share(before).alias("below_before"), share(after).alias("below_after"), F.count("*").alias("n"))


def direction_overlap(directions: DataFrame) -> DataFrame:
    """Mean absolute and mean squared cosine between different directions (key, w); there are few of them."""
    other = directions.select(F.col("key").alias("key2"), F.col("w").alias("w2"))
    c = directions.join(F.broadcast(other), F.col("key") != F.col("key2")).withColumn("c", cosine(F.col("w"), F.col("w2")))
    return c.agg(F.avg(F.abs("c")).alias("mean_abs"), F.avg(F.col("c") * F.col("c")).alias("mean_sq"), F.count("*").alias("n"))


def paired_cells(cells: DataFrame, keys: list[str], variant: str, base: str, value: str) -> DataFrame:
    """Every variant's mean difference to the ``base`` variant over the keys that both have."""
    b = cells.where(F.col(variant) == base).select(*keys, F.col(value).alias("_b"))
    d = cells.where(F.col(variant) != base).join(b, keys)
    return d.groupBy(variant).agg(F.avg(F.col(value) - F.col("_b")).alias("delta"), F.count("*").alias("n"))


def trusted_mean(cells: DataFrame, by: list[str], least: int) -> DataFrame:
    """Means weighted by n over the classes with ``least`` positives or more, and how many classes are left out."""
    ok = (F.col("n") >= least) & F.col("auc").isNotNull()
    total = F.sum(F.when(ok, F.col("n")))
    return cells.groupBy(*by).agg(
        (F.sum(F.when(ok, F.col("n") * F.col("auc"))) / F.nullif(total, F.lit(0))).alias("mean"), F.count_if(~ok).alias("left_out")
    )


def best_of(cells: DataFrame, by: list[str], value: str, choice: str) -> DataFrame:
    """The choice with the highest value; NULL and NaN count as -1, ties go to the smallest choice."""
    v = F.coalesce(finite(value), F.lit(-1.0))
    return cells.groupBy(*by).agg(F.max_by(F.struct(choice, v.alias(value)), F.struct(v, -F.col(choice))).alias("_b")).select(*by, f"_b.{choice}", f"_b.{value}")


def worst_split(reports: DataFrame, names: list[str], value: str) -> DataFrame:
    """The lowest value among the splits whose kind is one of ``names``."""
    ok = reports.where(F.split("split_name", "::")[0].isin(names) & F.col(value).isNotNull() & ~F.isnan(value))
    return ok.agg(F.min_by(F.struct("split_name", value), F.struct(value, "split_name")).alias("_b")).select("_b.*")


def member_sets(detections: DataFrame, k: int) -> DataFrame:
    """Of (model, id): how many ids every one of ``k`` models has, any has, and an odd number has."""
    n = detections.distinct().groupBy("id").agg(F.count("*").alias("m"))
    return n.agg(F.count_if(F.col("m") == k).alias("in_all"), F.count("*").alias("in_any"), F.count_if(F.col("m") % 2 == 1).alias("in_odd"))


# -- gates: what must hold, as tables of what doesn't ------------------------------------------------------------------


def id_gaps(rows: DataFrame, key: str, chunk: int = 1 << 20) -> DataFrame:
    """(key, before) of every id that doesn't follow the one before it by 1: repeats and gaps.

    Neighbours are found within chunks of ids; every chunk also gets the last id before it, so no window sees all ids.
    """
    own = rows.select(F.col(key).alias("key"), F.floor(F.col(key) / chunk).alias("chunk"))
    ends = own.groupBy("chunk").agg(F.max("key").alias("key"))
    # One row per chunk.
    ends = ends.select("key", F.lead("chunk").over(Window.orderBy("chunk")).alias("chunk")).where("chunk is not null")
    order = Window.partitionBy("chunk").orderBy("key", "real")
    all_ = own.withColumn("real", F.lit(True)).unionByName(ends.withColumn("real", F.lit(False)))
    all_ = all_.withColumn("before", F.lag("key").over(order)).where("real")
    return all_.where((F.col("before") + 1 != F.col("key"))).select("key", "before")


def merge_gate(shards: DataFrame, key: str, values: list[str], total: int) -> DataFrame:
    """(rule, n) of everything that speaks against a merge of shards (shard, key, values...).

    Ids 0 to ``total - 1`` each once, every shard's ids without a gap in them, and values that are numbers.
    """
    per_id = shards.groupBy(key).agg(F.count("*").alias("n"))
    ids = per_id.agg(F.count_if(F.col("n") > 1).alias("repeated id"), (F.lit(total) - F.count_if(F.col(key).between(0, total - 1))).alias("missing id"))
    runs = shards.groupBy("shard").agg((F.max(key) - F.min(key) + 1 - F.countDistinct(key)).alias("holes"))
    runs = runs.agg(F.count_if(F.col("holes") != 0).alias("shard with holes"))
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in values))
    numbers = shards.agg(F.count_if(bad).alias("value that is no number"))
    out = ids.crossJoin(runs).crossJoin(numbers)  # one row each
    return out.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in out.columns])).alias("r")).select("r.*")


def unequal(a: DataFrame, b: DataFrame, key: str, values: list[str], rtol: float = 0.0, atol: float = 0.0) -> DataFrame:
    """Keys that only one table has, or whose values differ by more than the tolerance."""
    x = a.select(key, *(F.col(c).alias(f"{c}_a") for c in values), F.lit(1).alias("_a"))
    y = b.select(key, *(F.col(c).alias(f"{c}_b") for c in values), F.lit(1).alias("_b"))
    both = x.join(y, key, "full")
    far = reduce(lambda p, q: p | q, (~F.coalesce(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= atol + rtol * F.abs(F.col(f"{c}_b")), F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))) for c in values))
    why = F.when(F.col("_a").isNull(), "only in b").when(F.col("_b").isNull(), "only in a").when(far, "differs")
    return both.withColumn("why", why).where("why is not null").select(key, "why")


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with the first few rows if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {rows}")


def steering_verdict(cells: DataFrame) -> DataFrame:
    """(alpha, arm, p, degraded) -> the change from the smallest strength to the largest one that isn't degraded.

    Arm 0 is the direction under test, arms 1 and 2 are controls.
    """
    ends = cells.groupBy("arm").agg((F.max_by(F.when(~F.col("degraded"), F.col("p")), F.when(~F.col("degraded"), F.col("alpha"))) - F.min_by("p", "alpha")).alias("d"))
    one = ends.agg(*[F.max(F.when(F.col("arm") == i, F.col("d"))).alias(n) for i, n in enumerate(("memory", "negative", "random"))])
    m, n, r = (F.col(c) for c in ("memory", "negative", "random"))
    verdict = F.when(m <= 0, "no effect").when((m > n) & (m > r), "specific").otherwise("unspecific")
    return one.select("memory", (m - n).alias("over_negative"), (m - r).alias("over_random"), verdict.alias("verdict"))


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The ends of Wilson's interval for a share."""
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def pooled_shares(cells: DataFrame, by: list[str], share: str, n: str) -> DataFrame:
    """Shares turned back into whole counts, summed, with the interval of the pooled share."""
    t = cells.groupBy(*by).agg((F.sum(F.round(F.col(share) * F.col(n))) / F.sum(n)).alias("pooled"), F.sum(n).cast("double").alias("_n"))
    lo, hi = wilson(F.col("pooled"), F.col("_n"))
    return t.select(*by, "pooled", lo.alias("lo"), hi.alias("hi"))
