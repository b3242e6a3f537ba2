"""Resampled AUCs: many draws in one pass over rows in order of their score, and nulls from permuted labels.

A draw gives every unit (a row, an example, a group) a Poisson weight that follows from the unit, the draw and the
seed.  Rows are first summed to (unit, score, label).  They are then dealt by ranges of the score; a task goes through
its range from the highest score down with an array of one number per draw, so a draw costs one addition per row and no
row is copied.  What the ranges give is put together by their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.scalars import POISSON_1
from lumenspan.store import staged

CHUNK = 1024
#: Rows times draws in a range.
RANGE = 20_000_000
PARTS = "top double, draw int, pos double, neg double, wins double"


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LEADING = 12
_BOUNDS = np.array(POISSON_1)
_LOW = np.searchsorted(_BOUNDS, np.arange(1 << LEADING) / (1 << LEADING), side="right").astype(np.float64)
_SPLIT = np.searchsorted(_BOUNDS, (np.arange(1 << LEADING) + 1) / (1 << LEADING), side="right") != _LOW


def draw_weights(units: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(units, draws) Poisson(1) weights."""
    salt = mixed(np.arange(draws, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
    u = mixed(units[:, None] ^ salt[None, :])
    # Nearly all weights follow from the leading bits; where a bound lies between, the whole number is looked up.
    top = (u >> np.uint64(64 - LEADING)).astype(np.intp)
    weights = _LOW[top]
    split = np.nonzero(_SPLIT[top])
    weights[split] = np.searchsorted(_BOUNDS, (u[split] >> np.uint64(11)) / float(1 << 53), side="right")
    return weights


def _curve(rows: DataFrame, draws: int, positives: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(draw, auc) of rows with a ``score``; ``positives`` gives a batch's positive and negative weight per row and draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        pos, neg, wins = (np.zeros(draws) for _ in range(3))
        held = None  # the score at hand, and its sums so far
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                score = batch.column("score").to_numpy()
                p, n = positives(batch)
                starts = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
                sums = list(zip(score[starts], np.add.reduceat(p, starts), np.add.reduceat(n, starts), strict=True))
                top = score[0] if top is None else top
                for s, ps, ns in sums:
                    if held is not None and held[0] == s:
                        held = (s, held[1] + ps, held[2] + ns)
                        continue
                    if held is not None:
                        wins += held[2] * (pos + held[1] / 2)
                        pos += held[1]
                        neg += held[2]
                    held = (s, ps, ns)
        if held is None:
            return
        wins += held[2] * (pos + held[1] / 2)
        arrays = [np.full(draws, top), np.arange(draws, dtype=np.int32), pos + held[1], neg + held[2], wins]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["top", "draw", "pos", "neg", "wins"])

    # A range's work is its rows times the draws, whatever few bytes the rows are; with a number ranges are not put together.
    rows = staged(rows, "resampled")
    ranges = max(1, -(-rows.count() * draws // RANGE))
    ordered = rows.repartitionByRange(ranges, F.desc("score")).sortWithinPartitions(F.desc("score"))
    # A row per range and draw.
    parts = ordered.mapInArrow(run, PARTS)
    above = Window.partitionBy("draw").orderBy(F.desc("top")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("wins", F.col("wins") + F.col("neg") * F.coalesce(F.sum("pos").over(above), F.lit(0.0)))
    total = F.sum("pos") * F.sum("neg")
    return parts.groupBy("draw").agg((F.sum("wins") / F.nullif(total, F.lit(0.0))).alias("auc"))


def resampled_auc(df: DataFrame, unit: list[str], score: str, label: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(draw, auc): NULL for a draw without both classes.  With a pool's name in ``unit`` pools are drawn separately."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()
    rows = df.where(ok).groupBy(F.xxhash64(*unit).alias("unit"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y"))
    rows = rows.agg(F.count("*").cast("double").alias("n"))

    def weights(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        units, back = np.unique(batch.column("unit").to_numpy().view(np.uint64), return_inverse=True)
        w = draw_weights(units, draws, seed)[back] * batch.column("n").to_numpy()[:, None]
        y = batch.column("y").to_numpy()[:, None]
        return w * y, w * (1 - y)

    return _curve(rows, draws, weights)


def paired_auc(df: DataFrame, unit: list[str], one: str, two: str, label: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(draw, one, two, delta): both scores on the same resamples."""
    a = resampled_auc(df, unit, one, label, draws, seed).withColumnRenamed("auc", "one")
    b = resampled_auc(df, unit, two, label, draws, seed).withColumnRenamed("auc", "two")
    return a.join(b, "draw").withColumn("delta", F.col("one") - F.col("two"))


def interval(draws: DataFrame, value: str = "auc", alpha: float = 0.05) -> DataFrame:
    """Mean, percentile interval, the share of draws above 0, and whether the interval leaves 0 out."""
    p = F.percentile(value, [alpha / 2, 1 - alpha / 2])
    above = F.avg((F.col(value) > 0).cast("double")).alias("above_0")
    out = draws.agg(F.avg(value).alias("mean"), p.alias("ci"), above, F.count(value).alias("n_draws"))
    lo, hi = F.col("ci")[0], F.col("ci")[1]
    return out.select("mean", lo.alias("lo"), hi.alias("hi"), "above_0", ((lo > 0) | (hi < 0)).alias("excludes_0"), "n_draws")


def row_numbers(df: DataFrame, out: str) -> DataFrame:
    """Numbers rows 0, 1, 2, ... in no given order, from counts per task; the rows are written first."""
    rows = staged(df.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    parts = rows.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row per task that wrote.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.broadcast(parts.select("_part", (before - F.col("_first")).alias("_shift")))
    return rows.join(parts, F.shiftright("_at", 33) == F.col("_part")).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def permuted(index: np.ndarray, size: int, draw_keys: np.ndarray) -> np.ndarray:
    """(indices, draws): a pseudo-random permutation of 0..size-1 for each draw, applied to some indices.

    Four Feistel rounds permute the next power of four; results outside the range go through again.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.broadcast_to(index.astype(np.uint64)[:, None], (len(index), len(draw_keys))).copy()
    keys = np.broadcast_to(draw_keys[None, :], x.shape)
    todo = np.ones(x.shape, dtype=bool)
    while todo.any():
        v, k = x[todo], keys[todo]
        left, right = v >> half, v & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right ^ k ^ (np.uint64(r) << np.uint64(60))) & mask)
        x[todo] = (left << half) | right
        todo = x >= np.uint64(size)
    return x.astype(np.int64)


def permutation_null(ex: DataFrame, score: str, label: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(draw, auc) under labels dealt at random among the rows, each draw with as many positives as there are."""
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()
    rows = row_numbers(ex.where(ok).select(F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y")), "i")
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    size, positives = total["n"], total["p"] or 0
    keys = mixed(np.arange(draws, dtype=np.uint64) + np.uint64(seed) * np.uint64(7_368_787))

    def labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = (permuted(batch.column("i").to_numpy(), size, keys) < positives).astype(np.float64)
        return y, 1 - y

    return _curve(rows, draws, labels)


def p_value(null: DataFrame, value: str, observed: float) -> DataFrame:
    """(1 + draws that reach the observed value) / (1 + draws)."""
    return null.agg(((1 + F.count_if(F.col(value) >= observed)) / (1 + F.count("*"))).alias("p"), F.count("*").alias("n_draws"))


def random_directions(spark, size: int, draws: int, seed: int) -> DataFrame:
    """(draw, w): gaussian vectors that follow from the seed."""
    w = np.random.default_rng(seed).standard_normal((draws, size))
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(w)], "draw int, w array<double>")
