"""Matrices of trained against tested classes with resampled units, and block means drawn jointly.

A draw gives each unit one weight, and that weight counts in every cell the unit appears in: all probes see the same
resample of a class's positives and of the shared negatives.  Rows are dealt by probe and range of its score; a task goes
down its range with one number per class and draw, and the ranges are put together by their order.  What the driver gets
is probes times ranges times classes arrays of one number per draw, all of them parameters, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.resampling import draw_weights

CHUNK = 1024
RANGES = 16
PARTS = "train string, range int, cls string, pos array<double>, neg array<double>, wins array<double>"


def resampled_cells(df: DataFrame, unit: list[str], draws: int, seed: int) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """(probe, class) -> its AUC and the weight of the class's positives, a number for each draw (NaN without both sides).

    ``df`` is (train, cls, score and the unit's columns), ``cls`` NULL in negatives, which all classes share.
    """
    ok = F.col("score").isNotNull() & ~F.isnan("score")
    rows = df.where(ok).groupBy(F.col("train").cast("string").alias("train"), F.col("cls").cast("string").alias("cls"), F.col("score").cast("double").alias("score"), F.xxhash64(*unit).alias("unit"))
    rows = rows.agg(F.count("*").cast("double").alias("n"))
    cuts = sorted(set(df.where(ok).agg(F.percentile_approx(F.col("score").cast("double"), [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    ordered = rows.withColumn("range", below.cast("int")).repartition("train", "range").sortWithinPartitions("train", "range", F.desc("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, neg = None, None, np.zeros(draws)
        total: dict[str, list[np.ndarray]] = {}  # by class: positives so far, of the score at hand, wins, negatives at the class's scores
        fresh = np.zeros(draws)

        def settle() -> None:
            for own in total.values():
                own[2] += fresh * (own[0] + own[1] / 2)
                own[0] += own[1]
                own[1] = np.zeros(draws)
            neg.__iadd__(fresh)
            fresh[:] = 0

        def out() -> pa.RecordBatch:
            settle()
            named = {**total, "": [np.zeros(draws)] * 3}
            arrays = [[own[0] for own in named.values()], [neg.copy()] * len(named), [own[2] for own in named.values()]]
            keys = [pa.array([here[0]] * len(named)), pa.array([here[1]] * len(named), pa.int32()), pa.array(named.keys(), pa.string())]
            return pa.RecordBatch.from_arrays([*keys, *(pa.array(a, pa.list_(pa.float64())) for a in arrays)], [f.split()[0] for f in PARTS.split(", ")])

        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                units, back = np.unique(batch.column("unit").to_numpy().view(np.uint64), return_inverse=True)
                weights = draw_weights(units, draws, seed)[back] * batch.column("n").to_numpy()[:, None]
                columns = [batch.column(c).to_pylist() for c in ("train", "range", "cls", "score")]
                for i, (train, part, cls, score) in enumerate(zip(*columns, strict=True)):
                    if (train, part) != here:
                        if here is not None:
                            yield out()
                        here, at, total = (train, part), None, {}
                        neg[:], fresh[:] = 0, 0
                    if score != at:
                        settle()
                        at = score
                    if cls is None:
                        fresh += weights[i]
                    else:
                        own = total.setdefault(cls, [np.zeros(draws) for _ in range(3)])
                        own[1] = own[1] + weights[i]
        if here is not None:
            yield out()

    parts: dict[tuple[str, int], dict] = {}
    for r in ordered.mapInArrow(run, PARTS).collect():
        parts.setdefault((r["train"], r["range"]), {})[r["cls"]] = tuple(np.array(r[c]) for c in ("pos", "neg", "wins"))
    classes = sorted({c for p in parts.values() for c in p if c})
    cells = {}
    for train in sorted({t for t, _ in parts}):
        pos, neg, wins = {c: np.zeros(draws) for c in classes}, np.zeros(draws), {c: np.zeros(draws) for c in classes}
        for _, own in sorted((k, v) for k, v in parts.items() if k[0] == train):
            here = own[""][1]
            for c in classes:
                p, _, w = own.get(c, (np.zeros(draws), None, np.zeros(draws)))
                wins[c] += w + here * pos[c]
                pos[c] += p
            neg += here
        for c in classes:
            with np.errstate(invalid="ignore", divide="ignore"):
                cells[train, c] = (np.where(pos[c] * neg > 0, wins[c] / (pos[c] * neg), np.nan), pos[c])
    return cells


def block_intervals(cells: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]], family: dict[str, str], alpha: float = 0.05) -> list[tuple]:
    """(train family, test family, mean, lo, hi, mean, lo, hi off the diagonal, draws): means weighted by the tested
    class's positives in each draw; undefined cells are left out, and so are draws without any."""
    out = []
    names = sorted(set(family.values()))
    for one in names:
        for two in names:
            row = [one, two]
            for off in (False, True):
                own = [(a, w) for (t, c), (a, w) in cells.items() if family.get(t) == one and family.get(c) == two and not (off and t == c)]
                if not own:
                    row += [None] * 3
                    continue
                a, w = np.array([a for a, _ in own]), np.array([w for _, w in own])
                w = np.where(np.isnan(a), 0, w)
                total = w.sum(axis=0)
                means = (np.nan_to_num(a) * w).sum(axis=0)[total > 0] / total[total > 0]
                row += [float(means.mean()), *map(float, np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)]))] if len(means) else [None] * 3
            out.append((*row, len(next(iter(cells.values()))[0]) if cells else 0))
    return out
