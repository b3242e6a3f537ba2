"""Resampled operating points: the share of positives found at a false-positive rate, for many draws in two sweeps.

Rows are summed to (unit, score, label) and dealt by ranges of the score whose bounds are written down.  The first sweep
gives, for each range and draw, the weights of positives and negatives and what positives come before the range's first
negative.  From these the driver tells in which range each draw's allowance of false positives ends: ranges times draws
numbers, both parameters.  The second sweep looks only there.  No row is copied for a draw.

The curve's points are the distinct scores, of points with equal false positives the highest counts, and between points
the rate is interpolated.  The discrete rate is that of the last point within ``floor(target * negatives)``, which is
also the rate strictly above the score at which one negative more would pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.operators.resampling import draw_weights
from lumenspan.store import staged

CHUNK = 1024
RANGES = 64
SUMS = "range int, pos array<double>, neg array<double>, lead array<double>"
FOUND = "range int, draw int, kind int, before_pos double, before_neg double, at_pos double, at_neg double, closed boolean, slices array<double>"


def _groups(batches: Iterator[pa.RecordBatch], draws: int, seed: int, slices: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(range, positives, negatives, positives of each slice) of one score after the other, from the highest, a number a draw."""
    held = None
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            part, score = batch.column("range").to_numpy(), batch.column("score").to_numpy()
            units, back = np.unique(batch.column("unit").to_numpy().view(np.uint64), return_inverse=True)
            w = draw_weights(units, draws, seed)[back] * batch.column("n").to_numpy()[:, None]
            y = batch.column("y").to_numpy()[:, None]
            p, n = w * y, w * (1 - y)
            inside = [p * np.asarray(batch.column(s).to_numpy(zero_copy_only=False), dtype=float)[:, None] for s in slices]
            starts = np.flatnonzero(np.concatenate([[True], (score[1:] != score[:-1]) | (part[1:] != part[:-1])]))
            ps, ns, ins = np.add.reduceat(p, starts), np.add.reduceat(n, starts), [np.add.reduceat(i, starts) for i in inside]
            for k, s in enumerate(starts):
                own = (ps[k], ns[k], np.array([i[k] for i in ins]).reshape(len(slices), draws))
                key = (int(part[s]), score[s])
                if held is not None and held[0] == key:
                    held = (key, *(a + b for a, b in zip(held[1:], own, strict=True)))
                    continue
                if held is not None:
                    yield held[0][0], *held[1:]
                held = (key, *own)
    if held is not None:
        yield held[0][0], *held[1:]


def resampled_tpr(df: DataFrame, unit: list[str], score: str, label: str, target: float, draws: int = 1000, seed: int = 7, slices: list[str] | None = None) -> DataFrame:
    """(draw, tpr, tpr_discrete and, for each boolean column of ``slices``, its positives' share above the same
    threshold); NULL for a draw without both classes, and for a slice without positives."""
    slices = slices or []
    ok = F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull()
    keys = [F.xxhash64(*unit).alias("unit"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("y")]
    keys += [F.coalesce(F.col(s), F.lit(False)).alias(s) for s in slices]
    rows = staged(df.where(ok).groupBy(*keys).agg(F.count("*").cast("double").alias("n")), "point-rows")
    cuts = rows.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    below = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    # Range 0 has the highest scores.
    ordered = rows.withColumn("range", below.cast("int")).repartition("range").sortWithinPartitions("range", F.desc("score"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for part, p, n, _ in _groups(batches, draws, seed, []):
            pos, neg, lead = total.setdefault(part, [np.zeros(draws) for _ in range(3)])
            neg += n
            pos += p
            lead += p * (neg == 0)
        for part, own in total.items():
            arrays = [pa.array([part], pa.int32()), *(pa.array([a], pa.list_(pa.float64())) for a in own)]
            yield pa.RecordBatch.from_arrays(arrays, ["range", "pos", "neg", "lead"])

    got = {r["range"]: r for r in ordered.mapInArrow(sums, SUMS).collect()}
    none = df.sparkSession.createDataFrame([], ", ".join(["draw int", "tpr double", "tpr_discrete double", *(f"tpr_{s} double" for s in slices)]))
    if not got:
        return none
    parts = sorted(got)
    pos, neg, lead = (np.array([got[p][c] for p in parts]) for c in ("pos", "neg", "lead"))
    tp0, fp0 = np.cumsum(pos, axis=0) - pos, np.cumsum(neg, axis=0) - neg
    positives, negatives = pos.sum(axis=0), neg.sum(axis=0)
    allowed = np.array([negatives * target, np.floor(negatives * target + 1e-9)])
    # The first range in which more than the allowance has passed.
    end = (fp0 + neg)[None] > allowed[:, None, :]
    crossing = np.where(end.any(axis=1), end.argmax(axis=1), -1)
    start = {part: (tp0[i], fp0[i], crossing == i) for i, part in enumerate(parts)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, slice_sums = None, None, np.zeros((len(slices), draws))

        def rows_of() -> pa.RecordBatch:
            _, _, before, at, closed, found, kept = state
            out = [(here, int(d), int(k), before[k, d, 0], before[k, d, 1], at[k, d, 0], at[k, d, 1], bool(closed[k, d]), kept[k, :, d].tolist()) for k, d in zip(*np.nonzero(found), strict=True)]
            types = (pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.bool_(), pa.list_(pa.float64()))
            names = [f.split()[0] for f in FOUND.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

        for part, p, n, inside in _groups(batches, draws, seed, slices):
            if part != here:
                if state is not None:
                    yield rows_of()
                here, slice_sums = part, np.zeros((len(slices), draws))
                tp, fp, _ = start[part]
                state = [tp.copy(), fp.copy(), np.zeros((2, draws, 2)), np.zeros((2, draws, 2)), np.zeros((2, draws), bool), np.zeros((2, draws), bool), np.zeros((2, len(slices), draws))]
            tp, fp, before, at, closed, found, kept = state
            # Points of a draw that has crossed: positives go on to count until its next negative.
            more = found & ~closed
            closed |= more & (n > 0)[None]
            at[..., 0] += np.where(more & (n == 0)[None], p[None], 0)
            now = start[part][2] & ~found & (fp + n > allowed)
            if now.any():
                before[now] = np.stack([np.broadcast_to(tp, now.shape)[now], np.broadcast_to(fp, now.shape)[now]], axis=1)
                at[now] = np.stack([np.broadcast_to(tp + p, now.shape)[now], np.broadcast_to(fp + n, now.shape)[now]], axis=1)
                for k in range(2):
                    kept[k][:, now[k]] = slice_sums[:, now[k]]
                found |= now
            tp += p
            fp += n
            slice_sums += inside
        if state is not None:
            yield rows_of()

    points = ordered.mapInArrow(look, FOUND).collect() if (crossing >= 0).any() else []
    out = {d: [None] * (2 + len(slices)) for d in range(draws)}
    whole = positives > 0
    both = whole & (negatives > 0)
    place = {part: i for i, part in enumerate(parts)}
    slice_pos = _slice_sums(ordered, draws, seed, slices)  # (slices, ranges, draws)
    slice_before = np.cumsum(slice_pos, axis=1) - slice_pos
    for d in np.flatnonzero(both & (crossing[0] < 0)):
        out[d][0] = 1.0
    for d in np.flatnonzero(both & (crossing[1] < 0)):
        out[d][1:] = [1.0, *(1.0 if slice_pos[s, :, d].sum() else None for s in range(len(slices)))]
    for r in points:
        d, i = r["draw"], place[r["range"]]
        if not both[d]:
            continue
        if r["kind"] == 0:
            high = r["at_pos"]
            later = i + 1
            while not r["closed"] and later < len(parts):
                high += lead[later, d]
                if neg[later, d] > 0:
                    break
                later += 1
            share = (allowed[0, d] - r["before_neg"]) / (r["at_neg"] - r["before_neg"])
            out[d][0] = float((r["before_pos"] + (high - r["before_pos"]) * share) / positives[d])
        else:
            out[d][1] = float(r["before_pos"] / positives[d])
            for s in range(len(slices)):
                total = slice_pos[s, :, d].sum()
                out[d][2 + s] = float((slice_before[s, i, d] + r["slices"][s]) / total) if total else None
    return df.sparkSession.createDataFrame([(int(d), *v) for d, v in out.items()], none.schema)


def _slice_sums(ordered: DataFrame, draws: int, seed: int, slices: list[str]) -> np.ndarray:
    """The positives' weights by slice, range and draw, ranges in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for part, p, _, inside in _groups(batches, draws, seed, slices):
            total[part] = total.get(part, 0) + inside
        for part, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.ravel()], pa.list_(pa.float64()))], ["range", "values"])

    if not slices:
        return np.zeros((0, 1, draws))
    got = {r["range"]: np.array(r["values"]).reshape(len(slices), draws) for r in ordered.mapInArrow(run, "range int, values array<double>").collect()}
    return np.stack([got[p] for p in sorted(got)], axis=1)


def paired_tpr(df: DataFrame, unit: list[str], one: str, two: str, label: str, target: float, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(draw, one, two, delta) of the interpolated rates, both scores on the same resamples."""
    a = resampled_tpr(df, unit, one, label, target, draws, seed).select("draw", F.col("tpr").alias("one"))
    b = resampled_tpr(df, unit, two, label, target, draws, seed).select("draw", F.col("tpr").alias("two"))
    return a.join(b, "draw").withColumn("delta", F.col("one") - F.col("two"))
