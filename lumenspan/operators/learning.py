"""Fitted probes: logistic regressions, Platt's calibration by Newton steps, sweeps, surface models and baselines.

Fits are sums over all rows in every step; what reaches the driver is a vector of coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.scalars import dot, sigmoid, uniform_hash
from lumenspan.functions.text import risky_calls, saturating
from lumenspan.operators.ranking import roc_auc
from lumenspan.store import staged


def fit_logistic(train: DataFrame, c: float = 1.0, max_iter: int = 100) -> tuple[list[float], float] | None:
    """Weights and intercept of an L2 logistic regression on (x, y); None where a class is missing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = train.agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n")).first()
    if not counts["p"] or not counts["n"]:
        return None
    # The usual C multiplies the sum of losses; here the penalty is added to their mean.
    ridge = 1 / (c * (counts["p"] + counts["n"]))
    model = LogisticRegression(maxIter=max_iter, regParam=ridge, elasticNetParam=0.0, standardization=False, featuresCol="v", labelCol="y")
    fitted = model.fit(train.select(array_to_vector("x").alias("v"), F.col("y").cast("double").alias("y")))
    return [float(w) for w in fitted.coefficients], float(fitted.intercept)


def linear(x: Column, model: tuple[list[float], float]) -> Column:
    return dot(x, F.array(*map(F.lit, model[0]))) + model[1]


def scored_splits(acts: DataFrame, sides: DataFrame, c: float = 1.0) -> DataFrame:
    """(split_name, eid, y, prob) of the test side of every split, by a fit on its train side.

    ``acts`` is (eid, x, y), ``sides`` (split_name, eid, side).  Splits whose train side lacks a class give no row.
    """
    sides = staged(sides.select("split_name", "eid", "side"), "sides")
    out = None
    for name in sorted(r["split_name"] for r in sides.select("split_name").distinct().collect()):
        rows = acts.join(sides.where(F.col("split_name") == name), "eid")
        model = fit_logistic(rows.where("side = 'train'"), c)
        if model is None:
            continue
        one = rows.where("side = 'test'").select("split_name", "eid", "y", sigmoid(linear(F.col("x"), model)).alias("prob"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = acts.join(sides, "eid").select("split_name", "eid", "y", F.lit(None).cast("double").alias("prob")).limit(0)
    return out


def fit_platt(rows: DataFrame, logit: str, label: str, steps: int = 50) -> tuple[float, float]:
    """(a, t) of sigmoid((x - a) / t) by Newton steps with smoothed targets, from counts per distinct logit."""
    counts = rows.groupBy(F.col(logit).cast("double").alias("x")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    counts = staged(counts, "logit-counts")
    total = counts.agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("n")).first()
    pos, neg = total["p"] or 0, total["n"] or 0
    # Targets are drawn a little towards each other, so that separable scores have a solution.
    hi, lo = (pos + 1) / (pos + 2), 1 / (neg + 2)
    slope, offset = 0.0, math.log((pos + 1) / (neg + 1))
    x, y, n = F.col("x"), F.col("p") * hi + (F.col("n") - F.col("p")) * lo, F.col("n")

    def loss(s: float, o: float) -> Column:
        z = x * s + o
        return F.sum(n * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - y * z)

    value = counts.agg(loss(slope, offset)).first()[0] or 0.0
    for _ in range(steps):
        p = sigmoid(x * slope + offset)
        w = n * p * (1 - p)
        g = counts.agg(F.sum((n * p - y) * x).alias("gx"), F.sum(n * p - y).alias("g1"), F.sum(w * x * x).alias("xx"), F.sum(w * x).alias("x1"), F.sum(w).alias("ww")).first()
        if g["g1"] is None or max(abs(g["gx"]), abs(g["g1"])) < 1e-7 * max(pos + neg, 1):
            break
        step = np.linalg.solve([[g["xx"] + 1e-12, g["x1"]], [g["x1"], g["ww"] + 1e-12]], [g["gx"], g["g1"]])
        # All lengths that a halving would try are valued in one pass.
        halves = [2.0**-i for i in range(12)]
        values = counts.agg(*[loss(slope - h * step[0], offset - h * step[1]) for h in halves]).first()
        best = next((i for i, v in enumerate(values) if v < value), None)
        if best is None:
            break
        slope, offset, value = slope - halves[best] * step[0], offset - halves[best] * step[1], values[best]
    t = 1 / slope if slope else math.inf
    return -offset * t if slope else 0.0, t


#: Scores that need no fit, from an example's columns; each is a column builder.
BASELINES = {
    "random": lambda: uniform_hash(F.lit(7), "eid"),
    "length": lambda: F.length("code").cast("double"),
    "regex": lambda: saturating(risky_calls(F.col("code"))),
}


def baseline_aucs(ex: DataFrame, sides: DataFrame, baselines: dict = BASELINES) -> DataFrame:
    """(split_name, baseline, auc, n_pos, n_neg) on the test side of every split."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), make().alias("score")) for k, make in baselines.items()]))
    scores = ex.select("eid", "row_label", named.alias("b")).select("eid", F.col("row_label").alias("y"), "b.*")
    rows = sides.where("side = 'test'").select("split_name", "eid").join(scores, "eid")
    return roc_auc(rows, ["split_name", "baseline"])


def span_max_step(tok: DataFrame, w: np.ndarray, b: float, omega: float, pos_weight: float) -> tuple[np.ndarray, float, float]:
    """Gradient and loss of a linear token probe, summed in one pass over (eid, x, y).

    The loss is the weighted token loss, (1 - omega) of it, and omega of each example's loss at its highest token.
    """

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch gives one row for each example it has tokens of, so that the tokens themselves are not put in order.
        for batch in batches:
            if not batch.num_rows:
                continue
            eid, y = batch.column("eid").to_numpy(), batch.column("y").to_numpy()
            s = np.asarray(batch.column("x").flatten()).reshape(len(eid), -1) @ w + b
            order = np.lexsort((-s, eid))
            starts = np.flatnonzero(np.concatenate([[True], np.diff(eid[order]) != 0]))
            first = order[starts]
            arrays = [pa.array(eid[first]), batch.column("x").take(pa.array(first)), pa.array(s[first]), pa.array(np.maximum.reduceat(y[order], starts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["eid", "x", "z", "y"])

    z = dot(F.col("x"), F.array(*map(F.lit, w.tolist()))) + float(b)
    t = tok.withColumn("z", z)
    weight = F.when(F.col("y") == 1, float(pos_weight)).otherwise(1.0)
    tops = tok.select(F.col("eid").cast("long").alias("eid"), "x", F.col("y").cast("int").alias("y")).mapInArrow(highest, "eid long, x array<double>, z double, y int")
    ex = tops.groupBy("eid").agg(F.max_by(F.struct("x", "z"), "z").alias("t"), F.max("y").alias("ey")).select("t.x", "t.z", F.col("ey").alias("y"), F.lit(1.0).alias("w"), F.lit("e").alias("k"))
    rows = t.select("x", "z", "y", weight.alias("w"), F.lit("t").alias("k")).unionByName(ex)
    rows = rows.withColumn("r", F.col("w") * (sigmoid(F.col("z")) - F.col("y")))
    loss = F.col("w") * (F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z"))))
    sums = [F.sum(F.get("x", F.lit(i)) * F.col("r")).alias(f"g{i}") for i in range(len(w))]
    got = {r["k"]: r for r in rows.groupBy("k").agg(F.sum("w").alias("n"), F.sum(loss).alias("l"), F.sum("r").alias("gb"), *sums).collect()}
    part = {"t": 1 - omega, "e": omega}
    grad = sum((part[k] / r["n"] * np.array([r[f"g{i}"] for i in range(len(w))]) for k, r in got.items()), np.zeros(len(w)))
    return grad, sum(part[k] / r["n"] * r["gb"] for k, r in got.items()), sum(part[k] / r["n"] * r["l"] for k, r in got.items())


def fit_span_max(tok: DataFrame, size: int, epochs: int = 20, rate: float = 0.5, pos_weight: float = 3.0, omega_end: float = 0.5) -> tuple[list[float], float, list[float]]:
    """A linear probe on tokens by full-batch steps; the share of the span-max part grows to ``omega_end``."""
    tok = staged(tok.select("eid", "x", "y"), "probe-tokens")
    w, b, losses = np.zeros(size), 0.0, []
    for e in range(epochs):
        grad, gb, loss = span_max_step(tok, w, b, omega_end * e / max(epochs - 1, 1), pos_weight)
        w, b = w - rate * grad, b - rate * gb
        losses.append(loss)
    return w.tolist(), b, losses
