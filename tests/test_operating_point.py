"""Resampled operating points against brute force, draw by draw."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

ROWS = "grp long, score double, y int, other double, s1 boolean, s2 boolean"


def rates(rows, weights, target):
    """(interpolated, discrete, discrete by slice) from every row, one point a score."""
    pos = sum(w for (_, _, y, *_), w in zip(rows, weights, strict=True) if y == 1)
    neg = sum(w for (_, _, y, *_), w in zip(rows, weights, strict=True) if y == 0)
    if not pos or not neg:
        return None, None, [None, None]
    points = {0.0: 0.0}
    for t in sorted({r[1] for r in rows}, reverse=True):
        tp = sum(w for r, w in zip(rows, weights, strict=True) if r[1] >= t and r[2] == 1)
        fp = sum(w for r, w in zip(rows, weights, strict=True) if r[1] >= t and r[2] == 0)
        points[fp] = max(points.get(fp, 0.0), tp)
    xs = sorted(points)
    tpr = np.interp(target * neg, xs, [points[x] for x in xs]) / pos
    allowed = int(np.floor(target * neg + 1e-9))
    negatives = sorted((r[1] for r, w in zip(rows, weights, strict=True) if r[2] == 0 for _ in range(int(w))), reverse=True)
    threshold = negatives[allowed] if allowed < len(negatives) else -np.inf
    above = lambda rs: sum(w for r, w in rs if r[1] > threshold)
    ps = [(r, w) for r, w in zip(rows, weights, strict=True) if r[2] == 1]
    by = []
    for k in (4, 5):
        own = [(r, w) for r, w in ps if r[k]]
        total = sum(w for _, w in own)
        by.append(above(own) / total if total else None)
    return tpr, above(ps) / pos, by


@pytest.mark.parametrize("target", [0.0, 0.05, 0.3, 1.0])
@pytest.mark.parametrize("ranges", [1, 4, 64])
def test_rates_equal_brute_force(spark, monkeypatch, target, ranges):
    from lumenspan.operators import operating_point
    from lumenspan.operators.resampling import draw_weights

    monkeypatch.setattr(operating_point, "RANGES", ranges)
    monkeypatch.setattr(operating_point, "CHUNK", 7)
    rng = random.Random(ranges)
    rows = [(g := rng.randrange(14), round(rng.gauss(y := int(rng.random() < 0.3), 1) * 4) / 4, y, rng.random(), g % 2 == 0, g == 3) for _ in range(160)]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {r["draw"]: r for r in operating_point.resampled_tpr(df, ["grp"], "score", "y", target, draws=8, seed=5, slices=["s1", "s2"]).collect()}
    units = {r["grp"]: r["h"] for r in df.select("grp", F.xxhash64("grp").alias("h")).distinct().collect()}
    w = dict(zip(units, draw_weights(np.array(list(units.values())).view(np.uint64), 8, 5), strict=True))
    for draw in range(8):
        tpr, discrete, by = rates(rows, [w[r[0]][draw] for r in rows], target)
        assert got[draw]["tpr"] == pytest.approx(tpr) and got[draw]["tpr_discrete"] == pytest.approx(discrete)
        assert [got[draw]["tpr_s1"], got[draw]["tpr_s2"]] == [pytest.approx(v) if v is not None else None for v in by]


def test_rates_of_odd_tables(spark):
    from lumenspan.operators.operating_point import paired_tpr, resampled_tpr

    empty = spark.createDataFrame([], ROWS)
    assert resampled_tpr(empty, ["grp"], "score", "y", 0.1, draws=3).count() == 0
    one = spark.createDataFrame([(1, 0.5, 1, 0.1, True, None), (2, None, 0, 0.2, True, None), (3, float("nan"), 0, 0.2, True, None)], ROWS)
    assert {r["tpr"] for r in resampled_tpr(one, ["grp"], "score", "y", 0.1, draws=3, slices=["s2"]).collect()} == {None}
    rows = [(i, float(i % 9), int(i % 3 == 0), float(i % 7), True, True) for i in range(90)]
    got = paired_tpr(spark.createDataFrame(rows, ROWS), ["grp"], "score", "other", "y", 0.1, draws=20).collect()
    assert all(r["delta"] == pytest.approx(r["one"] - r["two"]) for r in got) and len(got) == 20
