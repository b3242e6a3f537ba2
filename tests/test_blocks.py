"""Resampled matrices, and decoys without replacement, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_cells_and_blocks_equal_brute_force(spark, monkeypatch):
    from lumenspan.operators import blocks
    from lumenspan.operators.resampling import draw_weights

    monkeypatch.setattr(blocks, "CHUNK", 11)
    rng = random.Random(7)
    examples = [(i, f"g{i % 23}", rng.choice(["a", "b", "c", None, None])) for i in range(90)]
    rows = [(t, cls, round(rng.gauss(0.8 * (cls == t) + 0.3 * (cls is not None), 1), 1), grp) for _, grp, cls in examples for t in "abc"]
    df = spark.createDataFrame(rows, "train string, cls string, score double, grp string").repartition(4)
    cells = blocks.resampled_cells(df, ["cls", "grp"], 12, 5)
    hashes = {(r["cls"], r["grp"]): r["h"] for r in df.select("cls", "grp", F.xxhash64("cls", "grp").alias("h")).distinct().collect()}
    w = dict(zip(hashes, draw_weights(np.array(list(hashes.values())).view(np.uint64), 12, 5), strict=True))
    for (t, c), (auc, weight) in cells.items():
        for d in range(12):
            p = [(s, w[cls, g][d]) for tr, cls, s, g in rows if tr == t and cls == c]
            n = [(s, w[cls, g][d]) for tr, cls, s, g in rows if tr == t and cls is None]
            total = sum(x for _, x in p) * sum(x for _, x in n)
            assert weight[d] == sum(x for _, x in p)
            assert (auc[d] == pytest.approx(sum(a * b * ((s > u) + 0.5 * (s == u)) for s, a in p for u, b in n) / total)) if total else np.isnan(auc[d])
    assert set(cells) == {(t, c) for t in "abc" for c in "abc"}
    got = {(r[0], r[1]): r for r in blocks.block_intervals(cells, {"a": "x", "b": "x", "c": "y"})}
    for one, two in (("x", "x"), ("x", "y"), ("y", "y")):
        for off, at in ((False, 2), (True, 5)):
            own = [k for k in cells if ("x" if k[0] in "ab" else "y") == one and ("x" if k[1] in "ab" else "y") == two and not (off and k[0] == k[1])]
            means = []
            for d in range(12):
                pairs = [(cells[k][0][d], cells[k][1][d]) for k in own if not np.isnan(cells[k][0][d])]
                if sum(b for _, b in pairs):
                    means.append(sum(a * b for a, b in pairs) / sum(b for _, b in pairs))
            assert got[one, two][at : at + 3] == ((None,) * 3 if not own else pytest.approx((np.mean(means), *np.percentile(means, [2.5, 97.5]))))
    assert blocks.resampled_cells(df.limit(0), ["grp"], 3, 1) == {}


def test_decoys_are_whole_and_different(spark):
    from lumenspan.operators.splits import sampled_decoys

    rng = random.Random(1)
    rows = [(i, rng.choice(["py", "c", "go"]) if i % 50 else "rare", f"g{rng.randrange(9)}", int(i % 4 == 0)) for i in range(400)]
    rows = [(e, lang, f"{lang}:{g}", y) for e, lang, g, y in rows]
    df = spark.createDataFrame(rows, "eid long, lang string, grp string, row_label int")
    by = {r[0]: r for r in rows}
    got = {}
    for r in sampled_decoys(df.where("row_label = 1"), df.where("row_label = 0"), 7, 3).collect():
        got.setdefault(r["eid"], []).append(r["decoy"])
    for eid, lang, grp, y in rows:
        if y:
            own = got[eid]
            assert len(own) == len(set(own)) == 7 and all(by[d][2] != grp and by[d][3] == 0 for d in own)
            pool = [r for r in rows if r[3] == 0 and r[1] == lang and r[2] != grp]
            assert all(by[d][1] == lang for d in own) == (len(pool) >= 7)
    few = sampled_decoys(df.where("eid = 0"), df.where("row_label = 0").limit(3), 7, 3)
    assert few.count() == few.select("decoy").distinct().count() == 3
    assert sampled_decoys(df.where("row_label = 1"), df.limit(0), 7, 3).count() == 0
