"""Operators against brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def auc(pairs):
    """Share of (positive, negative) pairs in order, ties as half; rows are (score, y, weight)."""
    p = [(s, w) for s, y, w in pairs if y == 1 and w]
    n = [(s, w) for s, y, w in pairs if y == 0 and w]
    total = sum(w for _, w in p) * sum(w for _, w in n)
    wins = sum(a * b * ((s > t) + 0.5 * (s == t)) for s, a in p for t, b in n)
    return wins / total if total else None


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    rows = [(i % 17, i, round(rng.random() * 20) / 4 + (i % 3 == 0), int(i % 3 == 0), f"c{i % 4}") for i in range(300)]
    return rows, spark.createDataFrame(rows, "grp long, eid long, score double, y int, cls string").repartition(5)


def test_resampled_auc_equals_weighted_auc(spark, scores):
    from lumenspan.operators.resampling import draw_weights, resampled_auc

    rows, df = scores
    got = {r["draw"]: r["auc"] for r in resampled_auc(df, ["grp"], "score", "y", draws=6, seed=3).collect()}
    units = {r["grp"]: r["h"] for r in df.select("grp", F.xxhash64("grp").alias("h")).distinct().collect()}
    w = draw_weights(np.array(list(units.values())).view(np.uint64), 6, 3)
    by = dict(zip(units, w, strict=True))
    for draw in range(6):
        assert got[draw] == pytest.approx(auc([(s, y, by[g][draw]) for g, _, s, y, _ in rows]))


def test_weights_are_poisson():
    from lumenspan.operators.resampling import draw_weights, mixed

    w = draw_weights(mixed(np.arange(2000, dtype=np.uint64)), 50, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_permutations_are_permutations():
    from lumenspan.operators.resampling import mixed, permuted

    for n in (1, 2, 7, 100, 1000):
        p = permuted(np.arange(n), n, mixed(np.arange(5, dtype=np.uint64)))
        assert all(sorted(p[:, i]) == list(range(n)) for i in range(5))


def test_permutation_null_is_centred(spark, scores):
    from lumenspan.operators.resampling import p_value, permutation_null

    rows, df = scores
    null = permutation_null(df, "score", "y", draws=200)
    values = [r["auc"] for r in null.collect()]
    assert len(values) == 200 and abs(np.mean(values) - 0.5) < 0.01
    seen = auc([(s, y, 1) for _, _, s, y, _ in rows])
    assert p_value(null, "auc", seen).first()["p"] == pytest.approx((1 + sum(v >= seen for v in values)) / 201)


def test_percentiles_and_ranks(spark, scores):
    from lumenspan.operators.splits import ranked
    from lumenspan.operators.statistics import average_ranks, percentiles

    rows, df = scores
    got = {r["y"]: r for r in percentiles(df, ["y"], "score", [0.1, 0.5, 0.9]).collect()}
    for y in (0, 1):
        wanted = np.percentile([s for _, _, s, z, _ in rows if z == y], [10, 50, 90])
        assert [got[y][c] for c in ("p10", "p50", "p90")] == pytest.approx(wanted)
    places = {r["eid"]: r["r"] for r in ranked(df, ["y"], F.col("score"), "eid", "r", buckets=8).collect()}
    for y in (0, 1):
        order = sorted((s, e) for _, e, s, z, _ in rows if z == y)
        assert [places[e] for _, e in order] == list(range(1, len(order) + 1))
    mean = {r["eid"]: r["k"] for r in average_ranks(df, "score", "k").collect()}
    for _, e, s, _, _ in rows[:20]:
        below, same = sum(t < s for _, _, t, _, _ in rows), sum(t == s for _, _, t, _, _ in rows)
        assert mean[e] == below + (same + 1) / 2


def test_class_auc_equals_auc_against_all_negatives(spark, scores):
    from lumenspan.operators.ranking import class_auc, level_bundle

    rows, df = scores
    got = {r["cls"]: r["auc"] for r in class_auc(df, "cls", []).collect()}
    for c in got:
        assert got[c] == pytest.approx(auc([(s, y, 1) for _, _, s, y, k in rows if y == 0 or k == c]))
    one = df.withColumn("prob", F.col("score") / 7)
    b = level_bundle(one, []).first()
    assert b["auc"] == pytest.approx(auc([(s, y, 1) for _, _, s, y, _ in rows]))
    assert b["brier"] == pytest.approx(np.mean([(s / 7 - y) ** 2 for _, _, s, y, _ in rows]))


def test_buckets_of_scores_do_not_change_the_curve(spark, scores):
    from lumenspan.operators.ranking import cumulative, score_counts

    counts = score_counts(scores[1], ["cls"], "score", "y")
    one, many = (sorted(map(tuple, cumulative(counts, ["cls"], n).collect())) for n in (10**6, 7))
    assert one == many


def random_ranges(rng, n, top):
    out = []
    for _ in range(n):
        s = rng.randrange(top)
        out.append((s, s + rng.choice([0, 1, 3, 10, 30])))
    return out


def test_ranges_against_all_pairs(spark):
    from lumenspan.operators.intervals import label_tokens, meets, nearest_distance, span_tokens
    from lumenspan.operators.labels import token_labels
    from lumenspan.operators.pooling import span_max

    rng = random.Random(9)
    tokens, spans, targets = [], [], []
    for e in range(6):
        at = 0
        for t in range(80):
            size = rng.choice([0, 1, 2, 5])
            tokens.append((e, t, at, at + size, rng.random()))
            at += size + rng.choice([0, 1])
        spans += [(e, "k", s, t) for s, t in random_ranges(rng, 12, at)]
        targets += [(e, s, t) for s, t in (random_ranges(rng, 4, at) if e else [])]
    tok = spark.createDataFrame(tokens, "eid long, tok int, cs long, ce long, prob double")
    sp = spark.createDataFrame(spans, "eid long, key string, s long, e long")
    tg = spark.createDataFrame(targets, "eid long, s long, e long")
    wanted = {}
    for e, k, s, t in set(spans):
        own = [i for x, i, a, b, _ in tokens if x == e and b > s and a < t]
        if own:
            wanted[e, k, s, t] = (min(own), max(own))
    got = {(r["eid"], r["key"], r["s"], r["e"]): (r["first_tok"], r["last_tok"]) for r in span_tokens(tok, sp).collect()}
    assert got == wanted
    y = {(r["eid"], r["tok"]): r["y"] for r in label_tokens(tok, sp.select("eid", "s", "e")).collect()}
    assert y == {(e, t): int(any(x == e and s < b and u > a for x, _, s, u in spans)) for e, t, a, b, _ in tokens}
    near = {(r["eid"], r["s"], r["e"]): r["distance"] for r in nearest_distance(sp.select("eid", "s", "e"), tg).collect()}
    for e, _, s, t in spans:
        gaps = [max(0, u - t, s - w) for x, u, w in targets if x == e]
        assert near[e, s, t] == (min(gaps) if gaps else None)
    hit = {r["eid"] for r in meets(sp.select("eid", "s", "e"), tg).collect()}
    assert hit == {e for e, _, s, t in spans for x, u, w in targets if x == e and s < w and u < t}
    ranges = [(e, a, b) for e in range(6) for a, b in [(0, 79), (3, 3), (10, 75), (62, 66), (5, 4)]]
    best = span_max(tok, spark.createDataFrame(ranges, "eid long, first_tok int, last_tok int"), block=16)
    got = {(r["eid"], r["first_tok"], r["last_tok"]): r["span_score"] for r in best.collect()}
    assert got == {(e, a, b): max(p for x, t, _, _, p in tokens if x == e and a <= t <= b) for e, a, b in ranges if a <= b}
    marked = spark.createDataFrame([(0, 2, 5, 1), (0, 4, 8, 0), (0, 8, 8, 1)], "eid long, first_tok int, last_tok int, label int")
    rows = token_labels(tok.where("eid = 0 and tok < 12"), marked).orderBy("tok").collect()
    assert [r["y"] for r in rows] == [0, 0, 1, 1, 1, 1, 0, 0, 1, 0, 0, 0]
    assert [r["in_span"] for r in rows] == [2 <= t <= 8 for t in range(12)]


def test_leads_hit_traces_across_line_buckets(spark):
    from lumenspan.operators.retrieval import hits

    rng = random.Random(1)
    leads = [("r", f"f{i % 2}", i, (a := rng.randrange(900)), a + rng.choice([0, 5, 400]), i) for i in range(60)]
    traces = [("r", f"f{i % 2}", i, (a := rng.randrange(900)), a + rng.choice([0, 20, 300]), "c") for i in range(60)]
    one = spark.createDataFrame([*leads, ("r", "f0", 99, 9, 3, 1)], "repo_id string, file string, lead_id int, start_line int, end_line int, rank int")
    two = spark.createDataFrame(traces, "repo_id string, file string, trace_id int, start_line int, end_line int, cwe string")
    got = sorted((r["lead_id"], r["trace_id"]) for r in hits(one, two, bucket=64).collect())
    assert got == sorted((a[2], b[2]) for a, b in itertools.product(leads, traces) if a[1] == b[1] and a[3] <= b[4] and a[4] >= b[3])


def test_diff_spans():
    from lumenspan.operators.diffs import changed

    assert changed("abcd", "abXd") == ([(2, 3)], "chars")
    assert changed("same", "same") == ([], "chars")
    long = "".join(f"line {i}\n" for i in range(1000))
    spans, how = changed(long, long.replace("line 500\n", "other\n"))
    assert how == "lines" and [long[s:e] for s, e in spans] == ["line 500\n"]
    assert changed("x\n" * 4001, "y\n" * 5000) == ([(0, 8002)], "whole")


def test_platt_lowers_the_loss_and_logistic_separates(spark):
    from lumenspan.operators.learning import fit_logistic, fit_platt, linear
    from lumenspan.operators.ranking import roc_auc

    rng = np.random.default_rng(0)
    z = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(z - 1) / 2))).astype(int)
    df = spark.createDataFrame([(float(a), int(b), [float(a), float(-a), 1.0]) for a, b in zip(z, y, strict=True)], "z double, y int, x array<double>")
    a, t = fit_platt(df, "z", "y")
    assert abs(a - 1) < 0.25 and abs(t - 2) < 0.3
    model = fit_logistic(df)
    assert roc_auc(df.withColumn("score", linear(F.col("x"), model)), []).first()["auc"] > 0.8
    assert fit_logistic(df.where("y = 1")) is None


def test_decoys_are_of_other_groups(spark):
    from lumenspan.operators.splits import decoys

    rows = [(i, f"g{i % 9}", "en" if i % 4 else "de", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "eid long, grp string, lang string, y int")
    got = decoys(df.where("y = 1"), df.where("y = 0"), 3, 7).collect()
    by = {r[0]: r for r in rows}
    assert got and all(by[r["eid"]][1] != by[r["decoy"]][1] and by[r["eid"]][2] == by[r["decoy"]][2] and by[r["decoy"]][3] == 0 for r in got)
    assert len({(r["eid"], r["decoy"]) for r in got}) == len(got)


def test_gates(spark):
    from lumenspan.operators.statistics import id_gaps, merge_gate, require_empty, unequal

    rows = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (1, 1, 2.0), (4, 1, None)], "id long, shard int, v double")
    assert {r["rule"]: r["n"] for r in merge_gate(rows, "id", ["v"], 5).collect()} == {"repeated id": 1, "missing id": 2, "shard with holes": 1, "value that is no number": 1}
    assert sorted(map(tuple, id_gaps(rows, "id", 2).collect())) == [(1, 1), (4, 1)]
    with pytest.raises(ValueError):
        require_empty(unequal(rows.where("id < 1"), rows.where("id > 3"), "id", ["v"]), "merge")


def test_numbered_lines(spark, tmp_path):
    from lumenspan.sources.files import numbered_jsonl

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.jsonl").write_text('\n{"x": 3}\n{"x": 4}')
    got = sorted(map(tuple, numbered_jsonl(spark, f"file://{tmp_path}", "x long").collect()))
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_text_columns(spark):
    from lumenspan.functions import text as T
    from lumenspan.operators.lines import lines, live_ranges

    df = spark.createDataFrame([(1, "import a\nx = 1\n# c\ny"), (2, ""), (3, "only\n")], "eid long, code string")
    assert sorted(map(tuple, live_ranges(df).collect())) == [(1, 9, 15), (1, 19, 20), (3, 0, 5)]
    assert [(r["s"], r["e"]) for r in lines(df.where("eid = 1")).orderBy("s").collect()] == [(0, 9), (9, 15), (15, 19), (19, 20)]
    one = df.select(*T.last_line(F.col("code")), T.slug(F.lit("-A b/C."), "x"), T.slug(F.lit("//"), "x"), T.fixed_or_na(F.lit(None).cast("double")), T.fixed_or_na(F.lit(0.12345))).collect()
    assert tuple(one[0])[:2] == (19, 20) and tuple(one[2])[:2] == (0, 4)
    assert tuple(one[0])[2:] == ("a-b-c", "x", "n/a", "0.123")
    assert not math.isnan(df.select(T.saturating(F.lit(0))).first()[0])


def test_class_spans(spark):
    from lumenspan.operators.labels import class_spans, pattern_spans

    code = "x = request.args['q']\ncursor.execute(x)\nescape(x)\n"
    df = spark.createDataFrame([(1, code, "CWE-89", 1), (2, code, "CWE-89", 0), (3, "no", "CWE-1", 1)], "eid long, code string, cwe string, row_label int")
    got = {(r["eid"], r["key"], code[r["s"] : r["e"]]) for r in class_spans(df).collect() if r["eid"] == 1}
    assert {g[1:] for g in got} == {
        ("sink", "cursor.execute"),
        ("source", "request.args["),
        ("sanitizer", "escape("),
        ("vulnerable_line", "escape(x)"),
        ("evidence", "cursor.execute"),
        ("evidence", "request.args["),
        ("evidence", "escape(x)"),
    }
    assert sorted(tuple(r) for r in pattern_spans(df.where("eid = 1"), "x").collect()) == [(1, i, i + 1) for i, c in enumerate(code) if c == "x"]


def test_excerpts_and_blamed_lines(spark):
    from lumenspan.operators.diffs import blamed_lines
    from lumenspan.operators.lines import excerpts

    code = "a = 1\nb = 2\nc = 3\nd = 4"
    df = spark.createDataFrame([(1, code)], "eid long, code string")
    spans = spark.createDataFrame([(1, 6, 11), (1, 18, 19)], "eid long, s long, e long")
    got = {r["s"]: r["excerpt"] for r in excerpts(df, spans, around=1).collect()}
    assert got[6] == "    1 | a = 1\n    2 | «b = 2»\n    3 | c = 3"
    assert got[18] == "    3 | c = 3\n    4 | «d» = 4"
    pairs = [(1, code, code.replace("b = 2", "b = 9")), (2, "one\ntwo\n", "one\nnew\ntwo\n"), (3, "", "x")]
    out = blamed_lines(spark.createDataFrame(pairs, "eid long, before string, after string")).collect()
    assert {(r["eid"], r["s"], r["e"], r["how"]) for r in out} == {(1, 6, 12, "deleted"), (2, 4, 8, "inserted"), (3, 0, 0, "whole")}
