import pytest
from pyspark.sql import functions as F

from lumenspan.operators import intervals as I
from lumenspan.operators import ranking as R
from lumenspan.operators import retrieval
from lumenspan.sources.files import row_violations


def test_auc_ties_and_single_class(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.9, 1), ("b", 0.1, 1)], "g string, score double, y int")
    got = {r["g"]: r["auc"] for r in R.roc_auc(df, ["g"]).collect()}
    assert got["a"] == pytest.approx(0.75) and got["b"] is None


def test_auc_against_pairs(spark):
    rows = [(i, (i * 37 % 23) / 7.0, int(i % 3 == 0)) for i in range(300)]
    got = R.roc_auc(spark.createDataFrame(rows, "i int, score double, y int"), []).first()["auc"]
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert got == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


def test_known_answer_tpr(spark):
    rows = list(zip([0.9, 0.8, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1], [1, 1, 1, 0, 0, 0, 0, 1], strict=True))
    df = spark.createDataFrame(rows, "score double, y int")
    got = R.tpr_at_fpr(R.cumulative(R.score_counts(df, [], "score", "y"), []), [], 0.01).first()
    assert got["tpr_discrete"] == pytest.approx(0.75)


def test_merge_clips_and_touches(spark):
    s = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 5, 6), (1, 8, 9)], "eid long, s long, e long")
    assert sorted((r["s"], r["e"]) for r in I.merge_spans(s, ["eid"]).collect()) == [(1, 6), (8, 9)]


def test_complement_and_lines(spark):
    m = spark.createDataFrame([(1, 2, 4)], "eid long, s long, e long")
    n = spark.createDataFrame([(1, 6), (2, 3)], "eid long, n long")
    assert sorted(tuple(r) for r in I.complement(m, n).collect()) == [(1, 0, 2), (1, 4, 6), (2, 0, 3)]
    t = spark.createDataFrame([("a\nbb\nccc\n", o) for o in (0, 2, 5)], "code string, off int")
    assert [r[0] for r in t.select(I.line_of(F.col("code"), F.col("off"))).collect()] == [1, 2, 3]


def test_retrieval_fractions(spark):
    leads = spark.createDataFrame(
        [("r", "f", 1, 50, 60, 1), ("r", "f", 2, 1, 5, 2), ("r", "g", 3, 7, 9, None)],
        "repo_id string, file string, lead_id long, start_line long, end_line long, rank long",
    )
    traces = spark.createDataFrame([("r", "f", 1, 4, 4, "C"), ("r", "g", 2, 8, 8, "C")], "repo_id string, file string, trace_id long, start_line long, end_line long, cwe string")
    got = retrieval.retrieval_metrics(leads, traces, [1, 2, 3]).first()
    assert got["first_hit"] == 2 and got["rr"] == 0.5
    assert [got[f"trace_recall_at_{k}"] for k in (1, 2, 3)] == [0, 0.5, 1.0]
    assert got["precision_at_3"] == pytest.approx(2 / 3)


def test_row_violations(spark):
    rows = spark.createDataFrame([(1, "x", 1, None), (2, "", 0, None), (3, "x", None, None), (4, "x", 0, None)], "eid long, code string, row_label int, cwe string")
    got = {(r["eid"], r["rule"]) for r in row_violations(rows).collect()}
    assert got == {(1, "positive has a class"), (2, "code is not empty"), (3, "label is 0 or 1")}


def test_entry_registers_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_hashed_ngrams_of_each_document(spark, tmp_path):
    from collections import Counter

    from lumenspan.operators.ngrams import text_buckets
    from lumenspan.plans import QUERIES

    texts = [None, "", "ab", "abc", "Abcabc  abcd", "日本語の文", "x" * 50, *(f"text {i} of many" for i in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["f22_hashed_ngrams"](spark, str(tmp_path)).collect():
        assert 0 <= r["bucket"] < 1 << 18
        got.setdefault(r["doc_id"], Counter())[r["bucket"]] += r["n"]
    place = lambda g: int(text_buckets(g, range(len(g), len(g) + 1), 1 << 18)[0][0])
    for i, t in enumerate(texts):
        t = (t or "").lower().replace("  ", " ")
        grams = [t[j : j + n] for n in (3, 4, 5) for j in range(len(t) - n + 1)]
        assert got.get(i, Counter()) == Counter(map(place, grams)), t
    assert len({place(f"{a}{b}c") for a in "abcdefgh" for b in "abcdefgh"}) >= 62


def test_bootstrap_intervals_of_1000_draws(spark, tmp_path):
    import numpy as np

    from lumenspan.operators.resampling import draw_weights
    from lumenspan.plans.fixtures import Views
    from lumenspan.plans import QUERIES

    texts = [" ".join("w" * (1 + (i * 5 + j * j * 3 + i * j) % 13) for j in range(6)) for i in range(60)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tokens = Views(spark, str(tmp_path)).tok_scores.where("is_test").selectExpr("eid", "logit", "cast(length(word) as double) as other", "y").toPandas()

    def draws(seed, names):
        units = spark.createDataFrame([(i,) for i in range(0, 60, 5)], "eid long")
        keys = {r["eid"]: r["h"] for r in units.select("eid", F.xxhash64("eid").alias("h")).collect()}
        w = draw_weights(np.array(list(keys.values())).view(np.uint64), 1000, seed)
        weight = {(d, e): w[i, d] for i, e in enumerate(keys) for d in range(1000)}
        y = tokens["y"].to_numpy()
        for d in range(1000):
            w = np.array([weight[d, e] for e in tokens["eid"]], float)
            pos, neg = w * (y == 1), w * (y == 0)
            if pos.sum() and neg.sum():
                s = [tokens[n].to_numpy() for n in names]
                yield [pos @ ((x[:, None] > x) + (x[:, None] == x) / 2) @ neg / pos.sum() / neg.sum() for x in s]

    one = np.array(list(draws(7, ["logit"])))[:, 0]
    got = QUERIES["a30_clustered_interval"](spark, str(tmp_path)).first()
    assert got["n_draws"] == len(one) > 990
    assert [got[c] for c in ("mean", "lo", "hi")] == pytest.approx([one.mean(), *np.quantile(one, [0.025, 0.975])], abs=1e-5)
    two = np.array(list(draws(11, ["logit", "other"])))
    delta = two[:, 0] - two[:, 1]
    got = QUERIES["a33_paired_interval"](spark, str(tmp_path)).first()
    lo, hi = np.quantile(delta, [0.025, 0.975])
    assert got["n_draws"] == len(delta) and got["excludes_0"] == (lo > 0 or hi < 0)
    assert [got[c] for c in ("mean", "lo", "hi", "above_0")] == pytest.approx([delta.mean(), lo, hi, (delta > 0).mean()], abs=1e-5)
