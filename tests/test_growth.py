"""Steps whose work grew faster than their input, and SQL that left ties to chance."""

import random
import re

import pytest
from pyspark.sql import functions as F


def test_cumulative_counts_of_many_groups_and_many_cuts(spark):
    from lumenspan.operators.ranking import cumulative

    rng = random.Random(4)
    rows = [(g, float(s), rng.randrange(3), rng.randrange(3)) for g in range(3) for s in rng.sample(range(5000), 1500)]
    counts = spark.createDataFrame(rows, "g long, score double, pos long, neg long")
    want = []
    for g in range(3):
        own, tp, fp = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]), 0, 0
        for place, r in enumerate(own, 1):
            tp, fp = tp + r[2], fp + r[3]
            want.append((*r, tp, fp, sum(x[2] for x in own), sum(x[3] for x in own), place, len(own)))
    # In buckets of few scores (some 1,000 cuts), and without buckets, as no group passes one.
    for size in (4, 1500):
        assert sorted(map(tuple, cumulative(counts, ["g"], size).collect())) == sorted(want)


def test_merged_ranges_in_sql_do_not_hang_on_ties():
    duckdb = pytest.importorskip("duckdb")
    from lumenspan.plans.oracle import merged

    rng, rows = random.Random(3), []
    for i in range(20):
        at = 0
        for _ in range(60):
            at += rng.randrange(1, 8)
            rows += [(i, at, at + rng.randrange(1, 4))] * rng.randrange(1, 4)
    want = []
    for eid, s, e in sorted(rows):
        if want and want[-1][0] == eid and s <= want[-1][2]:
            want[-1] = (eid, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
        else:
            want.append((eid, s, e, 1))
    con = duckdb.connect()
    con.execute("CREATE TABLE spans (eid BIGINT, s BIGINT, e BIGINT)")
    con.executemany("INSERT INTO spans VALUES (?, ?, ?)", rows)
    got = con.execute("WITH z AS (SELECT 1)" + merged("m", "SELECT eid, s, e FROM spans") + "SELECT eid, s, e, members FROM m").fetchall()
    assert sorted(got) == sorted(want)


def test_soft_labels_look_ahead_without_a_shrinking_frame(spark):
    from lumenspan.operators.intervals import nearest_distance, soft_labels

    rng = random.Random(1)
    rows = [(g, i, int(rng.random() < 0.1)) for g in range(3) for i in range(200)]
    got = soft_labels(spark.createDataFrame(rows, "eid long, tok int, y int"), 4)
    on = {g: [i for h, i, y in rows if h == g and y] for g in range(3)}
    want = {(g, i): max(0.0, 1 - min(abs(i - j) for j in on[g]) / 4) for g, i, _ in rows}
    assert {(r["eid"], r["tok"]): r["soft"] for r in got.collect()} == want
    spans = spark.createDataFrame([(1, 0, 5), (1, 9, 10)], "eid long, s long, e long")
    for df in (got, nearest_distance(spans, spans)):
        plan = df._jdf.queryExecution().toString().lower()
        assert "currentrow$(), unboundedfollowing" not in plan


def test_pattern_spans_by_a_pattern_for_each_text(spark):
    from lumenspan.operators.labels import class_spans, pattern_spans

    rows = [(1, "a1 b22 c", "[0-9]+"), (2, "a1 Bb cc", "[a-z]+"), (3, "", "x"), (4, None, "x")]
    got = pattern_spans(spark.createDataFrame(rows, "eid long, code string, p string"), F.col("p"))
    want = [(i, m.start(), m.end()) for i, t, p in rows if t for m in re.finditer(p, t)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # A match's row carries neither the text nor the other matches.
    assert not any("array" in t or "string" in t for _, t in got.dtypes)
    ex = spark.createDataFrame([(1, "ab 12", "A", 1), (2, "ab 12", "B", 1), (3, "ab 12", "C", 1), (4, "ab 12", "A", 0)], "eid long, code string, cwe string, row_label int")
    found = class_spans(ex, {"A": ("[0-9]+", ""), "B": ("[a-z]+", "[0-9]+")}, "b")
    assert sorted((r["eid"], r["s"], r["e"]) for r in found.where("key = 'sink'").collect()) == [(1, 3, 5), (2, 0, 2)]
    assert [(r["eid"], r["s"], r["e"]) for r in found.where("key = 'source'").collect()] == [(2, 3, 5)]


def test_trigrams_cut_a_text_once(spark, tmp_path):
    from lumenspan.plans import QUERIES

    texts = ["abcabc", "ab", "\U0001f600bc", None, ""]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["f22_char_ngrams"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("abc", 2), ("bca", 1), ("cab", 1), ("\U0001f600bc", 1)]
    assert "substring(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_sample_orders_only_rows_near_its_bound(spark, monkeypatch):
    from lumenspan.functions.scalars import uniform_hash
    from lumenspan.operators import splits

    rows = spark.range(20_000).select((F.col("id") % 7).alias("eid"), F.col("id").alias("tok"))
    want = {r["tok"] for r in rows.withColumn("k", uniform_hash(F.lit(5), "eid", "tok")).orderBy("k").limit(300).collect()}
    seen, real = [], splits.ranked
    monkeypatch.setattr(splits, "ranked", lambda df, *a, **k: seen.append(df.count()) or real(df, *a, **k))
    assert {r["tok"] for r in splits.sampled(rows, 300, 5, ["eid", "tok"]).collect()} == want
    assert 300 <= seen[0] < 350
    assert splits.sampled(rows, 30_000, 5, ["eid", "tok"]).count() == 20_000 and splits.sampled(rows, 0, 5, ["eid", "tok"]).count() == 0


def test_highest_score_of_each_run(spark):
    from itertools import groupby

    from lumenspan.operators.pooling import run_max

    rng = random.Random(2)
    rows = [(g, i, rng.randrange(2), rng.random(), g == 1) for g in range(3) for i in range(100)]
    got = run_max(spark.createDataFrame(rows, "eid long, tok int, y int, prob double, side boolean"), "prob", ["side"])
    want = [(*k, max(r[3] for r in own), k[0] == 1) for k, own in ((k, list(own)) for k, own in groupby(rows, key=lambda r: (r[0], r[2])))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_excerpts_of_a_text_that_holds_the_marks_itself(spark):
    from lumenspan.operators.lines import excerpts

    text = "zero «q»\none\ntwo word here\nthree\nfour"
    at = text.index("word")
    got = excerpts(spark.createDataFrame([(1, text), (2, None)], "eid long, code string"), spark.createDataFrame([(1, at, at + 4), (1, at, at + 12), (2, 0, 1)], "eid long, s long, e long"), 1)
    assert {(r["s"], r["e"]): r["excerpt"] for r in got.collect()} == {
        (at, at + 4): "    2 | one\n    3 | two «word» here\n    4 | three",
        (at, at + 12): "    2 | one\n    3 | two «word here\n    4 | th»ree\n    5 | four",
    }


def test_vectors_in_the_task_equal_those_from_rows(spark, monkeypatch):
    import numpy as np

    from lumenspan.operators import ngrams, surface

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "été", "x", "gamma delta"]) for _ in range(rng.randrange(9))) if i else None, i % 2, "train" if i % 3 else "test") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, side string").repartition(3)
    fit = F.col("side") == "train"
    for held, in_words in ((300_000, False), (300_000, True), (5, False)):
        monkeypatch.setattr(ngrams, "HELD", held)
        monkeypatch.setattr(surface, "SLICE", 8)
        runs = surface.Runs(range(3, 5), in_words)
        want, n = surface.sparse_vectors(surface.character_runs(docs, range(3, 5), in_words), docs.select("doc_id", "y", "side"), 2, 30, fit)
        got, m = surface.run_vectors(docs, runs, 2, 30, fit)
        assert n == m and got.columns == want.columns
        a, b = ({r["doc_id"]: r for r in x.collect()} for x in (want, got))
        assert a.keys() == b.keys()
        for i, r in a.items():
            assert r["places"] == b[i]["places"] and np.allclose(r["values"], b[i]["values"])
    # Nothing but the vocabulary's sums is shuffled for the vectors of words.
    words = ngrams.vocabulary(docs, ngrams.word_pieces, 1, 10)
    assert {r["gram"]: r["df"] for r in words.collect()}.keys() >= {"alpha", "x", "delta"}
    plan = ngrams.text_vectors(docs, ngrams.word_pieces, words, 60)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_matcher_finds_the_blocks_of_the_standard_one():
    import difflib

    from lumenspan.operators.diffs import Matcher

    rng = random.Random(8)
    for alphabet, size in (("ab", 400), ("abcdefgh é\U0001f600", 1500), ("a", 300)):
        for _ in range(4):
            a = "".join(rng.choice(alphabet) for _ in range(size))
            b = a[: size // 3] + "".join(rng.choice(alphabet) for _ in range(size // 2)) + a[size // 2 :]
            for x, y in ((a, b), (b, a), (a, "".join(rng.choice(alphabet) for _ in range(size)))):
                got = Matcher(x, y)
                assert got.ranks and got.get_opcodes() == difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    for x, y in (("", ""), ("", "a" * 30_000), ("a" * 200, "b" * 200)):
        assert Matcher(x, y).get_opcodes() == difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def test_long_texts_are_compared_by_characters(spark):
    import difflib

    from lumenspan.operators.diffs import Matcher, blamed_lines, diff_spans

    rng = random.Random(12)
    lines = [" ".join(f"w{rng.randrange(300)}" for _ in range(6)) for _ in range(400)]
    long = "\n".join(lines)
    after = long[:3000] + "X" + long[3001:9000] + long[9004:]
    many = "".join(f"{i}\n" for i in range(5000))
    rows = [(1, long, after), (2, many, many.replace("\n2500\n", "\n25_00\n")), (3, many, many.replace("\n2500\n", "\n2_0\n")), (4, None, "x" * 7000)]
    pairs = spark.createDataFrame(rows, "eid long, before string, after string")
    got = {r["eid"]: ([(x["s"], x["e"]) for x in r["spans"]], r["how"]) for r in diff_spans(pairs, "eid").collect()}
    at = many.index("\n2500\n") + 1
    assert got == {1: ([(3000, 3001), (9000, 9004)], "chars"), 2: ([], "chars"), 3: ([(at + 1, at + 3)], "chars"), 4: ([], "chars")}
    lines = {(r["eid"], r["s"], r["e"], r["how"]) for r in blamed_lines(pairs.where("eid in (2, 3)")).collect()}
    assert lines == {(2, at, at + 5, "inserted"), (3, at, at + 5, "deleted")}
    # Unlike and near texts, with pieces longer than are taken length by length.
    near = list(long[:2500])
    for _ in range(12):
        k = rng.randrange(len(near))
        near[k : k + rng.randrange(60)] = rng.choice(["", "zz", long[:70]])
    for x, y in ((long[:2500], "".join(near)), ("".join(near), long[:2500]), (long[:1500], long[4000:6000]), ("x\n" * 401, "y\n" * 500), ("ab" * 400, "ac" * 500)):
        assert Matcher(x, y).get_opcodes() == difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def test_weights_of_draws_by_their_leading_bits():
    import numpy as np

    from lumenspan.functions.scalars import POISSON_1
    from lumenspan.operators.resampling import draw_weights, mixed

    units = np.arange(3000, dtype=np.uint64)
    salt = mixed(np.arange(200, dtype=np.uint64) + np.uint64(7) * np.uint64(1_000_003))
    u = mixed(units[:, None] ^ salt[None, :]) >> np.uint64(11)
    assert (draw_weights(units, 200, 7) == np.searchsorted(np.array(POISSON_1), u / float(1 << 53), side="right")).all()


def test_resampling_is_dealt_by_its_work(spark, monkeypatch):
    from lumenspan.operators import resampling

    rng = random.Random(3)
    rows = [(i % 40, float(rng.randrange(60)), rng.randrange(2)) for i in range(900)]
    df = spark.createDataFrame(rows, "eid long, score double, y int")
    want = sorted(map(tuple, resampling.resampled_auc(df, ["eid"], "score", "y", 20, 7).collect()))
    monkeypatch.setattr(resampling, "RANGE", 2000)
    got = resampling.resampled_auc(df, ["eid"], "score", "y", 20, 7)
    assert re.search(r"rangepartitioning\(score#\d+ DESC NULLS LAST, [2-9]\)", got._jdf.queryExecution().executedPlan().toString())
    for a, b in zip(sorted(map(tuple, got.collect())), want, strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1])


def test_span_max_steps_give_a_row_for_each_example_of_a_batch(spark):
    import numpy as np

    from lumenspan.operators.learning import span_max_step

    rng = np.random.default_rng(1)
    x, eid, y = rng.standard_normal((300, 3)), rng.integers(0, 9, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(e), r.tolist(), int(t)) for e, r, t in zip(eid, x, y, strict=True)], "eid long, x array<double>, y int").repartition(4)
    w, b = np.array([0.3, -0.2, 0.5]), 0.1
    grad, gb, loss = span_max_step(df, w, b, 0.4, 3.0)
    z = x @ w + b
    tops = [max(np.flatnonzero(eid == e), key=lambda i: z[i]) for e in range(9)]
    target = np.concatenate([y, [y[eid == e].max() for e in range(9)]])
    part = np.concatenate([0.6 * np.where(y == 1, 3.0, 1.0) / np.where(y == 1, 3.0, 1.0).sum(), np.full(9, 0.4 / 9)])
    zz, xx = np.concatenate([z, z[tops]]), np.concatenate([x, x[tops]])
    r = part * (1 / (1 + np.exp(-zz)) - target)
    assert np.allclose(grad, r @ xx) and gb == pytest.approx(r.sum())
    assert loss == pytest.approx((part * (np.maximum(zz, 0) - zz * target + np.log1p(np.exp(-np.abs(zz))))).sum())


def test_equal_rows_are_fitted_as_one_with_their_number(spark):
    import numpy as np

    from lumenspan.operators import fitting

    rng = random.Random(6)
    rows = [([float(rng.randrange(3)), float(rng.randrange(2))], rng.randrange(2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    one = df.groupBy("x", "y").agg(F.count("*").alias("n"))
    assert one.count() <= 12
    a, b = (fitting.fit_many(d, [fitting.Setting(0, 2)], lambda batch: batch.column("y").to_numpy().astype(float)[:, None])[0] for d in (df, one))
    assert np.allclose(a[0], b[0]) and a[1] == pytest.approx(b[1])


def test_hashed_ngrams_of_texts_counted_together(spark):
    import tracemalloc
    from collections import Counter

    from lumenspan.operators import ngrams

    def plain(text, buckets):
        text = re.sub(r"\s\s+", " ", text.lower())
        for size in (3, 4, 5):
            for i in range(len(text) - size + 1):
                h = size
                for c in text[i : i + size]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                yield (h * 0x9E3779B97F4A7C15 % 2**64 >> 32) % buckets

    rng = random.Random(8)
    texts = ["", "a", "ab", "abc", "", "ΣΊΣΥΦΟΣ  日本語", "aaaa" * 9000, *("".join(rng.choices("abc \n", k=rng.randrange(12))) for _ in range(5000)), "abc", ""]
    for buckets in (1 << 18, 1000, 1 << 31):
        place, bucket, n = ngrams.bucket_counts(texts[:60], range(3, 6), buckets)
        got = list(zip(place.tolist(), bucket.tolist(), n.tolist(), strict=True))
        assert got == [(i, b, k) for i, t in enumerate(texts[:60]) for b, k in sorted(Counter(plain(t, buckets)).items())]
    # More texts than are counted together, null ids and texts.
    rows = [(None if i % 9 == 0 else i // 2, t or None) for i, t in enumerate(texts)]
    got = ngrams.hashed_ngrams(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), range(3, 6), 1 << 18)
    want = [(d, b, k) for d, t in rows for b, k in Counter(plain(t or "", 1 << 18)).items()]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    # A long text takes a few copies of its characters.
    long = "".join(rng.choices("abcdefghij klmnop", k=1_000_000))
    tracemalloc.start()
    ngrams.text_buckets(long, range(3, 6), 1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * len(long)
