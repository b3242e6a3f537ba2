"""Queries of metrics, statistics, resampling, gates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import scalars as S
from lumenspan.operators import intervals as I
from lumenspan.operators import pooling as P
from lumenspan.operators import ranking as R
from lumenspan.operators import resampling as B
from lumenspan.operators import splits as X
from lumenspan.operators import statistics as Z
from lumenspan.operators import transfer
from lumenspan.plans.fixtures import SQL
from lumenspan.plans.oracle import EXAMPLES, TOKENS, hashed, src
from lumenspan.plans.registry import longs, query, r6
from lumenspan.sources import files
from lumenspan.store import new_path, staged
from lumenspan.streaming import incremental

#: Draws of intervals and nulls.
N_BOOT = 1000


def example_scores(v):
    t = v.tok_scores.groupBy("eid").agg(F.max("logit").alias("score"))
    return t.join(v.ex.select("eid", F.col("row_label").alias("y"), "lang", "cwe", "grp"), "eid")


def _probs(v):
    return example_scores(v).withColumn("prob", S.sigmoid(F.col("score") / 4 - 1))


_EXP = SQL + ", ep AS (SELECT *, 1 / (1 + exp(-(score / 4 - 1))) AS prob FROM exs)"


# thresholds and calibration


@query(SQL + """, c AS (SELECT lang, t / 100.0 AS thr, count(*) FILTER (prob >= t / 100.0 AND y = 1) AS tp, count(*) FILTER (prob >= t / 100.0 AND y = 0) AS fp, count(*) FILTER (y = 1) AS p
  FROM tok_scores, (SELECT unnest(range(1, 100)) AS t) GROUP BY lang, t),
f AS (SELECT lang, thr, round(coalesce(2.0 * tp / nullif(p + tp + fp, 0), 0), 12) AS f1 FROM c)
SELECT lang, round(thr, 6) AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, thr) = 1""")
def a10_f1_on_a_grid(v):
    return R.grid_f1(v.tok_scores, ["lang"], "prob", "y").select("lang", *r6("threshold", "f1"))


@query(TOKENS + """, f AS (SELECT *, round(2 * (tp / (tp + fp)) * (tp / P) / (tp / (tp + fp) + tp / P + 1e-12), 12) AS f1 FROM roc)
SELECT grp AS lang, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, score) = 1""")
def a10_f1_on_the_curve(v):
    roc = R.cumulative(R.score_counts(v.tok_scores, ["lang"], "logit", "y"), ["lang"])
    return R.curve_f1(roc, ["lang"]).select("lang", *r6("threshold", "f1"))


@query(TOKENS + """, u AS (SELECT grp, list(score ORDER BY score) AS us FROM roc GROUP BY grp), v AS (SELECT grp, us, i, i * (len(us) - 1) / 99.0 AS a FROM u, (SELECT unnest(range(100)) AS i)),
q AS (SELECT grp, i, us[CAST(floor(a) AS BIGINT) + 1] + (us[CAST(ceil(a) AS BIGINT) + 1] - us[CAST(floor(a) AS BIGINT) + 1]) * (a - floor(a)) AS thr FROM v),
m AS (SELECT q.grp, q.i, q.thr, coalesce(max(tp) FILTER (r.score >= q.thr), 0) AS tp, coalesce(max(fp) FILTER (r.score >= q.thr), 0) AS fp, max(P) AS P, max(N) AS N FROM q JOIN roc r ON r.grp = q.grp GROUP BY q.grp, q.i, q.thr),
c AS (SELECT *, round((tp + N - fp) * 1.0 / (P + N), 12) AS accuracy FROM m)
SELECT grp AS lang, round(thr, 6) AS threshold, round(accuracy, 6) AS accuracy FROM c QUALIFY row_number() OVER (PARTITION BY grp ORDER BY accuracy DESC, thr) = 1""")
def a6_accuracy_at_percentiles(v):
    roc = staged(R.cumulative(R.score_counts(v.tok_scores, ["lang"], "logit", "y"), ["lang"]), "roc")
    return R.percentile_accuracy(roc, ["lang"]).select("lang", *r6("threshold", "accuracy"))


@query(SQL + """, b AS (SELECT lang, least(floor(prob * 10), 9) AS bin, count(*) AS n, sum(prob) AS p, sum(y) AS y, sum((prob - y) * (prob - y)) AS sq FROM tok_scores GROUP BY 1, 2)
SELECT lang, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(p - y)) / sum(n), 6) AS ece FROM b GROUP BY lang""")
def a12_closed_bins(v):
    return R.calibration(v.tok_scores, ["lang"], bins=10, closed=True).select("lang", *r6("brier", "ece"))


@query(SQL + """, c AS (SELECT lang, count(*) FILTER (prob >= 0.7 AND y = 1) AS tp, count(*) FILTER (prob >= 0.7 AND y = 0) AS fp, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM tok_scores GROUP BY lang)
SELECT lang, round(sqrt(tp / p * (1 - fp / n)), 6) AS g_mean, round(tp / p * (1 - fp / n), 6) AS g_mean_sq FROM c""")
def a4_gmean_at_threshold(v):
    c = R.confusion(v.tok_scores, ["lang"], 0.7, "prob")
    return c.select("lang", *r6("g_mean"), F.round(F.col("g_mean") * F.col("g_mean"), 6).alias("g_mean_sq"))


@query(SQL + """, z AS (SELECT lang, prob, 1 / (1 + exp(-((ln(least(greatest(prob, 1e-7), 1 - 1e-7) / (1 - least(greatest(prob, 1e-7), 1 - 1e-7))) - 1) / 2))) AS q FROM tok_scores)
SELECT lang, round(avg(CASE WHEN prob < 0.5 THEN 1.0 ELSE 0 END), 6) AS below_before, round(avg(CASE WHEN q < 0.5 THEN 1.0 ELSE 0 END), 6) AS below_after, count(*) AS n FROM z GROUP BY lang""")
def a38_flip_rate(v):
    t = v.tok_scores.withColumn("after", S.platt(S.clipped_logit(F.col("prob")), 1.0, 2.0))
    return Z.flip_rate(t, ["lang"], "prob", "after").select("lang", *r6("below_before", "below_after"), "n")


def _bundle(levels: str) -> str:
    """AUC, counts at 0.5, recall at FPR 0.05 and 0.1, Brier and ECE per group of ``levels`` (grp, score, y), score a probability."""
    return src(levels) + """, cm AS (SELECT grp, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn FROM src GROUP BY grp),
vx AS (SELECT *, coalesce((fp - coalesce(lag(fp) OVER o, 0)) * (lead(tp) OVER o - tp) <> (lead(fp) OVER o - fp) * (tp - coalesce(lag(tp) OVER o, 0)), TRUE) AS keep FROM roc WINDOW o AS (PARTITION BY grp ORDER BY fp, tp)),
rf AS (SELECT grp, coalesce(max(CASE WHEN fp <= N * 0.05 THEN tp END) / nullif(max(P), 0), 0) AS r5, coalesce(max(CASE WHEN fp <= N * 0.1 THEN tp END) / nullif(max(P), 0), 0) AS r10 FROM vx WHERE keep GROUP BY grp),
cb AS (SELECT grp, CASE WHEN floor(score * 15) < 15 THEN floor(score * 15) END AS bin, count(*) AS n, sum(score) AS p, sum(y) AS y, sum((score - y) * (score - y)) AS sq FROM src GROUP BY 1, 2),
ca AS (SELECT grp, sum(sq) / sum(n) AS brier, sum(CASE WHEN bin IS NOT NULL THEN abs(p - y) ELSE 0 END) / sum(n) AS ece FROM cb GROUP BY grp),
bundle AS (SELECT grp, round(auc, 6) AS auc, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(r5, 6) AS recall_at_5, round(r10, 6) AS recall_at_10, round(brier, 6) AS brier, round(ece, 6) AS ece, CAST(tp + fp + fn + tn AS BIGINT) AS n_total, CAST(tp + fn AS BIGINT) AS n_pos
  FROM auc JOIN cm USING (grp) JOIN rf USING (grp) JOIN ca USING (grp))
"""


BUNDLE = ["auc", "accuracy", "precision", "recall", "f1", "recall_at_5", "recall_at_10", "brier", "ece"]


@query(_bundle("SELECT lang AS grp, round(prob, 9) AS score, y, 1 AS w FROM tok_scores") + "SELECT grp AS lang, * EXCLUDE (grp) FROM bundle")
def a43_level_bundle(v):
    return R.level_bundle(v.tok_scores.withColumn("prob", F.round("prob", 9)), ["lang"]).select("lang", *r6(*BUNDLE), *longs("n_total", "n_pos"))


_LEVELS = """SELECT {'split': CASE WHEN is_test THEN 'test' ELSE 'train' END, 'level': level} AS grp, round(prob, 9) AS score, y, 1 AS w FROM (
  SELECT is_test, 'all_tokens' AS level, prob, y FROM tok_scores UNION ALL SELECT is_test, 'code_tokens', prob, y FROM tok_scores WHERE is_code
  UNION ALL SELECT any_value(is_test), 'examples', max(prob), max(row_label) FROM tok_scores GROUP BY eid
  UNION ALL SELECT any_value(is_test), 'spans', max(prob), max(y) FROM (SELECT *, tok - row_number() OVER (PARTITION BY eid, y ORDER BY tok) AS k FROM tok_scores) GROUP BY eid, y, k)"""


@query(_bundle(_LEVELS) + "SELECT grp.split AS split, grp.level AS level, * EXCLUDE (grp) FROM bundle")
def c2_token_report(v):
    """Tokens, live tokens, runs of equal tokens and examples, on either side of the split."""
    t = staged(v.tok_scores.select("eid", "tok", "prob", "y", "is_code", "is_test", "row_label"), "report-tokens")
    spans = P.run_max(t, "prob", ["is_test"])
    level = lambda df, name: df.select("is_test", F.lit(name).alias("level"), "prob", F.col("y").cast("int").alias("y"))
    examples = t.groupBy("eid").agg(F.first("is_test").alias("is_test"), F.max("prob").alias("prob"), F.max("row_label").alias("y"))
    rows = level(t, "all_tokens").unionByName(level(t.where("is_code"), "code_tokens")).unionByName(level(examples, "examples"))
    rows = rows.unionByName(level(spans, "spans"))
    rows = rows.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train")).withColumn("prob", F.round("prob", 9))
    return R.level_bundle(rows, ["split", "level"]).select("split", "level", *r6(*BUNDLE), *longs("n_total", "n_pos"))


@query()
def c2_level_intervals(v):
    """The test side's levels: AUC with an interval over examples, beside a random score and the length."""
    t = v.tok_scores.where("is_test").select("eid", "tok", "prob", "y", "is_code", "row_label", F.length("word").cast("double").alias("length"), S.uniform_hash(F.lit(7), "eid", "tok").alias("random"))
    names = ("eid", "y", "prob", "random", "length")
    level = lambda df, name: df.select(*names, F.lit(name).alias("level"))
    examples = t.groupBy("eid").agg(F.max("row_label").alias("y"), F.max("prob").alias("prob"), F.max("random").alias("random"), F.sum("length").alias("length"))
    rows = staged(level(t, "all_tokens").unionByName(level(t.where("is_code"), "code_tokens")).unionByName(level(examples, "examples")), "levels")
    out = R.roc_auc(rows, ["level"], "prob")
    for name in ("random", "length"):
        out = out.join(R.roc_auc(rows, ["level"], name).select("level", F.col("auc").alias(f"{name}_auc")), "level")
    ci = None
    for name in ("all_tokens", "code_tokens", "examples"):
        one = B.interval(B.resampled_auc(rows.where(F.col("level") == name), ["eid"], "prob", "y", N_BOOT, 7)).select(F.lit(name).alias("level"), "lo", "hi", "n_draws")
        ci = one if ci is None else ci.unionByName(one)
    return out.join(ci, "level").select("level", *r6("auc", "lo", "hi", "random_auc", "length_auc"), *longs("n_pos", "n_neg", "n_draws"))


# pooling, slices, agreement


@query(SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY logit DESC, tok) AS r FROM tok_scores), c AS (SELECT eid, max(logit) FILTER (y = 1) AS pos, arg_max(logit, tok) FILTER (is_code) AS last_code FROM tok_scores GROUP BY eid)
SELECT t.eid, round(avg(logit) FILTER (r <= 10), 6) AS top_10, round(any_value(c.pos), 6) AS labelled_max, round(coalesce(any_value(c.last_code), arg_max(logit, tok)), 6) AS last_code FROM t JOIN c ON c.eid = t.eid GROUP BY t.eid""")
def a15_other_reads(v):
    return P.other_reads(v.tok_scores, 10).select("eid", *r6("top_10", "labelled_max", "last_code"))


@query(src("""SELECT {'family': f, 'lang': l} AS grp, score, y, 1 AS w FROM (SELECT *, CASE WHEN CAST(substr(cwe, 5) AS INT) % 2 = 0 THEN 'even' ELSE 'odd' END AS f0 FROM exs), (SELECT unnest(['even', 'odd']) AS f), (SELECT unnest(['de', 'en', 'es', 'fr', '*']) AS l)
WHERE (y = 0 OR f0 = f) AND (l = '*' OR lang = l)""") + "SELECT grp.family AS family, grp.lang AS lang, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def a17_family_by_language(v):
    family = F.when(F.col("cwe").isNotNull(), F.when(F.substring("cwe", 5, 9).cast("int") % 2 == 0, "even").otherwise("odd"))
    x = staged(example_scores(v).withColumn("family", family), "example-scores")
    return R.class_cells(x, "family", "lang", ["even", "odd"]).select("family", "lang", *r6("auc"), *longs("n_pos", "n_neg"))


@query(src("SELECT 1 AS grp, score, side AS y, 1 AS w FROM (SELECT a.score, 1 AS side FROM pairs JOIN exs a ON a.eid = vuln_eid UNION ALL SELECT b.score, 0 FROM pairs JOIN exs b ON b.eid = safe_eid)") + "SELECT round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def a19_pooled_pair_auc(v):
    s = example_scores(v).select("eid", "score")
    one = v.pairs.select(F.col("vuln_eid").alias("eid")).join(s, "eid").select("score", F.lit(1).alias("y"))
    two = v.pairs.select(F.col("safe_eid").alias("eid")).join(s, "eid").select("score", F.lit(0).alias("y"))
    return R.roc_auc(one.unionByName(two), []).select(*r6("auc"), *longs("n_pos", "n_neg"))


_DETECT = SQL + """, m AS (SELECT eid, k, bool_or(y = 1 AND is_code AND logit + k >= 4) AS hit FROM tok_scores, (SELECT unnest(range(8)) AS k) GROUP BY eid, k),
n AS (SELECT eid, count(*) FILTER (hit) AS n FROM m GROUP BY eid)
"""


def _detected(v):
    hit = [F.max((F.col("y") == 1) & F.col("is_code") & (F.col("logit") + k >= 4)).alias(f"m{k}") for k in range(8)]
    return v.tok_scores.groupBy("eid").agg(*hit)


@query(_DETECT + "SELECT k AS model, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS rate, count(*) AS n FROM m GROUP BY k")
def a21_detection_rate(v):
    d = _detected(v).select("eid", F.posexplode(F.array(*[f"m{k}" for k in range(8)])).alias("model", "hit"))
    return d.groupBy(F.col("model").cast("long").alias("model")).agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query(_DETECT + """SELECT b AS n_models, count(n.eid) AS n, CAST(count(*) FILTER (n.n >= 6) AS BIGINT) AS found_by_most, CAST(count(*) FILTER (n.n <= 1) AS BIGINT) AS missed_by_most FROM (SELECT unnest(range(9)) AS b) LEFT JOIN n ON n.n = b GROUP BY b""")
def a22_agreement_histogram(v):
    d = _detected(v).select("eid", F.size(F.filter(F.array(*[f"m{k}" for k in range(8)]), lambda x: x)).cast("long").alias("n_models"))
    d = d.groupBy("n_models").agg(F.count("*").alias("n"))
    every = v.spark.range(9).withColumnRenamed("id", "n_models").join(d, "n_models", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    many, few = F.when(F.col("n_models") >= 6, F.col("n")).otherwise(0), F.when(F.col("n_models") <= 1, F.col("n")).otherwise(0)
    return every.select("n_models", "n", many.cast("long").alias("found_by_most"), few.cast("long").alias("missed_by_most"))


@query(_DETECT + """, u AS (SELECT eid, count(*) FILTER (hit AND k < 3) AS c FROM m WHERE k < 3 AND hit GROUP BY eid)
SELECT count(*) FILTER (c = 3) AS in_all, count(*) AS in_any, count(*) FILTER (c % 2 = 1) AS in_odd FROM u""")
def u4_member_sets(v):
    d = _detected(v).select("eid", F.posexplode(F.array("m0", "m1", "m2")).alias("model", "hit")).where("hit")
    return Z.member_sets(d.select("model", F.col("eid").alias("id")), 3)


# statistics


@query(SQL + """SELECT member, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(score) AS n FROM member_scores GROUP BY member""")
def a26_mean_std(v):
    return Z.mean_std(v.member_scores, ["member"], "score").select("member", *r6("mean", "std"), "n")


@query(SQL + """SELECT CAST(y AS BIGINT) AS y, round(quantile_cont(logit, 0.1), 6) AS p10, round(quantile_cont(logit, 0.5), 6) AS p50, round(quantile_cont(logit, 0.9), 6) AS p90, round(avg(logit), 6) AS mean, round(min(logit), 6) AS lo, round(max(logit), 6) AS hi, count(*) AS n,
  round((SELECT avg(CASE WHEN logit > (SELECT quantile_cont(logit, 0.5) FROM tok_scores WHERE y = 1) THEN 1.0 ELSE 0 END) FROM tok_scores WHERE y = 0), 6) AS above FROM tok_scores GROUP BY y""")
def a27_exact_percentiles(v):
    t = v.tok_scores.select("y", "logit")
    p = staged(Z.percentiles(t, ["y"], "logit", [0.1, 0.5, 0.9]), "percentiles")
    above = Z.above_share(t, "logit", "y", p.where("y = 1").select(F.col("p50").alias("thr")))
    p = p.crossJoin(F.broadcast(above))
    return p.select(*longs("y"), *r6("p10", "p50", "p90", "mean", "lo", "hi"), *longs("n"), F.round("share", 6).alias("above"))


@query(SQL + """, t AS (SELECT eid, max(logit) AS s, count(*) AS n FROM tok_scores GROUP BY eid), o AS (SELECT row_number() OVER (ORDER BY s, eid) AS a, row_number() OVER (ORDER BY n, eid) AS b FROM t),
r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS b FROM t)
SELECT round((SELECT corr(a, b) FROM o), 6) AS ordinal, round((SELECT corr(a, b) FROM r), 6) AS tie_averaged""")
def a28_rank_correlations(v):
    """Spearman by ordinal ranks, and by ranks that ties share."""
    t = staged(v.tok_scores.groupBy("eid").agg(F.max("logit").alias("s"), F.count("*").cast("double").alias("n")), "lengths")
    ordinal = X.ranked(X.ranked(t, [], F.col("s"), "eid", "a"), [], F.col("n"), "eid", "b").agg(F.corr("a", "b").alias("ordinal"))
    return ordinal.crossJoin(Z.spearman(t, "s", "n")).select(*r6("ordinal"), F.round("spearman", 6).alias("tie_averaged"))


@query(SQL + """, t AS (SELECT eid, any_value(y) AS y, any_value(score) AS a, (eid * 37 % 101) / 101.0 AS b FROM exs GROUP BY eid), c AS (SELECT quantile_cont(a, 1 / 3.0) AS lo, quantile_cont(a, 2 / 3.0) AS hi FROM t)
SELECT count(*) FILTER (y = 1 AND a >= hi AND b < 0.5) AS only_first, count(*) FILTER (y = 1 AND a <= lo AND b >= 0.5) AS only_second FROM t, c""")
def a46_disagreement(v):
    x = example_scores(v).withColumn("b", (F.col("eid") * 37 % 101) / 101.0)
    cuts = Z.percentiles(x.select("score"), [], "score", [1 / 3, 2 / 3]).select(F.col("p33").alias("lo"), F.col("p67").alias("hi"))
    x = x.crossJoin(F.broadcast(cuts)).where("y = 1")
    return x.agg(F.count_if((F.col("score") >= F.col("hi")) & (F.col("b") < 0.5)).alias("only_first"), F.count_if((F.col("score") <= F.col("lo")) & (F.col("b") >= 0.5)).alias("only_second"))


@query(SQL + """, d AS (SELECT layer, unnest(range(64)) AS i, unnest(x) AS v, vec_id, y FROM acts), w AS (SELECT layer, i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM d GROUP BY 1, 2),
c AS (SELECT a.layer AS p, b.layer AS q, sum(a.w * b.w) / (sqrt(sum(a.w * a.w)) * sqrt(sum(b.w * b.w))) AS c FROM w a JOIN w b ON a.i = b.i AND a.layer <> b.layer GROUP BY 1, 2),
s AS (SELECT d.vec_id, sum(v * w) AS s FROM d JOIN w ON w.i = d.i AND w.layer = 0 GROUP BY d.vec_id)
SELECT round(avg(abs(c)), 6) AS mean_abs, round(avg(c * c), 6) AS mean_sq, count(*) AS n, round((SELECT stddev_pop(s) FROM s), 6) AS projection_std FROM c""")
def a40_direction_overlap(v):
    """Overlap of the layers' directions, and the deviation of all vectors along the first one (A39)."""
    probe = staged(transfer.centroid_probe(v.acts, ["layer"]), "directions")
    overlap = Z.direction_overlap(probe.select(F.col("layer").alias("key"), "w"))
    along = transfer.score_all(v.acts.select("x"), probe.where("layer = 0").select("w")).agg(F.stddev_pop("score").alias("projection_std"))
    return overlap.crossJoin(along).select(*r6("mean_abs", "mean_sq"), "n", *r6("projection_std"))


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value) / greatest(max(user_id), 1), 6) AS per_unit FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def a41_runtime_percentiles(v):
    e = v.table("events")
    p = Z.percentiles(e, ["event_type"], "value", [0.5, 0.95])
    units = e.groupBy("event_type").agg(F.max("user_id").alias("u"))
    return p.join(units, "event_type").select("event_type", *r6("p50", "p95"), F.round(F.col("mean") / F.greatest("u", F.lit(1)), 6).alias("per_unit"))


_CELLS = src("SELECT {'layer': layer, 'variant': vec_id % 3} AS grp, round(x[1 + layer * 5], 9) AS score, y, 1 AS w FROM acts")


def _cells(v):
    score = F.round(F.get("x", (F.col("layer") * 5).cast("int")), 9)
    t = v.acts.select("layer", (F.col("vec_id") % 3).alias("variant"), score.alias("score"), "y")
    return R.roc_auc(t, ["layer", "variant"]).select("layer", "variant", "auc", F.col("n_pos").cast("long").alias("n"))


@query(_CELLS + "SELECT a.grp.variant AS variant, round(avg(a.auc - b.auc), 6) AS delta, count(*) AS n FROM auc a JOIN auc b ON a.grp.layer = b.grp.layer AND b.grp.variant = 0 AND a.grp.variant <> 0 GROUP BY 1")
def a47_paired_cells(v):
    return Z.paired_cells(_cells(v), ["layer"], "variant", 0, "auc").select("variant", *r6("delta"), "n")


@query(_CELLS + ", m AS (SELECT quantile_cont(n_pos, 0.5) AS cut FROM auc) SELECT grp.layer % 2 AS family, round(sum(n_pos * auc) FILTER (n_pos >= 10) / nullif(sum(n_pos) FILTER (n_pos >= 10), 0), 6) AS mean, count(*) FILTER (n_pos < 10) AS left_out FROM auc GROUP BY 1")
def a48_trusted_mean(v):
    return Z.trusted_mean(_cells(v).withColumn("family", F.col("layer") % 2), ["family"], 10).select("family", *r6("mean"), "left_out")


@query(_CELLS + "SELECT variant, layer, auc FROM (SELECT grp.variant AS variant, grp.layer AS layer, round(auc, 6) AS auc, row_number() OVER (PARTITION BY grp.variant ORDER BY auc DESC, grp.layer) AS i FROM auc) WHERE i = 1")
def o3_best_layer(v):
    return Z.best_of(_cells(v), ["variant"], "auc", "layer").select("variant", "layer", *r6("auc"))


@query(SQL + "SELECT vec_id, round(list_sort(x, 'DESC')[1], 6) AS first, round(list_sort(x, 'DESC')[5], 6) AS fifth, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS at FROM acts".replace(" AS at", " AS place"))
def o6_top_logits(v):
    top = F.slice(F.sort_array("x", asc=False), 1, 5)
    return v.acts.select("vec_id", F.round(top[0], 6).alias("first"), F.round(top[4], 6).alias("fifth"), (F.array_position("x", top[0]) - 1).alias("place"))


@query(SQL + "SELECT lang, eid, row_number() OVER (PARTITION BY lang ORDER BY eid) AS place FROM ex QUALIFY place <= 50")
def o8_first_per_language(v):
    return X.ranked(v.ex.select("lang", "eid"), ["lang"], F.col("eid").cast("double"), "eid", "place").where("place <= 50").select("lang", "eid", *longs("place"))


@query(SQL + "SELECT eid, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS place FROM (SELECT eid, round(score, 6) AS score FROM exs)")
def w1_average_ranks(v):
    return Z.average_ranks(example_scores(v).select("eid", *r6("score")), "score", "place").select("eid", "score", "place")


# resampling


def _interval(draws, value="auc"):
    return B.interval(draws, value).select(*r6("mean", "lo", "hi", "above_0"), "excludes_0", "n_draws")


@query()
def a29_row_bootstrap(v):
    return _interval(B.resampled_auc(_probs(v), ["eid"], "prob", "y", N_BOOT, 7))


@query()
def a30_clustered_interval(v):
    return _interval(B.resampled_auc(v.tok_scores.where("is_test"), ["eid"], "logit", "y", N_BOOT, 7))


@query()
def a31_group_bootstrap(v):
    return _interval(B.resampled_auc(example_scores(v), ["grp"], "score", "y", N_BOOT, 7))


@query()
def a32_two_pool_bootstrap(v):
    """Positives and the clean pool are drawn apart; a clean example of a pair is drawn with its positive."""
    mates = v.pairs.select(F.col("safe_eid").alias("eid"), F.col("vuln_eid").alias("mate"))
    x = example_scores(v).join(mates, "eid", "left")
    x = x.withColumn("pool", F.when((F.col("y") == 1) | F.col("mate").isNotNull(), "positive").otherwise("clean")).withColumn("unit", F.coalesce("mate", "eid"))
    return _interval(B.resampled_auc(x, ["pool", "unit"], "score", "y", N_BOOT, 7))


@query()
def a33_paired_interval(v):
    t = v.tok_scores.where("is_test").withColumn("other", F.length("word").cast("double"))
    return _interval(B.paired_auc(t, ["eid"], "logit", "other", "y", N_BOOT, 11), "delta")


@query()
def a34_permutation_null(v):
    x = staged(example_scores(v).select("score", "y"), "examples")
    seen = R.roc_auc(x, []).first()["auc"] or 0.0
    p = B.p_value(B.permutation_null(x, "score", "y", N_BOOT, 7), "auc", seen)
    return p.select(F.round(F.lit(float(seen)), 6).alias("auc"), *r6("p"), "n_draws")


@query()
def a35_random_directions(v):
    """The AUC along random directions, the better side of each."""
    d = B.random_directions(v.spark, 64, 50, 3)
    s = transfer.score_all(v.acts.select("x", "y"), d)
    auc = R.roc_auc(s, ["draw"]).withColumn("auc", F.greatest("auc", 1 - F.col("auc")))
    return auc.agg(F.round(F.avg("auc"), 6).alias("mean"), F.round(F.max("auc"), 6).alias("highest"), F.count("*").alias("n_draws"))


# gates



@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey // 1000 AS shard, CASE WHEN o_orderkey % 701 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 1000, o_totalprice FROM orders WHERE o_orderkey % 997 = 0),
n AS (SELECT id, count(*) AS n FROM o GROUP BY id), k AS (SELECT max(o_orderkey) + 1 AS total FROM orders), s AS (SELECT shard, max(id) - min(id) + 1 - count(DISTINCT id) AS holes FROM o GROUP BY shard)
SELECT 'repeated id' AS rule, count(*) FILTER (n > 1) AS n FROM n UNION ALL SELECT 'missing id', (SELECT total FROM k) - count(*) FROM n UNION ALL SELECT 'shard with holes', count(*) FILTER (holes <> 0) FROM s
UNION ALL SELECT 'value that is no number', count(*) FILTER (v IS NULL) FROM o""")
def s10_merge_gate(v):
    o = v.table("orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 1000).alias("shard"), F.col("o_totalprice").cast("double").alias("v"))
    total = o.agg(F.max("id")).first()[0] + 1
    spoiled = o.withColumn("v", F.when(F.col("id") % 701 != 0, F.col("v"))).unionByName(o.where("id % 997 = 0"))
    return Z.merge_gate(spoiled, "id", ["v"], total)


@query("SELECT o_orderkey AS key, b AS before FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS b FROM orders WHERE o_orderkey % 613 <> 5) WHERE b + 1 <> o_orderkey")
def w10_id_gaps(v):
    return Z.id_gaps(v.table("orders").where("o_orderkey % 613 <> 5"), "o_orderkey", 1000)


@query("""WITH a AS (SELECT event_id AS id, value AS v FROM events WHERE event_id % 401 <> 1), b AS (SELECT event_id AS id, CASE WHEN event_id % 503 = 2 THEN value * 1.5 + 1 ELSE value * 1.0000001 END AS v FROM events WHERE event_id % 607 <> 3)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only in b' WHEN b.id IS NULL THEN 'only in a' ELSE 'differs' END AS why FROM a FULL JOIN b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR NOT coalesce(abs(a.v - b.v) <= 1e-6 + 1e-5 * abs(b.v), a.v IS NULL AND b.v IS NULL)""")
def s12_unequal_rows(v):
    e = v.table("events").select(F.col("event_id").alias("id"), F.col("value").alias("v"))
    other = e.where("id % 607 <> 3").withColumn("v", F.when(F.col("id") % 503 == 2, F.col("v") * 1.5 + 1).otherwise(F.col("v") * 1.0000001))
    return Z.unequal(e.where("id % 401 <> 1"), other, "id", ["v"], 1e-5, 1e-6)


@query(SQL + """, a AS (SELECT lang, eid FROM ex WHERE lang <> 'es'), n AS (SELECT eid, count(*) AS n FROM a GROUP BY eid), c AS (SELECT grp, count(DISTINCT cwe) AS k FROM ex GROUP BY grp)
SELECT (SELECT count(*) FROM n WHERE n > 1) AS in_several, (SELECT count(*) FROM ex WHERE eid NOT IN (SELECT eid FROM a)) AS in_none, (SELECT count(*) FROM c WHERE k > 1) AS groups_of_many""")
def u7_partition_checks(v):
    x = v.ex.select("eid", "lang", "grp", "cwe")
    check = X.partition_check(x.select("eid"), x.where("lang <> 'es'").select("eid", F.col("lang").alias("part")))
    many = x.groupBy("grp").agg(F.countDistinct("cwe").alias("k")).agg(F.count_if(F.col("k") > 1).alias("groups_of_many"))
    return check.crossJoin(many).select("in_several", "in_none", "groups_of_many")


@query(SQL + """, t AS (SELECT lang, round(avg(score), 6) AS auc FROM exs GROUP BY lang) SELECT lang, abs(auc - round(auc, 2)) <= 0.004 AS holds FROM t""")
def a45_reproduction_gate(v):
    t = example_scores(v).groupBy("lang").agg(F.round(F.avg("score"), 6).alias("auc"))
    stored = t.select("lang", F.round("auc", 2).alias("stored"))
    return t.join(stored, "lang").select("lang", (F.abs(F.col("auc") - F.col("stored")) <= 0.004).alias("holds"))


# joins


@query(SQL + "SELECT t.eid, t.tok, round(s.score, 6) AS score FROM tok t JOIN exs s USING (eid)")
def j9_score_to_tokens(v):
    return P.score_to_tokens(v.tok.select("eid", "tok"), example_scores(v).select("eid", "score")).select("eid", "tok", *r6("score"))


@query(SQL + "SELECT a.eid, round(a.score, 6) AS one, round(b.score, 6) AS two FROM member_scores a JOIN member_scores b ON a.eid = b.eid AND a.member = 0 AND b.member = 1 WHERE a.score IS NOT NULL AND b.score IS NOT NULL")
def j10_scored_by_both(v):
    m = v.member_scores
    one, two = (m.where(F.col("member") == i).select("eid", F.col("score").alias(c)) for i, c in enumerate(("one", "two")))
    return P.scored_by_both(one, two, "one", "two").select("eid", *r6("one", "two"))


@query(SQL + """, c AS (SELECT p.eid, n.eid AS fixed, row_number() OVER (PARTITION BY p.eid ORDER BY n.eid) AS i FROM ex p JOIN ex n ON p.grp = n.grp AND p.row_label = 1 AND n.row_label = 0 AND (n.cwe IS NULL OR n.cwe = p.cwe))
SELECT ex.eid, c.fixed FROM ex LEFT JOIN c ON c.eid = ex.eid AND c.i = 1 WHERE ex.row_label = 1""")
def j14_first_counterpart(v):
    x = v.ex.select("eid", "grp", "cwe", "row_label")
    return P.first_counterpart(x.where("row_label = 1"), x.where("row_label = 0")).select("eid", "fixed")


@query(SQL + f""", n AS (SELECT *, row_number() OVER (PARTITION BY lang, grp ORDER BY eid) AS i FROM ex WHERE row_label = 0), g0 AS (SELECT lang, grp, count(*) AS size FROM n GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {hashed('7', 'grp')}, grp) - 1 AS g, count(*) OVER (PARTITION BY lang) AS ring FROM g0),
p AS (SELECT x.eid, x.lang, r.ring, coalesce(g.g, 0) AS g, floor({hashed('7', 'x.eid')} * (r.ring - 1)) AS st FROM ex x JOIN (SELECT lang, max(ring) AS ring FROM g GROUP BY lang) r USING (lang) LEFT JOIN g ON g.lang = x.lang AND g.grp = x.grp WHERE x.row_label = 1 AND r.ring > 1),
k AS (SELECT *, unnest(range(1, CAST(least(3, ring - 1) + 1 AS BIGINT))) AS place FROM p),
c AS (SELECT k.eid, k.place, k.lang, g.grp, floor({hashed('7', 'k.eid', 'k.place')} * g.size) + 1 AS i FROM k JOIN g ON g.lang = k.lang AND g.g = (k.g + 1 + (k.st + k.place) % (k.ring - 1)) % k.ring)
SELECT c.eid, n.eid AS decoy, c.place FROM c JOIN n ON n.lang = c.lang AND n.grp = c.grp AND n.i = c.i""")
def j15_decoys(v):
    x = v.ex.select("eid", "grp", "lang", "row_label")
    return X.decoys(x.where("row_label = 1"), x.where("row_label = 0"), 3, 7).select("eid", "decoy", *longs("place"))


# splits


_SIDES = SQL + f""", ro AS (SELECT *, row_number() OVER (PARTITION BY row_label ORDER BY {hashed('7', 'eid')}, eid) AS i, count(*) OVER (PARTITION BY row_label) AS n FROM ex),
gr AS (SELECT grp, row_number() OVER (ORDER BY {hashed('7', 'grp')}, grp) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM ex)),
hc AS (SELECT cwe AS held, count(*) AS n, min(eid) AS f FROM ex WHERE row_label = 1 AND cwe IS NOT NULL GROUP BY cwe ORDER BY n DESC, f LIMIT 5),
sides AS (SELECT 'random' AS split_name, eid, row_label, CASE WHEN i <= round(n * 0.2) THEN 'test' ELSE 'train' END AS side FROM ro
  UNION ALL SELECT 'group_repo', eid, row_label, CASE WHEN i <= greatest(1, round(0.2 * n)) THEN 'test' ELSE 'train' END FROM ex JOIN gr USING (grp)
  UNION ALL SELECT 'heldout_cwe::' || held, eid, row_label, CASE WHEN cwe IS NOT DISTINCT FROM held THEN 'test' ELSE 'train' END FROM ex, hc
  UNION ALL SELECT 'heldout_lang::' || held, eid, row_label, CASE WHEN lang = held THEN 'test' ELSE 'train' END FROM ex, (SELECT DISTINCT lang AS held FROM ex))
"""


@query(_SIDES + "SELECT split_name, side, count(*) AS n, CAST(sum(row_label) AS BIGINT) AS n_pos, CAST(sum(eid) AS BIGINT) AS ids FROM sides GROUP BY 1, 2")
def x5_all_splits(v):
    return X.all_splits(v.ex, 7, 5).groupBy("split_name", "side").agg(F.count("*").alias("n"), F.sum("row_label").cast("long").alias("n_pos"), F.sum("eid").alias("ids"))


@query(SQL + f""", g AS (SELECT grp, row_number() OVER (ORDER BY {hashed('42', 'grp')}, grp) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM ex)), tr AS (SELECT grp FROM g WHERE i > greatest(1, round(0.2 * n))),
h AS (SELECT grp, row_number() OVER (ORDER BY {hashed('43', 'grp')}, grp) AS i, count(*) OVER () AS n FROM tr)
SELECT eid, CASE WHEN h.grp IS NULL THEN 'test' WHEN h.i <= greatest(1, round(0.15 * h.n)) THEN 'val' ELSE 'train' END AS side FROM ex LEFT JOIN h USING (grp)""")
def x7_validation_carve(v):
    return X.with_validation(v.ex, 42, 0.2, 0.15).select("eid", "side")


@query(SQL + f""", t AS (SELECT eid, tok, y FROM tok_scores), k AS (SELECT least(60000, greatest(25 * count(*) FILTER (y = 1), 2000)) AS cap FROM t),
n AS (SELECT eid, tok, row_number() OVER (ORDER BY {hashed('5', 'eid', 'tok')}, eid, tok) AS i FROM t WHERE y = 0)
SELECT eid, count(*) AS n FROM n, k WHERE i <= cap GROUP BY eid""")
def x10_sampled_negatives(v):
    t = v.tok_scores.select("eid", "tok", "y")
    cap = X.negative_cap(t.agg(F.sum("y")).first()[0] or 0)
    return X.sampled(t.where("y = 0"), cap, 5, ["eid", "tok"]).groupBy("eid").agg(F.count("*").alias("n"))


@query(SQL + "SELECT eid, count(*) AS n, count(*) FILTER (y = 1) AS n_pos FROM tok_scores WHERE is_code OR y = 1 GROUP BY eid")
def x11_masked_negatives(v):
    return X.masked_negatives(v.tok_scores).groupBy("eid").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"))


@query(SQL + f""", p AS (SELECT p.*, x.cwe, row_number() OVER (PARTITION BY x.cwe ORDER BY {hashed('9', 'vuln_eid')}, vuln_eid) AS i FROM pairs p JOIN ex x ON x.eid = vuln_eid)
SELECT cwe, vuln_eid, safe_eid FROM p WHERE i <= 15""")
def x12_pairs_per_class(v):
    p = v.pairs.join(v.ex.select(F.col("eid").alias("vuln_eid"), "cwe"), "vuln_eid")
    return X.ranked(p, ["cwe"], S.uniform_hash(F.lit(9), "vuln_eid"), "vuln_eid", "_i").where("_i <= 15").select("cwe", "vuln_eid", "safe_eid")


# sources


@query("SELECT count(*) AS n, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, CAST(sum(i) AS BIGINT) AS total, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM labels)")
def s1_jsonl_rows(v):
    """Labels written as JSON lines and read back with a number for each line."""
    path = files.written_jsonl(v.table("labels").select("doc_id", "quality"))
    rows = files.numbered_jsonl(v.spark, path, "doc_id long, quality long")
    return rows.agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"), F.sum("row").alias("total"), F.sum("doc_id").alias("ids"))


@query(SQL + "SELECT eid, CASE WHEN eid % 9 = 0 THEN '' ELSE sha1(code) END AS code, CASE WHEN eid % 7 = 0 THEN '' ELSE lang END AS lang FROM ex")
def s2_projected_rows(v):
    code, lang = F.when(F.col("eid") % 9 != 0, F.col("code")), F.when(F.col("eid") % 7 != 0, F.col("lang"))
    path = files.written_jsonl(v.ex.select("eid", code.alias("code"), lang.alias("lang"), "source"))
    rows = files.projected_jsonl(v.spark, path, "eid long", ["code", "lang"])
    return rows.select("eid", F.when(F.col("code") != "", F.sha1("code")).otherwise("").alias("code"), "lang")


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 4 <> 1 ORDER BY doc_id")
def s15_resumed_cells(v):
    """What is asked for and not done yet."""
    asked = v.table("labels").select("doc_id", "quality")
    return files.not_done(asked, asked.where("doc_id % 4 = 1").select("doc_id"), ["doc_id"])


@query(SQL + """, d AS (SELECT layer, unnest(range(64)) AS i, unnest(x) AS v, vec_id, y FROM acts), w AS (SELECT i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM d WHERE layer = 1 GROUP BY 1)
SELECT vec_id, round(1 / (1 + exp(-(sum(v * w) + 0.25))), 6) AS prob FROM d JOIN w USING (i) GROUP BY vec_id""")
def s20_probe_probabilities(v):
    """A probe (w, b, layer) stored as a table of one row, read again and applied to every vector."""
    probe = transfer.centroid_probe(v.acts.where("layer = 1"), ["layer"]).withColumn("b", F.lit(0.25))
    probe = files.stored_probe(probe.select("layer", "w", "b"))
    return transfer.probabilities(v.acts.select("vec_id", "x"), probe).select("vec_id", *r6("prob"))


@query("SELECT event_id, user_id, round(value, 6) AS value FROM events")
def s15_incremental_append(v):
    """Events that come in two deliveries with a part of them in both, appended once each by a stream."""
    e = v.table("events").select("event_id", "user_id", "value")
    source, target, checkpoint = (new_path(v.spark, n) for n in ("deliveries", "appended", "stream"))
    schema = "event_id long, user_id long, value double"
    e = e.selectExpr("cast(event_id as long) as event_id", "cast(user_id as long) as user_id", "cast(value as double) as value")
    for part in (e.where("event_id % 3 <> 0"), e.where("event_id % 3 <> 1")):
        part.coalesce(4).write.mode("append").parquet(source)
        incremental.append_new(v.spark, source, schema, target, checkpoint, ["event_id"])
    return v.spark.read.parquet(target).select("event_id", "user_id", *r6("value"))
