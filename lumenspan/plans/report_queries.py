"""Reports that put several operators together, and queries of fitted probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenspan.functions import scalars as S
from lumenspan.functions import text as T
from lumenspan.operators import diffs
from lumenspan.operators import intervals as I
from lumenspan.operators import labels as L
from lumenspan.operators import learning as M
from lumenspan.operators import lines as N
from lumenspan.operators import ngrams
from lumenspan.operators import pooling as P
from lumenspan.operators import ranking as R
from lumenspan.operators import resampling as B
from lumenspan.operators import retrieval
from lumenspan.operators import splits as X
from lumenspan.operators import statistics as Z
from lumenspan.operators import transfer
from lumenspan.plans.fixtures import SQL
from lumenspan.plans.metric_queries import _SIDES, BUNDLE, N_BOOT, example_scores
from lumenspan.plans.oracle import ROC, TOKENS, hashed, src
from lumenspan.plans.registry import longs, query, r6
from lumenspan.sources import files
from lumenspan.store import new_path, staged

# baselines and fitted probes


_BASE = _SIDES + f""", bl AS (SELECT eid, row_label, b, CASE b WHEN 'random' THEN {hashed('7', 'eid')} WHEN 'length' THEN length(code) * 1.0 ELSE 1 - exp(-({" + ".join("len(regexp_extract_all(code, '" + p.replace("'", "''") + "'))" for p in T.RISKY_PATTERNS.values())})) END AS s
  FROM ex, (SELECT unnest(['random', 'length', 'regex']) AS b)),
src AS (SELECT {{'split_name': split_name, 'baseline': b}} AS grp, s AS score, bl.row_label AS y, 1 AS w FROM sides JOIN bl USING (eid) WHERE side = 'test')""" + ROC


@query(_BASE + "SELECT grp.split_name AS split_name, grp.baseline AS baseline, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def l9_baselines(v):
    return M.baseline_aucs(v.ex, X.all_splits(v.ex, 7, 5)).select("split_name", "baseline", *r6("auc"), *longs("n_pos", "n_neg"))


def _labelled_vectors(v):
    """Vectors of labelled examples: the vector with the example's id, where there is one."""
    a = v.table("embeddings").select(F.col("vec_id").alias("eid"), F.col("embedding").cast("array<double>").alias("x"))
    return a.join(v.ex.select("eid", F.col("row_label").alias("y")), "eid")


@query()
def l1_refit_per_split(v):
    """A logistic regression per split, its AUC and calibration on the test side (C1 without the baselines)."""
    acts = staged(_labelled_vectors(v), "labelled-vectors")
    x = v.ex.join(acts.select("eid"), "eid", "left_semi")
    scored = M.scored_splits(acts, X.all_splits(x, 7, 5))
    return R.level_bundle(scored, ["split_name"]).select("split_name", *r6(*BUNDLE), *longs("n_total", "n_pos"))


@query()
def c1_sample_report(v):
    """Per split: the refitted probe's metrics, its bootstrap interval on all test rows, and the baselines' AUCs."""
    acts = staged(_labelled_vectors(v), "labelled-vectors")
    x = v.ex.join(acts.select("eid"), "eid", "left_semi")
    sides = staged(X.all_splits(x, 7, 5), "sides")
    scored = staged(M.scored_splits(acts, sides), "scored")
    bundle = R.level_bundle(scored, ["split_name"])
    ci = B.interval(B.resampled_auc(scored, ["eid"], "prob", "y", N_BOOT, 7)).select(F.col("lo").alias("all_lo"), F.col("hi").alias("all_hi"))
    names = list(M.BASELINES)
    base = M.baseline_aucs(x, sides).groupBy("split_name").pivot("baseline", names).agg(F.first("auc"))
    best = R.best_threshold(R.cumulative(R.score_counts(scored, ["split_name"], "prob", "y"), ["split_name"]), ["split_name"], "accuracy")
    best = best.select("split_name", F.col("threshold").alias("best_threshold"), F.col("accuracy").alias("best_accuracy"))
    out = bundle.join(base, "split_name", "left").join(best, "split_name").crossJoin(ci)
    return out.select("split_name", *r6(*BUNDLE, *names, "best_threshold", "best_accuracy", "all_lo", "all_hi"), *longs("n_total", "n_pos"))


@query(src("""SELECT layer AS grp, score, y, 1 AS w FROM (WITH d AS (SELECT vec_id, layer, y, unnest(range(64)) AS i, unnest(x) AS v FROM acts), wv AS (SELECT layer, i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM d WHERE vec_id % 5 <> 0 GROUP BY 1, 2)
SELECT layer, vec_id, any_value(y) AS y, round(sum(v * w), 9) AS score FROM d JOIN wv USING (layer, i) WHERE vec_id % 5 = 0 GROUP BY 1, 2)""") + "SELECT grp AS layer, round(auc, 6) AS auc, n_pos, n_neg, row_number() OVER (ORDER BY round(auc, 9) DESC, grp) = 1 AS best FROM auc")
def l7_layer_sweep(v):
    """A probe per layer on the training vectors, its AUC on the others, and the best layer."""
    a = v.acts
    probes = transfer.centroid_probe(a.where("vec_id % 5 <> 0"), ["layer"])
    scored = a.where("vec_id % 5 = 0").join(F.broadcast(probes), "layer").select("layer", F.round(S.dot(F.col("x"), F.col("w")), 9).alias("score"), "y")
    auc = staged(R.roc_auc(scored, ["layer"]), "layers").withColumn("rounded", F.round("auc", 9))
    best = Z.best_of(auc.withColumn("all", F.lit(1)), ["all"], "rounded", "layer").select("layer", F.lit(True).alias("best"))
    return auc.join(best, "layer", "left").select("layer", *r6("auc"), *longs("n_pos", "n_neg"), F.coalesce("best", F.lit(False)).alias("best"))


@query()
def l2_span_max_probe(v):
    """A token probe fitted with the span-max loss; AUC over tokens and over examples' highest tokens."""
    word = F.col("word")
    x = F.array(F.length(word) / 10.0, 1.0 - word.rlike("^[a-z]+$").cast("double"), 1.0 / (1 + F.col("tok")))
    t = staged(v.tok_scores.select("eid", x.alias("x"), "y", "is_test", "row_label"), "token-features")
    w, b, losses = M.fit_span_max(t.where("not is_test"), 3, epochs=20, rate=1.0)
    t = t.where("is_test").withColumn("score", M.linear(F.col("x"), (w, b)))
    tokens = R.roc_auc(t, []).select(F.lit("tokens").alias("level"), "auc")
    top = R.roc_auc(t.groupBy("eid").agg(F.max("score").alias("score"), F.max("row_label").alias("y")), []).select(F.lit("examples").alias("level"), "auc")
    return tokens.unionByName(top).select("level", *r6("auc"), F.round(F.lit(float(losses[-1])), 6).alias("last_loss"))


@query()
def l8_surface_model(v):
    """Word TF-IDF on training texts, hashed to fixed vectors, with a logistic regression; AUC on the test side."""
    x = staged(X.random_split(v.ex.select("eid", "code", "row_label"), 7), "sides")
    grams = ngrams.word_ngrams(x.select(F.col("eid").alias("doc_id"), F.col("code").alias("text")), 1)
    train = x.where("side = 'train'").select(F.col("eid").alias("doc_id"))
    weights = ngrams.tfidf(grams, train.count(), 2, 2000, fit_on=train)
    vectors = ngrams.hashed_vectors(weights, 128)
    rows = staged(vectors.join(x.select(F.col("eid").alias("doc_id"), "side", F.col("row_label").alias("y")), "doc_id"), "surface")
    model = M.fit_logistic(rows.where("side = 'train'"))
    if model is None:
        return rows.limit(0).select(F.lit(None).cast("double").alias("auc"), F.lit(0).alias("n_pos"), F.lit(0).alias("n_neg"))
    scored = rows.where("side = 'test'").withColumn("score", M.linear(F.col("x"), model))
    return R.roc_auc(scored, []).select(*r6("auc"), *longs("n_pos", "n_neg"))


@query()
def l5_learned_combiner(v):
    """Members combined by their maximum, their mean, and a regression fitted on the validation examples."""
    m = v.member_scores.groupBy("eid").agg(*[F.max(F.when(F.col("member") == i, F.col("score"))).alias(f"s{i}") for i in range(3)])
    m = m.dropna().join(v.ex.select("eid", F.col("row_label").alias("y")), "eid")
    m = staged(m.withColumn("x", F.array("s0", "s1", "s2")), "members")
    model = M.fit_logistic(m.where("eid % 3 = 0"))
    ways = {"max": F.array_max("x"), "mean": F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / 3}
    if model is not None:
        ways["learned"] = M.linear(F.col("x"), model)
    rows = m.where("eid % 3 <> 0").select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("how"), c.alias("score")) for k, c in ways.items()])).alias("r"))
    return R.roc_auc(rows.select("y", "r.*"), ["how"]).select("how", *r6("auc"), *longs("n_pos", "n_neg"))


@query()
def c16_calibration(v):
    """Platt's parameters on the training examples; Brier, ECE and flip rate of the test examples before and after."""
    x = staged(example_scores(v).select("eid", "y", "score"), "examples")
    a, t = M.fit_platt(x.where("eid % 5 <> 0"), "score", "y")
    test = x.where("eid % 5 = 0").select("y", S.sigmoid(F.col("score")).alias("before"), S.platt(F.col("score"), a, t).alias("after"))
    both = [R.calibration(test.withColumn("prob", F.col(c)), [], bins=10, closed=True).withColumn("stage", F.lit(c)) for c in ("before", "after")]
    flips = Z.flip_rate(test, [], "before", "after")
    out = both[0].unionByName(both[1]).crossJoin(flips)
    return out.select("stage", *r6("brier", "ece"), F.round(F.when(F.col("stage") == "before", F.col("below_before")).otherwise(F.col("below_after")), 6).alias("below"), F.round(F.lit(a), 4).alias("a"), F.round(F.lit(t), 4).alias("t"))


# live code and token contrasts


@query(TOKENS.replace("SELECT lang AS grp", "SELECT lang AS grp") + """, c AS (SELECT lang, count(*) AS n_total, count(*) FILTER (is_code) AS n_total_code, count(*) FILTER (is_code AND y = 1) AS n_pos_code FROM tok_scores GROUP BY lang)
SELECT lang, round(auc, 6) AS tokens_auc, round(1 - n_total_code * 1.0 / n_total, 6) AS dropped_fraction, n_pos_code, n_total_code FROM auc JOIN c ON c.lang = auc.grp""")
def a42_contrast_bundle(v):
    t = v.tok_scores
    n = t.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("is_code").alias("n_total_code"), F.count_if(F.col("is_code") & (F.col("y") == 1)).alias("n_pos_code"))
    dropped = F.round(1 - F.col("n_total_code") / F.col("n"), 6).alias("dropped_fraction")
    return R.roc_auc(t, ["lang"], "logit").join(n, "lang").select("lang", F.round("auc", 6).alias("tokens_auc"), dropped, "n_pos_code", "n_total_code")


# leads


_LEADS = SQL + """, ld AS (SELECT *, 'CWE-' || (CASE WHEN lead_id % 3 = 0 THEN 'en' ELSE 'de' END) AS lead_cwe, row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(rank, 1000000000), lead_id) AS pos FROM leads),
h0 AS (SELECT l.repo_id, l.pos, l.lead_cwe, t.trace_id, t.cwe FROM ld l JOIN traces t ON l.repo_id = t.repo_id AND l.file = t.file AND l.start_line <= t.end_line AND l.end_line >= t.start_line),
f AS (SELECT repo_id, pos, any_value(lead_cwe) = arg_min(cwe, trace_id) AS same FROM h0 WHERE cwe IS NOT NULL GROUP BY repo_id, pos)
"""


@query(_LEADS + "SELECT repo_id, " + ", ".join(f"round(avg(CASE WHEN same THEN 1.0 ELSE 0 END) FILTER (pos <= {k}), 6) AS cwe_at_{k}" for k in (1, 5, 10, 25)) + " FROM f GROUP BY repo_id")
def a25_class_on_hits(v):
    """Of the first k leads that hit a trace with a class, the share that names the class of the first such trace."""
    lead_cwe = F.concat(F.lit("CWE-"), F.when(F.col("lead_id") % 3 == 0, "en").otherwise("de"))
    return retrieval.class_on_hits(v.leads.withColumn("lead_cwe", lead_cwe), v.traces, [1, 5, 10, 25]).select("repo_id", *r6(*[f"cwe_at_{k}" for k in (1, 5, 10, 25)]))


@query(_LEADS + """, rp AS (SELECT repo_id, count(*) AS nt FROM traces GROUP BY 1), g AS (SELECT rp.repo_id, coalesce(1.0 / min(pos), 0) AS rr, """
    + ", ".join(f"CASE WHEN count(*) FILTER (pos <= {k}) > 0 THEN 1.0 ELSE 0 END AS hit_at_{k}, count(DISTINCT CASE WHEN pos <= {k} THEN trace_id END) * 1.0 / any_value(nt) AS trace_recall_at_{k}" for k in (1, 5, 10, 25))
    + " FROM rp LEFT JOIN h0 USING (repo_id) GROUP BY rp.repo_id), c AS (SELECT repo_id, " + ", ".join(f"avg(CASE WHEN same THEN 1.0 ELSE 0 END) FILTER (pos <= {k}) AS cwe_at_{k}" for k in (1, 5, 10, 25)) + " FROM f GROUP BY repo_id)"
    + " SELECT count(*) AS n_repos, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg(hit_at_{k}), 6) AS hit_at_{k}, round(avg(trace_recall_at_{k}), 6) AS trace_recall_at_{k}, round(avg(cwe_at_{k}), 6) AS cwe_at_{k}" for k in (1, 5, 10, 25)) + " FROM g LEFT JOIN c USING (repo_id)")
def c15_repo_report(v):
    """Means over the repositories; a class accuracy that no lead defines is left out of its mean."""
    ks = [1, 5, 10, 25]
    leads = v.leads.withColumn("lead_cwe", F.concat(F.lit("CWE-"), F.when(F.col("lead_id") % 3 == 0, "en").otherwise("de")))
    m = retrieval.retrieval_metrics(leads, v.traces, ks).join(retrieval.class_on_hits(leads, v.traces, ks), "repo_id", "left")
    names = [f"{n}_at_{k}" for k in ks for n in ("hit", "trace_recall", "cwe")]
    return m.agg(F.count("*").alias("n_repos"), F.round(F.avg("rr"), 6).alias("mrr"), *[F.round(F.avg(F.col(n).cast("double")), 6).alias(n) for n in names])


# diffs


@query()
def f14_diff_spans(v):
    """Characters of the vulnerable text that its fix replaces or deletes, per pair."""
    x = v.ex.select("eid", "code")
    p = v.pairs.join(x.select(F.col("eid").alias("vuln_eid"), F.col("code").alias("before")), "vuln_eid")
    p = p.join(x.select(F.col("eid").alias("safe_eid"), F.col("code").alias("after")), "safe_eid")
    d = diffs.diff_spans(p.select("vuln_eid", "before", "after"), "vuln_eid")
    return d.select("vuln_eid", F.size("spans").cast("long").alias("n"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["e"] - s["s"]).alias("chars"), "how")


@query()
def c6_relabelled_auc(v):
    """Token AUC under label schemes: the given one, tight spans of the diff, and these on live lines only."""
    x = v.ex.select("eid", "code")
    p = v.pairs.join(x.select(F.col("eid").alias("vuln_eid"), F.col("code").alias("before")), "vuln_eid")
    p = p.join(x.select(F.col("eid").alias("safe_eid"), F.col("code").alias("after")), "safe_eid")
    spans = diffs.diff_spans(p.select("vuln_eid", "before", "after"), "vuln_eid").select(F.col("vuln_eid").alias("eid"), F.explode("spans").alias("r")).select("eid", "r.s", "r.e")
    t = v.tok_scores.join(spans.select("eid").distinct(), "eid", "left_semi").select("eid", "tok", "word", "cs", "ce", "logit", F.col("y").alias("given"))
    t = I.label_tokens(t, spans).withColumnRenamed("y", "tight")
    t = staged(N.live_mask(t, N.live_ranges(x)), "relabelled")
    schemes = {"given": F.col("given"), "tight": F.col("tight"), "tight_live": F.when(F.col("is_live"), F.col("tight"))}
    rows = t.select("logit", F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), c.alias("y")) for k, c in schemes.items()])).alias("r")).select("logit", "r.*")
    return R.roc_auc(rows, ["scheme"], "logit").select("scheme", *r6("auc"), *longs("n_pos", "n_neg"))


# studies


@query(src("SELECT lang AS grp, logit AS score, y, 1 AS w FROM tok_scores") + """, m AS (SELECT t.lang, t.eid, sum(CASE WHEN TRUE THEN 0 END) AS z FROM tok_scores t GROUP BY 1, 2), k AS (SELECT lang, count(DISTINCT eid) AS n_examples, count(*) AS n_tokens, sum(y) AS n_pos_tokens FROM tok_scores GROUP BY lang)
SELECT k.lang, n_examples, n_tokens, round(auc, 6) AS auc, CAST(n_pos_tokens AS BIGINT) AS n_pos_tokens, round(n_pos_tokens * 1.0 / n_tokens, 6) AS share FROM auc JOIN k ON k.lang = auc.grp""")
def c7_language_report(v):
    t = v.tok_scores
    k = t.groupBy("lang").agg(F.countDistinct("eid").alias("n_examples"), F.count("*").alias("n_tokens"), F.sum("y").cast("long").alias("n_pos_tokens"))
    share = F.round(F.col("n_pos_tokens") / F.col("n_tokens"), 6).alias("share")
    return R.roc_auc(t, ["lang"], "logit").join(k, "lang").select("lang", "n_examples", "n_tokens", *r6("auc"), "n_pos_tokens", share)


@query()
def c8_transfer_matrix(v):
    """Every class's probe on every class (cells with intervals on the diagonal's family means come from A32)."""
    a = staged(v.acts.select("vec_id", "x", "label"), "vectors")
    probes = transfer.rest_probes(a, "label")
    scored = transfer.score_all(a, probes.withColumnRenamed("label", "train"))
    cells = R.class_auc(scored.withColumn("y", (F.col("label") != 9).cast("int")).withColumn("test", F.when(F.col("label") != 9, F.col("label"))), "test", ["train"])
    return cells.select(*longs("train", "test"), *r6("auc"), *longs("n_pos", "n_neg"))


@query()
def c9_regimes(v):
    """The same positives against each pool of negatives, with the language's own AUC and a two-pool interval."""
    x = staged(example_scores(v), "examples")
    pos, neg = x.where("y = 1"), x.where("y = 0")
    matched = neg.join(v.pairs.select(F.col("safe_eid").alias("eid")), "eid", "left_semi")
    out = None
    for name, pool in {"all_clean": neg, "english_only": neg.where("lang = 'en'"), "matched": matched}.items():
        rows = pos.unionByName(pool).withColumn("null", F.col("lang").isin("de", "fr").cast("double"))
        auc = R.roc_auc(rows, []).select(F.lit(name).alias("pool"), "auc", "n_pos", "n_neg")
        null = R.roc_auc(rows, [], "null").select(F.col("auc").alias("language_auc"))
        ci = B.interval(B.resampled_auc(rows, ["y", "eid"], "score", "y", N_BOOT, 7)).select("lo", "hi")
        one = auc.crossJoin(null).crossJoin(ci)
        out = one if out is None else out.unionByName(one)
    return out.select("pool", *r6("auc", "language_auc", "lo", "hi"), *longs("n_pos", "n_neg"))


@query(SQL + """, t AS (SELECT eid, row_label, tok, cs, ce, logit FROM tok_scores WHERE y = 0 AND logit >= 3.5), o AS (SELECT *, max(ce) OVER (PARTITION BY eid ORDER BY cs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR cs > reach + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY eid ORDER BY cs ROWS UNBOUNDED PRECEDING) AS i FROM o),
m AS (SELECT eid, i, min(cs) AS s, max(ce) AS e, count(*) AS members, any_value(row_label) AS row_label FROM g GROUP BY eid, i),
d AS (SELECT m.eid, m.s, m.e, m.members, m.row_label, (SELECT min(greatest(0, k.s - m.e, m.s - k.e)) FROM spans k WHERE k.key = 'sink' AND k.eid = m.eid) AS d FROM m)
SELECT CASE WHEN row_label = 0 THEN 'safe_alarm' WHEN d <= 40 THEN 'spread' ELSE 'misplaced' END AS kind, count(*) AS n_spans, CAST(sum(members) AS BIGINT) AS n_tokens, CAST(sum(e - s) AS BIGINT) AS chars FROM d GROUP BY 1""")
def c11_false_alarm_spans(v):
    """False alarms merged over gaps of two characters, then told apart by the nearest true span."""
    t = v.tok_scores.where("y = 0 and logit >= 3.5").select("eid", F.col("cs").alias("s"), F.col("ce").alias("e"))
    m = I.merge_spans(t, ["eid"], gap=2).select("eid", "s", "e", "members")
    m = I.nearest_distance(m, v.spans.where("key = 'sink'").select("eid", "s", "e")).join(v.ex.select("eid", "row_label"), "eid")
    kind = F.when(F.col("row_label") == 0, "safe_alarm").when(F.col("distance") <= 40, "spread").otherwise("misplaced")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_spans"), F.sum("members").alias("n_tokens"), F.sum(F.col("e") - F.col("s")).cast("long").alias("chars"))


@query()
def c12_operating_point(v):
    """TPR at a false-positive rate, and its interval over groups by a resampled AUC of the region's scores."""
    t = staged(example_scores(v), "examples")
    roc = staged(R.cumulative(R.score_counts(t, [], "score", "y"), []), "roc")
    point = R.tpr_at_fpr(roc, [], 0.05)
    ci = B.interval(B.resampled_auc(t, ["grp"], "score", "y", N_BOOT, 7)).select(F.col("lo").alias("auc_lo"), F.col("hi").alias("auc_hi"))
    return point.crossJoin(ci).select(*r6("tpr", "tpr_discrete", "auc_lo", "auc_hi"))


@query(SQL + """, l AS (SELECT eid, s, e FROM spans WHERE key = 'evidence'), q AS (SELECT p.grp, p.rn, p.vuln_eid, EXISTS (SELECT 1 FROM spans a JOIN l ON a.eid = l.eid AND a.s < l.e AND a.e > l.s WHERE a.key = 'sink' AND a.eid = p.vuln_eid) AS sub FROM pairs p)
SELECT split_part(grp, '::', 2) AS lang, count(*) AS n_pairs, count(*) FILTER (sub) AS n_subtractive FROM q GROUP BY 1""")
def c13_subtractive_pairs(v):
    s = v.spans
    meets = I.meets(s.where("key = 'sink'").select("eid", "s", "e"), s.where("key = 'evidence'").select("eid", "s", "e")).select(F.col("eid").alias("vuln_eid"), F.lit(True).alias("sub"))
    q = v.pairs.join(meets, "vuln_eid", "left")
    return q.groupBy(F.split("grp", "::")[1].alias("lang")).agg(F.count("*").alias("n_pairs"), F.count_if(F.coalesce("sub", F.lit(False))).alias("n_subtractive"))


@query(src("""SELECT how AS grp, score, y, 1 AS w FROM (SELECT m.eid, h.how, CASE h.how WHEN 'max' THEN max(score) WHEN 'mean' THEN round(avg(score), 9) ELSE max(score) FILTER (member = 0) END AS score, any_value(ex.row_label) AS y
FROM member_scores m JOIN ex USING (eid), (SELECT unnest(['max', 'mean', 'first']) AS how) h WHERE m.score IS NOT NULL GROUP BY m.eid, h.how HAVING count(*) = 3)""") + "SELECT grp AS how, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def c14_ensemble_matrix(v):
    """Members combined in several ways, on the examples that all of them scored."""
    m = v.member_scores.where("score is not null").groupBy("eid").agg(
        F.max("score").alias("max"), F.round(F.avg("score"), 9).alias("mean"), F.max(F.when(F.col("member") == 0, F.col("score"))).alias("first"), F.count("*").alias("n")
    )
    m = m.where("n = 3").join(v.ex.select("eid", F.col("row_label").alias("y")), "eid")
    rows = m.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("how"), F.col(k).alias("score")) for k in ("max", "mean", "first")])).alias("r"))
    return R.roc_auc(rows.select("y", "r.*"), ["how"]).select("how", *r6("auc"), *longs("n_pos", "n_neg"))


@query()
def c17_nulls(v):
    """A fitted probe's AUC on held-out vectors beside a permutation null and random directions."""
    a = staged(v.acts.where("layer = 0").select("vec_id", "x", "y"), "vectors")
    model = M.fit_logistic(a.where("vec_id % 3 <> 0"))
    test = staged(a.where("vec_id % 3 = 0").select("x", "y", (M.linear(F.col("x"), model) if model else F.lit(0.0)).alias("score")), "test")
    seen = R.roc_auc(test, []).first()["auc"] or 0.0
    p = B.p_value(B.permutation_null(test, "score", "y", N_BOOT, 3), "auc", seen)
    d = R.roc_auc(transfer.score_all(test.select("x", "y"), B.random_directions(v.spark, 64, 20, 5)), ["draw"]).agg(F.max(F.greatest("auc", 1 - F.col("auc"))).alias("best_random"))
    return p.crossJoin(d).select(F.round(F.lit(float(seen)), 6).alias("auc"), *r6("p", "best_random"), "n_draws")


@query(src("""SELECT read AS grp, CASE read WHEN 'max' THEN mx WHEN 'mean' THEN round(mn, 9) WHEN 'top_10' THEN round(tp, 9) ELSE ls END AS score, y, 1 AS w FROM (
  SELECT eid, max(logit) AS mx, avg(logit) AS mn, avg(logit) FILTER (r <= 10) AS tp, arg_max(logit, tok) AS ls, any_value(row_label) AS y FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY logit DESC, tok) AS r FROM tok_scores) GROUP BY eid),
  (SELECT unnest(['max', 'mean', 'top_10', 'last']) AS read)""") + "SELECT grp AS read, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def c18_reads(v):
    """AUC of the examples by each way of reading their tokens."""
    t = v.tok_scores
    reads = t.groupBy("eid").agg(F.max("logit").alias("max"), F.round(F.avg("logit"), 9).alias("mean"), F.max_by("logit", "tok").alias("last"), F.first("row_label").alias("y"))
    reads = reads.join(P.other_reads(t, 10).select("eid", F.round("top_10", 9).alias("top_10")), "eid")
    rows = reads.select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("read"), F.col(k).alias("score")) for k in ("max", "mean", "top_10", "last")])).alias("r"))
    return R.roc_auc(rows.select("y", "r.*"), ["read"]).select("read", *r6("auc"), *longs("n_pos", "n_neg"))


@query(SQL + "SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents UNION ALL SELECT page_id, NULL FROM pages)".replace("doc_id, lang FROM (", "doc_id, coalesce(lang, 'page') AS lang FROM ("))
def u5_concatenated(v):
    """Two tables with different columns, one after the other."""
    both = v.table("documents").select("doc_id", "lang").unionByName(v.table("pages").select(F.col("page_id").alias("doc_id")), allowMissingColumns=True)
    return both.select("doc_id", F.coalesce("lang", F.lit("page")).alias("lang"))


@query(src("SELECT split_part(grp, '::', 2) AS grp, score, y, 1 AS w FROM exs JOIN (SELECT eid, grp FROM ex) USING (eid)") + """, r AS (SELECT 'heldout_lang::' || grp AS split_name, round(auc, 9) AS auc FROM auc UNION ALL SELECT 'random', 0.0)
SELECT split_name, round(auc, 6) AS auc FROM r WHERE split_name LIKE 'heldout_lang%' ORDER BY auc, split_name LIMIT 1""")
def o4_worst_split(v):
    x = example_scores(v).withColumn("split_name", F.concat(F.lit("heldout_lang::"), "lang"))
    a = R.roc_auc(x, ["split_name"]).select("split_name", F.round("auc", 9).alias("auc"))
    a = a.unionByName(v.spark.range(1).select(F.lit("random").alias("split_name"), F.lit(0.0).alias("auc")))
    return Z.worst_split(a, ["heldout_lang", "heldout_cwe"], "auc").select("split_name", *r6("auc"))


@query(SQL + """, t AS (SELECT layer AS alpha, vec_id % 3 AS arm, avg(x[1]) AS p FROM acts GROUP BY 1, 2), e AS (SELECT arm, arg_max(p, alpha) FILTER (alpha < 3) AS p_end, arg_min(p, alpha) AS p_start FROM t GROUP BY arm),
d AS (SELECT max(p_end - p_start) FILTER (arm = 0) AS memory, max(p_end - p_start) FILTER (arm = 1) AS negative, max(p_end - p_start) FILTER (arm = 2) AS random FROM e)
SELECT round(memory, 6) AS memory, round(memory - negative, 6) AS over_negative, round(memory - random, 6) AS over_random, CASE WHEN memory <= 0 THEN 'no effect' WHEN memory > negative AND memory > random THEN 'specific' ELSE 'unspecific' END AS verdict FROM d""")
def a44_steering_verdict(v):
    """Endpoint change of each arm at the largest strength that still works, against the two control arms."""
    t = v.acts.groupBy(F.col("layer").alias("alpha"), (F.col("vec_id") % 3).alias("arm")).agg(F.avg(F.get("x", F.lit(0))).alias("p"))
    return Z.steering_verdict(t.withColumn("degraded", F.col("alpha") >= 3)).select(*r6("memory", "over_negative", "over_random"), "verdict")


@query(SQL + """, p AS (SELECT repo_id, file, count(*) AS n_traces, min(start_line) AS first_line, max(end_line) AS last_line FROM traces GROUP BY 1, 2)
SELECT repo_id, count(*) AS n_files, CAST(sum(n_traces) AS BIGINT) AS n_traces, min(first_line) AS first_line, max(last_line) AS last_line FROM p GROUP BY 1""")
def s14_repo_manifest(v):
    """Files and traces of every repository, nested as a manifest holds them."""
    m = retrieval.manifest(v.traces)
    return m.select(
        "repo_id",
        F.size("files").cast("long").alias("n_files"),
        F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.size(f["traces"])).alias("n_traces"),
        F.array_min(F.flatten(F.transform("files", lambda f: F.transform(f["traces"], lambda t: t["start_line"])))).alias("first_line"),
        F.array_max(F.flatten(F.transform("files", lambda f: F.transform(f["traces"], lambda t: t["end_line"])))).alias("last_line"),
    )


@query(SQL + """, w AS (SELECT eid, tok, cs, ce, code FROM (SELECT t.*, x.code AS code2 FROM tok t JOIN ex x USING (eid)) JOIN (SELECT eid, code FROM ex) USING (eid))
SELECT eid, tok, md5(substr(code, CAST(greatest(0, cs - 48) + 1 AS BIGINT), CAST(ce + 48 - greatest(0, cs - 48) AS BIGINT))) AS context FROM w""")
def p9_all_contexts(v):
    """The surroundings of every token, as a digest."""
    c = L.pieces(v.ex.select("eid", "code"), v.tok.select("eid", F.col("tok").alias("key"), (F.col("cs") - 48).alias("s"), (F.col("ce") + 48).alias("e")))
    return c.select("eid", F.col("key").alias("tok"), F.md5("piece").alias("context"))




@query(src("""SELECT layer AS grp, score, y, 1 AS w FROM (WITH d AS (SELECT vec_id, layer, y, unnest(range(64)) AS i, unnest(x) AS v FROM acts), wv AS (SELECT layer, i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM d WHERE (vec_id // 12) % 5 <> 0 GROUP BY 1, 2),
t AS (SELECT layer, vec_id, any_value(y) AS y, round(sum(v * w), 9) AS score FROM d JOIN wv USING (layer, i) WHERE (vec_id // 12) % 5 = 0 GROUP BY 1, 2) SELECT layer, vec_id // 12 AS eid, max(y) AS y, max(score) AS score FROM t GROUP BY 1, 2)""")
    + "SELECT grp AS layer, round(auc, 6) AS auc, n_pos, n_neg, row_number() OVER (ORDER BY round(coalesce(auc, -1), 9) DESC, grp) = 1 AS best FROM auc")
def c4_cross_model(v):
    """A probe per layer fitted on the training groups; examples' highest scores on the others; the best layer."""
    a = v.acts.withColumn("eid", F.floor(F.col("vec_id") / 12))
    probes = transfer.centroid_probe(a.where("eid % 5 <> 0"), ["layer"])
    scored = a.where("eid % 5 = 0").join(F.broadcast(probes), "layer").withColumn("score", F.round(S.dot(F.col("x"), F.col("w")), 9))
    top = scored.groupBy("layer", "eid").agg(F.max("score").alias("score"), F.max("y").alias("y"))
    auc = staged(R.roc_auc(top, ["layer"]), "layers").withColumn("rounded", F.round("auc", 9))
    best = Z.best_of(auc.withColumn("all", F.lit(1)), ["all"], "rounded", "layer").select("layer", F.lit(True).alias("best"))
    return auc.join(best, "layer", "left").select("layer", *r6("auc"), *longs("n_pos", "n_neg"), F.coalesce("best", F.lit(False)).alias("best"))


@query(src("SELECT {'lang': lang, 'level': level} AS grp, round(logit, 9) AS score, y, 1 AS w FROM (SELECT lang, 'all' AS level, logit, y FROM tok_scores UNION ALL SELECT lang, 'live', logit, y FROM tok_scores WHERE is_code UNION ALL SELECT any_value(lang), 'examples', max(logit), max(y) FROM tok_scores GROUP BY eid)") + "SELECT grp.lang AS lang, grp.level AS level, round(auc, 6) AS auc, n_pos, n_neg FROM auc")
def c5_logit_dump(v):
    """Token logits dumped by language; AUCs over all tokens, live ones, and examples' highest, from the dump."""
    path = new_path(v.spark, "logits")
    files.write_dump(v.tok_scores.select("eid", "tok", "logit", "y", "is_code", "lang"), path, ["lang"])
    t = v.spark.read.parquet(path).withColumn("logit", F.round("logit", 9))
    level = lambda df, name: df.select("lang", F.lit(name).alias("level"), "logit", "y")
    top = t.groupBy("eid").agg(F.first("lang").alias("lang"), F.max("logit").alias("logit"), F.max("y").alias("y"))
    rows = level(t, "all").unionByName(level(t.where("is_code"), "live")).unionByName(level(top, "examples"))
    return R.roc_auc(rows, ["lang", "level"], "logit").select("lang", "level", *r6("auc"), *longs("n_pos", "n_neg"))


@query()
def c10_surface_designs(v):
    """Regressions on surface features only, one per design, with a group-wise interval over the test side."""
    text = F.col("code")
    designs = {
        "length": [F.log1p(F.length(text).cast("double"))],
        "lexicon": [F.log1p(T.count_of(text, T.lexicon_pattern(w)).cast("double")) for w in T.LEXICON.values()],
        "marks": [F.regexp_count(text, F.lit(p)) / (1.0 + F.length(text)) for p in (r"[.,;]", r"[A-Z]", r"[#*$%&|<>]", r"[0-9]")],
        "language": [(F.col("lang") == c).cast("double") for c in ("de", "en", "es", "fr")],
    }
    x = X.group_split(v.ex.select("eid", "code", "lang", "row_label", "grp"), 42)
    x = staged(x.select("eid", "grp", "side", F.col("row_label").alias("y"), *[F.array(*c).alias(f"x_{n}") for n, c in designs.items()]), "designs")
    out = None
    for name in designs:
        rows = x.select("eid", "grp", "side", "y", F.col(f"x_{name}").alias("x"))
        model = M.fit_logistic(rows.where("side = 'train'"))
        if model is None:
            continue
        test = rows.where("side = 'test'").withColumn("score", M.linear(F.col("x"), model))
        ci = B.interval(B.resampled_auc(test, ["eid"], "score", "y", N_BOOT, 7)).select("lo", "hi")
        one = R.roc_auc(test, []).crossJoin(ci).select(F.lit(name).alias("design"), *r6("auc", "lo", "hi"), *longs("n_pos", "n_neg"))
        out = one if out is None else out.unionByName(one)
    return v.spark.createDataFrame([], "design string, auc double, lo double, hi double, n_pos long, n_neg long") if out is None else out


@query(SQL + """, p AS (SELECT split_part(grp, '::', 2) AS lang, avg(CASE WHEN a.score > b.score THEN 1.0 ELSE 0 END) AS v, count(*) AS n FROM pairs JOIN exs a ON a.eid = vuln_eid JOIN exs b ON b.eid = safe_eid GROUP BY grp),
t AS (SELECT lang, sum(round(v * n)) / sum(n) AS p, CAST(sum(n) AS DOUBLE) AS n FROM p GROUP BY lang)
SELECT lang, round(p, 6) AS pooled, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS lo, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS hi FROM t""")
def a36_pooled_pairs(v):
    """Pair accuracies of groups pooled as counts, with Wilson's interval."""
    s = example_scores(v).select("eid", "score")
    p = v.pairs.join(s.select(F.col("eid").alias("vuln_eid"), F.col("score").alias("a")), "vuln_eid").join(s.select(F.col("eid").alias("safe_eid"), F.col("score").alias("b")), "safe_eid")
    each = p.groupBy("grp").agg(F.avg((F.col("a") > F.col("b")).cast("double")).alias("v"), F.count("*").alias("n"))
    pooled = Z.pooled_shares(each.withColumn("lang", F.split("grp", "::")[1]), ["lang"], "v", "n")
    return pooled.select("lang", *r6("pooled", "lo", "hi"))
