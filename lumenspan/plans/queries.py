"""Registered queries of the operators, each on the views of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspan.functions import scalars as S
from lumenspan.operators import intervals as I
from lumenspan.operators import labels as L
from lumenspan.operators import pooling as P
from lumenspan.operators import ranking as R
from lumenspan.operators import ngrams, retrieval, splits, transfer
from lumenspan.plans.fixtures import Views
from lumenspan.sources.files import merge_last, row_violations, shard_of
from lumenspan.store import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def example_scores(v: Views) -> DataFrame:
    t = v.tok_scores.groupBy("eid").agg(F.max("logit").alias("score"))
    return t.join(v.ex.select("eid", F.col("row_label").alias("y"), "lang", "cwe"), "eid")


# scans, merges, checks


@query
def s8_contiguous_shards(v):
    rows = v.table("documents").select("doc_id")
    return rows.select("doc_id", shard_of(F.col("doc_id"), rows.count(), 7).alias("shard"))


@query
def s9_modulo_shards(v):
    return v.table("documents").groupBy(F.pmod("doc_id", F.lit(8)).alias("shard")).agg(F.count("*").alias("n"))


@query
def s11_last_write_wins(v):
    e = v.table("events").select("user_id", "event_id", "value")
    return merge_last(e, "user_id", "value", "event_id").select("user_id", *r6("value"))


@query
def s18_row_violations(v):
    rows = v.ex.withColumn("cwe", F.when(F.col("eid") % 13 != 0, F.col("cwe"))).withColumn("row_label", F.when(F.col("eid") % 17 != 0, F.col("row_label")))
    return row_violations(rows)


@query
def s10_merge_gates(v):
    d = v.table("orders").select("o_orderkey")
    return d.agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_keys"), (F.count("*") - F.countDistinct("o_orderkey")).alias("n_repeated"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")
    )


# labels, keys, text


@query
def p4_cwe_keys(v):
    c = F.concat(F.lit("cwe-"), F.lpad(F.substring("source", 4, 9), 3, "0"))
    return v.table("documents").select("doc_id", S.normalized_cwe(c).alias("cwe"), S.cwe_key(c).alias("cwe_key"))


@query
def p7_group_keys(v):
    d = v.table("documents")
    repo = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    func = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return d.select("doc_id", splits.group_key(repo, F.lit(None).cast("string"), func, F.col("text")).alias("grp"))


@query
def p8_paired_class(v):
    return L.paired_classes(v.ex)


@query
def p9_context_windows(v):
    return L.contexts(v.tok.where(F.length("word") >= 18).select("eid", "tok", "cs", "ce"), v.ex)


@query
def p15_null_safe_holdout(v):
    return v.ex.groupBy(splits.held_out_side("cwe", "CWE-003").alias("side")).agg(F.count("*").alias("n"))


# joins and intervals


@query
def j1_span_tokens(v):
    s = v.spans.where("key = 'sink'").select("eid", "key", F.greatest(F.lit(0), F.col("s") - 3).alias("s"), (F.col("e") + 3).alias("e"))
    return I.span_tokens(v.tok.select("eid", "tok", "cs", "ce"), s).groupBy("eid").agg(
        F.count("*").alias("n_spans"), F.sum("first_tok").alias("first_sum"), F.sum("last_tok").alias("last_sum")
    )


@query
def j2_token_labels(v):
    t = I.label_tokens(v.tok.select("eid", "tok", "cs", "ce"), v.spans.where("key = 'evidence'"))
    return t.groupBy("eid").agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))


@query
def j5_ordinal_pairs(v):
    return v.pairs


@query
def j6_adjacent_pairs(v):
    return splits.adjacent_pairs(v.ex)


@query
def j13_span_meets_live(v):
    # An example is subtractive if one of its tight spans meets one of its live ranges.
    tight, live = (v.spans.where(F.col("key") == k).select("eid", "s", "e") for k in ("sink", "evidence"))
    met = I.meets(tight, live).withColumn("_meets", F.lit(True))
    has = lambda rows, c: rows.select("eid").distinct().withColumn(c, F.lit(True))
    x = v.ex.select("eid").join(met, "eid", "left").join(has(tight, "_tight"), "eid", "left").join(has(live, "_live"), "eid", "left")
    # Without live ranges any tight span will do.
    found = F.when(F.col("_live").isNull(), F.col("_tight")).otherwise(F.col("_meets"))
    return x.select("eid", F.coalesce(found, F.lit(False)).alias("subtractive"))


@query
def j18_negative_pools(v):
    # The positives stay; the negatives are all, those of one language, or those paired with a positive.
    x = staged(example_scores(v), "example-scores")
    neg = x.where("y = 0")
    matched = neg.join(v.pairs.select(F.col("safe_eid").alias("eid")), "eid", "left_semi")
    pools = {"all_clean": neg, "english_only": neg.where("lang = 'en'"), "matched": matched}
    return R.roc_auc(splits.negative_pools(x, pools), ["pool"]).select("pool", *r6("auc"), "n_pos", "n_neg")


def _detections(v):
    return v.member_scores.groupBy("eid").agg(F.count_if(F.col("score") >= 0.5).alias("n_models"))


@query
def a22_agreement(v):
    return _detections(v).groupBy("n_models").agg(F.count("*").alias("n"), F.min("eid").alias("first_eid"))


@query
def a23_false_alarm_kinds(v):
    t = v.tok_scores.where("y = 0 and logit >= 4").select("eid", "row_label", F.col("cs").alias("s"), F.col("ce").alias("e"))
    k = I.alarm_kinds(t, v.spans.where("key = 'sink'").select("eid", "s", "e"))
    return k.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("eid").alias("n_examples"))


@query
def o5_top_per_kind(v):
    x = _detections(v).join(v.ex.select("eid", "lang"), "eid")
    x = splits.top_per_group(x, ["lang"], [F.desc("n_models"), F.asc("eid")], 15)
    return x.select("lang", "eid", "n_models", F.col("place").cast("long").alias("place"))


@query
def o7_hardest_examples(v):
    # Weakest positives and strongest negatives, two of each.
    hard = F.when(F.col("y") == 1, F.col("score")).otherwise(-F.col("score"))
    x = splits.top_per_group(example_scores(v), ["y"], [hard.asc(), F.asc("eid")], 2)
    return x.select(F.col("y").cast("long").alias("y"), "eid", *r6("score"), F.col("place").cast("long").alias("place"))


@query
def j11_member_combine(v):
    return P.combine_members(v.member_scores).select("eid", *r6("best", "mean"), "n_members")


@query
def j16_nearest_span(v):
    s, t = v.spans.where("key = 'sink'").select("eid", "s", "e"), v.spans.where("key = 'sanitizer'").select("eid", "s", "e")
    return I.nearest_distance(s, t).groupBy("eid").agg(F.count("*").alias("n"), F.sum("distance").alias("total"), F.max("distance").alias("longest"))


@query
def j17_line_of_offset(v):
    x = v.ex.select("eid", "code", F.explode(F.array(*map(F.lit, (-1, 0, 200, 1000)))).alias("off"))
    return x.select("eid", F.col("off").cast("long").alias("off"), I.line_of(F.col("code"), F.col("off")).cast("long").alias("line"))


@query
def w5_merged_spans(v):
    m = I.merge_spans(v.spans.select("eid", "s", (F.col("e") + 1).alias("e")), ["eid"])
    return m.groupBy("eid").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("chars"), F.sum("members").alias("members"))


@query
def w6_merged_with_gap(v):
    m = I.merge_spans(v.spans.select("eid", "s", "e"), ["eid"], gap=2)
    return m.groupBy("eid").agg(F.count("*").alias("n"), F.max("members").alias("most"))


@query
def u2_span_difference(v):
    a = I.merge_spans(v.spans.where("key = 'sink'").select("eid", "s", (F.col("e") + 4).alias("e")), ["eid"])
    b = I.merge_spans(v.spans.where("key = 'sanitizer'").select("eid", "s", "e"), ["eid"])
    d = I.subtract_spans(a.select("eid", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")), b.select("eid", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")))
    return d.groupBy("eid").agg(F.sum(F.col("e") - F.col("s")).alias("chars"))


@query
def u3_live_ranges(v):
    m = I.merge_spans(v.spans.where("key = 'evidence'").select("eid", "s", "e"), ["eid"])
    sizes = v.ex.select("eid", F.length("code").cast("long").alias("n"))
    c = I.complement(m.select("eid", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")), sizes)
    return c.groupBy("eid").agg(F.count("*").alias("n"), F.sum(F.col("e") - F.col("s")).alias("chars"))


@query
def w4_islands(v):
    i = I.islands(v.tok_scores)
    return i.groupBy("eid").agg(F.count("*").alias("n"), F.max(F.col("last_tok") - F.col("first_tok") + 1).alias("longest"))


@query
def w7_soft_labels(v):
    return I.soft_labels(v.tok_scores.select("eid", "tok", "y"), 4).groupBy("eid").agg(F.round(F.sum("soft"), 6).alias("soft"))


@query
def w8_dilation(v):
    return I.dilate(v.tok_scores.select("eid", "tok", "y"), 2).groupBy("eid").agg(F.sum("dilated").alias("n"))


# metrics


@query
def a1_token_auc(v):
    return R.roc_auc(v.tok_scores, ["lang"], "logit").select("lang", *r6("auc"), "n_pos", "n_neg")


@query
def a1_example_auc(v):
    return R.roc_auc(example_scores(v), []).select(*r6("auc"), "n_pos", "n_neg")


@query
def a3_confusion(v):
    c = R.confusion(v.tok_scores, ["lang"], 0.5, "prob")
    return c.select("lang", "tp", "fp", "fn", "tn", *r6("accuracy", "precision", "recall", "f1", "g_mean"))


def _best(v, objective):
    roc = R.cumulative(R.score_counts(v.tok_scores, ["lang"], "logit", "y"), ["lang"])
    return R.best_threshold(roc, ["lang"], objective).select("lang", *r6("threshold", objective))


@query
def a5_best_gmean(v):
    return _best(v, "g_mean")


@query
def a6_best_accuracy(v):
    return _best(v, "accuracy")


@query
def a10_best_f1(v):
    return _best(v, "f1")


@query
def a7_recall_at_fpr(v):
    roc = R.cumulative(R.score_counts(example_scores(v), [], "score", "y"), [])
    return R.recall_at_fpr(roc, [], [0.01, 0.05, 0.10, 0.20]).select(*r6("recall_at_1", "recall_at_5", "recall_at_10", "recall_at_20"))


@query
def a8_tpr_at_fpr(v):
    roc = R.cumulative(R.score_counts(v.tok_scores, ["lang"], "logit", "y"), ["lang"])
    return R.tpr_at_fpr(roc, ["lang"], 0.05).select("lang", *r6("tpr", "tpr_discrete"))


@query
def a9_global_threshold_recall(v):
    t = v.tok_scores
    roc = R.cumulative(R.score_counts(t, [], "logit", "y"), [])
    return R.recall_above(t, R.global_threshold(roc, 0.01), ["lang"], "logit").select("lang", *r6("recall"), "n")


@query
def a12_calibration(v):
    return R.calibration(v.tok_scores, ["lang"]).select("lang", *r6("brier", "ece"))


@query
def a13_reliability(v):
    return R.reliability(v.tok_scores).select(F.col("bin").cast("long").alias("bin"), *r6("centre", "accuracy"), "n")


@query
def a14_pooling(v):
    return P.pool(v.tok_scores).select("eid", *r6("max_all", "max_code", "mean_code", "top_mean", "last"), F.col("y").cast("long").alias("y"))


@query
def a16_span_max(v):
    t = v.tok_scores
    m = P.span_max(t.select("eid", "tok", "prob"), I.islands(t))
    return m.groupBy("eid").agg(F.count("*").alias("n_spans"), F.round(F.avg("span_score"), 6).alias("mean_score"))


@query
def a17_slice_auc(v):
    x = staged(example_scores(v), "example-scores")
    # A class's slice is its positives and all negatives, which are counted once.
    own = R.class_auc(x.withColumnRenamed("cwe", "slice"), "slice", [])
    every = x.select(F.lit("all").alias("slice"), "score", "y").unionByName(x.select(F.concat(F.lit("lang::"), "lang").alias("slice"), "score", "y"))
    return own.unionByName(R.roc_auc(every, ["slice"])).select("slice", *r6("auc"), "n_pos", "n_neg")


@query
def a18_macro_auc(v):
    a = R.roc_auc(v.tok_scores, ["eid"], "logit")
    return a.agg(F.round(F.avg("auc"), 6).alias("macro_auc"), F.count("auc").alias("n"))


@query
def a19_pair_accuracy(v):
    return P.pair_accuracy(v.pairs, example_scores(v).select("eid", "score")).select(*r6("strict", "half_ties"), "n_pairs")


@query
def a20_transfer_blocks(v):
    # Probes of one label against the rest, tested on every label's vectors against those of label 9.
    a = v.acts.select("vec_id", "x", "label")
    probes = transfer.rest_probes(a, "label").where("label < 9").withColumnRenamed("label", "train")
    scored = transfer.score_all(a, probes).withColumn("score", F.round("score", 9)).withColumn("y", (F.col("label") != 9).cast("int"))
    m = R.class_auc(scored.withColumn("test", F.when(F.col("label") != 9, F.col("label"))), "test", ["train"])
    fam = lambda c: F.when(F.col(c) < 4, "low").otherwise("high")
    m = m.select("train", "test", "auc", F.col("n_pos").alias("n"), fam("train").alias("train_family"), fam("test").alias("test_family"))
    return transfer.block_means(m).select("train_family", "test_family", *r6("mean_all", "mean_off_diagonal"))


@query
def a25_retrieval(v):
    m = retrieval.retrieval_metrics(v.leads, v.traces, [1, 3, 10])
    names = [c for c in m.columns if c not in ("repo_id", "first_hit") and not c.startswith("hit_")]
    return m.select("repo_id", F.col("first_hit").cast("long").alias("first_hit"), *[F.col(f"hit_at_{k}").cast("long").alias(f"hit_at_{k}") for k in (1, 3, 10)], *r6(*names))


@query
def a27_score_summary(v):
    p = F.percentile("logit", [0.1, 0.5, 0.9])
    s = v.tok_scores.groupBy("y").agg(F.avg("logit").alias("mean"), F.stddev_pop("logit").alias("std"), p.alias("p"), F.min("logit").alias("lo"), F.max("logit").alias("hi"), F.count("*").alias("n"))
    return s.select(F.col("y").cast("long").alias("y"), *r6("mean", "std"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p10", "median", "p90"))], *r6("lo", "hi"), "n")


@query
def a28_length_correlation(v):
    t = v.tok_scores.groupBy("eid").agg(F.max("logit").alias("s"), F.count("*").alias("n"))
    return t.agg(F.round(F.corr("s", F.col("n").cast("double")), 6).alias("pearson"))


@query
def a30_clustered_bootstrap(v):
    d = R.bootstrap_auc(v.tok_scores.where("is_test"), "eid", ["logit"], "y", 40, 7)
    return R.interval(d, "logit").select(*r6("mean", "lo", "hi"), "n_draws")


@query
def a33_paired_bootstrap(v):
    t = v.tok_scores.where("is_test").withColumn("other", F.length("word").cast("double"))
    d = R.bootstrap_auc(t, "eid", ["logit", "other"], "y", 20, 11).withColumn("delta", F.col("logit") - F.col("other"))
    return R.interval(d, "delta").select(*r6("mean", "lo", "hi"), "n_draws")


@query
def a36_wilson(v):
    z = 1.96
    g = v.ex.groupBy("lang").agg(F.avg("row_label").alias("p"), F.count("*").cast("double").alias("n"))
    c, d = (F.col("p") + z * z / (2 * F.col("n"))), 1 + z * z / F.col("n")
    h = z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))
    return g.select("lang", F.round((c - h) / d, 6).alias("lo"), F.round((c + h) / d, 6).alias("hi"))


@query
def a37_language_null(v):
    t = v.tok_scores.withColumn("s", F.col("lang").isin("de", "fr").cast("double"))
    return R.roc_auc(t, [], "s").select(*r6("auc"), "n_pos", "n_neg")


@query
def a42_code_contrast(v):
    t = v.tok_scores
    both = t.select(F.lit("tokens").alias("level"), "logit", "y").unionByName(t.where("is_code").select(F.lit("tokens_code").alias("level"), "logit", "y"))
    return R.roc_auc(both, ["level"], "logit").select("level", *r6("auc"), "n_pos", "n_neg")


@query
def a24_class_counts(v):
    return splits.top_classes(v.ex, 5).select("cwe", "n", "first_eid")


# functions


@query
def f6_probe_scores(v):
    probe = transfer.centroid_probe(v.acts, ["layer"])
    s = v.acts.join(F.broadcast(probe), "layer").select("vec_id", F.round(S.dot(F.col("x"), F.col("w")), 6).alias("score"), F.round(S.cosine(F.col("x"), F.col("w")), 6).alias("cosine"))
    return s


@query
def f8_span_max_loss(v):
    return R.span_max_loss(v.tok_scores, 0.5).select("eid", *r6("loss"))


@query
def f5_logit_aggregation(v):
    return v.acts.select("vec_id", F.round(S.logsumexp(F.col("x"), 4.0), 6).alias("lse"), F.round(F.array_max("x"), 6).alias("top"))


@query
def f10_pattern_counts(v):
    d = v.table("documents")
    c = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return d.select("doc_id", c("[0-9]+").alias("numbers"), c("[A-Z][a-z]+").alias("capitalised"), c("[.,;]").alias("marks"))


@query
def f22_char_ngrams(v):
    # A text is cut into its characters once; taking each piece out of the text would count through it from its start.
    t = v.ex.where("length(code) >= 3").select(F.split("code", "").alias("c"))
    later = lambda k: F.slice("c", F.lit(1 + k), F.size("c") - 2)
    both = lambda a, b: F.concat(a, b)
    g = t.select(F.explode(F.zip_with(F.zip_with(later(0), later(1), both), later(2), both)).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(50)


@query
def f22_hashed_ngrams(v):
    """Per document, over the whole table; ``f22_char_ngrams`` is the 50 commonest trigrams of labelled texts only."""
    return ngrams.hashed_ngrams(v.table("documents"), range(3, 6), 1 << 18)


@query
def f24_json_fields(v):
    k = F.get_json_object("props", "$.k").cast("long")
    return v.table("events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"))).alias("again"))


# splits


@query
def x1_random_split(v):
    return splits.random_split(v.ex, 7).groupBy("row_label", "side").agg(F.count("*").alias("n"), F.sum("eid").alias("ids")).select(F.col("row_label").cast("long").alias("row_label"), "side", "n", "ids")


@query
def x6_group_holdout(v):
    return splits.group_split(v.ex, 42).select("eid", "grp", "side")


@query
def x8_group_folds(v):
    return splits.group_folds(v.ex, 5, 42).select("eid", F.col("fold").cast("long").alias("fold"))


@query
def x3_leave_one_class_out(v):
    x = v.ex
    s = splits.leave_one_out(x, "cwe", splits.top_classes(x, 5), "heldout_cwe")
    return s.groupBy("split_name", "side").agg(F.count("*").alias("n"), F.sum("row_label").alias("n_pos"))


@query
def x4_leave_one_language_out(v):
    x = v.ex
    s = splits.leave_one_out(x, "lang", x.select("lang").distinct(), "heldout_lang")
    return s.groupBy("split_name", "side").agg(F.count("*").alias("n"), F.sum("row_label").alias("n_pos"))


@query
def x9_oversample(v):
    out = splits.oversampled(v.ex.select("eid", "lang"), F.col("lang") == "en", F.col("lang") == "es")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.sum("eid").alias("ids"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token AUC by language."""
    return QUERIES["a1_token_auc"](spark, sf_dir)
