"""Exact ranking metrics from counts per distinct score.

Rows are first summed to (group, score, positives, negatives): a partial aggregation that all tasks share.  Cumulative
counts then need the order of scores; they are taken within score buckets and offset by the buckets' sums, so a group
with very many distinct scores is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.scalars import bce_with_logits
from lumenspan.store import staged


def score_counts(df: DataFrame, by: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    y = F.col(label).cast("int")
    return (
        df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.sum(w * y).alias("pos"), F.sum(w * (1 - y)).alias("neg"))
    )


def cumulative(counts: DataFrame, by: list[str], rows_in_bucket: int = 200_000) -> DataFrame:
    """Adds ``tp``, ``fp``: positives and negatives with at least this score; ``P``, ``N``: all of the group.

    ``place`` is the score's place from the highest, 1, and ``n_scores`` how many distinct scores the group has.  The
    counts are written once; the number of buckets follows from theirs.  Where no group has more than one bucket's
    scores, however many groups there are, each is put in order as it is.
    """
    counts = staged(counts, "score-counts")
    sizes = counts.groupBy(*by).count() if by else counts.groupBy().count()
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= rows_in_bucket:
        order, group = Window.partitionBy(*by).orderBy(F.desc("score")), Window.partitionBy(*by)
        within = order.rowsBetween(Window.unboundedPreceding, 0)
        return counts.select(
            *by, "score", "pos", "neg", F.sum("pos").over(within).alias("tp"), F.sum("neg").over(within).alias("fp"),
            F.sum("pos").over(group).alias("P"), F.sum("neg").over(group).alias("N"),
            F.row_number().over(order).alias("place"), F.count("*").over(group).alias("n_scores"),
        )
    buckets = total // rows_in_bucket + 1
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(counts.agg(F.percentile_approx("score", shares, 1000)).first()[0] or []))
    # One literal array, as an expression for each cut would nest as deep as there are cuts.
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("score")))
    counts = counts.withColumn("_b", bucket)
    sums = counts.groupBy(*by, "_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.count("*").alias("_k"))
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    zero = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    own = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    sums = sums.select(
        *own, F.col("_b").alias("_gb"), zero("_p").alias("_p0"), zero("_n").alias("_n0"), zero("_k").alias("_k0"),
        F.sum("_p").over(group).alias("P"), F.sum("_n").over(group).alias("N"), F.sum("_k").over(group).alias("n_scores"),
    )
    order = Window.partitionBy(*by, "_b").orderBy(F.desc("score"))
    within = order.rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_pc", F.sum("pos").over(within)).withColumn("_nc", F.sum("neg").over(within)).withColumn("_kc", F.row_number().over(order))
    cond = F.col("_b") == F.col("_gb")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return counts.join(sums, cond).select(
        *by, "score", "pos", "neg",
        (F.col("_p0") + F.col("_pc")).alias("tp"), (F.col("_n0") + F.col("_nc")).alias("fp"), "P", "N",
        (F.col("_k0") + F.col("_kc")).alias("place"), "n_scores",
    )


def roc_auc(df: DataFrame, by: list[str], score: str = "score", label: str = "y", weight: Column | None = None) -> DataFrame:
    """Mann-Whitney with average ranks on ties; NULL where a class is missing."""
    c = cumulative(score_counts(df, by, score, label, weight), by)
    # A negative loses to the positives above it and halves with those of its own score.
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    agg = c.groupBy(*by) if by else c.groupBy()
    pairs = F.max("P") * F.max("N")
    return agg.agg((wins / F.nullif(pairs, F.lit(0))).alias("auc"), F.max("P").alias("n_pos"), F.max("N").alias("n_neg"))


def confusion(df: DataFrame, by: list[str], threshold: float, score: str = "score", label: str = "y") -> DataFrame:
    """Counts, accuracy, precision, recall, F1 (0 where undefined) and g-mean at score >= threshold."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(
        count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"), count(~hit & ~y).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        out.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("g_mean", F.sqrt(ratio(tp, tp + fn) * ratio(tn, tn + fp)))
    )


def best_threshold(roc: DataFrame, by: list[str], objective: str) -> DataFrame:
    """The score of the cumulative table that maximises g-mean, F1 or accuracy; ties go to the highest score."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "P", "N"))
    value = {
        "g_mean": F.sqrt(tp / F.nullif(p, F.lit(0)) * (1 - fp / F.nullif(n, F.lit(0)))),
        "f1": 2 * tp / F.nullif(p + tp + fp, F.lit(0)),
        "accuracy": (tp + n - fp) / F.nullif(p + n, F.lit(0)),
    }[objective]
    best = roc.withColumn("v", F.round(value, 12)).groupBy(*by).agg(F.max(F.struct("v", "score")).alias("b"))
    return best.select(*by, F.col("b.score").alias("threshold"), F.col("b.v").alias(objective))


def tpr_at_fpr(roc: DataFrame, by: list[str], target: float) -> DataFrame:
    """TPR interpolated on the ROC at the target, and the TPR within floor(target * N) false positives."""
    points = roc.groupBy(*by, "fp", "P", "N").agg(F.max("tp").alias("tp"))
    order = Window.partitionBy(*by).orderBy("fp")
    points = points.withColumn("fp2", F.lead("fp").over(order)).withColumn("tp2", F.lead("tp").over(order))
    x = F.col("N") * target
    inside = (F.col("fp") <= x) & (F.col("fp2") > x)
    slope = F.col("tp") + (F.col("tp2") - F.col("tp")) * (x - F.col("fp")) / (F.col("fp2") - F.col("fp"))
    # Before the first vertex the curve starts in the origin.
    first = F.row_number().over(order) == 1
    from_origin = F.when(first & (F.col("fp") > x), F.col("tp") * x / F.col("fp"))
    allowed = F.max(F.when(F.col("fp") <= F.floor(x), F.col("tp")))
    agg = points.withColumn("_o", from_origin)
    value = F.coalesce(F.max(F.when(inside, slope)), F.max("_o"), F.max("tp"))
    return agg.groupBy(*by).agg(
        (value / F.nullif(F.max("P"), F.lit(0))).alias("tpr"),
        (F.coalesce(allowed, F.lit(0)) / F.nullif(F.max("P"), F.lit(0))).alias("tpr_discrete"),
    )


def recall_at_fpr(roc: DataFrame, by: list[str], targets: list[float]) -> DataFrame:
    """TPR at the last ROC vertex (collinear points dropped) whose FPR is at most the target."""
    order = Window.partitionBy(*by).orderBy("fp", "tp")
    # Slopes before and after a point, compared by cross products of counts.
    dx, dy = F.col("fp") - F.coalesce(F.lag("fp").over(order), F.lit(0)), F.col("tp") - F.coalesce(F.lag("tp").over(order), F.lit(0))
    ex, ey = F.lead("fp").over(order) - F.col("fp"), F.lead("tp").over(order) - F.col("tp")
    kept = roc.withColumn("_keep", F.coalesce(dx * ey != ex * dy, F.lit(True))).where("_keep")
    exprs = []
    for t in targets:
        best = F.max(F.when(F.col("fp") <= F.col("N") * t, F.col("tp")))
        exprs.append(F.coalesce(best / F.nullif(F.max("P"), F.lit(0)), F.lit(0.0)).alias(f"recall_at_{round(t * 100)}"))
    return kept.groupBy(*by).agg(*exprs)


def calibration(df: DataFrame, by: list[str], prob: str = "prob", label: str = "y", bins: int = 15, closed: bool = False) -> DataFrame:
    """Brier score and ECE over equal bins; p = 1 falls in no bin unless the last one is ``closed``."""
    raw = F.floor(F.col(prob) * bins)
    b = F.least(raw, F.lit(bins - 1)) if closed else F.when(raw < bins, raw)
    binned = df.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"), F.sum(prob).alias("p"), F.sum(label).alias("y"), F.sum(F.pow(F.col(prob) - F.col(label), 2)).alias("sq")
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("p") - F.col("y"))).otherwise(0.0)
    return binned.groupBy(*by).agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"))


def reliability(df: DataFrame, prob: str = "prob", label: str = "y", bins: int = 10) -> DataFrame:
    """Every bin's centre, share of positives (NULL if empty) and count."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    got = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(label).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select(
        "bin", ((F.col("bin") + 0.5) / bins).alias("centre"), "accuracy", F.coalesce("n", F.lit(0)).alias("n")
    )


def grid_f1(df: DataFrame, by: list[str], prob: str, label: str) -> DataFrame:
    """The best F1 at thresholds 0.01 to 0.99 and the first threshold that gives it.

    Rows are counted by how many thresholds they pass; the table that is cumulated has 100 rows a group.
    """
    passed = F.lit(0)
    for t in range(1, 100):
        passed = passed + (F.col(prob) >= t / 100.0).cast("int")
    c = df.groupBy(*by, passed.alias("_t")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    every = c.select(*by).distinct().crossJoin(F.broadcast(df.sparkSession.range(100).select(F.col("id").cast("int").alias("_t"))))
    c = every.join(c, [*by, "_t"], "left").fillna(0, ["pos", "neg"])
    above = Window.partitionBy(*by).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("tp", F.sum("pos").over(above)).withColumn("fp", F.sum("neg").over(above)).withColumn("P", F.sum("pos").over(Window.partitionBy(*by)))
    f1 = F.round(F.coalesce(2.0 * F.col("tp") / F.nullif(F.col("P") + F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0)), 12)
    best = c.where("_t > 0").groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("_t")).alias("t"))).alias("b"))
    return best.select(*by, (-F.col("b.t") / 100).alias("threshold"), F.col("b.f1").alias("f1"))


def curve_f1(roc: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    """The best F1 on the precision-recall curve; ties go to the lowest threshold, the curve's first point."""
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif(F.col("P"), F.lit(0))
    f1 = F.round(2 * precision * recall / (precision + recall + eps), 12)
    best = roc.groupBy(*by).agg(F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s"))).alias("b"))
    return best.select(*by, (-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def percentile_accuracy(roc: DataFrame, by: list[str], points: int = 100) -> DataFrame:
    """The most accurate of ``points`` evenly spaced percentiles of the distinct scores; ties go to the lowest."""
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    cuts = roc.groupBy(*by).agg(F.first("n_scores").alias("_u")).withColumn("_i", at).withColumn("_at", F.col("_i") * (F.col("_u") - 1) / (points - 1))
    low = roc.select(*by, (F.col("n_scores") - F.col("place")).alias("_lo"), F.col("score").alias("_s"))
    high = roc.select(*by, (F.col("n_scores") - F.col("place")).alias("_hi"), F.col("score").alias("_t"), "tp", "fp", "P", "N")
    cuts = cuts.withColumn("_lo", F.floor("_at")).withColumn("_hi", F.ceil("_at")).join(low, [*by, "_lo"]).join(high, [*by, "_hi"])
    threshold = F.col("_s") + (F.col("_t") - F.col("_s")) * (F.col("_at") - F.col("_lo"))
    accuracy = F.round((F.col("tp") + F.col("N") - F.col("fp")) / (F.col("P") + F.col("N")), 12)
    best = cuts.groupBy(*by).agg(F.max(F.struct(accuracy.alias("v"), (-threshold).alias("t"))).alias("b"))
    return best.select(*by, (-F.col("b.t")).alias("threshold"), F.col("b.v").alias("accuracy"))


def level_bundle(df: DataFrame, by: list[str], prob: str = "prob", label: str = "y", threshold: float = 0.5, bins: int = 15) -> DataFrame:
    """AUC, counts' ratios at the threshold, recall at two false-positive rates, Brier score and ECE per group.

    All of it comes from counts per distinct score, so the rows are read once.
    """
    roc = staged(cumulative(score_counts(df, by, prob, label), by), "roc")
    n = F.col("pos") + F.col("neg")
    on = F.col("score") >= threshold
    b = F.floor(F.col("score") * bins)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    part = roc.groupBy(*by).agg(
        F.max("P").alias("p"), F.max("N").alias("n"), (wins / F.nullif(F.max("P") * F.max("N"), F.lit(0))).alias("auc"),
        F.coalesce(F.sum(F.when(on, F.col("pos"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(on, F.col("neg"))), F.lit(0)).alias("f"),
        F.sum(F.col("pos") * F.pow(F.col("score") - 1, 2) + F.col("neg") * F.pow("score", F.lit(2))).alias("sq"),
    )
    cells = roc.where(b < bins).groupBy(*by, b.alias("_bin")).agg(F.abs(F.sum(F.col("score") * n) - F.sum("pos")).alias("gap"))
    gaps = cells.groupBy(*by).agg(F.sum("gap").alias("gap"))
    recalls = recall_at_fpr(roc, by, [0.05, 0.10])
    # Without groups each table is one row.
    out = part.join(gaps, by, "left").join(recalls, by) if by else part.crossJoin(gaps).crossJoin(recalls)
    total = F.col("p") + F.col("n")
    ratio = lambda a, c: F.coalesce(a / F.nullif(c, F.lit(0)), F.lit(0.0))
    return out.select(
        *by, "auc", ((F.col("t") + F.col("n") - F.col("f")) / total).alias("accuracy"), ratio(F.col("t"), F.col("t") + F.col("f")).alias("precision"),
        ratio(F.col("t"), F.col("p")).alias("recall"), ratio(2 * F.col("t"), F.col("p") + F.col("t") + F.col("f")).alias("f1"),
        "recall_at_5", "recall_at_10", (F.col("sq") / total).alias("brier"), (F.coalesce("gap", F.lit(0.0)) / total).alias("ece"),
        total.alias("n_total"), F.col("p").alias("n_pos"),
    )


def class_auc(ex: DataFrame, cls: str, by: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """AUC of each class's positives against all negatives of the group (``by``).

    A class's wins are sums over its positives of the negatives below them, so negatives are counted once per score and
    not copied for each class.
    """
    s = F.col(score).cast("double")
    ok = ex.where(F.col(score).isNotNull() & ~F.isnan(score))
    roc = cumulative(score_counts(ok, by, score, label), by)
    own = ok.where((F.col(label) == 1) & F.col(cls).isNotNull()).groupBy(cls, *by, s.alias("score")).agg(F.count("*").alias("_m"))
    below = F.col("N") - F.col("fp") + F.col("neg") / 2.0
    joined = own.join(roc.select(*by, "score", below.alias("_below"), "N"), [*by, "score"])
    total = F.sum("_m") * F.max("N")
    return joined.groupBy(cls, *by).agg((F.sum(F.col("_m") * F.col("_below")) / F.nullif(total, F.lit(0))).alias("auc"), F.sum("_m").alias("n_pos"), F.max("N").alias("n_neg"))


def class_cells(ex: DataFrame, cls: str, group: str, classes: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """The classes' AUCs in every value of ``group`` and over all ('*'); cells without positives have a NULL."""
    each = class_auc(ex, cls, [group], score, label)
    whole = class_auc(ex.withColumn(group, F.lit("*")), cls, [group], score, label)
    sizes = ex.groupBy(group).agg(F.sum(1 - F.col(label)).alias("_neg")).unionByName(ex.agg(F.sum(1 - F.col(label)).alias("_neg")).select(F.lit("*").alias(group), "_neg"))
    names = F.explode(F.array(*map(F.lit, classes))).alias(cls)
    cells = sizes.select(group, "_neg", names).join(each.unionByName(whole), [cls, group], "left")
    return cells.select(cls, group, "auc", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), F.col("_neg").alias("n_neg"))


def bootstrap_auc(df: DataFrame, unit: str, scores: list[str], label: str, draws: int, seed: int) -> DataFrame:
    """(draw, auc of each score) of Poisson resamples of ``unit``: rows, examples or groups.

    Rows are summed to (unit, score, label) first, so a draw multiplies counts, not tokens.
    """
    from lumenspan.functions.scalars import poisson_weight, uniform_hash

    spark = df.sparkSession
    out = None
    units = df.select(unit).distinct()
    weights = units.crossJoin(F.broadcast(spark.range(draws).withColumnRenamed("id", "draw")))
    weights = weights.withColumn("w", poisson_weight(uniform_hash(F.lit(seed), "draw", unit))).where("w > 0")
    for s in scores:
        summed = df.groupBy(unit, F.col(s).alias("score"), F.col(label).alias("y")).agg(F.count("*").alias("n"))
        one = roc_auc(summed.join(weights, unit), ["draw"], "score", "y", F.col("w") * F.col("n")).select("draw", F.col("auc").alias(s))
        out = one if out is None else out.join(one, "draw")
    return out


def interval(draws: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    p = F.percentile(value, [alpha / 2, 1 - alpha / 2])
    above = F.avg((F.col(value) > 0).cast("int")).alias("above_0")
    return draws.agg(F.avg(value).alias("mean"), p.alias("ci"), above, F.count(value).alias("n_draws")).select(
        "mean", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"), "above_0", "n_draws"
    )


def global_threshold(roc: DataFrame, share: float) -> DataFrame:
    """(thr): the (floor(share * N) + 1)-th largest negative, from the cumulative counts of one group."""
    return roc.where(F.col("fp") > F.floor(F.col("N") * share)).agg(F.max("score").alias("thr"))


def recall_above(rows: DataFrame, threshold: DataFrame, by: list[str], score: str, label: str = "y") -> DataFrame:
    """Per slice the share of positives strictly above a threshold of the whole table."""
    pos = rows.where(F.col(label) == 1).crossJoin(F.broadcast(threshold))
    return pos.groupBy(*by).agg(F.avg((F.col(score) > F.col("thr")).cast("double")).alias("recall"), F.count("*").alias("n"))


def span_max_loss(tok: DataFrame, omega: float, logit: str = "logit", label: str = "y", pos_weight: float = 1.0) -> DataFrame:
    """(eid, loss): (1 - omega) of the weighted mean token loss and omega of the loss at the highest token."""
    weight = F.when(F.col(label) == 1, pos_weight).otherwise(1.0)
    t = tok.withColumn("_l", bce_with_logits(F.col(logit), F.col(label))).withColumn("_w", weight)
    mean = F.sum(F.col("_w") * F.col("_l")) / F.sum("_w")
    return t.groupBy("eid").agg(((1 - omega) * mean + omega * F.max_by("_l", F.struct(logit, -F.col("tok")))).alias("loss"))
