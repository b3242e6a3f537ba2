"""Example scores from token scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pool(tok: DataFrame, score: str = "logit", top: int = 5) -> DataFrame:
    """Max, mean, mean of the top few, last and maximal-code reads per example; all tokens where none is code."""
    order = Window.partitionBy("eid").orderBy(F.desc(score), "tok")
    t = tok.withColumn("_r", F.row_number().over(order))
    code = F.col("is_code")
    return t.groupBy("eid").agg(
        F.max(score).alias("max_all"),
        F.coalesce(F.max(F.when(code, F.col(score))), F.max(score)).alias("max_code"),
        F.coalesce(F.avg(F.when(code, F.col(score))), F.avg(score)).alias("mean_code"),
        F.avg(F.when(F.col("_r") <= top, F.col(score))).alias("top_mean"),
        F.max_by(score, "tok").alias("last"),
        F.max("y").alias("y"),
    )


def span_max(tok: DataFrame, token_spans: DataFrame, score: str = "prob", block: int = 64) -> DataFrame:
    """The highest score in each token range (first and last included).

    Whole blocks inside a range are read from the blocks' maxima, only its ends token by token, so that ranges over
    long texts are not joined with all their tokens.
    """
    ranges = token_spans.select("eid", "first_tok", "last_tok").where("first_tok <= last_tok").distinct()
    t = tok.select("eid", "tok", F.col(score).alias("_v"))
    blocks = t.groupBy("eid", F.floor(F.col("tok") / block).alias("_p")).agg(F.max("_v").alias("_v"))
    lo, hi = F.ceil(F.col("first_tok") / block), F.floor((F.col("last_tok") + 1) / block) - 1
    inner = ranges.where(lo <= hi).withColumn("_p", F.explode(F.sequence(lo, hi))).join(blocks, ["eid", "_p"])
    head = F.least(F.col("last_tok"), lo * block - 1)
    tail = F.greatest(F.col("first_tok"), (hi + 1) * block)
    short = F.sequence(F.col("first_tok").cast("long"), F.col("last_tok").cast("long"))
    none = F.array().cast("array<bigint>")
    left = F.when(head >= F.col("first_tok"), F.sequence(F.col("first_tok").cast("long"), head.cast("long"))).otherwise(none)
    right = F.when(tail <= F.col("last_tok"), F.sequence(tail.cast("long"), F.col("last_tok").cast("long"))).otherwise(none)
    ends = ranges.withColumn("tok", F.explode(F.when(lo > hi, short).otherwise(F.concat(left, right)))).join(t, ["eid", "tok"])
    columns = ["eid", "first_tok", "last_tok", "_v"]
    return inner.select(*columns).unionByName(ends.select(*columns)).groupBy("eid", "first_tok", "last_tok").agg(F.max("_v").alias("span_score"))


def run_max(tok: DataFrame, score: str, keep: list[str]) -> DataFrame:
    """(eid, y, ``score``, keep...): the highest score of each run of tokens with equal ``y``; ``keep`` is the same for a
    whole example.  One pass in order of position."""
    place = F.row_number().over(Window.partitionBy("eid", "y").orderBy("tok"))
    runs = tok.withColumn("_k", F.col("tok") - place).groupBy("eid", "y", "_k")
    return runs.agg(F.max(score).alias(score), *[F.first(c).alias(c) for c in keep]).drop("_k")


def pair_accuracy(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """How often the vulnerable side of a pair outscores the safe side: strictly, and with ties as half."""
    v = scores.select(F.col("eid").alias("vuln_eid"), F.col("score").alias("v"))
    s = scores.select(F.col("eid").alias("safe_eid"), F.col("score").alias("s"))
    return pairs.join(v, "vuln_eid").join(s, "safe_eid").agg(
        F.avg((F.col("v") > F.col("s")).cast("double")).alias("strict"),
        F.avg(F.when(F.col("v") > F.col("s"), 1.0).when(F.col("v") == F.col("s"), 0.5).otherwise(0.0)).alias("half_ties"),
        F.count("*").alias("n_pairs"),
    )


def combine_members(scores: DataFrame) -> DataFrame:
    """Max and mean over the members that scored an example; NULL and NaN count as absent."""
    ok = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    return ok.groupBy("eid").agg(F.max("score").alias("best"), F.avg("score").alias("mean"), F.count("*").alias("n_members"))


def other_reads(tok: DataFrame, top: int, score: str = "logit") -> DataFrame:
    """Mean of the ``top`` highest, the highest of the labelled positives, and the last token that is code.

    An example's scores are gathered for this, never those of a group of examples.  Without code: the last token.
    """
    best = F.slice(F.sort_array(F.collect_list(score), asc=False), 1, top)
    code = F.col("is_code")
    t = tok.groupBy("eid").agg(
        best.alias("_best"),
        F.max(F.when(F.col("y") == 1, F.col(score))).alias("labelled_max"),
        F.coalesce(F.max_by(F.when(code, F.col(score)), F.when(code, F.col("tok"))), F.max_by(score, "tok")).alias("last_code"),
    )
    mean = F.aggregate("_best", F.lit(0.0), lambda a, x: a + x) / F.size("_best")
    return t.select("eid", mean.alias("top_10" if top == 10 else f"top_{top}"), "labelled_max", "last_code")


def score_to_tokens(tok: DataFrame, scores: DataFrame) -> DataFrame:
    """Every token with its example's score."""
    return tok.join(scores, "eid")


def scored_by_both(one: DataFrame, two: DataFrame, a: str, b: str) -> DataFrame:
    """The examples that have a number on both sides."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return one.where(number(a)).join(two.where(number(b)), "eid")


def first_counterpart(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(eid, fixed): the first negative of a positive's group that has the positive's class or none.

    Negatives are reduced to the first of each (group, class), so groups are not paired out.
    """
    first = negatives.groupBy("grp", "cwe").agg(F.min("eid").alias("_f"))
    none = first.where("cwe is null").select("grp", F.col("_f").alias("_none"))
    p = positives.join(none, "grp", "left").join(first.where("cwe is not null"), ["grp", "cwe"], "left")
    return p.select("eid", F.least("_none", "_f").alias("fixed"))
