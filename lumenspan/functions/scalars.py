"""Scalar column builders: logistic functions, losses, vectors and token classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Stable in both tails."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clipped_logit(p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.ln(q / (1 - q))


def platt(x: Column, a: float, t: float) -> Column:
    return sigmoid((x - a) / t)


def bce_with_logits(z: Column, y: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) - z * y + F.ln(1 + F.exp(-F.abs(z)))


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def logsumexp(x: Column, tau: float = 1.0) -> Column:
    top = F.array_max(x)
    return top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp((v - top) * tau))) / tau


def normalized_cwe(s: Column) -> Column:
    """``cwe-022`` -> ``CWE-022``."""
    return F.upper(F.trim(s))


def cwe_key(s: Column) -> Column:
    """``CWE-022`` -> ``CWE-22``; only zeros -> ``CWE-0``."""
    n = F.regexp_replace(normalized_cwe(s), r"^CWE-0*(\d*)$", "$1")
    return F.concat(F.lit("CWE-"), F.when(n == "", "0").otherwise(n))


def uniform_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5; the same in other engines."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Cumulative Poisson(1) probabilities; a resample draws how many of them a uniform number passes.
POISSON_1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def poisson_weight(u: Column) -> Column:
    out = F.lit(0)
    for c in POISSON_1:
        out = out + (u >= c).cast("int")
    return out


def unit(x: Column) -> Column:
    """The vector over its length; NULLs where that is 0."""
    n = F.nullif(norm(x), F.lit(0.0))
    return F.transform(x, lambda v: v / n)


def gated_sum(gates: Column, values: Column) -> Column:
    """Values weighted by the softmax of the gates."""
    top = F.array_max(gates)
    e = F.transform(gates, lambda g: F.exp(g - top))
    return dot(e, values) / F.aggregate(e, F.lit(0.0), lambda s, v: s + v)


def all_finite(x: Column) -> Column:
    return ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def min_max(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``value`` between the least (0) and greatest (1) of its group; 0 where all are equal."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    return df.join(ends, by).withColumn(out, F.coalesce((F.col(value) - F.col("_lo")) / width, F.lit(0.0))).drop("_lo", "_hi")


def standardised(acts: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``z``: each dimension of ``x`` less its group's mean, over its population deviation (1 where that is 0)."""
    dims = acts.select(*by, F.posexplode("x").alias("i", "v")).groupBy(*by, "i").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    packed = F.sort_array(F.collect_list(F.struct("i", "mu", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd"))))
    # One row per group and as many numbers as a vector has.
    stats = dims.groupBy(*by).agg(packed.alias("_s"))
    return acts.join(stats, by).withColumn("z", F.zip_with("x", "_s", lambda v, s: (v - s["mu"]) / s["sd"])).drop("_s")


def json_row(df: DataFrame) -> DataFrame:
    """(json): every row as a JSON object; numbers that are none become null."""
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*clean)).alias("json"))
