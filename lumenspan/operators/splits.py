"""Train and test sides of examples, leakage-aware.  Order of hashes replaces a shuffle, so splits are repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.functions.scalars import uniform_hash
from lumenspan.store import broadcast_if_small, staged


def group_key(repo: Column, file: Column, func: Column, code: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(filled(repo), F.concat(F.lit("repo::"), repo))
        .when(filled(file) | filled(func), F.concat(F.lit("func::"), F.coalesce(file, F.lit("")), F.lit("::"), F.coalesce(func, F.lit(""))))
        .otherwise(F.concat(F.lit("row::"), F.substring(F.sha1(code), 1, 12)))
    )


def ranked(df: DataFrame, by: list[str], key: Column, tie: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds ``out``: the row's place from 1 by ``key``, then ``tie``, in its group (``by``; none: in the table).

    Rows are counted by range of the key first, ranges are offset by the sums of those before them, and places are
    counted inside a range; so a group that holds a large share of all rows, or all, is not put in order in one task.
    """
    rows = df.withColumn("_key", key.cast("double"))
    cuts = rows.agg(F.percentile_approx("_key", [i / buckets for i in range(1, buckets)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= F.col("_key"))) if cuts else F.lit(0)
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = [F.col(c).alias(f"_s{i}") for i, c in enumerate(by)]
    sums = sums.select(*own, F.col("_part").alias("_p2"), before.alias("_before"))
    cond = F.col("_part") == F.col("_p2")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_s{i}"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_key", tie))
    rows = rows.withColumn("_within", within).join(sums, cond)
    return rows.select(*df.columns, (F.col("_before") + F.col("_within")).alias(out))


def random_split(ex: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """A fifth of each label is test."""
    n = ex.groupBy("row_label").agg(F.count("*").alias("_all"))
    r = ranked(ex, ["row_label"], uniform_hash(F.lit(seed), "eid"), "eid", "_r").join(n, "row_label")
    return r.withColumn("side", F.when(F.col("_r") <= F.round(F.col("_all") * share), "test").otherwise("train")).drop("_r", "_all")


def _group_places(ex: DataFrame, seed: int) -> DataFrame:
    """(grp, _r, _all): each group's place by its hash, and how many there are."""
    groups = staged(ex.select("grp").distinct(), "groups")
    return ranked(groups, [], uniform_hash(F.lit(seed), "grp"), "grp", "_r").crossJoin(F.broadcast(groups.agg(F.count("*").alias("_all"))))


def group_split(ex: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """Whole groups are test: max(1, round(share of groups)), in order of their hash."""
    most = F.greatest(F.lit(1), F.round(F.lit(share) * F.col("_all")))
    side = _group_places(ex, seed).select("grp", F.when(F.col("_r") <= most, "test").otherwise("train").alias("side"))
    return ex.join(side, "grp")


def group_folds(ex: DataFrame, k: int, seed: int) -> DataFrame:
    """Folds of whole groups, of equally many groups; the first ones have one more where they don't come out even."""
    place, size, more = F.col("_r") - 1, F.floor(F.col("_all") / k), F.col("_all") % k
    cut = more * (size + 1)
    fold = F.when(place < cut, F.floor(place / (size + 1))).otherwise(more + F.floor((place - cut) / F.nullif(size, F.lit(0))))
    return ex.join(_group_places(ex, seed).select("grp", (fold + 1).cast("int").alias("fold")), "grp")


def with_validation(ex: DataFrame, seed: int, test_share: float, share: float) -> DataFrame:
    """``side`` test, val or train: the validation groups are carved out of the training groups, with the next seed."""
    split = group_split(ex, seed, test_share)
    inner = group_split(split.where("side = 'train'").drop("side"), seed + 1, share).select("grp", F.col("side").alias("_inner")).distinct()
    side = F.when(F.col("side") == "test", "test").when(F.col("_inner") == "test", "val").otherwise("train")
    return split.join(inner, "grp", "left").withColumn("side", side).drop("_inner")


def all_splits(ex: DataFrame, seed: int, classes: int) -> DataFrame:
    """(split_name, eid, row_label, side) of the random, group, held-out class and held-out language splits."""
    named = lambda df, name: df.select(F.lit(name).alias("split_name"), "eid", "row_label", "side")
    out = named(random_split(ex, seed), "random").unionByName(named(group_split(ex, seed), "group_repo"))
    out = out.unionByName(leave_one_out(ex, "cwe", top_classes(ex, classes), "heldout_cwe"))
    return out.unionByName(leave_one_out(ex, "lang", ex.select("lang").distinct(), "heldout_lang"))


def negative_cap(positives: int, most: int = 60_000, each: int = 25, least: int = 2_000) -> int:
    return min(most, max(each * positives, least))


#: Stretches of the hash that rows are counted by.
STRETCHES = 4096


def sampled(rows: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """``n`` rows in order of their hash.

    Rows are counted by stretches of the hash; only those up to the stretch that holds the n-th are put in order.
    """
    key = uniform_hash(F.lit(seed), *keys)
    stretch, before, last = F.floor(key * STRETCHES), 0, -1
    # At most STRETCHES rows.
    for s, k in sorted((r["s"], r["k"]) for r in rows.groupBy(stretch.alias("s")).agg(F.count("*").alias("k")).collect()):
        if before >= n:
            break
        before, last = before + k, s
    return ranked(rows.where(stretch <= last), [], key, keys[-1], "_r").where(F.col("_r") <= n).drop("_r")


def masked_negatives(tok: DataFrame) -> DataFrame:
    """Training rows: all positives, and the negatives that are code."""
    return tok.where(F.col("is_code") | (F.col("y") == 1))


def partition_check(ids: DataFrame, parts: DataFrame) -> DataFrame:
    """How many ids are in several parts, and how many in none; both are 0 where the parts partition the ids."""
    n = parts.distinct().groupBy("eid").agg(F.count("*").alias("n"))
    return ids.join(n, "eid", "left").agg(F.count_if(F.col("n") > 1).alias("in_several"), F.count_if(F.col("n").isNull()).alias("in_none"))


def decoys(positives: DataFrame, negatives: DataFrame, k: int, seed: int) -> DataFrame:
    """(eid, decoy, place): up to ``k`` negatives of a positive's language, each of another group than the rest and its own.

    The groups of a language are put in a ring by their hash; a positive takes the k groups after a place of its own in
    the ring (its own group left out), and from each a negative by a hash.  No positive meets more than k negatives.
    """
    neg = ranked(negatives.select("lang", "grp", F.col("eid").alias("decoy")), ["lang", "grp"], F.col("decoy").cast("double"), "decoy", "_at")
    groups = negatives.groupBy("lang", "grp").agg(F.count("*").alias("_size"))
    groups = staged(ranked(groups, ["lang"], uniform_hash(F.lit(seed), "grp"), "grp", "_g").withColumn("_g", F.col("_g") - 1), "group-ring")
    rings = groups.groupBy("lang").agg(F.count("*").alias("_ring"))
    p = positives.select("eid", "lang", "grp").join(rings, "lang").join(groups.select("lang", "grp", "_g"), ["lang", "grp"], "left")
    p = p.withColumn("_g", F.coalesce("_g", F.lit(0))).where("_ring > 1")
    start = F.floor(uniform_hash(F.lit(seed), "eid") * (F.col("_ring") - 1))
    p = p.select("eid", "lang", "_ring", "_g", start.alias("_start"), F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.col("_ring") - 1))).alias("place"))
    p = p.withColumn("_g", (F.col("_g") + 1 + (F.col("_start") + F.col("place")) % (F.col("_ring") - 1)) % F.col("_ring"))
    p = p.join(groups.withColumnRenamed("grp", "_other"), ["lang", "_g"])
    p = p.withColumn("_at", F.floor(uniform_hash(F.lit(seed), "eid", "place") * F.col("_size")) + 1)
    return p.join(neg.withColumnRenamed("grp", "_other"), ["lang", "_other", "_at"]).select("eid", "decoy", "place")


def sampled_decoys(positives: DataFrame, negatives: DataFrame, k: int, seed: int) -> DataFrame:
    """(eid, decoy, place): ``k`` different negatives of other groups than the positive's, of its language where that has
    so many, else of any; fewer only where all languages together have fewer.

    The negatives of a language, and all of them, are put in a ring in which groups stand together.  A positive's own
    group is one stretch of a ring; it takes places at equal distances from a start of its own in what is left.  Nothing
    is paired but a positive with its decoys, and a group of any size costs no more than its two ends.
    """
    neg = negatives.select("lang", "grp", F.col("eid").alias("decoy"))
    key = uniform_hash(F.lit(seed), "grp")
    own = ranked(neg, ["lang"], key, "decoy", "_at").select(F.concat(F.lit("="), "lang").alias("_ring"), "grp", "decoy", "_at")
    every = ranked(neg, [], key, "decoy", "_at").select(F.lit("*").alias("_ring"), "grp", "decoy", "_at")
    rings = staged(own.unionByName(every), "decoy-rings")
    sizes = rings.groupBy("_ring").agg(F.count("*").alias("_size"))
    blocks = rings.groupBy("_ring", "grp").agg((F.min("_at") - 1).alias("_from"), (F.max("_at") - F.min("_at") + 1).alias("_own"))
    p = positives.select("eid", "grp", F.explode(F.array(F.concat(F.lit("="), "lang"), F.lit("*"))).alias("_ring"))
    p = p.join(sizes, "_ring").join(blocks, ["_ring", "grp"], "left")
    p = p.select("eid", "_ring", F.coalesce("_own", F.lit(0)).alias("_own"), F.coalesce("_from", "_size").alias("_from"), (F.col("_size") - F.coalesce("_own", F.lit(0))).alias("_pool"))
    # The language's ring first, if its pool is large enough.
    fits = ((F.col("_ring") != "*") & (F.col("_pool") >= k)).cast("int")
    named = ("_ring", "_own", "_from", "_pool")
    p = p.groupBy("eid").agg(F.max_by(F.struct(*named), F.struct(fits, (F.col("_ring") == "*").cast("int"))).alias("r")).select("eid", "r.*").where("_pool > 0")
    take = F.least(F.lit(k), F.col("_pool"))
    start = F.floor(uniform_hash(F.lit(seed), "eid") * F.col("_pool"))
    p = p.select("eid", *named, start.alias("_start"), F.floor(F.col("_pool") / take).alias("_step"), F.explode(F.sequence(F.lit(1), take.cast("int"))).alias("place"))
    at = (F.col("_start") + (F.col("place") - 1) * F.col("_step")) % F.col("_pool")
    p = p.withColumn("_at", at + F.when(at >= F.col("_from"), F.col("_own")).otherwise(0) + 1)
    return p.join(rings.select("_ring", "_at", "decoy"), ["_ring", "_at"]).select("eid", "decoy", "place")


def leave_one_out(ex: DataFrame, column: str, values: DataFrame, name: str) -> DataFrame:
    """For each held-out value its rows are test and all others, NULL included, train; one-sided splits go."""
    held = values.select(F.col(column).alias("held")).distinct()
    # A value that no row has leaves no test side, one that all rows have no training side.
    sizes = ex.groupBy(F.col(column).alias("held")).agg(F.count("*").alias("_own"))
    whole = ex.agg(F.count("*").alias("_all"))
    two_sided = held.join(sizes, "held").crossJoin(F.broadcast(whole)).where("_own < _all").select("held")
    v = broadcast_if_small(staged(two_sided, "held-values"))
    rows = ex.crossJoin(v).withColumn("side", F.when(F.col(column).eqNullSafe(F.col("held")), "test").otherwise("train"))
    return rows.select(F.concat(F.lit(name + "::"), "held").alias("split_name"), "eid", "row_label", "side")


def top_classes(ex: DataFrame, k: int) -> DataFrame:
    """The classes with most positives; ties go to the one that appears first."""
    n = ex.where((F.col("row_label") == 1) & F.col("cwe").isNotNull()).groupBy("cwe").agg(F.count("*").alias("n"), F.min("eid").alias("first_eid"))
    return n.orderBy(F.desc("n"), "first_eid").limit(k)


def held_out_side(column: str, value: str) -> Column:
    """test where the column has the value, else train; rows without a value are train."""
    return F.when(F.col(column).eqNullSafe(F.lit(value)), "test").otherwise("train")


def adjacent_pairs(ex: DataFrame) -> DataFrame:
    """(grp, n_pairs, n_rejected): rows 2i and 2i + 1 of a group, by eid, are a pair if their labels are 1 and 0."""
    places = ranked(ex.select("grp", "eid", "row_label"), ["grp"], F.col("eid").cast("double"), "eid", "_r")
    p = places.groupBy("grp", F.floor((F.col("_r") - 1) / 2).alias("_i"))
    p = p.agg(F.count("*").alias("n"), F.min_by("row_label", "eid").alias("a"), F.max_by("row_label", "eid").alias("b"))
    ok = (F.col("n") == 2) & (F.col("a") == 1) & (F.col("b") == 0)
    return p.groupBy("grp").agg(F.count_if(ok).alias("n_pairs"), F.count_if(~ok).alias("n_rejected"))


def oversampled(ex: DataFrame, large: Column, small: Column, most: int = 8) -> DataFrame:
    """Rows of ``small`` are repeated round(large / small) times, ``most`` at most; copy i gets ``eid + i * (largest + 1)``."""
    n = ex.agg(F.count_if(large).alias("_many"), F.count_if(small).alias("_few"), (F.max("eid") + 1).alias("_step"))
    times = F.greatest(F.lit(1), F.least(F.round(F.col("_many") / F.nullif(F.col("_few"), F.lit(0))), F.lit(most))).cast("int")
    n = n.select("_step", F.coalesce(times, F.lit(1)).alias("_k"))
    copies = ex.where(small).crossJoin(F.broadcast(n)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    copies = copies.withColumn("eid", F.col("eid") + F.col("_step") * F.col("_i")).select(*ex.columns)
    return copies.unionByName(ex.where(~F.coalesce(small, F.lit(False))))


def negative_pools(ex: DataFrame, pools: dict[str, DataFrame]) -> DataFrame:
    """(pool, score, y): the same positives with each pool's negatives."""
    pos = ex.where("y = 1").select("score", "y")
    out = None
    for name, rows in pools.items():
        one = rows.select("score", "y").unionByName(pos).withColumn("pool", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with their place; groups are cut to n in every task before they meet."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
