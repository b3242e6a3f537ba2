"""Connected components of a link table, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.store import Scratch


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> (id, component), the smallest id that links lead to; ids without a link don't appear.

    Alternates two steps on the links until they are stars around their smallest id: every id sends its larger
    neighbours to its smallest one, then its smaller ones.  Each round halves long chains; a hub never gathers its
    neighbours, since only minima per id are taken.  Raises if ``rounds`` don't suffice.
    """
    scratch = Scratch(links.sparkSession)
    both = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = scratch.staged(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    before = edges.agg(F.count("*"), same).first()
    for _ in range(rounds):
        # Large star: larger neighbours of u go to u's smallest neighbour (or u).
        sides = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = scratch.staged(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = new.agg(F.count("*"), same).first()
        scratch.drop(edges)
        edges = new
        if before == after:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
