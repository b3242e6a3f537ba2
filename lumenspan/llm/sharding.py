"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard has ``vnodes`` points on a ring of 60-bit positions, every row one position of its own.  A row belongs to
the next point clockwise; once that point's shard is full, the row continues clockwise to the next shard with room.
Shard capacities add up to the number of rows exactly (they differ by one at most), so every shard ends full: row
counts are at most one apart, and rows move only out of shards that overflow.

The rows are never walked in ring order.  All rows of one arc take the same way, so the overflow is settled on counts
per arc, of which there are ``shards * vnodes`` whatever the data's size; rows then look up their share by their rank
in the arc.  Ranks are counted in two steps (within a part of the arc, then over the parts' sums), so an arc that many
equal keys fall into isn't gathered in one task.

Cases: a null text has size 16 and CRC 0; a null id is placed by the text's CRC and size.  Repeated rows get slots of
their own.  An empty table gives an empty result.  Other columns are not carried.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.store import staged

RING = 1 << 60


def position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def position_column(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard), clockwise."""
    return sorted((position(f"shard {s} point {v}"), s) for s in range(shards) for v in range(vnodes))


def settle(points: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    First every shard takes the rows of its own arcs up to its capacity, in ring order; what is left over then moves
    clockwise, arc by arc, to the next shards that have room.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []

    def give(arc: int, first: int, shard: int, most: int) -> int:
        n = min(most, room[shard] - used[shard])
        if n:
            out.append((arc, first, first + n, shard, used[shard]))
            used[shard] += n
        return n

    for arc, (_, shard) in enumerate(points):
        if n := counts.get(arc, 0):
            taken = give(arc, 0, shard, n)
            if taken < n:
                over.append((arc, taken, n))
    for arc, first, end in over:
        at = arc
        while first < end:
            at = (at + 1) % len(points)
            first += give(arc, first, points[at][1], end - first)
    return out


def bounded_ring(docs: DataFrame, shards: int = 40, vnodes: int = 64, parts: int = 32) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    points = ring_points(shards, vnodes)
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 16).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    key = F.coalesce(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.concat_ws(" ", F.lit("text"), "text_crc32", "size")
    )
    bounds = [p for p, _ in points]
    keys = keys.withColumn("pos", position_column(key))
    # The arc of a position is how many ring points lie before it (past the last point: the first arc).  A join on the
    # position's slice of the ring leaves the few points of that slice to compare with; the table has a row for each
    # of the 1024 slices.
    slices = 1 << 10
    starts: list[list[int]] = [[] for _ in range(slices)]
    for p in bounds:
        starts[p // (RING // slices)].append(p)
    rows, before = [], 0
    for i, inside in enumerate(starts):
        rows.append((i, before, inside))
        before += len(inside)
    table = F.broadcast(spark.createDataFrame(rows, "slice int, points_before int, points array<bigint>"))
    keys = keys.withColumn("slice", F.shiftright("pos", 50).cast("int")).join(table, "slice")
    arc = F.col("points_before") + F.size(F.filter("points", lambda p: p < F.col("pos")))
    keys = keys.withColumn("arc", F.pmod(arc, F.lit(len(bounds))).cast("int")).drop("slice", "points_before", "points")
    # Which task read the row is part of its rank, so the rows are fixed first.
    keys = staged(keys.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts))), "ring-keys")
    sums = keys.groupBy("arc", "part").count()
    before_part = F.coalesce(
        F.sum("count").over(Window.partitionBy("arc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    sums = staged(sums.withColumn("before", before_part), "ring-sums")
    counts = {r["arc"]: r["n"] for r in sums.groupBy("arc").agg(F.sum("count").alias("n")).collect()}
    plan = settle(points, counts, shards)
    schema = "arc int, first long, end long, shard int, first_slot long"
    # At most one row for each arc and one for each time a shard fills up: bounded by the ring, not by the data.
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))
    within = F.row_number().over(Window.partitionBy("arc", "part").orderBy("pos", "doc_id", "text_crc32")) - 1
    # arcs * parts rows at most.
    ranked = keys.withColumn("within", within).join(F.broadcast(sums.select("arc", "part", "before")), ["arc", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    placed = ranked.join(plan_df, "arc").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("first")).alias("slot")
    )
