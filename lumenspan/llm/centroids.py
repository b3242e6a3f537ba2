"""Centroid clustering of integer vectors (Lloyd's rounds) by scalar lookup tables.

1. Vectors are read once and written as blocks.  A block holds up to ``BLOCK`` vectors: for each dimension the integer
   values that occur in it, and for each vector the place of its value among them (two bytes).
2. In a round every task tabulates, for each dimension, occurring value and centroid, the squared difference.  The
   distances of a block are gathers from these tables, summed over the dimensions; nothing is subtracted or squared per
   vector.  A task gives one partial sum for each cluster and dimension, Spark adds them up, and the driver gets
   ``clusters * (dimensions + 1)`` numbers.
3. Once centroids stay as they are, the rounds that are left wouldn't change them and are not run.

Memory: one block and its tables, which have no more entries than the block has components, times the clusters.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out, and so are those
with an integer of 62 bits or more, which no 64-bit distance could tell.  Rows with equal ids are vectors of their own;
if one of the smallest hashes is theirs, each of them starts a centroid, in the order of their components.  Rows without
an id are assigned like others but start no centroid.  With fewer vectors that can start one there are fewer centroids;
with none, and for an empty table, the result is empty.  A distance or sum that doesn't fit into 64 bits is null (the
assignment is still exact).  Equal distances go to the smaller number.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.store import Scratch, staged

#: Vectors of a block; their places have to fit into two bytes.
BLOCK = 8192
#: Integers below this bound have distances and block sums that fit into 64 bits, for up to 64 dimensions.
SMALL = 1 << 27
#: Integers from here on are left out.
LARGE = float(1 << 62)


def integer_vectors(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the integers ``floor(scale * component)`` of the vectors that are kept."""
    x = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    odd = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v * scale) >= LARGE))
    kept = x.where((F.size("e") == dims) & ~odd)
    return kept.select("vec_id", F.transform("e", lambda v: F.floor(v * scale)).alias("x"))


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(ids, values: per dimension those that occur, places: dimension after dimension, two bytes each)."""
    types = (pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = np.asarray(part.column("x").flatten()).reshape(-1, dims)
                coded = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
                places = np.concatenate([c.astype("<u2") for _, c in coded]).tobytes()
                row = (part.column("vec_id").to_pylist(), [v for v, _ in coded], places)
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], ["ids", "values", "places"])

    return vectors.mapInArrow(run, "ids array<long>, values array<array<long>>, places binary")


class Block:
    """One block; distances and sums are 64-bit numbers, or Python's where these wouldn't hold them."""

    def __init__(self, ids: pa.Array, values: pa.Array, places: bytes, centroids: list[list[int]]):
        self.ids, dims = ids, len(values)
        largest = max((abs(v) for c in centroids for v in c), default=0)
        self.values = [np.asarray(v) for v in values]
        if any(len(v) and max(abs(int(v[0])), abs(int(v[-1])), largest) >= SMALL for v in self.values):
            self.values = [v.astype(object) for v in self.values]
        self.type = self.values[0].dtype
        self.places = np.frombuffer(places, dtype="<u2").reshape(dims, -1)
        self.centroids = np.array(centroids, dtype=self.type)

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector and its squared distance."""
        total = np.zeros((len(self.ids), len(self.centroids)), dtype=self.type)
        for values, places, centre in zip(self.values, self.places, self.centroids.T, strict=True):
            table = values[:, None] - centre[None, :]
            table *= table
            total += table[places]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray) -> np.ndarray:
        """Per cluster the sum of each dimension and, last, the number of vectors."""
        out = np.zeros((len(self.centroids), len(self.values) + 1), dtype=object)
        x = np.stack([v[p] for v, p in zip(self.values, self.places, strict=True)], axis=1)
        for c in np.unique(cluster):
            own = x[cluster == c]
            out[c, :-1], out[c, -1] = own.sum(axis=0), len(own)
        return out


def _read(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]) -> Iterator[Block]:
    for batch in batches:
        ids, values, places = (batch.column(c) for c in ("ids", "values", "places"))
        for i in range(batch.num_rows):
            yield Block(ids[i].values, [v.values for v in values[i]], places[i].as_py(), centroids)


def _partial_sums(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _read(batches, centroids):
            own = block.sums(block.nearest()[0])
            total = own if total is None else total + own
        if total is not None:
            cluster, place = np.indices(total.shape)
            sums = pa.array([Decimal(int(v)) for v in total.ravel()], pa.decimal128(38, 0))
            arrays = [pa.array(cluster.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), sums]
            yield pa.RecordBatch.from_arrays(arrays, ["cluster", "place", "total"])

    return table.mapInArrow(run, "cluster int, place int, total decimal(38,0)")


def _assigned(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches, centroids):
            cluster, distance = block.nearest()
            if distance.dtype == object:
                distance = [d if d < 1 << 63 else None for d in distance]
            arrays = [block.ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest SHA-256 of ``seed:vec_id``."""
    named = vectors.where("vec_id is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["x"]) for r in named.orderBy(order, "x").limit(clusters).collect()]


def cluster_vectors(table: DataFrame, clusters: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of ``table`` (vec_id, embedding)."""
    vectors = integer_vectors(table, dims, scale)
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        none = "cast(null as int) cluster, vec_id distance, vec_id cluster_inertia, vec_id inertia, cast(null as string) centroid_sha256"
        return vectors.limit(0).selectExpr("vec_id", *none.split(", "))
    with Scratch(table.sparkSession) as scratch:
        coded = scratch.staged(blocks(vectors, dims), "blocks")
        for _ in range(rounds):
            new = [list(c) for c in centroids]
            sums = {(r["cluster"], r["place"]): int(r["total"]) for r in _partial_sums(coded, centroids).groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()}
            for c in range(len(centroids)):
                count = sums.get((c, dims), 0)
                if count:
                    new[c] = [sums[c, d] // count for d in range(dims)]
            if new == centroids:
                break
            centroids = new
        # The rows take less room than the blocks, which go.
        rows = staged(_assigned(coded, centroids), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    found = rows.groupBy("cluster").agg(exact.alias("total"), F.max(F.col("distance").isNull()).alias("lost")).collect()
    total = {r["cluster"]: None if r["lost"] else int(r["total"]) for r in found}
    whole = None if None in total.values() else sum(total.values())

    def long(v: int | None) -> int | None:
        return v if v is not None and v < 1 << 63 else None

    def by_cluster(values: list, kind: str):
        return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster"))

    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster([long(total.get(c)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(long(whole)).cast("long").alias("inertia"),
        by_cluster(hashes, "string").alias("centroid_sha256"),
    )


def clustering_sql(clusters: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """The same rows in DuckDB's SQL, a pair of tables for each round."""
    of_item = f"sha256('{seed}:' || vec_id)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT {of_item} AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clusters})
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x,
    min({{'d': list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 'c': c.c}}) AS best
  FROM v, c{i} c GROUP BY v.r
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(n.x, c.x) AS x
  FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS x
    FROM (SELECT c, p, sum(e) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(x) AS e, unnest(range({dims})) AS p FROM a{i}) GROUP BY c, p)
    GROUP BY c
  ) n ON n.c = c.c
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = best.c"""
