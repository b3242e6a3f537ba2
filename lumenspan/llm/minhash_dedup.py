"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, verification.

1. A document's set is that of its word shingles.  Documents with equal sets form a class; one of each goes on.
2. Its shingles fall into ``REGISTERS`` buckets by hash.  A register keeps of the least hash in its bucket the number of
   leading zeros and the ``MANTISSA`` bits behind the first one, 16 bits together.
3. Four registers make a band, whose 64 bits are a key; bands of empty registers are none.  Sets of 14 shingles and more
   that are similar enough share two keys but for a chance of about 2e-9 (0.85 similar, 32 bands of four; smaller sets
   have fewer bands, of which at most one for each unlike shingle differs).  Sets of up to 15 shingles are listed whole
   and without each one or two that a similar set may lack: exact, and no frequent shingle becomes a key.
4. Candidates are not all pairs of a key: for a few turns each document is compared with one hub of its groups, and
   groups that have become one component are done.  What is then still open is listed again by pairs of keys of one of
   four classes, so that a key which many unlike documents have makes no pairs by itself; similar documents that share
   five keys share two of a class, all but about 3e-7 of those at the limit.
5. Each candidate pair's similarity is estimated from both documents' registers, less the collisions that unlike hashes
   of these sizes have; pairs more than ``SPARE`` standard deviations below the limit go.  The rest is confirmed on the
   full sets.

Cases, as in the n-gram join: a null text or one without words has an empty set, links with nothing and is its own
component.  Fewer words than a shingle has: the whole sequence is the one shingle.  Equal sets are linked.  Repeated
rows with one doc_id are one node and give a row each; one doc_id with several texts links them.  Rows with a null
doc_id link by their text only, and have a null component if no document with an id is reached; they are then kept.  An
empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.components import connected_components
from lumenspan.llm.jaccard_join import (
    HUB_TURNS,
    _by_row,
    _hub_pairs,
    _links,
    _only,
    _open_rows,
    _repeats,
    _similar_parity,
    _similar_size,
    _with_stars,
    shingle_sets,
)
from lumenspan.llm.words import WordHashes, shingle_set
from lumenspan.store import Scratch, broadcast_if_small, staged

#: Buckets of a sketch and bits of a mantissa; a register has 16 bits.
REGISTERS, BUCKET_BITS, MANTISSA = 128, 7, 10
EMPTY = 0xFFFF
#: Registers of a band: their bits are a key of 64.
BAND = 4
#: Sets of so many shingles at most are listed with what a similar set may lack; those of TINY - 1 or more by bands.
TINY = 15
#: Classes of open keys, and how many of a member's keys in a class tell at which of them a pair is made.
CLASSES, FIRST_KEYS = 4, 12
#: An estimate so many standard deviations below the limit counts as unlike.
SPARE = 6.5


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted distinct 64-bit hashes."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        # Sorted hashes: the first of a bucket is its least.  53 bits of it, so that floats hold them.
        rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)
        fraction, length = np.frexp(rest.astype(np.float64))
        zeros = np.minimum(53 - length, 62)
        mantissa = ((fraction * 2 - 1).clip(0) * (1 << MANTISSA)).astype(np.int64)
        out[bucket[first]] = (zeros << MANTISSA | mantissa).astype(np.uint16)
    return out


def _missing(n: int, percent: int) -> int:
    """How many shingles of a set of ``n`` a similar set can lack."""
    return n + -(n * percent // 100) - (1 if n * percent % 100 else 0)


def candidate_keys(hashes: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The keys a set is listed by."""
    n, keys = len(hashes), []
    if n >= TINY - 1:
        bands = sketch.reshape(-1, BAND)
        own = bands.view(np.uint64).ravel() * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(bands), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys.append(own[(bands != EMPTY).any(axis=1)])
    if n <= TINY:
        whole = hashes.sum(dtype=np.uint64)
        for gone in range(_missing(n, percent) + 1):
            less = [int(sum(map(int, c))) for c in combinations(hashes, gone)]
            keys.append(np.array([(int(whole) - x) * 0xBF58476D1CE4E5B9 + 1 & 0xFFFFFFFFFFFFFFFF for x in less], dtype=np.uint64))
    return np.unique(np.concatenate(keys))


SKETCH = "doc_id long, n long, fp1 long, fp2 long, registers binary, keys array<long>"


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, fp1 and fp2: fingerprints of the set, registers, keys)."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), ([], [], [], [], [])
                for text in part.column("text").to_pylist():
                    s = shingle_set(words.array((text or "").encode().lower().split()), k)
                    mixed = s * np.uint64(0xD6E8FEB86659FD93)
                    sums = np.array([s.sum(dtype=np.uint64), (mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64)], dtype=np.uint64)
                    sketch = registers(s)
                    keys = candidate_keys(s, sketch, percent) if len(s) else s
                    row = (len(s), *sums.view(np.int64).tolist(), sketch.tobytes(), keys.view(np.int64))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                arrays = [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "fp1", "fp2", "registers", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def collision_share(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How often registers of unlike least hashes are equal, for sets of ``n`` and ``m``.

    Least hashes of a bucket lie as exponentials with rates n and m; two of them collide in a cell, which is between
    2**-MANTISSA and half of that of the value wide, log-uniformly: 1 / (2 ln 2) of the widest on average.
    """
    return n * m / (n + m) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)


def estimates(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corrected Jaccard similarity of sketches, a row for each pair, and the buckets it rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    share = collision_share(n.astype(float), m.astype(float))
    return (same - share * used) / (used * (1 - share)), used


def likely(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate doesn't speak against them; ``drawn``: (id, n, registers)."""
    one, two = (drawn.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("registers").alias(f"{c}_registers")) for c in "ab")
    limit = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"{c}_registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in "ab")
                found, used = estimates(x, y, np.asarray(batch.column("a_n")), np.asarray(batch.column("b_n")))
                good = found >= limit - SPARE * np.sqrt(limit * (1 - limit) / used)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long")


def near_links(docs: DataFrame, drawn: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links that give the components of the class representatives ``drawn`` (id, n, registers, keys)."""
    keyed = drawn.select("id", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    listed = keyed.join(sizes, "key").select(F.lit(0).alias("level"), "key", "id", "n", F.log2("size").alias("typical"), "size")
    listed = scratch.staged(listed, "keys")
    needed = listed.select("id").distinct()
    drawn = scratch.staged(_only(drawn.select("id", "n", "registers"), "id", needed), "registers")
    whole = shingle_sets(_only(docs, "doc_id", needed), k, percent, whole=True)
    sets = scratch.staged(whole.select(F.col("doc_id").alias("id"), "tokens", "parity"), "sets")
    compared, components, rows = None, None, None

    def confirmed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that are new, and those of them that are links."""
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        tried = scratch.staged(pairs, "pairs")
        found = scratch.staged(_links(likely(tried, drawn, percent), sets, percent), "links")
        return tried, found.where("linked").select("a", "b")

    for turn in range(HUB_TURNS):
        scratch.drop(rows)
        rows = listed.withColumn("component", F.col("id")) if components is None else _open_rows(listed, components, sets, scratch)
        tried, linked = confirmed(_hub_pairs(rows, turn, percent))
        compared = tried if compared is None else compared.unionAll(tried)
        if components is None or not linked.isEmpty():
            before, components = components, scratch.staged(connected_components(_with_stars(components, linked)), "components")
            scratch.drop(before)
    scratch.drop(rows)
    _, last = confirmed(_pairs_of_two_keys(_open_rows(listed, components, sets, scratch), percent, scratch))
    return _with_stars(components, last)


def _of_class(keys: str, c: int) -> Column:
    # A function of one argument: Spark gives a second one the element's place.
    return F.filter(keys, lambda x: F.pmod(x, F.lit(CLASSES)) == c)


def _pairs_of_two_keys(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): members of different components that may be similar and share two open keys of a class; tiny sets share one.

    A pair that is similar and still apart has none of its keys among the groups that are done, so all it shares is open.
    Keys fall into ``CLASSES`` by bits of their own, which keeps a member's combinations few.  In each class a pair is made
    at the first two keys it shares; ``own`` are a member's first few of the class.
    """
    by_id = rows.groupBy("id").agg(
        F.first("n").alias("n"), F.first("component").alias("component"), F.first("parity").alias("parity"), F.collect_set("key").alias("keys")
    )
    # Half a key each, the one that all of its bits have a part in; two of them make a whole one again.
    half = F.array_sort(F.transform("keys", lambda x: F.shiftrightunsigned(x, 33).cast("int")))
    by_class = by_id.withColumn("half", half).select(
        "id", "n", "component", "parity", F.explode(F.array(*[_of_class("half", c) for c in range(CLASSES)])).alias("all")
    )
    later = F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda y: F.xxhash64(x, y))))
    names = ("id", "n", "component", "parity", "own")
    open_keys = by_class.where("size(all) > 1").select("id", "n", "component", "parity", F.slice("all", 1, FIRST_KEYS).alias("own"), F.explode(later).alias("key"))
    tiny = by_id.where(F.col("n") <= TINY).select("id", "n", "component", "parity", F.array().cast("array<int>").alias("own"), F.explode("keys").alias("key"))
    open_keys = open_keys.unionAll(tiny)
    ends = open_keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_keys = scratch.staged(open_keys.join(ends, "key"), "two-keys")
    other = open_keys.select("key", *(F.col(c).alias(f"{c}2") for c in names))
    both = F.array_intersect("own", "own2")
    pairs = open_keys.join(other, "key").where(
        (F.col("id") < F.col("id2"))
        & (F.col("component") != F.col("component2"))
        & _similar_size("n", "n2", percent)
        & _similar_parity(percent)
        & F.when(F.size(both) >= 2, F.xxhash64(both[0], both[1]) == F.col("key")).otherwise(True)
    )
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _grouped(docs, k, percent).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        drawn = scratch.staged(sketches(docs, k, percent), "sketches")
        table = staged(drawn.select("doc_id", "n", "fp1", "fp2"), "documents")
        members = table.where("n > 0 and doc_id is not null").distinct()
        classes = staged(members.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
        if members.groupBy("doc_id").count().where("count > 1").limit(1).count():
            return _by_row(docs, k, percent, _grouped)
        repeats = _repeats(docs)
        named = drawn.where("n > 0 and doc_id is not null")
        reps = _only(named.dropDuplicates(["doc_id"]) if repeats else named, "doc_id", classes.select("rep"))
        reps = scratch.staged(reps.select(F.col("doc_id").alias("id"), "n", "registers", "keys"), "representatives")
        scratch.drop(drawn)
        one_each = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if repeats else docs
        components = staged(connected_components(near_links(one_each, reps, k, percent, scratch)), "components")
    classes = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id")
    )
    found = table.join(classes, ["n", "fp1", "fp2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
