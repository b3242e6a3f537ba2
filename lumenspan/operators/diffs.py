"""What of a text its fix replaces or deletes, as character ranges."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.functions.text import common_prefix, whole_lines
from lumenspan.operators.intervals import merge_spans
from lumenspan.store import staged

#: For ``changed`` only: longer texts are compared line by line, and texts of more lines count as changed in whole.
MOST_CHARS, MOST_LINES = 6000, 4000
#: Pairs to a task.
PAIRS = 200
#: Texts of more pairs of characters are compared by ranks of pieces, smaller ones by the standard matcher.
SEARCHED = 20_000
#: Pieces up to this length are taken length by length.
LONG = 32
SPAN = pa.struct([("s", pa.int64()), ("e", pa.int64())])


def _places(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of ranges that begin at ``lo``, one range after the other."""
    return np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


class Matcher(difflib.SequenceMatcher):
    """The same blocks as the standard matcher without junk, in steps by length instead of one block after the other.

    The standard matcher takes a block's longest common piece, the first in ``a`` and then in ``b``, and goes on to the left
    and to the right of it.  To the left no piece is as long, as it would have come first; to the right one may be.  So a
    block's pieces of one length are taken from left to right at once, and what lies between them has shorter pieces only.
    All blocks take a step together: those with pieces longer than ``LONG`` each at its own longest length, which is found
    by halving, then all the others length by length.  Pieces are known by the ranks of their first and last power of two.
    """

    def __init__(self, a: str, b: str):
        super().__init__(None, a, b, autojunk=False)
        self.ranks: list[np.ndarray] = []
        if len(a) * len(b) > SEARCHED:
            rank = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            while not self.ranks or np.isin(rank[: len(a) - 2 ** len(self.ranks) + 1], rank[len(a) :]).any():
                rank, size = np.unique(rank, return_inverse=True)[1].astype(np.int64), 2 ** len(self.ranks)
                self.ranks.append(np.append(rank, np.zeros(size - 1, dtype=np.int64)).astype(np.int32))
                if 2 * size > min(len(a), len(b)):
                    break
                rank = rank[: len(rank) - size] * (len(a) + len(b) + 1) + rank[size:]

    def _shared(self, blocks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of ``a`` whose pieces, of its block's size, the block has in ``b`` too: block, place, and from where to
        where the piece's places in ``b`` lie in the last array."""
        room = np.flatnonzero(np.minimum(blocks[:, 1] - blocks[:, 0], blocks[:, 3] - blocks[:, 2]) >= sizes)
        level = np.log2(sizes[room]).astype(np.int64)
        rest, keys, at, of = sizes[room] - 2**level, [], [], []
        for lo, hi, base in ((0, 1, 0), (2, 3, len(self.a))):
            n = blocks[room, hi] - blocks[room, lo] - sizes[room] + 1
            at.append(_places(blocks[room, lo], n))
            of.append(np.repeat(room, n))
            own, place = np.repeat(level, n), at[-1] + base
            keys.append(self.table[own, place].astype(np.int64) * (len(self.a) + len(self.b) + 1) + self.table[own, place + np.repeat(rest, n)])
        # Pieces by their place among those of b, so that block and piece make one number.
        known = np.append(np.unique(keys[1]), -1)
        one, two = (np.searchsorted(known[:-1], k) for k in keys)
        found = np.flatnonzero(known[one] == keys[0])
        one, two = of[0][found] * len(known) + one[found], of[1] * len(known) + two
        order = np.argsort(two, kind="stable")
        first, last = (np.searchsorted(two[order], one, side=side) for side in ("left", "right"))
        own = first < last
        return of[0][found][own], at[0][found][own], first[own], last[own], at[1][order]

    def _having(self, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.isin(np.arange(len(blocks)), self._shared(blocks, sizes)[0])

    def _taken(self, blocks: np.ndarray, sizes: np.ndarray, shared: tuple[np.ndarray, ...]) -> np.ndarray:
        """Takes the shared pieces from left to right; the blocks that are left."""
        *columns, places = (x.tolist() for x in shared)
        left, block, alo, ahi, blo, bhi, size = [], -1, 0, 0, 0, 0, 0
        for own, i, first, last in zip(*columns, strict=True):
            if own != block:
                left.append((alo, ahi, blo, bhi))
                block, (alo, ahi, blo, bhi), size = own, blocks[own].tolist(), int(sizes[own])
            if i >= alo and (k := bisect_left(places, blo, first, last)) < last:
                j = places[k]
                self.pieces.append((i, j, size))
                left.append((alo, i, blo, j))
                alo, blo = i + size, j + size
        left.append((alo, ahi, blo, bhi))
        blocks = np.concatenate([np.delete(blocks, np.unique(shared[0]), axis=0), np.array(left, dtype=np.int64)])
        return blocks[(blocks[:, 0] < blocks[:, 1]) & (blocks[:, 2] < blocks[:, 3])]

    def get_matching_blocks(self) -> list[difflib.Match]:
        if not self.ranks:
            return super().get_matching_blocks()
        self.table, self.pieces = np.stack(self.ranks), []
        blocks, most = np.array([[0, len(self.a), 0, len(self.b)]]), 2 ** len(self.ranks) - 1
        done = [np.empty((0, 4), dtype=np.int64)]
        while len(blocks) and most > LONG:
            long = self._having(blocks, np.full(len(blocks), LONG + 1))
            done.append(blocks[~long])
            blocks = blocks[long]
            low, high = np.full(len(blocks), LONG + 1), np.minimum(np.minimum(blocks[:, 1] - blocks[:, 0], blocks[:, 3] - blocks[:, 2]), most)
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_] + 1) // 2
                has = self._having(blocks[open_], middle)
                low[open_[has]], high[open_[~has]] = middle[has], middle[~has] - 1
            if len(blocks):
                blocks = self._taken(blocks, low, self._shared(blocks, low))
        blocks = np.concatenate([*done, blocks])
        for size in range(min(LONG, most), 0, -1):
            sizes = np.full(len(blocks), size)
            blocks = self._taken(blocks, sizes, self._shared(blocks, sizes))
        out: list[difflib.Match] = []
        for i, j, k in sorted(self.pieces):
            if out and (out[-1].a + out[-1].size, out[-1].b + out[-1].size) == (i, j):
                out[-1] = out[-1]._replace(size=out[-1].size + k)
            else:
                out.append(difflib.Match(i, j, k))
        return [*out, difflib.Match(len(self.a), len(self.b), 0)]


def changed_characters(before: str, after: str) -> list[tuple[int, int]]:
    """Ranges of ``before`` that the edit to ``after`` replaces or deletes, by characters at any length."""
    return [(i, j) for tag, i, j, _, _ in Matcher(before, after).get_opcodes() if tag in ("replace", "delete")]


def changed(before: str, after: str) -> tuple[list[tuple[int, int]], str]:
    """The same by characters for short texts only, and how the ranges were found; a guard that no query uses."""
    if len(before) <= MOST_CHARS and len(after) <= MOST_CHARS:
        return changed_characters(before, after), "chars"
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    if len(a) > MOST_LINES or len(b) > MOST_LINES:
        return [(0, len(before))], "whole"
    starts = [0]
    for line in a:
        starts.append(starts[-1] + len(line))
    ops = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [(starts[i], starts[j]) for tag, i, j, _, _ in ops if tag in ("replace", "delete")], "lines"


def diff_spans(pairs: DataFrame, key: str) -> DataFrame:
    """(key, before, after) -> (key, spans, how); a NULL text counts as empty, and all texts are compared by characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = [changed_characters(a or "", b or "") for a, b in zip(batch.column("before").to_pylist(), batch.column("after").to_pylist(), strict=True)]
                spans = pa.array([[{"s": s, "e": e} for s, e in x] for x in found], pa.list_(SPAN))
                yield pa.RecordBatch.from_arrays([batch.column(key), spans, pa.array(["chars"] * len(found))], [key, "spans", "how"])

    # Work goes with the pairs and not with their bytes, by which partitions would be put together.
    rows = pairs.selectExpr(f"cast(`{key}` as long) as `{key}`", "before", "after")
    rows = staged(rows, "pairs")
    rows = rows.repartition(max(1, -(-rows.count() // PAIRS)), key)
    return rows.mapInArrow(run, f"`{key}` long, spans array<struct<s: long, e: long>>, how string")


def blamed_lines(pairs: DataFrame) -> DataFrame:
    """(eid, before, after) -> (eid, s, e, how): whole lines of ``before`` that its fix changes.

    Ranges that are replaced or deleted, grown to lines and merged; without any, the line where the fix inserts, which
    is where the texts' common beginning ends; the whole text where that is empty.
    """
    found = diff_spans(pairs, "eid").select("eid", F.explode("spans").alias("r")).select("eid", "r.s", "r.e").where("s < e")
    s, e = whole_lines("before", "s", "e")
    own = found.join(pairs.select("eid", "before"), "eid").select("eid", s.cast("long").alias("s"), e.cast("long").alias("e"))
    own = merge_spans(own, ["eid"]).select("eid", "s", "e", F.lit("deleted").alias("how"))
    rest = pairs.join(found.select("eid").distinct(), "eid", "left_anti")
    rest = rest.withColumn("s", F.greatest(F.lit(0), F.least(common_prefix(F.col("before"), F.col("after")), F.length("before") - 1))).withColumn("e", F.col("s") + 1)
    empty = F.length("before") == 0
    start, end = F.when(empty, 0).otherwise(s), F.when(empty, F.length("before")).otherwise(e)
    how = F.when(empty, "whole").otherwise("inserted")
    return own.unionByName(rest.select("eid", start.cast("long").alias("s"), end.cast("long").alias("e"), how.alias("how")))
