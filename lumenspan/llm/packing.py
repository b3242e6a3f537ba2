"""Best-fit packing of documents into training sequences by a linear grouping scheme.

A document's token ids are cut into pieces only where it is longer than a sequence.  What has to be packed is then a
count for each length (at most ``capacity`` of them, whatever the data's size), and the plan is made on those counts:

1. Large lengths are put in order and split into groups of (nearly) equally many pieces; in a group every length is
   rounded up to the largest.  That leaves a problem of few sizes.
2. Its configurations (which sizes share a sequence) are optimised by a linear program with column generation.
3. The actual pieces take the places of the rounded sizes.
4. Small pieces, and those the rounded-down solution left over, go to the sequences where they fit best, longest first.

The plan is a list of runs: pieces of one length with ranks from a to b go to consecutive sequences.  Pieces look up
their run by length and rank; ranks are counted per task first and offset by the sums over tasks, so no length's
pieces are gathered in one task.

Cases: a null text is the empty text, which is one piece with the end id only.  A null doc_id is kept as null.
Repeated rows are documents of their own.  An empty table gives an empty result.  Other columns are not carried.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.store import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
#: The cache holds so many chunks of so many characters at most, about 60 MB.
CACHE, CACHE_CHARS = 300_000, 64
#: Fixed value: the pattern that cuts texts into pieces for this kind of file.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Chunks(dict):
    """Chunk -> its ids.  Forgets everything when it is full and keeps no long chunk: a task's memory stays bounded."""

    def __init__(self, encode, space: str):
        super().__init__()
        self.encode, self.space = encode, space

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(self.space + word)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids
        return ids


class TokenIds:
    """Little-endian 32-bit ids of a text, the ones ``tokenizers`` gives for a byte-level BPE file.

    ``tokenizers`` reads the file; its vocabulary goes as ranks to ``tiktoken``, which merges single chunks several
    times faster and to the same ids.  Byte-level BPE never merges across the pre-tokenizer's pieces, and a single
    space or line feed between other characters always starts a piece; so texts are cut there and each chunk's ids are
    looked up.  A text with white space of another form is encoded as a whole, one that holds an added token (such as
    an end mark written out) by ``tokenizers`` itself, which gives that token's id.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.decoders import ByteLevel

        tokenizer, bytes_of = Tokenizer.from_file(path), _byte_alphabet()
        self.tokenizer = tokenizer
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        ranks = {bytes(map(bytes_of.__getitem__, t)): i for t, i in tokenizer.get_vocab().items() if t not in self.added}
        assert isinstance(tokenizer.decoder, ByteLevel), "a byte-level BPE file is needed"
        self.encode = tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = _Chunks(self.encode, ""), _Chunks(self.encode, " ")
        self.line_feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        lines = [line.split(" ") for line in text.split("\n")]
        if sum(map(len, lines)) != len(text.split()):
            return self.whole(text)
        f, g = self.first.__getitem__, self.later.__getitem__
        return self.line_feed.join([b"".join([f(words[0]), *map(g, words[1:])]) for words in lines])


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level BPE files write for bytes: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece.  ``nth`` counts the pieces of a length within the task ``part``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, nth = TokenIds(tokenizer), TaskContext.get().partitionId(), {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, out = whole.slice(at, 512), []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    data = ids(text) + end if text else end
                    n = len(data) // 4
                    first = (n - 1) % capacity + 1
                    start, length, piece = 0, first, 0
                    while start < n:
                        at_length = nth[length] = nth.get(length, -1) + 1
                        crc = zlib.crc32(data[4 * start : 4 * (start + length)])
                        out.append((doc, piece, start, length, crc, part, at_length))
                        start, length, piece = start + length, capacity, piece + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(c, t)
                        for c, t in zip(
                            zip(*out, strict=True),
                            (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()),
                            strict=True,
                        )
                    ],
                    [c.split()[0] for c in PIECES.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# -- the plan, on counts per length -----------------------------------------------------------------------------------


def equal_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths in ascending order, split where the pieces so far pass the next of ``groups`` equal shares."""
    total, out, done, cut = sum(counts.values()), [], 0, 0
    for length in sorted(counts):
        share = done * groups // max(total, 1)
        if not out or share > cut:
            out.append([])
            cut = share
        out[-1].append(length)
        done += counts[length]
    return out


def _best_column(value: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: unbounded knapsack over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    size = np.array(sizes)
    order = np.argsort(size)
    size_o, value_o = size[order], value[order]
    for c in range(1, capacity + 1):
        k = bisect.bisect_right(size_o, c)
        best[c], choice[c] = best[c - 1], -1
        if k:
            gain = best[c - size_o[:k]] + value_o[:k]
            i = int(np.argmax(gain))
            if gain[i] > best[c] + 1e-12:
                best[c], choice[c] = gain[i], i
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            column[order[choice[c]]] += 1
            c -= size_o[choice[c]]
    return float(best[capacity]), column


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size in a sequence, how many such sequences), rounded down from the linear program's optimum."""
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, dtype=float)
    x = np.linalg.solve(basis, need)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        gain, column = _best_column(np.maximum(dual, 0), sizes, capacity)
        if gain <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        x = np.maximum(np.linalg.solve(basis, need), 0)
    return [(basis[:, i], int(np.floor(x[i] + 1e-9))) for i in range(len(sizes)) if x[i] >= 1 - 1e-9]


class _Stock:
    """Pieces of each length, handed out by rank."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.used = dict(counts), dict.fromkeys(counts, 0)

    def take(self, length: int, n: int) -> int:
        first = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return first


#: Shares of the configurations that are tried.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.65, 0.5, 0.3, 0.1)

Run = tuple[int, int, int, int, int, int]


def packing_plan(counts: dict[int, int], capacity: int, groups: int = 64, small: int = 4) -> list[Run]:
    """Runs (length, first rank, end rank, first sequence, pieces of the run in each sequence, offset in the sequence).

    Pieces longer than ``capacity // small`` are large.  Configurations for all large pieces leave few of them to fill the
    last sequences with, so plans that use them for a share of the pieces only are tried as well; the one with fewest
    sequences is taken.
    """
    large = {k: n for k, n in counts.items() if capacity // small < k < capacity and n}
    grouped = equal_groups(large, groups)
    sizes = [g[-1] for g in grouped]
    patterns = configurations(sizes, [sum(large[k] for k in g) for g in grouped], capacity) if sizes else []
    plans = [_plan(counts, capacity, sizes, patterns, sorted(large, reverse=True), share) for share in SHARES]
    return min(plans, key=lambda plan: plan[1])[0]


def _plan(counts: dict[int, int], capacity: int, sizes: list[int], patterns: list[tuple[np.ndarray, int]], longest_first: list[int], share: float) -> tuple[list[Run], int]:
    """The runs and the number of sequences, with ``share`` of the sequences that the configurations ask for."""
    stock, runs, sequences = _Stock(counts), [], 0
    room: list[list] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, how many)
    for length in [capacity] if counts.get(capacity) else []:
        n = counts[length]
        runs.append((length, stock.take(length, n), n, 0, 1, 0))
        sequences = n
    for column, times in patterns:
        # Every place of the configuration, largest first, takes the longest actual length that fits into its size
        # and the room that the configuration and the places before it leave; where a length runs out, the next
        # begins, and so do sequences of another make-up.
        places = [g for g, n in reversed(list(enumerate(column))) for _ in range(round(n))]
        spare = capacity - sum(sizes[g] for g in places)
        times, done = int(times * share), 0
        while done < times:
            wanted: dict[int, int] = {}
            free = spare
            for g in places:
                free += sizes[g]
                length = next((k for k in longest_first if k <= free and stock.left[k] > wanted.get(k, 0)), None)
                if length is not None:
                    wanted[length] = wanted.get(length, 0) + 1
                    free -= length
            if not wanted:
                break
            n = min(times - done, *(stock.left[k] // w for k, w in wanted.items()))
            offset = 0
            for length, w in wanted.items():
                first = stock.take(length, n * w)
                runs.append((length, first, first + n * w, sequences, w, offset))
                offset += w * length
            room[capacity - offset].append((sequences, n))
            sequences, done = sequences + n, done + n
    for length in sorted(counts, reverse=True):
        while left := stock.left[length]:
            free = next((f for f in range(length, capacity) if room[f]), None)
            if free is None:
                # New sequences, each filled with as many of this length as fit.
                each = min(capacity // length, left)
                n = left // each
                first = stock.take(length, n * each)
                runs.append((length, first, first + n * each, sequences, each, 0))
                room[capacity - each * length].append((sequences, n))
                sequences += n
                continue
            at, n = room[free].pop()
            each = min(free // length, left)
            fill = min(n, left // each)
            first = stock.take(length, fill * each)
            runs.append((length, first, first + fill * each, at, each, capacity - free))
            room[free - each * length].append((at, fill))
            if fill < n:
                room[free].append((at + fill, n - fill))
    return runs, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row per piece of ``docs`` (doc_id, text) with its sequence and offset."""
    spark = docs.sparkSession
    pieces = staged(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    sums = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-sums")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(counts, capacity)
    runs = spark.createDataFrame(
        plan, "length long, first long, end long, first_sequence long, each long, first_offset long"
    )
    # Runs are bounded by lengths and configurations, not by documents.
    # The sums grow with the number of tasks: not broadcast.
    ranked = pieces.join(sums.select("length", "part", "before").hint("merge"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(runs), "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
