"""Ranked lexical search of a set of items over all documents, by branch and bound in document FP-trees.

1. One pass over the texts counts all terms of a document and the occurrences of those terms that some item has: the
   document's restricted term vector.  These are written once; ``N``, ``L`` and the terms' ``df`` are summed from them.
2. Each task takes blocks of such vectors, orders every vector by document frequency (frequent terms first) and builds
   a trie in which vectors with a common beginning share a path.  Each node has the largest tf of every term in its
   subtree and the smallest length penalty ``m``: the score with these is a bound for all documents below it, and at a
   leaf, one document, the score itself.
3. For each item the trie is walked depth first, the branches with the highest bounds first; a branch whose bound is
   below the item's worst kept score is left.  What a task has kept goes on from block to block.
4. Each task gives at most ``top`` rows for an item; Spark ranks them.

Items are taken in parts whose texts have ``ITEM_BYTES`` on average, each a pass over the documents, so what is sent to
the tasks is bounded at any number of items.  Memory of a task: one slice of a text, one block.

Cases: null texts and texts without a term count as no document and are never found.  Repeated rows of a document are
documents of their own, with ranks of their own; a null doc_id comes last among equal scores.  Equal rows of an item
count once; one item_id with several texts gets a list for each.  An item without a term, or whose terms no document
has, gives no row; so do empty tables.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.store import Scratch, staged

ITEM_BYTES = 2 << 20
#: A text is cut into terms so many bytes at a time.
SLICE = 1 << 20
#: A block's trie has so many documents, and so many numbers in the table of its nodes, at most.
BLOCK_DOCUMENTS, BLOCK_CELLS = 2048, 12 << 20
#: So many branches are entered together, those with the best bounds.
WIDTH = 64

#: Bytes of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`` in UTF-8, A-Z lower-cased; all others are spaces.
_TO_TERMS = bytes(b if chr(b).isalnum() or b >= 0x80 else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, slice by slice."""
    text, at = text or b"", 0
    while at < len(text):
        end = at + SLICE
        # A slice ends behind a byte that separates terms.
        while end < len(text) and _TO_TERMS[text[end - 1]] != 32:
            end += 1
        yield text[at:end].translate(_TO_TERMS).split()
        at = end


VECTORS = "doc_id long, n long, terms array<int>, tf array<long>"


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n: all terms, terms and tf: those of ``vocabulary``, by number) of the documents with a term."""
    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), ([], [], [], [])
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()), strict=True):
                    n, found = 0, Counter()
                    for some in terms(text.as_py()):
                        n += len(some)
                        found.update(filter(lambda t: t is not None, map(vocabulary.get, some)))
                    if n:
                        for column, value in zip(out, (doc, n, list(found), list(found.values())), strict=True):
                            column.append(value)
                arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, VECTORS)


class Trie:
    """A block of documents: nodes 0 to D-1 are its documents, the others branches, the last one the root."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], m: list[int], columns: np.ndarray):
        """``vectors``: places of the terms by frequency, ascending, and tf; ``columns``: those that occur in the block."""
        order = sorted(range(len(vectors)), key=lambda i: vectors[i][0].astype(">u4").tobytes())
        self.documents = np.array(order)
        self.columns = columns
        size = len(order)
        self.most = np.zeros((2 * size, len(columns)), dtype=np.int32)
        self.least_m = np.zeros(2 * size, dtype=np.int64)
        self.children: list[np.ndarray | None] = [None] * size
        for leaf, i in enumerate(order):
            self.most[leaf, np.searchsorted(columns, vectors[i][0])] = vectors[i][1]
            self.least_m[leaf] = m[i]
        # Branches are the stretches of documents that share a beginning; open ones wait with the length of it.
        waiting: list[tuple[int, list[int]]] = [(0, [])]
        for leaf in range(1, size):
            shared = _shared(vectors[order[leaf - 1]][0], vectors[order[leaf]][0])
            if shared > waiting[-1][0]:
                waiting.append((shared, [leaf - 1]))
                continue
            waiting[-1][1].append(leaf - 1)
            while waiting[-1][0] > shared:
                done = self._branch(waiting.pop()[1])
                if waiting[-1][0] < shared:
                    waiting.append((shared, [done]))
                else:
                    waiting[-1][1].append(done)
        waiting[-1][1].append(size - 1)
        while len(waiting) > 1:
            done = self._branch(waiting.pop()[1])
            waiting[-1][1].append(done)
        self.root = self._branch(waiting[0][1])

    def _branch(self, nodes: list[int]) -> int:
        own, node = np.array(nodes), len(self.children)
        self.children.append(own)
        self.most[node] = self.most[own].max(axis=0)
        self.least_m[node] = self.least_m[own].min()
        return node

    def bounds(self, nodes: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no document below a node exceeds; the score of a document."""
        tf = self.most[nodes[:, None], columns[None, :]].astype(np.int64)
        return ((1_000_000_000 * tf) // (1000 * tf + 12 * self.least_m[nodes][:, None]) * weights).sum(axis=1)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    return int(unlike[0]) if len(unlike) else n


class Best:
    """The best (score, doc_id) of an item so far, equal scores by doc_id, null last."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: list[int], ids: list[int | None]) -> None:
        self.rows += [(-s, i is None, i or 0) for s, i in zip(scores, ids, strict=True)]
        if len(self.rows) > self.top:
            self.rows = sorted(self.rows)[: self.top]
        if len(self.rows) == self.top:
            self.least = max(1, -max(self.rows)[0])


def walk(trie: Trie, ids: list[int | None], places: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Takes the documents of ``trie`` that belong among the ``best`` of an item (term places, weights times repeats)."""
    at = np.searchsorted(trie.columns, places)
    here = at < len(trie.columns)
    here[here] = trie.columns[at[here]] == places[here]
    columns, weights = at[here], weights[here]
    if not len(columns):
        return
    open_branches = [(np.array([trie.root]), None)]
    while open_branches:
        nodes, bounds = open_branches.pop()
        if bounds is not None:
            nodes = nodes[bounds >= best.least]
        if not len(nodes):
            continue
        nodes = np.concatenate([trie.children[n] for n in nodes])
        bounds = trie.bounds(nodes, columns, weights)
        good = bounds >= best.least
        nodes, bounds = nodes[good], bounds[good]
        leaf = nodes < len(trie.documents)
        if leaf.any():
            best.add(bounds[leaf].tolist(), [ids[i] for i in trie.documents[nodes[leaf]]])
        nodes, bounds = nodes[~leaf], bounds[~leaf]
        order = np.argsort(bounds)
        for end in range(len(order) % WIDTH or WIDTH, len(order) + 1, WIDTH):
            some = order[max(0, end - WIDTH) : end]
            if len(some):
                open_branches.append((nodes[some], bounds[some]))


def _blocks(vectors: list[tuple]) -> Iterator[tuple[list[tuple], np.ndarray]]:
    """Parts of ``vectors`` whose tries keep to the limits, and the terms that occur in each."""
    columns = np.unique(np.concatenate([v[2] for v in vectors]))
    if len(vectors) > 1 and 2 * len(vectors) * len(columns) > BLOCK_CELLS:
        half = len(vectors) // 2
        yield from _blocks(vectors[:half])
        yield from _blocks(vectors[half:])
    else:
        yield vectors, columns


def _best_in_tasks(vectors: DataFrame, frequency: np.ndarray, items: list[tuple[int | None, Counter]], documents: int, words: int, top: int) -> DataFrame:
    """(item: number in ``items``, item_id, doc_id, score): what each task found best."""
    place = np.empty(len(frequency), dtype=np.int64)
    place[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency))
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency]
    wanted = []
    for _, own in items:
        pairs = sorted((int(place[t]), weight[t] * n) for t, n in own.items())
        wanted.append((np.array([p for p, _ in pairs], dtype=np.int64), np.array([w for _, w in pairs], dtype=np.int64)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Vectors of up to a block's documents, the terms by their places."""
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = part.column("n").to_pylist()
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = place[np.asarray(part.column("terms")[i].values)]
                    if len(own):
                        order = np.argsort(own)
                        m = 75 + 25 * counts[i] * documents // words
                        held.append((doc, m, own[order], np.asarray(part.column("tf")[i].values)[order]))
                    if len(held) == BLOCK_DOCUMENTS:
                        yield held
                        held = []
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Best(top) for _ in wanted]
        for several in read(batches):
            for block, columns in _blocks(several):
                trie = Trie([v[2:] for v in block], [v[1] for v in block], columns)
                ids = [v[0] for v in block]
                for (places, weights), best in zip(wanted, kept, strict=True):
                    walk(trie, ids, places, weights, best)
        rows = [(i, items[i][0], None if no_id else doc, -score) for i, best in enumerate(kept) for score, no_id, doc in best.rows]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "item_id", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of every item (item_id, text)."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // item_bytes) or 1
    results = []
    for part in range(parts):
        named, vocabulary = [], {}
        for row in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect():
            own = Counter(vocabulary.setdefault(t, len(vocabulary)) for some in terms(row["text"].encode()) for t in some)
            if own:
                named.append((row["item_id"], own))
        if not named:
            continue
        with Scratch(spark) as scratch:
            vectors = scratch.staged(term_vectors(docs, vocabulary), "vectors")
            documents, words = vectors.agg(F.count("*"), F.sum("n")).first()
            if not documents:
                continue
            frequency = np.zeros(len(vocabulary), dtype=np.int64)
            for term, df in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
                frequency[term] = df
            found = _best_in_tasks(vectors, frequency, named, documents, words, top)
            order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            results.append(staged(found.select("item_id", "rank", "doc_id", "score"), "ranked"))
    return reduce(DataFrame.unionAll, results) if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SEARCH_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
),
i AS (
  SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
q AS (SELECT item_id, term, count(*) AS repeats FROM i GROUP BY item_id, term),
s AS (SELECT count(*) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d WHERE len(ws) > 0),
t AS (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, s GROUP BY term
),
x AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM x WHERE score > 0
QUALIFY rank <= 20"""
