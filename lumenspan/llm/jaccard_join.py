"""Self-join of documents on the Jaccard similarity of their word shingles, by token-combination prefixes.

1. Documents with equal shingle sets form a class; only one document of each class goes on.
2. Tokens (64-bit shingle hashes) get their document frequency.  A document's tokens are ordered rare first; what two
   similar documents share must show in the first few of each: at most ``n - ceil(t * n)`` of ``n`` tokens are missing
   in the other.
3. Rare tokens are indexed singly.  Frequent ones fall into classes by their hash, and a class is indexed by its
   two-token combinations: with f tokens of a class in the prefix, f - 1 must be missing before no combination is
   shared.  The prefix is therefore extended until ``rare + sum(f - 1)`` exceeds what may be missing.  Classes are
   sized so that about four frequent tokens of a document fall into each, so combinations stay in proportion to it.
4. Candidates are verified on the whole sets.  A group of candidates is not turned into all its pairs: for a few turns
   each is compared with one hub of its group, and groups that have become one component are done; only members that
   are still in different components are then paired, if their parity vectors allow it.  Such a vector holds for each
   of 256 bins of hashes whether the set has an odd number in it; every bit in which two vectors differ needs a shingle
   that one of the sets lacks, so no similar pair is lost.

Sizes matter only within factors of two: level ``floor(log2(n))``; a document just above a level's lower end is also
listed in the level below, so similar documents always share a level.  In levels of 32 shingles and more the tokens
used are a fixed share of all hashes (the same for all documents), which follows from the percentage and gives more
than a prefix needs.  A document whose share is too small for its prefix lists all of it, which any similar document
with a full prefix meets, and is joined with other such documents over all its tokens.

Cases: a null text or one without words has an empty set, links with nothing and is its own component.  Fewer than
three words: the whole sequence is the one shingle.  Equal sets are linked, so their documents share a component.
Repeated rows with one doc_id are one node and give a row each; rows with a null doc_id link by their text only, and
have a null component if no document with an id is reached.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenspan.llm.components import connected_components
from lumenspan.llm.words import WordHashes, shingle_set
from lumenspan.store import Scratch, broadcast_if_small, staged

#: A token in so many documents or more counts as frequent.
FREQUENT = 12
CLASS_TOKENS = 4
#: So many standard deviations more tokens than the longest prefix needs are taken, in steps of the least share.
SPARE = 3.0
SHARE_STEP = 0.05
#: Turns in which a group is compared with one of its members only.
HUB_TURNS = 3
#: So many keys of a member tell at which of them a pair is made.
FIRST_KEYS = 16
#: Bits of a set's parity vector.
PARITY_BITS = 256


def _share(level: int, percent: int) -> float:
    """The share of all hashes that tokens of a level are taken from: enough if all are frequent; below 32 shingles all."""
    n = 1 << level
    need = n - -(-n * percent // 100) + 1
    for step in range(4, round(1 / SHARE_STEP)):
        share = step * SHARE_STEP
        tokens = n * share
        if level >= 5 and tokens - tokens / CLASS_TOKENS - SPARE * (tokens * (1 - share)) ** 0.5 >= need:
            return share
    return 1.0


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _levels(n: int, percent: int) -> list[int]:
    top = n.bit_length() - 1
    low = -(-n * percent // 100)  # the smallest similar set
    return sorted({top, max(low, 1).bit_length() - 1})


def shingle_sets(docs: DataFrame, k: int, percent: int, whole: bool = False) -> DataFrame:
    """(doc_id, n, fp1, fp2, levels of (level, tokens)); with ``whole`` all tokens and their parity instead of levels."""
    limits = {v: np.uint64(min(int(_share(v, percent) * 2**64), 2**64 - 1)) for v in range(64)}
    out_type = pa.list_(pa.int64()) if whole else pa.list_(pa.struct([("level", pa.int32()), ("tokens", pa.list_(pa.int64()))]))
    tail = "tokens array<long>, parity array<long>" if whole else "levels array<struct<level: int, tokens: array<long>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, fp1, fp2, sets, parities = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingle_set(hashes.array((text or "").encode().lower().split()), k)
                    n.append(len(s))
                    mixed = s * np.uint64(0xD6E8FEB86659FD93)
                    fp1.append(int(_as_long(s.sum(dtype=np.uint64, keepdims=True))[0]))
                    fp2.append(int(_as_long((mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64, keepdims=True))[0]))
                    if whole:
                        sets.append(_as_long(s))
                        parities.append(_parity(s))
                    else:
                        sets.append(
                            [
                                {"level": v, "tokens": _as_long(s[s <= limits[v]])}
                                for v in (_levels(len(s), percent) if len(s) else [])
                            ]
                        )
                arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64())]
                arrays.append(pa.array(sets, out_type))
                if whole:
                    arrays.append(pa.array(parities, pa.list_(pa.int64())))
                names = ["doc_id", "n", "fp1", "fp2", *(("tokens", "parity") if whole else ("levels",))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n long, fp1 long, fp2 long, {tail}")


def _missing(n: Column, percent: int) -> Column:
    """How many tokens of a set of ``n`` a similar set can lack."""
    return n - F.ceil(n * percent / 100)


KEYS = "id long, level int, n long, short boolean, typical double, keys array<long>"


def _prefix_keys(tokens: DataFrame, percent: int, combine: bool = True) -> DataFrame:
    """(id, level, n, known: tokens others have with their frequency) -> the keys of each document's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "level", "n", "alone")]
            known, out = batch.column("known"), []
            for i, (doc, level, n, alone) in enumerate(zip(*columns, strict=True)):
                entries = known[i].values
                token = np.asarray(entries.field("token")).view(np.uint64)
                df = np.asarray(entries.field("df"))
                need = n - -(-n * percent // 100) + 1 - alone
                short, keys = False, np.empty(0, dtype=np.uint64)
                if need > 0:
                    order = np.lexsort((token, df))
                    token = token[order]
                    rare = int((df < FREQUENT).sum()) if combine else len(token)
                    keys = token[:rare][:need]
                    need -= len(keys)
                    if need > 0 and combine:
                        more, need = _combinations(token[rare:], level, need, percent)
                        keys = np.concatenate([keys, more])
                    short = need > 0
                out.append((doc, level, n, short, float(np.log2(df).sum()) / n, _as_long(keys)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in out], t)
                    for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.float64(), pa.list_(pa.int64())))
                ],
                ["id", "level", "n", "short", "typical", "keys"],
            )

    return tokens.mapInArrow(run, KEYS)


def _combinations(tokens: np.ndarray, level: int, need: int, percent: int) -> tuple[np.ndarray, int]:
    """Two-token keys of the shortest prefix of ``tokens`` whose classes outweigh ``need``; what is lacking then."""
    # Tokens come with the less frequent ones first; their class comes from their hash.
    classes = max(1, int((1 << level) * _share(level, percent)) // CLASS_TOKENS)
    groups: dict[int, list[int]] = {}
    for t in tokens.tolist():
        own = groups.setdefault((t * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) % classes, [])
        own.append(t)
        need -= len(own) > 1
        if need <= 0:
            break
    out = [
        (a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB + 1) & 0xFFFFFFFFFFFFFFFF
        for own in groups.values()
        for i, a in enumerate(own)
        for b in own[i + 1 :]
    ]
    return np.array(out, dtype=np.uint64), max(need, 0)


def _with_frequency(listed: DataFrame, shingles: int) -> DataFrame:
    """(id, level, n, tokens) -> (id, level, n, alone, known): tokens with their frequency in the level.

    Tokens of one document only can't be shared: they are counted, not kept.  Frequencies are counted by a part of the
    hash that is wide enough for so many shingles; two tokens with one part have a higher frequency than their own,
    which changes their order and nothing else.
    """
    tokens = listed.select("id", "level", F.explode("tokens").alias("token"))
    bits = min(58, max(40, shingles.bit_length() + 6))
    part = F.col("token").bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.shiftleft(F.col("level").cast("long"), bits))
    shared = tokens.groupBy(part.alias("part")).agg(F.count("*").alias("df")).where("df > 1")
    known = tokens.join(shared, part == F.col("part")).groupBy("id", "level").agg(F.collect_list(F.struct("token", "df")).alias("known"))
    # What a document brings with it is joined to its tokens afterwards, so that it isn't moved with each of them.
    sizes = listed.select("id", "level", "n", F.size("tokens").alias("total"))
    return known.join(sizes, ["id", "level"]).withColumn("alone", F.col("total") - F.size("known"))


def _only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is one of ``ids``; these are broadcast if they are few, else both sides are shuffled."""
    return df.join(broadcast_if_small(ids.withColumnRenamed(ids.columns[0], key)), key, "left_semi")


def _links(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) with what their whole sets say."""
    one, two = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x, y, ok = batch.column("a_tokens"), batch.column("b_tokens"), []
                for i in range(batch.num_rows):
                    s, t = np.asarray(x[i].values), np.asarray(y[i].values)
                    both = len(s) + len(t) - len(np.union1d(s, t))
                    ok.append(100 * both >= percent * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], ["a", "b", "linked"])

    return candidates.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long, linked boolean")


def _similar_size(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _similar_parity(percent: int) -> Column:
    """Two similar sets differ in ``(100 - percent) / percent`` of the smaller one's size at most."""
    words = range(PARITY_BITS // 64)
    unlike = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity2")[i])) for i in words), F.lit(0))
    return unlike * percent <= F.least("n", "n2") * (100 - percent)


def set_links(docs: DataFrame, keyed: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links that give the exact components of the class representatives that share a key."""
    keyed = keyed.select("id", "level", "n", "typical", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("level", "key").agg(F.count("*").alias("size")).where("size > 1")
    listed = scratch.staged(keyed.join(sizes, ["level", "key"]), "keys")
    needed = listed.select("id").distinct()
    whole = shingle_sets(_only(docs, "doc_id", needed), k, percent, whole=True)
    # Repeated doc_ids (rows of one id) have been reduced to their first text before.
    sets = scratch.staged(whole.select(F.col("doc_id").alias("id"), "tokens", "parity"), "sets")
    compared, components, rows = None, None, None
    for turn in range(HUB_TURNS):
        scratch.drop(rows)
        rows = listed.withColumn("component", F.col("id")) if components is None else _open_rows(listed, components, sets, scratch)
        pairs = _hub_pairs(rows, turn, percent)
        if compared is not None:
            pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        found = scratch.staged(_links(pairs, sets, percent), "links")
        compared = found if compared is None else compared.unionAll(found)
        linked = found.where("linked").select("a", "b")
        if components is None or not linked.isEmpty():
            before, components = components, scratch.staged(connected_components(_with_stars(components, linked)), "components")
            scratch.drop(before)
    scratch.drop(rows)
    pairs = _open_pairs(_open_rows(listed, components, sets, scratch), percent)
    pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
    last = scratch.staged(_links(pairs, sets, percent), "links")
    return _with_stars(components, last.where("linked").select("a", "b"))


def _hub_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): each member of a key group with one of them, the hub.

    First the member whose tokens most documents have, the likely centre of a group of copies, which is the hub of most
    keys the copies share; later a member that changes from key to key, so that a member meets as many as it has keys.
    """
    by, parity = ["level", "key"], ["parity"] * bool(turn)
    order = F.struct(F.xxhash64("id", "key", F.lit(turn)), "id") if turn else F.struct("typical", "id")
    hubs = rows.groupBy(*by).agg(F.max_by(F.struct("id", "n", "component", *parity), order).alias("hub"))
    names = ("id", "n", "component", *parity)
    hubs = hubs.select(*by, *(F.col(f"hub.{c}").alias(f"{c}2") for c in names))
    near = (F.col("component") != F.col("component2")) & _similar_size("n", "n2", percent)
    pairs = rows.join(hubs, by).where(near & _similar_parity(percent) if turn else near)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): what is still apart, members of different components of a group that may be similar.

    A pair that shares several keys is made at the first of them, in the order of group size; ``first`` are a member's
    first few keys.  Where two members have none of these in common the pair may come from several keys.
    """
    first = rows.groupBy("id", "level").agg(
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "key"))), 1, FIRST_KEYS), lambda x: x["key"]).alias("first")
    )
    rows = rows.join(first, ["id", "level"])
    names = ("id", "n", "component", "parity", "first")
    rows = rows.select("level", "key", *names)
    other = rows.select("level", "key", *(F.col(c).alias(f"{c}2") for c in names))
    pairs = rows.join(other, ["level", "key"]).where(
        (F.col("id") < F.col("id2"))
        & (F.col("component") != F.col("component2"))
        & _similar_size("n", "n2", percent)
        & _similar_parity(percent)
        & (F.coalesce(F.get(F.array_intersect("first", "first2"), F.lit(0)), F.col("key")) == F.col("key"))
    )
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()


def _with_stars(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """``links`` and those that stand for the components found so far: each id with its component's smallest."""
    if components is None:
        return links
    return links.unionAll(components.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))


def _open_rows(listed: DataFrame, components: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of the key groups whose members are in several components; the others are done."""
    placed = listed.join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ends = placed.groupBy("level", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    placed = placed.join(ends.select("level", "key"), ["level", "key"]).join(sets.select("id", "parity"), "id")
    return scratch.staged(placed, "open")


def similar_documents(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        whole = scratch.staged(shingle_sets(docs, k, percent), "shingles")
        table = staged(whole.select("doc_id", "n", "fp1", "fp2"), "documents")
        # A class is the documents with one set; a doc_id of several texts belongs to several classes and joins them.
        members = table.where("n > 0 and doc_id is not null").distinct()
        classes = staged(members.groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep")), "classes")
        # A representative stands for its class by a number of its own where doc_ids repeat with other texts.
        if members.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0:
            return _by_row(docs, k, percent, similar_documents)
        repeats = _repeats(docs)
        with_text = whole.where("n > 0 and doc_id is not null")
        reps = _only(with_text.dropDuplicates(["doc_id"]) if repeats else with_text, "doc_id", classes.select("rep"))
        reps = reps.select(F.col("doc_id").alias("id"), "n", F.explode("levels").alias("x")).select("id", "n", "x.level", "x.tokens")
        shingles = table.agg(F.sum("n")).first()[0] or 0
        keyed = scratch.staged(_prefix_keys(_with_frequency(reps, shingles), percent), "prefixes")
        # Short: the fixed share of hashes doesn't fill the prefix.  Without a token that others have a document is not
        # in ``keyed``.
        few = reps.where(F.size("tokens") <= _missing(F.col("n"), percent))
        short = scratch.staged(keyed.where("short").select("id").unionAll(few.select("id")).distinct(), "short")
        scratch.drop(whole)
        one_each = docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if repeats else docs
        # A short document lists all its tokens, so any partner that is not short meets it here.
        links = set_links(one_each, keyed, k, percent, scratch)
        if not short.isEmpty():
            # All tokens, rare ones first, singly.
            again = shingle_sets(_only(one_each, "doc_id", short), k, percent, whole=True)
            again = scratch.staged(again.select(F.col("doc_id").alias("id"), "n", F.lit(0).alias("level"), "tokens"), "short-sets")
            rest = scratch.staged(_prefix_keys(_with_frequency(again, shingles), percent, combine=False), "prefixes-2")
            links = links.unionAll(set_links(one_each, rest, k, percent, scratch))
        components = staged(connected_components(links), "components")
    classes = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left").select(
        "n", "fp1", "fp2", F.coalesce("component", "rep").alias("component_id")
    )
    found = table.join(classes, ["n", "fp1", "fp2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _by_row(docs: DataFrame, k: int, percent: int, join: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """The join where one doc_id has several texts: rows are joined under numbers of their own, then ids are linked."""
    rows = staged(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    found = staged(join(rows.select(F.col("row").alias("doc_id"), "text"), k, percent), "row-components")
    found = found.join(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    # Rows of a component share it, rows of an id share it: components of the graph of ids and row components.
    low = F.lit(-(1 << 62))
    links = found.where("id is not null").select(F.col("id").alias("a"), (low + F.col("component_id")).alias("b")).distinct()
    nodes = connected_components(links)
    smallest = links.join(nodes.withColumnRenamed("id", "a"), "a").groupBy("component").agg(F.min("a").alias("component_id"))
    by_id = nodes.join(smallest, "component").select(F.col("id").alias("node"), F.col("component_id").alias("smallest"))
    found = found.withColumn("node", low + F.col("component_id")).join(by_id, "node", "left")
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("smallest", "id").alias("component_id"))
