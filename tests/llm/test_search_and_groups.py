"""Search, clustering and near duplicates of round three against brute force, and the cases their docstrings state."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def brute_search(docs, items, top=20):
    found = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, words = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in found:
            m = 75 + (25 * sum(c.values()) * n_docs) // words
            s = 0
            for t in TERM.findall(lower(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def test_search(spark, monkeypatch):
    from lumenspan.llm import lexical_search

    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Été", "x_y", "日本", "A1"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 4, 30, 200]))) for _ in range(300)]
    texts += [texts[0]] * 40 + [None, "", " .,- ", "only here", "y" * 50_000, "w1 " * 3000]
    rows = [(i if i != 7 else None, t, 1, "x") for i, t in enumerate(texts)] + [(9, texts[9], 1, "x"), (9, "w1 w2 other", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, terms string").repartition(5)
    items = [(j, " ".join(rng.choices(words, k=25))) for j in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (53, "only HERE here"), (None, "w1 w1 w2")]
    bench = spark.createDataFrame([(*i, "x") for i in items * 2], "item_id long, text string, doc_id string")
    expected = brute_search([r[:2] for r in rows], items)
    assert sorted((tuple(r) for r in lexical_search.search(docs, bench).collect()), key=str) == expected
    # Several parts of items, small blocks, narrow branches, slices that cut the texts.
    for name, value in (("BLOCK_DOCUMENTS", 64), ("BLOCK_CELLS", 4000), ("WIDTH", 2), ("SLICE", 7)):
        monkeypatch.setattr(lexical_search, name, value)
    assert sorted((tuple(r) for r in lexical_search.search(docs, bench, item_bytes=500).collect()), key=str) == expected
    assert lexical_search.search(docs.limit(0), bench).count() == 0 and lexical_search.search(docs, bench.limit(0)).count() == 0


def test_trie_bounds_hold_and_leave_branches():
    from lumenspan.llm.lexical_search import Best, Trie, walk

    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(400):
        places = np.flatnonzero(rng.random(60) < 0.9 / np.arange(1, 61) ** 0.5)
        vectors.append((places, rng.integers(1, 5, len(places))))
    m = rng.integers(75, 300, 400).tolist()
    trie = Trie(vectors, m, np.arange(60))
    columns, weights = np.array([3, 20, 40, 59]), np.array([10, 400, 900, 2000])
    below = {}

    def leaves(node):
        own = [node] if node < 400 else [x for c in trie.children[node] for x in leaves(c)]
        below[node] = own
        return own

    assert sorted(leaves(trie.root)) == list(range(400))
    score = trie.bounds(np.arange(400), columns, weights)
    for node, own in below.items():
        assert trie.bounds(np.array([node]), columns, weights)[0] >= score[own].max()
    seen, plain = [], trie.bounds
    trie.bounds = lambda nodes, *a: seen.extend(nodes) or plain(nodes, *a)
    best = Best(5)
    walk(trie, list(range(400)), columns, weights, best)
    own = [(-int(score[leaf]), False, int(doc)) for leaf, doc in enumerate(trie.documents)]
    assert sorted(best.rows) == sorted(own)[:5] and len(seen) < len(below)


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(b"3:%d" % i).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in out), key=str)


VECTORS = "vec_id long, embedding array<double>, cluster string, x long"


def test_clusters(spark):
    from lumenspan.llm.centroids import cluster_vectors

    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(64)]) for i in range(200)]
    rows += [(500, [0.5] * 64)] * 30 + [(None, [1.0] * 64), (600, None), (601, [1.0] * 63), (602, [math.nan] * 64), (603, [None] * 64), (604, [math.inf] * 64)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in cluster_vectors(table).collect()), key=str)
    assert got == brute_clusters(rows)
    # Fewer vectors than clusters, ties, an empty table.
    few = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [2.0] * 64)]
    assert sorted(map(tuple, cluster_vectors(spark.createDataFrame([(*r, "x", 1) for r in few], VECTORS)).collect())) == brute_clusters(few)
    assert cluster_vectors(table.limit(0)).count() == 0


def test_clusters_of_large_numbers(spark):
    from lumenspan.llm.centroids import cluster_vectors

    rows = [(i, [float((i * 7 + d) % 11) * 2.0**45 for d in range(64)]) for i in range(40)] + [(90, [1e30] * 64)]
    got = cluster_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)).collect()
    expected = {r[0]: r for r in brute_clusters(rows[:40])}
    assert len(got) == 40 and {(r["vec_id"], r["cluster"], r["centroid_sha256"]) for r in got} == {(i, r[1], r[5]) for i, r in expected.items()}
    assert all(r["distance"] == (d if (d := expected[r["vec_id"]][2]) < 1 << 63 else None) for r in got)


def brute_near(texts, percent=85, k=3):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


DOCS = "doc_id long, text string, n long, registers string, keys string"


def test_near_duplicates(spark):
    from lumenspan.llm.minhash_dedup import near_duplicates

    rng = random.Random(6)
    texts = [None, "", " \n ", "one", "one two", "One two", "x" * 40_000]
    common = "this line is on very many of the documents here".split()
    for size in (4, 8, 9, 13, 14, 15, 16, 17, 18, 24, 40, 90, 300):
        for _ in range(6):
            words = [f"v{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for _ in range(3):
                copy = list(words)
                for _ in range(rng.randrange(1 + size // 20) + 1):
                    at = rng.randrange(len(copy) + 1)
                    copy[at : at + rng.randrange(2)] = [f"u{rng.randrange(5000)}"] * rng.randrange(2)
                texts.append(" ".join(copy))
            texts.append(" ".join(common + words))
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    expected = brute_near(texts)
    assert got == expected and len({r[2] for r in expected}) < len(texts) - 60


def test_near_copies_that_only_their_source_links(spark):
    from lumenspan.llm.minhash_dedup import near_duplicates

    # Copies are similar to their source and not to each other; the source is the hub of few groups.
    rng = random.Random(9)
    texts = []
    for size, edits, copies in ((300, 7, 90), (60, 1, 40)):
        source = [f"s{size}w{rng.randrange(5000)}" for _ in range(size)]
        texts.append(" ".join(source))
        for _ in range(copies):
            copy = list(source)
            for at in rng.sample(range(2, size - 2), edits):
                copy[at] = f"u{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect())
    assert got == brute_near(texts) and len({r[2] for r in got}) == 2


def test_near_duplicates_of_odd_tables(spark):
    from lumenspan.llm.minhash_dedup import near_duplicates

    rows = [(None, "a b c d"), (1, None), (1, None), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (4, "e f g h"), (8, "e f g h"), (None, "p q r")]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(table).collect())))
    assert got == sorted(map(str, [(None, 2, 3, False), (1, 0, 1, True), (1, 0, 1, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (8, 2, 3, False), (None, 1, None, True)]))
    assert near_duplicates(table.limit(0)).count() == 0


def test_estimates_are_near_and_corrected():
    from lumenspan.llm.minhash_dedup import EMPTY, collision_share, estimates, registers

    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 0.85, 1.0):
        found = []
        for _ in range(40):
            pool = rng.integers(0, 2**64, 2000, dtype=np.uint64)
            both = int(1000 * 2 * share / (1 + share))
            a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:both], pool[1000 : 2000 - both]]))
            found.append(estimates(registers(a)[None], registers(b)[None], np.array([1000]), np.array([1000]))[0][0])
        assert abs(np.mean(found) - share) < 0.03
    # The share of colliding registers, on sketches of few mantissa bits: those of unlike sets, many of them.
    x, y = (np.concatenate([registers(np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))) for _ in range(20_000)]) for n in (300, 900))
    used = (x != EMPTY) & (y != EMPTY)
    assert abs((x == y)[used].mean() / collision_share(np.array(300.0), np.array(900.0)) - 1) < 0.35
