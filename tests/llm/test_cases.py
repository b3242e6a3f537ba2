"""Queries of the operators against brute force, and the cases that each docstring states."""

import random
import zlib

import pytest

public = pytest.importorskip("public_tokenizers")

#: Columns that clash with names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _words string, _lines string, id string, h string, n string, row long, kept string"


def docs(spark, rows):
    rows = [(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", 1, "f") for i, t in rows]
    return spark.createDataFrame(rows, DOCS)


LONG_WORD = "x" * 30_000
#: Null ids, repeated rows, one id with two texts, null and empty texts, a very long word.
CASES = [(None, "a b c d"), (1, None), (1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (4, "e f g h"), (5, LONG_WORD), (6, " \t\n")]


def test_operators_take_odd_tables(spark):
    from lumenspan.llm.decontamination import leaks
    from lumenspan.llm.jaccard_join import similar_documents
    from lumenspan.llm.license_scan import scan_licenses
    from lumenspan.llm.packing import pack
    from lumenspan.llm.quality_classifier import classify
    from lumenspan.llm.quality_rules import quality_rules
    from lumenspan.llm.sharding import bounded_ring
    from lumenspan.llm.token_counts import count_tokens

    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id long, text string")
    bpe, pieces = str(public.path("byte_bpe_50k.json")), str(public.path("piece_bpe_32k.model"))
    operators = {
        "tokens": lambda d: count_tokens(d, pieces),
        "pack": lambda d: pack(d, bpe),
        "rules": quality_rules,
        "ring": lambda d: bounded_ring(d, shards=3, vnodes=4),
        "licenses": scan_licenses,
        "join": similar_documents,
        "classify": lambda d: classify(d, labels),
    }
    full, empty = docs(spark, CASES), docs(spark, [])
    for name, run in operators.items():
        got = run(full).collect()
        wanted = sorted(str(i) for i, _ in CASES)
        assert sorted(str(r["doc_id"]) for r in got if name != "pack" or r["piece"] == 0) == wanted, name
        assert run(empty).count() == 0, name
    assert leaks(full, bench).count() == 0 and leaks(empty, bench).count() == 0 and leaks(full, bench.limit(0)).count() == 0
    out = quality_rules(full)
    assert {"_words", "_lines", "id"} <= set(out.columns) and {r["_words"] for r in out.collect()} == {"a"}
    # One id with two texts links both; a null id takes part by its text.
    ids = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in similar_documents(full).collect()}
    assert ids[3, 2] == ids[4, 2] == 3 and ids[None, 2] == 3 and ids[1, 0] == 1


def test_packing_query_against_tokenizers(spark):
    from tokenizers import Tokenizer

    from lumenspan.llm.packing import pack

    path = str(public.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    rng = random.Random(5)
    words = ["the", "Straße", "12", "日本", "it's", "x<|endoftext|>y", "  ", "\n\n", "émigré", "foo_bar"]
    texts = [None, "", "<|endoftext|>", *(" ".join(rng.choices(words, k=rng.choice([3, 40, 300, 2500]))) for _ in range(60))]
    rows = pack(docs(spark, list(enumerate(texts))), path, capacity=256).collect()
    for i, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 256)))
        at = 0
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 256 for r in own[1:])
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256


def brute_leaks(docs, items, k=8):
    """Documents that hold an item whole, word for word but for white space and case."""
    out = set()
    for i, t in docs:
        w = (t or "").lower().split()
        for j, item in items:
            x = item.lower().split()
            if any(w[a : a + len(x)] == x for a in range(len(w) - len(x) + 1)):
                out.add((i, j))
    return out


def test_decontamination_against_brute_force(spark):
    from lumenspan.llm.decontamination import leaks

    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Anna", "Peter", "12", "7", "kg", "days", "Berlin"]
    items = [(j, " ".join(rng.choices(words, k=rng.choice([3, 8, 15, 60])))) for j in range(25)]
    items += [(25, "Anna has 5 kg of tea"), (26, "Paris lies far"), (27, "12 + 7 = 19 kg and 5 + 3 = 8 kg for Anna and Peter")]
    texts = []
    for i in range(200):
        filler = rng.choices(words[:300], k=rng.choice([0, 5, 50, 400]))
        if i % 2:
            at = rng.randrange(len(filler) + 1)
            filler[at:at] = items[rng.randrange(len(items))][1].split()
        texts.append((i, " ".join(filler)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs(spark, texts), bench).collect()}
    assert got == brute_leaks(texts, items)


def question(rng, names, numbers, units):
    a, b = rng.sample(names, 2)
    x, y, z = rng.sample(numbers, 3)
    u = rng.choice(units)
    return (
        f"In a small shop near the harbour {a} puts {x} {u} of rice into the first box and {y} {u} into the second one "
        f"while {b} carries {z} {u} home before noon so how much rice is left for the evening market in the end"
    )


def test_reparameterised_questions_are_found(spark):
    """Recall of questions with other names, numbers and units, and texts whose values contradict each other."""
    from lumenspan.llm.decontamination import leaks

    rng = random.Random(3)
    names = ["Anna", "Peter", "Maria", "Otto", "Luise", "Karl", "Frida", "Hugo", "Clara", "Emil"]
    item = question(rng, names[:4], [12, 7, 30], ["kg"])
    changed = [question(rng, names[4:], list(range(40, 400)), ["lb", "g", "tonnes", "liters"]) for _ in range(100)]
    wrong = item.replace("12", "9").replace("7", "9").replace("30", "9")
    texts = list(enumerate([*(f"We ask: {c} Good luck." for c in changed), f"so {wrong} now"]))
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {r["doc_id"] for r in leaks(docs(spark, texts), bench).collect()}
    assert 100 not in got
    assert len(got) >= 90


def test_ring_equals_a_literal_walk(spark):
    """Each row in turn goes clockwise to the first shard with room: rows of an arc by position, arcs' own rows first."""
    from lumenspan.llm.sharding import bounded_ring, position, ring_points

    n, shards, vnodes = 500, 6, 8
    got = {r["doc_id"]: r["shard"] for r in bounded_ring(docs(spark, [(i, f"t{i}") for i in range(n)]), shards=shards, vnodes=vnodes).collect()}
    points = ring_points(shards, vnodes)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    arcs = [[] for _ in points]
    for i in range(n):
        pos = position(f"doc {i}")
        arcs[sum(p < pos for p, _ in points) % len(points)].append(i)
    # Own arcs first: which rows stay is told by counts, so compare counts per arc and shard.
    own = [min(len(arcs[a]), 10**9) for a in range(len(points))]
    left = []
    for a, (_, s) in enumerate(points):
        take = min(own[a], room[s])
        room[s] -= take
        left.append(own[a] - take)
    moved = {a: {} for a in range(len(points))}
    for a in range(len(points)):
        at = a
        while left[a]:
            at = (at + 1) % len(points)
            s = points[at][1]
            take = min(left[a], room[s])
            room[s] -= take
            left[a] -= take
            if take:
                moved[a][s] = moved[a].get(s, 0) + take
    for a, (_, s) in enumerate(points):
        shares = {}
        for i in arcs[a]:
            shares[got[i]] = shares.get(got[i], 0) + 1
        wanted = dict(moved[a])
        stay = len(arcs[a]) - sum(moved[a].values())
        if stay:
            wanted[s] = wanted.get(s, 0) + stay
        assert shares == wanted
    # Movement: with one more shard few rows change theirs.
    more = {r["doc_id"]: r["shard"] for r in bounded_ring(docs(spark, [(i, f"t{i}") for i in range(n)]), shards=shards + 1, vnodes=vnodes).collect()}
    assert sum(got[i] != more[i] for i in got) <= n * 0.45


def test_repeated_and_neighbouring_licenses(spark):
    from lumenspan.llm.license_scan import scan_licenses

    line = "All rights reserved. "
    gap = " ".join(f"q{i}" for i in range(40))
    texts = [line * n for n in (1, 3, 4, 5, 6, 8, 200)] + [(line + "\n") * 6]
    texts += [f"{gap} Licensed under CC BY-NC 4.0 {gap} {line} {gap}", f"{gap} rights of all {gap}", "mit license " * 3000]
    got = scan_licenses(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["all-rights-reserved"] * 8 + ["all-rights-reserved,cc-by-nc", "", "mit"]
    assert got[-1]["n_base"] == 3000 and got[-1]["last_word"] == 5998


def test_pages_without_an_article_tag(spark):
    from lumenspan.llm.html_text import extract_text, main_text

    p = "one two, three four words of plain prose here and some more of it. "
    page = f"""<body><div class="top"><a href=1>home</a> <a href=2>about</a></div><div class="wrap"><h1>Title</h1>
      <div class="content"><p>{p * 4}</p><p>{p * 3}</p><ul><li>item one</li><li>item two</li></ul></div>
      <div class="section"><h2>More</h2><p>Short part.</p></div>
      <ul class="links"><li><a href=3>a very long link to another page</a></li><li><a href=4>one more long link</a></li></ul></div>
      <div class="sidebar"><p>{p}</p></div><div class="comments"><p>{p * 9}</p></div><div hidden>secret</div><footer>foot</footer></body>"""
    wanted = ["Title", (p * 4).strip(), (p * 3).strip(), "item one", "item two", "More", "Short part."]
    assert main_text(page).split("\n\n") == wanted
    inside = f"<article><h1>T</h1><div><p>{p * 3}</p><p>{p * 2}</p></div><ul><li>item one</li></ul></article>"
    assert main_text(inside).split("\n\n") == ["T", (p * 3).strip(), (p * 2).strip(), "item one"]
    # A doubtful name does not remove what holds most of the text.
    assert main_text(f"<body><div class='header social'><p>{p * 5}</p></div><div class='share'>tell others</div>") == (p * 5).strip()
    assert main_text("<font>" * 3000 + "<hr>" * 3000 + p) == p.strip()
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (None, None, None, None, None), (2, "u", "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = extract_text(pages).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len("\n\n".join(wanted)), len("\n\n".join(wanted))]
    assert extract_text(pages.limit(0)).count() == 0


def test_token_count_query(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from lumenspan.llm.token_counts import count_tokens, zipf_vocabulary

    path = str(public.path("piece_bpe_32k.model"))
    vocabulary, unknown = zipf_vocabulary(path)
    tok = Tokenizer(models.Unigram(vocabulary, unknown, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = [None, "", " ", "the quick brown fox", "the quick brown fox", "日本語 😀", "x" * 500]
    got = sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(docs(spark, list(enumerate(texts))), path).collect())
    assert got == [(i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]


def test_warc_of_repeated_rows(spark):
    from lumenspan.llm.warc import archived_pages

    rows = [(7, "u", "same")] * 3 + [(None, "u", "same")] * 2 + [(8, "u", "other")]
    got = archived_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    kinds = sorted((str(r["key"]), r["record_type"]) for r in got)
    assert kinds == [("7", "response"), ("7", "revisit"), ("7", "revisit"), ("8", "response"), ("None", "revisit"), ("None", "revisit")]


def test_join_of_a_large_family(spark):
    """Copies of one text with edits of their own: the components of the exact links, whatever hubs are chosen."""
    from test_llm import brute_components

    from lumenspan.llm.jaccard_join import similar_documents

    rng = random.Random(2)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"z{rng.randrange(60)}"], [words[at], "and"]])
        texts.append(" ".join(words))
    for percent in (80, 90):
        got = sorted(tuple(r)[:3] for r in similar_documents(docs(spark, list(enumerate(texts))), percent=percent).collect())
        assert got == brute_components(texts, percent=percent)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on its own input: what it drops and keeps, and the packed pieces of what is left."""
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    rng = random.Random(8)
    words = [f"word{i}" for i in range(4000)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    item = prose(30)
    texts = [prose(rng.choice([80, 200, 400])) for _ in range(120)]
    near = texts[5].split()
    near[40] = "changed"
    rows = list(enumerate(texts))
    rows += [(200, texts[3]), (201, " ".join(near)), (202, f"{prose(60)} {item} {prose(60)}"), (203, "too short"), (204, None), (205, "")]
    rows += [(300 + i, "### ".join(f"w{(i + j) % 9}" for j in range(80))) for i in range(60)]
    rows += [(2, texts[2])]
    documents = docs(spark, rows)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    label = [(i, 1, 0) for i in range(0, 120, 2)] + [(300 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(label, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(c.STAGES)
    names = list(stages)
    d, seen = documents, []
    for name in names[:-1]:
        d = stages[name](spark, d, str(tmp_path))
        assert d.columns == c.COLUMNS
        d.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        d = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        seen.append(sorted(r["doc_id"] for r in d.select("doc_id").collect()))
    clean = sorted([*range(120), 2])
    assert seen[0] == sorted([*clean, 200, 201, 202]) and seen[1] == seen[0]
    assert seen[2] == sorted([*range(120), 202])
    assert seen[3] == sorted(range(120))
    packed = stages[names[-1]](spark, d, str(tmp_path)).collect()
    tok = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    size = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in d.collect()}
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == size
    # Empty tables go through all stages.
    none = documents.limit(0)
    for name in names:
        none = stages[name](spark, none, str(tmp_path))
        assert none.count() == 0
    run = c.run(spark, str(tmp_path))
    assert sorted({r["doc_id"] for r in run.collect()}) == list(range(120))
