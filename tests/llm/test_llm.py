import itertools
import zlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"w{i}" for i in range(3000))


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", "   ", "one", "one two", "a b c", "a b c", LONG, LONG]


def brute_components(texts, percent=90):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_jaccard_join(spark):
    from lumenspan.llm.jaccard_join import similar_documents

    base = [f"t{i * 7919 % 1000}" for i in range(60)]
    near = [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in (0, 1, 59, 58, 30)]
    texts = [*EDGE, " ".join(base), *near, *(" ".join(base + [f"z{i}"] * i) for i in range(8))]
    got = sorted(tuple(r) for r in similar_documents(docs(spark, texts)).collect())
    assert got == brute_components(texts)


def test_jaccard_join_of_short_and_full_prefixes(spark):
    from lumenspan.llm.jaccard_join import similar_documents

    # Every shingle is frequent, and each pair of similar documents hangs on its own link.
    parts = [[f"p{p}w{i}" for i in range(120)] for p in range(8)]
    texts = []
    for three in itertools.combinations(parts, 3):
        words = [w for p in three for w in p]
        texts += [" ".join(words), " ".join(words[:310])]
    got = sorted(tuple(r) for r in similar_documents(docs(spark, texts), percent=80).collect())
    assert got == brute_components(texts, percent=80)


def test_packing_plan_is_whole_and_gapless():
    from lumenspan.llm.packing import packing_plan

    for counts in ({}, {1: 5}, {1024: 3, 600: 10, 500: 3}, {k: k % 7 for k in range(1, 1024)}):
        counts = {k: n for k, n in counts.items() if n}
        fill, seen = {}, {}
        for length, first, end, sequence, each, offset in packing_plan(counts, 1024):
            for r in range(first, end):
                fill.setdefault(sequence + (r - first) // each, []).append((offset + (r - first) % each * length, length))
            seen[length] = seen.get(length, 0) + end - first
        assert seen == counts
        for places in fill.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024


def best_fit_sequences(counts, capacity):
    room, sequences = [0] * (capacity + 1), 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            free = next((f for f in range(length, capacity + 1) if room[f]), None)
            if free is None:
                sequences, free = sequences + 1, capacity
            else:
                room[free] -= 1
            room[free - length] += 1
    return sequences


def test_packing_plan_needs_no_more_than_best_fit():
    import random

    from lumenspan.llm.packing import packing_plan

    rng = random.Random(8)
    for spread in (60, 300, 700, 1024):
        counts = {}
        for _ in range(6000):
            length = 1 + int(min(rng.expovariate(1 / spread), 1023))
            counts[length] = counts.get(length, 0) + 1
        plan = packing_plan(counts, 1024)
        used = max(first + -(-(end - begin) // each) for _, begin, end, first, each, _ in plan)
        assert used <= best_fit_sequences(counts, 1024)


def test_token_ids_equal_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lumenspan.llm.packing import TokenIds

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    ids = TokenIds(path)
    for t in ["", "a  b", "\n\n x", " a", "it's 12ab ,x", "x\ty", "日本 語\n45,6", LONG, "Hello world.\nNew line"]:
        assert ids(t) == b"".join(i.to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids)


def test_unigram_counts_equal_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer, models, pre_tokenizers

    from lumenspan.llm.token_counts import UnigramCounter, zipf_vocabulary

    vocabulary, unknown = zipf_vocabulary(public.path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(vocabulary, unknown, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    own = UnigramCounter(vocabulary, unknown)
    for t in ["", " ", "  a", "日本語\n😀x", "a▁b", "éß ñ", "the quick brown fox. Of the\nlines", LONG]:
        assert own.text(t) == len(tok.encode(t, add_special_tokens=False).ids), t


def test_long_words_are_counted_in_bounded_memory():
    public = pytest.importorskip("public_tokenizers")
    import random
    import tracemalloc

    from tokenizers import Tokenizer, models, pre_tokenizers

    from lumenspan.llm.token_counts import UnigramCounter, zipf_vocabulary

    vocabulary, unknown = zipf_vocabulary(public.path("piece_bpe_32k.model"))
    own = UnigramCounter(vocabulary, unknown)
    tok = Tokenizer(models.Unigram(vocabulary, unknown, True))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(5)
    pieces = [p.replace("▁", "") for p, _ in vocabulary if not p.startswith("<")] + ["日", "😀", "é"]
    mixed = "".join(rng.choice(pieces) for _ in range(6_000))
    assert len(mixed) > 20_000
    assert own.text(mixed) == len(tok.encode(mixed, add_special_tokens=False).ids)
    word = mixed * 10
    tracemalloc.start()
    try:
        own.text(word)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24 * len(word) + (4 << 20)


def test_warc_finds_the_same_responses_by_a_shuffle(spark):
    from lumenspan.llm.warc import deduplicated

    rows = [(i, f"u{i}", ["", "one", "two", None, f"own {i}"][i % 5]) for i in range(200)] + [(None, "u", "one")]
    for repeats in ([], [(3, "u3", None), (1, "u1", "one")]):
        table = spark.createDataFrame(rows + repeats, "key long, url string, html string")
        table = table.selectExpr("key", "url", "encode(html, 'UTF-8') payload")
        for least in (0, 1):
            got = [deduplicated(table, least, limit) for limit in (64 << 20, -1)]
            small, large = (sorted(map(str, d.drop("url").collect())) for d in got)
            assert small == large and len(small) == len(rows) + len(repeats)
            assert sum("revisit" in r for r in small) > 50


def test_warc_round_trip(spark):
    from lumenspan.llm.warc import archived_pages

    rows = [(1, "u", "<p>x"), (2, None, "<p>x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (None, "u", "<p>x"), (2, None, "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archived_pages(spark, pages).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["payload_digest"], []).append(r)
    for same in by.values():
        assert [r["record_type"] for r in same].count("response") == 1
    assert {r["refers_to"] for r in got if r["payload_bytes"] == 4 and r["record_type"] == "revisit"} == {2}
    assert {r["payload_bytes"] for r in got} == {0, 4, 10000}
    assert archived_pages(spark, pages.limit(0)).count() == 0


def test_html_text():
    from lumenspan.llm.html_text import main_text

    article = "<article><h1>T &amp; U</h1><p><b>One,  two, three words of prose here.<br><p>Second block of the article text.</article>"
    page = f"<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>{article}<div id=comments><p>nice, very nice, I like this a lot</div><footer>f</footer>"
    assert main_text(page) == "T & U\n\nOne, two, three words of prose here.\n\nSecond block of the article text."
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == ""


def test_quality_rules(spark):
    from lumenspan.llm.quality_rules import quality_rules

    prose = ".\n".join(" ".join(f"word{i}x{j}" for j in range(20)) for i in range(5)) + "."
    menu = prose + "\n" + " | ".join(f"m{i}" for i in range(200))
    repeats = "the same four words " * 30
    got = quality_rules(docs(spark, [*EDGE, prose, menu, repeats])).orderBy("doc_id").collect()
    assert [r["kept"] for r in got[-3:]] == [True, False, False]
    assert not any(r["kept"] for r in got[:7])
    assert got[-1]["n_repeat_words"] == 120 and got[5]["n_repeat_words"] == 0
    assert quality_rules(docs(spark, [prose, None])).where("kept").count() == 1


def test_decontamination(spark):
    from lumenspan.llm.decontamination import leaks

    item = "How many apples does Anna Maria buy if each of the 12 boxes holds 5 kg of green fruit from the farm near town today"
    other = item.replace("12", "31").replace("5 kg", "9 kg").replace("Anna Maria", "Peter Paul")
    torn = item.replace("12", "31") + " x " + item.replace("12", "77")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    clean = " ".join(f"q{i}" for i in range(80))
    got = {(r["doc_id"], r["item_id"], r["other_values"]) for r in leaks(docs(spark, [*EDGE, f"x y. {item} z", f"Then: {other}", clean]), bench).collect()}
    assert got == {(9, 1, False), (10, 1, True)}
    assert torn
    assert leaks(docs(spark, []), bench).count() == 0


def test_sharding(spark):
    from lumenspan.llm.sharding import bounded_ring

    texts = [*EDGE, *(f"t{i}" for i in range(400))]
    got = bounded_ring(docs(spark, texts), shards=7, vnodes=16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert bounded_ring(docs(spark, []), shards=7, vnodes=16).count() == 0


def test_license_scan(spark):
    from lumenspan.llm.license_scan import scan_licenses

    texts = [*EDGE, "a Licensed under the Apache License, Version 2.0. b", "The MIT license and the MIT LICENSE", "Licensed under CC BY-NC 4.0."]
    got = scan_licenses(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got[-3:]] == ["apache", "mit", "cc-by-nc"]
    assert (got[-2]["n_base"], got[-2]["first_word"], got[-2]["last_word"]) == (2, 1, 5)
    assert all(r["labels"] == "" and r["score"] == 0 for r in got[:9])


def test_classifier_on_held_out(spark):
    from lumenspan.llm.quality_classifier import classify

    good = [" ".join(f"w{(i * 7 + j * 13) % 97}" for j in range(60)) + "." for i in range(150)]
    bad = ["### ".join(f"w{(i + j) % 9}" for j in range(60)) for i in range(150)]
    d = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in classify(d, labels).collect()}
    assert sum(got[i] == (i < 150) for i in range(0, 300, 2)) >= 147
    assert all(r["score"] == 1.0 for r in classify(d, labels.limit(0)).collect())


def test_decontamination_of_values_and_places(spark):
    from lumenspan.llm.decontamination import leaks

    sums = "12 + 15 = 27 and 31 + 44 = 75 and 18 + 90 = 108 and 7 + 6 = 13"
    names = "Anna Maria Peter Paul Luise Karl Otto Emil Frida Greta Hans Inge"
    title = "What Is The Capital City Of The World"
    item = "in box 3 we put 14 red apples then in box 5 we put 16 red pears and in crate 7 we put 18 red plums last of all"
    wrong = item.replace("3", "8").replace("5", "8").replace("7", "8").replace("14", "8").replace("16", "8").replace("18", "8")
    right = item.replace("14", "24").replace("red plums last of all", "red plums last of them")
    torn = item.replace("3", "31") + " x " + item.replace("3", "77")
    bench = spark.createDataFrame(enumerate([sums, names, title, item]), "item_id long, text string")
    texts = [f"so x {sums} y", f"we met {names} here", f"it asks {title} or so", f"{wrong} " + "q " * 40 + right, torn, wrong]
    texts += [sums.replace("1", "9"), " ".join(reversed(names.split()))]
    got = {(r["doc_id"], r["item_id"], r["other_values"]) for r in leaks(docs(spark, texts), bench).collect()}
    # The same arithmetic with other numbers is the same question.
    assert got == {(0, 0, False), (1, 1, False), (2, 2, False), (3, 3, True), (4, 3, True), (6, 0, True)}


def test_pipeline_drops_near_copies(spark):
    import corpus_pipeline as c

    words = [f"t{i * 7919 % 1000}" for i in range(400)]
    near = [f"n{i}" if i in range(100, 320, 30) else w for i, w in enumerate(words)]
    shares = []
    for k in (3, 5):
        one, two = ({tuple(t[i : i + k]) for i in range(401 - k)} for t in (words, near))
        shares.append(len(one & two) / len(one | two))
    assert shares[0] < 0.9 and shares[1] >= 0.8
    texts = [" ".join(words), " ".join(near), " ".join(reversed(words))]
    got = sorted(r["doc_id"] for r in c.one_of_each(spark, docs(spark, texts), "").collect())
    assert got == [0, 2]


def test_classifier_fitted_on_other_documents(spark):
    from lumenspan.llm.quality_classifier import classify

    good = [" ".join(f"w{(i * 7 + j * 13) % 97}" for j in range(60)) + "." for i in range(150)]
    bad = ["### ".join(f"w{(i + j) % 9}" for j in range(60)) for i in range(150)]
    raw = docs(spark, [*good, *bad])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 2], "doc_id long, quality int, toxic int")
    # What a stage before left: no labelled bad document.
    left = raw.where("doc_id < 150 or doc_id % 2 = 0")
    got = {r["doc_id"]: r["kept"] for r in classify(left, labels, fit_on=raw).collect()}
    assert len(got) == 225 and sum(got[i] == (i < 150) for i in got) >= 220


def test_pipeline_classifier_rejects(spark, tmp_path):
    import corpus_pipeline as c

    # The rules have removed the labelled bad documents; an unlabelled one must go in the next stage.
    good = [" ".join(f"w{(i * 7 + j * 13) % 97}" for j in range(60)) + "." for i in range(150)]
    bad = ["### ".join(f"w{(i + j) % 9}" for j in range(60)) for i in range(150)]
    raw = docs(spark, [*good, *bad])
    raw.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300) if i % 2], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in c.good_quality(spark, raw.where("doc_id < 150 or doc_id % 2 = 0"), str(tmp_path)).collect()}
    assert len(kept & set(range(150))) >= 147 and len(kept - set(range(150))) <= 2
