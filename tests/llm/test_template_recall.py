"""Recall of re-parameterised questions over ten templates, and precision on unrelated ones of like form."""

import random

NAMES = ["Anna", "Peter", "Maria", "Omar", "Lena", "Ivan", "Chloe", "Ravi", "Sofia", "Hugo", "Mina", "Paul"]
THINGS = ["balls", "apples", "stamps", "coins", "cards"]
TEMPLATES = [
    "{a} has {x} red balls. {a} buys {y} more and gives {z} to {b}. How many red balls does {a} have now?",
    "{x} + {y} = {z} kg and {y} + {w} = {v} kg for {a} and {b}",
    "{a} runs {x} km. {b} runs {y} km. Who runs more and by how much?",
    "How many apples does {a} buy if each of the {x} boxes holds {y} kg of green fruit from the farm near town today",
    "A train leaves the station at {x} km per hour and another one follows {y} hours later at {z} km per hour until they meet",
    "{a} is {x} years old. {b} is {y} years younger. In how many years will {a} be twice as old as {b}?",
    "Compute ({x} * {y}) + {z} = and then divide what you found by {w} to get the share of {a}",
    "{a} and {b} share {x} dollars. {a} gets {y} dollars more than {b}. How much does {b} get?",
    "If {x} workers build a wall in {y} days how many days do {z} workers need for the same wall",
    "{a} reads {x} pages. {b} reads {y} pages a day for a week. {c} reads the rest of the book.",
]


def fill(template, rng):
    names = rng.sample(NAMES, 3)
    numbers = rng.sample(range(2, 900), 5)
    return template.format(**dict(zip("abc", names, strict=True)), **dict(zip("xyzwv", numbers, strict=True)))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_recall_and_precision(spark):
    from lumenspan.llm.decontamination import leaks

    rng = random.Random(13)
    items = [(j, fill(t, rng)) for j, t in enumerate(TEMPLATES)]
    filler = [f"w{i}" for i in range(400)]
    around = lambda q: " ".join([*rng.choices(filler, k=30)]) + ". " + q + " " + " ".join(rng.choices(filler, k=30))
    texts, wanted = [], set()
    for j, t in enumerate(TEMPLATES):
        for _ in range(40):
            wanted.add((len(texts), j))
            texts.append(around(fill(t, rng)))
    many = len(texts)
    for j, q in items:
        for copy in (q, q.lower()):
            wanted.add((len(texts), j))
            texts.append(around(copy))
    verbs = ["paints", "sells", "finds", "carries", "counts", "loses", "draws", "washes"]
    for _ in range(500):
        a, b = rng.sample(NAMES, 2)
        x, y = rng.sample(range(2, 900), 2)
        v, w = rng.sample(verbs, 2)
        texts.append(around(f"{a} {v} {x} {rng.choice(THINGS)} on {rng.choice(['Monday', 'Friday'])}. {b} {w} {y} of them. What is left for {a} at the end?"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs(spark, texts), bench).collect()}
    found = [sum((d, i) in got for d, i in wanted if i == j and d < many) for j in range(len(TEMPLATES))]
    assert min(found) >= 36, found
    assert all(pair in got for pair in wanted if pair[0] >= many)
    assert not {d for d, _ in got if d >= many + 2 * len(items)}
    assert all(i == j for d, i in got for dd, j in wanted if dd == d)
