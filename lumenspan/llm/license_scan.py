"""License texts in documents by diagonal voting.

All rolling k-word hashes of all documents are joined with the positions of the same hashes in license templates.  A
hit votes for the diagonal (document position minus template position); votes on neighbouring diagonals are merged,
since inserted or missing words move a text by a few places; and what they span is verified: the template's words must
be covered to a fixed share, and densely enough in the document.  Neighbours are diagonals of one band, whose width
grows with the template's length; bands overlap by half, so a span is never longer than the template and its drift
however often a notice is repeated, and each repetition stands for itself.

Base phrases are places where a short phrase's words stand consecutively; their labels always stay.

Cases: a null text is the empty text: no words, no places, empty labels and score 0.  Texts of fewer than k words
have no k-gram and only base labels.  Repeated rows are scanned one by one; a null doc_id is kept.  An empty table
gives an empty result.  Other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.words import WordHashes, window_hashes
from lumenspan.store import staged

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: License notices and passages of public license texts, (label, text).
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"),
]

#: ASCII but 0-9, A-Z and a-z; all other bytes belong to words.
NOT_WORD = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
AS_SPACE = bytes.maketrans(NOT_WORD + bytes(range(65, 91)), b" " * len(NOT_WORD) + bytes(range(97, 123)))
#: The hash that a document's own row carries instead of a k-gram's.
DOCUMENT = -1

ROWS = (
    "row long, pos int, h long, doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string"
)


def scan_words(text: str) -> list[bytes]:
    return text.encode().translate(AS_SPACE).split()


def base_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        sought = b" " + phrase.encode() + b" "
        at, counted, start = joined.find(sought), 0, 0
        while at >= 0:
            start += joined.count(b" ", counted, at)
            counted = at
            out.append((start, label))
            at = joined.find(sought, at + 1)
    return out


def _grams(docs: DataFrame, k: int, phrases: dict[str, str]) -> DataFrame:
    """A row per k-gram, and one per document with its base columns."""
    names = [re.split(r"\s+", c.strip())[0] for c in ROWS.split(",")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 40
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                part, heads, places, grams, rows = whole.slice(at, 128), [], [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = scan_words(text or "")
                    found = base_places(words, phrases)
                    starts = [p for p, _ in found]
                    labels = ",".join(sorted({x for _, x in found}))
                    heads.append((row, -1, DOCUMENT, doc, len(words), len(found), min(starts, default=None), max(starts, default=None), labels))
                    h = window_hashes(hashes.array(words), k).view(np.int64)
                    grams.append(h)
                    places.append(np.arange(len(h), dtype=np.int32))
                    rows.append(np.full(len(h), row, dtype=np.int64))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*heads, strict=True), types, strict=True)], names)
                arrays = [pa.array(np.concatenate(x)) for x in (rows, places, grams)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(arrays[0]), t) for t in types[3:])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    k: int = 3,
    drift_share: float = 0.125,
    least_cover: float = 0.75,
    least_density: float = 0.5,
) -> DataFrame:
    """Base columns, labels and the best template's covered share of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    hashes, rows, sizes = WordHashes(), [], []
    for i, (label, text) in enumerate(templates):
        words = scan_words(text)
        # Words may be missing or more by a share of the template; a band holds twice its width of diagonals.
        sizes.append((i, label, len(words), 2 + int(len(words) * drift_share)))
        rows += [(int(h), i, p) for p, h in enumerate(window_hashes(hashes.array(words), k).view(np.int64))]
    rows.append((DOCUMENT, -1, -1))
    # One row per word of the templates.
    places = F.broadcast(spark.createDataFrame(rows, "h long, template int, at int"))
    hits = staged(_grams(docs, k, phrases).join(places, "h").drop("h"), "license-hits")
    votes = hits.where("template >= 0").withColumn("diagonal", F.col("pos") - F.col("at"))
    size = F.broadcast(spark.createDataFrame(sizes, "template int, label string, template_words int, band_width int"))
    band = F.floor(F.col("diagonal") / F.col("band_width"))
    votes = votes.join(size, "template").withColumn("band", F.explode(F.array(band, band + 1)))
    spans = votes.groupBy("row", "template", "label", "template_words", "band").agg(
        F.array_sort(F.collect_set("at")).alias("ats"),
        F.countDistinct("pos").alias("grams"),
        (F.max("pos") - F.min("pos") + k).alias("width"),
    )
    # Template words that the matched k-grams cover: each covers k, less what the next one covers again.
    covers = F.aggregate(
        F.transform("ats", lambda a, i: F.least(F.lit(k), F.coalesce(F.get("ats", i + 1) - a, F.lit(k)))), F.lit(0), lambda s, x: s + x
    )
    spans = spans.withColumn("cover", covers / F.col("template_words"))
    dense = F.col("grams") + (k - 1) >= F.col("width") * least_density
    good = spans.where((F.col("cover") >= least_cover) & dense)
    found = good.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("cover").alias("score"))
    out = hits.where("template < 0").join(found, "row", "left")
    base = F.array_remove(F.split("base_labels", ","), "")
    labels = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("score").isNull(), 0.0).otherwise(F.least("score", F.lit(1.0))).cast("double").alias("score"),
    )
