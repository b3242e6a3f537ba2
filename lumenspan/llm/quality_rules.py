"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate); lines that fail are removed; a document that
lost too large a share of its words is rejected, as is one that fails the base rules.

Cases: a null text counts as the empty text; it has no words and is rejected.  Lines without a word are dropped from
the cleaned text and count for nothing.  Repeated rows are judged one by one.  All other columns pass through; the
result columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»•·›→"
#: Phrases of page furniture; a short line that holds one of them is boilerplate.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|click here|read more|"
    "sign (in|up)|log ?in|subscribe|share this|powered by|skip to (main )?content"
)
TERMINAL = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails if, for each hundred words, it has more symbols (or words ending in two marks) than this.
    max_symbol_percent: int = 30
    max_marks_percent: int = 30
    #: Separators of menus per hundred words.
    max_separator_percent: int = 20
    #: A line of so few words that doesn't end a sentence is a menu entry or a heading.
    short_line_words: int = 3
    boilerplate_line_words: int = 20
    #: The document goes if it loses more of its words than this.
    max_lost_percent: int = 30


RESULTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_words", "clean_text", "base_failed", "kept",
]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def char_count(text: Column, chars: str) -> Column:
    """Characters of a regular expression's class ``chars``: one fewer than the pieces between them."""
    return F.size(F.split(text, f"[{chars}]")) - 1


def line_fails(line: Column, words: Column, r: Rules) -> Column:
    n = F.size(words)
    symbols = char_count(line, SYMBOLS)
    marks = F.regexp_count(line, F.lit(r"[!?.,]{2,}(?=[\x20\x09-\x0D]|$)"))
    separators = char_count(line, SEPARATORS)
    return (
        (symbols * 100 > n * r.max_symbol_percent)
        | (marks * 100 > n * r.max_marks_percent)
        | (separators * 100 > n * r.max_separator_percent)
        | ((n <= r.short_line_words) & ~line.rlike(TERMINAL))
        | ((n <= r.boilerplate_line_words) & F.lower(line).rlike(BOILERPLATE))
    )


def repeated_window_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: how many words stand in a three-word window that occurs twice or more in the row.

    Windows are hashed and sorted with their positions, so equal ones are neighbours; sorted positions of those then
    cover three words each, less what the next one covers again.  Each step is a projection of its own, so that a
    lambda reads a computed array instead of computing it for each element.
    """
    w = F.col(words)
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    df = df.withColumn(f"{words}_win", windows)
    repeats = F.size(f"{words}_win") > F.size(F.array_distinct(f"{words}_win"))
    pairs = F.sort_array(F.transform(f"{words}_win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn(f"{words}_win", F.when(repeats, pairs))
    s = F.col(f"{words}_win")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    df = df.withColumn(f"{words}_win", F.sort_array(F.transform(again, lambda x: x["p"])))
    p = F.col(f"{words}_win")
    covers = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    total = F.aggregate(covers, F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop(f"{words}_win")


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Adds the base counts, ``clean_text`` (the lines that stay), ``kept_words``, ``base_failed`` and ``kept``."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Helper columns get names that no input column has.
    at = "_"
    while any(c.startswith(at) for c in docs.columns):
        at += "_"
    lines_at, words_at, good_at, result_at = (at + c for c in ("lines", "words", "good", "result"))
    df = docs.withColumn(lines_at, F.split(t, "\n")).drop(*RESULTS)
    df = df.withColumn(lines_at, F.transform(lines_at, lambda x: F.struct(x.alias("l"), words_of(x).alias("w"))))
    df = df.withColumn(lines_at, F.filter(lines_at, lambda x: F.size(x["w"]) > 0))
    df = df.withColumn(words_at, F.flatten(F.transform(lines_at, lambda x: x["w"])))
    lines = F.transform(lines_at, lambda x: x["l"])
    good = F.filter(lines_at, lambda x: ~line_fails(x["l"], x["w"], rules))
    df = (
        df.withColumn("n_words", F.size(words_at).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(words_at, "")).cast("long"))
        .withColumn("n_symbols", char_count(t, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines_at) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn(good_at, good)
        .drop(lines_at)
    )
    df = repeated_window_words(df, words_at, "n_repeat_words").drop(words_at)
    df = (
        df.withColumn("kept_words", F.aggregate(good_at, F.lit(0), lambda a, x: a + F.size(x["w"])).cast("long"))
        .withColumn("clean_text", F.array_join(F.transform(good_at, lambda x: x["l"]), "\n"))
        .drop(good_at)
        .withColumn(
            "base_failed",
            (F.col("n_words") < rules.min_words)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent),
        )
    )
    lost = (F.col("n_words") - F.col("kept_words")) * 100 > F.col("n_words") * rules.max_lost_percent
    df = df.withColumn("kept", ~F.col("base_failed") & ~lost)
    # A filter on a result must not be pushed down into the steps above: it would put their array expressions into
    # each other's lambdas.  The optimizer doesn't move filters below a row number.
    fixed = F.when(F.monotonically_increasing_id() >= 0, F.struct(*RESULTS))
    df = df.withColumn(result_at, fixed).drop(*RESULTS)
    return df.select("*", *(F.col(f"{result_at}.{c}").alias(c) for c in RESULTS)).drop(result_at)
