"""Benchmark leaks by canonical templates.

Numbers, names and units become typed placeholders, so a question with other values gives the same template.  Windows
of ``k`` template words of all documents are hash-joined with those of the benchmark.  A document leaks an item if
enough of the item's windows stand on one diagonal of it (the item's words in order, give or take a few), and the slot
values agree: an item's value must always stand for the same value of the document, and the other way round.

A window needs words of its own for half its length at least, or for three eighths if it holds two numbers or more;
otherwise placeholders alone would match.  Signs of arithmetic are words.  One with fewer matches only with the same
words, values included; for this every capitalised word and every unit counts as a placeholder, so that what stands
before the window makes no difference.

A capital letter doesn't tell a name from a sentence's first word, nor does a text in lower case have any.  Windows are
therefore hashed in three ways, on both sides, where these differ: with the first word of a sentence as a word, with
every capitalised word as a name, and with every name as a word in lower case.  As an item can stand inside a sentence
of a document, its first word is also looked up as what it would be there.

Documents are read once: of their windows only those pass whose hash is in a bitmap of the benchmark's hashes, which
has a fixed largest size, and only for these are slot values taken.

Cases: null or empty texts have no windows and leak nothing.  Items with fewer than ``k`` words are looked up as one
window of their own length; items without a letter or digit never match.  Words are never kept for longer than a
bounded cache of theirs, so very long words or texts cost no more memory than themselves.  Repeated items are reported for each item_id.  Repeated
rows of a document are counted together, as they hold the same text; a null doc_id leaks nothing that could be named.
Empty tables give an empty result.  Other columns of the documents are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspan.llm.words import window_hashes
from lumenspan.store import broadcast_if_small, staged

#: Units of measurement that may follow a number; fixed list of common symbols and words.
UNITS = frozenset(
    "mm cm m km mi ft in yd mg g kg lb lbs oz t ml l s sec min h hr hz khz mhz ghz w kw kwh v kv a pa kpa n j kj cal "
    "kcal c f k b kb mb gb tb percent usd eur gbp dollar dollars euro euros cent cents pound pounds meter meters metre "
    "metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre "
    "litres ton tons tonne tonnes ounce ounces pint pints gallon gallons yard yards second seconds minute minutes hour hours day days week weeks month months year years degree degrees".split()
)
#: Spelled numbers; fixed list.
NUMBER_WORDS = frozenset(
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
#: Signs of arithmetic that stand alone.
SIGNS = re.compile(r"[+*/=<>×÷^]+")
EDGES = re.compile(r"^[^\w$€£%]+|[^\w%]+$")
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-z]{1,3})")
#: Words are forgotten when those known take about so many bytes.
KEEP_CHARS = 32_000_000
#: Texts are handled in runs of about so many characters.
SLICE_CHARS = 250_000

LITERAL, NAME, NUM, UNIT = range(4)
TYPES = (np.uint64, np.int8, np.bool_)
ROWS = "id long, pos int, h long, slots string"
#: Sets the hashes of windows that match as they are apart from the templates'.
EXACT = np.uint64(0x9E3779B97F4A7C15)


class Canonical:
    """White-space words -> codes; a word's own properties are looked up, its place decides between name and word."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.code, self.kind, self.ends, self.chars = [], [], [], 0
        self.tables: tuple[np.ndarray, ...] = ()

    def _learn(self, word: str) -> int:
        core = EDGES.sub("", word) or ("" if SIGNS.fullmatch(word) is None else word)
        low = core.lower()
        if not core:
            kind = -1
        elif low in NUMBER_WORDS or NUMBER.fullmatch(core) or (m := NUMBER_UNIT.fullmatch(low)) and m[2] in UNITS:
            kind = NUM
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper() and core[1:].islower():
            kind = NAME
        else:
            kind = LITERAL
        i = self.ids[word] = len(self.code)
        self.code.append(word_code(low))
        self.kind.append(kind)
        self.ends.append(word.rstrip("\"'”’)]")[-1:] in (".", "!", "?", ":", "…"))
        self.chars += len(word) + 50
        return i

    def __call__(self, texts: list[str]) -> Words:
        """The words of some texts, one after the other."""
        words, sizes = [], []
        for text in texts:
            own = text.split()
            words += own
            sizes.append(len(own))
        if self.chars > KEEP_CHARS:
            self.clear()
        get, learn, known = self.ids.get, self._learn, len(self.code)
        ids = np.fromiter((i if (i := get(w)) is not None else learn(w) for w in words), dtype=np.int64, count=len(words))
        if not self.tables or known != len(self.code):
            new = [np.array(x[known if self.tables else 0 :], t) for x, t in zip((self.code, self.kind, self.ends), TYPES, strict=True)]
            self.tables = tuple(map(np.concatenate, zip(self.tables, new, strict=True))) if self.tables else tuple(new)
        own, kind, ends = (t[ids] for t in self.tables)
        text = np.repeat(np.arange(len(sizes)), sizes)
        real = kind >= 0
        if not real.all():
            own, kind, ends, text = own[real], kind[real], ends[real], text[real]
            words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
        first = np.ones(len(kind), dtype=bool)
        first[1:] = text[1:] != text[:-1]
        starts, after_number = first.copy(), np.zeros(len(kind), dtype=bool)
        starts[1:] |= ends[:-1]
        after_number[1:] = (kind[:-1] == NUM) & ~first[1:]
        placed = np.where((kind == NAME) & starts, LITERAL, kind)
        placed = np.where((placed == UNIT) & ~after_number, LITERAL, placed)
        return Words(words, text, first, own, kind, placed)


@dataclass
class Words:
    """Words of several texts in one row: text number, own code, kind by itself, and kind in its place."""

    words: list[str]
    text: np.ndarray
    first: np.ndarray
    own: np.ndarray
    kind: np.ndarray
    placed: np.ndarray

    def windows(self, size: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None, as_found: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(starts, hashes, where placeholders stand) of the windows that ``wanted`` asks for.

        The template's windows have words of their own for half the length at least; the others are hashed as they are,
        and for these every capitalised word and every unit counts as a placeholder.  With ``as_found`` a text's first
        word is also taken for what it would be inside a sentence.
        """
        n = len(self.own) - size + 1
        if n <= 0:
            return
        inside = self.text[:n] == self.text[size - 1 :]
        # Ways to take a window, and where they give something else than the first.
        ways = [(self.placed, False, None), (self.kind, True, None)]
        for other in (self.kind, np.where(self.placed == NAME, LITERAL, self.placed), *([np.where(self.first, self.kind, self.placed)] if as_found else [])):
            unlike = np.concatenate([[0], np.cumsum(other != self.placed)])
            ways.append((other, False, (unlike[size:] - unlike[:-size]) > 0))
        for kind, exact, where in ways:
            if where is not None and not where.any():
                continue
            literal = kind == LITERAL
            plain = np.concatenate([[0], np.cumsum(literal)])
            plain = plain[size:] - plain[:-size]
            if exact:
                fits = inside & (plain * 2 < size)
            else:
                numbers = np.concatenate([[0], np.cumsum(kind == NUM)])
                numbers = numbers[size:] - numbers[:-size]
                fits = inside & ((plain * 2 >= size) | (plain * 8 >= size * 3) & (numbers >= 2))
            if where is not None:
                fits &= where
            if not fits.any():
                continue
            h = window_hashes(self.own if exact else np.where(literal, self.own, kind.astype(np.uint64)), size)
            h = h ^ (EXACT if exact else np.uint64(0)) ^ np.uint64(size)
            if wanted is not None:
                fits &= wanted(h)
            at = np.flatnonzero(fits)
            if len(at):
                # Words that are the same in another case can differ in being names only.
                yield at, h[at], (kind == NUM) | (kind == UNIT) if exact else ~literal

    def slots(self, start: int, size: int, open_: np.ndarray) -> str | None:
        """The values at a window's placeholders."""
        at = np.flatnonzero(open_[start : start + size])
        return "\x1f".join((EDGES.sub("", w) or w).lower() for w in (self.words[start + i] for i in at)) if len(at) else None


def word_code(low: str) -> int:
    return xxhash.xxh3_64_intdigest(low) | 8  # apart from the placeholders' codes


class HashFilter:
    """A bitmap of the low bits of the hashes that are looked for; what passes is joined exactly afterwards.

    Its size follows from their number and ends at 2^27 bits (16 MB), whatever the benchmark's size.
    """

    def __init__(self, hashes: DataFrame):
        n = max(hashes.count(), 1)
        self.bits = min(27, max(18, (64 * n).bit_length()))
        low = F.col("h").bitwiseAND(F.lit((1 << self.bits) - 1))
        parts = hashes.select(F.shiftright(low, 15).alias("part"), low.bitwiseAND(F.lit(32767)).alias("at"))
        parts = parts.groupBy("part").agg(F.bitmap_construct_agg("at").alias("map"))
        table = np.zeros(1 << self.bits - 3, dtype=np.uint8)
        for part, found in parts.collect():  # 2^12 rows of 4 KB at most
            table[part * 4096 : part * 4096 + 4096] = np.frombuffer(found, dtype=np.uint8)
        self.table = hashes.sparkSession.sparkContext.broadcast(table)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        low = h & np.uint64((1 << self.bits) - 1)
        return (self.table.value[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def template_windows(rows: DataFrame, lengths: list[int], k: int, wanted: HashFilter | None) -> DataFrame:
    """(id, text) -> a row per window that ``wanted`` lets pass, with the window's slot values, if it has any.

    Documents get windows of all ``lengths``.  Without ``wanted`` the texts are items: all their windows of ``k`` words
    are given, and a shorter item is one window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for whole in batches:
            ids, texts = whole.column("id").to_pylist(), whole.column("text").to_pylist()
            for part in _parts(texts, SLICE_CHARS if wanted else 0):
                own = canonical([t or "" for t in texts[part]])
                begins = np.searchsorted(own.text, np.arange(part.stop - part.start))
                out = []
                for size in lengths if wanted else [min(k, len(own.own))]:
                    if not size:
                        continue
                    for at, h, open_ in own.windows(size, wanted, as_found=wanted is None):
                        text = own.text[at]
                        place = at - begins[text]
                        for i, t, p, x in zip(at.tolist(), text.tolist(), place.tolist(), h.view(np.int64).tolist(), strict=True):
                            out.append((ids[part.start + t], p, x, own.slots(i, size, open_)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)],
                        ["id", "pos", "h", "slots"],
                    )

    return rows.mapInArrow(run, ROWS)


def _parts(texts: list[str | None], chars: int) -> Iterator[slice]:
    """Runs of texts of about so many characters, one at least."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 8, least_percent: int = 50, drift: int = 4) -> DataFrame:
    """A row for each document and item it leaks: place, share of the item's windows, slots and their agreement."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null")
    items = staged(template_windows(items, [k], k, None).withColumnRenamed("id", "item_id"), "item-windows")
    wanted = HashFilter(items.select("h").distinct())
    sizes = items.groupBy("item_id").agg(F.countDistinct("pos").alias("item_windows"))
    item_side = items.select("item_id", F.col("pos").alias("item_pos"), "h", F.col("slots").alias("item_slots")).distinct()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    windows = template_windows(rows, template_lengths(benchmark, k), k, wanted)
    # Benchmarks are small as a rule, but the size is checked; a large one is joined by a shuffle.
    hits = windows.join(broadcast_if_small(item_side), "h").select(F.col("id").alias("doc_id"), "pos", "slots", "item_id", "item_pos", "item_slots")
    hits = staged(hits.withColumn("diagonal", F.col("pos") - F.col("item_pos")), "hits")
    # Diagonals next to each other count as one: an inserted word moves the rest of the item by one.
    band = F.floor(F.col("diagonal") / (drift + 1))
    place = ["doc_id", "item_id", "band"]
    banded = hits.withColumn("band", F.explode(F.array(band, band + 1)))
    found = banded.groupBy(*place).agg(F.countDistinct("item_pos").alias("windows"), F.min("pos").alias("first_word"))
    enough = found.join(broadcast_if_small(sizes), "item_id").where(F.col("windows") * 100 >= F.col("item_windows") * least_percent)
    # Of an item's window that a band holds several times (a pattern that repeats) the hit counts whose diagonal has
    # most windows.  The slot values there, pairs (item's, document's), must be one to one.
    votes = banded.join(enough.select(*place), place)
    by_diagonal = votes.groupBy(*place, "diagonal").agg(F.countDistinct("item_pos").alias("votes"))
    votes = votes.join(by_diagonal, [*place, "diagonal"]).groupBy(*place, "item_pos")
    votes = votes.agg(F.max_by(F.struct("item_slots", "slots"), F.struct("votes", -F.col("pos"))).alias("s"))
    pair = F.explode(F.arrays_zip(F.split("s.item_slots", "\x1f").alias("i"), F.split("s.slots", "\x1f").alias("d")))
    slot = votes.where("s.slots is not null").select(*place, pair.alias("p")).select(*place, "p.i", "p.d").distinct()
    slot = slot.groupBy(*place).agg(
        F.count("*").alias("n_slot_pairs"),
        F.countDistinct("i").alias("n_item_values"),
        F.countDistinct("d").alias("n_doc_values"),
        F.max((F.col("i") != F.col("d")).cast("int")).alias("changed"),
    )
    out = enough.join(slot, place, "left")
    consistent = F.col("n_slot_pairs") == F.least("n_item_values", "n_doc_values")
    fits = out.withColumn("slots_agree", F.coalesce(consistent, F.lit(True))).where("slots_agree")
    # Of the bands that agree the one with most windows, of such the first.
    names = ["item_windows", "n_slot_pairs", "changed"]
    order = F.struct("windows", -F.col("first_word"), "band")
    best = fits.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("windows", "first_word", "slots_agree", *names), order).alias("b"))
    return best.select("doc_id", "item_id", "b.*").select(
        "doc_id",
        "item_id",
        F.col("first_word").cast("long").alias("first_word"),
        F.col("windows").cast("long").alias("matched_windows"),
        F.col("item_windows").cast("long").alias("item_windows"),
        F.coalesce("n_slot_pairs", F.lit(0)).cast("long").alias("slot_pairs"),
        "slots_agree",
        (F.coalesce("changed", F.lit(0)) == 1).alias("other_values"),
    )


def template_lengths(benchmark: DataFrame, k: int) -> list[int]:
    """The window lengths documents need: k, and those of shorter items (k values at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical()
        for batch in batches:
            found = {min(k, len(canonical([t]).own)) for t in batch.column("text").to_pylist() if t}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found - {0}), pa.int32())], ["size"])

    sizes = benchmark.select("text").mapInArrow(run, "size int").distinct().collect()
    return sorted(r["size"] for r in sizes) or [k]
