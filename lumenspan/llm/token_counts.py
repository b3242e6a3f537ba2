"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates every vocabulary piece in a word, by its end; a Viterbi pass carries the best
score and the number of pieces up to each character.  Rules for ties and unknown characters are the tokenizer's own:
at one end, pieces are tried by their start, leftmost first, and a later one must score higher; a character without a
piece of its own costs the lowest score less ten, and falls back to bytes or joins the unknown piece before it.

Texts are counted word by word (the tokenizer never crosses a space), and counts of words that are not long are kept in
a bounded cache, so words that a task has met are looked up.

The vocabulary comes from a tokenizer file's pieces in order of rank.  Where the file has no log probabilities (BPE
files hold ranks), a piece's score is the log of its share by Zipf's law, 1 / (rank + 2.7); the scores are a parameter.

Cases: null and empty texts have no token.  Repeated rows are counted one by one; null ids are kept.  Very long words
and texts are counted whole; a word takes a few copies of its characters and a window of scores.  An empty table gives an empty result.  Other columns are not carried.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: The cache holds so many words of so many characters at most, about 50 MB.
KEEP, KEEP_CHARS = 200_000, 64
#: Positions of a word that may be held beside those of the longest piece before the oldest go.
HELD = 4_096


def zipf_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id of a sentencepiece file, and the id of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    special = {i for i in range(len(pieces)) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
    order = sorted((i for i in range(len(pieces)) if i not in special), key=lambda i: (-model.get_score(i), i))
    rank = {i: r for r, i in enumerate(order)}
    norm = math.log(sum(1 / (r + 2.7) for r in range(len(order))))
    lowest = -math.log(len(order) + 2.7) - norm
    scores = [-math.log(rank[i] + 2.7) - norm if i in rank else lowest for i in range(len(pieces))]
    return list(zip(pieces, scores, strict=True)), model.unk_id()


class UnigramCounter:
    """Counts the pieces of words as ``tokenizers.models.Unigram`` with byte fallback would cut them."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int, byte_fallback: bool = True):
        self.known = dict(vocabulary)
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.pieces = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if i != unknown_id and piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.longest = max((len(piece) for piece, _ in vocabulary), default=1)
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.seen.get(word)
        if n is None:
            n = self.viterbi(word)
            if len(word) <= KEEP_CHARS:
                if len(self.seen) >= KEEP:
                    self.seen.clear()
                self.seen[word] = n
        return n

    def viterbi(self, word: str) -> int:
        """Pieces of the best cut.  Only the positions that a piece can still begin at are held."""
        best, count, joins = [0.0], [0], False
        matches = self.pieces.iter(word)
        match = next(matches, None)
        for end, character in enumerate(word):
            found = []
            while match is not None and match[0] == end:
                found.append(match[1])
                match = next(matches, None)
            top, own = None, False
            # Longest first is leftmost first; an unknown character is tried last, as its start is the last.
            for size, score in sorted(found, reverse=True):
                total = score + best[-size]
                if size == 1:
                    own = True
                if top is None or total > top:
                    top, pick = total, size
            if not own and (top is None or self.unknown + best[-1] > top):
                top = self.unknown + best[-1]
                pieces = count[-1] + (len(character.encode()) if self.bytes else not joins)
                joins = True
            else:
                pieces, joins = count[-pick] + 1, False
            best.append(top)
            count.append(pieces)
            if len(best) > HELD + self.longest:
                del best[: -self.longest], count[: -self.longest]
        return count[-1]

    def text(self, text: str) -> int:
        """Words begin at spaces, which belong to the word they begin; a text that begins with none gets one."""
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            del words[0]
        return sum(n * self.word(SPACE + w) for w, n in Counter(words).items())


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for whole in batches:
            counter = counter or UnigramCounter(*zipf_vocabulary(model))
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                chars, tokens = [], []
                for value in batch.column("text"):
                    text = value.as_py() or ""
                    chars.append(len(text))
                    tokens.append(counter.text(text))
                arrays = [batch.column("doc_id"), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_chars", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
