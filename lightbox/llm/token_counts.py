"""Token counts of a unigram vocabulary: Viterbi that carries only score and piece count.

An Aho-Corasick automaton enumerates the vocabulary pieces in a word; dynamic
programming over its characters keeps the best score of each prefix and how
many pieces it takes. No piece has a word mark after another character, and a
character in no piece stands alone, so a text is counted in parts: split there, the best
whole is made of the best parts. Each part is counted once per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.llm.batches import pieces

# Fixed values of the sentencepiece family: the word mark and the penalty of unknown characters.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED, REMEMBERED_LENGTH = 300_000, 64


@dataclass
class Vocabulary:
    """Pieces with scores; ``bytes_fallback`` counts an unknown character as its UTF-8 bytes."""

    pieces: list[tuple[str, float]]
    bytes_fallback: bool = True


def load_vocabulary(model_file: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece file (at most some 100,000), read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Vocabulary(
        [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids)
    )


class UnigramCounter:
    """Number of pieces of the best segmentation.

    Ties follow the exact tokenizer: prefixes are extended from left to right and
    a later equal score does not replace an earlier one, so the longer last piece
    wins. A character that no single-character piece covers may also stand
    alone as unknown, at the least score minus the penalty.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_fallback = vocabulary.bytes_fallback
        letters = {c for piece, _ in vocabulary.pieces for c in piece}
        if any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary.pieces):
            raise ValueError("a piece has a word mark after another character")
        inside = "".join(re.escape(c) for c in sorted(letters - {MARK}))
        # Marks and what follows them, or one character that no piece has.
        self.parts = re.compile(f"{MARK}*[{inside}]+|{MARK}+|[^{inside}{MARK}]" if inside else f"{MARK}+|[^{MARK}]", re.S)
        self.memory: dict[str, int] = {}

    def part(self, text: str) -> int:
        n = len(text)
        arriving: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, (length, score) in self.automaton.iter(text):
            arriving[last].append((length, score))
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            top = None
            # Longest first: the earliest start wins a tie.
            for length, score in sorted(arriving[end - 1], reverse=True):
                value = best[end - length] + score
                if top is None or value > top:
                    top, best[end], count[end] = value, value, count[end - length] + 1
            letter = text[end - 1]
            if letter not in self.single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    best[end] = value
                    count[end] = count[end - 1] + (len(letter.encode()) if self.bytes_fallback else 1)
        return count[n]

    def count(self, text: str | None) -> int:
        """Pieces of a text; null and empty texts have none."""
        if not text:
            return 0
        total = 0
        for part in self.parts.findall(MARK + text.replace(" ", MARK)):
            known = self.memory.get(part)
            if known is None:
                known = self.part(part)
                if len(part) <= REMEMBERED_LENGTH:
                    if len(self.memory) >= REMEMBERED:
                        self.memory.clear()
                    self.memory[part] = known
            total += known
        return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row, over whole texts, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.pieces, vocabulary.bytes_fallback))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(Vocabulary(*shared.value))
        for batch, texts in pieces(batches, "text"):
            counts = [counter.count(t and t.decode()) for t in texts]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())})

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
