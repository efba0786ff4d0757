"""Benchmark decontamination with an FM-index per shard of documents.

A shard is a few megabytes of documents. Words that no benchmark item uses end a
stretch; stretches shorter than every phrase cannot contain one and are not
indexed. All phrases are searched backwards at once, their occurrences are located
by sampled suffix positions, and overlapping ones are merged to removal spans. The
documents never leave their task; the phrases are broadcast in slices of bounded
size, one pass over the documents per slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lightbox.llm.batches import pieces, whole_row
from lightbox.llm.fm_index import FMIndex
from lightbox.session import durable

WINDOW = 10
# Words of all phrases that one pass broadcasts (about 60 MB).
SLICE_WORDS = 4_000_000
# Words that one index holds; stretches are never cut.
SHARD_WORDS = 1_000_000
# Lower-case A-Z; other ASCII outside 0-9 and a-z separates words, everything else belongs to them.
TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else (c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


def phrases(benchmark: DataFrame, text: str = "text", id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(phrase array<string>, items array<string>): every window of the items, each phrase once.

    An item shorter than the window, but not empty, is one phrase. Items
    without an id, null and empty texts add phrases or nothing, but no item.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, phrase = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(t)
                for a in range(max(1, len(words) - window + 1) if words else 0):
                    item.append(i)
                    phrase.append(b" ".join(words[a : a + window]).decode("utf-8", "replace"))
            yield pa.record_batch({"item": pa.array(item, pa.string()), "phrase": pa.array(phrase, pa.string())})

    rows = benchmark.select(F.col(id).cast("string").alias("item"), F.col(text).cast("string").alias("t"))
    return (
        rows.mapInArrow(run, "item string, phrase string")
        .groupBy("phrase").agg(F.collect_set("item").alias("items"))
    )


class PhraseBook:
    """A slice of the phrases as word numbers."""

    def __init__(self, entries: list[tuple[str, list[str]]]):
        self.number: dict[bytes, int] = {}
        split = [phrase.encode().split() for phrase, _ in entries]
        self.lengths = np.array([len(w) for w in split], np.int64)
        self.patterns = np.zeros((len(split), int(self.lengths.max(initial=1))), np.int64)
        for i, words in enumerate(split):
            for j, w in enumerate(words):
                self.patterns[i, j] = self.number.setdefault(w, len(self.number) + 1)
        self.items = [items for _, items in entries]
        self.alphabet = len(self.number) + 1
        self.shortest = int(self.lengths.min(initial=1))


def _stretches(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the runs of known words that can hold a phrase."""
    known = np.concatenate([[0], ids != 0, [0]]).astype(np.int8)
    edge = np.diff(known)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= shortest
    return begin[long], end[long]


def occurrences(ids: np.ndarray, book: PhraseBook, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(position, phrase number) of every occurrence of a phrase in the sequence ``ids``."""
    begin, end = _stretches(ids, book.shortest)
    places, numbers = [], []
    total = np.cumsum(end - begin + 1)
    at = 0
    while at < len(begin):
        done = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, done + shard_words, side="right")))
        size = end[at:upto] - begin[at:upto] + 1
        start = np.cumsum(size) - size
        # Position in ``ids`` of every indexed word, 0 at the ends of stretches.
        source = np.arange(int(size.sum())) + np.repeat(begin[at:upto] - start, size)
        symbols = ids[np.minimum(source, len(ids) - 1)].copy()
        symbols[start + size - 1] = 0
        index = FMIndex(symbols, book.alphabet)
        low, high = index.search(book.patterns, book.lengths)
        hits = high - low
        if hits.sum():
            number = np.repeat(np.arange(len(hits)), hits)
            offset = np.arange(int(hits.sum())) - np.repeat(np.cumsum(hits) - hits, hits)
            places.append(source[index.locate(low[number] + offset)])
            numbers.append(number)
        at = upto
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(numbers)


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_batch(texts: list[bytes | None], book: PhraseBook) -> tuple[list[int], list[list], list[set]]:
    """(words, merged word spans, items) of each text of a shard."""
    number = book.number.get
    parts, counts = [], []
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        parts.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    place, phrase = occurrences(ids, book)
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if len(place):
        order = np.argsort(place, kind="stable")
        place, phrase = place[order], phrase[order]
        doc = np.searchsorted(starts, place, side="right") - 1
        end = place + book.lengths[phrase]
        for d in np.unique(doc):
            mine = slice(*np.searchsorted(doc, [d, d + 1]))
            base = int(starts[d])
            spans[d] = _merged(list(zip((place[mine] - base).tolist(), (end[mine] - base).tolist())))
            for p in np.unique(phrase[mine]):
                items[d].update(book.items[p])
    return counts, spans, items


def _pass(rows: DataFrame, text: str, entries) -> DataFrame:
    """Add what one slice of phrases finds to (..., n_words, spans, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = PhraseBook(entries.value)
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch, texts in pieces(batches, text):
            counts, spans, items = search_batch(texts, book)
            columns = dict(zip(batch.schema.names, batch.columns))
            for d, old in enumerate(columns["spans"].to_pylist()):
                if old:
                    spans[d] = _merged(spans[d] + [(s["begin"], s["end"]) for s in old])
            for d, old in enumerate(columns["items"].to_pylist()):
                items[d].update(old or ())
            columns["n_words"] = pa.array(counts, pa.int64())
            columns["spans"] = pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], kind)
            columns["items"] = pa.array([sorted(i) for i in items], pa.list_(pa.string()))
            yield pa.record_batch(columns)

    return rows.mapInArrow(run, rows.schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text",
    benchmark_text: str = "text", item_id: str = "item_id", window: int = WINDOW, slice_words: int = SLICE_WORDS,
) -> DataFrame:
    """The columns of ``docs``, n_words, spans and items of every row; spans are [begin, end) in words.

    ``text`` is a column, or a field ``row.name`` of a struct column ``row``. Null and empty texts have no words. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    found = durable(phrases(benchmark, benchmark_text, item_id, window))
    n = found.count()
    slices = max(1, -(-n * window // slice_words))
    rows = docs.select(
        "*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for i in range(slices):
        mine = found if slices == 1 else found.where(F.pmod(F.xxhash64("phrase"), F.lit(slices)) == i)
        # Plain lists: a broadcast is unpickled without this package.
        entries = spark.sparkContext.broadcast([(r["phrase"], r["items"]) for r in mine.collect()])
        rows = _pass(rows, text, entries)
        if slices > 1:
            rows = durable(rows)
    return rows


def contamination(
    docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    named = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    found = find_leaks(named, benchmark, "text", **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no phrase of the benchmark occurs, with all their columns."""
    found = find_leaks(docs.select(whole_row(docs)), benchmark, f"row.{text}", **options)
    return found.where(F.size("spans") == 0).select("row.*")


def cut_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows of ``docs`` with the removal spans cut out of their texts.

    A cut runs from the first to the last byte of a span's words; what separates
    it from its neighbours stays.
    """
    found = find_leaks(docs.select(whole_row(docs)), benchmark, f"row.{text}", **options)

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, _cut)

    cleaned = cut(F.col("row").getField(text), F.col("spans"))
    return found.withColumn("row", F.when(F.size("spans") > 0, F.col("row").withField(f"`{text}`", cleaned)).otherwise(F.col("row"))).select("row.*")


def _cut(text, spans):
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode()
    flat = np.frombuffer(raw.translate(TO_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], flat, [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : begin[s["begin"]]])
        at = end[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode()
