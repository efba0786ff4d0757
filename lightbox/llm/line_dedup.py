"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of words; the edit bound is one word inserted,
deleted or replaced, for lines of at least five words (a similarity of 0.8), and
none for shorter lines. A line goes if an earlier line, by document id and line
number, is equal or within the bound.

Every variant with one word deleted is emitted as a hashed key. A replaced word
leaves the same variant at the same place in both lines; an inserted word leaves a
variant equal to the whole shorter line. So lines under one key are all within
the bound of each other (or of the whole line), and the least line of each key is
found by aggregation: no pairs are made, however common a line is. The edit
distance of every line that goes to the line that stays is verified in full.

Lines that share neither their first nor their second half with another line
cannot have a partner and emit no variants.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightbox.llm.batches import pieces
from lightbox.session import durable, ensure_checkpoint_dir

MIN_WORDS = 5
# An odd multiplier of the polynomial over word hashes, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> np.ndarray:
    factors = np.full(n, BASE, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _scramble(x: np.ndarray, salt: int) -> np.ndarray:
    """Spread a polynomial value and a salt over 64 bits."""
    x = x ^ np.uint64(salt * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums_of(words: list[bytes], powers: np.ndarray | None = None) -> np.ndarray:
    """Prefix sums of the polynomial: sums[i] covers the first i words.

    ``powers`` are those of :func:`_powers`, made once for many lines.
    """
    n = len(words)
    terms = np.zeros(n + 1, np.uint64)
    known = powers is not None and n <= len(powers)
    np.multiply(_hashes(words), powers[:n] if known else _powers(n), out=terms[1:])
    return np.cumsum(terms, out=terms)


def line_keys(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, hash, halves, which of these hold) of lines given as words, all at once.

    Halves are keys that two lines within the bound share: for each number L of words that the shorter of
    them can have, its first L // 2 words and the rest.
    """
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(n)
    start = end - n
    place = np.arange(int(n.sum())) - np.repeat(start, n)
    longest = int(n.max(initial=0)) + 1
    back = np.full(longest, INVERSE, np.uint64)
    back[:1] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(_hashes(list(chain.from_iterable(lines))) * _powers(longest)[place], out=sums[1:])
    keys, held = np.zeros((len(n), 4), np.uint64), np.zeros((len(n), 4), bool)
    for at, length in ((0, n), (2, n - 1)):
        some = np.flatnonzero(length >= MIN_WORDS)
        size, s, e = length[some], start[some], end[some]
        half = size // 2
        begin = n[some] - (size - half)
        salt = size.astype(np.uint64) * np.uint64(2)
        keys[some, at] = _salted(sums[s + half] - sums[s], salt)
        keys[some, at + 1] = _salted((sums[e] - sums[s + begin]) * back[begin], salt + np.uint64(1))
        held[some, at : at + 2] = True
    return n, _salted(sums[end] - sums[start], n.astype(np.uint64)).view(np.int64), keys.view(np.int64), held


def _salted(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return _scramble(x ^ salt * np.uint64(0xA24BAED4963EE407), 1)


def variant_keys(words: list[bytes], powers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kind, key): 0 a replacement at some place, 1 the whole line, 2 the line without one word."""
    n = len(words)
    sums = sums_of(words, powers)
    with np.errstate(over="ignore"):
        without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
        place = np.arange(n, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        kinds, keys = [np.zeros(n, np.int8)], [_scramble(without ^ place, 2 * n)]
        kinds.append(np.ones(1, np.int8))
        keys.append(_scramble(sums[-1:], 2 * n + 1))
        if n - 1 >= MIN_WORDS:
            kinds.append(np.full(n, 2, np.int8))
            keys.append(_scramble(without, 2 * (n - 1) + 1))
    return np.concatenate(kinds), np.concatenate(keys).view(np.int64)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word inserted, deleted or replaced, or nothing, turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - head - tail <= 1


LINES = "doc_id long, row_no long, line_no int, n_words int, hash long, halves array<long>, line string"


def _split(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Every line of every row, written once; zstd keeps the copy of the texts small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text", 1_000_000):
            split = [(raw or b"").split(b"\n") for raw in texts]
            lines = list(chain.from_iterable(split))
            n, hashed, keys, held = line_keys([line.split() for line in lines])
            each = np.fromiter(map(len, split), np.int64, len(split))
            at = pa.array(np.repeat(np.arange(len(split)), each))
            numbers = np.arange(len(lines)) - np.repeat(np.cumsum(each) - each, each)
            offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))])
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(at), "row_no": batch.column("row_no").take(at),
                "line_no": pa.array(numbers, pa.int32()), "n_words": pa.array(n, pa.int32()), "hash": pa.array(hashed),
                "halves": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[held])),
                "line": pa.array(lines, pa.binary()).cast(pa.string()),
            })

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text).alias("text"))
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    lines = rows.mapInArrow(run, LINES)
    lines.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(lines.schema).parquet(path)


FIRST = "struct(isnull(doc_id) as unnamed, doc_id, row_no, line_no)"


def _partners(lines: DataFrame) -> DataFrame:
    """(hash, n_words, partner): for each distinct line with an earlier line within the bound, the first such."""
    classes = durable(
        lines.where(F.col("n_words") >= MIN_WORDS).groupBy("hash", "n_words").agg(
            F.min(F.expr(FIRST)).alias("first"), F.first("halves").alias("halves")
        )
    )
    halves = classes.select("hash", "n_words", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    candidates = durable(halves.join(shared, "half", "left_semi").select("hash", "n_words").distinct())
    chosen = classes.join(candidates, ["hash", "n_words"], "left_semi").select("hash", "n_words", "first")
    chosen = durable(chosen)
    texts = lines.select("row_no", "line_no", "line")
    placed = chosen.withColumns({"row_no": F.col("first.row_no"), "line_no": F.col("first.line_no")})
    with_text = durable(placed.join(texts, ["row_no", "line_no"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(1 << 12)
        # Small pieces: a line of n words has 2n + 1 variants.
        for batch, texts in pieces(batches, "line", 500_000):
            found = [variant_keys(line.split(), powers) for line in texts]
            at = pa.array(np.repeat(np.arange(len(found)), [len(keys) for _, keys in found]))
            yield pa.record_batch({
                "kind": pa.array(np.concatenate([kinds for kinds, _ in found])),
                "key": pa.array(np.concatenate([keys for _, keys in found])),
                "hash": batch.column("hash").take(at), "n_words": batch.column("n_words").take(at),
                "first": batch.column("first").take(at),
            })

    first = with_text.schema["first"].dataType.simpleString()
    variants = with_text.select("line", "hash", "n_words", "first").mapInArrow(
        run, f"kind byte, key long, hash long, n_words int, first {first}"
    )
    variants = durable(variants)
    whole = F.col("kind") == 1
    least = variants.groupBy("key").agg(
        F.min(F.when(whole, F.col("first"))).alias("whole_first"), F.min(F.when(~whole, F.col("first"))).alias("variant_first"),
        F.count("*").alias("n"),
    ).where("n > 1").drop("n")
    # Under a replacement key all are partners; otherwise whole lines and variants are partners of each other.
    offered = F.when(F.col("kind") == 2, F.col("whole_first")).otherwise(F.col("variant_first"))
    found = (
        variants.join(least, "key").withColumn("partner", offered).where(F.col("partner") < F.col("first"))
        .groupBy("hash", "n_words").agg(F.min("partner").alias("partner"))
    )
    # Verification of each line against its partner, on the words themselves.
    own = with_text.select("hash", "n_words", F.col("line").alias("own_line"))
    partner_text = with_text.select(F.col("row_no").alias("p_row"), F.col("line_no").alias("p_line"), F.col("line").alias("partner_line"))
    paired = found.join(own, ["hash", "n_words"]).join(
        partner_text, (F.col("partner.row_no") == F.col("p_row")) & (F.col("partner.line_no") == F.col("p_line"))
    )

    @F.pandas_udf("boolean")
    def close(a, b):
        return a.combine(b, lambda x, y: within_one_edit(x.encode().split(), y.encode().split()))

    return paired.where(close("own_line", "partner_line")).select("hash", "n_words", "partner")


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line: doc_id, row_no, line_no, line, keep_doc, keep_line, dropped.

    ``keep_doc`` and ``keep_line`` name the first line that is equal or within the
    bound, the line itself where it stays. Lines without words always stay. Lines of
    rows without an id come last. A null text is one empty line.
    """
    lines = _split(docs, id, text)
    worded = lines.where("n_words > 0")
    firsts = worded.groupBy("hash", "n_words").agg(F.min(F.expr(FIRST)).alias("first"), F.count("*").alias("copies"))
    near = _partners(lines)
    # Only lines that occur twice or have a partner need the join; the written table tells its size.
    marked = durable(
        firsts.join(near, ["hash", "n_words"], "left").where("copies > 1 or partner is not null")
        .select("hash", "n_words", F.least("first", F.coalesce("partner", "first")).alias("keep"))
    )
    joined = lines.join(marked, ["hash", "n_words"], "left")
    own = F.expr(FIRST)
    kept = F.col("keep").isNull() | (F.col("n_words") == 0) | (F.col("keep") == own)
    return joined.select(
        "doc_id", "row_no", "line_no", "line",
        F.when(kept, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_doc"),
        F.when(kept, F.col("line_no")).otherwise(F.col("keep.line_no")).alias("keep_line"),
        (~kept).alias("dropped"),
    )


def line_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_kept and the sorted numbers of the lines that go."""
    lines = repeated_lines(docs, id, text)
    return lines.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"), F.count_if(~F.col("dropped")).alias("n_kept"),
        F.sort_array(F.collect_list(F.when(F.col("dropped"), F.col("line_no")))).alias("dropped_lines"),
    ).drop("row_no")


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row, the text made of the lines that stay."""
    lines = repeated_lines(docs, id, text)
    kept = F.sort_array(F.collect_list(F.when(~F.col("dropped"), F.struct("line_no", "line"))))
    return lines.groupBy("row_no").agg(F.first("doc_id").alias("doc_id"), kept.alias("kept")).select(
        "doc_id", F.array_join("kept.line", "\n").alias("text")
    )
