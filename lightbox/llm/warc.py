"""WARC archives of pages, and capture histories from their merged index.

Pages go to WARC files, one per task, each sorted by URL key and capture time: a
run. Reading the files back gives one index entry per record. Sampled splitters
cut the key space into ranges; each range merges its slices of all runs with a
loser tree, so the ranges in order are the globally ordered capture history.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.session import durable, shared_folder

MIN_REVISIT_BYTES = 100
# A file is read back whole by one task. Payloads of at most so many bytes go so many to a
# file, about 80 MB; longer ones than the last are files of their own.
FILE_SIZES = ((16_384, 5_000), (262_144, 300), (4_194_304, 20))
RANGE_ROWS = 200_000  # index entries that a merging task holds, about
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, then the path and query, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(rest == "", F.lit("")).otherwise(F.lower(F.concat(labels, F.lit(")"), tail)))


def capture_time(id: Column) -> Column:
    """A capture time for tables without one: seconds since 2020 by id."""
    return F.date_format(
        F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce(id, F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )


def _header_value(value: Column) -> Column:
    """A URL as a header value: what would break a header line is percent-encoded."""
    out = F.coalesce(value, F.lit(""))
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), ("\u0000", "%00")):
        out = F.replace(out, F.lit(raw), F.lit(code))
    return out


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(row_no, page_id, url, body, n_bytes, digest, url_key, date) of every page, written once: a row keeps its
    number whatever order the input is read in again."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return durable(pages.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"),
        F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("digest"),
        url_key(F.col(url)).alias("url_key"), capture_time(F.col(id).cast("long")).alias("date"),
    ))


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write one WARC record per page below ``path``: gzipped files of about 80 MB of payload at most
    (or one longer page), each in the order of URL key and capture time.

    A revisit carries the HTTP header of its payload and refers to the response.
    Of rows with the same id and payload one is the response; rows without an id
    come after all others. An empty table writes nothing.
    """
    rows = plan_records(pages, id, url, payload)
    # Which row answers for a digest: decided on (digest, id) alone, for digests seen more than once.
    firsts = durable(
        rows.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
            F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row_no")).alias("first"), F.count("*").alias("n")
        ).where("n > 1").select("digest", F.col("first.page_id").alias("first_id"), F.col("first.row_no").alias("first_row"))
    )
    joined = rows.join(firsts, "digest", "left")
    revisit = F.coalesce(F.col("first_row") != F.col("row_no"), F.lit(False))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END)
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), _header_value(F.col("url")),
        F.lit("\r\nWARC-Date: "), F.col("date"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first_id").cast("string"), F.lit("")), F.lit(">")
        )).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(END),
    )
    records = joined.select("n_bytes", "url_key", "date", "page_id", F.concat(header, block).alias("value"))
    # Files are cut by the size class of their payloads; classes without rows cost nothing.
    classes = [*FILE_SIZES, (None, 1)]
    size_class = F.lit(len(classes) - 1)
    for i, (most, _) in reversed(list(enumerate(FILE_SIZES))):
        size_class = F.when(F.col("n_bytes") <= most, i).otherwise(size_class)
    for (number,) in rows.select(size_class).distinct().collect():
        (
            records.where(size_class == number).sortWithinPartitions("url_key", "date", F.asc_nulls_last("page_id"))
            .select("value").write.mode("append").option("lineSep", END).option("compression", "gzip")
            .option("maxRecordsPerFile", classes[number][1]).text(path)
        )


HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)")
INDEX = (
    "run string, position long, url string, url_key string, date string, page_id long, record_type string, "
    "payload_bytes long, payload_digest string, refers_to long"
)


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes, bytes]]:
    """(offset, WARC header, HTTP header, payload) of every record, by content lengths."""
    at = 0
    while at < len(raw):
        head_end = raw.index(b"\r\n\r\n", at)
        header = dict(HEADER.findall(raw[at:head_end]))
        begin = head_end + 4
        end = begin + int(header[b"Content-Length"])
        body = raw.index(b"\r\n\r\n", begin) + 4
        if raw[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        yield at, header, raw[begin:body], raw[body:end]
        at = end + 4


def _id(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def _url(value: bytes) -> str:
    for code, raw in ((b"%00", b"\0"), (b"%0A", b"\n"), (b"%0D", b"\r"), (b"%25", b"%")):
        value = value.replace(code, raw)
    return value.decode()


def read_archives(pages_path: str, spark) -> DataFrame:
    """One index entry per record of the archives below ``pages_path``.

    Digests and lengths of responses are computed from the payload and must agree
    with the header; those of revisits come from their headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[list] = [[] for _ in range(9)]
                for at, warc, http, payload in parse_records(zlib.decompress(content.as_buffer(), 31)):
                    kind = warc[b"WARC-Type"].decode()
                    digest = warc[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                    length = int(dict(HEADER.findall(http))[b"Content-Length"])
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (length, digest):
                        raise ValueError(f"{path}: the payload at {at} does not match its header")
                    values = (
                        path, at, _url(warc[b"WARC-Target-URI"]), warc[b"WARC-Date"].decode(), _id(warc[b"WARC-Record-ID"]),
                        kind, length, digest, _id(warc.get(b"WARC-Refers-To")),
                    )
                    for column, value in zip(rows, values):
                        column.append(value)
                names = ("run", "position", "url", "date", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.record_batch({n: pa.array(r, k) for n, r, k in zip(names, rows, kinds)})

    schema = ", ".join(x for x in INDEX.split(", ") if not x.startswith("url_key"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(pages_path).select("path", "content")
    return files.mapInArrow(run, schema).withColumn("url_key", url_key(F.col("url")))


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list]):
        self.runs = [r for r in runs if r]
        self.next = [1] * len(self.runs)
        self.head = [r[0] for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else (0 if k else -1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None
        return x <= y

    def __iter__(self):
        k = len(self.runs)
        while k and self.head[self.winner] is not None:
            w = self.winner
            yield self.head[w]
            at = self.next[w]
            self.head[w] = self.runs[w][at] if at < len(self.runs[w]) else None
            self.next[w] = at + 1
            node = (w + k) // 2
            while node:
                if not self._before(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_index(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """The index with ``range_no`` and ``place``: in this order, captures are globally
    sorted by (url_key, date, page_id, run, position).

    A URL captured very often spreads over several ranges, because splitters cut by
    time as well. A range holds its index entries in memory, not the payloads.
    """
    ranges = ranges or max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // RANGE_ROWS + 1)
    order = ["url_key", "date", F.asc_nulls_last("page_id"), "run", "position"]
    sliced = index.select(*[x.split()[0] for x in INDEX.split(", ")]).repartitionByRange(ranges, *order)
    # Slices of runs arrive in any order; each is put back in run order, as written.
    sliced = sliced.sortWithinPartitions("run", "position").withColumn("range_no", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        rows = pa.Table.from_batches(table)
        ids = rows.column("page_id").to_pylist()
        runs: dict[str, list] = {}
        for i, (k, d, p, r, at) in enumerate(zip(
            rows.column("url_key").to_pylist(), rows.column("date").to_pylist(), ids,
            rows.column("run").to_pylist(), rows.column("position").to_pylist(),
        )):
            runs.setdefault(r, []).append((k.encode(), d, p is None, p or 0, r, at, i))
        merged = rows.take(pa.array([entry[-1] for entry in LoserTree(list(runs.values()))], pa.int64()))
        merged = merged.append_column("place", pa.array(range(len(ids)), pa.int64()))
        yield from merged.to_batches()

    return sliced.mapInArrow(run, f"{INDEX}, range_no int, place long")


def capture_history(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archive ``pages``, read the archives back and merge their index.

    One row per page, in global order by (range_no, place). Null payloads are
    empty, null URLs have an empty key; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path, id, url, payload)
    if not _exists(spark, path):
        return merge_index(spark.createDataFrame([], INDEX))
    return merge_index(durable(read_archives(path, spark)))
