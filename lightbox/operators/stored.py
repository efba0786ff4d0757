"""The catalog as stored files clustered by capture time, with bounds that let pages skip files.

Metadata is parsed once, when items are written: files hold the derived extension, media type and
capture time, each file a range of (capture time, id). Beside them lies one narrow row of bounds per
file and media type. A page reads the bounds, and then only the files that can hold its rows;
totals by type read no item at all.

Items lie below ``items/run=<n>``, bounds of all live files below ``bounds/gen=<n>``. Writing a
generation of bounds publishes it, so a run that failed half-way is never seen and readers of an
older generation keep their files. One writer at a time is assumed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lightbox.operators import catalog as C
from lightbox.plans.ordered import FOLD_ROWS, running

# Items of a file; about 128 MB of records.
FILE_ROWS = 500_000


def _generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the published bounds."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(f"{root}/bounds")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    found = [s.getPath() for s in system.listStatus(where)]
    return sorted(int(p.getName().removeprefix("gen=")) for p in found if system.exists(path(p, "_SUCCESS")))


def _sort_key() -> Column:
    return F.struct("original_date", "id")


def bounds(spark: SparkSession, root: str) -> DataFrame:
    """(run, file, media_type, n, size_bytes, lo, hi) of the live files; lo and hi are (original_date, id)."""
    known = _generations(spark, root)
    if not known:
        raise FileNotFoundError(f"no stored catalog below {root}")
    return spark.read.parquet(f"{root}/bounds/gen={known[-1]}")


def _write_run(items: DataFrame, root: str, number: int, file_rows: int) -> DataFrame:
    """Write ``items`` as run ``number`` and return the bounds of its files."""
    spark = items.sparkSession
    files = max(1, math.ceil(items.count() / file_rows))
    path = f"{root}/items/run={number}"
    order = [F.desc("original_date"), F.desc("id")]
    items.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return spark.read.schema(items.schema).parquet(path).groupBy(
        F.lit(number).alias("run"), F.col("_metadata.file_name").alias("file"), "media_type"
    ).agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"),
        F.min(_sort_key()).alias("lo"), F.max(_sort_key()).alias("hi"),
    )


def _publish(rows: DataFrame, root: str, number: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/bounds/gen={number}")


def write_catalog(media: DataFrame, root: str, file_rows: int = FILE_ROWS) -> None:
    """Store ``media`` (raw metadata) below ``root``: derived once, clustered by capture time.

    Written again, the new items replace those of the generation before.
    """
    number = (_generations(media.sparkSession, root) or [0])[-1] + 1
    _publish(_write_run(C.derive_catalog(media), root, number, file_rows), root, number)


def append_catalog(media: DataFrame, root: str, file_rows: int = FILE_ROWS) -> None:
    """Add new items as a run of their own, whatever capture times it spans; no stored file is touched."""
    spark = media.sparkSession
    known = bounds(spark, root)
    number = _generations(spark, root)[-1] + 1
    _publish(known.unionByName(_write_run(C.derive_catalog(media), root, number, file_rows)), root, number)


def compact_catalog(spark: SparkSession, root: str, file_rows: int = FILE_ROWS) -> None:
    """All live items as one clustered run, so ranges of files no longer overlap."""
    number = _generations(spark, root)[-1] + 1
    _publish(_write_run(read_catalog(spark, root), root, number, file_rows), root, number)


def _read_files(spark: SparkSession, root: str, files: list[tuple[int, str]]) -> DataFrame:
    paths = [f"{root}/items/run={run}/{file}" for run, file in files]
    if not paths:
        # No file can hold a row: the columns come from the newest run, none of its rows.
        return spark.read.parquet(f"{root}/items/run={_generations(spark, root)[-1]}").limit(0)
    return spark.read.parquet(*paths)


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    """All live items with their derived columns; no metadata is parsed."""
    runs = sorted(r["run"] for r in bounds(spark, root).select("run").distinct().collect())
    if not runs:
        return _read_files(spark, root, [])
    return spark.read.parquet(*[f"{root}/items/run={r}" for r in runs])


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """:func:`catalog.media_counts` from the bounds alone."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("media_type") == kind, F.col("n"))), F.lit(0)).cast("long")
    return bounds(spark, root).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), n("image").alias("images"), n("video").alias("videos"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_bytes"),
    )


def _running_sum(rows: DataFrame, order: list[Column], fold_rows: int) -> DataFrame:
    """Add ``total``: the inclusive running sum of ``n``. One window serves as long as one task can fold the rows."""
    if rows.count() <= fold_rows:
        window = Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("total", F.sum("n").over(window))
    return running(rows, [], order, F.col("n"))


def _spans(
    spark: SparkSession, root: str, media_type: str | None, ascending: bool, after: tuple | None, fold_rows: int
) -> DataFrame:
    """(run, file, n, surely, possibly): the rows that surely and that possibly come before a file's.

    ``surely`` bounds the number of rows before its first from below: files that end before it begins.
    ``possibly`` bounds the number up to its last from above: files that begin before it ends.
    With ``after``, a (capture time, id), only rows behind it count, and a file that it cuts counts
    as nothing from below and as whole from above.
    """
    known = bounds(spark, root)
    if media_type is not None:
        known = known.where(F.col("media_type") == media_type)
    files = known.groupBy("run", "file").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    files = files.withColumn("sure", F.col("n"))
    if after is not None:
        key = files.schema["lo"].dataType
        at = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(after, key)])
        ends, begins = ("hi", "lo") if ascending else ("lo", "hi")
        behind = (lambda c: F.col(c) > at) if ascending else (lambda c: F.col(c) < at)
        files = files.where(behind(ends)).withColumn("sure", F.when(behind(begins), F.col("n")).otherwise(0))
    begin, end = ("lo", "hi") if ascending else ("hi", "lo")

    def sums(counted: str, asked: str, ties_count: bool, n: str, name: str) -> DataFrame:
        # One sweep over the ends that count rows and the ends that ask for their sum.
        each = files.select(
            "run", "file",
            F.explode(F.array(
                F.struct(F.col(counted).alias("key"), F.lit(not ties_count).alias("late"), F.col(n).alias("n"), F.lit(False).alias("asks")),
                F.struct(F.col(asked).alias("key"), F.lit(ties_count).alias("late"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks")),
            )).alias("e"),
        ).select("run", "file", "e.*")
        order = [F.asc("key") if ascending else F.desc("key"), F.asc("late"), F.asc("run"), F.asc("file")]
        swept = _running_sum(each, order, fold_rows)
        return swept.where("asks").select("run", "file", F.col("total").alias(name))

    surely = sums(end, begin, False, "sure", "surely")
    possibly = sums(begin, end, True, "n", "possibly")
    return files.select("run", "file", "n").join(surely, ["run", "file"]).join(possibly, ["run", "file"])


def page_files(
    spark: SparkSession, root: str, offset: int, size: int, media_type: str | None = None, ascending: bool = False,
    after: tuple | None = None, fold_rows: int = FOLD_ROWS,
) -> tuple[list[tuple[int, str]], int]:
    """The files that can hold rows ``offset`` to ``offset + size``, and the offset left in them.

    Files whose rows all lie before the page are skipped and their counts come off the offset. In a
    compacted catalog one or two files are left however deep the page lies; in runs that overlap, those
    of each run around it.
    """
    spans = _spans(spark, root, media_type, ascending, after, fold_rows)
    # A file that ``after`` cuts holds fewer rows behind it than it counts, so it is never skipped by its counts.
    passed = F.lit(False) if after is not None else F.col("possibly") <= offset
    met = spans.withColumn("passed", passed).where(F.col("passed") | (F.col("surely") < offset + size))
    skipped = met.where("passed").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    files = [(r["run"], r["file"]) for r in met.where("not passed").select("run", "file").collect()]
    return sorted(files), offset - skipped


def stored_page(
    spark: SparkSession, root: str, page_no: int | None = 1, limit: int | None = None,
    media_type: str | None = None, ascending: bool = False, fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """:func:`catalog.page` by capture time over the stored files, one media type or all."""
    offset, size = C.page_bounds(page_no, limit)
    files, rest = page_files(spark, root, offset, size, media_type, ascending, fold_rows=fold_rows)
    rows = C.filter_media_type(_read_files(spark, root, files), media_type)
    return C.page_rows(rows, rest, size, "date", ascending)


def stored_page_after(
    spark: SparkSession, root: str, last_key, last_id, limit: int | None = None,
    media_type: str | None = None, ascending: bool = False, fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """:func:`catalog.page_after` by capture time over the stored files."""
    _, size = C.page_bounds(1, limit)
    files, _ = page_files(spark, root, 0, size, media_type, ascending, (last_key, last_id), fold_rows)
    rows = C.filter_media_type(_read_files(spark, root, files), media_type)
    return C.page_after(rows, last_key, last_id, limit, "date", ascending)
