"""Media files as rows: batch scan, stream, and reading of chosen paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _named(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        F.col("modificationTime").alias("uploaded_at"), F.col("length").alias("size_bytes"), "content",
    )


def ingest_files(
    spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Files below ``path`` as (path, original_filename, uploaded_at, size_bytes, content).

    Columns that are not used are not read, the content included. More than
    ``max_files`` files are an error, as for one request.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    if max_files is not None and files.select("path").limit(max_files + 1).count() > max_files:
        raise ValueError(f"too many files (max {max_files})")
    return _named(files)


def file_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """The same rows as a stream of newly arriving files; all of them in a batch unless ``per_trigger`` is given."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return _named(reader.load(path))


def open_uri(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path) as stream:
        return stream.read()


def read_paths(
    rows: DataFrame, path: str = "path", opener: Callable[[str], bytes] = open_uri
) -> DataFrame:
    """Add ``content`` of each row's own path, null when it cannot be read.

    For a few rows out of a large store: only their files are opened, by the
    tasks that hold the rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                part = batch.slice(start, 16)
                content = []
                for uri in part.column(path).to_pylist():
                    try:
                        content.append(opener(uri))
                    except (OSError, ValueError, TypeError):
                        content.append(None)
                yield part.append_column("content", pa.array(content, pa.binary()))

    spread = rows.repartition(path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return spread.mapInArrow(read, f"{fields}, content binary")
