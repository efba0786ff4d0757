"""Continuous ingest, view upkeep and scheduled repair.

Each micro-batch writes its own ``batch=<n>`` folder, so a batch that runs again after
a failure replaces its own output. State lives in logs of changes (:class:`KeyedLog`): a batch
reads only the buckets its keys fall into and writes only what it changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lightbox.functions import scalars as S
from lightbox.operators import changes as L
from lightbox.operators import catalog as C
from lightbox.operators import dedup as K
from lightbox.session import durable
from lightbox.sources.files import file_stream, open_uri, read_paths
from lightbox.streaming import feed as N
from lightbox.streaming.keyed_log import KeyedLog

# What a processor tells about one file.
PROCESSED = (
    "phash string, width int, height int, exif_json string, original_date timestamp_ntz, "
    "embedding array<float>, failure string"
)
_ARROW = pa.schema(
    [("phash", pa.string()), ("width", pa.int32()), ("height", pa.int32()),
     ("exif_json", pa.string()), ("original_date", pa.timestamp("us")),
     ("embedding", pa.list_(pa.float32())), ("failure", pa.string())]
)

Processor = Callable[[str, bytes], dict | None]


def process_files(rows: DataFrame, processor: Processor) -> DataFrame:
    """Replace ``content`` by the processor's findings; every row comes out.

    A processor answers None for a picture or film that it cannot decode: the
    row gets the sentinel hash and can be repaired later. A processor that raises, or
    a file that cannot be read, leaves its text in ``failure``.
    """
    rest = [f for f in rows.schema if f.name != "content"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, item in zip(batch.column("original_filename").to_pylist(), batch.column("content")):
                try:
                    result = processor(name, item.as_py()) if item.is_valid else {"failure": "unreadable"}
                except Exception as error:  # noqa: BLE001  reported with its file
                    result = {"failure": str(error) or type(error).__name__}
                result = {"phash": S.NO_HASH} if result is None else result
                found.append({f.name: result.get(f.name) for f in _ARROW})
            head = batch.select([f.name for f in rest])
            tail = pa.RecordBatch.from_pylist(found, _ARROW)
            yield pa.record_batch({**dict(zip(head.schema.names, head.columns)),
                                   **dict(zip(tail.schema.names, tail.columns))})

    return rows.mapInArrow(run, f"{fields}, {PROCESSED}")


MEDIA = (
    "id string, path string, filename string, original_filename string, media_type string, phash string, "
    "uploaded_at timestamp, original_date timestamp_ntz, width int, height int, size_bytes bigint, "
    "exif_json string"
)


def ingest_batch(files: DataFrame, existing: DataFrame | Callable[[DataFrame], DataFrame], processor: Processor) -> DataFrame:
    """Decided rows of one batch of files: created, duplicate, rejected or failed.

    ``existing`` holds the hashes known before, or finds those among given ones. The id follows from path and time. Files outside the allowlist are rejected
    without being processed; failed ones keep their text as ``reason``.
    """
    ext = S.file_extension(F.col("original_filename"))
    named = files.withColumn("id", F.md5(F.concat_ws("|", "path", F.col("uploaded_at").cast("string"))))
    unread = named.where(~S.allowed_extension(ext)).drop("content").selectExpr(
        "*", *[f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in PROCESSED.split(", "))]
    )
    # Each file is processed once, whatever the decisions below read.
    done = durable(process_files(named.where(S.allowed_extension(ext)), processor).unionByName(unread))
    rows = done.withColumns(
        {
            "filename": S.storage_path(F.col("id"), ext),
            "media_type": S.media_type(ext),
            "original_date": F.coalesce(
                "original_date", S.date_from_filename(F.col("original_filename")),
                F.col("uploaded_at").cast("timestamp_ntz"),
            ),
        }
    )
    # A file without a hash joins no decision about copies.
    rows = rows.withColumn("phash", F.coalesce("phash", F.lit(S.NO_HASH)))
    known = existing if isinstance(existing, DataFrame) else existing(rows.select("phash").distinct())
    decided = K.dedup_ingest(rows, known)
    failed = F.col("failure").isNotNull()
    return decided.withColumns({
        "status": F.when(failed, "failed").otherwise(F.col("status")),
        "reason": F.when(failed, F.col("failure")).otherwise(F.col("reason")),
    })


HASHES = T.StructType([T.StructField("phash", T.StringType())])


def known_hashes(spark: SparkSession, root: str) -> KeyedLog:
    """The hashes of everything an ingest job below ``root`` has taken in."""
    return KeyedLog(spark, f"{root}/hashes", HASHES, ["phash"])


def streaming_ingest(
    spark: SparkSession, incoming: str, root: str, processor: Processor, per_trigger: int | None = None,
    available_now: bool = True, folder_id: str | None = None,
) -> StreamingQuery:
    """Take arriving files into ``root/media`` and ``root/vectors``, and report each in ``root/report``.

    With ``folder_id`` the created items also join that folder, in ``root/folder_media``. A batch looks up
    its own hashes in ``root/hashes``; media of earlier batches are not read again.
    """
    log = known_hashes(spark, root)

    def take(batch: DataFrame, batch_id: int) -> None:
        decided = durable(ingest_batch(batch, lambda hashes: log.before(batch_id, hashes), processor))
        columns = [c.split()[0] for c in MEDIA.split(", ")]
        created = decided.where("status = 'created'").select(*columns)
        created.write.mode("overwrite").parquet(f"{root}/media/batch={batch_id}")
        vectors = decided.where("status = 'created' and embedding is not null").select("id", "embedding")
        vectors.write.mode("overwrite").parquet(f"{root}/vectors/batch={batch_id}")
        if folder_id is not None:
            created.select(F.lit(folder_id).alias("folder_id"), F.col("id").alias("media_id")).write.mode(
                "overwrite"
            ).parquet(f"{root}/folder_media/batch={batch_id}")
        decided.select("path", "original_filename", "status", "reason").write.mode(
            "overwrite"
        ).parquet(f"{root}/report/batch={batch_id}")
        taken = created.where(F.col("phash") != S.NO_HASH).select("phash").distinct()
        log.put(batch_id, taken, taken.limit(0))

    writer = file_stream(spark, incoming, per_trigger).writeStream.foreachBatch(take).option(
        "checkpointLocation", f"{root}/_progress/ingest"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def view_log(spark: SparkSession, root: str, base: DataFrame) -> KeyedLog:
    """The listing that :func:`maintain_view` keeps; ``view_log(...).before()`` is its present state."""
    fields = [f for f in base.schema if f.name == "id" or f.name in N.VIEW_FIELDS]
    return KeyedLog(spark, f"{root}/view", T.StructType(fields), ["id"])


def view_step(log: KeyedLog, events: DataFrame, view: N.View, batch_id: int) -> None:
    """Apply one batch of item events: only the items they name are read, only what becomes of those is written."""
    events = durable(events)
    touched = durable(events.select("id").distinct())
    after = durable(N.apply_changes(log.before(batch_id, touched), events, view))
    log.put(batch_id, after, touched.join(after.select("id"), "id", "left_anti"))


def maintain_view(
    events: DataFrame, root: str, base: DataFrame, view: N.View = N.View(), available_now: bool = True
) -> StreamingQuery:
    """Keep ``root/view`` equal to the listing after the events seen so far (:func:`view_log`).

    ``events`` is a stream of (seq, value) texts; rejects go to ``root/rejects``.
    """
    log = view_log(base.sparkSession, root, base)
    log.start(base)

    def step(batch: DataFrame, batch_id: int) -> None:
        parsed = durable(N.parse_changes(batch))
        view_step(log, N.item_events(parsed), view, batch_id)
        parsed.where(F.col("reason").isNotNull()).select("seq", "reason").write.mode(
            "overwrite"
        ).parquet(f"{root}/rejects/batch={batch_id}")

    writer = events.writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{root}/_progress/view"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


PAIRS = T.StructType([T.StructField("folder_id", T.StringType()), T.StructField("media_id", T.StringType())])


def members_log(spark: SparkSession, root: str) -> KeyedLog:
    """The memberships that :func:`maintain_folders` keeps, in buckets by item."""
    return KeyedLog(spark, f"{root}/members", PAIRS, ["folder_id", "media_id"], "media_id")


def folders_step(log: KeyedLog, parsed: DataFrame, root: str, batch_id: int) -> None:
    """Apply one batch of membership events to the pairs of the items it names, and write by how much
    each folder's count changes to ``root/counts``."""
    parsed = durable(parsed)
    touched = N.membership_changes(parsed).select("media_id").unionByName(
        N.item_events(parsed).where("action = 'delete'").select(F.col("id").alias("media_id"))
    ).distinct()
    held = durable(log.before(batch_id, durable(touched)))
    after = durable(N.memberships_after(held, parsed))
    on = ["folder_id", "media_id"]
    added, lost = after.join(held, on, "left_anti"), held.join(after, on, "left_anti")
    log.put(batch_id, added, lost)
    deltas = added.select("folder_id", F.lit(1).alias("delta")).unionByName(lost.select("folder_id", F.lit(-1).alias("delta")))
    deltas.groupBy("folder_id").agg(F.sum("delta").alias("delta")).where("delta <> 0").write.mode("overwrite").parquet(
        f"{root}/counts/batch={batch_id}"
    )


def maintain_folders(
    events: DataFrame, root: str, base: DataFrame, available_now: bool = True
) -> StreamingQuery:
    """Keep ``root/members`` equal to the memberships after the events seen so far (:func:`members_log`).

    Each batch writes the changes of the folders' counts to ``root/counts``. ``events`` is a stream
    of (seq, value) texts, ``base`` holds (folder_id, media_id).
    """
    log = members_log(base.sparkSession, root)
    log.start(base)

    def step(batch: DataFrame, batch_id: int) -> None:
        folders_step(log, N.parse_changes(batch), root, batch_id)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/_progress/folders")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def repair_run(
    media: DataFrame, root_uri: str, processor: Processor, opener: Callable[[str], bytes] = open_uri,
    vectors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(catalog, change rows, vectors) after processing the unhashed items again.

    Only files of unhashed items are opened. The change rows are one
    MediaUpdated with its ``item`` per repaired item and one ThumbnailFixCompleted with the count.
    Vectors of repaired items are replaced where a new one was found; null without ``vectors``.
    Started by any scheduler, daily in the original service.
    """
    wanted = C.unhashed_media(media).select(
        "id", "original_filename", F.concat(F.lit(root_uri.rstrip("/") + "/"), "filename").alias("path")
    )
    read = durable(process_files(read_paths(wanted, "path", opener), processor))
    fresh = read.where(F.col("failure").isNull() & (F.col("phash") != S.NO_HASH))
    catalog, fixed = L.repair_media(media, fresh.drop("original_filename", "path"))
    item = F.struct(*[F.col(c) for c in media.columns])
    updated = fixed.select(
        F.lit("MediaUpdated").alias("type"), F.col("id").cast("string").alias("id"),
        F.lit(None).cast("long").alias("count"), item.alias("item"),
    )
    finished = fixed.agg(F.count("*").alias("count")).select(
        F.lit("ThumbnailFixCompleted").alias("type"), F.lit(None).cast("string").alias("id"), "count",
        F.lit(None).cast(updated.schema["item"].dataType).alias("item"),
    )
    replaced = None if vectors is None else L.repair_vectors(vectors, fixed.select("id"), fresh)
    return catalog, updated.unionByName(finished), replaced


def repair_stream(
    spark: SparkSession, ticks: DataFrame, load: Callable[[], DataFrame | tuple[DataFrame, DataFrame]], root: str, root_uri: str,
    processor: Processor, available_now: bool = True,
) -> StreamingQuery:
    """Run a repair for every tick; catalog, changes and vectors go to ``root`` by batch.

    ``load`` gives the media, or media and vectors, as they are at that time.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        loaded = load()
        media, vectors = loaded if isinstance(loaded, tuple) else (loaded, None)
        catalog, changes, replaced = repair_run(media, root_uri, processor, vectors=vectors)
        catalog.write.mode("overwrite").parquet(f"{root}/media/batch={batch_id}")
        changes.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
        if replaced is not None:
            replaced.write.mode("overwrite").parquet(f"{root}/vectors/batch={batch_id}")

    writer = ticks.writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{root}/_progress/repair"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
