import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lightbox.functions import images as O
from lightbox.operators import catalog as C
from lightbox.sources import files, tables
from lightbox.streaming import feed as N
from lightbox.streaming import jobs
from lightbox.streaming import windows as W


def feed(spark, *events):
    return spark.createDataFrame([(i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)], "seq long, value string")


def ev(kind, **data):
    return {"type": kind, "data": data or None}


ALL_KINDS = [
    ev("MediaCreated", item={"id": "1"}), ev("MediaUpdated", id="1", item={"size_bytes": 3}), ev("MediaDeleted", id="1"),
    ev("MediaBatchDeleted", ids=["1", "2"]), ev("MediaTagsUpdated", ids=["1"], tags=["a"]), ev("FolderCreated", folder={"id": "f"}),
    ev("FolderDeleted", id="f"), ev("FolderRenamed", id="f", name="n"), ev("FoldersReordered", ids=["f"]),
    ev("MediaAddedToFolder", folder_id="f", media_ids=["1"]), ev("MediaRemovedFromFolder", folder_id="f", media_ids=["1"]),
    ev("UploadComplete"), ev("TagLearningComplete", tag_name="a"), ev("FullRefresh"), ev("ThumbnailFixStarted"),
    ev("ThumbnailFixCompleted", count=2),
]


def test_every_kind_parses(spark):
    got = N.parse_changes(feed(spark, *ALL_KINDS, "junk", ev("Nope"), ev("MediaDeleted"))).orderBy("seq").collect()
    assert [r["reason"] for r in got[:16]] == [None] * 16
    assert [r["reason"] for r in got[16:]] == ["unreadable", "unknown type", "missing id"]
    assert got[3]["ids"] == ["1", "2"] and got[15]["count"] == 2 and got[1]["item"]["size_bytes"] == 3


def listing(spark, *rows):
    return spark.createDataFrame(rows, "id string, size_bytes long, is_favorite boolean, tags array<string>")


def shown(df):
    return sorted((r["id"], r["size_bytes"], r["is_favorite"], r["tags"]) for r in df.collect())


def after(spark, base, view, *events):
    return shown(N.apply_changes(base, N.item_events(N.parse_changes(feed(spark, *events))), view))


def test_view_rules(spark):
    base = listing(spark, ("1", 10, True, ["a"]), ("2", 20, True, ["a", "b"]))
    made = {"id": "3", "size_bytes": 1, "media_type": "image", "is_favorite": True, "tags": [{"name": "a"}]}
    plain = N.View()
    assert after(spark, base, plain, ev("MediaCreated", item=made)) == [("1", 10, True, ["a"]), ("2", 20, True, ["a", "b"]), ("3", 1, True, ["a"])]
    assert after(spark, base, plain, ev("MediaUpdated", id="9", item={"size_bytes": 5}), ev("MediaUpdated", id="1", item={"size_bytes": 5})) == [("1", 5, True, ["a"]), ("2", 20, True, ["a", "b"])]
    assert after(spark, base, N.View(folder=True), ev("MediaCreated", item=made)) == shown(base)
    assert after(spark, base, N.View(media_type="video"), ev("MediaCreated", item=made)) == shown(base)
    assert after(spark, base, N.View(favorites=True), ev("MediaUpdated", id="1", item={"is_favorite": False})) == [("2", 20, True, ["a", "b"])]
    assert after(spark, base, N.View(favorites=True), ev("MediaUpdated", id="7", item={"is_favorite": True, "size_bytes": 2}))[-1] == ("7", 2, True, None)
    assert after(spark, base, N.View(tags=["a"]), ev("MediaTagsUpdated", ids=["1", "2"], tags=["b"])) == []
    # gone, seen again, changed: only what follows the return counts
    story = [ev("MediaDeleted", id="1"), ev("MediaUpdated", id="1", item={"size_bytes": 99}), ev("MediaCreated", item={**made, "id": "1"}),
             ev("MediaTagsUpdated", ids=["1"], tags=["z"])]
    assert after(spark, base, plain, *story)[0] == ("1", 1, True, ["z"])
    assert after(spark, base, plain, *story, ev("MediaBatchDeleted", ids=["1", "2"])) == []


def test_view_stream_matches_the_batch(spark, tmp_path):
    base = listing(spark, ("1", 10, True, ["a"]), ("2", 20, False, ["a"]))
    events = [ev("MediaUpdated", id="1", item={"size_bytes": 11}), ev("MediaDeleted", id="2"), "junk",
              ev("MediaCreated", item={"id": "3", "size_bytes": 3, "tags": [{"name": "a"}]}), ev("MediaUpdated", id="3", item={"size_bytes": 4})]
    source = tmp_path / "feed"
    for i in range(0, len(events), 2):
        feed(spark, *events).where(f"seq >= {i} and seq < {i + 2}").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("seq long, value string").option("maxFilesPerTrigger", 1).json(str(source))
    query = jobs.maintain_view(stream, str(tmp_path / "out"), base)
    query.awaitTermination(120)
    assert query.exception() is None
    log = jobs.view_log(spark, str(tmp_path / "out"), base)
    assert shown(log.before()) == after(spark, base, N.View(), *events)
    # Each batch wrote what it changed, not the listing.
    written = [spark.read.parquet(str(tmp_path / f"out/view/changes/batch={i}")).count() for i in range(3)]
    assert written == [2, 1, 1]
    assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 1


def timed(spark, tmp_path, offsets, key="k"):
    path = str(tmp_path / "timed")
    df = spark.createDataFrame([(key, float(o)) for o in offsets], "k string, s double")
    df = df.select("k", F.timestamp_millis((F.col("s") * 1000).cast("long") + 1_700_000_000_000).alias("ts"))
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema("k string, ts timestamp").parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_session_stream(spark, tmp_path):
    stream = timed(spark, tmp_path, [0, 0.2, 0.6, 5, 5.1, 9000])
    q = W.session_stream(stream, ["k"], "500 milliseconds", "1 second").writeStream.format("memory").queryName("sess").outputMode("append").start()
    drain(q)
    got = sorted(r["n"] for r in spark.table("sess").collect())
    assert got == [2, 3]


def test_limiter_stream(spark, tmp_path):
    stream = timed(spark, tmp_path, [i * 0.1 for i in range(12)] + [300.5, 301.0, 302])
    q = W.attempt_limiter_stream(stream, "k").writeStream.format("memory").queryName("lim").outputMode("append").start()
    # time-out batches keep coming, so the query never counts as idle
    deadline = time.time() + 60
    while spark.table("lim").count() < 15 and time.time() < deadline:
        time.sleep(0.5)
    q.stop()
    got = [r["allowed"] for r in spark.table("lim").orderBy("ts").collect()]
    assert got == [True] * 10 + [False] * 3 + [True, True]


def test_folder_count_stream(spark, tmp_path):
    path = str(tmp_path / "ev")
    feed(
        spark, ev("MediaAddedToFolder", folder_id="f", media_ids=["1", "2"]), ev("MediaAddedToFolder", folder_id="f", media_ids=["2"]),
        ev("MediaRemovedFromFolder", folder_id="f", media_ids=["1", "9"]), ev("MediaDeleted", id="7"),
    ).withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp")).write.json(path)
    stream = spark.readStream.schema("seq long, ts timestamp, value string").json(path)
    base = spark.createDataFrame([("f", 1), ("g", 7), ("g", 8)], "folder_id string, media_id long")
    root = str(tmp_path / "out")
    q = jobs.maintain_folders(stream, root, base)
    q.awaitTermination(120)
    assert q.exception() is None
    # twice the same addition counts once, a removal of a stranger not at all
    assert sorted((r.folder_id, r.media_id) for r in jobs.members_log(spark, root).before().collect()) == [("f", "2"), ("g", "8")]
    assert sorted((r.folder_id, r.delta) for r in spark.read.parquet(f"{root}/counts").collect()) == [("g", -1)]


def test_logs_equal_a_replay(spark, tmp_path):
    """Views, memberships and counts by batches, with snapshots and a batch run twice, equal one replay of all events."""
    rnd = random.Random(4)
    kinds = []
    for _ in range(120):
        i, f = str(rnd.randint(0, 14)), rnd.choice("fgh")
        kinds.append(rnd.choice([
            ev("MediaCreated", item={"id": i, "size_bytes": rnd.randint(0, 9), "tags": [{"name": "a"}]}),
            ev("MediaUpdated", id=i, item={"size_bytes": rnd.randint(10, 99)}), ev("MediaDeleted", id=i),
            ev("MediaBatchDeleted", ids=[i, "3"]), ev("MediaTagsUpdated", ids=[i], tags=["a", "b"]),
            ev("MediaAddedToFolder", folder_id=f, media_ids=[i, "5"]), ev("MediaRemovedFromFolder", folder_id=f, media_ids=[i]), "junk",
        ]))
    events = feed(spark, *kinds).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    base = listing(spark, ("1", 10, True, ["a"]), ("2", 20, False, ["a"]), ("77", 7, False, []))
    pairs = spark.createDataFrame([("f", "1"), ("g", "77"), ("h", "5")], "folder_id string, media_id string")
    root = str(tmp_path)
    views = jobs.view_log(spark, root, base)
    members = jobs.members_log(spark, root)
    for log, first in ((views, base), (members, pairs)):
        log.compact_every = 2
        log.start(first)
    for n, batch in enumerate((0, 1, 1, 2, 3)):
        part = N.parse_changes(events.where(f"seq >= {30 * batch} and seq < {30 * (batch + 1)}"))
        jobs.view_step(views, N.item_events(part), N.View(), batch)
        jobs.folders_step(members, part, root, batch)
    assert views._batches("snapshot") == [-1, 1, 3]
    parsed = N.parse_changes(events)
    assert shown(views.before()) == shown(N.apply_changes(base, N.item_events(parsed)))
    want = sorted(map(tuple, N.memberships_after(pairs, parsed).collect()))
    assert sorted(map(tuple, members.before().collect())) == want
    counts = spark.read.parquet(f"{root}/counts").unionByName(pairs.select("folder_id", F.lit(1).alias("delta"), F.lit(-1).alias("batch")))
    totals = {r.folder_id: r.n for r in counts.groupBy("folder_id").agg(F.sum("delta").alias("n")).where("n <> 0").collect()}
    assert totals == {r.folder_id: r.item_count for r in N.folder_counts_after(pairs, parsed).collect()}
    # Nothing of the rest is read: an untouched item's bucket stays closed.
    plan = views.before(9, spark.createDataFrame([("1",)], "id string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1][:80]


@pytest.fixture()
def processor():
    def process(name, raw):
        if raw.startswith(b"bad"):
            raise ValueError(name)
        if raw.startswith(b"odd"):
            return None
        return {"phash": hashlib.md5(raw).hexdigest(), "width": 1, "height": len(raw), "embedding": [float(len(raw))]}

    return process


def test_streaming_ingest(spark, tmp_path, processor):
    incoming = tmp_path / "in"
    incoming.mkdir()
    names = {"a_20240115.jpg": b"one", "b.jpg": b"two", "c.png": b"one", "d.txt": b"three", "e.mp4": b"bad", "g.gif": b"odd"}
    for i, (name, body) in enumerate(names.items()):
        (incoming / name).write_bytes(body)
        os.utime(incoming / name, (1_700_000_000 + i, 1_700_000_000 + i))
    root = str(tmp_path / "lib")
    q = jobs.streaming_ingest(spark, str(incoming), root, processor, folder_id="album")
    q.awaitTermination(120)
    assert q.exception() is None
    report = {r["original_filename"]: r["status"] for r in spark.read.parquet(f"{root}/report").collect()}
    assert report == {"a_20240115.jpg": "created", "b.jpg": "created", "c.png": "duplicate", "d.txt": "rejected", "e.mp4": "failed", "g.gif": "created"}
    assert {r["original_filename"]: r["reason"] for r in spark.read.parquet(f"{root}/report").collect()}["e.mp4"] == "e.mp4"
    media = {r["original_filename"]: r for r in spark.read.parquet(f"{root}/media").collect()}
    assert set(media) == {"a_20240115.jpg", "b.jpg", "g.gif"}
    assert media["g.gif"]["phash"] == "no_hash" and media["b.jpg"]["filename"]
    vectors = {r["id"]: r["embedding"] for r in spark.read.parquet(f"{root}/vectors").collect()}
    assert vectors == {media["a_20240115.jpg"]["id"]: [3.0], media["b.jpg"]["id"]: [3.0]}
    assert spark.read.parquet(f"{root}/folder_media").count() == 3
    assert str(media["a_20240115.jpg"]["original_date"]) == "2024-01-15 00:00:00"
    # a later run sees only new files, and knows the old hashes
    (incoming / "f.jpg").write_bytes(b"two")
    jobs.streaming_ingest(spark, str(incoming), root, processor).awaitTermination(120)
    report = {r["original_filename"]: r["status"] for r in spark.read.parquet(f"{root}/report").collect()}
    assert report["f.jpg"] == "duplicate" and len(report) == 7
    # A new file and two copies of it, within and across batches, and a batch that runs again.
    log = jobs.known_hashes(spark, root)
    assert sorted(r.phash for r in log.before().collect()) == sorted(hashlib.md5(b).hexdigest() for b in (b"one", b"two"))
    assert log.before(0).count() == 0 and log.before(1, spark.createDataFrame([(hashlib.md5(b"two").hexdigest(),)], "phash string")).count() == 1


def test_repair(spark, tmp_path, processor):
    (tmp_path / "x.jpg").write_bytes(b"pixels")
    (tmp_path / "broken.jpg").write_bytes(b"bad")
    media = spark.createDataFrame(
        [("1", "x.jpg", "no_hash"), ("2", "broken.jpg", "no_hash"), ("3", "missing.jpg", "no_hash"), ("4", "x.jpg", "known")],
        "id string, filename string, phash string",
    ).select("*", F.col("filename").alias("original_filename"), F.lit(0).alias("width"), F.lit(0).alias("height"),
             F.lit("{}").alias("exif_json"), F.lit("2020-01-01").cast("timestamp_ntz").alias("original_date"))
    vectors = spark.createDataFrame([("1", [9.0]), ("2", [8.0]), ("4", [7.0])], "id string, embedding array<float>")
    catalog, changes, replaced = jobs.repair_run(media, f"file://{tmp_path}", processor, vectors=vectors)
    assert {r.id: r.embedding for r in replaced.collect()} == {"1": [6.0], "2": [8.0], "4": [7.0]}
    got = {r["id"]: (r["phash"], r["height"], str(r["original_date"])) for r in catalog.collect()}
    assert got["1"] == (hashlib.md5(b"pixels").hexdigest(), 6, "2020-01-01 00:00:00")
    assert got["2"][0] == got["3"][0] == "no_hash" and got["4"][0] == "known"
    rows = changes.orderBy("type").collect()
    assert [tuple(r)[:3] for r in rows] == [("MediaUpdated", "1", None), ("ThumbnailFixCompleted", None, 1)]
    assert rows[0].item.phash == hashlib.md5(b"pixels").hexdigest() and rows[0].item.filename == "x.jpg" and rows[1].item is None
    ticks = str(tmp_path / "ticks")
    spark.createDataFrame([("go",)], "t string").write.json(ticks)
    stream = spark.readStream.schema("t string").json(ticks)
    q = jobs.repair_stream(spark, stream, lambda: (media, vectors), str(tmp_path / "rep"), f"file://{tmp_path}", processor)
    q.awaitTermination(120)
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "rep/changes")).count() == 2
    assert spark.read.parquet(str(tmp_path / "rep/vectors")).where("id = '1'").first().embedding == [6.0]


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.jpg").write_bytes(b"x" * (i + 1))
    (tmp_path / "n.txt").write_bytes(b"t")
    df = files.ingest_files(spark, str(tmp_path), "*.jpg")
    assert sorted((r["original_filename"], r["size_bytes"]) for r in df.collect()) == [("p0.jpg", 1), ("p1.jpg", 2), ("p2.jpg", 3)]
    with pytest.raises(ValueError):
        files.ingest_files(spark, str(tmp_path), max_files=2)


def test_library_roundtrip(spark, tmp_path):
    media = spark.createDataFrame([("1", "a.jpg", 5)], "id string, original_filename string, size_bytes long")
    vectors = spark.createDataFrame([("1", [1.0, 2.0]), ("2", None)], "id string, embedding array<float>")
    tables.append_media(media, vectors, str(tmp_path))
    tables.append_media(media.withColumn("id", F.lit("9")), vectors.limit(0), str(tmp_path))
    got = tables.load_table(spark, str(tmp_path), "media")
    assert got.count() == 2 and got.first()["media_type"] == "image"
    assert tables.load_table(spark, str(tmp_path), "vectors").count() == 1
    media.write.option("header", True).csv(str(tmp_path / "csv/favorites"))
    shards = str(tmp_path / "shards")
    tables.write_sharded(media.withColumn("id", F.lit("abcd1")), shards)
    assert [(r["p1"], r["p2"]) for r in spark.read.parquet(shards).collect()] == [("ab", "cd")]


def picture(h, w, fill):
    return {"height": h, "width": w, "nChannels": 3, "data": bytes(fill)}


def test_picture_functions(spark):
    ramp = [x * 12 for _ in range(20) for x in range(20) for _ in range(3)]
    back = [255 - v for v in ramp]
    df = spark.createDataFrame(
        [(1, picture(20, 20, ramp)), (2, picture(20, 20, ramp)), (3, picture(20, 20, back)), (4, picture(70000, 1, [0]))],
        "id long, image struct<height:int,width:int,nChannels:int,data:binary>",
    )
    got = {r["id"]: r["h"] for r in df.select("id", O.image_fingerprint(F.col("image")).alias("h")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == "no_hash"

    def factory():
        return lambda batch: batch.reshape(len(batch), 3, -1).mean(axis=2)

    out = {r["id"]: r["embedding"] for r in O.extract_embeddings(df, factory).collect()}
    assert len(out[1]) == 3 and out[1] == out[2] != out[3] and out[4] is None
    mean = sum(ramp) / len(ramp) / 255
    assert out[1][0] == pytest.approx((mean - 0.485) / 0.229, abs=1e-3)
