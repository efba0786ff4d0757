import datetime as dt

import pytest
from pyspark.sql import functions as F

from lightbox.operators import catalog as C
from lightbox.operators import changes as L
from lightbox.operators import dedup as K
from lightbox.operators import sets
from lightbox.sources import tables

D = dt.datetime


@pytest.fixture()
def media(spark):
    data = [
        (1, "a.jpg", "image", D(2024, 1, 1), 100), (2, "b.mp4", "video", D(2024, 6, 15), 300),
        (3, "c.jpg", "image", D(2024, 3, 10), 200), (4, "d.mp4", "video", D(2024, 3, 10), 9999),
    ]
    return spark.createDataFrame(
        [(i, n, t, d, d, s) for i, n, t, d, s in data],
        "id long, original_filename string, media_type string, uploaded_at timestamp_ntz, "
        "original_date timestamp_ntz, size_bytes long",
    )


@pytest.fixture()
def tags(spark):
    return spark.createDataFrame(
        [(1, "Nature", False, None), (2, "Nature", True, 0.9), (2, "City", False, None), (3, "City", False, None)],
        "media_id long, tag string, is_auto boolean, confidence double",
    )


@pytest.fixture()
def favorites(spark):
    return spark.createDataFrame([(1,), (2,)], "media_id long")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_sort_and_tie_break(media):
    assert ids(C.sort_media(media)) == [2, 4, 3, 1]
    assert ids(C.sort_media(media, "date", True)) == [1, 3, 4, 2]
    assert ids(C.sort_media(media, "size")) == [4, 2, 3, 1]
    assert ids(C.sort_media(media, "no such key")) == [2, 4, 3, 1]


def test_filters(media, tags, favorites):
    assert sorted(ids(C.filter_media_type(media, "video"))) == [2, 4]
    assert ids(C.filter_media_type(media, "'; drop table media")) == []
    assert sorted(ids(C.filter_media_type(media, None))) == [1, 2, 3, 4]
    assert sorted(ids(C.filter_tags_any(media, tags, ["Nature", "City"]))) == [1, 2, 3]
    assert sorted(ids(C.filter_tags_all(media, tags, ["Nature", "City", "City"]))) == [2]
    assert sorted(ids(C.filter_tags_any(media, tags, []))) == [1, 2, 3, 4]
    assert sorted(ids(C.filter_tags_any(media, tags, ["nature"]))) == []
    assert sorted(ids(C.filter_favorite(media, favorites))) == [1, 2]


def test_pages(spark, media):
    many = spark.range(1, 11).select(
        "id", F.lit(0).cast("long").alias("size_bytes"),
        F.make_timestamp_ntz(F.lit(2024), F.col("id").cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("original_date"),
    )
    assert ids(C.page(many, 1, 3)) == [10, 9, 8]
    assert ids(C.page(many, 4, 3)) == [1]
    assert ids(C.page(many, 5, 3)) == []
    assert ids(C.page(many, 0, 3)) == [10, 9, 8]
    last = C.page(many, 1, 3).collect()[-1]
    assert ids(C.page_after(many, last["original_date"], last["id"], 3)) == ids(C.page(many, 2, 3))
    assert C.page_bounds(None, None) == (0, 20) and C.page_bounds(2, 5000) == (200, 200)
    members = many.select(F.lit("f").alias("folder_id"), F.col("id").alias("media_id"))
    per = C.page_per_folder(many, members, 2, 3).orderBy("rank")
    assert ids(per) == [7, 6, 5]


def test_query_media(media, tags, favorites):
    out = C.query_media(media, favorites, tags, favorite=True, tags=["Nature"]).collect()
    assert [r["id"] for r in out] == [2, 1]
    assert [(t["name"], t["is_auto"]) for t in out[0]["tags"]] == [("City", False), ("Nature", True)]
    assert all(r["is_favorite"] for r in out)
    none = C.query_media(media, favorites, tags, media_type="image", page_no=9)
    assert none.collect() == []


def test_counts(spark, media, tags):
    got = C.media_counts(media).first()
    assert tuple(got) == (4, 2, 2, 10599)
    assert tuple(C.media_counts(media.limit(0)).first()) == (0, 0, 0, 0)
    assert {r["tag"]: r["n"] for r in C.tag_counts(tags, False).collect()} == {"Nature": 1, "City": 2}
    folders = spark.createDataFrame([("x", "b", 0), ("y", "A", 0)], "folder_id string, name string, sort_order long")
    members = spark.createDataFrame([("x", 1), ("x", 2)], "folder_id string, media_id long")
    assert [(r["folder_id"], r["item_count"]) for r in C.folder_counts(folders, members).collect()] == [("y", 0), ("x", 2)]
    assert C.trainable_tags(tags, 2).count() == 1


def test_suggest_and_requested(spark, media):
    tags = spark.createDataFrame([("Nature",), ("City",), ("Signature",)], "tag string")
    assert sorted(r[0] for r in C.suggest_tags(tags, "NAT", ["Nature"]).collect()) == ["Signature"]
    assert C.suggest_tags(tags, "  ").count() == 0
    wanted = spark.createDataFrame([(0, 3), (1, 9), (2, 1), (3, 3)], "pos long, media_id long")
    got = C.resolve_requested(wanted, media).orderBy("pos").collect()
    assert [(r["pos"], r["id"]) for r in got] == [(0, 3), (2, 1)]


def test_references(spark, media, tags):
    bad = tags.unionByName(spark.createDataFrame([(99, "x", False, None)], tags.schema))
    assert C.check_references(bad, media, "media_id", "id").count() == 1
    C.reject_orphans(tags, media, "media_id", "id")
    with pytest.raises(ValueError):
        C.reject_orphans(bad, media, "media_id", "id")


def test_set_operations(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C")], "k long, v string")
    assert rows(sets.insert_ignore(base, new, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert sets.additions(base, new, ["k"]).count() == 1
    assert rows(sets.upsert(base, new.distinct(), ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    log = spark.createDataFrame([(1, 5, None), (1, 9, "z"), (1, 7, "y")], "k long, seq long, v string")
    assert rows(sets.last_per_key(log, ["k"], ["seq"])) == [(1, 9, "z")]
    assert sets.first_per_key(log, ["k"], ["seq"]).first()["v"] is None
    assert rows(sets.refresh_merge(base, new.distinct(), "k", True)) == [(2, "B"), (3, "C")]
    assert rows(sets.refresh_merge(base, new.distinct(), "k", False)) == [(1, "a"), (2, "B"), (3, "C")]


def test_tag_changes(spark, tags, rows):
    items = spark.createDataFrame([(2,), (4,)], "media_id long")
    out = L.replace_tags(tags, items, [" City ", "", "New", "City"])
    assert rows(out, "media_id", "tag", "is_auto") == [
        (1, "Nature", False), (2, "City", False), (2, "New", False), (3, "City", False),
        (4, "City", False), (4, "New", False),
    ]
    assert rows(L.replace_tags(tags, items, []), "media_id", "tag") == [(1, "Nature"), (3, "City")]
    known = spark.createDataFrame([("City", 7)], "tag string, tag_id long")
    grown = L.add_tags(known, spark.createDataFrame([("b",), ("a",), (" City",), (" ",)], "tag string"))
    assert rows(grown) == [("City", 7), ("a", 8), ("b", 9)]


def test_auto_tags_never_replace_manual_ones(spark, tags, rows):
    found = spark.createDataFrame([("Nature", 1, 0.8), ("Nature", 3, 0.7)], "tag string, media_id long, confidence double")
    out = L.merge_auto_tags(tags, found, found)
    assert rows(out.where("tag = 'Nature'"), "media_id", "is_auto", "confidence") == [(1, False, None), (3, True, 0.7)]
    scope = spark.createDataFrame([(3,)], "media_id long")
    scoped = L.merge_auto_tags(tags, found, found, scope)
    assert rows(scoped.where("tag = 'Nature'"), "media_id", "is_auto") == [(1, False), (2, True), (3, True)]
    gone = L.merge_auto_tags(tags, found.limit(0), found.select("tag"))
    assert rows(gone.where("tag = 'Nature'"), "media_id") == [(1,)]


def test_folder_changes(spark, rows):
    folders = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "folder_id string, name string, sort_order long")
    new = spark.createDataFrame([("c", " C ", 0), ("d", "  ", 1), ("e", "E", 2)], "folder_id string, name string, pos long")
    assert rows(L.create_folders(folders, new)) == [("a", "A", 0), ("b", "B", 1), ("c", "C", 2), ("e", "E", 3)]
    assert rows(L.create_folders(folders.limit(0), new), "folder_id", "sort_order") == [("c", 0), ("e", 1)]
    names = spark.createDataFrame([("a", " Z "), ("b", " "), ("x", "X")], "folder_id string, name string")
    assert rows(L.rename_folders(folders, names), "folder_id", "name") == [("a", "Z"), ("b", "B")]
    order = spark.createDataFrame([("b", 0), ("a", 1)], "folder_id string, pos long")
    assert rows(L.reorder_folders(folders, order), "folder_id", "sort_order") == [("a", 1), ("b", 0)]
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "folder_id string, media_id long")
    kept, inside = L.delete_folder(folders, members, folders.where("folder_id = 'a'"))
    assert rows(kept, "folder_id") == [("b",)] and rows(inside) == [("b", 1)]
    grown, added = L.add_to_folder(members, spark.createDataFrame([("a", 2), ("a", 3)], members.schema))
    assert grown.count() == 4 and rows(added) == [("a", 1)]
    fewer, removed = L.remove_from_folder(members, spark.createDataFrame([("a", 2), ("a", 9)], members.schema))
    assert fewer.count() == 2 and rows(removed) == [("a", 1)]


def test_dedup_first_arrival_wins_under_skew(spark, rows):
    # a third of the batch shares one hash
    batch = spark.range(300).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "no_hash")
        .otherwise(F.concat(F.lit("h"), F.col("id") % 20)).alias("phash"),
        F.when(F.col("id") % 7 == 0, "x.txt").otherwise("x.jpg").alias("original_filename"),
        (1000 - F.col("id")).alias("uploaded_at"),
    )
    existing = spark.createDataFrame([("h1",), ("h1",), ("no_hash",)], "phash string")
    got = {r["id"]: r["status"] for r in K.dedup_ingest(batch, existing).collect()}
    seen, want = {"h1"}, {}
    for r in sorted(batch.collect(), key=lambda r: (r["uploaded_at"], r["id"])):
        if r["original_filename"].endswith("txt"):
            want[r["id"]] = "rejected"
        elif r["phash"] == "no_hash":
            want[r["id"]] = "created"
        else:
            want[r["id"]] = "duplicate" if r["phash"] in seen else "created"
            seen.add(r["phash"])
    assert got == want


def test_composite_fingerprint(spark, rows):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    frames = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, None)], "id long, frame_no int, hash string")
    assert rows(K.composite_fingerprint(items, frames)) == [(1, "a|b"), (2, "no_hash"), (3, "no_hash")]


def test_schema_and_models(spark, rows):
    old = spark.createDataFrame([("1", 5)], "media_id string, tag_id int")
    got = tables.conform_schema(old, tables.SCHEMAS["media_tags"], tables.DEFAULTS["media_tags"])
    assert tuple(got.first()) == ("1", 5, False, None)
    stored = spark.createDataFrame([("a", [1.0], 0.0, -2.0, 0.0, 3, 4)], "tag string, weights array<double>, bias double, platt_a double, platt_b double, trained_at_count long, version long")
    fresh = stored.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("tag"), F.array(F.lit(2.0)).alias("weights"), "bias", "platt_a", "platt_b", F.lit(9).cast("long").alias("trained_at_count"))
    assert rows(tables.save_models(stored, fresh), "tag", "trained_at_count", "version") == [("a", 9, 5), ("b", 9, 1)]


def test_repeated_keys_in_changes(spark, rows):

    folders = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "folder_id string, name string, sort_order long")
    names = spark.createDataFrame([("a", " X ", 1), ("a", "Y", 2), ("b", " ", 3), ("b", None, 4)], "folder_id string, name string, seq long")
    assert rows(L.rename_folders(folders, names, ["seq"]), "folder_id", "name") == [("a", "Y"), ("b", "B")]
    assert L.refused_names(names).count() == 2
    new = spark.createDataFrame([("c", "C", 1), ("c", "CC", 2), ("a", "again", 3)], "folder_id string, name string, pos long")
    assert rows(L.create_folders(folders, new), "folder_id", "name") == [("a", "A"), ("b", "B"), ("c", "CC")]
    tags = spark.createDataFrame([(1, "t", True, 0.1)], "media_id long, tag string, is_auto boolean, confidence double")
    guess = spark.createDataFrame([("t", 1, 0.5), ("t", 1, 0.9)], "tag string, media_id long, confidence double")
    assert rows(L.merge_auto_tags(tags, guess, guess)) == [(1, "t", True, 0.9)]
    base = spark.createDataFrame([(1, "old")], "id long, v string")
    twice = spark.createDataFrame([(1, "m"), (1, "z"), (2, "q")], "id long, v string")
    assert rows(sets.upsert(base, twice, ["id"])) == [(1, "z"), (2, "q")]
    favorites = spark.createDataFrame([(1, None)], "media_id long, created_at timestamp")
    on = spark.createDataFrame([(2, 1, True), (2, 2, True)], "media_id long, seq long, favorite boolean").withColumn("ts", F.timestamp_seconds("seq"))
    got = {r.media_id: r.created_at for r in L.set_favorites(favorites, on).collect()}
    assert set(got) == {1, 2} and got[2].second == 2
