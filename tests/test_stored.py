"""Pages over the stored catalog against a sort of everything."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lightbox.operators import catalog as C
from lightbox.operators import stored as P

SCHEMA = "id long, original_filename string, exif_json string, uploaded_at timestamp_ntz, size_bytes long"
START = dt.datetime(2020, 1, 1)


def items(lo, hi, seed=3):
    rnd = random.Random(seed + lo)
    names = ["a.jpg", "b.mp4", None, "IMG_20190304_101112.png", "c"]
    return [
        (i, rnd.choice(names), None, None if i % 17 == 0 else START + dt.timedelta(hours=rnd.randint(0, 90)), i)
        for i in range(lo, hi)
    ]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("catalog"))
    parts = [spark.createDataFrame(items(a, b), SCHEMA) for a, b in ((0, 600), (600, 800), (800, 830))]
    P.write_catalog(parts[0], root, 50)
    P.append_catalog(parts[1], root, 50)
    P.append_catalog(parts[2], root, 50)
    return root, C.derive_catalog(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def expected(media, media_type, ascending):
    rows = C.filter_media_type(media, media_type).select("id", "original_date").collect()
    key = lambda r: (r[1] is not None, r[1] or START, r[0])
    return [r[0] for r in sorted(rows, key=key, reverse=not ascending)]


@pytest.mark.parametrize("media_type", [None, "image", "video"])
@pytest.mark.parametrize("ascending", [False, True])
def test_pages_of_overlapping_runs(spark, library, media_type, ascending):
    root, media = library
    want = expected(media, media_type, ascending)
    for page_no in (1, 5, len(want) // 30 + 1, 100):
        got = P.stored_page(spark, root, page_no, 30, media_type, ascending)
        assert [r["id"] for r in got.collect()] == want[(page_no - 1) * 30 : page_no * 30]
    by_blocks = P.stored_page(spark, root, 5, 30, media_type, ascending, fold_rows=4)
    assert [r["id"] for r in by_blocks.collect()] == want[120:150]


@pytest.mark.parametrize("ascending", [False, True])
def test_page_after_a_row(spark, library, ascending):
    root, media = library
    dated = media.where("original_date is not null")
    want = expected(dated, None, ascending)
    dates = {r["id"]: r["original_date"] for r in dated.collect()}
    for at in (0, 100, len(want) - 10, len(want) - 1):
        got = P.stored_page_after(spark, root, dates[want[at]], want[at], 20, None, ascending)
        assert [r["id"] for r in got.collect()] == want[at + 1 : at + 21]


def test_pages_skip_files(spark, library, tmp_path):
    root, media = library
    files = P.bounds(spark, root).select("run", "file").distinct().count()
    some, rest = P.page_files(spark, root, 300, 30)
    assert 0 < len(some) < files / 2 and rest < 300
    one = str(tmp_path / "one")
    P.write_catalog(spark.createDataFrame(items(0, 2000), SCHEMA), one, 50)
    total = P.bounds(spark, one).select("file").distinct().count()
    assert total >= 35
    for offset in (0, 777, 1900):
        met, left = P.page_files(spark, one, offset, 20)
        assert len(met) < total / 10 and left < 160
    plan = P.stored_page(spark, one, 1, 20)._jdf.queryExecution().toString()
    assert "get_json_object" not in plan and "regexp" not in plan
    assert P.page_files(spark, one, 5000, 20)[0] == []


def test_compaction_and_counts(spark, library):
    root, media = library
    before = [tuple(r) for r in P.stored_counts(spark, root).collect()]
    assert before == [tuple(r) for r in C.media_counts(media).collect()]
    want = expected(media, None, False)
    P.compact_catalog(spark, root, 50)
    assert P.bounds(spark, root).select("run").distinct().count() == 1
    assert [tuple(r) for r in P.stored_counts(spark, root).collect()] == before
    assert [r["id"] for r in P.stored_page(spark, root, 4, 50).collect()] == want[150:200]
    assert len(P.page_files(spark, root, 150, 50)[0]) < 5


def test_empty(spark, tmp_path):
    root = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        P.bounds(spark, root)
    P.write_catalog(spark.createDataFrame([], SCHEMA), root)
    assert P.stored_page(spark, root).count() == 0
    assert P.read_catalog(spark, root).count() == 0
    assert [tuple(r) for r in P.stored_counts(spark, root).collect()] == [(0, 0, 0, 0)]
    P.append_catalog(spark.createDataFrame(items(0, 5), SCHEMA), root)
    assert P.stored_page(spark, root).where(F.col("id") >= 0).count() == 5
