import datetime as dt

import pytest
from pyspark.sql import functions as F

from lightbox.functions import scalars as S

T = dt.datetime


def value(spark, column, **literals):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("a.JPG", "jpg"), ("a.tar.gz", "gz"), ("noext", "bin"), (".hidden", "bin"), ("dir.x/file", "bin"),
        ("dir/a.", ""), ("up/b.Mp4", "mp4"), ("", "bin"),
    ],
)
def test_file_extension(spark, name, want):
    assert value(spark, S.file_extension(F.col("n")), n=name) == want


def test_allowlist(spark):
    for ext in (*S.IMAGE_EXTENSIONS, *S.VIDEO_EXTENSIONS):
        assert value(spark, S.allowed_extension(F.col("e")), e=ext)
    for ext in ("html", "svg", "exe", "php", "sh", "bin"):
        assert not value(spark, S.allowed_extension(F.col("e")), e=ext)
        assert value(spark, S.rejection_reason(F.col("e")), e=ext) == f"File type not allowed: .{ext}"
    assert value(spark, S.media_type(F.col("e")), e="mkv") == "video"
    assert value(spark, S.media_type(F.col("e")), e="heic") == "image"


@pytest.mark.parametrize(
    "name, want",
    [
        ("IMG_20240115_134530.jpg", T(2024, 1, 15, 13, 45, 30)),
        ("2024-01-15_13-45-30.jpg", T(2024, 1, 15, 13, 45, 30)),
        ("PXL_20240115_134530123.jpg", T(2024, 1, 15, 13, 45, 30)),
        ("dir/20990101.png", T(2099, 1, 1)),
        ("a\\20240115.png", T(2024, 1, 15)),
        ("20240115_999999.jpg", T(2024, 1, 15)),
        ("20241315.jpg", None), ("18991231.jpg", None), ("21010101.jpg", None), ("1234567.jpg", None),
        ("20240230.jpg", None), ("x.20240115", None), ("²0240115x20240116.jpg", None),
    ],
)
def test_date_from_filename(spark, name, want):
    assert value(spark, S.date_from_filename(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024:01:15 13:45:30", T(2024, 1, 15, 13, 45, 30)),
        (" 2024-01-15 13:45:30 ", T(2024, 1, 15, 13, 45, 30)),
        ("2024/01/15 13:45:30", T(2024, 1, 15, 13, 45, 30)),
        ("2024:01:15", T(2024, 1, 15)), ("2024-1-5", T(2024, 1, 5)),
        ("2024-13-01", None), ("2024:01:15 25:00:00", None), ("unknown", None), ("", None), (None, None),
    ],
)
def test_parse_exif_datetime(spark, text, want):
    col = S.parse_exif_datetime(F.col("t").cast("string"))
    assert value(spark, col, t=text) == want


def test_original_date_order(spark):
    up = F.lit(T(2030, 1, 1)).cast("timestamp_ntz")
    exif = '{"DateTimeOriginal":"bad","DateTime":"2001:01:01 01:01:01"}'
    assert value(spark, S.resolve_original_date(F.col("x"), F.col("n"), up), x=exif, n="20020202.jpg") == T(2001, 1, 1, 1, 1, 1)
    assert value(spark, S.resolve_original_date(F.col("x"), F.col("n"), up), x="nope", n="20020202.jpg") == T(2002, 2, 2)
    assert value(spark, S.resolve_original_date(F.col("x"), F.col("n"), up), x="nope", n="a.jpg") == T(2030, 1, 1)


@pytest.mark.parametrize(
    "name, want",
    [
        ("../../etc/passwd", "....etcpasswd"), ('a"b\'c.jpg', "abc.jpg"), ("\x00\x1fx\n.png", "x.png"),
        ("  spaced .jpg ", "spaced .jpg"), ("/\\", "download"), ("", "download"), ("　ä.jpg ", "ä.jpg"),
    ],
)
def test_sanitize_filename(spark, name, want):
    assert value(spark, S.sanitize_filename(F.col("n")), n=name) == want


def test_safe_archive_name(spark):
    assert value(spark, S.safe_archive_name(F.col("n")), n="My Trip (2024)!") == "My_Trip__2024"
    assert value(spark, S.safe_archive_name(F.col("n")), n="été-1.b_c") == "été-1.b_c"
    assert value(spark, S.safe_archive_name(F.col("n")), n="!!!") == "folder"


def test_distances_lists_sizes(spark):
    assert value(spark, S.similarity_to_distance(F.col("s")), s=70.0) == pytest.approx(0.6)
    assert value(spark, S.similarity_to_distance(F.col("s")), s=-50.0) == 2.0
    assert value(spark, S.similarity_to_distance(F.col("s"), clamp=False), s=150.0) == -1.0
    assert value(spark, S.parse_tag_list(F.col("s")), s=" a, ,b,") == ["a", "b"]
    assert value(spark, S.parse_tag_list(F.col("s")), s="") is None
    for n, want in [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (2 * 1024**4, "2.0 TB")]:
        assert value(spark, S.format_bytes(F.col("n")), n=n) == want


def test_guards_and_paths(spark):
    ok = S.decode_allowed(F.col("w"), F.col("h"))
    assert value(spark, ok, w=65000, h=2000)
    assert not value(spark, ok, w=65001, h=1)
    assert not value(spark, ok, w=20000, h=20000)
    assert value(spark, S.oriented_width(F.col("w"), F.col("h"), F.lit(6)), w=3, h=4) == 4
    assert value(spark, S.oriented_width(F.col("w"), F.col("h"), F.lit(3)), w=3, h=4) == 3
    assert value(spark, S.storage_path(F.col("i"), F.col("e")), i="abcd-1", e="png") == "ab/cd/abcd-1.png"
