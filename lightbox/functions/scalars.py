"""Column expressions over one row: names, dates, units, metadata.

Everything here is built from SQL functions, so it stays inside whole-stage
code generation and reaches the scan as projection or filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted upload extensions.
IMAGE_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "heic", "heif", "avif",
)
VIDEO_EXTENSIONS = ("mp4", "mov", "avi", "mkv", "webm")

# Hash text of an item that could not be hashed.
NO_HASH = "no_hash"

# Decode limits in pixels per side and in bytes.
MAX_SIDE = 65_000
MAX_DECODE_BYTES = 500 * 1024 * 1024

# EXIF fields that may carry the capture time, best first.
EXIF_DATE_FIELDS = ("DateTimeOriginal", "DateTimeDigitized", "DateTime")

# Size units.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def file_extension(name: Column) -> Column:
    """Lower-cased text after the last dot of the last path component."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.when(
        base.rlike(r"(?s)^.+\.[^.]*$"), F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1))
    ).otherwise("bin")


def media_type(ext: Column) -> Column:
    return F.when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("image")


def allowed_extension(ext: Column) -> Column:
    return ext.isin(*IMAGE_EXTENSIONS, *VIDEO_EXTENSIONS)


def rejection_reason(ext: Column) -> Column:
    """Error text for an extension outside the allowlist, else null."""
    return F.when(~allowed_extension(ext), F.concat(F.lit("File type not allowed: ."), ext))


def _timestamp_from(text: Column, pattern: str, spelled: str) -> Column:
    """Timestamp spelled from the groups of ``pattern``; null when it does not fit.

    Text outside the pattern turns into separators only, which no cast accepts,
    so the text is looked at once.
    """
    return F.regexp_replace(text, rf"(?s)^(?:{pattern}|.*)$", spelled).try_cast("timestamp_ntz")


def date_from_filename(name: Column) -> Column:
    """Capture time spelled by the digits of a file name, or null.

    Fourteen or more digits are read as date and time, eight or more as a
    date; only years 1970 to 2100 count.
    """
    base = F.regexp_extract(name, r"(?s)([^/\\]*)$", 1)
    digits = F.regexp_replace(F.regexp_replace(base, r"(?s)\.[^.]*$", ""), "[^0-9]", "")
    day = r"(19[7-9]\d|20\d\d|2100)(\d\d)(\d\d)"
    return F.coalesce(
        _timestamp_from(digits, day + r"(\d\d)(\d\d)(\d\d).*", "$1-$2-$3 $4:$5:$6"),
        _timestamp_from(digits, day + ".*", "$1-$2-$3"),
    )


def parse_exif_datetime(text: Column) -> Column:
    """Timestamp from the two EXIF separators, with or without time of day."""
    t = F.replace(strip(text), F.lit("/"), F.lit("-"))
    return _timestamp_from(
        t, r"(\d{4})([:-])(\d{1,2})\2(\d{1,2})(?:\s*(\d{1,2}:\d{1,2}:\d{1,2}))?", "$1-$3-$4 $5"
    )


def exif_map(exif_json: Column) -> Column:
    """EXIF text as a map; null for text that is not a JSON object."""
    return F.from_json(exif_json, "map<string,string>")


def exif_original_date(exif_json: Column) -> Column:
    """First field, best first, whose text is a readable time."""
    return F.coalesce(
        *[parse_exif_datetime(F.get_json_object(exif_json, f"$.{f}")) for f in EXIF_DATE_FIELDS]
    )


def resolve_original_date(exif_json: Column, name: Column, uploaded_at: Column) -> Column:
    return F.coalesce(exif_original_date(exif_json), date_from_filename(name), uploaded_at)


def oriented_width(width: Column, height: Column, orientation: Column) -> Column:
    return F.when(orientation.between(5, 8), height).otherwise(width)


def oriented_height(width: Column, height: Column, orientation: Column) -> Column:
    return F.when(orientation.between(5, 8), width).otherwise(height)


def decode_allowed(width: Column, height: Column, bytes_per_pixel: int = 4) -> Column:
    need = width.cast("long") * height.cast("long") * F.lit(bytes_per_pixel)
    return (width <= MAX_SIDE) & (height <= MAX_SIDE) & (need <= MAX_DECODE_BYTES)


def strip(text: Column) -> Column:
    """Trim white space of every script, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize_filename(name: Column) -> Column:
    clean = strip(F.regexp_replace(name, r"[\p{Cc}/\\\"']", ""))
    return F.when(clean == "", "download").otherwise(clean)


def safe_archive_name(name: Column) -> Column:
    safe = F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}._-]", "_")
    safe = F.regexp_replace(safe, "^_+|_+$", "")
    return F.when(safe == "", "folder").otherwise(safe)


def similarity_to_distance(similarity: Column, clamp: bool = True) -> Column:
    """Cosine distance for a similarity of 0 to 100 percent."""
    distance = F.lit(2.0) * (F.lit(1.0) - similarity / F.lit(100.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), distance)) if clamp else distance


def parse_tag_list(text: Column) -> Column:
    """Trimmed, non-empty names of a comma list; null means no filter."""
    names = F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")
    return F.when(F.length(text) > 0, names)


def format_bytes(size: Column) -> Column:
    """Size in 1024-based units: no decimals for bytes, else one."""
    unit = F.least(F.floor(F.log(size) / F.log(F.lit(1024.0))), F.lit(len(BYTE_UNITS) - 1))
    value = size / F.pow(F.lit(1024.0), unit)
    label = F.element_at(F.array(*[F.lit(u) for u in BYTE_UNITS]), (unit + 1).cast("int"))
    return (
        F.when(size == 0, "0 B")
        .when(unit == 0, F.concat(size.cast("long").cast("string"), F.lit(" "), label))
        .otherwise(F.concat(F.format_string("%.1f", value), F.lit(" "), label))
    )


def storage_path(item_id: Column, ext: Column) -> Column:
    """``ab/cd/abcd....ext`` below the storage root; ext ``jpg`` for thumbnails."""
    text = item_id.cast("string")
    return F.concat(
        F.substring(text, 1, 2), F.lit("/"), F.substring(text, 3, 2), F.lit("/"),
        text, F.lit("."), ext,
    )
