"""Typed scans, schema conformance and writes of the library tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS: dict[str, str] = {
    "media": (
        "id string, filename string, original_filename string, media_type string, phash string, "
        "uploaded_at timestamp_ntz, original_date timestamp_ntz, width int, height int, "
        "size_bytes bigint, exif_json string"
    ),
    "vectors": "id string, embedding array<float>",
    "folders": "folder_id string, name string, created_at timestamp_ntz, sort_order bigint",
    "folder_media": "folder_id string, media_id string, added_at timestamp_ntz",
    "favorites": "media_id string, created_at timestamp_ntz",
    "tags": "tag_id bigint, tag string",
    "media_tags": "media_id string, tag_id bigint, is_auto boolean, confidence double",
    "tag_models": (
        "tag_id bigint, weights array<double>, bias double, platt_a double, platt_b double, "
        "trained_at_count bigint, version bigint"
    ),
}

# What a column holds when a stored table predates it.
DEFAULTS: dict[str, dict[str, object]] = {
    "media": {"media_type": "image"},
    "folders": {"sort_order": 0},
    "media_tags": {"is_auto": False, "confidence": None},
    "tag_models": {"platt_a": -2.0, "platt_b": 0.0, "trained_at_count": 0, "version": 1},
}


def conform_schema(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Cast to ``schema``, filling columns the table does not have yet."""
    want = T.StructType.fromDDL(schema)
    defaults = defaults or {}
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)))
            .cast(f.dataType).alias(f.name)
            for f in want
        ]
    )


def load_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One library table with the declared types.

    Parquet carries its own columns, so an older file is read as it is and
    conformed; text formats get the schema up front and are never inferred.
    """
    path = f"{root}/{name}"
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        reader = spark.read.schema(SCHEMAS[name])
        raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    return conform_schema(raw, SCHEMAS[name], DEFAULTS.get(name))


def load_library(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: load_table(spark, root, name, fmt) for name in SCHEMAS}


def append_media(media: DataFrame, vectors: DataFrame, root: str) -> None:
    """Append item rows, and vector rows only where a vector exists."""
    media.write.mode("append").parquet(f"{root}/media")
    vectors.where(F.col("embedding").isNotNull()).write.mode("append").parquet(f"{root}/vectors")


def write_sharded(rows: DataFrame, root: str, key: str = "id") -> None:
    """Write partitioned by the two leading pairs of the id, like the file store."""
    text = F.col(key).cast("string")
    (
        rows.withColumn("p1", F.substring(text, 1, 2)).withColumn("p2", F.substring(text, 3, 2))
        .repartition("p1", "p2")
        .write.mode("append").partitionBy("p1", "p2").parquet(root)
    )


def save_models(stored: DataFrame, trained: DataFrame, key: str = "tag") -> DataFrame:
    """Stored models with the trained ones in place, versions counted up."""
    fields = ["weights", "bias", "platt_a", "platt_b", "trained_at_count"]
    s = stored.select(key, F.col("version").alias("_v"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    t = trained.select(key, F.lit(True).alias("_new"), *fields)
    return s.join(t, key, "full").select(
        key,
        *[F.when(F.col("_new"), F.col(f)).otherwise(F.col(f"_s_{f}")).alias(f) for f in fields],
        (F.coalesce("_v", F.lit(0)) + F.when(F.col("_new"), 1).otherwise(0)).cast("long").alias("version"),
    )


def last_trained_count(tags: DataFrame, models: DataFrame, key: str = "tag") -> DataFrame:
    """Label count at the last training; zero for a tag without a model."""
    return tags.select(key).join(models.select(key, "trained_at_count"), key, "left").withColumn(
        "trained_at_count", F.coalesce("trained_at_count", F.lit(0))
    )
