"""Keyed state of a micro-batch job as a log of changes with snapshots.

A batch writes only the rows it changed, with a mark on those that are gone, in buckets by a
hash of one column. Reading back takes the last snapshot and the changes since, of the
buckets that the batch's keys fall into. Every ``compact_every`` batches the state is
written as a new snapshot, so no read goes further back.

Folders are ``changes/batch=<n>/bucket=<b>`` and ``snapshot/batch=<n>/bucket=<b>``. Batch n reads what
batches before it wrote; run again after a failure, it replaces its own folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyedLog:
    """Rows of ``schema`` with the unique key ``key``, in buckets by ``bucket_by`` (one of the key columns)."""

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str], bucket_by: str | None = None,
        buckets: int = 64, compact_every: int = 20,
    ):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, list(key)
        self.bucket_by, self.buckets, self.compact_every = bucket_by or key[0], buckets, compact_every
        extra = [("_gone", T.BooleanType()), ("batch", T.LongType()), ("bucket", T.IntegerType())]
        self.stored = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in extra]])

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.bucket_by).cast("string")), F.lit(self.buckets)).cast("int"))

    def _batches(self, kind: str) -> list[int]:
        """Numbers of the finished folders of one kind, by name alone."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        done = []
        for status in system.listStatus(where):
            name = status.getPath().getName()
            if name.startswith("batch=") and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done.append(int(name.removeprefix("batch=")))
        return sorted(done)

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        self._bucket(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}/batch={batch}")

    def start(self, base: DataFrame) -> None:
        """Take in what there was before the first batch, once."""
        if not self._batches("snapshot"):
            kept = base.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).dropDuplicates(self.key)
            self._write(kept.withColumn("_gone", F.lit(False)), "snapshot", -1)

    def before(self, batch: int | None = None, touched: DataFrame | None = None) -> DataFrame:
        """The state that batch ``batch`` finds (null: after all batches); with ``touched``, one column of
        ``bucket_by`` values, only their rows are read."""
        upto = float("inf") if batch is None else batch
        snapshots = [b for b in self._batches("snapshot") if b < upto]
        since = snapshots[-1] if snapshots else -2
        folders = [f"{self.root}/snapshot/batch={since}"] if snapshots else []
        folders += [f"{self.root}/changes/batch={b}" for b in self._batches("changes") if since < b < upto]
        rows = self.spark.createDataFrame([], self.stored)
        for folder in folders:  # at most compact_every and one
            number = int(folder.rsplit("=", 1)[1])
            plain = T.StructType([f for f in self.stored if f.name != "batch"])
            rows = rows.unionByName(self.spark.read.schema(plain).parquet(folder).withColumn("batch", F.lit(number).cast("long")))
        if touched is not None:
            wanted = self._bucket(touched.toDF(self.bucket_by).distinct())
            # At most one number per bucket; it prunes folders before anything is read.
            found = [r[0] for r in wanted.select("bucket").distinct().collect()]
            rows = rows.where(F.col("bucket").isin(found)).join(wanted.select(self.bucket_by), self.bucket_by, "left_semi")
        names = [f.name for f in self.schema]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct("_gone", *names), "batch").alias("_row"))
        return last.where(~F.col("_row._gone")).select(*[f"_row.{n}" for n in names])

    def put(self, batch: int, changed: DataFrame, gone: DataFrame) -> None:
        """Write the rows that ``batch`` set and the keys it removed; snapshot when it is time."""
        names = [f.name for f in self.schema]
        lost = gone.select(*self.key).distinct().select(*[
            (F.col(f.name) if f.name in self.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema
        ])
        rows = changed.select(*names).withColumn("_gone", F.lit(False)).unionByName(lost.withColumn("_gone", F.lit(True)))
        self._write(rows, "changes", batch)
        if (batch + 1) % self.compact_every == 0:
            self._write(self.before(batch + 1).withColumn("_gone", F.lit(False)), "snapshot", batch)
