"""A store of snapshots, entries and vectors in Parquet, partitioned by snapshot."""

from __future__ import annotations

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Store:
    """Tables below a folder that all executors share. Entries and vectors lie in a folder for each snapshot, so one is
    replaced or deleted without touching the others, and a scan of some reads only those."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def save(self, snapshots: DataFrame, entries: DataFrame) -> None:
        """Add snapshots and their entries; one saved before is replaced. Rows without an id or time are left out."""
        good = snapshots.filter("snapshot_id is not null and ts is not null")
        for name, df in (("snapshots", good), ("entries", entries.join(good.select("snapshot_id"), "snapshot_id", "left_semi"))):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{self.folder}/{name}")

    def snapshots(self) -> DataFrame | None:
        found = self._read("snapshots")
        return None if found is None else found.withColumn("snapshot_id", F.col("snapshot_id").cast("string"))

    def entries(self) -> DataFrame | None:
        found = self._read("entries")
        return None if found is None else found.withColumn("snapshot_id", F.col("snapshot_id").cast("string"))

    def listed(self) -> DataFrame | None:
        """Snapshots that have entries, oldest first."""
        s, e = self.snapshots(), self.entries()
        return None if s is None or e is None else s.join(e.select("snapshot_id").distinct(), "snapshot_id", "left_semi").orderBy("ts", "snapshot_id")

    def delete(self, snapshot_id: str) -> None:
        """Remove a snapshot with its entries and vectors."""
        jvm = self.spark.sparkContext._jvm
        for name in ("entries", "vectors", "snapshots"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/snapshot_id={snapshot_id}")
            with contextlib.suppress(Exception):
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def upsert_vectors(self, chunks: DataFrame, embedded: DataFrame) -> None:
        """Vectors of chunks (snapshot_id, chunk_id, ..) by (chunk_id, embedding); of a chunk given twice the last by
        embedding order. A chunk without a vector is an error."""
        w = Window.partitionBy("chunk_id").orderBy(F.xxhash64("embedding").desc())
        one = embedded.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
        both = chunks.join(one, "chunk_id", "left")
        checked = both.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no vector for chunk "), "chunk_id"))).otherwise(F.col("embedding")))
        checked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{self.folder}/vectors")

    def vectors(self) -> DataFrame | None:
        return self._read("vectors")

    def export(self, snapshot_id: str, path: str) -> int:
        """Write a snapshot as JSON lines, its entries as records; returns the bytes of text written."""
        e = self.entries().filter(F.col("snapshot_id") == snapshot_id)
        rows = e.select(F.to_json(F.struct(*sorted(e.columns))).alias("value"))
        rows.write.mode("overwrite").text(path)
        return rows.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0


def recovered(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots from JSON files below a folder, whatever an index says; files that cannot be read are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema("id string, timestamp long, description string, tags array<string>, _bad string").json(folder)
    return raw.filter("_bad is null and id is not null and timestamp is not null").select(F.col("id").alias("snapshot_id"), F.timestamp_millis("timestamp").alias("ts"), "description", "tags").orderBy("ts", "snapshot_id")


def hashed_embedding(text: F.Column, size: int = 64) -> F.Column:
    """A vector of a text without a model: its words are hashed into ``size`` places with a sign and normalised. Stands
    where a service would be asked."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9a-z_]+)"), 1)
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")
    sign = lambda w: F.when(F.pmod(F.xxhash64(F.lit(1), w), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    weights = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(words, lambda w: place(w) == i), F.lit(0.0), lambda a, w: a + sign(w)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(weights, lambda x: F.when(norm(weights) > 0, x / norm(weights)).otherwise(0.0))
