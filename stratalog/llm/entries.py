"""Entries of snapshots by the delivery that counts, without moving their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.sources.tables import clean_path, newest


def _delivery() -> Column:
    return F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(0)).alias("delivery")


def texts(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, content, delivery) of every delivery with a text."""
    return files.filter("content is not null and snapshot_id is not null and path is not null and not coalesce(deleted, false)").select("snapshot_id", clean_path("path").alias("path"), "content", _delivery())


def counting(files: DataFrame) -> DataFrame:
    """(snapshot_id, path, delivery, has_text) of the live, not binary entry that counts for each key. Only keys and
    hashes are shuffled; joined by (snapshot_id, path, delivery) to what was made of ``texts`` it drops earlier deliveries."""
    slim = files.filter("snapshot_id is not null and path is not null").select(
        "snapshot_id", clean_path("path").alias("path"), "received_at", F.coalesce("deleted", F.lit(False)).alias("gone"), F.coalesce("is_binary", F.lit(False)).alias("binary"), F.col("content").isNotNull().alias("has_text"), F.xxhash64("content").alias("__text")
    )
    return newest(slim, ["snapshot_id", "path"]).filter("not gone and not binary").select("snapshot_id", "path", _delivery(), "has_text")


def owners(snapshots: DataFrame) -> DataFrame:
    """(snapshot_id, owner): the workspace of each snapshot."""
    return newest(snapshots.filter("snapshot_id is not null").select("snapshot_id", "workspace", "received_at"), ["snapshot_id"]).select("snapshot_id", F.col("workspace").alias("owner"))
