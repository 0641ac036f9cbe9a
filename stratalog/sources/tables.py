"""Readers and the cleaning steps that all tables share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.session import staged


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clean_path(c: Column | str) -> Column:
    """One spelling for a path: ``/`` for ``\\``, no leading ``./``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")


def newest(df: DataFrame, keys: list[str | Column], received: str = "received_at") -> DataFrame:
    """Of each key the row received last. Ties go to the row with the larger content hash, so a re-run picks alike;
    a null ``received`` counts as earliest. The filter on the rank lets each map task drop losers before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(F.col(received).desc_nulls_last(), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]).desc())
    return df.withColumn("__rank", F.row_number().over(rank)).filter("__rank = 1").drop("__rank")


def small(df: DataFrame, max_bytes: int = 8_000_000) -> DataFrame:
    """``df``, staged, and marked for broadcast if it takes at most ``max_bytes`` as written (joined by shuffle beyond).

    It is computed once: what is measured is what is joined.
    """
    written = staged(df)
    return F.broadcast(written) if int(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= max_bytes else written


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan or what is made of one without a shuffle, over at least as many tasks as there are cores. A table
    of few splits, such as one small file, would else leave most of them idle in a stage of long work on each row; a
    large table has more splits than cores and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
