"""Rules that take a snapshot when events arrive: throttled, by interval, or after a pause."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def throttled(events: DataFrame, rule: str, ts: str, ident: str, hours: float) -> DataFrame:
    """(rule, ident, ts) of the events that fire: the first of a rule, then each at least ``hours`` after the last that
    fired. Events come sorted by rule and time and are streamed, so a rule with any number of events holds one time.
    Events without a time or rule never fire."""
    gap = int(hours * 3_600_000_000)
    rows = events.filter(F.col(rule).isNotNull() & F.col(ts).isNotNull()).select(F.col(rule).cast("string").alias("rule"), F.col(ident).cast("long").alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    rows = rows.repartition("rule").sortWithinPartitions("rule", "us", "id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, last = None, 0
        for part in parts:
            keep = []
            for r, us in zip(part["rule"], part["us"], strict=True):
                fires = r != rule or us - last >= gap
                if fires:
                    rule, last = r, us
                keep.append(fires)
            yield part[keep]

    return rows.mapInPandas(run, "rule string, id long, us long").select("rule", F.col("id").alias(ident), F.timestamp_micros("us").cast("timestamp_ntz").alias(ts))


def sessions(events: DataFrame, keys: list[str], ts: str, gap_minutes: int) -> DataFrame:
    """(keys.., started, ended, events): runs of events at most the gap apart, as in a session window."""
    w = Window.partitionBy(*keys).orderBy(ts)
    new = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > gap_minutes * 60_000_000
    runs = events.withColumn("__run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events")).drop("__run")


def per_interval(events: DataFrame, keys: list[str], ts: str, hours: int) -> DataFrame:
    """(keys.., started, events): events to an interval of whole hours since the epoch."""
    size = hours * 3600
    start = F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000000 div {size} * {size}")
    return events.filter(F.col(ts).isNotNull()).groupBy(*keys, F.timestamp_seconds(start).cast("timestamp_ntz").alias("started")).agg(F.count("*").alias("events"))


def reminders(saves: DataFrame, snapshots: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """(key, since, due): after each snapshot of a key (and before the first) the first save, and when a reminder is due
    unless a snapshot is taken before. One pass over both, sorted by time."""
    both = saves.select(key, F.col(ts), F.lit(False).alias("s")).unionByName(snapshots.select(key, F.col(ts), F.lit(True).alias("s")))
    w = Window.partitionBy(key).orderBy(ts, F.col("s").desc())
    epoch = both.withColumn("e", F.sum(F.col("s").cast("int")).over(w))
    first = epoch.groupBy(key, "e").agg(F.min(F.when(~F.col("s"), F.col(ts))).alias("since"))
    ends = epoch.filter("s").groupBy(key, "e").agg(F.min(ts).alias("taken")).select(key, (F.col("e") - 1).alias("e"), "taken")
    due: Column = F.col("since") + F.expr(f"interval {minutes} minutes")
    return first.filter("since is not null").join(ends, [key, "e"], "left").filter(F.col("taken").isNull() | (F.col("taken") > due)).select(key, "since", due.alias("due"))
