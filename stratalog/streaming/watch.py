"""Triggers over a stream of events: throttled rules, sessions, intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Events with a time that a watermark can be set on."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def read_events(spark: SparkSession, folder: str, like: DataFrame, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the columns of ``like``."""
    return timed(spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder))


def with_rules(events: DataFrame, rules: DataFrame, on: str) -> DataFrame:
    """Events that a rule is for (a small static table, broadcast), with its columns."""
    return events.join(F.broadcast(rules), on)


def throttled(events: DataFrame, rule: str, ident: str, hours: float) -> DataFrame:
    """(rule, id, ts) of the events that fire: a rule's first, then each at least ``hours`` after the last that fired.

    The state of a rule is one time, kept over restarts by the checkpoint. Events of one batch are taken in order of
    time; one older than the last that fired does not fire.
    """
    gap = int(hours * 3_600_000_000)
    keyed = events.filter(F.col(rule).isNotNull() & F.col("ts").isNotNull()).select(F.col(rule).cast("string").alias("rule"), F.col(ident).cast("long").alias("id"), F.unix_micros("ts").alias("us"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for us, i in sorted((us, i) for p in parts for us, i in zip(p["us"], p["id"], strict=True)):
            if last is None or us - last >= gap:
                last = int(us)
                out.append((key[0], i, us))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["rule", "id", "us"])

    fired = keyed.groupBy("rule").applyInPandasWithState(step, "rule string, id long, us long", "last long", "append", GroupStateTimeout.NoTimeout)
    return fired.select("rule", "id", F.timestamp_micros("us").alias("ts"))


def sessions(events: DataFrame, key: str, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a key, given out once the watermark has passed their end."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def intervals(events: DataFrame, key: str, size: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events to an interval, given out once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), "events")


def on_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, types: list[str] | None = None):
    """Give each micro-batch (of the named event types) to ``sink(df, batch id)``; the id lets a sink skip what it has."""
    wanted = stream.filter(F.col("event_type").isin(types)) if types else stream
    return wanted.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
