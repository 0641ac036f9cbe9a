"""Queries on the event stream as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import triggers as T
from stratalog.plans import Registry
from stratalog.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""with recursive o as (select event_type, event_id, ts, row_number() over (partition by event_type order by ts, event_id) n from events), f as (select event_type, event_id, ts, n, ts last, true fires from o where n = 1
  union all select o.event_type, o.event_id, o.ts, o.n, case when o.ts - f.last >= interval 6 hour then o.ts else f.last end, o.ts - f.last >= interval 6 hour from o join f on o.event_type = f.event_type and o.n = f.n + 1) select event_type as "rule", event_id, ts from f where fires""")
def st1_throttled(spark: SparkSession, folder: str) -> DataFrame:
    """Each type of event fires at most every six hours."""
    return T.throttled(table(spark, folder, "events"), "event_type", "ts", "event_id", 6)


@query("""with r as (select user_id, ts, sum((g is null or g > interval 15 minute)::int) over (partition by user_id order by ts rows unbounded preceding) run from (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) g from events))
select user_id, min(ts) started, max(ts) ended, count(*) events from r group by user_id, run""")
def st2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return T.sessions(table(spark, folder, "events"), ["user_id"], "ts", 15)


@query("""with b as (select user_id, ts, event_type = 'purchase' s from events where event_type in ('purchase', 'click')), e as (select *, sum(s::int) over (partition by user_id order by ts, s desc) e from b),
  f as (select user_id, e, min(ts) filter (not s) since from e group by all), n as (select user_id, e - 1 e, min(ts) taken from e where s group by all)
select user_id, since, since + interval 15 minute due from f left join n using (user_id, e) where since is not null and (taken is null or taken > since + interval 15 minute)""")
def st3_reminders(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks as saves, purchases as snapshots: where a reminder is due."""
    e = table(spark, folder, "events")
    return T.reminders(e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), "user_id", "ts", 15)


@query("select event_type, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') started, count(*) events from events group by all")
def st4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return T.per_interval(table(spark, folder, "events"), ["event_type"], "ts", 6)


@query("select user_id, event_type, count(*) events, round(sum(value), 6) total from events where event_type in ('click', 'error') group by all")
def st5_watched(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the types that a client watches."""
    return table(spark, folder, "events").filter(F.col("event_type").isin("click", "error")).groupBy("user_id", "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
