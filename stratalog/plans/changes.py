"""Queries on what changed between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators.file_states import file_states, ordered_snapshots, resolved_entries
from stratalog.operators.history import classify
from stratalog.operators.merkle_diff import merkle_changes
from stratalog.sources.tables import table


def snapshot_changes(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(workspace, ord, path, change_kind) of each file that a snapshot added, removed or changed.

    A full snapshot without an entry for a path removes it; a selective one looks at ``selected_files`` only. Binary
    files that stay are not changed; a file that turns from text into binary or back is. See ``file_states`` for texts.
    """
    states = file_states(snapshots, files).withColumnRenamed("first_ord", "ord")
    return merkle_changes(states, ["workspace"], "ord", "path", "digest", "last_ord", end="end_ord")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    snapshots = table(spark, folder, "snapshots")
    ids = ordered_snapshots(snapshots).select("workspace", "ord", "snapshot_id")
    changes = snapshot_changes(snapshots, table(spark, folder, "snapshot_files"))
    return changes.join(ids, ["workspace", "ord"]).select("snapshot_id", "path", "change_kind")


def p2_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each snapshot added, removed and changed."""
    return p2_found(spark, folder).groupBy("snapshot_id").agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")])


def p2_presence(spark: SparkSession, folder: str) -> DataFrame:
    """Which files each snapshot added or removed; what SQL can tell without applying patches."""
    return p2_found(spark, folder).filter("change_kind <> 'changed'")


_PRESENCE = r"""
with s as (select snapshot_id, workspace, coalesce(is_selective, false) sel, list_transform(selected_files, lambda x: regexp_replace(replace(x, '\', '/'), '^(\./)+', '')) chosen, row_number() over (partition by workspace order by ts nulls first, snapshot_id) ord
             from (select *, row_number() over (partition by snapshot_id order by received_at desc nulls last) d from snapshots) where d = 1),
     f as (select snapshot_id, path, not coalesce(deleted, false) live from (select *, row_number() over (partition by snapshot_id, path order by received_at desc nulls last) d
             from (select * replace (regexp_replace(replace(path, '\', '/'), '^(\./)+', '') as path) from snapshot_files)) where d = 1),
     p as (select distinct workspace, path from f join s using (snapshot_id)),
     g as (select s.workspace, s.snapshot_id, s.ord, p.path, case when not sel or list_contains(chosen, p.path) then coalesce(live, false) end seen
             from s join p on s.workspace is not distinct from p.workspace left join f on f.snapshot_id = s.snapshot_id and f.path = p.path),
     t as (select *, coalesce(last_value(seen ignore nulls) over (partition by workspace, path order by ord), false) now from g),
     c as (select *, lag(now) over (partition by workspace, path order by ord) was from t)
select snapshot_id, path, case when now then 'added' else 'removed' end change_kind from c where ord > 1 and now <> was"""


def d1_files(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each snapshot found added (A), deleted (D), changed (M) and the same (U), captured against the state before it."""
    states = file_states(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))
    now = states.filter("first_ord > 1").select("workspace", F.col("first_ord").alias("ord"), "path", "digest")
    before = states.filter("end_ord <= last_ord").select("workspace", F.col("end_ord").alias("ord"), "path", "digest")
    return classify(now, before, ["workspace", "ord", "path"], "digest").groupBy("workspace", "ord", "change").agg(F.count("*").alias("files"))


def _ends(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(first, newest) state of every workspace: workspace, path, digest."""
    states = file_states(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))
    return states.filter("first_ord = 1").select("workspace", "path", "digest"), states.filter("end_ord = last_ord + 1").select("workspace", "path", "digest")


def d11_files(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every workspace compared with its first."""
    first, newest = _ends(spark, folder)
    return classify(newest, first, ["workspace", "path"], "digest")


def d13_files(spark: SparkSession, folder: str) -> DataFrame:
    """What brings every workspace back from its newest state to its first."""
    first, newest = _ends(spark, folder)
    plan = classify(first, newest, ["workspace", "path"], "digest").filter("change <> 'U'")
    return plan.select("workspace", "path", F.when(F.col("change") == "D", "delete").when(F.col("change") == "A", "write").otherwise("overwrite").alias("action"))


def d7_unknown_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Live text entries whose text can't be had: a base is missing or a patch does not fit. Between two of these no
    change is seen."""
    e = resolved_entries(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))
    return e.filter("content is null").select("snapshot_id", "path")


QUERIES = {"p2_found": p2_found, "p2_change_counts": p2_change_counts, "p2_presence": p2_presence, "d1_files": d1_files, "d11_files": d11_files, "d13_files": d13_files, "d7_unknown_texts": d7_unknown_texts}
SQL = {"p2_presence": _PRESENCE}
