"""Filters, groups, navigation, summaries and retention over the list of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.text import col, js_round, named_when, path_matches
from stratalog.sources.tables import clean_path, newest

#: Tags and wording of snapshots that were taken automatically.
AUTO_TAGS, AUTO_WORDING = ("auto", "timed", "scheduled", "rule-based", "time-triggered", "save-triggered"), "auto-snapshot"
BUCKETS = ("Today", "Yesterday", "This Week", "Last Week", "Older")
ORDER = ("ts", "snapshot_id")


def catalogue(snapshots: DataFrame) -> DataFrame:
    """Of each snapshot the delivery that counts, with ``seq``, its place in its workspace from 1."""
    one = newest(snapshots, ["snapshot_id"])
    return one.withColumn("seq", F.row_number().over(Window.partitionBy("workspace").orderBy(*ORDER)))


def listed(cat: DataFrame, any_tags: list[str] | None = None, all_tags: list[str] | None = None, since=None, until=None, favorite: bool | None = None, pattern: str | None = None, entries: DataFrame | None = None) -> DataFrame:
    """Snapshots with any (or all) of the tags, taken between two times (both included; None is open), favorites or
    not (None: either), and, with ``pattern``, one of whose files matches: the selected files of a selective snapshot,
    else those of ``entries`` (snapshot_id, path), gone or not."""
    if any_tags:
        cat = cat.filter(F.arrays_overlap("tags", F.lit(any_tags)))
    if all_tags:
        cat = cat.filter(F.size(F.array_except(F.lit(all_tags), F.coalesce("tags", F.array().cast("array<string>")))) == 0)
    if since is not None:
        cat = cat.filter(F.col("ts") >= F.lit(since))
    if until is not None:
        cat = cat.filter(F.col("ts") <= F.lit(until))
    if favorite is not None:
        cat = cat.filter(F.col("is_favorite") == favorite)
    if pattern:
        chosen = F.coalesce("is_selective", F.lit(False)) & (F.size(F.coalesce("selected_files", F.array().cast("array<string>"))) > 0)
        own = cat.filter(chosen).filter(F.exists("selected_files", lambda x: path_matches(clean_path(x), pattern, substring=True)))
        named = entries.filter(path_matches("path", pattern, substring=True)).select("snapshot_id").distinct()
        cat = own.unionByName(cat.filter(~chosen).join(named, "snapshot_id", "left_semi"))
    return cat


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    """A slice of an ordered list; a limit of 0 is none."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def automatic(tags: Column | str, description: Column | str) -> Column:
    return F.coalesce(F.arrays_overlap(col(tags), F.lit(list(AUTO_TAGS))), F.lit(False)) | F.coalesce(F.contains(F.lower(col(description)), F.lit(AUTO_WORDING)), F.lit(False))


def date_bucket(ts: Column | str, as_of: Column) -> Column:
    """Today, Yesterday, This Week (from Sunday), Last Week or Older, seen from ``as_of``."""
    today = F.to_date(as_of)
    sunday = F.date_sub(today, F.dayofweek(as_of) - 1)
    day = F.to_date(col(ts))
    return named_when(((BUCKETS[0], day >= today), (BUCKETS[1], day >= F.date_sub(today, 1)), (BUCKETS[2], day >= sunday), (BUCKETS[3], day >= F.date_sub(sunday, 7))), BUCKETS[4])


def time_ago(ts: Column | str, as_of: Column) -> Column:
    """now, Nm ago, Nh ago, Nd ago; each unit is rounded from the one before."""
    seconds = js_round((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(ts).cast("timestamp"))) / 1e6)
    minutes = js_round(seconds / 60)
    hours = js_round(minutes / 60)
    days = js_round(hours / 24)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "now").when(minutes < 60, text(minutes, "m")).when(hours < 24, text(hours, "h")).otherwise(text(days, "d"))


def volume(changes: Column) -> Column:
    """high, medium, low, none by the number of changes."""
    return named_when((("high", changes > 20), ("medium", changes > 5), ("low", changes > 0)), "none")


def neighbours(cat: DataFrame) -> DataFrame:
    """(snapshot_id, previous_id, next_id) in the workspace."""
    w = Window.partitionBy("workspace").orderBy(*ORDER)
    return cat.select("snapshot_id", F.lag("snapshot_id").over(w).alias("previous_id"), F.lead("snapshot_id").over(w).alias("next_id"))


def tag_histogram(cat: DataFrame) -> DataFrame:
    return cat.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("snapshots"))


def entries_of(files: DataFrame) -> DataFrame:
    """Of each entry the delivery that counts, paths in one spelling, with ``marker``: deleted, binary, modified (a
    patch), added (a text that rests on nothing), same."""
    cleaned = files.withColumn("path", clean_path("path"))
    one = newest(cleaned, ["snapshot_id", "path"])
    flag = lambda c: F.coalesce(c, F.lit(False))
    marker = named_when((("deleted", flag("deleted")), ("binary", flag("is_binary")), ("modified", F.coalesce(F.length("diff"), F.lit(0)) > 0), ("added", (F.coalesce(F.length("content"), F.lit(0)) > 0) & F.col("base_snapshot_id").isNull())), "same")
    return one.withColumn("marker", marker)


def change_summary(entries: DataFrame) -> DataFrame:
    """(snapshot_id, added, modified, deleted) by the markers of the entries."""
    return entries.groupBy("snapshot_id").agg(*[F.count_if(F.col("marker") == m).alias(m) for m in ("added", "modified", "deleted")])


def tree_changes(cat: DataFrame, entries: DataFrame) -> DataFrame:
    """(snapshot_id, path, change) against the snapshot before it in the workspace: deleted unless it was deleted there,
    modified by a patch, added if it was not there alive, else unchanged."""
    places = cat.select("snapshot_id", "workspace", "seq")
    own = entries.select("snapshot_id", "path", "marker", F.coalesce("deleted", F.lit(False)).alias("gone")).join(places, "snapshot_id")
    before = own.select("workspace", "path", (F.col("seq") + 1).alias("seq"), F.col("gone").alias("was_gone"))
    both = own.join(before, ["workspace", "path", "seq"], "left")
    live_before = F.coalesce(~F.col("was_gone"), F.lit(False))
    change = named_when((("unchanged", F.col("gone") & F.coalesce("was_gone", F.lit(False))), ("deleted", F.col("gone")), ("modified", F.col("marker") == "modified"), ("added", ~live_before)), "unchanged")
    return both.select("snapshot_id", "path", change.alias("change"))


def retained(cat: DataFrame, most: int = 50) -> DataFrame:
    """The newest ``most`` snapshots of each workspace."""
    w = Window.partitionBy("workspace").orderBy(F.col("ts").desc(), F.col("snapshot_id").desc())
    return cat.withColumn("__age", F.row_number().over(w)).filter(F.col("__age") <= most).drop("__age")


def dangling(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries of ``kept`` snapshots that rest on a snapshot which is not kept, or has no such entry."""
    own = entries.filter("base_snapshot_id is not null").join(kept.select("snapshot_id"), "snapshot_id", "left_semi").select("snapshot_id", "path", "base_snapshot_id")
    held = entries.join(kept.select("snapshot_id"), "snapshot_id", "left_semi").select(F.col("snapshot_id").alias("base_snapshot_id"), "path")
    return own.join(held, ["base_snapshot_id", "path"], "left_anti").select("snapshot_id", "path", "base_snapshot_id")


def snapshot_id(ts: Column | str, workspace: Column | str) -> Column:
    """The id of a new snapshot: its time in milliseconds and eight hex digits, the same for the same time and workspace."""
    mark = F.substring(F.lower(F.hex(F.xxhash64(col(ts), col(workspace)))), 1, 8)
    return F.concat(F.lit("snapshot-"), F.unix_millis(col(ts).cast("timestamp")).cast("string"), F.lit("-"), F.lpad(mark, 8, "0"))


def classify(current: DataFrame, base: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Capture or comparison of two states: keys.., change (A added, D deleted, M changed, U same), by a full outer
    join; nulls are values."""
    a, b = current.select(*keys, F.col(value).alias("__now"), F.lit(True).alias("__a")), base.select(*keys, F.col(value).alias("__before"), F.lit(True).alias("__b"))
    change = named_when((("A", F.col("__b").isNull()), ("D", F.col("__a").isNull()), ("U", F.col("__now").eqNullSafe(F.col("__before")))), "M")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))
