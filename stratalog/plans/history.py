"""Queries on snapshots and their entries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import patches
from stratalog.functions.text import binary_name, language
from stratalog.operators import history as H
from stratalog.operators.file_states import resolved_entries
from stratalog.plans import Registry
from stratalog.session import staged
from stratalog.sources.tables import clean_path, small, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_S = "with s as (select * exclude (d), row_number() over (partition by workspace order by ts nulls first, snapshot_id) seq from (select *, row_number() over (partition by snapshot_id order by received_at desc nulls last) d from snapshots) where d = 1)"
_F = r""", f as (select * exclude (d, path, np), np path, case when coalesce(deleted, false) then 'deleted' when coalesce(is_binary, false) then 'binary' when coalesce(length(diff), 0) > 0 then 'modified'
  when coalesce(length(content), 0) > 0 and base_snapshot_id is null then 'added' else 'same' end marker
  from (select *, row_number() over (partition by snapshot_id, np order by received_at desc nulls last) d from (select *, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') np from snapshot_files)) where d = 1)"""
_NOW = "(select max(ts) from snapshots)"


def cat(spark: SparkSession, folder: str) -> DataFrame:
    return H.catalogue(table(spark, folder, "snapshots"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return H.entries_of(table(spark, folder, "snapshot_files"))


def seen(df: DataFrame) -> DataFrame:
    """``df`` with ``as_of``, the time of the newest snapshot (one row, broadcast)."""
    return df.join(F.broadcast(df.agg(F.max("ts").alias("as_of"))))


@query(f"{_S} select snapshot_id, ts from s where list_has_any(tags, ['track', 'panel', 'inlet', 'auto']) and is_favorite = false and ts between timestamp '2024-02-01' and timestamp '2025-06-30'")
def h1_list_any_tag(spark: SparkSession, folder: str) -> DataFrame:
    found = H.listed(cat(spark, folder), any_tags=["track", "panel", "inlet", "auto"], favorite=False, since="2024-02-01 00:00:00", until="2025-06-30 00:00:00")
    return found.select("snapshot_id", "ts")


@query(f"{_S} select snapshot_id, ts from s order by ts, snapshot_id limit 25 offset 10")
def h1_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of the list; the limit is the feature."""
    return H.page(cat(spark, folder).select("snapshot_id", "ts"), list(H.ORDER), 10, 25)


@query(f"{_S} select snapshot_id, workspace from s where list_has_all(coalesce(tags, []), ['report']) and ts >= timestamp '2024-03-01'")
def h2_tree_filter(spark: SparkSession, folder: str) -> DataFrame:
    return H.listed(cat(spark, folder), all_tags=["report"], since="2024-03-01 00:00:00").select("snapshot_id", "workspace")


@query(rf"""{_S}{_F} select snapshot_id from s where case when coalesce(is_selective, false) and len(coalesce(selected_files, [])) > 0
  then len(list_filter(selected_files, lambda x: regexp_matches(regexp_replace(replace(x, '\', '/'), '^(\./)+', ''), '^src/(?:[^/]+/)*[^/]*\.py$'))) > 0
  else snapshot_id in (select snapshot_id from f where regexp_matches(path, '^src/(?:[^/]+/)*[^/]*\.py$')) end""")
def h3_file_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return H.listed(cat(spark, folder), pattern="src/**/*.py", entries=entries(spark, folder)).select("snapshot_id")


@query(f"{_S} select snapshot_id, coalesce(list_has_any(tags, ['auto', 'timed', 'scheduled', 'rule-based', 'time-triggered', 'save-triggered']), false) or coalesce(contains(lower(description), 'auto-snapshot'), false) automatic from s")
def h4_automatic(spark: SparkSession, folder: str) -> DataFrame:
    return cat(spark, folder).select("snapshot_id", H.automatic("tags", "description").alias("automatic"))


_BUCKET = f"""case when ts::date >= {_NOW}::date then 'Today' when ts::date >= {_NOW}::date - 1 then 'Yesterday' when ts::date >= {_NOW}::date - dayofweek({_NOW})::int then 'This Week'
  when ts::date >= {_NOW}::date - dayofweek({_NOW})::int - 7 then 'Last Week' else 'Older' end"""


@query(f"{_S} select snapshot_id, {_BUCKET} bucket from s")
def h5_date_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return seen(cat(spark, folder)).select("snapshot_id", H.date_bucket("ts", F.col("as_of")).alias("bucket"))


@query(f"""{_S}{_F}, c as (select snapshot_id, count(*) filter (marker = 'added') added, count(*) filter (marker = 'modified') modified, count(*) filter (marker = 'deleted') deleted from f group by 1)
select {_BUCKET} bucket, count(*) snapshots, coalesce(sum(added), 0)::bigint added, coalesce(sum(modified), 0)::bigint modified, coalesce(sum(deleted), 0)::bigint deleted from s left join c using (snapshot_id) group by 1""")
def h6_bucket_totals(spark: SparkSession, folder: str) -> DataFrame:
    both = seen(cat(spark, folder)).join(H.change_summary(entries(spark, folder)), "snapshot_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return both.groupBy(H.date_bucket("ts", F.col("as_of")).alias("bucket")).agg(F.count("*").alias("snapshots"), total("added"), total("modified"), total("deleted"))


@query(f"{_S} select snapshot_id, workspace, row_number() over (partition by workspace order by ts desc, snapshot_id desc) place from s")
def h7_newest_first(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("workspace").orderBy(F.col("ts").desc(), F.col("snapshot_id").desc())
    return cat(spark, folder).select("snapshot_id", "workspace", F.row_number().over(w).cast("long").alias("place"))


@query(f"{_S} select snapshot_id, workspace, description, git_branch from s where snapshot_id = (select min(snapshot_id) from snapshots)")
def h8_lookup(spark: SparkSession, folder: str) -> DataFrame:
    least = table(spark, folder, "snapshots").agg(F.min("snapshot_id").alias("snapshot_id"))
    return cat(spark, folder).join(F.broadcast(least), "snapshot_id").select("snapshot_id", "workspace", "description", "git_branch")


@query(f"{_S} select snapshot_id, lag(snapshot_id) over w previous_id, lead(snapshot_id) over w next_id from s window w as (partition by workspace order by ts, snapshot_id)")
def h9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return H.neighbours(cat(spark, folder))


@query(f"{_S} select tag, count(*) snapshots from (select unnest(tags) tag from s) group by 1")
def h10_tag_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return H.tag_histogram(cat(spark, folder))


@query(f"{_S} select snapshot_id, case when ts >= {_NOW} - interval 24 hour then '24h' when ts >= {_NOW} - interval 7 day then '7d' when ts >= {_NOW} - interval 30 day then '30d' else 'older' end preset from s")
def h11_presets(spark: SparkSession, folder: str) -> DataFrame:
    since = lambda n: F.col("ts") >= F.col("as_of") - F.expr(f"interval {n} hours")
    return seen(cat(spark, folder)).select("snapshot_id", F.when(since(24), "24h").when(since(168), "7d").when(since(720), "30d").otherwise("older").alias("preset"))


@query(f"{_S} select snapshot_id, ts, description, git_branch, git_commit, array_to_string(tags, ',') tags, notes, task_ref, is_favorite, is_selective, coalesce(len(selected_files), 0)::bigint selected from s")
def h14_summary(spark: SparkSession, folder: str) -> DataFrame:
    return cat(spark, folder).select("snapshot_id", "ts", "description", "git_branch", "git_commit", F.array_join("tags", ",").alias("tags"), "notes", "task_ref", "is_favorite", "is_selective", F.coalesce(F.array_size("selected_files"), F.lit(0)).cast("long").alias("selected"))


@query(f"{_S}{_F} select snapshot_id, case when n > 20 then 'high' when n > 5 then 'medium' when n > 0 then 'low' else 'none' end volume from (select snapshot_id, count(*) filter (marker in ('added', 'modified', 'deleted')) n from s left join f using (snapshot_id) group by 1)")
def h15_change_volume(spark: SparkSession, folder: str) -> DataFrame:
    both = cat(spark, folder).select("snapshot_id").join(H.change_summary(entries(spark, folder)), "snapshot_id", "left")
    n = sum((F.coalesce(c, F.lit(0)) for c in ("added", "modified", "deleted")), F.lit(0))
    return both.select("snapshot_id", H.volume(n).alias("volume"))


@query(f"""{_S}, a as (select snapshot_id, floor(epoch_us({_NOW}) / 1e6 - epoch_us(ts) / 1e6 + 0.5) x from s), m as (select *, floor(x / 60 + 0.5) y from a), h as (select *, floor(y / 60 + 0.5) z from m)
select snapshot_id, case when x < 60 then 'now' when y < 60 then y::bigint || 'm ago' when z < 24 then z::bigint || 'h ago' else floor(z / 24 + 0.5)::bigint || 'd ago' end ago from h""")
def h16_time_ago(spark: SparkSession, folder: str) -> DataFrame:
    return seen(cat(spark, folder)).select("snapshot_id", H.time_ago("ts", F.col("as_of")).alias("ago"))


@query(f"""{_S}{_F}, c as (select snapshot_id, count(*) filter (marker = 'added') a, count(*) filter (marker = 'modified') m, count(*) filter (marker = 'deleted') d from f group by 1)
select snapshot_id, '+' || coalesce(a, 0) || ' ~' || coalesce(m, 0) || ' -' || coalesce(d, 0) changes, case when length(notes) > 50 then substr(notes, 1, 47) || '...' else coalesce(notes, '') end preview,
  case when coalesce(task_ref, '') <> '' then '[' || task_ref || '] ' else '' end || coalesce(description, '') || case when len(coalesce(tags, [])) > 0 then ' | Tags: ' || array_to_string(tags, ', ') else '' end label
from s left join c using (snapshot_id)""")
def h17_pick_line(spark: SparkSession, folder: str) -> DataFrame:
    both = cat(spark, folder).join(H.change_summary(entries(spark, folder)), "snapshot_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    changes = F.concat(F.lit("+"), n("added"), F.lit(" ~"), n("modified"), F.lit(" -"), n("deleted"))
    preview = F.when(F.length("notes") > 50, F.concat(F.substring("notes", 1, 47), F.lit("..."))).otherwise(F.coalesce("notes", F.lit("")))
    task = F.when(F.coalesce("task_ref", F.lit("")) != "", F.concat(F.lit("["), F.col("task_ref"), F.lit("] "))).otherwise(F.lit(""))
    tags = F.when(F.coalesce(F.array_size("tags"), F.lit(0)) > 0, F.concat(F.lit(" | Tags: "), F.array_join("tags", ", "))).otherwise(F.lit(""))
    return both.select("snapshot_id", changes.alias("changes"), preview.alias("preview"), F.concat(task, F.coalesce("description", F.lit("")), tags).alias("label"))


@query(f"{_S} select workspace, count(*) snapshots, max(ts) last_ts from s group by 1")
def h18_workspace_info(spark: SparkSession, folder: str) -> DataFrame:
    return cat(spark, folder).groupBy("workspace").agg(F.count("*").alias("snapshots"), F.max("ts").alias("last_ts"))


_EXT = r"lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\.[^.]*)$', 1))"
_LANG = (
    f"case when {_EXT} in ('.js', '.jsx', '.mjs', '.cjs') then 'javascript' when {_EXT} in ('.ts', '.tsx') then 'typescript' when {_EXT} = '.py' then 'python' when {_EXT} = '.java' then 'java' when {_EXT} = '.go' then 'go' when {_EXT} = '.css' then 'css'"
    f" when {_EXT} = '.json' then 'json' when {_EXT} in ('.md', '.markdown') then 'markdown' when {_EXT} in ('.yaml', '.yml') then 'yaml' else 'text' end"
)


@query(f"{_S}{_F} select workspace, {_LANG} lang, count(*) files from f join (select * from s qualify row_number() over (partition by workspace order by ts desc, snapshot_id desc) = 1) using (snapshot_id) where marker <> 'deleted' group by all")
def h19_current_files(spark: SparkSession, folder: str) -> DataFrame:
    """Live files of each workspace's newest snapshot by language."""
    last = H.retained(cat(spark, folder), 1).select("snapshot_id", "workspace")
    return entries(spark, folder).filter("marker <> 'deleted'").select("snapshot_id", "path").join(small(last), "snapshot_id").groupBy("workspace", language("path").alias("lang")).agg(F.count("*").alias("files"))


@query(f"{_S}{_F} select snapshot_id, count(*) entries, count(*) filter (base_snapshot_id is not null and (base_snapshot_id, path) not in (select (snapshot_id, path) from f)) dangling from f join s using (snapshot_id) group by 1")
def h20_validate(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder).select("snapshot_id", "path", "base_snapshot_id").join(cat(spark, folder).select("snapshot_id"), "snapshot_id", "left_semi")
    held = own.select(F.col("snapshot_id").alias("base_snapshot_id"), "path", F.lit(True).alias("held"))
    both = own.join(held, ["base_snapshot_id", "path"], "left")
    return both.groupBy("snapshot_id").agg(F.count("*").alias("entries"), F.count_if(F.col("base_snapshot_id").isNotNull() & F.col("held").isNull()).alias("dangling"))


@query(f"{_S} select snapshot_id, case when is_favorite then 'kept: ' || coalesce(notes, '') else notes end notes, coalesce(task_ref, 'NONE') task_ref from s")
def h21_update_context(spark: SparkSession, folder: str) -> DataFrame:
    """A patch of notes and task: only what is given is changed."""
    c = cat(spark, folder)
    patch = c.filter("is_favorite").select("snapshot_id", F.concat(F.lit("kept: "), F.coalesce("notes", F.lit(""))).alias("new_notes"))
    return c.join(patch, "snapshot_id", "left").select("snapshot_id", F.coalesce("new_notes", "notes").alias("notes"), F.coalesce("task_ref", F.lit("NONE")).alias("task_ref"))


@query(f"{_S} select snapshot_id, row_number() over (partition by workspace order by ts, snapshot_id) seq from s where not coalesce(is_selective, false)")
def h22_delete(spark: SparkSession, folder: str) -> DataFrame:
    """The list after all selective snapshots were deleted: places are counted anew."""
    from pyspark.sql import Window

    left = cat(spark, folder).filter(~F.coalesce("is_selective", F.lit(False)))
    return left.select("snapshot_id", F.row_number().over(Window.partitionBy("workspace").orderBy(*H.ORDER)).cast("long").alias("seq"))


@query(f"""{_S}{_F}, k as (select snapshot_id from s qualify row_number() over (partition by workspace order by ts desc, snapshot_id desc) <= 5)
select snapshot_id, path, base_snapshot_id from f join k using (snapshot_id) where base_snapshot_id is not null and (base_snapshot_id, path) not in (select (f.snapshot_id, path) from f join k using (snapshot_id))""")
def h23_retention(spark: SparkSession, folder: str) -> DataFrame:
    """What would dangle if each workspace kept its newest five."""
    return H.dangling(entries(spark, folder), H.retained(cat(spark, folder), 5))


@query(f"{_F[2:].join(['with ', ''])} select snapshot_id, count(*) filter (marker = 'added') added, count(*) filter (marker = 'modified') modified, count(*) filter (marker = 'deleted') deleted from f group by 1")
def d9_change_summary(spark: SparkSession, folder: str) -> DataFrame:
    return H.change_summary(entries(spark, folder))


@query(f"{_F[2:].join(['with ', ''])} select snapshot_id, marker, count(*) files, min(path) first_path, max(path) last_path from f where marker <> 'same' group by all")
def d10_change_lists(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).filter("marker <> 'same'").groupBy("snapshot_id", "marker").agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


@query(f"""{_S}{_F}, o as (select f.*, workspace, seq, coalesce(deleted, false) gone from f join s using (snapshot_id))
select a.snapshot_id, a.path, case when a.gone and coalesce(b.gone, false) then 'unchanged' when a.gone then 'deleted' when a.marker = 'modified' then 'modified' when coalesce(not b.gone, false) then 'unchanged' else 'added' end change
from o a left join o b on a.workspace = b.workspace and a.path = b.path and a.seq = b.seq + 1""")
def d12_tree_changes(spark: SparkSession, folder: str) -> DataFrame:
    return H.tree_changes(cat(spark, folder), entries(spark, folder))


@query(f"""{_S}{_F}, o as (select f.*, workspace, seq, coalesce(deleted, false) gone from f join s using (snapshot_id))
select a.snapshot_id, a.path, upper(substr(a.marker, 1, 1)) mark from o a left join o b on a.workspace = b.workspace and a.path = b.path and a.seq = b.seq + 1
where a.marker in ('added', 'modified') or (a.marker = 'deleted' and not coalesce(b.gone, false))""")
def d12b_changed_files(spark: SparkSession, folder: str) -> DataFrame:
    places = cat(spark, folder).select("snapshot_id", "workspace", "seq")
    own = entries(spark, folder).select("snapshot_id", "path", "marker", F.coalesce("deleted", F.lit(False)).alias("gone")).join(places, "snapshot_id")
    before = own.filter("gone").select("workspace", "path", (F.col("seq") + 1).alias("seq"), F.lit(True).alias("was_gone"))
    both = own.filter("marker in ('added', 'modified', 'deleted')").join(before, ["workspace", "path", "seq"], "left")
    return both.filter((F.col("marker") != "deleted") | F.col("was_gone").isNull()).select("snapshot_id", "path", F.upper(F.substring("marker", 1, 1)).alias("mark"))


_Q = "with v as (select (year(o_orderdate) * 4 + quarter(o_orderdate))::int q, o_custkey k, max(o_orderstatus) v from orders group by all)"


def _quarters(spark: SparkSession, folder: str) -> DataFrame:
    """One state of each customer to a quarter: the last order status."""
    return table(spark, folder, "orders").groupBy((F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).alias("q"), F.col("o_custkey").alias("k")).agg(F.max("o_orderstatus").alias("v"))


@query(f"""{_Q}, b as (select q + 1 q, k, v from v where q < (select max(q) from v)), c as (select * from v where q > (select min(q) from v))
select coalesce(c.q, b.q) q, case when b.q is null then 'A' when c.q is null then 'D' when b.v = c.v then 'U' else 'M' end change, count(*) n from c full join b on c.q = b.q and c.k = b.k group by all""")
def d1_capture(spark: SparkSession, folder: str) -> DataFrame:
    """Each quarter's state captured against the one before."""
    v = _quarters(spark, folder)
    ends = F.broadcast(v.agg(F.min("q").alias("lo"), F.max("q").alias("hi")))
    now = v.join(ends).filter("q > lo").select("q", "k", "v")
    before = v.join(ends).filter("q < hi").select((F.col("q") + 1).alias("q"), "k", "v")
    return H.classify(now, before, ["q", "k"], "v").groupBy("q", "change").agg(F.count("*").alias("n"))


@query(f"{_Q}, c as (select * from v where q = (select max(q) from v)), b as (select * from v where q = (select min(q) from v)) select coalesce(c.k, b.k) k, case when b.q is null then 'A' when c.q is null then 'D' when b.v = c.v then 'U' else 'M' end change from c full join b on c.k = b.k")
def d11_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The last quarter against the first."""
    v = _quarters(spark, folder)
    ends = F.broadcast(v.agg(F.min("q").alias("lo"), F.max("q").alias("hi")))
    both = v.join(ends)
    return H.classify(both.filter("q = hi").select("k", "v"), both.filter("q = lo").select("k", "v"), ["k"], "v")


@query(f"""{_Q}, c as (select * from v where q = (select max(q) from v)), b as (select * from v where q = (select max(q) - 3 from v))
select coalesce(c.k, b.k) k, case when b.q is null then 'delete' when c.q is null then 'write' else 'overwrite' end action, b.v content from c full join b on c.k = b.k where b.v is distinct from c.v""")
def d13_restore_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What brings the newest state back to the one three quarters before."""
    v = _quarters(spark, folder)
    both = v.join(F.broadcast(v.agg(F.max("q").alias("hi"))))
    target, now = both.filter("q = hi - 3").select("k", F.col("v").alias("content")), both.filter("q = hi").select("k", "v")
    plan = H.classify(target.withColumnRenamed("content", "v"), now, ["k"], "v").filter("change <> 'U'").join(target, "k", "left")
    return plan.select("k", F.when(F.col("change") == "D", "delete").when(F.col("change") == "A", "write").otherwise("overwrite").alias("action"), "content")


@query(f"{_S} select workspace, coalesce(git_branch, '') branch, count(*) snapshots, count(distinct git_commit) commits from s group by all")
def d19_git_branches(spark: SparkSession, folder: str) -> DataFrame:
    return cat(spark, folder).groupBy("workspace", F.coalesce("git_branch", F.lit("")).alias("branch")).agg(F.count("*").alias("snapshots"), F.count_distinct("git_commit").alias("commits"))


@query(f"""{_F[2:].join(['with ', ''])} select snapshot_id, path, (len(regexp_extract_all(chr(10) || diff, '\\n\\+(?:[^+\\n]|$)')))::bigint plus, (len(regexp_extract_all(chr(10) || diff, '\\n-(?:[^-\\n]|$)')))::bigint minus from f where length(diff) > 0""".replace("\\\\", "\\"))
def d18_patch_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that a patch adds and takes away."""
    own = entries(spark, folder).filter(F.length("diff") > 0)
    n = lambda p: F.regexp_count(F.concat(F.lit("\n"), F.col("diff")), F.lit(p)).cast("long")
    return own.select("snapshot_id", "path", n(r"\n\+(?:[^+\n]|$)").alias("plus"), n(r"\n-(?:[^-\n]|$)").alias("minus"))


@query(f"""{_F[2:].join(['with recursive ', ''])}, c as (select snapshot_id, path, base_snapshot_id b, 0 steps, (coalesce(length(diff), 0) > 0)::int patches, content is not null whole from f where marker not in ('deleted', 'binary')
  union all select c.snapshot_id, c.path, f.base_snapshot_id, steps + 1, patches + (coalesce(length(f.diff), 0) > 0)::int, f.content is not null from c join f on f.snapshot_id = c.b and f.path = c.path where not c.whole and f.marker not in ('deleted', 'binary'))
select snapshot_id, path, max(steps)::bigint steps, max(patches)::bigint patches from c group by all""")
def d5_base_chains(spark: SparkSession, folder: str) -> DataFrame:
    """How many entries back the whole text of each entry lies, and how many patches on the way. Pointers are doubled,
    so a chain of n takes log n rounds."""
    own = entries(spark, folder).filter("marker not in ('deleted', 'binary')")
    now = staged(own.select("snapshot_id", "path", F.when(F.col("content").isNull(), F.col("base_snapshot_id")).alias("at"), F.lit(0).cast("long").alias("steps"), (F.coalesce(F.length("diff"), F.lit(0)) > 0).cast("long").alias("patches")))
    for _ in range(40):  # chains of up to 2**40; a ring of bases ends here too
        target = now.select(F.col("snapshot_id").alias("at"), "path", F.col("at").alias("further"), F.col("steps").alias("more_steps"), F.col("patches").alias("more_patches"), F.lit(1).cast("long").alias("found"))
        both = now.join(target, ["at", "path"], "left")
        add = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        # an entry whose base is missing keeps its place: nothing more is known of it
        stepped = both.select("snapshot_id", "path", F.col("further").alias("at"), (F.col("steps") + F.coalesce("more_steps", F.lit(0)) + F.coalesce("found", F.lit(0))).alias("steps"), add("patches"))
        now = staged(stepped)
        if not now.filter("at is not null").limit(1).count():
            break
    return now.select("snapshot_id", "path", "steps", "patches")


@query(rf"""{_F[2:].join(['with ', ''])} select distinct path, {_EXT} in ('.png', '.ico', '.zip', '.woff2', '.woff', '.ttf', '.jpg', '.gif', '.jar', '.pdf', '.db', '.bin', '.dat', '.exe', '.class')
  or (regexp_matches(lower(path), '/(dist|build|bin|node_modules)/') and {_EXT} not in ('.js', '.css', '.html', '.json', '.txt', '.md', '.map')) is_binary from f""")
def src7_binary_names(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select("path", binary_name("path").alias("is_binary")).distinct()


@query(rf"""with p as (select distinct regexp_replace(replace(path, '\', '/'), '^(\./)+', '') path from snapshot_files) select path, {_LANG} lang from p""")
def c2_languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "snapshot_files").select(clean_path("path").alias("path")).distinct().select("path", language("path").alias("lang"))


@query()
def d7_whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each live text entry with the digest and size of its whole text, patches applied along its bases."""
    e = resolved_entries(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))
    return e.select("snapshot_id", "path", F.md5("content").alias("digest"), F.length("content").cast("long").alias("chars"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(s, p, *r) for s, p, d in zip(*[batch.column(c).to_pylist() for c in ("snapshot_id", "path", "diff")], strict=True) for r in patches.ranges(d.replace("\r\n", "\n"))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["snapshot_id", "path", "kind", "first_line", "last_line"])


@query()
def d17_line_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of lines that each patch adds or modifies."""
    e = entries(spark, folder).filter(F.length("diff") > 0).select("snapshot_id", "path", "diff")
    return e.mapInArrow(_ranges, "snapshot_id string, path string, kind string, first_line long, last_line long")
