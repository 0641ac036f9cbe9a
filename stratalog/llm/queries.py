"""Queries over the test tables for the operators of this subpackage, and the SQL that some must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.credentials import find_credentials, redacted
from stratalog.llm.entries import counting, owners, texts
from stratalog.llm.foreign_files import foreign_files
from stratalog.llm.mixing import draw, shares
from stratalog.llm.near_duplicates import copy_pairs, expand_pairs, long_enough, members, near_duplicates, near_pairs, text_key
from stratalog.llm.packing import fill_report, pack
from stratalog.llm.residue import residue
from stratalog.llm.splitting import oversized, split_oversized
from stratalog.llm.top_items import top_items
from stratalog.operators.file_states import resolved_entries
from stratalog.session import dropped, staged
from stratalog.sources.tables import clean_path, newest, small, table


#: What makes two pieces of code the same but for edits: three words, a similarity of 0.6, 30 words.
_EDITED = {"words": 3, "threshold": 0.6, "min_words": 30}


def _units(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(unit, content) of chunks and of full texts in files, and the members of those texts: chunks, and the entries
    that count. Which delivery counts is settled on keys alone; a text that only an earlier one had has no member."""
    chunks = table(spark, folder, "code_chunks").filter("chunk_id is not null").select(F.lit("chunk").alias("unit"), F.col("chunk_id").alias("id"), "content")
    files = table(spark, folder, "snapshot_files")
    whole = texts(files).withColumn("unit", F.lit("file"))
    entries = whole.select("snapshot_id", "path", "delivery", F.lit("file").alias("group"), F.concat("snapshot_id", F.lit("|"), "path").alias("id"), text_key("unit", "content").alias("k"), long_enough("content", _EDITED["min_words"]).alias("comparable"))
    entries = entries.join(counting(files).filter("has_text"), ["snapshot_id", "path", "delivery"], "left_semi").select("group", "id", "k", "comparable")
    return chunks.select("unit", "content").unionByName(whole.select("unit", "content")), members(chunks, "id", "unit", "content", _EDITED["min_words"]).unionByName(entries)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks, and of full texts of files, that are largely the same or copies of one text."""
    docs, member = _units(spark, folder)
    member = staged(member.distinct())
    pairs = near_pairs(docs, "unit", "content", **_EDITED)
    found = staged(pairs)
    dropped(pairs)  # the sets sent to leaders
    edited = expand_pairs(found, member)
    return edited.unionByName(copy_pairs(member)).withColumnRenamed("group", "unit")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each chunk and file, and its links."""
    docs, member = _units(spark, folder)
    return near_duplicates(docs, member, "unit", "content", **_EDITED).withColumnRenamed("group", "unit")


def _best_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = table(spark, folder, "search_results").select("hit_id", "query_id", clean_path("file_path").alias("file_path"), "score", "received_at")
    caps = table(spark, folder, "search_queries").select("query_id", F.coalesce("max_results_per_file", F.lit(3)).alias("cap")).groupBy("query_id").agg(F.max("cap").alias("cap"))
    capped = newest(hits, ["hit_id"]).join(small(caps), "query_id", "left").withColumn("cap", F.coalesce("cap", F.lit(3)))
    return top_items(capped, ["query_id", "file_path"], "score", "hit_id", "cap")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Of each query and file the best hits, at most as many as the query asks for."""
    return _best_hits(spark, folder).select("query_id", "file_path", "hit_id")


_P3 = r"""
with h as (select hit_id, query_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') file_path, score,
             row_number() over (partition by hit_id order by received_at desc nulls last) d from search_results),
     q as (select query_id, max(coalesce(max_results_per_file, 3)) cap from search_queries group by query_id),
     r as (select h.*, coalesce(cap, 3) cap, row_number() over (partition by h.query_id, file_path order by score desc, hit_id) n
           from h left join q on h.query_id = q.query_id where d = 1 and score is not null and not isnan(score))
select query_id, file_path, hit_id from r where n <= cap"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a workspace that were not written by hand."""
    found = foreign_files(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))
    return found.select(F.col("owner").alias("workspace"), "path")


def p4_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many files of each kind there are."""
    found = foreign_files(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))
    return found.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("files"))


def p4_handwritten_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the files that remain."""
    snapshots = table(spark, folder, "snapshots")
    found = foreign_files(snapshots, table(spark, folder, "snapshot_files")).select("owner", F.col("path").alias("file_path"))
    chunks = table(spark, folder, "code_chunks").select("chunk_id", "snapshot_id", clean_path("file_path").alias("file_path")).distinct()
    return chunks.join(small(owners(snapshots)), "snapshot_id").join(found, ["owner", "file_path"], "left_anti").select("chunk_id", "snapshot_id", "file_path")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the texts of entries that count which hold a live credential."""
    return find_credentials(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files")).select("snapshot_id", "path", "line_no").distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that hold credentials, masked."""
    return redacted(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the limits of their language: those the splitter cuts."""
    return split_oversized(table(spark, folder, "code_chunks"), table(spark, folder, "chunk_limits")).select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces, with line numbers put right by the files the chunks come from."""
    chunks, limits, snapshots = table(spark, folder, "code_chunks"), table(spark, folder, "chunk_limits"), table(spark, folder, "snapshots")
    # only the files of chunks to be cut are resolved, by path in their workspace, as their bases may lie in any snapshot
    wanted = oversized(chunks, limits).select("snapshot_id", clean_path("file_path").alias("path")).distinct()
    whose = small(owners(snapshots).withColumn("owner", F.coalesce("owner", F.lit(""))))
    wanted = small(wanted.join(whose, "snapshot_id").select("owner", F.col("path").alias("wanted")).distinct())
    files = table(spark, folder, "snapshot_files")
    files = files.join(whose, "snapshot_id").withColumn("wanted", clean_path("path")).join(wanted, ["owner", "wanted"], "left_semi").drop("owner", "wanted")
    return split_oversized(chunks, limits, resolved_entries(snapshots, files))


_P6 = r"""
with c as (select distinct chunk_id, content, lower(trim(metadata.lang)) lang from code_chunks where content is not null),
     l as (select lower(lang) lang, max_lines, max_chars from chunk_limits)
select distinct chunk_id from c left join l on c.lang = l.lang and l.lang <> '*' cross join (select max_lines al, max_chars ac from l where lang = '*')
where length(content) > coalesce(max_chars, ac)
   or length(content) - length(replace(content, chr(10), '')) + case when content like '%' || chr(10) then 0 else 1 end > coalesce(max_lines, al)"""


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, for each spec."""
    return pack(table(spark, folder, "documents"), table(spark, folder, "pack_specs"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and fill of each spec."""
    specs = table(spark, folder, "pack_specs")
    return fill_report(pack(table(spark, folder, "documents"), specs), specs)


def p8_draws(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that each mix draws, and how often."""
    return draw(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each source in its mix, wanted and reached."""
    targets = table(spark, folder, "mix_targets")
    return shares(draw(table(spark, folder, "documents"), targets), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold unfilled blanks, filler, or an error or script notice."""
    return residue(table(spark, folder, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents hold each kind of residue."""
    return residue(table(spark, folder, "documents")).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("documents"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_kinds": p4_kinds, "p4_handwritten_chunks": p4_handwritten_chunks, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_draws": p8_draws, "p8_shares": p8_shares, "p9_found": p9_found, "p9_kinds": p9_kinds}
SQL = {"p3_found": _P3, "p6_found": _P6}
