"""Queries on cutting files into chunks, and on the chunks there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.text import language, lines
from stratalog.operators import chunking as K
from stratalog.operators.file_states import resolved_entries
from stratalog.operators.history import entries_of
from stratalog.plans import Registry
from stratalog.plans.features import _C, _L, chunks
from stratalog.plans.history import _F
from stratalog.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts of all live text entries that count, patches applied along their bases."""
    e = resolved_entries(table(spark, folder, "snapshots"), table(spark, folder, "snapshot_files")).filter("content is not null")
    return e.select("snapshot_id", "path", language("path", "content").alias("lang"), "content")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that entries store whole; chunks are pieces of these."""
    e = entries_of(table(spark, folder, "snapshot_files")).filter("content is not null and marker <> 'deleted'")
    return e.select("snapshot_id", "path", "content")


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of documents, as files by their id."""
    return table(spark, folder, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("snapshot_id"), F.lit("text").alias("path"), F.col("text").alias("content"))


@query()
def c7_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of forty lines that share ten, of every file."""
    return K.fixed(files(spark, folder), 40, 10)


@query("with l as (select doc_id, string_split(text, chr(10)) l from documents where text is not null), b as (select doc_id, l, unnest(generate_series(0, greatest(len(l) - 1, 0), 30)) s from l) select doc_id, s::int start_line, (least(s + 40, len(l)) - 1)::int end_line, array_to_string(l[s + 1 : s + 40], chr(10)) content from b where s = 0 or s + 10 < len(l)")
def c7_fixed_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The same of every document."""
    return K.fixed(notes(spark, folder), 40, 10).select(F.col("snapshot_id").cast("long").alias("doc_id"), "start_line", "end_line", "content")


@query()
def c14_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of fifty lines, as where nothing is recognised, of every file."""
    return K.fixed(files(spark, folder), K.BLOCK_SEMANTIC, 0).drop("content")


@query("with l as (select doc_id, string_split(text, chr(10)) l from documents where text is not null) select doc_id, s::int start_line, (least(s + 50, len(l)) - 1)::int end_line from (select doc_id, l, unnest(generate_series(0, greatest(len(l) - 1, 0), 50)) s from l)")
def c14_blocks_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The same of every document."""
    return K.fixed(notes(spark, folder), K.BLOCK_SEMANTIC, 0).select(F.col("snapshot_id").cast("long").alias("doc_id"), "start_line", "end_line")


@query()
def c5_base(spark: SparkSession, folder: str) -> DataFrame:
    return K.chunked(files(spark, folder), "base", 60, 10)


@query()
def c11_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations, and what lies between them."""
    return K.chunked(files(spark, folder), "semanticComplete")


@query()
def c12_context_aware(spark: SparkSession, folder: str) -> DataFrame:
    return K.chunked(files(spark, folder), "context-aware")


@query()
def c13_hierarchical(spark: SparkSession, folder: str) -> DataFrame:
    return K.chunked(files(spark, folder), "hierarchical")


@query()
def c10_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Each file by the strategy that suits it."""
    return K.chunked(files(spark, folder))


@query(f"{_C} select snapshot_id, path, count(*) chunks, round(avg(end_line - start_line), 6) mean_span, count(distinct lang) langs, sum(len({_L}))::bigint lines from c group by all")
def c17_summary(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).groupBy("snapshot_id", "path").agg(F.count("*").alias("chunks"), F.round(F.avg(F.col("end_line") - F.col("start_line")), 6).alias("mean_span"), F.count_distinct("lang").alias("langs"), F.sum(F.size(lines("content")).cast("long")).alias("lines"))


@query(f"{_C} select chunk_id, path, start_line, end_line from c where lang in ('python', 'typescript') order by start_line desc nulls last, chunk_id limit 50 offset 50")
def c18_list(spark: SparkSession, folder: str) -> DataFrame:
    """The second page of fifty chunks; the limit is the feature."""
    c = chunks(spark, folder).filter(F.col("lang").isin("python", "typescript")).select("chunk_id", "path", "start_line", "end_line")
    return c.orderBy(F.col("start_line").desc_nulls_last(), "chunk_id").offset(50).limit(50)


@query(rf"""{_C}{_F} select c.chunk_id, array_to_string(string_split(replace(f.content, chr(13) || chr(10), chr(10)), chr(10))[greatest(c.start_line - 3, 0) + 1 : c.start_line], chr(10)) before, array_to_string(string_split(replace(f.content, chr(13) || chr(10), chr(10)), chr(10))[c.end_line + 2 : c.end_line + 4], chr(10)) after
from c join f on c.snapshot_id = f.snapshot_id and c.path = f.path and f.content is not null and f.marker <> 'deleted' where c.start_line >= 0 and c.end_line >= c.start_line""")
def c19_context(spark: SparkSession, folder: str) -> DataFrame:
    """Three lines on either side of each chunk in its file."""
    f = stored(spark, folder).select("snapshot_id", "path", F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n").alias("l"))
    c = chunks(spark, folder).filter("start_line >= 0 and end_line >= start_line").select("chunk_id", "snapshot_id", "path", "start_line", "end_line").join(f, ["snapshot_id", "path"])
    first = F.greatest(F.col("start_line") - 3, F.lit(0))
    return c.select("chunk_id", F.array_join(F.slice("l", first + 1, F.col("start_line") - first), "\n").alias("before"), F.array_join(F.slice("l", F.col("end_line") + 2, F.lit(3)), "\n").alias("after"))
