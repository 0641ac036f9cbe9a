"""Queries on edges between chunks, and checks of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import code as C
from stratalog.functions.code import semantic_type
from stratalog.operators import graph as G
from stratalog.operators import links as K
from stratalog.operators import validation as V
from stratalog.operators.chunking import chunked
from stratalog.plans import Registry
from stratalog.plans.features import SQL as FEATURES
from stratalog.plans.features import _C, _L, chunks
from stratalog.plans.pieces import files

query = Registry()
QUERIES, SQL = query.queries, query.sql

_N = f"{_C}, n as (select distinct snapshot_id, chunk_id, unnest(symbols) name from c), names as (select * from n where name is not null and name <> '')"


def _join(used: str, strength: str) -> str:
    return f"select u.chunk_id src, d.chunk_id dst, {strength} strength from ({used}) u join names d on u.snapshot_id = d.snapshot_id and u.name = d.name and u.chunk_id <> d.chunk_id group by all"


_CALLS = _join(r"select snapshot_id, chunk_id, unnest(regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\s*\(', 1)) name from c", "least(1.0::double, count(*) * 0.2::double)")
_EXTENDS = _join(r"select snapshot_id, chunk_id, unnest(list_concat(regexp_extract_all(content, '(?:extends|implements)\s+([A-Za-z_][0-9A-Za-z_]*)', 1), regexp_extract_all(content, 'class\s+[0-9A-Za-z_]+\(([A-Za-z_][0-9A-Za-z_]*)\)', 1))) name from c", "0.9::double")


@query(f"{_N} select src, dst, round(strength, 6) strength from ({_CALLS})")
def g1_calls(spark: SparkSession, folder: str) -> DataFrame:
    return G.call_edges(chunks(spark, folder)).select("src", "dst", F.round("strength", 6).alias("strength"))


_IMPORTS = r"""select u.chunk_id src, d.chunk_id dst from (select distinct snapshot_id, chunk_id, unnest(regexp_extract_all(x, '([0-9A-Za-z_-]{3,})', 1)) name from (select snapshot_id, chunk_id, unnest(imports) x from c)) u
  join (select snapshot_id, chunk_id, regexp_extract(path, '([^/.]{3,})[^/]*$', 1) name from c) d on u.snapshot_id = d.snapshot_id and u.name = d.name and u.name <> '' and u.chunk_id <> d.chunk_id"""


@query(f"{_C} select distinct src, dst from ({_IMPORTS})")
def g2_imports(spark: SparkSession, folder: str) -> DataFrame:
    return G.import_edges(chunks(spark, folder)).select("src", "dst")


@query(f"{_N} select src, dst, strength from ({_EXTENDS})")
def g3_extends(spark: SparkSession, folder: str) -> DataFrame:
    return G.inherit_edges(chunks(spark, folder)).select("src", "dst", "strength")


@query()
def g4_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Names used but not called; SQL without look-ahead can't say it."""
    return G.use_edges(chunks(spark, folder)).select("src", "dst", F.round("strength", 6).alias("strength"))


@query(rf"""{_N} select distinct u.chunk_id src, d.chunk_id dst from (select snapshot_id, chunk_id, unnest(regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\b', 1)) name from c where regexp_matches(lower(path), 'test|spec')) u
  join (select names.* from names join c using (snapshot_id, chunk_id) where not regexp_matches(lower(path), 'test|spec')) d on u.snapshot_id = d.snapshot_id and u.name = d.name and u.chunk_id <> d.chunk_id""")
def g5_tests(spark: SparkSession, folder: str) -> DataFrame:
    return G.test_edges(chunks(spark, folder)).select("src", "dst")


@query()
def g13_similar(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder).withColumn("kind", semantic_type("content", "lang"))
    return G.similar_edges(c)


@query(f"{_C} select src, dst from (select chunk_id src, lead(chunk_id) over (partition by snapshot_id, path order by start_line, chunk_id) dst from c where start_line is not null) where dst is not null")
def g8_next_in_file(spark: SparkSession, folder: str) -> DataFrame:
    return G.file_neighbours(chunks(spark, folder))


_ALL = f"(select src, dst, 'calls' rel, strength from ({_CALLS}) union all select src, dst, 'extends' rel, strength from ({_EXTENDS}))"


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    c = chunks(spark, folder)
    return G.call_edges(c).unionByName(G.inherit_edges(c))


@query(f"{_N} select rel, count(*) edges, round(avg(strength), 6) mean_strength, count(distinct src) sources, count(distinct dst) targets from {_ALL} group by 1")
def g15_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return G.statistics(_edges(spark, folder))


@query(f"{_N}, e as {_ALL} select node, sum(o)::bigint outgoing, sum(i)::bigint incoming from (select src node, 1 o, 0 i from e union all select dst, 0, 1 from e) group by 1")
def g16_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(_edges(spark, folder))


@query(f"{_N} select src, rel, dst, round(strength, 6) strength from {_ALL} qualify row_number() over (partition by src order by strength desc, rel, dst) = 1")
def g17_strongest(spark: SparkSession, folder: str) -> DataFrame:
    return G.strongest(_edges(spark, folder)).withColumn("strength", F.round("strength", 6))


@query(f"{_N}, e as (select distinct src, dst from {_ALL}), b as (select distinct a.src, b.dst from e a join e b on a.dst = b.src where a.src <> b.dst), t as (select distinct b.src, e.dst from b join e on b.dst = e.src where b.src <> e.dst), u as (select *, 1 hops from e union all select *, 2 from b union all select *, 3 from t) select src, dst, min(hops) hops from u group by all")
def g17_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Dependencies in at most three steps."""
    return G.reach(_edges(spark, folder))


_NLINES = f"len({_L}) - case when content like '%' || chr(10) then 1 else 0 end"
_VAL = rf"""{_C}, v as (select chunk_id, list_filter([case when trim(chunk_id) = '' then 'MISSING_ID' end, case when coalesce(trim(path), '') = '' then 'MISSING_FILE_PATH' end, case when coalesce(trim(snapshot_id), '') = '' then 'MISSING_SNAPSHOT_ID' end, case when trim(content) = '' then 'EMPTY_CONTENT' end, case when start_line < 0 then 'INVALID_START_LINE' end, case when end_line < start_line then 'INVALID_LINE_RANGE' end], lambda x: x is not null) e,
  list_filter([case when start_line is null or end_line is null then 'MISSING_LINES' end, case when end_line - start_line + 1 <> {_NLINES} then 'LINE_COUNT_DIFFERS' end, case when coalesce(trim(lang), '') = '' then 'MISSING_LANGUAGE' end, case when coalesce(len(symbols), 0) = 0 then 'NO_SYMBOLS' end, case when ratio < 0 or ratio > 1 then 'COMMENT_RATIO_OUT_OF_RANGE' end,
    case when len(list_filter({_L}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') = '')) * 2 > len({_L}) then 'MOSTLY_BLANK' end], lambda x: x is not null) w from c)"""


@query(f"{_VAL} select chunk_id, array_to_string(e, '|') errors, array_to_string(w, '|') warnings, greatest(0, 100 - len(e) * 10 - len(w) * 2)::bigint score from v")
def val1_validated(spark: SparkSession, folder: str) -> DataFrame:
    return V.validated(chunks(spark, folder))


@query(f"{_VAL} select code, count(*) chunks from (select unnest(list_concat(e, w)) code from v) group by 1 order by 2 desc, 1 limit 5")
def val2_frequent_codes(spark: SparkSession, folder: str) -> DataFrame:
    """The five codes found most often; the limit is the feature."""
    return V.frequent(V.validated(chunks(spark, folder)))


# The second analyser: what the texts themselves define, and paths that imports resolve to.
_STEM = r"regexp_replace({}, '\.[A-Za-z0-9]+$', '')"
_RESOLVED = r"""case when regexp_matches(i, '^\.\.?/') then regexp_replace(array_to_string(list_concat(d[1:greatest(len(d) - length(regexp_extract(i, '^((?:\.\./)*)', 1)) // 3, 0)], [regexp_replace(i, '^(?:\./|(?:\.\./)+)', '')]), '/'), '\.[A-Za-z0-9]+$', '')
  when coalesce(lang = 'python', false) and not contains(i, '/') then replace(i, '.', '/') else regexp_replace(i, '\.[A-Za-z0-9]+$', '') end"""
_IMPORTED = rf"""select distinct u.chunk_id src, f.chunk_id dst from (select snapshot_id, chunk_id, {_RESOLVED} t from (select snapshot_id, chunk_id, lang, list_filter(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), lambda x: x <> '') d, unnest(imports) i from c) where i <> '') u
  join (select snapshot_id, chunk_id, {_STEM.format('path')} f from c) f on u.snapshot_id = f.snapshot_id and u.chunk_id <> f.chunk_id and regexp_extract(u.t, '([^/]*)$', 1) <> '' and (u.t = f.f or ends_with(u.t, '/' || f.f) or ends_with(f.f, '/' || u.t))"""
_NAMED = "select distinct u.chunk_id src, d.chunk_id dst from ({}) u join ({}) d on u.snapshot_id = d.snapshot_id and u.name = d.name and u.chunk_id <> d.chunk_id"
_CALLED = _NAMED.format(r"select distinct snapshot_id, chunk_id, unnest(regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\s*\(', 1)) name from c", r"select distinct snapshot_id, chunk_id, unnest(list_concat(coalesce(symbols, []), regexp_extract_all(content, '(?:function|def)\s+([A-Za-z_][0-9A-Za-z_]*)', 1))) name from c")
_USES = _NAMED.format(r"select distinct snapshot_id, chunk_id, unnest(list_concat(regexp_extract_all(content, '\bnew\s+([A-Za-z_][0-9A-Za-z_]*)', 1), regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\.', 1))) name from c", r"select distinct snapshot_id, chunk_id, unnest(list_concat(coalesce(symbols, []), regexp_extract_all(content, 'class\s+([A-Za-z_][0-9A-Za-z_]*)', 1))) name from c")
_KIND = f"({FEATURES['f24_semantic_type']})"
_PARENTS = _NAMED.format(r"select distinct snapshot_id, chunk_id, unnest(list_concat(regexp_extract_all(content, '\bextends\s+([A-Za-z_][0-9A-Za-z_]*)', 1), regexp_extract_all(content, '\bclass\s+[0-9A-Za-z_]+\(([A-Za-z_][0-9A-Za-z_]*)\)', 1))) name from c", rf"select distinct snapshot_id, chunk_id, unnest(list_concat(coalesce(symbols, []), regexp_extract_all(content, 'class\s+([A-Za-z_][0-9A-Za-z_]*)', 1))) name from c join {_KIND} using (chunk_id) where kind = 'class'")
_FACES = _NAMED.format(r"select distinct snapshot_id, chunk_id, unnest(regexp_extract_all(content, '\bimplements\s+([A-Za-z_][0-9A-Za-z_]*)', 1)) name from c", rf"select distinct snapshot_id, chunk_id, unnest(list_concat(coalesce(symbols, []), regexp_extract_all(content, 'interface\s+([A-Za-z_][0-9A-Za-z_]*)', 1))) name from c join {_KIND} using (chunk_id) where kind = 'interface'")


@query(f"{_C} select src, dst, 0.8::double strength, 0.9::double confidence from ({_IMPORTED})")
def g9_resolved_imports(spark: SparkSession, folder: str) -> DataFrame:
    return K.imported(chunks(spark, folder)).drop("rel")


@query(f"{_C} select src, dst, 0.7::double strength, 0.7::double confidence from ({_CALLED})")
def g10_defined_calls(spark: SparkSession, folder: str) -> DataFrame:
    return K.called(chunks(spark, folder)).drop("rel")


@query(f"{_C} select src, dst, 'extends' rel from ({_PARENTS}) union all select src, dst, 'implements' from ({_FACES})")
def g11_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Empty where no chunk extends another; see the tests for rows."""
    return K.inherited(chunks(spark, folder).withColumn("kind", semantic_type("content", "lang"))).select("src", "dst", "rel")


@query(f"{_C} select src, dst, 0.5::double strength, 0.6::double confidence from ({_USES})")
def g12_used_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return K.instantiated(chunks(spark, folder)).drop("rel")


@query(f"{_C}, e as (select 'imports' rel, 0.9::double c from ({_IMPORTED}) union all select 'calls', 0.7 from ({_CALLED}) union all select 'extends', 0.85 from ({_PARENTS}) union all select 'implements', 0.8 from ({_FACES}) union all select 'uses', 0.6 from ({_USES})) select rel, count(*) edges, round(avg(c), 6) confidence from e where c >= 0.65 group by 1")
def g14_confident(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of some confidence, by kind."""
    found = K.linked(chunks(spark, folder).withColumn("kind", semantic_type("content", "lang")), 0.65)
    return found.groupBy("rel").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(rf"""{_C}, n as (select snapshot_id, path, chunk_id, start_line, list_filter(symbols, lambda x: x <> '')[1] name, coalesce(imports, []) imports, content, regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\b', 1) words, regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\s*\(', 1) made, regexp_extract_all(content, '(?:extends|implements) ([A-Za-z_][0-9A-Za-z_]*)', 1) parents from c where start_line is not null),
  p as (select a.chunk_id src, b.chunk_id dst, b.name, a.imports, a.parents, list_contains(a.words, b.name)::int referred, len(list_filter(a.made, lambda x: x = b.name)) calls, len(list_intersect(list_distinct(a.imports), list_distinct(b.imports))) common, abs(a.start_line - b.start_line) far
    from n a join n b on a.snapshot_id = b.snapshot_id and a.path = b.path and a.chunk_id <> b.chunk_id and a.name <> b.name),
  w as (select *, round(least(1.0, referred * 0.5::double + common * 0.1::double + greatest(0, 100 - far) / 100 * 0.2::double + least(0.4::double, calls * 0.1::double)), 9) strength from p)
select src, dst, case when calls > 0 then 'calls' when len(list_filter(imports, lambda x: contains(x, name))) > 0 then 'imports' when list_contains(parents, name) then 'extends' else 'uses' end rel, strength from w where strength > 0.1""")
def g7_file_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Dependencies between the chunks of one file, weighed."""
    return K.file_graph(chunks(spark, folder))


@query()
def g6_nesting(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between declarations and those that hold them, in every file."""
    return K.nested(chunked(files(spark, folder), "hierarchical"))


@query("with " + ", ".join(f"x{i} as ({FEATURES[n]})" for i, n in enumerate(("f4_complexity", "f10_maintainability", "f23_context_concerns", "f16_slow_code"))) + """, c as (select distinct chunk_id, start_line, end_line, content from code_chunks where content is not null),
  v as (select c.chunk_id, list_filter([case when length(content) > 10000 then 'LARGE_CHUNK' end, case when end_line - start_line > 500 then 'LARGE_LINE_RANGE' end, case when complexity > 80 then 'HIGH_COMPLEXITY' end, case when maintainability < 20 then 'LOW_MAINTAINABILITY' end, case when x2.risk > 70 then 'HIGH_SECURITY_RISK' end, case when x3.risk > 70 then 'HIGH_PERFORMANCE_RISK' end], lambda x: x is not null) w
    from c join x0 using (chunk_id) join x1 using (chunk_id) join x2 using (chunk_id) join x3 using (chunk_id))
select chunk_id, '' errors, array_to_string(w, '|') warnings, greatest(0, 100 - len(w) * 2)::bigint score from v""")
def val1_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of what is measured of each chunk; what is computed here has no errors, only warnings."""
    c = chunks(spark, folder)
    risks = {"documentation": C.documentation_ratio("content"), "security_risk": F.least(F.lit(100), F.size(C.context_concerns("content", "lang")) * 25), "performance_risk": C.slow_risk("content", "lang")}
    return V.validated_measures(C.enriched(c).withColumns(risks))


@query(f"{_N} select src, dst, '' errors, '' warnings, 100::bigint score from ({_CALLS})")
def val1_edges(spark: SparkSession, folder: str) -> DataFrame:
    return V.validated_edges(G.call_edges(chunks(spark, folder)))
