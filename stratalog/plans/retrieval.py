"""Queries on vectors and search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalog.functions import code as C
from stratalog.functions.text import lines
from stratalog.operators import ranking as R
from stratalog.operators import vector_index as I
from stratalog.operators.vector_search import cosine_top_k, two_rounds
from stratalog.plans import Registry
from stratalog.plans.asked import _INTENT, asked
from stratalog.session import staged
from stratalog.sources.tables import clean_path, newest, small, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_P = "with p as (select a.vec_id q, b.vec_id, b.label, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a join embeddings b on a.vec_id % 100 = 0)"
_K = f"{_P}, k as (select *, row_number() over (partition by q order by s desc, vec_id) place from p)"


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def _nearest(spark: SparkSession, folder: str, k: int) -> DataFrame:
    v = _vectors(spark, folder)
    return cosine_top_k(v, v.filter("vec_id % 100 = 0"), k)


@query(f"{_K} select q query, vec_id, round(s, 6) score, place from k where place <= 10")
def v2_cosine_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return _nearest(spark, folder, 10).select("query", "vec_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query("with p as (select a.vec_id q, b.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from embeddings a join embeddings b on a.vec_id % 100 = 0 where b.label in (1, 3, 5)), k as (select *, row_number() over (partition by q order by s desc, vec_id) place from p) select q query, vec_id, round(s, 6) score from k where place <= 20 and s >= 0.15")
def v1_v3_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Among some labels, with a least score: the filter is pushed to the scan."""
    v = _vectors(spark, folder)
    return cosine_top_k(v.filter(F.col("label").isin(1, 3, 5)), v.filter("vec_id % 100 = 0"), 20, 0.15).select("query", "vec_id", F.round("score", 6).alias("score"))


@query(f"""{_K}, c as (select * from k where place <= 60), f as (select *, row_number() over (partition by q, label order by s desc, vec_id) n from c), g as (select *, case when n = 1 then row_number() over (partition by q, n = 1 order by s desc, vec_id) end m from f),
  o as (select *, row_number() over (partition by q order by coalesce(n = 1 and m <= 5, false) desc, s desc, vec_id) x from g) select q query, vec_id, label, row_number() over (partition by q order by s desc, vec_id) place from o where x <= 10""")
def v4_two_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Ten of the sixty nearest, spread over labels."""
    near = _nearest(spark, folder, 60).drop("place").join(small(_vectors(spark, folder).select("vec_id", "label")), "vec_id")
    return two_rounds(near, ["query"], ["label"], "score", ["vec_id"], 10).select("query", "vec_id", "label", F.col("place").cast("long").alias("place"))


_H = r"""with h as (select * exclude (d, file_path), regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') file_path from (select *, row_number() over (partition by hit_id order by received_at desc nulls last) d from search_results) where d = 1 and score is not null and not isnan(score))"""


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with a score, by the delivery that counts."""
    h = newest(table(spark, folder, "search_results"), ["hit_id"]).withColumn("file_path", clean_path("file_path"))
    return h.filter(F.col("score").isNotNull() & ~F.isnan("score"))


@query(f"""{_H}, f as (select *, row_number() over (partition by query_id, snapshot_id, file_path order by score desc, hit_id) n from h), g as (select *, case when n = 1 then row_number() over (partition by query_id, n = 1 order by score desc, hit_id) end m from f where n <= 3),
  o as (select *, row_number() over (partition by query_id order by coalesce(n = 1 and m <= 10, false) desc, score desc, hit_id) x from g) select query_id, hit_id, row_number() over (partition by query_id order by score desc, hit_id) place from o where x <= 20""")
def v5_search(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty hits to a query: ten files first, then the best, three of a file."""
    return two_rounds(hits(spark, folder).select("query_id", "snapshot_id", "file_path", "hit_id", "score"), ["query_id"], ["snapshot_id", "file_path"], "score", ["hit_id"], 20, 3).select("query_id", "hit_id", F.col("place").cast("long").alias("place"))


@query(f"{_H} select query_id, hit_id, row_number() over (partition by query_id order by floor(round(score / 0.05, 6)) desc, hit_ts desc nulls last, score desc, hit_id) place from h")
def v6_newer_among_equals(spark: SparkSession, folder: str) -> DataFrame:
    """Hits in steps of 0.05, the newer first within a step."""
    w = Window.partitionBy("query_id").orderBy(F.floor(F.round(F.col("score") / 0.05, 6)).desc(), F.col("hit_ts").desc_nulls_last(), F.col("score").desc(), "hit_id")
    return hits(spark, folder).select("query_id", "hit_id", F.row_number().over(w).cast("long").alias("place"))


_RANK = (
    f"""{_H}, a as (select query_id, min(coalesce(original_query, '')) q from search_queries group by 1), i as (select query_id, {_INTENT} intent from a), now as (select max(hit_ts) t from search_results),
  e as (select h.query_id, hit_id, score, file_path, coalesce(content, '') content, coalesce(intent, 'find_implementation') intent, hit_ts,"""
    r""" len(regexp_extract_all(coalesce(content, ''), '\b(if|for|while|case|catch|&&|\|\||switch)\b')) + 1 cc, len(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) n,"""
    r""" len(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '^(//|#|/\*|\*)'))) m,
    case when hit_ts is null then 0.1 when (epoch_us(t) - epoch_us(hit_ts)) / 86400e6 <= 7 then 1.0 when (epoch_us(t) - epoch_us(hit_ts)) / 86400e6 <= 30 then 0.9 when (epoch_us(t) - epoch_us(hit_ts)) / 86400e6 <= 90 then 0.7 when (epoch_us(t) - epoch_us(hit_ts)) / 86400e6 <= 180 then 0.5 when (epoch_us(t) - epoch_us(hit_ts)) / 86400e6 <= 365 then 0.3 else 0.1 end::double rec
    from h cross join now left join i using (query_id)),
  s as (select *, (case when n = 0 then 0 else m / n end)::double doc, case intent when 'find_examples' then 3 when 'debug_issue' then 8 when 'find_patterns' then 6 when 'analyze_quality' then 10 else 5 end ideal from e),
  c as (select *, (0.7 + doc + 0.7 + 0.8) / 4 qual, greatest(0.0, 1 - abs(cc - ideal) / ideal)::double fit from s),"""
    """ w as (select *, greatest(0.0::double, least(1.0::double, case case intent when 'analyze_quality' then 'quality' when 'find_examples' then 'usage' when 'debug_issue' then 'recency' else 'relevance' end
    when 'quality' then score * 0.3::double + qual * 0.5::double + rec * 0.03::double + 0.05::double + fit * 0.02::double + doc * 0.1::double when 'usage' then score * 0.3::double + qual * 0.2::double + rec * 0.1::double + 0.35::double + fit * 0.03::double + doc * 0.02::double
    when 'recency' then score * 0.35::double + qual * 0.15::double + rec * 0.4::double + 0.05::double + fit * 0.03::double + doc * 0.02::double else score * 0.6::double + qual * 0.2::double + rec * 0.05::double + 0.1::double + fit * 0.03::double + doc * 0.02::double end)) comp from c)"""
)


def _composite(spark: SparkSession, folder: str) -> DataFrame:
    h = hits(spark, folder)
    now = F.broadcast(table(spark, folder, "search_results").agg(F.max("hit_ts").alias("as_of")))
    intents = asked(spark, folder).groupBy("query_id").agg(F.min(F.struct("q", "intent")).alias("x")).select("query_id", F.col("x.intent").alias("intent"))
    e = h.select("query_id", "hit_id", "score", "file_path", "hit_ts", F.coalesce("content", F.lit("")).alias("content")).join(now).join(small(intents), "query_id", "left").withColumn("intent", F.coalesce("intent", F.lit("find_implementation")))
    e = e.withColumns({"rec": R.recency("hit_ts", F.col("as_of")), "doc": C.documentation_ratio("content"), "fit": R.complexity_fit(C.hits(F.col("content"), C.BRANCHES) + 1, "intent")})
    e = e.withColumn("qual", R.quality(F.lit(0.7), F.col("doc"), F.lit(0.3), F.lit(0.2)))
    strategy = F.when(F.col("intent") == "analyze_quality", "quality").when(F.col("intent") == "find_examples", "usage").when(F.col("intent") == "debug_issue", "recency").otherwise("relevance")
    scores = {"relevance": F.col("score"), "quality": F.col("qual"), "recency": F.col("rec"), "usage": F.lit(1.0), "complexity": F.col("fit"), "documentation": F.col("doc")}
    return e.withColumn("comp", R.composite(strategy, scores))


@query(f"{_RANK} select query_id, hit_id, round(comp, 6) composite, round(qual, 6) quality, rec recency, round(fit, 6) fit from w")
def v13_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Each hit by six criteria, weighed by the intent of its query."""
    return _composite(spark, folder).select("query_id", "hit_id", F.round("comp", 6).alias("composite"), F.round("qual", 6).alias("quality"), F.col("rec").alias("recency"), F.round("fit", 6).alias("fit"))


_ADJ = (
    f"{_RANK}, j as (select *, greatest(0.0::double, least(1.0::double, comp * case intent when 'find_examples' then (case when contains(file_path, 'test') or contains(content, 'test') or contains(content, 'spec') then 1.04::double else 1 end) * (case when doc < 0.2 then 0.56::double else 1 end)"
    " when 'debug_issue' then case when contains(content, 'try') or contains(content, 'catch') or contains(content, 'error') then 1.26::double else 1 end else 1 end)) adj from w)"
)


def _adjusted(spark: SparkSession, folder: str) -> DataFrame:
    return _composite(spark, folder).withColumn("adj", R.adjusted(F.col("comp"), "intent", "file_path", "content", F.lit(0.7), F.col("doc")))


@query(f"{_ADJ} select query_id, hit_id, round(adj, 6) adjusted from j")
def v17_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return _adjusted(spark, folder).select("query_id", "hit_id", F.round("adj", 6).alias("adjusted"))


_NORM = f"{_ADJ}, x as (select *, min(adj) over (partition by query_id) lo, max(adj) over (partition by query_id) hi from j), y as (select *, case when hi > lo then (adj - lo) / (hi - lo) else adj end norm from x)"


@query(f"{_NORM} select query_id, hit_id, round(norm, 6) score from y where round(norm, 9) >= 0.1")
def v18_normalised(spark: SparkSession, folder: str) -> DataFrame:
    n = R.normalised(_adjusted(spark, folder).select("query_id", "hit_id", "adj"), ["query_id"], "adj")
    return n.select("query_id", "hit_id", F.round("adj", 6).alias("score"))


@query()
def v19_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty hits to a query, spread over files, functions, patterns and layers."""
    h = hits(spark, folder).withColumn("content", F.coalesce("content", F.lit("")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id"))
    name = F.regexp_extract("content", r"(?:function|class|const|let|var)\s+([0-9A-Za-z_]+)", 1)
    own = h.select("query_id", "hit_id", place.alias("place"), "file_path", F.concat("file_path", F.lit("#"), F.when(name == "", F.col("hit_id").cast("string")).otherwise(name)).alias("function"), C.layer("file_path").alias("layer"), C.design_patterns("content").alias("patterns"))
    return R.greedy(own)


@query(f"""{_H}, g as (select *, year(hit_ts) * 4 + quarter(hit_ts) q from h), n as (select query_id, count(*) a, count(distinct q) + max((q is null)::int) b from g group by 1), r as (select g.*, a // b m, row_number() over (partition by query_id, q order by score desc, hit_id) x from g join n using (query_id)) select query_id, hit_id from r where x <= greatest(1, m)""")
def v20_temporal(spark: SparkSession, folder: str) -> DataFrame:
    """Hits spread over quarters."""
    return R.temporal(hits(spark, folder).select("query_id", "hit_id", "score", "hit_ts"), ["query_id"], "hit_ts", [F.col("score").desc(), "hit_id"]).select("query_id", "hit_id")


@query(f"{_H} select query_id, count(*) hits, count(distinct file_path) files, round(avg(score), 6) mean, round((count(distinct file_path) / count(*) + least(1, count(distinct snapshot_id) / 5)) / 2, 6) diversity from h group by 1")
def v21_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return hits(spark, folder).groupBy("query_id").agg(F.count("*").alias("hits"), F.count_distinct("file_path").alias("files"), F.round(F.avg("score"), 6).alias("mean"), F.round((F.count_distinct("file_path") / F.count("*") + F.least(F.lit(1.0), F.count_distinct("snapshot_id") / 5)) / 2, 6).alias("diversity"))


@query(f"""{_H} select hit_id, case when score >= 0.8 then 'Excellent match' when score >= 0.6 then 'Good match' when score >= 0.3 then 'Moderate match' else 'Weak match' end || ' in ' || file_path || coalesce(' (lines ' || (start_line + 1) || '-' || (end_line + 1) || ')', '') explanation from h""")
def v22_explained(spark: SparkSession, folder: str) -> DataFrame:
    where = F.concat(F.lit(" (lines "), (F.col("start_line") + 1).cast("string"), F.lit("-"), (F.col("end_line") + 1).cast("string"), F.lit(")"))
    return hits(spark, folder).select("hit_id", F.concat(R.explained(F.col("score")), F.lit(" in "), "file_path", F.coalesce(where, F.lit(""))).alias("explanation"))


@query(rf"""{_H} select hit_id, array_to_string(list_filter([case when length(coalesce(content, '')) > 120 and len(string_split(coalesce(content, ''), chr(10))) < 3 then 'split long lines' end, case when not contains(lower(coalesce(content, '')), 'test') then 'add tests' end,
  case when not regexp_matches(coalesce(content, ''), '(?m)^\s*(//|#|/\*|\*)') then 'add comments' end], lambda x: x is not null), '|') suggestions from h""")
def v23_suggestions(spark: SparkSession, folder: str) -> DataFrame:
    c = F.coalesce("content", F.lit(""))
    found = F.array_compact(F.array(F.when((F.length(c) > 120) & (F.size(lines(c)) < 3), "split long lines"), F.when(~F.contains(F.lower(c), F.lit("test")), "add tests"), F.when(~c.rlike(r"(?m)^\s*(//|#|/\*|\*)"), "add comments")))
    return hits(spark, folder).select("hit_id", F.array_join(found, "|").alias("suggestions"))


_TYPE = "case when contains(coalesce(content, ''), 'class ') then 'class' when contains(coalesce(content, ''), 'function ') or contains(coalesce(content, ''), '=>') or contains(coalesce(content, ''), 'def ') then 'function' else 'module' end"
_LONG = "len(list_filter(string_split(coalesce(content, ''), chr(10)), lambda x: length(x) > 120))"


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with the type, complexity and readability of their text."""
    c = F.coalesce("content", F.lit(""))
    kind = F.when(F.contains(c, F.lit("class ")), "class").when(F.contains(c, F.lit("function ")) | F.contains(c, F.lit("=>")) | F.contains(c, F.lit("def ")), "function").otherwise("module")
    long = F.size(F.filter(lines(c), lambda x: F.length(x) > 120))
    return hits(spark, folder).select("query_id", "hit_id", "snapshot_id", "file_path", "score", "hit_ts", kind.alias("kind"), C.node_complexity(c).alias("cyclomatic"), F.greatest(F.lit(0.0), F.lit(1.0) - long * 0.05).alias("readability"))


@query(rf"""{_H}, j as (select *, {_TYPE} kind, len(regexp_extract_all(coalesce(content, ''), '\b(if|for|while|case|catch|&&|\|\||switch)\b')) + 1 cc, greatest(0.0, 1.0 - {_LONG} * 0.05::double) readable from h)
select query_id, hit_id, kind from j where score >= 0.6 and readable >= 0.9 and cc between 1 and 4 and kind in ('function', 'class') and starts_with(file_path, 'src/') and not contains(lower(file_path), 'test') and hit_ts >= timestamp '2024-03-01'""")
def v11_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Hits by quality, complexity, type, path and time."""
    found = R.selected(_judged(spark, folder), 0.6, 0.9, (1, 4), ["function", "class"], include=["src/**"], since="2024-03-01 00:00:00")
    return found.filter(~F.contains(F.lower("file_path"), F.lit("test"))).select("query_id", "hit_id", "kind")


@query(rf"""with top as ({SQL["v5_search"]}), r as (select hit_id, query_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') file_path, score, content, row_number() over (partition by hit_id order by received_at desc nulls last) d from search_results),
  t as (select top.query_id, top.hit_id, place, file_path, score, {_TYPE} kind, greatest(0.0, 1.0 - {_LONG} * 0.05::double) readable from top join r on r.hit_id = top.hit_id and d = 1),
  p as (select a.query_id, a.hit_id, b.hit_id other, b.place, a.file_path <> b.file_path other_files, a.kind <> b.kind other_type, b.readable - a.readable better, round(case when a.file_path = b.file_path then 0.45::double when regexp_replace(a.file_path, '/?[^/]*$', '') = regexp_replace(b.file_path, '/?[^/]*$', '') then 0.15::double else 0 end
    + case when a.kind = b.kind then 0.3::double else 0 end + greatest(0.0::double, 0.3::double - abs(a.score - b.score)) * 1.5::double, 6) similarity from t a join t b on a.query_id is not distinct from b.query_id and a.query_id is not null and a.hit_id <> b.hit_id),
  k as (select *, row_number() over (partition by query_id, hit_id order by place) n from p where similarity > 0.6 and similarity < 0.9)
select query_id, hit_id, other, similarity, other_files, other_type, case when better > 0.1 then 'quality' when better < -0.1 then 'simplicity' else 'another approach' end prefer from k where n <= 3""")
def v24_alternatives(spark: SparkSession, folder: str) -> DataFrame:
    """Other hits among the twenty of a query that do alike in another way, three to a hit."""
    judged = _judged(spark, folder)
    top = two_rounds(judged, ["query_id"], ["snapshot_id", "file_path"], "score", ["hit_id"], 20, 3)
    return R.alternatives(top, ["query_id"])


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    centres = I.fit(v)
    return I.search(staged(I.indexed(v, centres)), centres, v.filter("vec_id % 100 = 0"), 10, I.probes_for(v, centres, 10))


@query()
def v2_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest by an index that holds every vector and looks into as many lists as the vectors need."""
    return _indexed(spark, folder).select("query", "vec_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query()
def v2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What the index finds of the exact answers."""
    return I.recall(_indexed(spark, folder), _nearest(spark, folder, 10))


_HIT_PATTERNS = "list_filter([" + ", ".join(f"case when contains(coalesce(content, ''), '{a}') or contains(coalesce(content, ''), '{b}') then '{n}' end" for n, a, b in (("Singleton", "getInstance", "singleton"), ("Factory", "factory", "create"), ("Observer", "observer", "subscribe"), ("Strategy", "strategy", "algorithm"), ("Decorator", "decorator", "wrapper"))) + "], lambda x: x is not null)"
_LAYER = "case when contains(lower(file_path), 'controller') or contains(lower(file_path), 'api') or contains(lower(file_path), 'route') then 'presentation' when contains(lower(file_path), 'service') or contains(lower(file_path), 'business') or contains(lower(file_path), 'logic') then 'business' when contains(lower(file_path), 'repository') or contains(lower(file_path), 'dao') or contains(lower(file_path), 'database') then 'data' when contains(lower(file_path), 'model') or contains(lower(file_path), 'entity') then 'domain' when contains(lower(file_path), 'util') or contains(lower(file_path), 'helper') then 'utility' when contains(lower(file_path), 'config') or contains(lower(file_path), 'setting') then 'configuration' else 'unknown' end"


@query(f"""{_H}, p as (select query_id, count(distinct x) n from (select query_id, unnest({_HIT_PATTERNS}) x from h) group by 1)
select h.query_id, round((count(distinct file_path) / count(*) + least(1.0, coalesce(max(p.n), 0) / 5) + least(1.0, count(distinct {_LAYER}) / 3)) / 3, 6)::double diversity from h left join p on h.query_id is not distinct from p.query_id group by 1""")
def v21_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """How varied the hits of a query are, by files, patterns and layers."""
    h = hits(spark, folder).select("query_id", "file_path", C.layer("file_path").alias("layer"), C.hit_patterns(F.coalesce("content", F.lit(""))).alias("patterns"))
    by = h.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"), F.count_distinct("layer").alias("layers"))
    found = h.select("query_id", F.explode("patterns").alias("p")).distinct().groupBy("query_id").agg(F.count("*").alias("patterns"))
    both = by.join(found.withColumnRenamed("query_id", "q"), F.col("query_id").eqNullSafe(F.col("q")), "left")
    mean = (F.col("files") / F.col("n") + F.least(F.lit(1.0), F.coalesce("patterns", F.lit(0)) / 5) + F.least(F.lit(1.0), F.col("layers") / 3)) / 3
    return both.select("query_id", F.round(mean, 6).alias("diversity"))


@query(f"""with top as ({SQL["v5_search"]}), r as (select hit_id, score, row_number() over (partition by hit_id order by received_at desc nulls last) d from search_results), a as (select query_id, min(coalesce(original_query, '')) q from search_queries group by 1), i as (select query_id, {_INTENT} intent from a)
select top.query_id, top.hit_id, 'This result ranks #' || place || ' with ' || case when score > 0.8 then 'high' when score > 0.6 then 'good' else 'moderate' end || ' semantic similarity to your query. ' || case coalesce(intent, 'find_implementation') when 'find_examples' then 'It appears to be a good example implementation' when 'debug_issue' then 'It contains relevant error handling or debugging code'
  when 'find_patterns' then 'It demonstrates relevant design patterns' when 'analyze_quality' then 'It provides code suitable for quality analysis' else 'It contains relevant implementation code' end || '.' reason, round(greatest(0.0, 1 - (place - 1) / 20), 6)::double by_rank from top join r on r.hit_id = top.hit_id and d = 1 left join i on top.query_id = i.query_id""")
def v22_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why each of the twenty hits of a query ranks where it does."""
    top = two_rounds(hits(spark, folder).select("query_id", "snapshot_id", "file_path", "hit_id", "score"), ["query_id"], ["snapshot_id", "file_path"], "score", ["hit_id"], 20, 3)
    intents = asked(spark, folder).groupBy("query_id").agg(F.min(F.struct("q", "intent")).alias("x")).select("query_id", F.col("x.intent").alias("intent"))
    return top.join(small(intents), "query_id", "left").select("query_id", "hit_id", R.reason(F.col("place"), F.col("score"), F.coalesce("intent", F.lit("find_implementation"))).alias("reason"), F.round(F.greatest(F.lit(0.0), 1 - (F.col("place") - 1) / 20), 6).alias("by_rank"))
