"""Queries on search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import questions as Q
from stratalog.plans import Registry
from stratalog.sources.tables import table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_A = "with a as (select distinct query_id, coalesce(original_query, '') q, coalesce(search_mode, '') mode, result_limit, max_results_per_file from search_queries)"
_INTENT = r"""case
  when regexp_matches(lower(q), '\b(how to|example|sample|demo|tutorial|guide|show me)\b') or regexp_matches(lower(q), '\b(examples? of|samples? of|demos? of)\b') then 'find_examples'
  when regexp_matches(lower(q), '\b(error|bug|issue|problem|fix|debug|troubleshoot|broken)\b') or regexp_matches(lower(q), '\b(not working|fails?|crash|exception)\b') then 'debug_issue'
  when regexp_matches(lower(q), '\b(similar|like|equivalent|alternative|comparable)\b') or regexp_matches(lower(q), '\b(same as|looks like|works like)\b') then 'find_similar'
  when regexp_matches(lower(q), '\b(pattern|design pattern|architecture|architectural pattern)\b') or regexp_matches(lower(q), '\b(singleton|factory|observer|strategy|decorator)\b') or regexp_matches(lower(q), '\b(patterns? in|patterns? used)\b') then 'find_patterns'
  when regexp_matches(lower(q), '\b(usage|used|call|invoke|reference|depend|import)\b') or regexp_matches(lower(q), '\b(where.*used|how.*used|who.*uses)\b') or regexp_matches(lower(q), '\b(usage of|references to)\b') then 'find_usage'
  when regexp_matches(lower(q), '\b(quality|performance|optimize|improve|refactor|clean)\b') or regexp_matches(lower(q), '\b(best practice|code smell|maintainability|analyze)\b') then 'analyze_quality'
  when regexp_matches(lower(q), '\b(what does|how does|behavior|functionality|logic)\b') or regexp_matches(lower(q), '\b(works by|operates|functions)\b') then 'understand_behavior'
  else 'find_implementation' end"""
_B = f"{_A}, b as (select *, {_INTENT} intent from a)"
_WORDS = r"len(regexp_split_to_array(q, '\s+'))"


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_queries").select("query_id", F.coalesce("original_query", F.lit("")).alias("q"), F.coalesce("search_mode", F.lit("")).alias("mode"), "result_limit", "max_results_per_file").distinct().withColumn("intent", Q.intent("q"))


def _map(table: dict[str, str], default: str) -> str:
    return "case intent " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + f" else '{default}' end"


@query(f"{_B} select query_id, intent, case intent " + " ".join(f"when '{k}' then {c}" for k, (c, _) in Q.INTENTS.items()) + f" else {Q.BASE} end::double confidence, regexp_matches(lower(q), '{Q.TESTING}') about_tests from b")
def q2_intent(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", "intent", Q.confidence("intent").alias("confidence"), Q.about_tests("q").alias("about_tests"))


_ADDED = r"""list_concat(case intent
  when 'find_implementation' then list_filter(['implementation', 'code', 'function', 'method', 'class'], lambda w: not contains(lower(q), w))[1:2]
  when 'find_examples' then list_filter(['example', 'sample', 'demo', 'tutorial', 'usage'], lambda w: not contains(lower(q), w))[1:2]
  when 'debug_issue' then list_filter(['error handling', 'exception', 'debugging', 'troubleshooting'], lambda w: not contains(lower(q), w))[1:2]
  when 'find_patterns' then list_filter(['design pattern', 'architecture', 'structure', 'organization'], lambda w: not contains(lower(q), w))[1:2]
  when 'find_usage' then list_filter(['usage', 'reference', 'dependency', 'import', 'call'], lambda w: not contains(lower(q), w))[1:2]
  when 'find_similar' then list_filter(['similar', 'alternative', 'equivalent', 'comparable'], lambda w: not contains(lower(q), w))[1:2]
  when 'analyze_quality' then list_filter(['quality', 'metrics', 'performance', 'maintainability'], lambda w: not contains(lower(q), w))[1:2]
  when 'understand_behavior' then list_filter(['behavior', 'functionality', 'logic', 'algorithm'], lambda w: not contains(lower(q), w))[1:2] end, list_concat(case
  when contains(lower(q), 'api') then list_filter(['endpoint', 'service', 'client', 'request', 'response'], lambda w: not contains(lower(q), w))[1:1] else [] end, case
  when contains(lower(q), 'database') then list_filter(['query', 'schema', 'model', 'repository', 'orm'], lambda w: not contains(lower(q), w))[1:1] else [] end, case
  when contains(lower(q), 'auth') then list_filter(['authentication', 'authorization', 'token', 'session', 'login'], lambda w: not contains(lower(q), w))[1:1] else [] end, case
  when contains(lower(q), 'ui') then list_filter(['component', 'interface', 'view', 'render', 'display'], lambda w: not contains(lower(q), w))[1:1] else [] end, case
  when contains(lower(q), 'test') then list_filter(['unit test', 'integration test', 'mock', 'assert', 'verify'], lambda w: not contains(lower(q), w))[1:1] else [] end, case
  when contains(lower(q), 'config') then list_filter(['configuration', 'settings', 'environment', 'parameter'], lambda w: not contains(lower(q), w))[1:1] else [] end))"""


@query(f"""{_B}, t as (select query_id, q, {_ADDED} terms from b), e as (select *, trim(q || ' ' || array_to_string(terms, ' ')) enhanced from t)
select query_id, enhanced, len(terms)::bigint added, (case when length(q) = 0 then 0.8 else round(greatest(0.1, least(1.0, 0.8 - case when len(terms) > 5 then 0.2 else 0 end + case when length(enhanced) / length(q) > 1.2 and length(enhanced) / length(q) < 2 then 0.1 when length(enhanced) / length(q) > 2 then -0.15 else 0 end)), 6) end)::double confidence from e""")
def q4_enhanced(spark: SparkSession, folder: str) -> DataFrame:
    e = asked(spark, folder).withColumn("terms", Q.added_terms("q", "intent")).withColumn("enhanced", F.trim(F.concat("q", F.lit(" "), F.array_join("terms", " "))))
    ratio = F.length("enhanced") / F.nullif(F.length("q"), F.lit(0))
    shift = F.when((ratio > 1.2) & (ratio < 2), 0.1).when(ratio > 2, -0.15).otherwise(0.0)
    sure = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(0.8) - F.when(F.size("terms") > 5, 0.2).otherwise(0.0) + shift))
    return e.select("query_id", "enhanced", F.size("terms").cast("long").alias("added"), F.round(F.when(F.length("q") == 0, 0.8).otherwise(sure), 6).alias("confidence"))


@query(rf"""{_A}, p as (select query_id, list_filter(list_transform(regexp_split_to_array(q, '(?i)\b(?:and|or|also|plus|additionally|furthermore|moreover)\b'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 3) p from a
  where regexp_matches(lower(q), '{Q.SEPARATORS}') or len(regexp_split_to_array(q, '[.!?]')) > 1 or (length(q) > 100 and {_WORDS} > 15))
select query_id, (i - 1)::bigint place, p[i] part, case when i = 1 then 'high' else 'medium' end priority from (select query_id, p, unnest(generate_series(1, len(p))) i from p)""")
def q6_parts(spark: SparkSession, folder: str) -> DataFrame:
    e = asked(spark, folder).select("query_id", F.posexplode(Q.parts("q")).alias("place", "part"))
    return e.select("query_id", F.col("place").cast("long").alias("place"), "part", F.when(F.col("place") == 0, "high").otherwise("medium").alias("priority"))


_VAGUE = r"""(contains(lower(q), 'it') or contains(lower(q), 'this') or contains(lower(q), 'that') or contains(lower(q), 'thing') or contains(lower(q), 'stuff') or contains(lower(q), 'code')) and len(regexp_split_to_array(q, '\s+')) < 5"""


@query(f"""{_A} select query_id, array_to_string(list_filter([case when length(q) < 3 then 'too_narrow' end, case when length(q) > 200 then 'too_broad' end, case when {_VAGUE} then 'ambiguous' end], lambda x: x is not null), '|') issues, length(q) >= 3 valid,
  round(greatest(0.1, least(1.0, 0.8 - (length(q) < 3)::int * 0.3 - ((length(q) > 200)::int + ({_VAGUE})::int) * 0.15 + case when length(q) > 20 and length(q) < 100 then 0.1 else 0 end)), 6)::double quality from a""")
def q7_validity(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", F.array_join(Q.issues("q"), "|").alias("issues"), (F.length("q") >= 3).alias("valid"), F.round(Q.expected_quality("q"), 6).alias("quality"))


@query(f"{_B} select query_id, {_map(Q.MODES, 'semantic')} mode, {_map(Q.RANKINGS, 'relevance')} ranking, {_map({k: '|'.join(v) for k, v in Q.EXPECTED.items()}, 'code')} expected, case intent when 'understand_behavior' then 10 else 5 end radius from b")
def q8_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", Q.by_intent("intent", Q.MODES, "semantic").alias("mode"), Q.by_intent("intent", Q.RANKINGS, "relevance").alias("ranking"), Q.by_intent("intent", {k: "|".join(v) for k, v in Q.EXPECTED.items()}, "code").alias("expected"), F.when(F.col("intent") == "understand_behavior", 10).otherwise(5).alias("radius"))


_TECH = " + ".join(f"contains(lower(q), '{t}')::int" for t in Q.TECHNICAL)


@query(f"{_A} select query_id, round(least(1.0, least(length(q) / 100, 1.0) * 0.3 + least({_WORDS} / 10, 1.0) * 0.3 + least(({_TECH}) / 5, 1.0) * 0.2 + least(len(regexp_extract_all(lower(q), '{Q.CONJUNCTIONS}')) / 3, 1.0) * 0.2), 6) complexity from a")
def q9_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", F.round(Q.complexity("q"), 6).alias("complexity"))


@query(f"{_B} select query_id, case intent when 'find_examples' then 0.7 when 'debug_issue' then 0.6 when 'find_similar' then 0.75 when 'analyze_quality' then 0.8 else 0.65 end::double threshold from b")
def q11_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", F.round(Q.threshold("intent", 0.65), 6).alias("threshold"))


@query("""with p as (select query_id, coalesce(original_query, '') q, coalesce(search_mode, '') m from (select distinct query_id, original_query, search_mode from search_queries)) select q query, m mode, min(query_id) first_id, count(*) asked from p group by all""")
def b2_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """A batch of queries with equal ones once, the first kept."""
    return asked(spark, folder).groupBy(F.col("q").alias("query"), "mode").agg(F.min("query_id").alias("first_id"), F.count("*").alias("asked"))


# What an error message says, by the first wording found; and which errors are tried again.
ERRORS = {"timeout": "OPERATION_TIMEOUT", "not found": "RESOURCE_NOT_FOUND", "permission": "PERMISSION_DENIED", "network": "NETWORK_ERROR", "memory": "MEMORY_ERROR"}
AGAIN, NEVER = ("timeout", "network", "temporary", "rate limit", "service unavailable"), ("not found", "permission", "invalid", "malformed")


def error_code(message):
    out = None
    for words, code in ERRORS.items():
        holds = F.contains(message, F.lit(words))
        out = F.when(holds, code) if out is None else out.when(holds, code)
    return out.otherwise("UNKNOWN_ERROR")


def retryable(message):
    """Whether an operation that failed with ``message`` is tried again; an unknown error is."""
    low = F.lower(message)
    has = lambda words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), True) for w in words], F.lit(False))
    return F.when(has(AGAIN), True).otherwise(~has(NEVER))


@query("select doc_id, case " + " ".join(f"when contains(text, '{w}') then '{c}'" for w, c in ERRORS.items()) + " else 'UNKNOWN_ERROR' end code, case when " + " or ".join(f"contains(lower(text), '{w}')" for w in AGAIN) + " then true else not (" + " or ".join(f"contains(lower(text), '{w}')" for w in NEVER) + ") end again from documents where text is not null")
def b4_error_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document read as an error message."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", error_code(F.col("text")).alias("code"), retryable(F.col("text")).alias("again"))


_KEYWORDS = {  # by intent: the keywords that each wording of it found adds
    "find_examples": "['examples', 'tutorials', 'samples']", "debug_issue": "['debugging', 'error_handling', 'troubleshooting']", "find_patterns": "['patterns', 'architecture', 'design']", "find_usage": "['usage', 'dependencies', 'references']",
    "find_similar": "['similarity', 'alternatives', 'equivalents']", "analyze_quality": "['quality', 'performance', 'optimization']", "understand_behavior": "['behavior', 'functionality', 'logic']",
}
_ADD = [f"case when regexp_matches(lower(q), '{p}') then {_KEYWORDS[n]} else [] end" for n, (_, ps) in sorted(Q.INTENTS.items()) for p in ps] + [f"case when regexp_matches(lower(q), '{Q.TESTING}') then ['testing', 'quality_assurance', 'verification'] else [] end"]


@query(f"{_A} select distinct query_id, array_to_string(list_sort(flatten([{', '.join(_ADD)}])), '|') keywords from a")
def q3_context_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of a query's context, each as often as a wording asks for it, in the order of letters."""
    return asked(spark, folder).select("query_id", F.array_join(F.array_sort(Q.context_keywords("q")), "|").alias("keywords")).distinct()


@query(rf"""{_A}, l as (select query_id, min(lower(metadata.lang)) lang from (select distinct query_id, snapshot_id from search_results) join code_chunks using (snapshot_id) group by 1 having count(distinct lower(metadata.lang)) = 1),
  t as (select distinct a.query_id, q, regexp_replace(q, '^\s+|\s+$', '', 'g') q0, lang from a left join l using (query_id)), b as (select *, case when lang is not null and not contains(lower(q0), lang) then lang || ' ' || q0 else q0 end q1 from t)
select query_id, case when length(q) > 100 then q when length(q) >= 70 then q1 when regexp_matches(lower(q), '\b(error|exception|bug|fix|catch|try)\b') then q1 || ' error handling code' when regexp_matches(lower(q), '\b(api|endpoint|service|client|request|response|fetch|http)\b') then q1 || ' service implementation'
  when regexp_matches(lower(q), '\b(test|spec|assert|mock|stub|verify)\b') then q1 || ' test implementation' when regexp_matches(lower(q), '\b(auth|login|permission|access|token|jwt|authenticate)\b') then q1 || ' authentication code' when regexp_matches(lower(q), '\b(data|store|database|db|persist|save|load|query)\b') then q1 || ' data storage code'
  when regexp_matches(lower(q), '\b(ui|interface|display|render|component|view|screen)\b') then q1 || ' interface code' when regexp_matches(lower(q), '\b(algorithm|sort|search|tree|graph|compute)\b') then q1 || ' algorithm implementation' when regexp_matches(lower(q), '\b(parse|format|convert|transform)\b') then q1 || ' data transformation code'
  when regexp_matches(lower(q), '\b(config|setting|option|parameter|env)\b') then q1 || ' configuration code' when regexp_matches(lower(q), '\b(util|helper|common)\b') then q1 || ' utility function' else q1 || ' implementation code' end search_text from b""")
def q10_search_text(spark: SparkSession, folder: str) -> DataFrame:
    """What is searched for a query: its language where its hits have but one, and what its words suggest."""
    seen = table(spark, folder, "search_results").select("query_id", "snapshot_id").distinct().join(table(spark, folder, "code_chunks").select("snapshot_id", F.lower("metadata.lang").alias("lang")).distinct(), "snapshot_id")
    langs = seen.groupBy("query_id").agg(F.count_distinct("lang").alias("n"), F.min("lang").alias("lang")).filter("n = 1").drop("n")
    return asked(spark, folder).select("query_id", "q").distinct().join(langs, "query_id", "left").select("query_id", Q.search_text("q", "lang").alias("search_text"))
