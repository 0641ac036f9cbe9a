"""Queries on features of code chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import code as C
from stratalog.functions.text import base_name, hits, js_round, lines, trimmed
from stratalog.plans import Registry
from stratalog.sources.tables import clean_path, newest, small, table

query = Registry()
QUERIES, SQL = query.queries, query.sql

_C = r"with c as (select distinct chunk_id, snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') path, start_line, end_line, content, lower(metadata.lang) lang, metadata.symbols symbols, metadata.imports imports, metadata.comment_ratio ratio from code_chunks where content is not null)"
_L = "string_split(content, chr(10))"
_T = r"list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


def _n(pattern: str, text: str = "content") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with a text, exact copies once."""
    c = table(spark, folder, "code_chunks").filter("content is not null")
    return c.select("chunk_id", "snapshot_id", clean_path("file_path").alias("path"), "start_line", "end_line", "content", F.lower("metadata.lang").alias("lang"), F.col("metadata.symbols").alias("symbols"), F.col("metadata.imports").alias("imports"), F.col("metadata.comment_ratio").alias("ratio")).distinct()


def text(array) -> str:
    return F.array_join(array, "|")


def _named(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in rules.items()) + "], lambda x: x is not null), '|')"


def _has(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in (w.replace("'", "''") for w in words)) + ")"


@query(rf"""{_C}, k as (select chunk_id, list_transform({_T}, lambda x: case when x = '' then 'b' when regexp_matches(x, '^(//|#|/\*|\*)') then 'c' when contains(x, '//') or contains(x, '#') then 'm' else 'x' end) k from c)
select chunk_id, len(k)::bigint total, len(list_filter(k, lambda x: x = 'b'))::bigint blank, len(list_filter(k, lambda x: x = 'c'))::bigint comments, len(list_filter(k, lambda x: x = 'm'))::bigint mixed, len(list_filter(k, lambda x: x = 'x'))::bigint code, len(list_filter(k, lambda x: x in ('x', 'm')))::bigint logical from k""")
def f1_line_census(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.line_census("content").alias("n")).select("chunk_id", "n.*")


_CYCLO = rf"(case when lang in ('javascript', 'typescript', 'java', 'c', 'cpp', 'csharp') then {_n(C.BRANCHES)} + 1 when lang = 'python' then {_n(C.PYTHON_BRANCHES)} + 1 else 1 end)"


@query(f"{_C} select chunk_id, {_CYCLO}::bigint cyclomatic from c")
def f3_cyclomatic(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.cyclomatic("content", "lang").alias("cyclomatic"))


_STEP = "len(regexp_extract_all(x, '[{(]')) - len(regexp_extract_all(x, '[})]'))"



@query(rf"""{_C}, d as (select chunk_id, greatest(0, max(d)) depth from (select chunk_id, sum({_STEP}) over (partition by chunk_id order by i) d from (select chunk_id, unnest({_L}) x, generate_subscripts({_L}, 1) i from c)) group by 1)
select chunk_id, depth::bigint nesting, floor(({_CYCLO} + depth * 0.5 + greatest(len({_L}) - 50, 0) * 0.1) * 10 + 0.5) / 10 complexity from c join d using (chunk_id)""")
def f4_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.nesting("content").alias("nesting"), C.complexity("content", "lang").alias("complexity"))


@query(rf"{_C} select chunk_id, greatest(0, least(100, floor(100 - greatest(0.0, (len({_L}) - 100) * 0.01) + len(list_filter({_T}, lambda x: regexp_matches(x, '^(//|#|\*)'))) / len({_L}) * 20 + 0.5)))::bigint maintainability from c")
def f10_maintainability(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.maintainability("content").alias("maintainability"))


@query(rf"""{_C} select chunk_id, greatest(0, least(100, floor(100 - 0.5 * greatest(0, avg_len - 80) - 5 * long_lines + 0.5)))::bigint readability from (select chunk_id, list_avg(list_transform({_L}, lambda x: length(x))) avg_len, len(list_filter({_L}, lambda x: length(x) > 120)) long_lines from c)""")
def f11_line_readability(spark: SparkSession, folder: str) -> DataFrame:
    """By mean line length and lines over 120 characters."""
    sizes = F.transform(lines("content"), lambda x: F.length(x))
    mean = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(sizes)
    score = 100 - 0.5 * F.greatest(F.lit(0.0), mean - 80) - 5 * F.size(F.filter(sizes, lambda x: x > 120))
    return chunks(spark, folder).select("chunk_id", F.greatest(F.lit(0), F.least(F.lit(100), js_round(score))).cast("long").alias("readability"))


@query(rf"""{_C} select chunk_id, greatest(0, least(100, floor(100 - len(list_filter({_L}, lambda x: length(x) > 120)) * 5 - greatest(len({_L}) - 50, 0) * 0.5 + least(10.0, {_n(chr(92) + 'b[a-z]+[A-Z][a-zA-Z]*' + chr(92) + 'b')} * 0.5)
  - len(list_filter({_L}, lambda x: regexp_matches(x, '^\s{{17,}}\S'))) * 2 - {_n(chr(92) + 'b' + chr(92) + 'd{2,}' + chr(92) + 'b')} * 2 + 0.5)))::bigint readability from c""")
def f12_readability(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.readability("content").alias("readability"))


@query(rf"{_C} select chunk_id, round(case when len(k) = 0 then 0 else len(list_filter(k, lambda x: regexp_matches(x, '^(//|#|/\*|\*)'))) / len(k) end, 6) ratio from (select chunk_id, list_filter({_T}, lambda x: x <> '') k from c)")
def f13_documentation(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.round(C.documentation_ratio("content"), 6).alias("ratio"))


@query(rf"""{_C}, l as (select chunk_id, snapshot_id, path, regexp_replace(x, '^\s+|\s+$', '', 'g') x from (select chunk_id, snapshot_id, path, unnest({_L}) x from c)), k as (select * from l where length(x) > 10),
  o as (select snapshot_id, path, x, count(distinct chunk_id) n from k group by all)
select chunk_id, round(count(*) filter (length(x) > 20 and n > 1) / count(*), 6) risk from k join o using (snapshot_id, path, x) group by 1""")
def f14_duplication(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a chunk's lines, of over 10 characters, that are over 20 and stand in another chunk of its file too."""
    kept = chunks(spark, folder).select("chunk_id", "snapshot_id", "path", F.explode(F.transform(lines("content"), trimmed)).alias("x")).filter(F.length("x") > 10)
    keyed = kept.select("chunk_id", "snapshot_id", "path", F.xxhash64("x").alias("h"), (F.length("x") > 20).alias("long"))
    shared = keyed.groupBy("snapshot_id", "path", "h").agg(F.count_distinct("chunk_id").alias("n"))
    both = keyed.join(shared, ["snapshot_id", "path", "h"])
    return both.groupBy("chunk_id").agg(F.round(F.count_if(F.col("long") & (F.col("n") > 1)) / F.count("*"), 6).alias("risk"))


@query(rf"""{_C}, k as (select chunk_id, x, count(*) n from (select chunk_id, unnest({_T}) x from c) where x <> '' group by all)
select chunk_id, round(least(100, sum(n - 1) / sum(n) * 200), 6) risk from k group by 1""")
def f15_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Twice the percentage of lines that repeat an earlier one, 100 at most."""
    kept = chunks(spark, folder).select("chunk_id", F.explode(F.transform(lines("content"), trimmed)).alias("x")).filter("x <> ''")
    n = kept.groupBy("chunk_id", "x").agg(F.count("*").alias("n"))
    return n.groupBy("chunk_id").agg(F.round(F.least(F.lit(100.0), F.sum(F.col("n") - 1) / F.sum("n") * 200), 6).alias("risk"))


@query(f"{_C} select chunk_id, " + _named({n: _has("lower(content)", w) + (" or (contains(lower(content), 'instance') and contains(lower(content), 'static'))" if n == "Singleton" else "") for n, w in C.PATTERNS.items()}) + " patterns from c")
def f21_design_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.design_patterns("content")).alias("patterns"))


@query(rf"{_C} select chunk_id, " + _named({"Long Method": f"len({_L}) > 50", "Long Parameter List": r"regexp_matches(content, '\([^)]{50,}\)')", "Duplicate Code": "dup", "Large Class": f"contains(content, 'class ') and len({_L}) > 200", "Dead Code": _has("content", C.MARKS)}) + rf""" smells from c join (select chunk_id, coalesce(max(n), 0) > 2 dup from c left join (select chunk_id, x, count(*) n from (select chunk_id, unnest({_T}) x from c) where length(x) > 10 group by all) using (chunk_id) group by 1) using (chunk_id)""")
def f22_code_smells(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.code_smells("content")).alias("smells"))


@query(f"{_C} select chunk_id, " + _named({"SQL Injection Risk": _has("lower(content)", C.SQL_WORDS) + " and " + _has("content", C.JOINS), "XSS Risk": _has("lower(content)", ("innerhtml", "eval")), "Hardcoded Credentials": "regexp_matches(content, '" + C.SECRET.replace("'", "''") + "')", "Weak Random Number Generation": _has("lower(content)", ("math.random", "random.random")), "Path Traversal Risk": _has("lower(content)", ("../", "..\\"))}) + " concerns from c")
def f23_security(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.security_concerns("content")).alias("concerns"))


@query(rf"""{_C} select chunk_id, case when {_has('lower(content)', ('test', 'spec', 'describe', 'it('))} then 'test' when {_has('lower(content)', ('readme', 'documentation'))} or regexp_matches(content, '(?m)^\s*/\*\*[\s\S]*\*/') or regexp_matches(content, '(?m)^\s*#\s+') then 'documentation'
  when {_has('lower(content)', ('config', 'settings'))} or lang in ('json', 'yaml') then 'config' when lang in ('javascript', 'typescript', 'python', 'java') and contains(content, 'class ') then 'class' when lang in ('javascript', 'typescript', 'java') and contains(content, 'interface ') then 'interface'
  when lang in ('javascript', 'typescript') and (contains(content, 'function ') or contains(content, '=>')) or lang = 'python' and contains(content, 'def ') or lang = 'java' and (contains(content, 'public ') or contains(content, 'private ')) then 'function' else 'module' end kind from c""")
def f24_semantic_type(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.semantic_type("content", "lang").alias("kind"))


@query(f"{_C} select distinct path, case " + " ".join(f"when {_has('lower(path)', w)} then '{n}'" for n, w in C.LAYERS.items()) + " else 'unknown' end layer from c")
def f25_layers(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("path", C.layer("path").alias("layer")).distinct()


@query(f"{_C} select chunk_id, " + _named({n: _has("content", w) for n, w in C.FRAMEWORKS.items()}) + " frameworks from c")
def f26_frameworks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.frameworks("content")).alias("frameworks"))


@query(rf"""{_C} select distinct chunk_id, unnest(case when lang in ('javascript', 'typescript') then regexp_extract_all(content, '(?:from|require\()\s*[''"]([^''"\n]+)[''"]', 1) when lang = 'python' then regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([0-9A-Za-z_.]+)', 1)
  when lang = 'java' then regexp_extract_all(content, '(?m)^\s*import\s+(?:static\s+)?([0-9A-Za-z_.]+)\s*;', 1) else [] end) module from c""")
def f28_imports(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.explode(C.imports("content", "lang")).alias("module"))


@query(rf"{_C} select distinct chunk_id, unnest(regexp_extract_all(content, '\b([A-Za-z_][0-9A-Za-z_]*)\s*\(', 1)) callee from c")
def f30_calls(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.explode(C.calls("content")).alias("callee"))


@query(rf"""{_C} select chunk_id, path || '#' || coalesce(nullif(regexp_extract(content, '(?:function|class|const|let|var)\s+([0-9A-Za-z_]+)', 1), ''), 'anonymous') key from c""")
def f33_function_key(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_extract("content", r"(?:function|class|const|let|var)\s+([0-9A-Za-z_]+)", 1)
    return chunks(spark, folder).select("chunk_id", F.concat("path", F.lit("#"), F.when(name == "", "anonymous").otherwise(name)).alias("key"))


@query(rf"""{_C} select snapshot_id, path, count(*) chunks, count(*) filter (x < 10) simple, count(*) filter (x >= 10 and x < 20) medium, count(*) filter (x >= 20) complex, round(avg(x), 6) mean from (select *, {_CYCLO} x from c) group by all""")
def f35_file_metrics(spark: SparkSession, folder: str) -> DataFrame:
    scored = chunks(spark, folder).select("snapshot_id", "path", C.cyclomatic("content", "lang").alias("x"))
    n = lambda c, name: F.count_if(c).alias(name)
    x = F.col("x")
    return scored.groupBy("snapshot_id", "path").agg(F.count("*").alias("chunks"), n(x < 10, "simple"), n((x >= 10) & (x < 20), "medium"), n(x >= 20, "complex"), F.round(F.avg("x"), 6).alias("mean"))


@query(rf"""{_C} select lang, count(*) chunks, sum({_n(chr(92) + 'bTODO' + chr(92) + 'b')})::bigint todos, round(avg(ratio), 6) comment_ratio from c group by 1""")
def f2_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(hits("content", r"\bTODO\b").cast("long")).alias("todos"), F.round(F.avg("ratio"), 6).alias("comment_ratio"))


@query(rf"""{_C} select chunk_id, content || chr(10) || chr(10) || '// SEMANTIC CONTEXT:' || chr(10) || '// LANGUAGE: ' || coalesce(lang, 'text') || chr(10) || '// FILE: ' || regexp_extract(path, '([^/]*)$', 1) || chr(10)
  || case when len(symbols) > 0 then '// SYMBOLS: ' || array_to_string(symbols, ', ') || chr(10) else '' end
  || case when len(imports) > 0 then '// IMPORTS: ' || array_to_string(imports[1:7], ', ') || case when len(imports) > 7 then ' and ' || (len(imports) - 7) || ' more' else '' end || chr(10) else '' end embedded from c""")
def con5_embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text that is embedded for a chunk: its content, then what is known of it."""
    some = lambda c: F.coalesce(F.array_size(c), F.lit(0)) > 0
    more = F.when(F.size("imports") > 7, F.concat(F.lit(" and "), (F.size("imports") - 7).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return chunks(spark, folder).select("chunk_id", F.concat("content", F.lit("\n\n// SEMANTIC CONTEXT:\n// LANGUAGE: "), F.coalesce("lang", F.lit("text")), F.lit("\n// FILE: "), base_name("path"), F.lit("\n"),
        F.when(some("symbols"), F.concat(F.lit("// SYMBOLS: "), F.array_join("symbols", ", "), F.lit("\n"))).otherwise(F.lit("")),
        F.when(some("imports"), F.concat(F.lit("// IMPORTS: "), F.array_join(F.slice("imports", 1, 7), ", "), more, F.lit("\n"))).otherwise(F.lit(""))).alias("embedded"))



_WORD = chr(92) + "b"
_DECISIONS = f"({_n(_WORD + '(' + '|'.join(C.DECISIONS) + ')' + _WORD)} + {_n(C.OPERATORS)} + 1)"


@query(f"{_C} select chunk_id, {_DECISIONS}::bigint decisions from c")
def f6_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.decisions("content").alias("decisions"))


@query(rf"""{_C}, l as (select chunk_id, list_transform({_T}, lambda x: {{'c': contains(x, 'if') or contains(x, 'for') or contains(x, 'while'), 'z': x = chr(125), 'o': len(regexp_extract_all(x, '&&|\|\|'))}}) l from c)
select chunk_id, (list_reduce(l, lambda a, x: {{'cost': a.cost + case when x.c then a.nest + 1 else 0 end + x.o, 'nest': case when x.z then greatest(a.nest + x.c::int - 1, 0) else a.nest + x.c::int end}}, {{'cost': 0::bigint, 'nest': 0::bigint}})).cost cognitive from l""".replace("\\", "\\"))
def f7_cognitive(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.cognitive("content").alias("cognitive"))


@query(rf"""{_C}, b as (select chunk_id, string_split(regexp_replace(content, '[^{{}}]', '', 'g'), '') b from c)
select chunk_id, coalesce((list_reduce(b, lambda a, x: {{'now': case when x = chr(123) then a.now + 1 when x = chr(125) then greatest(a.now - 1, 0) else a.now end, 'most': greatest(a.most, case when x = chr(123) then a.now + 1 else a.most end)}}, {{'now': 0::bigint, 'most': 0::bigint}})).most, 0) depth from b""")
def f8_brace_depth(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.brace_depth("content").alias("depth"))


_LOW = "lower(content)"
_SCRIPT, _PY, _JAVA = "lang in ('javascript', 'typescript')", "lang = 'python'", "lang = 'java'"
_RISKS = (
    (f"{_SCRIPT} and {_has(_LOW, ('fs.readfilesync', 'fs.writefilesync'))}", 0.3), (f"{_SCRIPT} and {_n('getElementById')} > 2", 0.2), (f"{_SCRIPT} and contains({_LOW}, 'setinterval') and not contains({_LOW}, 'clearinterval')", 0.4),
    (f"{_PY} and contains({_LOW}, 'for') and contains({_LOW}, 'append') and contains({_LOW}, 'range')", 0.2), (f"{_PY} and contains({_LOW}, 'global ')", 0.3), (f"{_JAVA} and contains({_LOW}, 'for') and contains({_LOW}, '+') and contains({_LOW}, 'string')", 0.3), (f"{_JAVA} and {_has(_LOW, ('vector', 'hashtable'))}", 0.2),
    (f"{_has(_LOW, ('for', 'while'))} and {_has(_LOW, ('query', 'select', 'insert', 'update'))}", 0.5), (f"contains({_LOW}, 'array') and regexp_matches(content, '[0-9]{{4,}}')", 0.2),
)
_RISK = "least(1.0::double, " + " + ".join(f"case when {c} then {n}::double else 0 end" for c, n in _RISKS) + rf" + len(regexp_extract_all(content, '(?i)for\s*\([^}}]*for\s*\(')) * 0.3::double)"


@query(f"{_C} select chunk_id, round({_RISK}, 6) risk from c")
def f16_performance_risk(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.round(C.performance_risk("content", "lang"), 6).alias("risk"))


@query()
def f18_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each chunk, whole and in parts; each part but complexity and security has its own checked query."""
    return chunks(spark, folder).select("chunk_id", F.round(C.overall_quality("content", "lang"), 6).alias("quality"), C.quality_complexity("content").alias("complexity"), C.security_score("content", "lang").alias("security"))


@query()
def f19_debt(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.debt("content", "lang").alias("d")).select("chunk_id", "d.hours", "d.severity")


@query(rf"""{_C} select chunk_id, len(list_filter({_L}, lambda x: regexp_matches(x, '^\t+ +\S|^ +\t'))) ::bigint mixed_indents, len(list_filter({_L}, lambda x: regexp_matches(x, '[ \t]+\r?$')))::bigint trailing_blanks, len(regexp_extract_all(content, '[a-z0-9]_[a-z0-9]'))::bigint snake, len(regexp_extract_all(content, '[a-z0-9][A-Z]'))::bigint camel from c""")
def f20_style(spark: SparkSession, folder: str) -> DataFrame:
    """Mixed indents, blanks at line ends, and how names are joined."""
    n = lambda p: F.size(F.filter(lines("content"), lambda x: x.rlike(p))).cast("long")
    return chunks(spark, folder).select("chunk_id", n(r"^\t+ +\S|^ +\t").alias("mixed_indents"), n(r"[ \t]+\r?$").alias("trailing_blanks"), hits("content", "[a-z0-9]_[a-z0-9]").cast("long").alias("snake"), hits("content", "[a-z0-9][A-Z]").cast("long").alias("camel"))


@query(rf"{_C} select distinct chunk_id, unnest(regexp_extract_all(content, '\b(?:function|class|interface|enum|def|func|type|const|let|var)\s+([A-Za-z_][0-9A-Za-z_]*)', 1)) name from c")
def f29_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", F.explode(C.symbols("content")).alias("name"))


@query(rf"""with h as (select distinct query_id, hit_id, lower(content) content from search_results where content is not null), q as (select distinct query_id, lower(original_query) q from search_queries where original_query is not null)
select hit_id, query_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(q, '\s+'), lambda w: length(w) > 3 and contains(content, w)))), '|'), '') matched from h join q using (query_id)""")
def f32_matched_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of a query, over three letters, that stand in a hit."""
    h = table(spark, folder, "search_results").filter("content is not null").select("query_id", "hit_id", F.lower("content").alias("content")).distinct()
    q = table(spark, folder, "search_queries").filter("original_query is not null").select("query_id", F.lower("original_query").alias("q")).distinct()
    words = F.sort_array(F.array_distinct(F.filter(F.split("q", r"\s+"), lambda w: (F.length(w) > 3) & F.contains(F.col("content"), w))))
    return h.join(small(q), "query_id").select("hit_id", "query_id", F.array_join(words, "|").alias("matched"))


_NODE = r"(len(regexp_extract_all(content, '\b(if|for|while|switch|case|catch|&&|\|\|)\b')) + 1)"


@query(f"{_C} select chunk_id, {_NODE}::bigint complexity from c")
def f5_node_complexity(spark: SparkSession, folder: str) -> DataFrame:
    """Branching words of whatever language."""
    return chunks(spark, folder).select("chunk_id", C.node_complexity("content").alias("complexity"))


@query(rf"""{_C} select chunk_id, round(greatest(0.0, least(100.0, 100 - {_NODE} * 2 - len({_L}) * 0.1::double + len(regexp_extract_all(content, '//|/\*')) / len({_L}) * 10)), 6)::double maintainability from c""")
def f9_result_maintainability(spark: SparkSession, folder: str) -> DataFrame:
    """Of a search result: less for branches and lines, more for comments."""
    return chunks(spark, folder).select("chunk_id", F.round(C.result_maintainability("content"), 6).alias("maintainability"))


@query(rf"""{_C} select chunk_id, case when coalesce(len(symbols), 0) = 0 then null when contains(lower(path), 'test') or contains(lower(path), 'spec') or contains(lower(content), 'describe(') or contains(lower(content), 'it(') then 1.0::double
  else round(least(1.0, (contains(lower(content), 'test(')::int + contains(lower(content), 'expect(')::int + contains(lower(content), 'assert')::int + contains(lower(content), 'should')::int) * 0.2), 6)::double end coverage from c""")
def f17_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """A rough estimate of test coverage; none where nothing is defined."""
    return chunks(spark, folder).select("chunk_id", F.round(C.coverage("content", "path", "symbols"), 6).alias("coverage"))


@query("with r as (" + SQL["f12_readability"] + ") select chunk_id, case when readability / 100 > 0.8 then 'simple' when readability / 100 > 0.6 then 'moderate' when readability / 100 > 0.4 then 'complex' else 'very_complex' end complexity_level from r")
def f34_complexity_level(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.complexity_level(C.readability("content") / 100).alias("complexity_level"))


_ESCAPED = "replace(replace(replace(replace(replace(coalesce(content, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(rf"""with h as (select hit_id, query_id, content, row_number() over (partition by hit_id order by received_at desc nulls last) d from search_results), q as (select query_id, min(original_query) q from search_queries group by 1),
  t as (select query_id, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(q), '\s+'), lambda x: length(x) > 2), lambda x: regexp_replace(x, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'))) terms from q)
select hit_id, case when coalesce(len(terms), 0) = 0 then {_ESCAPED} else regexp_replace({_ESCAPED}, '(' || array_to_string(list_sort(terms), '|') || ')', '<mark>\1</mark>', 'gi') end marked from h left join t using (query_id) where d = 1""")
def f36_highlighted(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each hit, escaped, with the words of its query marked; words of three letters or more."""
    h = newest(table(spark, folder, "search_results"), ["hit_id"]).select("hit_id", "query_id", "content")
    q = table(spark, folder, "search_queries").groupBy("query_id").agg(F.min("original_query").alias("q"))
    return h.join(small(q), "query_id", "left").select("hit_id", C.highlighted("content", "q").alias("marked"))


@query("with " + ", ".join(f"x{i} as ({SQL[n]})" for i, n in enumerate(("f24_semantic_type", "f10_maintainability", "f12_readability", "f21_design_patterns", "f22_code_smells", "f23_security", "f26_frameworks"))) + rf""",
  c as (select distinct chunk_id, snapshot_id, regexp_replace(replace(file_path, '\', '/'), '^(\./)+', '') path, metadata.imports imports from code_chunks where content is not null),
  f as (select snapshot_id, path, list_sort(list_distinct(flatten(list(imports)))) all_imports from (select snapshot_id, path, list_filter(coalesce(imports, []), lambda x: x is not null) imports from c) group by 1, 2)
select c.chunk_id, kind, maintainability, readability, patterns, smells, concerns, frameworks, array_to_string(all_imports, '|') dependencies from c join f using (snapshot_id, path) """ + " ".join(f"join x{i} using (chunk_id)" for i in range(7)))
def c15_enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with all that is known of them, and the imports of their whole file."""
    return C.enriched(chunks(spark, folder)).select("chunk_id", "kind", "maintainability", "readability", text("patterns").alias("patterns"), text("smells").alias("smells"), text("concerns").alias("concerns"), text("frameworks").alias("frameworks"), text("dependencies").alias("dependencies"))


def _contains(c: str, *words: str) -> str:
    return " or ".join(f"contains({c}, '{w}')" for w in words)


@query(f"""{_C} select chunk_id, array_to_string(list_filter([case when {_contains('content', 'getInstance', 'singleton')} then 'Singleton' end, case when {_contains('content', 'factory', 'create')} then 'Factory' end, case when {_contains('content', 'observer', 'subscribe')} then 'Observer' end,
  case when {_contains('content', 'strategy', 'algorithm')} then 'Strategy' end, case when {_contains('content', 'decorator', 'wrapper')} then 'Decorator' end], lambda x: x is not null), '|') patterns from c""")
def f21_hit_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.hit_patterns("content")).alias("patterns"))


@query(f"""{_C}, k as (select *, lower(content) low from c) select chunk_id, array_to_string(list_filter([case when contains(low, 'singleton') or (contains(low, 'instance') and contains(low, 'static')) then 'Singleton' end, case when {_contains('low', 'factory', 'create')} then 'Factory' end, case when {_contains('low', 'observer', 'subscribe', 'notify', 'listener')} then 'Observer' end,
  case when contains(low, 'strategy') or (contains(low, 'interface') and contains(low, 'implement')) then 'Strategy' end, case when {_contains('low', 'decorator', '@')} then 'Decorator' end], lambda x: x is not null), '|') patterns from k""")
def f21_context_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.context_patterns("content")).alias("patterns"))


@query(rf"""{_C}, d as (select chunk_id, count(*) repeated from (select chunk_id, x from (select chunk_id, unnest({_T}) x from c) where length(x) > 10 group by 1, 2 having count(*) > 1) group by 1)
select chunk_id, array_to_string(list_filter([case when len({_L}) > 50 then 'Long Method' end, case when regexp_matches(content, '\([^)]{{50,}}\)') then 'Long Parameter List' end, case when repeated > 3 then 'Duplicate Code' end, case when len(regexp_extract_all(content, '\b[0-9]{{2,}}\b')) > 3 then 'Magic Numbers' end,
  case when len(list_filter({_L}, lambda x: length(regexp_extract(x, '^(\s*)', 1)) > 20)) > 0 then 'Deep Nesting' end], lambda x: x is not null), '|') smells from c left join d using (chunk_id)""")
def f22_context_smells(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.context_smells("content")).alias("smells"))


@query(f"""{_C} select chunk_id, array_to_string(list_filter([case when contains(content, 'eval(') or contains(content, 'innerHTML') then 'XSS' end, case when contains(content, 'password') and not contains(content, 'hash') then 'password handling' end], lambda x: x is not null), '|') concerns from c""")
def f23_hit_concerns(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", text(C.hit_concerns("content")).alias("concerns"))


@query(f"""{_C}, k as (select chunk_id, lang, lower(content) low from c), l as (select chunk_id, list_filter([case when contains(low, 'query') and contains(low, '+') then 'Potential SQL Injection' end, case when {_contains('low', 'innerhtml', 'eval')} then 'Potential XSS Vulnerability' end, case when contains(low, 'password') and contains(low, '=') and (contains(low, '''') or contains(low, '"')) then 'Hardcoded Credentials' end,
  case when contains(low, 'math.random') and coalesce(lang = 'javascript', false) then 'Insecure Random Number Generation' end], lambda x: x is not null) found from k) select chunk_id, array_to_string(found, '|') concerns, least(100, len(found) * 25)::bigint risk from l""")
def f23_context_concerns(spark: SparkSession, folder: str) -> DataFrame:
    """Concerns, and the risk they add up to."""
    found = C.context_concerns("content", "lang")
    return chunks(spark, folder).select("chunk_id", text(found).alias("concerns"), F.least(F.lit(100), F.size(found) * 25).cast("long").alias("risk"))


_NESTED = r"len(regexp_extract_all(content, 'for\s*\([^)]*\)\s*\{[^}]*for\s*\([^)]*\)'))"


@query(rf"""{_C} select chunk_id, least(100, case lang when 'javascript' then 10 * ({_NESTED} + len(regexp_extract_all(content, 'document\.getElementById')) + len(regexp_extract_all(content, '\.innerHTML\s*\+=')) + len(regexp_extract_all(content, 'new\s+RegExp')))
  when 'python' then 10 * (len(regexp_extract_all(content, 'for\s+[0-9A-Za-z_]+\s+in\s+range\([^)]*\):[^:]*for\s+[0-9A-Za-z_]+\s+in\s+range')) + len(regexp_extract_all(content, '\.append\s*\(')) + len(regexp_extract_all(content, '\+\s*=.*str')) + len(regexp_extract_all(content, 'global\s+[0-9A-Za-z_]+')))
  when 'java' then 10 * ({_NESTED} + len(regexp_extract_all(content, 'String\s+[0-9A-Za-z_]+\s*=\s*"[^"]*"\s*\+')) + len(regexp_extract_all(content, 'Vector|Hashtable')) + len(regexp_extract_all(content, 'synchronized\s*\('))) else 0 end + {_NESTED} * 20)::bigint risk from c""")
def f16_slow_code(spark: SparkSession, folder: str) -> DataFrame:
    return chunks(spark, folder).select("chunk_id", C.slow_risk("content", "lang").alias("risk"))
