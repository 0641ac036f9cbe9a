"""Features of source text as column expressions: size, complexity, smells, patterns, layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.text import all_named, ascii_words, col, has_any, hits, js_round, lines, named_when, trimmed

# Words by which code is classed, and languages they hold for.
BRACES = ("javascript", "typescript", "java", "c", "cpp", "csharp")
BRANCHES = r"\b(if|for|while|case|catch|&&|\|\||switch)\b"
PYTHON_BRANCHES = r"\b(if|elif|for|while|except|and|or|try)\b"
PATTERNS = {"Singleton": ("singleton",), "Factory": ("factory", "create"), "Observer": ("observer", "notify"), "Strategy": ("strategy", "algorithm"), "Decorator": ("decorator", "wrapper"), "Adapter": ("adapter", "convert"), "Builder": ("builder", "build")}
SQL_WORDS, JOINS = ("select", "insert", "update", "delete"), ('" + ', "' + ", "` + ", '+ "', "+ '", "+ `")
SECRET = r"(?i)(?:password|secret|token|key)\s*[:=]\s*[\"'][^\"']+[\"']"
MARKS = ("TODO", "FIXME", "HACK", "XXX")
FRAMEWORKS = {"React": ("React", "jsx"), "Vue": ("Vue", "vue"), "Angular": ("Angular", "@angular"), "Express": ("Express", "express"), "Spring": ("Spring", "@RestController"), "Django": ("Django", "django")}
LAYERS = {"presentation": ("controller", "api", "route"), "business": ("service", "business", "logic"), "data": ("repository", "dao", "database"), "domain": ("model", "entity"), "utility": ("util", "helper"), "configuration": ("config", "setting")}


def line_census(content: Column | str) -> Column:
    """Struct of total, blank, comments, mixed, code, logical lines. A line that begins a comment is one; one with a
    comment mark further on is mixed."""
    kind = lambda x: named_when((("blank", x == ""), ("comments", x.startswith("//") | x.startswith("#") | x.startswith("/*") | x.startswith("*")), ("mixed", x.contains("//") | x.contains("#"))), "code")
    kinds = F.transform(lines(content), lambda x: kind(trimmed(x)))
    n = lambda name: F.size(F.filter(kinds, lambda x: x == name)).cast("long")
    return F.struct(F.size(kinds).cast("long").alias("total"), *[n(k).alias(k) for k in ("blank", "comments", "mixed", "code")], (n("code") + n("mixed")).alias("logical"))


def cyclomatic(content: Column | str, lang: Column | str) -> Column:
    """One more than the branching words; 1 for languages without a rule."""
    return F.when(col(lang).isin(*BRACES), hits(content, BRANCHES) + 1).when(col(lang) == "python", hits(content, PYTHON_BRANCHES) + 1).otherwise(F.lit(1)).cast("long")


def nesting(content: Column | str) -> Column:
    """Greatest surplus of opening brackets after any line."""
    step = lambda x: F.regexp_count(x, F.lit(r"[{(]")) - F.regexp_count(x, F.lit(r"[})]"))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    merge = lambda acc, x: F.struct((acc["now"] + step(x)).alias("now"), F.greatest(acc["most"], acc["now"] + step(x)).alias("most"))
    return F.aggregate(lines(content), zero, merge, lambda acc: acc["most"]).cast("long")


def complexity(content: Column | str, lang: Column | str) -> Column:
    """Branches, half the nesting and a tenth of the lines over 50, to one decimal."""
    n = F.size(lines(content))
    return js_round((cyclomatic(content, lang) + nesting(content) * 0.5 + F.greatest(n - 50, F.lit(0)) * 0.1) * 10) / 10


def maintainability(content: Column | str) -> Column:
    """0..100: less a hundredth of each line over 100, plus a fifth of the percentage of comment lines."""
    all_lines = lines(content)
    n = F.size(all_lines)
    marked = F.size(F.filter(all_lines, lambda x: trimmed(x).rlike(r"^(//|#|\*)")))
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(100 - F.greatest(F.lit(0.0), (n - 100) * 0.01) + marked / n * 20))).cast("long")


def semantic_type(content: Column | str, lang: Column | str) -> Column:
    """test, documentation, config, class, interface, function or module, by the first rule that holds."""
    c, low, lang = col(content), F.lower(col(content)), col(lang)
    script, python, java = lang.isin("javascript", "typescript"), lang == "python", lang == "java"
    return named_when((
        ("test", has_any(low, ("test", "spec", "describe", "it("))),
        ("documentation", has_any(low, ("readme", "documentation")) | c.rlike(r"(?m)^\s*/\*\*[\s\S]*\*/") | c.rlike(r"(?m)^\s*#\s+")),
        ("config", has_any(low, ("config", "settings")) | lang.isin("json", "yaml")),
        ("class", (script | python | java) & c.contains("class ")),
        ("interface", (script | java) & c.contains("interface ")),
        ("function", (script & (c.contains("function ") | c.contains("=>"))) | (python & c.contains("def ")) | (java & (c.contains("public ") | c.contains("private ")))),
    ), "module")


def design_patterns(content: Column | str) -> Column:
    low = F.lower(col(content))
    rules = [(name, has_any(low, words)) for name, words in PATTERNS.items()]
    rules[0] = ("Singleton", rules[0][1] | (low.contains("instance") & low.contains("static")))
    return all_named(rules)


def repeated_lines(content: Column | str, longer: int, more: int) -> Column:
    """Whether a trimmed line of over ``longer`` characters stands more than ``more`` times in a text."""
    kept = F.array_sort(F.filter(F.transform(lines(content), trimmed), lambda x: F.length(x) > longer))
    # sorted, a line that stands more than n times equals the one n places on
    return F.exists(F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - more, F.lit(0))), F.slice(kept, more + 1, F.greatest(F.size(kept) - more, F.lit(0))), lambda a, b: a == b), lambda x: x)


def code_smells(content: Column | str) -> Column:
    c, n = col(content), F.size(lines(content))
    return all_named((("Long Method", n > 50), ("Long Parameter List", c.rlike(r"\([^)]{50,}\)")), ("Duplicate Code", repeated_lines(c, 10, 2)), ("Large Class", c.contains("class ") & (n > 200)), ("Dead Code", has_any(c, MARKS))))


def security_concerns(content: Column | str) -> Column:
    c, low = col(content), F.lower(col(content))
    return all_named((("SQL Injection Risk", has_any(low, SQL_WORDS) & has_any(c, JOINS)), ("XSS Risk", has_any(low, ("innerhtml", "eval"))), ("Hardcoded Credentials", c.rlike(SECRET)), ("Weak Random Number Generation", has_any(low, ("math.random", "random.random"))), ("Path Traversal Risk", has_any(low, ("../", "..\\")))))


def frameworks(content: Column | str) -> Column:
    return all_named((name, has_any(content, words)) for name, words in FRAMEWORKS.items())


def layer(path: Column | str) -> Column:
    """Architectural layer by the words of a path."""
    low = F.lower(col(path))
    return named_when(((name, has_any(low, words)) for name, words in LAYERS.items()), "unknown")


def readability(content: Column | str) -> Column:
    """0..100: less 5 for a line over 120 characters, half a point for each line over 50, 2 for deep indents and for
    each number of two or more digits; plus half a point for camel case names, 10 at most."""
    c, all_lines = col(content), lines(content)
    long = F.size(F.filter(all_lines, lambda x: F.length(x) > 120))
    deep = F.size(F.filter(all_lines, lambda x: x.rlike(r"^\s{17,}\S")))
    camel = hits(c, r"\b[a-z]+[A-Z][a-zA-Z]*\b")
    score = 100 - long * 5 - F.greatest(F.size(all_lines) - 50, F.lit(0)) * 0.5 + F.least(F.lit(10.0), camel * 0.5) - deep * 2 - hits(c, r"\b\d{2,}\b") * 2
    return F.greatest(F.lit(0), F.least(F.lit(100), js_round(score))).cast("long")


def documentation_ratio(content: Column | str) -> Column:
    """Share of the lines that hold something which are comments."""
    kept = F.filter(F.transform(lines(content), trimmed), lambda x: x != "")
    marked = F.size(F.filter(kept, lambda x: x.rlike(r"^(//|#|/\*|\*)")))
    return F.when(F.size(kept) == 0, F.lit(0.0)).otherwise(marked / F.size(kept))


def calls(content: Column | str) -> Column:
    """Distinct names that are called."""
    return F.array_distinct(F.regexp_extract_all(col(content), F.lit(ascii_words(r"\b([A-Za-z_][0-9A-Za-z_]*)\s*\(")), 1))


def imports(content: Column | str, lang: Column | str) -> Column:
    """Distinct modules that a text imports."""
    js = F.regexp_extract_all(col(content), F.lit(r"""(?:from|require\()\s*['"]([^'"\n]+)['"]"""), 1)
    py = F.regexp_extract_all(col(content), F.lit(r"(?m)^\s*(?:from|import)\s+([0-9A-Za-z_.]+)"), 1)
    java = F.regexp_extract_all(col(content), F.lit(r"(?m)^\s*import\s+(?:static\s+)?([0-9A-Za-z_.]+)\s*;"), 1)
    return F.array_distinct(F.when(col(lang).isin("javascript", "typescript"), js).when(col(lang) == "python", py).when(col(lang) == "java", java).otherwise(F.array().cast("array<string>")))


# Words and operators of the second complexity, waits and loops that may cost time, weights of quality.
DECISIONS, OPERATORS = ("if", "else", "while", "for", "switch", "case", "catch"), r"&&|\|\||\?"
SCORED = ("if", "else", "for", "while", "switch", "case", "catch", "try")
UNSAFE = {"javascript": r"eval\s*\(|innerHTML\s*=|document\.write|setTimeout\s*\(\s*[\"']", "python": r"eval\s*\(|exec\s*\(|os\.system|pickle\.loads", "java": r"Runtime\.getRuntime|ProcessBuilder|ObjectInputStream"}
WEIGHTS = {"readability": 0.25, "complexity": 0.2, "maintainability": 0.2, "documentation": 0.15, "security": 0.1}


def decisions(content: Column | str) -> Column:
    """One more than the decision words and operators, in any language."""
    return (hits(content, r"\b(" + "|".join(DECISIONS) + r")\b") + hits(content, OPERATORS) + 1).cast("long")


def cognitive(content: Column | str) -> Column:
    """A line that names a control word costs one and the nesting it is in, and nests what follows until a line that is
    a closing brace; each logical operator costs one."""
    zero = F.struct(F.lit(0).alias("cost"), F.lit(0).alias("nest"))

    def step(acc: Column, line: Column) -> Column:
        line = trimmed(line)
        control, closing = has_any(line, ("if", "for", "while")), line == "}"
        cost = acc["cost"] + F.when(control, acc["nest"] + 1).otherwise(0) + F.regexp_count(line, F.lit(r"&&|\|\|"))
        nest = acc["nest"] + control.cast("int")
        return F.struct(cost.alias("cost"), F.when(closing, F.greatest(nest - 1, F.lit(0))).otherwise(nest).alias("nest"))

    return F.aggregate(lines(content), zero, step, lambda acc: acc["cost"]).cast("long")


def brace_depth(content: Column | str) -> Column:
    """Greatest depth of braces; a closing one too many counts for nothing."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    braces = F.split(F.regexp_replace(col(content), "[^{}]", ""), "")

    def step(acc: Column, c: Column) -> Column:
        now = F.when(c == "{", acc["now"] + 1).when(c == "}", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(braces, zero, step, lambda acc: acc["most"]).cast("long")


def performance_risk(content: Column | str, lang: Column | str) -> Column:
    """0..1: waiting reads, timers never cleared, growing lists in loops, loops in loops, queries in loops, large arrays."""
    c, low, lang = col(content), F.lower(col(content)), col(lang)
    script, python, java = lang.isin("javascript", "typescript"), lang == "python", lang == "java"
    has = lambda *words: has_any(low, words)
    rules = (
        (script & has("fs.readfilesync", "fs.writefilesync"), 0.3), (script & (hits(c, "getElementById") > 2), 0.2), (script & has("setinterval") & ~has("clearinterval"), 0.4),
        (python & has("for") & has("append") & has("range"), 0.2), (python & has("global "), 0.3), (java & has("for") & has("+") & has("string"), 0.3), (java & has("vector", "hashtable"), 0.2),
        (has("for", "while") & has("query", "select", "insert", "update"), 0.5), (has("array") & c.rlike(r"[0-9]{4,}"), 0.2),
    )
    total = sum((F.when(holds, n).otherwise(0.0) for holds, n in rules), F.lit(0.0))
    return F.least(F.lit(1.0), total + hits(c, r"(?i)for\s*\([^}]*for\s*\(") * 0.3)


def quality_complexity(content: Column | str) -> Column:
    """0..100: three times the words and operators of decision, and nesting over two twice."""
    words = hits(content, r"\b(" + "|".join(SCORED) + r")\b") + hits(content, r"&&|\|\||and\s+|or\s+") + 1
    return F.least(F.lit(100), (words + F.greatest(nesting(content) - 2, F.lit(0)) * 2) * 3).cast("long")


def security_score(content: Column | str, lang: Column | str) -> Column:
    """0..100, less 15 for each unsafe call and 10 if a secret is named."""
    found = F.when(col(lang).isin("javascript", "typescript"), hits(content, UNSAFE["javascript"])).when(col(lang) == "python", hits(content, UNSAFE["python"])).when(col(lang) == "java", hits(content, UNSAFE["java"])).otherwise(0)
    return F.greatest(F.lit(0), 100 - found * 15 - F.when(col(content).rlike("(?i)password|secret|key"), 10).otherwise(0)).cast("long")


def overall_quality(content: Column | str, lang: Column | str) -> Column:
    """0..100: the weighted mean of readability, (inverse) complexity, maintainability, documentation and security."""
    parts = {"readability": readability(content), "complexity": 100 - quality_complexity(content), "maintainability": maintainability(content), "documentation": documentation_ratio(content) * 100, "security": security_score(content, lang)}
    return sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())


def debt(content: Column | str, lang: Column | str) -> Column:
    """Struct of hours to mend (2 for a smell, 4 for a concern, 3 for high performance risk) and how pressing it is."""
    hours = F.size(code_smells(content)) * 2 + F.size(security_concerns(content)) * 4 + F.when(performance_risk(content, lang) > 0.5, 3).otherwise(0)
    return F.struct(hours.cast("long").alias("hours"), named_when((("critical", hours > 16), ("high", hours > 8), ("medium", hours > 4), ("low", hours > 0)), "none").alias("severity"))


def symbols(content: Column | str) -> Column:
    """Distinct names that a text declares."""
    return F.array_distinct(F.regexp_extract_all(col(content), F.lit(ascii_words(r"\b(?:function|class|interface|enum|def|func|type|const|let|var)\s+([A-Za-z_][0-9A-Za-z_]*)")), 1))


def node_complexity(content: Column | str) -> Column:
    """One more than the branching words, whatever the language."""
    return (hits(content, BRANCHES) + 1).cast("long")


def result_maintainability(content: Column | str) -> Column:
    """0..100: less two for each branch and a tenth for each line, plus a tenth of the percentage of comment marks."""
    n = F.size(lines(content))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - node_complexity(content) * 2 - n * 0.1 + F.regexp_count(col(content), F.lit(r"//|/\*")) / n * 10))


def coverage(content: Column | str, path: Column | str, symbols: Column | str) -> Column:
    """Null where nothing is defined, 1 for tests, else a fifth for each word of tests."""
    low = F.lower(col(content))
    tests = has_any(F.lower(col(path)), ("test", "spec")) | has_any(low, ("describe(", "it("))
    words = sum((F.contains(low, F.lit(w)).cast("int") for w in ("test(", "expect(", "assert", "should")), F.lit(0))
    return F.when(F.coalesce(F.size(col(symbols)), F.lit(0)) <= 0, F.lit(None).cast("double")).when(tests, 1.0).otherwise(F.least(F.lit(1.0), words * 0.2))


def complexity_level(score: Column) -> Column:
    """A word for a readability of 0..1."""
    return named_when((("simple", score > 0.8), ("moderate", score > 0.6), ("complex", score > 0.4)), "very_complex")


def highlighted(content: Column | str, query: Column | str) -> Column:
    """``content`` escaped for HTML, the words of ``query`` of three letters or more marked, in any letter case."""
    text = F.coalesce(col(content), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    words = F.filter(F.split(F.lower(col(query)), r"\s+"), lambda x: F.length(x) > 2)
    terms = F.array_sort(F.array_distinct(F.transform(words, lambda x: F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1"))))
    pattern = F.concat(F.lit("(?i)("), F.array_join(terms, "|"), F.lit(")"))
    return F.when(F.coalesce(F.size(terms), F.lit(0)) <= 0, text).otherwise(F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>")))


def enriched(chunks):
    """``chunks`` with kind, maintainability, readability, patterns, smells, concerns, frameworks, layer, complexity,
    and as ``dependencies`` the imports of all chunks of the same file."""
    c = chunks.withColumns({
        "kind": semantic_type("content", "lang"), "maintainability": maintainability("content"), "readability": readability("content"), "patterns": design_patterns("content"), "smells": code_smells("content"),
        "concerns": security_concerns("content"), "frameworks": frameworks("content"), "layer": layer("path"), "complexity": complexity("content", "lang"),
    })
    named = chunks.select("snapshot_id", "path", F.explode("imports").alias("i")).filter("i is not null")
    files = named.groupBy("snapshot_id", "path").agg(F.array_sort(F.collect_set("i")).alias("dependencies"))
    return c.join(files, ["snapshot_id", "path"], "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))


# The words of the second versions, which search hits and the context-aware chunker use.
HIT_PATTERNS = {"Singleton": ("getInstance", "singleton"), "Factory": ("factory", "create"), "Observer": ("observer", "subscribe"), "Strategy": ("strategy", "algorithm"), "Decorator": ("decorator", "wrapper")}
SLOW = {
    "javascript": (r"for\s*\([^)]*\)\s*\{[^}]*for\s*\([^)]*\)", r"document\.getElementById", r"\.innerHTML\s*\+=", r"new\s+RegExp"),
    "python": (r"for\s+[0-9A-Za-z_]+\s+in\s+range\([^)]*\):[^:]*for\s+[0-9A-Za-z_]+\s+in\s+range", r"\.append\s*\(", r"\+\s*=.*str", r"global\s+[0-9A-Za-z_]+"),
    "java": (r"for\s*\([^)]*\)\s*\{[^}]*for\s*\([^)]*\)", r"String\s+[0-9A-Za-z_]+\s*=\s*\"[^\"]*\"\s*\+", r"Vector|Hashtable", r"synchronized\s*\("),
}


def hit_patterns(content: Column | str) -> Column:
    """Design patterns of a search hit, by words in their letter case."""
    return all_named((name, has_any(content, words)) for name, words in HIT_PATTERNS.items())


def hit_concerns(content: Column | str) -> Column:
    """Security considerations of a search hit."""
    c = col(content)
    return all_named((("XSS", has_any(c, ("eval(", "innerHTML"))), ("password handling", F.contains(c, F.lit("password")) & ~F.contains(c, F.lit("hash")))))


def context_patterns(content: Column | str) -> Column:
    """Design patterns as the context-aware chunker sees them."""
    low = F.lower(col(content))
    both = lambda a, b: F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))
    return all_named((
        ("Singleton", has_any(low, ("singleton",)) | both("instance", "static")), ("Factory", has_any(low, ("factory", "create"))), ("Observer", has_any(low, ("observer", "subscribe", "notify", "listener"))),
        ("Strategy", has_any(low, ("strategy",)) | both("interface", "implement")), ("Decorator", has_any(low, ("decorator", "@"))),
    ))


def context_smells(content: Column | str) -> Column:
    """Code smells as the context-aware chunker sees them: more than three lines that are repeated, more than three
    numbers of two digits or more, an indent of over twenty."""
    c, all_lines = col(content), lines(content)
    kept = F.array_sort(F.filter(F.transform(all_lines, trimmed), lambda x: F.length(x) > 10))
    # sorted, a line is repeated where it equals the one before; each counts once
    again = F.array_distinct(F.filter(F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    deep = F.exists(all_lines, lambda x: F.length(F.regexp_extract(x, r"^(\s*)", 1)) > 20)
    return all_named((("Long Method", F.size(all_lines) > 50), ("Long Parameter List", c.rlike(r"\([^)]{50,}\)")), ("Duplicate Code", F.size(again) > 3), ("Magic Numbers", hits(c, r"\b[0-9]{2,}\b") > 3), ("Deep Nesting", deep)))


def context_concerns(content: Column | str, lang: Column | str) -> Column:
    """Security concerns as the context-aware chunker sees them; each is a risk of 25."""
    low = F.lower(col(content))
    has = lambda x: F.contains(low, F.lit(x))
    return all_named((("Potential SQL Injection", has("query") & has("+")), ("Potential XSS Vulnerability", has_any(low, ("innerhtml", "eval"))), ("Hardcoded Credentials", has("password") & has("=") & has_any(low, ("'", '"'))), ("Insecure Random Number Generation", has("math.random") & F.coalesce(col(lang) == "javascript", F.lit(False)))))


def slow_risk(content: Column | str, lang: Column | str) -> Column:
    """0..100: ten for each pattern of slow code of the language, twenty for each nested loop."""
    c, total = col(content), F.lit(0)
    for name, patterns in SLOW.items():
        own = sum((F.regexp_count(c, F.lit(p)) for p in patterns), F.lit(0)) * 10
        total = F.when(col(lang) == name, own).otherwise(total)
    return F.least(F.lit(100), total + F.regexp_count(c, F.lit(SLOW["java"][0])) * 20).cast("long")
