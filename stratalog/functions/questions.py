"""Understanding of search queries in words: intent, strategy, enhancement, parts, validity, complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions.text import ascii_words, col, has_any, hits, named_when

# Wording of each intent (patterns on the lower-cased query), its confidence, and what follows from it.
INTENTS = {
    "find_examples": (0.9, (r"\b(how to|example|sample|demo|tutorial|guide|show me)\b", r"\b(examples? of|samples? of|demos? of)\b")),
    "debug_issue": (0.85, (r"\b(error|bug|issue|problem|fix|debug|troubleshoot|broken)\b", r"\b(not working|fails?|crash|exception)\b")),
    "find_similar": (0.85, (r"\b(similar|like|equivalent|alternative|comparable)\b", r"\b(same as|looks like|works like)\b")),
    "find_patterns": (0.8, (r"\b(pattern|design pattern|architecture|architectural pattern)\b", r"\b(singleton|factory|observer|strategy|decorator)\b", r"\b(patterns? in|patterns? used)\b")),
    "find_usage": (0.8, (r"\b(usage|used|call|invoke|reference|depend|import)\b", r"\b(where.*used|how.*used|who.*uses)\b", r"\b(usage of|references to)\b")),
    "analyze_quality": (0.8, (r"\b(quality|performance|optimize|improve|refactor|clean)\b", r"\b(best practice|code smell|maintainability|analyze)\b")),
    "understand_behavior": (0.75, (r"\b(what does|how does|behavior|functionality|logic)\b", r"\b(works by|operates|functions)\b")),
}
TESTING = r"\b(test|testing|spec|assert|mock|stub|verify|unit test|integration test)\b"
DEFAULT, BASE = "find_implementation", 0.7
MODES = {"find_patterns": "behavioral", "understand_behavior": "behavioral", "find_usage": "hybrid", "find_similar": "hybrid", "debug_issue": "syntactic"}
RANKINGS = {"analyze_quality": "quality", "find_examples": "usage", "debug_issue": "recency"}
TERMS = {
    "find_implementation": ("implementation", "code", "function", "method", "class"),
    "find_examples": ("example", "sample", "demo", "tutorial", "usage"),
    "debug_issue": ("error handling", "exception", "debugging", "troubleshooting"),
    "find_patterns": ("design pattern", "architecture", "structure", "organization"),
    "find_usage": ("usage", "reference", "dependency", "import", "call"),
    "find_similar": ("similar", "alternative", "equivalent", "comparable"),
    "analyze_quality": ("quality", "metrics", "performance", "maintainability"),
    "understand_behavior": ("behavior", "functionality", "logic", "algorithm"),
}
CONTEXTS = {
    "api": ("endpoint", "service", "client", "request", "response"),
    "database": ("query", "schema", "model", "repository", "orm"),
    "auth": ("authentication", "authorization", "token", "session", "login"),
    "ui": ("component", "interface", "view", "render", "display"),
    "test": ("unit test", "integration test", "mock", "assert", "verify"),
    "config": ("configuration", "settings", "environment", "parameter"),
}
EXPECTED = {
    "find_implementation": ("function", "class", "method"),
    "find_examples": ("example", "tutorial", "demo"),
    "debug_issue": ("error_handling", "exception", "debugging"),
    "find_patterns": ("pattern", "architecture", "design"),
    "find_usage": ("usage", "reference", "call"),
    "find_similar": ("similar", "alternative"),
    "analyze_quality": ("quality_metrics", "performance"),
    "understand_behavior": ("behavior", "logic", "algorithm"),
}
LANGUAGE_NAMES = ("javascript", "typescript", "python", "java", "c#", "c++", "go", "rust", "php", "ruby")
TECHNICAL = ("function", "method", "class", "interface", "api", "database", "service", "component", "module", "library", "framework", "algorithm", "pattern", "authentication", "authorization", "validation", "configuration")
AMBIGUOUS = ("it", "this", "that", "thing", "stuff", "code")
CONJUNCTIONS, SEPARATORS = r"\b(and|or|but|also|plus)\b", r"\b(and|or|also|plus|additionally|furthermore|moreover)\b"


def intent(query: Column | str) -> Column:
    """The intent of most confidence; of several as sure the first in order."""
    low = F.lower(col(query))
    return named_when(((name, _any(low, patterns)) for name, (_, patterns) in INTENTS.items()), DEFAULT)


def _any(low: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | low.rlike(ascii_words(p))
    return found


def about_tests(query: Column | str) -> Column:
    return F.lower(col(query)).rlike(ascii_words(TESTING))


def confidence(named: Column | str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, (c, _) in INTENTS.items() for x in (k, c)]), col(named)), F.lit(BASE))


def by_intent(named: Column | str, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col(named)), F.lit(default))


def word_count(query: Column | str) -> Column:
    return F.size(F.split(col(query), r"\s+"))


def complexity(query: Column | str) -> Column:
    """0..1: length, words, technical terms and conjunctions, each up to its share."""
    q, low = col(query), F.lower(col(query))
    technical = sum((F.contains(low, F.lit(t)).cast("int") for t in TECHNICAL), F.lit(0))
    part = lambda n, full, share: F.least(n / full, F.lit(1.0)) * share
    return F.least(F.lit(1.0), part(F.length(q), 100, 0.3) + part(word_count(q), 10, 0.3) + part(technical, 5, 0.2) + part(hits(low, CONJUNCTIONS), 3, 0.2))


def compound(query: Column | str) -> Column:
    """Whether a query asks more than one thing."""
    q = col(query)
    return F.lower(q).rlike(ascii_words(SEPARATORS)) | (F.size(F.split(q, "[.!?]")) > 1) | ((F.length(q) > 100) & (word_count(q) > 15))


def parts(query: Column | str) -> Column:
    """Parts of a compound query over three characters, without the words that join them; else none."""
    pieces = F.transform(F.split(col(query), "(?i)" + ascii_words(SEPARATORS)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(compound(query), F.filter(pieces, lambda x: F.length(x) > 3)).otherwise(F.array().cast("array<string>"))


def added_terms(query: Column | str, named: Column | str) -> Column:
    """The first two terms of the intent that the query lacks, then one term for each context it touches."""
    low = F.lower(col(query))
    absent = lambda words, n: F.slice(F.filter(F.lit(words), lambda w: ~F.contains(low, w)), 1, n)
    none = F.array().cast("array<string>")
    own = none
    for name, words in TERMS.items():
        own = F.when(col(named) == name, absent(list(words), 2)).otherwise(own)
    return F.concat(own, *[F.when(F.contains(low, F.lit(k)), absent(list(w), 1)).otherwise(none) for k, w in CONTEXTS.items()])


def issues(query: Column | str) -> Column:
    """too_narrow (under 3 characters), too_broad (over 200), ambiguous (vague words in under five words)."""
    q = col(query)
    vague = has_any(F.lower(q), AMBIGUOUS) & (word_count(q) < 5)
    return F.array_compact(F.array(F.when(F.length(q) < 3, "too_narrow"), F.when(F.length(q) > 200, "too_broad"), F.when(vague, "ambiguous")))


def expected_quality(query: Column | str) -> Column:
    """0.1..1 by the issues, high ones more, and a bonus for a middling length."""
    q, found = col(query), issues(query)
    has = lambda x: F.array_contains(found, x).cast("int")
    bonus = F.when((F.length(q) > 20) & (F.length(q) < 100), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(0.8) - has("too_narrow") * 0.3 - (has("too_broad") + has("ambiguous")) * 0.15 + bonus))


def threshold(named: Column | str, given: float) -> Column:
    """The score that hits must reach, shifted by intent."""
    at_least = {"find_examples": max(0.7, given), "debug_issue": max(0.6, given - 0.1), "find_similar": max(0.75, given + 0.1), "analyze_quality": max(0.8, given + 0.15)}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in at_least.items() for x in kv]), col(named)), F.lit(given))


# Keywords of the context that each wording of an intent adds, and what short queries are searched with.
KEYWORDS = {
    "find_examples": ("examples", "tutorials", "samples"),
    "debug_issue": ("debugging", "error_handling", "troubleshooting"),
    "find_patterns": ("patterns", "architecture", "design"),
    "find_usage": ("usage", "dependencies", "references"),
    "find_similar": ("similarity", "alternatives", "equivalents"),
    "analyze_quality": ("quality", "performance", "optimization"),
    "understand_behavior": ("behavior", "functionality", "logic"),
}
ABOUT_TESTS = ("testing", "quality_assurance", "verification")
SUFFIXES = (
    ("error handling code", ("error", "exception", "bug", "fix", "catch", "try")),
    ("service implementation", ("api", "endpoint", "service", "client", "request", "response", "fetch", "http")),
    ("test implementation", ("test", "spec", "assert", "mock", "stub", "verify")),
    ("authentication code", ("auth", "login", "permission", "access", "token", "jwt", "authenticate")),
    ("data storage code", ("data", "store", "database", "db", "persist", "save", "load", "query")),
    ("interface code", ("ui", "interface", "display", "render", "component", "view", "screen")),
    ("algorithm implementation", ("algorithm", "sort", "search", "tree", "graph", "compute")),
    ("data transformation code", ("parse", "format", "convert", "transform")),
    ("configuration code", ("config", "setting", "option", "parameter", "env")),
    ("utility function", ("util", "helper", "common")),
)
SUFFIX, DETAILED, SHORT = "implementation code", 100, 70


def context_keywords(query: Column | str) -> Column:
    """The keywords of each wording found, so those of an intent may come twice."""
    low, none = F.lower(col(query)), F.array().cast("array<string>")
    words = lambda p, given: F.when(low.rlike(ascii_words(p)), F.lit(list(given))).otherwise(none)
    return F.concat(*[words(p, KEYWORDS[name]) for name, (_, patterns) in INTENTS.items() for p in patterns], words(TESTING, ABOUT_TESTS))


def search_text(query: Column | str, lang: Column | str) -> Column:
    """A query as it is searched: a detailed one as it is, else with its one language if it lacks that, and a short one
    with the first suffix one of whose words it has."""
    q, low = col(query), F.lower(col(query))
    bare = F.regexp_replace(q, r"^\s+|\s+$", "")
    named = F.when(col(lang).isNotNull() & ~F.contains(F.lower(bare), col(lang)), F.concat(col(lang), F.lit(" "), bare)).otherwise(bare)
    suffix = named_when(((s, low.rlike(ascii_words(rf"\b({'|'.join(words)})\b"))) for s, words in SUFFIXES), SUFFIX)
    return F.when(F.length(q) > DETAILED, q).when(F.length(q) >= SHORT, named).otherwise(F.concat(named, F.lit(" "), suffix))
