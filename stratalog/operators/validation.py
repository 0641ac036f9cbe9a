"""Checks of chunks and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.code import line_census

#: What an error and a warning take from the score.
ERROR, WARNING = 10, 2


def _codes() -> tuple[list[tuple[str, Column]], list[tuple[str, Column]]]:
    none = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    span = F.col("end_line") - F.col("start_line") + 1
    n = F.col("n.total") - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    errors = [("MISSING_ID", none("chunk_id")), ("MISSING_FILE_PATH", none("path")), ("MISSING_SNAPSHOT_ID", none("snapshot_id")), ("EMPTY_CONTENT", none("content")), ("INVALID_START_LINE", F.col("start_line") < 0), ("INVALID_LINE_RANGE", F.col("end_line") < F.col("start_line"))]
    warnings = [("MISSING_LINES", F.col("start_line").isNull() | F.col("end_line").isNull()), ("LINE_COUNT_DIFFERS", span != n), ("MISSING_LANGUAGE", none("lang")), ("NO_SYMBOLS", F.coalesce(F.array_size("symbols"), F.lit(0)) == 0), ("COMMENT_RATIO_OUT_OF_RANGE", (F.col("ratio") < 0) | (F.col("ratio") > 1)), ("MOSTLY_BLANK", F.col("n.blank") * 2 > F.col("n.total"))]
    return errors, warnings


def validated(chunks: DataFrame) -> DataFrame:
    """(chunk_id, errors, warnings, score): codes by ``|``; a null check does not hold."""
    errors, warnings = _codes()
    named = lambda rules: F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))
    c = chunks.withColumn("n", line_census("content")).select("chunk_id", named(errors).alias("e"), named(warnings).alias("w"))
    return c.select("chunk_id", F.array_join("e", "|").alias("errors"), F.array_join("w", "|").alias("warnings"), F.greatest(F.lit(0), 100 - F.size("e") * ERROR - F.size("w") * WARNING).cast("long").alias("score"))


def frequent(checked: DataFrame, most: int = 5) -> DataFrame:
    """The codes found most often."""
    codes = checked.select(F.explode(F.filter(F.split(F.concat_ws("|", "errors", "warnings"), r"\|"), lambda x: x != "")).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("chunks")).orderBy(F.col("chunks").desc(), "code").limit(most)


# What chunks and edges may be, and the bounds from which their measures are remarked on.
TYPES = ("function", "class", "interface", "module", "config", "test", "documentation")
LAYERS = ("presentation", "business", "data", "infrastructure", "domain", "utility", "configuration", "unknown")
RELATIONS = ("calls", "imports", "extends", "implements", "uses", "depends_on", "similar_to", "tests", "contains")
LARGE_CHARS, LARGE_LINES, COMPLEX, MAINTAINED, RISKY = 10_000, 500, 80, 20, 70


def _scored(rows: DataFrame, keys: list[str], errors: list[tuple[str, Column]], warnings: list[tuple[str, Column]]) -> DataFrame:
    named = lambda rules: F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))
    both = rows.select(*keys, named(errors).alias("e"), named(warnings).alias("w"))
    return both.select(*keys, F.array_join("e", "|").alias("errors"), F.array_join("w", "|").alias("warnings"), F.greatest(F.lit(0), 100 - F.size("e") * ERROR - F.size("w") * WARNING).cast("long").alias("score"))


def validated_measures(enriched: DataFrame) -> DataFrame:
    """(chunk_id, errors, warnings, score) of enriched chunks: kinds, layers, lists and measures that can't be, and sizes,
    complexity, maintainability and risks beyond their bounds. ``enriched`` has what ``functions.code.enriched`` adds,
    and documentation, security_risk and performance_risk."""
    out = lambda c, lo, hi: F.col(c).isNull() | (F.col(c) < lo) | (F.col(c) > hi)
    errors = [("INVALID_SEMANTIC_TYPE", ~F.coalesce(F.col("kind").isin(*TYPES), F.lit(False))), ("INVALID_COMPLEXITY_SCORE", F.col("complexity").isNull() | (F.col("complexity") < 0)), ("INVALID_MAINTAINABILITY_INDEX", out("maintainability", 0, 100))]
    errors += [(f"INVALID_{c.upper()}", F.col(c).isNull()) for c in ("dependencies", "patterns", "smells", "concerns", "frameworks")]
    errors += [("INVALID_DOCUMENTATION_RATIO", out("documentation", 0, 1)), ("INVALID_QUALITY_SCORE", out("security_risk", 0, 100) | out("performance_risk", 0, 100)), ("INVALID_ARCHITECTURAL_LAYER", ~F.coalesce(F.col("layer").isin(*LAYERS), F.lit(False)))]
    warnings = [("LARGE_CHUNK", F.length("content") > LARGE_CHARS), ("LARGE_LINE_RANGE", F.col("end_line") - F.col("start_line") > LARGE_LINES), ("HIGH_COMPLEXITY", F.col("complexity") > COMPLEX), ("LOW_MAINTAINABILITY", F.col("maintainability") < MAINTAINED), ("HIGH_SECURITY_RISK", F.col("security_risk") > RISKY), ("HIGH_PERFORMANCE_RISK", F.col("performance_risk") > RISKY)]
    return _scored(enriched, ["chunk_id"], errors, warnings)


def validated_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, errors, warnings, score) of edges (src, dst, rel, strength, confidence)."""
    share = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)
    errors = [("INVALID_RELATIONSHIP_TYPE", ~F.coalesce(F.col("rel").isin(*RELATIONS), F.lit(False))), ("MISSING_TARGET_CHUNK_ID", F.coalesce(F.length(F.trim("dst")), F.lit(0)) == 0), ("INVALID_RELATIONSHIP_STRENGTH", share("strength")), ("INVALID_RELATIONSHIP_CONFIDENCE", share("confidence"))]
    return _scored(edges, ["src", "dst"], errors, [("SELF_REFERENCE", F.col("src") == F.col("dst"))])
