"""Ranking of search hits by several criteria, and diversification."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions.code import layer
from stratalog.functions.text import col, has_any, named_when, path_matches
from stratalog.session import staged
from stratalog.sources.tables import small

# Weights of the criteria by strategy, recency by age in days, ideal complexity by intent.
CRITERIA = ("relevance", "quality", "recency", "usage", "complexity", "documentation")
WEIGHTS = {
    "relevance": (0.6, 0.2, 0.05, 0.1, 0.03, 0.02), "quality": (0.3, 0.5, 0.03, 0.05, 0.02, 0.1), "recency": (0.35, 0.15, 0.4, 0.05, 0.03, 0.02),
    "usage": (0.3, 0.2, 0.1, 0.35, 0.03, 0.02), "balanced": (0.4, 0.25, 0.15, 0.1, 0.05, 0.05),
}
RECENCY, OLD = ((7, 1.0), (30, 0.9), (90, 0.7), (180, 0.5), (365, 0.3)), 0.1
IDEAL, IDEAL_DEFAULT = {"find_examples": 3, "debug_issue": 8, "find_patterns": 6, "analyze_quality": 10}, 5
LEAST = 0.1


def recency(ts: Column | str, as_of: Column) -> Column:
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(col(ts).cast("timestamp"))) / 86_400e6
    out = None
    for most, score in RECENCY:
        out = F.when(days <= most, score) if out is None else out.when(days <= most, score)
    return F.when(col(ts).isNull(), OLD).otherwise(out.otherwise(OLD))


def complexity_fit(cyclomatic: Column | str, intent: Column | str) -> Column:
    ideal = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in IDEAL.items() for x in kv]), col(intent)), F.lit(IDEAL_DEFAULT))
    return F.greatest(F.lit(0.0), 1 - F.abs(col(cyclomatic) - ideal) / ideal)


def quality(readability: Column, documentation: Column, duplication: Column, performance: Column, coverage: Column | None = None) -> Column:
    """Mean of the scores given; risks count as what they leave."""
    parts = [readability, documentation, 1 - duplication, 1 - performance]
    total = sum(parts, F.lit(0.0))
    if coverage is None:
        return total / len(parts)
    return F.when(coverage.isNull(), total / len(parts)).otherwise((total + coverage) / (len(parts) + 1))


def composite(strategy: Column | str, scores: dict[str, Column]) -> Column:
    """Weighted sum of the criteria, 0..1; an unknown strategy is relevance."""
    total = lambda w: sum((scores[c] * x for c, x in zip(CRITERIA, w, strict=True)), F.lit(0.0))
    out = None
    for name, weights in WEIGHTS.items():
        if name != "relevance":
            out = F.when(col(strategy) == name, total(weights)) if out is None else out.when(col(strategy) == name, total(weights))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out.otherwise(total(WEIGHTS["relevance"]))))


def adjusted(score: Column, intent: Column | str, path: Column | str, content: Column | str, readability: Column, documentation: Column) -> Column:
    """Boosts and penalties by intent: tests and documentation for examples, quality for analysis, error handling for debugging."""
    text = F.coalesce(col(content), F.lit(""))
    tests = F.contains(col(path), F.lit("test")) | has_any(text, ("test", "spec"))
    factor = F.when(col(intent) == "find_examples", F.when(tests, 1.3 * 0.8).otherwise(1.0) * F.when(documentation < 0.2, 0.8 * 0.7).otherwise(1.0))
    factor = factor.when((col(intent) == "analyze_quality") & (readability > 0.8), 1.5).when((col(intent) == "debug_issue") & has_any(text, ("try", "catch", "error")), 1.4 * 0.9).otherwise(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * factor))


def normalised(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Scores stretched to 0..1 within a group, as they are where all are equal; below LEAST cut. The ends of a group are
    found by partial aggregation, so that a group of any size is spread over tasks."""
    own = staged(df)
    ends = own.groupBy(*group).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    both = own.join(small(ends), group)
    stretched = F.when(F.col("__hi") > F.col("__lo"), (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.col(score))
    return both.withColumn(score, stretched).filter(F.round(score, 9) >= LEAST).drop("__lo", "__hi")


def temporal(df: DataFrame, group: list[str], ts: str, order: list) -> DataFrame:
    """Of each quarter the first max(1, hits // quarters) hits of a group, in the given order."""
    own = staged(df.withColumn("__q", F.year(ts) * 4 + F.quarter(ts)))
    quarters = own.groupBy(*group, "__q").agg(F.count("*").alias("__n"))
    most = quarters.groupBy(*group).agg(F.sum("__n").alias("__all"), F.count("*").alias("__quarters")).select(*group, F.greatest(F.lit(1), F.expr("__all div __quarters")).alias("__most"))
    ranked = own.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "__q").orderBy(*order)))
    return ranked.join(small(most), group).filter(F.col("__n") <= F.col("__most")).drop("__q", "__most", "__n")


def selected(hits: DataFrame, least: float = 0.6, quality: float | None = None, complexity: tuple[int, int] | None = None, types: list[str] | None = None, patterns: list[str] | None = None, without_smells: list[str] | None = None, layers: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, since=None, until=None, coverage: float | None = None) -> DataFrame:
    """Hits that pass all filters given: readability (0..1) of at least ``quality``, cyclomatic complexity within two
    bounds, one of the types, any of the patterns, none of the smells, one of the layers, a path that matches any of
    ``include`` and none of ``exclude``, changed between two times, an estimated test coverage; then a score of at least
    ``least``. ``hits`` has score, file_path, hit_ts and what is asked for among readability, cyclomatic, kind, patterns,
    smells, coverage; what is null passes no filter on it."""
    keep = [F.col("score") >= least]
    some = lambda given: F.lit(list(given))
    if quality is not None:
        keep.append(F.col("readability") >= quality)
    if complexity is not None:
        keep.append(F.col("cyclomatic").between(*complexity))
    if types:
        keep.append(F.col("kind").isin(*types))
    if patterns:
        keep.append(F.arrays_overlap("patterns", some(patterns)))
    if without_smells:
        keep.append(~F.arrays_overlap("smells", some(without_smells)))
    if layers:
        keep.append(layer("file_path").isin(*layers))
    any_path = lambda given: functools.reduce(Column.__or__, [path_matches("file_path", p, substring=True) for p in given])
    if include:
        keep.append(any_path(include))
    if exclude:
        keep.append(~any_path(exclude))
    if since is not None:
        keep.append(F.col("hit_ts") >= F.lit(since))
    if until is not None:
        keep.append(F.col("hit_ts") <= F.lit(until))
    if coverage is not None:
        keep.append(F.col("coverage") >= coverage)
    return hits.filter(functools.reduce(Column.__and__, keep))


def alternatives(top: DataFrame, group: list[str], most: int = 3, low: float = 0.6, high: float = 0.9) -> DataFrame:
    """(group.., hit_id, other, similarity, other_files, other_type, prefer) for each of the ``top`` hits of a group the
    first ``most`` others, in their order, that do alike in another way: a similarity between ``low`` and ``high``.

    Similarity adds 0.45 for the same file or 0.15 for the same folder, 0.3 for the same type and up to 0.45 for scores
    within 0.3. ``top`` has hit_id, place, file_path, kind, score, readability (0..1), and is bounded by its limit of
    hits to a group, so pairs are few."""
    cols = ("hit_id", "place", "file_path", "kind", "score", "readability")
    a = top.select(*group, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = top.select(*group, *[F.col(c).alias(f"b_{c}") for c in cols])
    folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    same = F.col("a_file_path") == F.col("b_file_path")
    near = F.when(same, 0.45).when(folder("a_file_path") == folder("b_file_path"), 0.15).otherwise(0.0)
    score = near + F.when(F.col("a_kind") == F.col("b_kind"), 0.3).otherwise(0.0) + F.greatest(F.lit(0.0), 0.3 - F.abs(F.col("a_score") - F.col("b_score"))) * 1.5
    both = a.join(b, group).filter("a_hit_id <> b_hit_id").withColumn("similarity", F.round(score, 6)).filter((F.col("similarity") > low) & (F.col("similarity") < high))
    ranked = both.withColumn("__n", F.row_number().over(Window.partitionBy(*group, "a_hit_id").orderBy("b_place"))).filter(F.col("__n") <= most)
    better = F.col("b_readability") - F.col("a_readability")
    prefer = named_when((("quality", better > 0.1), ("simplicity", better < -0.1)), "another approach")
    return ranked.select(*group, F.col("a_hit_id").alias("hit_id"), F.col("b_hit_id").alias("other"), "similarity", (~same).alias("other_files"), (F.col("a_kind") != F.col("b_kind")).alias("other_type"), prefer.alias("prefer"))


def greedy(hits: DataFrame, limit: int = 20, per_file: int = 3, per_function: int = 2, patterns: int = 5, per_layer: int = 3, layers_after: int = 8) -> DataFrame:
    """Greedy pick in the order of ``place``: (query_id, hit_id, kept), kept from 1.

    A hit is passed over if its file has ``per_file`` already or its function ``per_function``, if more than ``patterns``
    pattern hits were kept and all its patterns were seen, or if its layer has ``per_layer`` once more than ``layers_after`` were
    kept. What is passed over uses nothing up. ``hits``: query_id, hit_id, place, file_path, function, layer, patterns
    (array). Rows come sorted by query and place and are streamed, so a query of any size holds only what it kept.
    """
    rows = hits.select("query_id", "hit_id", "place", "file_path", "function", "layer", F.array_join("patterns", "|").alias("patterns"))
    rows = rows.repartition("query_id").sortWithinPartitions("query_id", "place")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query: object = object()
        files: dict = {}
        functions: dict = {}
        layer_counts: dict = {}
        seen: set = set()
        kept = of_pattern = 0
        for part in parts:
            out = []
            for q, h, f, g, layer, p in part[["query_id", "hit_id", "file_path", "function", "layer", "patterns"]].itertuples(index=False):
                if q != query:
                    query, files, functions, layer_counts, seen, kept, of_pattern = q, {}, {}, {}, set(), 0, 0
                own = set(p.split("|")) if p else set()
                if kept >= limit or files.get(f, 0) >= per_file or functions.get(g, 0) >= per_function:
                    continue
                if own and of_pattern > patterns and own <= seen:
                    continue
                if kept > layers_after and layer_counts.get(layer, 0) >= per_layer:
                    continue
                kept += 1
                of_pattern += bool(own)
                seen |= own
                for counts, key in ((files, f), (functions, g), (layer_counts, layer)):
                    counts[key] = counts.get(key, 0) + 1
                out.append((q, h, kept))
            yield pd.DataFrame(out, columns=["query_id", "hit_id", "kept"])

    return rows.mapInPandas(run, "query_id string, hit_id long, kept long")


def explained(score: Column) -> Column:
    """A word for a score."""
    return named_when((("Excellent match", score >= 0.8), ("Good match", score >= 0.6), ("Moderate match", score >= 0.3)), "Weak match")


def reason(place: Column, score: Column, intent: Column) -> Column:
    """A sentence or two on the place of a hit: its similarity, and what its query was after."""
    level = F.when(score > 0.8, "high").when(score > 0.6, "good").otherwise("moderate")
    aim = F.when(intent == "find_examples", "It appears to be a good example implementation").when(intent == "debug_issue", "It contains relevant error handling or debugging code").when(intent == "find_patterns", "It demonstrates relevant design patterns").when(intent == "analyze_quality", "It provides code suitable for quality analysis").otherwise("It contains relevant implementation code")
    return F.concat(F.lit("This result ranks #"), place.cast("string"), F.lit(" with "), level, F.lit(" semantic similarity to your query. "), aim, F.lit("."))
