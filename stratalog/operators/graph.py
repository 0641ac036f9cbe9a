"""Edges between chunks by the names they use, and reach over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.code import calls
from stratalog.functions.text import ascii_words
from stratalog.session import staged

#: Strength of an edge for each use, and its most; confidence; depth to which dependencies are followed.
CALL, CALL_MOST, USE, USE_MOST, EXTENDS, IMPORTS, DEPTH = 0.2, 1.0, 0.1, 0.8, 0.9, 0.8, 3
EDGE = ("src", "dst", "rel", "strength", "confidence")


def _names(chunks: DataFrame) -> DataFrame:
    """(snapshot_id, chunk_id, name): the symbols that a chunk defines."""
    return chunks.select("snapshot_id", "chunk_id", F.explode(F.array_distinct("symbols")).alias("name")).filter("name is not null and name <> ''")


def _edges(used: DataFrame, defined: DataFrame, rel: str, strength, confidence: float) -> DataFrame:
    """Equi-join of names used (snapshot_id, src, name, n) and defined, within a snapshot; a chunk is not joined to itself."""
    both = used.join(defined.select("snapshot_id", F.col("chunk_id").alias("dst"), "name"), ["snapshot_id", "name"]).filter("src <> dst")
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n")).select("src", "dst", F.lit(rel).alias("rel"), strength.alias("strength"), F.lit(confidence).alias("confidence"))


def call_edges(chunks: DataFrame) -> DataFrame:
    """A chunk calls what another of its snapshot defines; stronger by the number of calls. ``chunks``: chunk_id,
    snapshot_id, content, symbols. Calls are taken from a text once and joined by name, never text by text."""
    made = F.regexp_extract_all("content", F.lit(ascii_words(r"\b([A-Za-z_][0-9A-Za-z_]*)\s*\(")), 1)
    used = chunks.select("snapshot_id", F.col("chunk_id").alias("src"), F.explode(made).alias("name")).groupBy("snapshot_id", "src", "name").agg(F.count("*").alias("n"))
    return _edges(used, _names(chunks), "calls", F.least(F.lit(CALL_MOST), F.col("n") * CALL), 0.8)


def use_edges(chunks: DataFrame) -> DataFrame:
    """A chunk names what another defines without calling it."""
    named = F.regexp_extract_all("content", F.lit(ascii_words(r"\b([A-Za-z_][0-9A-Za-z_]*)\b(?!\s*\()")), 1)
    used = chunks.select("snapshot_id", F.col("chunk_id").alias("src"), F.explode(named).alias("name")).groupBy("snapshot_id", "src", "name").agg(F.count("*").alias("n"))
    return _edges(used, _names(chunks), "uses", F.least(F.lit(USE_MOST), F.col("n") * USE), 0.7)


def inherit_edges(chunks: DataFrame) -> DataFrame:
    """A chunk extends or implements what another defines."""
    parents = F.regexp_extract_all("content", F.lit(r"(?:extends|implements)\s+([A-Za-z_][0-9A-Za-z_]*)"), 1)
    python = F.regexp_extract_all("content", F.lit(r"class\s+[0-9A-Za-z_]+\(([A-Za-z_][0-9A-Za-z_]*)\)"), 1)
    used = chunks.select("snapshot_id", F.col("chunk_id").alias("src"), F.explode(F.concat(parents, python)).alias("name")).groupBy("snapshot_id", "src", "name").agg(F.count("*").alias("n"))
    return _edges(used, _names(chunks), "extends", F.lit(EXTENDS), 0.9)


def import_edges(chunks: DataFrame) -> DataFrame:
    """A chunk imports a module one of whose path segments is the name of another's file, three letters or more.
    ``chunks`` also has path and imports."""
    words = F.array_distinct(F.flatten(F.transform("imports", lambda x: F.regexp_extract_all(x, F.lit(r"([0-9A-Za-z_-]{3,})"), 1))))
    used = chunks.select("snapshot_id", F.col("chunk_id").alias("src"), F.explode(words).alias("name")).withColumn("n", F.lit(1))
    files = chunks.select("snapshot_id", "chunk_id", F.regexp_extract("path", r"([^/.]{3,})[^/]*$", 1).alias("name"))
    return _edges(used, files, "imports", F.lit(IMPORTS), 0.8)


def test_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst): a chunk of a test file that names a symbol of a chunk of another kind of file in its snapshot."""
    tests = F.lower("path").rlike(r"test|spec")
    named = F.array_distinct(F.regexp_extract_all("content", F.lit(ascii_words(r"\b([A-Za-z_][0-9A-Za-z_]*)\b")), 1))
    used = chunks.filter(tests).select("snapshot_id", F.col("chunk_id").alias("src"), F.explode(named).alias("name")).withColumn("n", F.lit(1))
    return _edges(used, _names(chunks.filter(~tests)), "tests", F.lit(0.7), 0.7)


def similar_edges(chunks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(src, dst, strength) of similar chunks of a snapshot, src < dst: 0.3 for the same kind, 0.2 for the same language,
    0.3 of the Jaccard similarity of symbols and 0.2 of that of words.

    With a threshold over 0.5 and no symbol in common only equal words can reach it, at exactly 0.7; so candidates are
    the pairs that share a symbol or a set of words, found by equi-joins, never all pairs. ``chunks`` also has kind and lang.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("content"), F.lit(r"([0-9a-z_]+)"), 1), lambda w: F.length(w) > 2)))
    c = staged(chunks.select("snapshot_id", "chunk_id", "kind", "lang", F.array_distinct(F.coalesce("symbols", F.array().cast("array<string>"))).alias("symbols"), words.alias("words")))
    keys = c.select("snapshot_id", "chunk_id", F.explode(F.concat(F.transform("symbols", lambda x: F.xxhash64(F.lit("s"), x)), F.array(F.xxhash64(F.lit("w"), "words")))).alias("k"))
    pairs = keys.join(keys.select("snapshot_id", F.col("chunk_id").alias("other"), "k"), ["snapshot_id", "k"]).filter("chunk_id < other").select("snapshot_id", "chunk_id", "other").distinct()
    b = c.select("snapshot_id", F.col("chunk_id").alias("other"), *[F.col(x).alias(f"o_{x}") for x in ("kind", "lang", "symbols", "words")])
    both = pairs.join(c, ["snapshot_id", "chunk_id"]).join(b, ["snapshot_id", "other"])
    jaccard = lambda x: F.when(F.size(F.array_union(x, f"o_{x}")) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, f"o_{x}")) / F.size(F.array_union(x, f"o_{x}")))
    same = lambda x, w: F.when(F.col(x).eqNullSafe(F.col(f"o_{x}")), w).otherwise(0.0)
    strength = F.round(same("kind", 0.3) + same("lang", 0.2) + jaccard("symbols") * 0.3 + jaccard("words") * 0.2, 9)
    return both.select(F.col("chunk_id").alias("src"), F.col("other").alias("dst"), strength.alias("strength")).filter(F.col("strength") >= threshold)


def file_neighbours(chunks: DataFrame) -> DataFrame:
    """(src, dst): a chunk and the one that follows it in its file, an edge of context."""
    from pyspark.sql import Window

    w = Window.partitionBy("snapshot_id", "path").orderBy("start_line", "chunk_id")
    return chunks.filter("start_line is not null").select(F.col("chunk_id").alias("src"), F.lead("chunk_id").over(w).alias("dst")).filter("dst is not null")


def statistics(edges: DataFrame) -> DataFrame:
    """(rel, edges, mean_strength, sources, targets) by kind."""
    return edges.groupBy("rel").agg(F.count("*").alias("edges"), F.round(F.avg("strength"), 6).alias("mean_strength"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming)."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def strongest(edges: DataFrame) -> DataFrame:
    """The strongest edge of each chunk, ties by kind and target."""
    best = F.min_by(F.struct("rel", "dst", "strength"), F.struct(-F.col("strength"), "rel", "dst"))
    return edges.groupBy("src").agg(best.alias("b")).select("src", "b.rel", "b.dst", "b.strength")


def reach(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(src, dst, hops): what each chunk depends on in at most ``depth`` steps, by the fewest. Pairs known are not
    followed again; each step is staged. A chunk that a part of all use or that uses a part of all makes pairs of its
    own, which are the answer, not candidates."""
    pairs = staged(edges.select("src", "dst").distinct())
    known = pairs.withColumn("hops", F.lit(1))
    front = known
    for n in range(2, depth + 1):
        step = front.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").filter("src <> next").select("src", F.col("next").alias("dst")).distinct()
        front = staged(step.join(known, ["src", "dst"], "left_anti").withColumn("hops", F.lit(n)))
        known = known.unionByName(front)
    return known


__all__ = ["call_edges", "calls", "degrees", "file_neighbours", "import_edges", "inherit_edges", "reach", "similar_edges", "statistics", "strongest", "test_edges", "use_edges"]
