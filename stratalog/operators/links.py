"""Edges found from the text of chunks: imports by resolved path, calls and parents by definition, nesting, and the
weighted graph of one file. All within a snapshot, by equi-joins on names or paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import ascii_words

# Strength and confidence by kind of edge; weights, most and least of a dependency within a file, and the
# lines over which nearness counts.
KINDS = {"imports": (0.8, 0.9), "calls": (0.7, 0.7), "extends": (0.9, 0.85), "implements": (0.8, 0.8), "uses": (0.5, 0.6)}
REFERRED, COMMON, NEAR, NEAR_LINES, CALL, CALL_MOST, LEAST, CONFIDENT = 0.5, 0.1, 0.2, 100, 0.1, 0.4, 0.1, 0.3


def stem(path: Column) -> Column:
    """A path without its extension."""
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def resolved_import(name: Column, path: Column, lang: Column) -> Column:
    """The path that an import names: a relative one from the folder of the importing file, a dotted Python module by
    folders, any other as it is; without extension."""
    up = (F.length(F.regexp_extract(name, r"^((?:\.\./)*)", 1)) / 3).cast("int")
    rest = F.regexp_replace(name, r"^(?:\./|(?:\.\./)+)", "")
    folders = F.filter(F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/"), lambda x: x != "")
    relative = F.array_join(F.concat(F.slice(folders, 1, F.greatest(F.size(folders) - up, F.lit(0))), F.array(rest)), "/")
    dotted = (lang == "python") & ~F.contains(name, F.lit("/"))
    return F.when(name.rlike(r"^\.\.?/"), stem(relative)).when(F.coalesce(dotted, F.lit(False)), F.regexp_replace(name, r"\.", "/")).otherwise(stem(name))


def _edges(pairs: DataFrame, rel: str) -> DataFrame:
    """Each pair of different chunks once."""
    strength, sure = KINDS[rel]
    return pairs.filter("src <> dst").select("src", "dst").distinct().withColumns({"rel": F.lit(rel), "strength": F.lit(strength), "confidence": F.lit(sure)})


def imported(chunks: DataFrame) -> DataFrame:
    """A chunk imports the chunks of a file whose path is the resolved one, or ends in it, or the other way round. Both
    have the same last name, by which they are joined. A null or empty import names nothing."""
    named = chunks.select("snapshot_id", F.col("chunk_id").alias("src"), "path", "lang", F.explode("imports").alias("name")).filter("name is not null and name <> ''")
    wanted = named.select("snapshot_id", "src", resolved_import(F.col("name"), F.col("path"), F.col("lang")).alias("t"))
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    files = chunks.select("snapshot_id", F.col("chunk_id").alias("dst"), stem(F.col("path")).alias("f")).withColumn("last", last(F.col("f")))
    both = wanted.distinct().withColumn("last", last(F.col("t"))).filter("last <> ''").join(files, ["snapshot_id", "last"])
    return _edges(both.filter("t = f or endswith(t, '/' || f) or endswith(f, '/' || t)"), "imports")


def _defined(chunks: DataFrame, pattern: str, kind: str | None = None) -> DataFrame:
    """(snapshot_id, dst, name): symbols of a chunk, and what its text defines by ``pattern``."""
    own = chunks if kind is None else chunks.filter(F.col("kind") == kind)
    names = F.array_distinct(F.concat(F.coalesce("symbols", F.array().cast("array<string>")), F.regexp_extract_all("content", F.lit(pattern), 1)))
    return own.select("snapshot_id", F.col("chunk_id").alias("dst"), F.explode(names).alias("name"))


def _used(chunks: DataFrame, *patterns: str) -> DataFrame:
    names = F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(ascii_words(p)), 1) for p in patterns]))
    return chunks.select("snapshot_id", F.col("chunk_id").alias("src"), F.explode(names).alias("name")).filter("name <> ''")


def called(chunks: DataFrame) -> DataFrame:
    """A chunk calls what another defines, as a symbol or by function or def. That both call a name is no edge between them."""
    return _edges(_used(chunks, r"\b([A-Za-z_][0-9A-Za-z_]*)\s*\(").join(_defined(chunks, r"(?:function|def)\s+([A-Za-z_][0-9A-Za-z_]*)"), ["snapshot_id", "name"]), "calls")


def inherited(chunks: DataFrame) -> DataFrame:
    """A chunk extends a class, or implements an interface, of a chunk of that kind. ``chunks`` also has ``kind``."""
    parents = _used(chunks, r"\bextends\s+([A-Za-z_][0-9A-Za-z_]*)", r"\bclass\s+[0-9A-Za-z_]+\(([A-Za-z_][0-9A-Za-z_]*)\)").join(_defined(chunks, r"class\s+([A-Za-z_][0-9A-Za-z_]*)", "class"), ["snapshot_id", "name"])
    faces = _used(chunks, r"\bimplements\s+([A-Za-z_][0-9A-Za-z_]*)").join(_defined(chunks, r"interface\s+([A-Za-z_][0-9A-Za-z_]*)", "interface"), ["snapshot_id", "name"])
    return _edges(parents, "extends").unionByName(_edges(faces, "implements"))


def instantiated(chunks: DataFrame) -> DataFrame:
    """A chunk uses what another defines as a symbol: by new, or before a point."""
    return _edges(_used(chunks, r"\bnew\s+([A-Za-z_][0-9A-Za-z_]*)", r"\b([A-Za-z_][0-9A-Za-z_]*)\.").join(_defined(chunks, r"class\s+([A-Za-z_][0-9A-Za-z_]*)"), ["snapshot_id", "name"]), "uses")


def linked(chunks: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """All these edges of at least ``least`` confidence."""
    found = imported(chunks).unionByName(called(chunks)).unionByName(inherited(chunks)).unionByName(instantiated(chunks))
    return found.filter(F.col("confidence") >= least)


def nested(pieces: DataFrame) -> DataFrame:
    """(snapshot_id, path, src, dst, rel, strength) between pieces of a file (ordinal, start_line, end_line) and the one
    that holds them (parent, an ordinal): 'extends' up, 'uses' down; a piece is named start-end."""
    name = F.concat(F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    below = pieces.filter("parent is not null").select("snapshot_id", "path", F.col("parent").alias("ordinal"), name.alias("child"))
    both = below.join(pieces.select("snapshot_id", "path", "ordinal", name.alias("parent")), ["snapshot_id", "path", "ordinal"])
    edge = lambda a, b, rel, w: both.select("snapshot_id", "path", F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rel).alias("rel"), F.lit(w).alias("strength"))
    return edge("child", "parent", "extends", 0.9).unionByName(edge("parent", "child", "uses", 0.8))


def file_graph(chunks: DataFrame) -> DataFrame:
    """(src, dst, rel, strength) of chunks of one file: half for a mention of the other's name (its first symbol), a tenth
    for each common import, nearness up to a fifth within 100 lines, a tenth for each call up to 0.4; over 0.1, 1 at most.

    Nearness alone is over 0.1 only within 50 lines, so candidates are pairs within 50 lines, met in strips of lines, and
    pairs joined by a name or an import; chunks without a name or a first line have no edges."""
    nodes = chunks.select("snapshot_id", "path", "chunk_id", "start_line", F.try_element_at(F.filter("symbols", lambda x: x != ""), F.lit(1)).alias("name"), "imports", "content").filter("name is not null and start_line is not null")
    key = ["snapshot_id", "path"]
    src = nodes.select(*key, F.col("chunk_id").alias("src"), F.col("start_line").alias("a"), F.col("name").alias("own"), "imports", "content")
    dst = nodes.select(*key, F.col("chunk_id").alias("dst"), F.col("start_line").alias("b"), "name", F.col("imports").alias("theirs"))
    cols = ["src", "dst", "a", "b", "own", "name"]
    words = src.withColumn("name", F.explode(F.regexp_extract_all("content", F.lit(ascii_words(r"\b([A-Za-z_][0-9A-Za-z_]*)\b")), 1))).select(*key, "src", "a", "own", "name").distinct()
    made = src.withColumn("name", F.explode(F.regexp_extract_all("content", F.lit(ascii_words(r"\b([A-Za-z_][0-9A-Za-z_]*)\s*\(")), 1))).groupBy(*key, "src", "a", "own", "name").agg(F.count("*").alias("calls"))
    shared = src.withColumn("i", F.explode(F.array_distinct("imports"))).select(*key, "src", "a", "own", "i").join(dst.withColumn("i", F.explode(F.array_distinct("theirs"))).select(*key, "dst", "b", "name", "i"), [*key, "i"])
    strip = lambda c: F.floor(F.col(c) / (NEAR_LINES // 2))
    close = src.withColumn("strip", F.explode(F.array(strip("a") - 1, strip("a"), strip("a") + 1))).join(dst.withColumn("strip", strip("b")), [*key, "strip"]).filter(F.abs(F.col("a") - F.col("b")) < NEAR_LINES // 2)
    part = lambda df, **n: df.select(*cols, *[F.lit(n[c]).cast("long").alias(c) if not isinstance(n[c], str) else F.col(n[c]).alias(c) for c in ("referred", "calls", "common")])
    both = part(words.join(dst, [*key, "name"]), referred=1, calls=0, common=0).unionByName(part(made.join(dst, [*key, "name"]), referred=0, calls="calls", common=0))
    both = both.unionByName(part(shared, referred=0, calls=0, common=1)).unionByName(part(close, referred=0, calls=0, common=0))
    sums = both.filter("src <> dst and own <> name").groupBy(*cols).agg(F.max("referred").alias("referred"), F.sum("calls").alias("calls"), F.sum("common").alias("common"))
    near = F.greatest(F.lit(0), NEAR_LINES - F.abs(F.col("a") - F.col("b"))) / NEAR_LINES * NEAR
    strength = F.least(F.lit(1.0), F.col("referred") * REFERRED + F.col("common") * COMMON + near + F.least(F.lit(CALL_MOST), F.col("calls") * CALL))
    kept = sums.withColumn("strength", F.round(strength, 9)).filter(F.col("strength") > LEAST)
    told = src.select("src", "imports", F.regexp_extract_all("content", F.lit(r"(?:extends|implements) ([A-Za-z_][0-9A-Za-z_]*)"), 1).alias("parents"))
    kept = kept.join(told, "src")
    named = F.coalesce(F.exists("imports", lambda x: F.contains(x, F.col("name"))), F.lit(False))
    rel = F.when(F.col("calls") > 0, "calls").when(named, "imports").when(F.array_contains("parents", F.col("name")), "extends").otherwise("uses")
    return kept.select("src", "dst", rel.alias("rel"), "strength")
