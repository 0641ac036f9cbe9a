"""Nearest vectors of a set of query vectors, and spreading hits over files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that one pass over all vectors compares.
BLOCK = 2048


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, ident: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query, ident, score): of each query vector the ``k`` vectors with the highest cosine, ties by smaller ident.

    Exact. Queries are taken in blocks of bounded size, each sent to all tasks; a task keeps k candidates for each
    query of the block, so what is shuffled depends on tasks x queries x k, not on pairs. Vectors that are null, empty,
    of another length than the query, or of zero length, have no score; NaN scores are left out.
    """
    spark = vectors.sparkSession
    asked = queries.filter(F.col(embedding).isNotNull()).select(F.col(ident).cast("long").alias("q"), F.col(embedding).cast("array<double>").alias("v"))
    n = asked.count()
    own = vectors.filter(F.col(embedding).isNotNull()).select(F.col(ident).cast("long").alias("i"), F.col(embedding).cast("array<double>").alias("v"))
    out = None
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        part = own.mapInArrow(_near([(r.q, r.v) for r in rows], k, least), "query long, id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    best = (out if out is not None else spark.createDataFrame([], "query long, id long, score double")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return best.select("query", F.col("id").alias(ident), "score", "place")


def _near(asked: list[tuple[int, list[float]]], k: int, least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for _, v in asked if v}:
            some = [(q, v) for q, v in asked if len(v) == size]
            m = np.array([v for _, v in some], np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                by[size] = (np.array([q for q, _ in some], np.int64), m / np.linalg.norm(m, axis=1, keepdims=True))
        for batch in batches:
            column = batch.column("v")
            sizes, ids = column.value_lengths().to_numpy(), batch.column("i").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for size, (q, m) in by.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows):
                    continue
                v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = m @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
                low = np.where(np.isnan(scores), -np.inf, scores)
                for j in range(len(q)):
                    order = np.lexsort((ids[rows], -low[j])) if len(rows) <= 4 * k else _first(low[j], ids[rows], k)
                    order = order[:k]
                    order = order[(low[j][order] > -np.inf) & ((least is None) | (low[j][order] >= (least or 0)))]
                    out.append((np.full(len(order), q[j]), ids[rows][order], low[j][order]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "id", "score"])

    return run


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best by score, then id, with all ties at the edge considered."""
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    some = np.flatnonzero(scores >= edge)
    return some[np.lexsort((ids[some], -scores[some]))]


def two_rounds(hits: DataFrame, group: list[str], file: list[str], score: str, tie: list[str], limit: int, most_per_file: int | None = None) -> DataFrame:
    """At most ``limit`` hits to a group: first the best hit of each of the best half of the files, then the rest by
    score, at most ``most_per_file`` of a file. Adds ``place``."""
    order = [F.col(score).desc(), *tie]
    in_file = hits.withColumn("__in_file", F.row_number().over(Window.partitionBy(*group, *file).orderBy(*order)))
    if most_per_file:
        in_file = in_file.filter(F.col("__in_file") <= most_per_file)
    # whatever is kept is among the best files or the best hits; both are cut in each task before they are shuffled
    by_group = Window.partitionBy(*group)
    heads = in_file.filter("__in_file = 1").withColumn("__n", F.row_number().over(by_group.orderBy(*order))).filter(F.col("__n") <= (limit + 1) // 2).withColumn("__first", F.lit(True))
    best = in_file.withColumn("__n", F.row_number().over(by_group.orderBy(*order))).filter(F.col("__n") <= limit).withColumn("__first", F.lit(False))
    both = heads.unionByName(best).withColumn("__once", F.row_number().over(Window.partitionBy(*group, *file, "__in_file").orderBy(F.col("__first").desc()))).filter("__once = 1")
    kept = both.withColumn("__n", F.row_number().over(by_group.orderBy(F.col("__first").desc(), *order))).filter(F.col("__n") <= limit)
    return kept.withColumn("place", F.row_number().over(by_group.orderBy(*order))).drop("__in_file", "__first", "__n", "__once")
