"""An inverted index over vectors: each lies in the list of its nearest centre, and a query looks into a few lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that the centres are fitted on, most lists, rounds of fitting; share of the nearest to be found, and queries
#: on which the lists that takes are measured.
SAMPLE, LISTS, ROUNDS, TARGET, ASKED = 20_000, 1024, 12, 0.97, 500


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _sampled(vectors: DataFrame, sample: int, seed: int, ident: str, embedding: str) -> np.ndarray:
    """At most ``sample`` vectors, those with the least hash of their ident, of the length most of them have, as unit vectors."""
    own = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0)).select(F.col(embedding).cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), ident).alias("h"))
    rows = [r.v for r in own.orderBy("h").limit(sample).select("v").collect()]
    if not rows:
        return np.zeros((0, 0))
    counts = np.bincount([len(v) for v in rows])
    return _unit(np.nan_to_num(np.array([v for v in rows if len(v) == counts.argmax()], np.float64)))


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 42, ident: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Centres of ``lists`` lists (the root of the sample's size if not given, LISTS at most), by spherical k-means on
    at most ``sample`` vectors; vectors of another length than most are passed over."""
    m = _sampled(vectors, sample, seed, ident, embedding)
    if not len(m):
        return m
    rng = np.random.default_rng(seed)
    k = min(len(m), lists or min(LISTS, max(1, round(len(m) ** 0.5))))
    centres = m[rng.choice(len(m), k, replace=False)]
    for _ in range(ROUNDS):
        at = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, m)
        empty = np.bincount(at, minlength=k) == 0
        centres = np.where(empty[:, None], centres, _unit(sums))
    return centres


def probes_for(vectors: DataFrame, centres: np.ndarray, k: int, target: float = TARGET, asked: int = ASKED, sample: int = SAMPLE, seed: int = 43, ident: str = "vec_id", embedding: str = "embedding") -> int:
    """How many lists a query must look into to find ``target`` of its ``k`` nearest, measured on at most ``sample``
    vectors of which ``asked`` are the queries. Vectors that cluster need few, those spread at random most lists."""
    m = _sampled(vectors, sample, seed, ident, embedding)
    if not len(m) or not len(centres) or m.shape[1] != centres.shape[1]:
        return 1
    at, q = np.argmax(m @ centres.T, axis=1), m[:asked]
    near = np.argsort(-(q @ m.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each list for each query
    needed = np.sort(np.take_along_axis(place, at[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def indexed(vectors: DataFrame, centres: np.ndarray, ident: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(list, ident, embedding) of every vector; one that has no length or another one than the centres lies in list -1,
    where no query looks. Write it partitioned or bucketed by ``list``: a search then reads its lists only."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            at = np.full(batch.num_rows, -1, np.int32)
            rows = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == centres.shape[1]) if len(centres) else np.zeros(0, np.int64)
            if len(rows):
                v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
                good = np.isfinite(v).all(axis=1) & (np.linalg.norm(np.nan_to_num(v), axis=1) > 0)
                at[rows[good]] = np.argmax(_unit(v[good]) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("i"), column], ["list", ident, embedding])

    own = vectors.filter(F.col(embedding).isNotNull()).select(F.col(ident).cast("long").alias("i"), F.col(embedding).cast("array<double>").alias("v"))
    return own.mapInArrow(assign, f"list int, {ident} long, {embedding} array<double>")


def search(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, ident: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query, ident, score, place): of each query the ``k`` nearest in the ``probes`` lists of the nearest centres.
    ``probes`` of all lists is exact.

    Each query is sent to its lists and joined there by an equi-join, so that neither is gathered on the driver; scores
    are computed in the JVM, and each task keeps k rows for a query before they are shuffled."""
    top = max(1, min(probes, len(centres)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, v in zip(batch.column("query").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if len(centres) and len(v) == centres.shape[1] and np.isfinite(v).all() and (n := float(np.linalg.norm(v))) > 0:
                    u = np.asarray(v) / n
                    out += [(q, int(x), u.tolist()) for x in np.argsort(-(centres @ u), kind="stable")[:top]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.float64())), strict=True)], ["query", "list", "v"])

    asked = queries.filter(F.col(embedding).isNotNull()).select(F.col(ident).cast("long").alias("query"), F.col(embedding).cast("array<double>").alias("v"))
    asked = asked.mapInArrow(probe, "query long, list int, v array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = index.filter("list >= 0").join(asked, "list")
    score = total(F.zip_with("v", embedding, lambda a, b: a * b)) / F.sqrt(total(F.transform(embedding, lambda x: x * x)))
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), ident)
    scored = both.select("query", ident, score.alias("score")).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return scored.select("query", ident, "score", "place")


def recall(found: DataFrame, exact: DataFrame, ident: str = "vec_id") -> DataFrame:
    """(query, wanted, found, recall): how many of the exact answers to each query were found."""
    hit = exact.select("query", ident).join(found.select("query", ident, F.lit(1).alias("hit")), ["query", ident], "left")
    by = hit.groupBy("query").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return by.withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))
