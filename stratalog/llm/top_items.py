"""The best N items of every group, by a loser-tree merge of sorted runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEPT = ("__g", "__limit", "__score", "__id")


def top_items(items: DataFrame, group: list[str], score: str, item: str, limit: str) -> DataFrame:
    """Of each group the ``limit`` items (a column of the group; null or below 1 keeps none) with the highest score.

    Ties go to the smaller ``item`` (a unique long). Rows with a null or NaN score or a null item are never kept; null
    group values form a group of their own. Returns group.., score, item.

    1. Runs: the rows as they lie over the tasks are sorted by group, score and item within each task, and each run
       seeks to its next group after ``limit`` outputs. A group of any size is thus spread over all tasks, and at most
       ``limit`` rows of it leave each.
    2. Merge: the runs of a group meet in one task, sorted by run; a loser tree over the heads of the runs gives the
       best row again and again and seeks to the next group after ``limit`` outputs. A task holds at most
       limit x runs rows of one group.
    """
    ok = items.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(item).isNotNull() & (F.col(limit) >= 1))
    g = F.struct(*[F.col(c) for c in group])
    rows = ok.select(g.alias("__g"), F.col(limit).cast("int").alias("__limit"), F.col(score).cast("double").alias("__score"), F.col(item).cast("long").alias("__id"))
    runs = rows.sortWithinPartitions("__g", F.col("__score").desc(), "__id").mapInArrow(_run, _with_key(rows, run=True))
    keyed = runs.repartition("__g").sortWithinPartitions("__g", "__run", F.col("__score").desc(), "__id")
    best = keyed.mapInArrow(_merge, _with_key(rows, run=False))
    return best.select(*[F.col(f"__g.{c}").alias(c) for c in group], F.col("__score").alias(score), F.col("__id").alias(item))


def _with_key(rows: DataFrame, run: bool) -> str:
    return f"__g {rows.schema['__g'].dataType.simpleString()}, __limit int, __score double, __id long" + ", __run int" * run


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one sorted run that can be among the best: the first ``limit`` of each group."""
    from pyspark import TaskContext

    me = TaskContext.get().partitionId()
    last, n = None, 0  # the group that the batch before ended in, and how many of its rows came
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column("__g")
        new = np.ones(batch.num_rows, bool)
        new[1:] = False
        for field in groups.flatten():
            codes = field.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        place = np.arange(batch.num_rows) - starts[np.cumsum(new) - 1]
        if groups[0].as_py() == last:
            place[: starts[1] if len(starts) > 1 else None] += n
        last, n = groups[-1].as_py(), int(place[-1]) + 1
        out = batch.take(pa.array(np.flatnonzero(place < batch.column("__limit").to_numpy())))
        yield out.append_column("__run", pa.array(np.full(out.num_rows, me, np.int32)))


class LoserTree:
    """A tournament over sorted runs: the winner is the least head; each inner node holds the loser of its match."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k - 1, -1, -1):
            self._play(i)

    def _head(self, i: int) -> tuple | None:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _before(self, i: int, j: int) -> bool:
        a, b = self._head(i), self._head(j)
        return b is None or (a is not None and a <= b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1:
                self.losers[node] = i
                return
            if self._before(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def pop(self) -> tuple | None:
        """The least row left, or None."""
        win = self.losers[0] if self.k > 1 else 0
        row = self._head(win)
        if row is not None:
            self.at[win] += 1
            if self.k > 1:
                self._play(win)
        return row


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []
    kind = None
    key, limit, runs, last = None, 0, [], None

    def close() -> None:
        if len(runs) == 1:
            best = runs[0][:limit]
        else:
            tree, best = LoserTree(runs), []
            while len(best) < limit and (row := tree.pop()) is not None:
                best.append(row)
        kept.extend((key, limit, -score, item) for score, item in best)

    for batch in batches:
        kind = batch.schema.field("__g").type
        for g, most, score, item, run in zip(*[batch.column(c).to_pylist() for c in (*_KEPT, "__run")], strict=True):
            if g != key or not runs:
                if runs:
                    close()
                key, limit, runs, last = g, most, [], None
            if run != last:
                runs.append([])
                last = run
            runs[-1].append((-score, item))
        if len(kept) > 20_000:
            yield _batch(kept, kind)
            kept = []
    if runs:
        close()
    if kept:
        yield _batch(kept, kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int32(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(_KEPT))
