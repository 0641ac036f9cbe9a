"""Cutting oversized chunks at natural boundaries, by recursive bisection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.sources.tables import clean_path

#: Strength of the boundary after a line: blank line, end of a block, end of a statement, any other line, inside a line.
BLANK, BLOCK, STATEMENT, LINE, IN_STATEMENT, IN_WORD = 6.0, 4.0, 3.0, 1.0, 0.6, 0.3
_BLOCK_END = re.compile(r"^\s*(\}[\s;,)]*|\]\s*[;,]?|\)\s*[;,]?|end;?)\s*$")
_STATEMENT_END = re.compile(r"[;,:.{}]\s*$|(?<=\))\s*$")


@dataclass(slots=True)
class Unit:
    """A line, or a stretch of a line that alone is over the limit; ``line`` counts from 0."""

    text: str
    line: int
    after: float


def count_lines(content: Column) -> Column:
    """Number of ``\\n``, plus one if the content does not end in one."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return breaks + F.when(content.endswith("\n"), 0).otherwise(1)


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunks`` with max_lines, max_chars, overlap_lines of their language in any letter case, those of ``*`` for
    every other or none. The limits table is a dimension of a few rows."""
    named = limits.filter("lang <> '*'").groupBy(F.lower("lang").alias("__lang")).agg(F.min(F.struct("max_lines", "max_chars", "overlap_lines")).alias("__own"))
    other = limits.filter("lang = '*'").agg(F.min(F.struct("max_lines", "max_chars", "overlap_lines")).alias("__any"))
    found = chunks.join(F.broadcast(named), F.lower(F.trim(F.col("metadata.lang"))) == F.col("__lang"), "left").join(F.broadcast(other))
    for c in ("max_lines", "max_chars", "overlap_lines"):
        found = found.withColumn(c, F.coalesce(f"__own.{c}", f"__any.{c}"))
    return found.drop("__own", "__any", "__lang")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks with more lines or more characters than their language allows, with the limits. Null contents are not."""
    both = with_limits(chunks, limits)
    return both.filter(F.col("content").isNotNull() & ((count_lines(F.col("content")) > F.col("max_lines")) | (F.length("content") > F.col("max_chars"))))


def split_oversized(chunks: DataFrame, limits: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Pieces (chunk_id, piece, start_line, end_line, start_char, content) of each chunk over the limits of its language.

    Joined without their overlaps the pieces give the content. Each piece but the first starts ``overlap_lines`` lines
    before the last one ended; fewer only where those lines do not fit into ``max_chars`` beside the piece's own, and
    none where the cut lies inside a line. Lines over ``max_chars`` are cut inside, at ends of statements or at blanks
    where there are any; pieces of one line share its number. ``start_char`` is the offset in the content.

    Line numbers: a null ``start_line`` is taken from ``end_line``, else from 0. With ``files`` (snapshot_id, path,
    content: whole texts) numbers are put right by finding the chunk in its file, at the place nearest the stated one.
    Exact copies of a chunk are cut once.
    """
    big = oversized(chunks.select("chunk_id", "snapshot_id", clean_path("file_path").alias("path"), "start_line", "end_line", "content", "metadata"), limits)
    big = big.drop("metadata").dropDuplicates(["chunk_id"])
    if files is not None:
        big = big.join(files.select("snapshot_id", "path", F.col("content").alias("whole")), ["snapshot_id", "path"], "left")
    else:
        big = big.withColumn("whole", F.lit(None).cast("string"))
    cols = ("chunk_id", "start_line", "end_line", "content", "max_lines", "max_chars", "overlap_lines", "whole")
    return big.select(*cols).mapInArrow(_cut_all, "chunk_id string, piece int, start_line int, end_line int, start_char int, content string")


def units(content: str, max_chars: int) -> list[Unit]:
    """Lines of ``content`` with the strength of the boundary after each; lines over ``max_chars`` in stretches."""
    lines = content.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    out: list[Unit] = []
    for i, line in enumerate(lines):
        if not line.strip():
            after = BLANK
        elif i + 1 < len(lines) and not lines[i + 1].strip():
            after = STATEMENT  # the blank line itself stays with what precedes it
        elif _BLOCK_END.match(line):
            after = BLOCK
        else:
            after = STATEMENT if _STATEMENT_END.search(line) else LINE
        if len(line) <= max_chars:
            out.append(Unit(line, i, after))
        else:
            parts = _stretches(line, max_chars)
            out += [Unit(x, i, s) for x, s in parts[:-1]] + [Unit(parts[-1][0], i, after)]
    return out


def _stretches(line: str, most: int) -> list[tuple[str, float]]:
    """``line`` in parts of at most half of ``most``, cut after ``;`` or ``}``, else after a blank, ``,`` or ``>``, else anywhere."""
    out: list[tuple[str, float]] = []
    step = max(1, most // 2)
    at = 0
    while len(line) - at > step:
        window = line[at : at + step]
        strength = IN_STATEMENT
        end = max(window.rfind(";"), window.rfind("}"))
        if end < step // 4:
            end, strength = max(window.rfind(" "), window.rfind(","), window.rfind(">")), IN_WORD
        if end < step // 4:
            end, strength = step - 1, 0.1
        if at + end + 1 < len(line) and line[at + end] == "\r":
            end = max(0, end - 1)
        out.append((line[at : at + end + 1], strength))
        at += end + 1
    out.append((line[at:], 0.1))
    return out


def bisect(parts: list[Unit], max_lines: int, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first unit with overlap, first own unit, end unit exclusive) of each piece of ``parts``."""
    chars = [0, *accumulate(len(u.text) for u in parts)]

    def size(a: int, b: int) -> tuple[int, int]:
        return parts[b - 1].line - parts[a].line + 1, chars[b] - chars[a]

    def lead(a: int) -> int:
        """The unit at which a piece whose own units begin at ``a`` starts."""
        if a == 0 or parts[a].line == parts[a - 1].line:
            return a
        b = a
        while b > 0 and parts[a].line - parts[b - 1].line <= overlap and parts[b - 1].text.endswith("\n") and (b < 2 or parts[b - 2].line != parts[b - 1].line):
            b -= 1
        return b

    def fits(a: int, b: int, start: int) -> bool:
        n, m = size(start, b)
        return n <= max_lines and m <= max_chars

    own: list[tuple[int, int]] = []
    todo = [(0, len(parts))]
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or fits(a, b, lead(a)):
            own.append((a, b))
            continue
        middle, half = (chars[a] + chars[b]) / 2, max(1.0, (chars[b] - chars[a]) / 2)
        if size(a, b)[0] > max_lines and (lines := size(a, b)[0]) / max_lines > (chars[b] - chars[a]) / max_chars:
            position = lambda i: abs(parts[i].line - parts[a].line - lines / 2) / (lines / 2)
        else:
            position = lambda i: abs(chars[i] - middle) / half
        cut = max(range(a + 1, b), key=lambda i: (parts[i - 1].after * max(0.02, 1 - 1.6 * position(i)), -position(i)))
        todo += [(cut, b), (a, cut)]  # the left half comes next, so pieces come in order
    out = []
    for a, b in own:
        start = lead(a)
        while start < a and not fits(a, b, start):
            start += 1
        out.append((start, a, b))
    return out


def place(content: str, whole: str | None, start: int | None, end: int | None) -> int:
    """The line of its file at which ``content`` starts."""
    n = content.count("\n") + (not content.endswith("\n"))
    stated = start if start is not None else end - n + 1 if end is not None else 0
    if whole is not None:
        text, part = whole.replace("\r\n", "\n"), content.replace("\r\n", "\n")
        best, at = None, text.find(part)
        while at >= 0:
            if at == 0 or text[at - 1] == "\n":
                line = text.count("\n", 0, at)
                if best is None or abs(line - stated) < abs(best - stated):
                    best = line
                elif line > stated:
                    break
            at = text.find(part, at + 1)
        if best is not None:
            return best
    return max(0, stated)


def cut(content: str, max_lines: int, max_chars: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(first line, last line, offset, text) of the pieces of ``content``, lines counted from 0."""
    max_lines, max_chars = max(1, max_lines), max(1, max_chars)
    overlap = max(0, min(overlap, max_lines - 1))
    parts = units(content, max_chars)
    chars = [0, *accumulate(len(u.text) for u in parts)]
    return [(parts[s].line, parts[b - 1].line, chars[s], content[chars[s] : chars[b]]) for s, _, b in bisect(parts, max_lines, max_chars, overlap)]


def _cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            base = place(r["content"], r["whole"], r["start_line"], r["end_line"])
            rows += [(r["chunk_id"], i, base + a, base + b, at, text) for i, (a, b, at, text) in enumerate(cut(r["content"], r["max_lines"], r["max_chars"], r["overlap_lines"]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["chunk_id", "piece", "start_line", "end_line", "start_char", "content"])
