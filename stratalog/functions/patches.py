"""Unified patches on texts: parse, apply, make, count."""

from __future__ import annotations

import difflib
import re

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse(diff: str) -> list[tuple[int, list[str], list[str]]]:
    """Hunks of the first file in ``diff``: (old start, old lines, new lines); lines keep no line end.

    A line followed by ``\\ No newline at end of file`` is marked by a trailing NUL.
    """
    hunks: list[tuple[int, list[str], list[str]]] = []
    need_old = need_new = 0
    last: list[list[str]] = []
    for line in diff.split("\n"):
        if line.startswith("\\"):
            for side in last:
                side[-1] += "\0"
            continue
        if need_old <= 0 and need_new <= 0:
            if m := HUNK.match(line):
                need_old, need_new = int(m[2] or 1), int(m[4] or 1)
                hunks.append((int(m[1]), [], []))
            elif hunks and line.startswith("--- "):
                break
            last = []
            continue
        _, old, new = hunks[-1]
        mark, body = line[:1], line[1:]
        last = []
        if mark != "+":
            old.append(body)
            last.append(old)
            need_old -= 1
        if mark != "-":
            new.append(body)
            last.append(new)
            need_new -= 1
    return hunks


def apply(base: str, diff: str | None) -> str | None:
    """``base`` with ``diff`` applied, both with ``\\n`` line ends; None if a hunk fits nowhere.

    No diff, an empty one or one without hunks changes nothing. A hunk that does not fit at its stated line is tried
    at the nearest line where it does.
    """
    hunks = parse(diff) if diff else []
    if not hunks:
        return base
    lines = base.split("\n")
    open_end = lines[-1] != ""
    if open_end:
        lines[-1] += "\0"
    else:
        lines.pop()
    out: list[str] = []
    at = 0
    shift = 0
    for start, old, new in hunks:
        want = (start - 1 if old else start) + shift
        want = max(at, want)
        found = _locate(lines, old, at, want)
        if found is None:
            return None
        shift += found - want
        out += lines[at:found]
        out += new
        at = found + len(old)
    out += lines[at:]
    if not out:
        return ""
    text = "\n".join(x[:-1] if x.endswith("\0") else x for x in out)
    return text if out[-1].endswith("\0") else text + "\n"


def _locate(lines: list[str], old: list[str], least: int, want: int) -> int | None:
    n = len(old)
    if not n:
        return min(want, len(lines))
    loose = [x.rstrip("\0") for x in old]
    for delta in range(max(want - least, len(lines) - want) + 1):
        for at in {want - delta, want + delta}:
            if at >= least and at + n <= len(lines) and lines[at] .rstrip("\0") == loose[0] and [x.rstrip("\0") for x in lines[at : at + n]] == loose:
                return at
    return None


def make(name: str, old: str, new: str) -> str:
    """A unified patch from ``old`` to ``new``; '' when they are equal."""
    if old == new:
        return ""
    out = []
    for line in difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), name, name):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


def ranges(diff: str) -> list[tuple[str, int, int]]:
    """(added or modified, first, last) lines of the new text that a patch touches, counted from 0: lines that stand in
    place of others are modified, the rest added."""
    out: list[tuple[str, int, int]] = []
    at = gone = need_old = need_new = 0
    run: list[int] = []

    def close() -> None:
        nonlocal gone, run
        if run:
            out.append(("modified" if gone else "added", run[0], run[-1]))
        gone, run = 0, []

    for line in diff.split("\n"):
        if need_old <= 0 and need_new <= 0:
            close()
            if m := HUNK.match(line):
                need_old, need_new = int(m[2] or 1), int(m[4] or 1)
                at = int(m[3]) - 1 if need_new else int(m[3])
            continue
        mark = line[:1]
        if mark == "\\":
            continue
        if mark == "+":
            run.append(at)
            at, need_new = at + 1, need_new - 1
        elif mark == "-":
            if run:
                close()
            gone, need_old = gone + 1, need_old - 1
        else:
            close()
            at, need_old, need_new = at + 1, need_old - 1, need_new - 1
    close()
    return out
