"""Cutting files into chunks of lines: fixed blocks, sections, and declarations with their levels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.text import lines

#: Lines to a chunk and shared with the one before, the least of each, and the block sizes used where nothing is recognised.
SIZE, OVERLAP, LEAST, BLOCK_SEMANTIC, BLOCK_CONTEXT = 200, 50, 10, 50, 40
_OUT = "snapshot_id string, path string, chunk_id string, ordinal int, parent int, level int, kind string, name string, start_line int, end_line int, content string"

# How declarations and sections begin, by language.
_SCRIPT = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?P<kind>class|interface|enum|type|function\*?|const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)"
_METHOD = r"^\s+(?:(?:public|private|protected|static|async|get|set|final|abstract|synchronized)\s+)*(?:[\w<>\[\], ?]+\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{\s*$"
DECLARATIONS = {
    "javascript": (_SCRIPT, _METHOD), "typescript": (_SCRIPT, _METHOD),
    "java": (r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)", _METHOD),
    "go": (r"^(?P<kind>func)\s+(?:\([^)]*\)\s*)?(?P<name>\w+)", r"^(?P<kind>type)\s+(?P<name>\w+)"),
}
_PYTHON = re.compile(r"^(?P<indent>\s*)(?:async\s+)?(?P<kind>def|class)\s+(?P<name>\w+)")
SECTIONS = {
    "javascript": (r"^//\s*(?i:SECTION|MARK|TODO|FIXME|[=-]{3,})", r"^(?:export\s+)?(?:class|function|const|let|var|interface|type|enum)\s+\w+", r"^/\*{1,2}"),
    "python": (r"^#\s*(?i:SECTION|MARK|TODO|FIXME|[-=*]{3,})", r"^(?:def|class|if\s+__name__\s*==\s*['\"]__main__['\"]|@\w+)"),
    "java": (r"^//\s*(?i:SECTION|MARK|TODO|FIXME|[=-]{3,})", r"^(?:public|private|protected)\s+(?:class|interface|enum)", r"^(?:public|private|protected|static|final)\s+\w+", r"^/\*{1,2}"),
    "": (r"^#{1,2}", r"^//"),
}
_NOT_METHODS = frozenset("if for while switch catch return function else do try with".split())


@dataclass
class Node:
    """A declaration: kind, name, lines from 0 (both included), level from 0 and the declaration around it."""

    kind: str
    name: str
    start: int
    end: int
    level: int = 0
    parent: int = -1
    ordinal: int = field(default=-1)


def fixed(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(snapshot_id, path, start_line, end_line, content): blocks of ``size`` lines, each starting ``overlap`` lines
    before the last ended; the last reaches the end. Without a Python step."""
    size = max(LEAST, size)
    step = size - max(0, min(overlap, size - 5))
    n = F.size("__lines")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s + (size - step) < n))
    cut = files.select("snapshot_id", "path", lines("content").alias("__lines")).withColumn("start_line", F.explode(starts))
    end: Column = F.least(F.col("start_line") + size, n) - 1
    return cut.select("snapshot_id", "path", "start_line", end.alias("end_line"), F.array_join(F.slice("__lines", F.col("start_line") + 1, F.lit(size)), "\n").alias("content"))


def sections(text: str, lang: str, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, end exclusive) of the sections of a text: cut where declarations or remarks of sections begin and after
    two blank lines; sections over twice the size in even parts."""
    rows = text.split("\n")
    patterns = [re.compile(p) for p in SECTIONS.get("javascript" if lang == "typescript" else lang, SECTIONS[""])]
    cuts, blank = {0, len(rows)}, 0
    for i, row in enumerate(rows):
        row = row.strip()
        if not row:
            blank += 1
            if blank == 2:
                cuts.add(i + 1)
                blank = 0
            continue
        blank = 0
        if any(p.search(row) for p in patterns):
            cuts.add(i)
    ordered, out = sorted(cuts), []
    for a, b in zip(ordered, ordered[1:], strict=False):
        parts = -(-(b - a) // size) if b - a > 2 * size else 1
        edges = [a + (b - a) * j // parts for j in range(parts + 1)]
        out += list(zip(edges, edges[1:], strict=False))
    return [x for x in out if any(r.strip() for r in rows[x[0] : x[1]])]


def nodes(text: str, lang: str) -> list[Node]:
    """Declarations of a text in the order they begin, with their levels: by indentation for Python, by braces else.
    Braces in strings and remarks do not count."""
    rows = text.split("\n")
    found = _python_nodes(rows) if lang == "python" else _brace_nodes(rows, [re.compile(p) for p in DECLARATIONS[lang]]) if lang in DECLARATIONS else []
    for i, node in enumerate(found):
        node.ordinal = i
    return found


def _python_nodes(rows: list[str]) -> list[Node]:
    out: list[Node] = []
    open_: list[tuple[int, int]] = []  # (indent, place in out)
    last = decorated = -1
    for i, row in enumerate(rows):
        if not row.strip():
            continue
        indent = len(row) - len(row.lstrip())
        while open_ and indent <= open_[-1][0] and not row.lstrip().startswith(("#", ")", "]", "}")):
            out[open_.pop()[1]].end = last
        if row.lstrip().startswith("@"):
            decorated = i if decorated < 0 else decorated
        elif m := _PYTHON.match(row):
            out.append(Node("class" if m["kind"] == "class" else "function", m["name"], decorated if decorated >= 0 else i, i, len(open_), open_[-1][1] if open_ else -1))
            open_.append((indent, len(out) - 1))
            decorated = -1
        else:
            decorated = -1
        last = i
    for _, at in open_:
        out[at].end = max(last, out[at].start)
    return out


_BARE = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`|//[^\n]*|/\*.*?\*/")


def _brace_nodes(rows: list[str], patterns: list[re.Pattern]) -> list[Node]:
    out: list[Node] = []
    open_: list[tuple[int, int, bool]] = []  # (depth before, place in out, body begun)
    depth, remark = 0, False
    for i, row in enumerate(rows):
        if remark:
            if "*/" not in row:
                continue
            row, remark = row.split("*/", 1)[1], False
        bare = _BARE.sub("", row)
        if "/*" in bare:
            bare, remark = bare.split("/*", 1)[0], True
        for p in patterns:
            m = p.match(bare)
            if m and m["name"] not in _NOT_METHODS:
                kind = m.groupdict().get("kind") or "method"
                if kind in ("const", "let", "var"):
                    if "=>" not in bare and "function" not in bare:
                        continue
                    kind = "function"
                out.append(Node({"function*": "function", "func": "function"}.get(kind, kind), m["name"], i, i, len(open_), open_[-1][1] if open_ else -1))
                open_.append((depth, len(out) - 1, False))
                break
        depth += bare.count("{") - bare.count("}")
        while open_:
            before, at, begun = open_[-1]
            begun = begun or "{" in bare or depth > before
            if depth <= before and (begun or bare.rstrip().endswith(";")):
                out[at].end = i
                open_.pop()
                continue
            open_[-1] = (before, at, begun)
            break
    for _, at, _ in open_:
        out[at].end = len(rows) - 1
    return out


def packed(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Neighbouring spans (start, end included) together, up to ``size`` lines; a longer one stays alone."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and b - out[-1][0] + 1 <= size:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def overlapped(spans: list[tuple[int, int]], overlap: int) -> list[tuple[int, int]]:
    """Spans that overlap are merged; one that starts within ``overlap`` lines after the last reaches back by half of it."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif out and a - out[-1][1] - 1 < overlap:
            out.append((max(out[-1][0] + 1, out[-1][1] - overlap // 2 + 1), b))
        else:
            out.append((a, b))
    return out


def _base(text: str, lang: str, size: int, overlap: int) -> list[Node]:
    """Declarations and what lies between them, packed up to the size; without any, sections."""
    rows = text.split("\n")
    tops = [n for n in nodes(text, lang) if n.level == 0]
    if not tops:
        return [Node("section", "", a, b - 1) for a, b in sections(text, lang, size)]
    spans, at = [], 0
    for n in tops:
        if n.start > at and any(r.strip() for r in rows[at : n.start]):
            spans.append((at, n.start - 1))
        for a in range(max(n.start, at), n.end + 1, size):
            spans.append((a, min(n.end, a + size - 1)))
        at = max(at, n.end + 1)
    if any(r.strip() for r in rows[at:]):
        spans.append((at, len(rows) - 1))
    return [Node("code", "", a, b) for a, b in overlapped(packed(spans, size), overlap)]


def _semantic(text: str, lang: str, size: int, overlap: int) -> list[Node]:
    """One chunk to a top declaration, cut at ``size`` lines; without any, blocks."""
    return [n for n in _complete(text, lang, size, overlap) if n.kind != "code"]


def _complete(text: str, lang: str, size: int, overlap: int) -> list[Node]:
    """One chunk to a top declaration, and one to what lies between two, all cut at ``size`` lines, so that no text is
    lost; without a declaration, blocks."""
    found = [n for n in nodes(text, lang) if n.level == 0]
    if not found:
        return _blocks(text, BLOCK_SEMANTIC)
    rows, out, at = text.split("\n"), [], 0

    def cut(kind: str, name: str, first: int, last: int) -> None:
        out.extend(Node(kind, name, a, min(last, a + size - 1)) for a in range(first, last + 1, size))

    for n in [*found, None]:
        until = n.start if n else len(rows)
        if any(r.strip() for r in rows[at:until]):
            cut("code", "", at, until - 1)
        if n:
            cut(n.kind, n.name, n.start, n.end)
            at = max(at, n.end + 1)
    return out


def _hierarchical(text: str, lang: str, size: int, overlap: int) -> list[Node]:
    """Every declaration with its level and parent."""
    return nodes(text, lang) or _blocks(text, BLOCK_SEMANTIC)


def _context(text: str, lang: str, size: int, overlap: int) -> list[Node]:
    """Top declarations, each reaching out to a neighbour whose name it uses and that lies within 20 lines, by 8 lines
    or half the distance at most."""
    rows = text.split("\n")
    found = [n for n in nodes(text, lang) if n.level == 0]
    if not found:
        return _blocks(text, BLOCK_CONTEXT)
    used = [set(re.findall(r"[A-Za-z_$][\w$]*", "\n".join(rows[n.start : n.end + 1]))) for n in found]
    out = []
    for i, n in enumerate(found):
        before = after = 0
        for step in (-1, 1):  # declarations lie in order, so those too far off are not looked at
            j = i + step
            while 0 <= j < len(found) and (n.start - found[j].end if step < 0 else found[j].start - n.end) < 20:
                m = found[j]
                if m.name in used[i] or n.name in used[j]:
                    if m.end < n.start:
                        before = max(before, min(8, (n.start - m.end) // 2))
                    elif m.start > n.end:
                        after = max(after, min(8, (m.start - n.end) // 2))
                j += step
        out.append(Node(n.kind, n.name, max(0, n.start - before), min(len(rows) - 1, n.end + after)))
    return out


def _blocks(text: str, size: int) -> list[Node]:
    n = text.count("\n") + 1
    return [Node("block", "", a, min(n, a + size) - 1) for a in range(0, n, size)]


Strategy = Callable[[str, str, int, int], list[Node]]
#: Strategies by name. A strategy of one's own is added here.
STRATEGIES: dict[str, Strategy] = {"base": _base, "semantic": _semantic, "semanticComplete": _complete, "hierarchical": _hierarchical, "contextAware": _context}
ALIASES = {"context-aware": "contextAware", "context_aware": "contextAware"}


def suited(name: str, text: str, lang: str) -> bool:
    """Whether a strategy has something to work on in a text."""
    if name == "semantic":
        return lang in DECLARATIONS or lang == "python"
    found = nodes(text, lang)
    return max((n.level for n in found), default=0) >= 1 if name == "hierarchical" else len(found) >= 2 if name == "contextAware" else True


def chosen(text: str, lang: str, preferred: str | None = None) -> str:
    """The preferred strategy if it suits, else the first that does; semantic in the end."""
    preferred = ALIASES.get(preferred, preferred) if preferred else None
    for name in ([preferred] if preferred in STRATEGIES else []) + ["semantic", "hierarchical", "contextAware"]:
        if suited(name, text, lang):
            return name
    return "semantic"


def chunked(files: DataFrame, strategy: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of files (snapshot_id, path, lang, content) by a named strategy, or for each file the one that suits.

    A chunk's id holds a hash of the whole path, so equal base names do not collide. Null texts have no chunks, blank
    ones neither. Each file is cut where it lies; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
        names = [x.split()[0] for x in _OUT.split(", ")]
        for batch in batches:
            out = []
            for sid, path, lang, text in zip(*[batch.column(c).to_pylist() for c in ("snapshot_id", "path", "lang", "content")], strict=True):
                if text is None or not text.strip():
                    continue
                text = text.replace("\r\n", "\n")
                rows = text.split("\n")
                name = ALIASES.get(strategy, strategy) if strategy in STRATEGIES or strategy in ALIASES else chosen(text, lang or "", strategy)
                key = xxhash.xxh3_64_hexdigest(f"{sid}|{path}")
                for i, n in enumerate(STRATEGIES[name](text, lang or "", max(LEAST, size), max(0, overlap))):
                    out.append((sid, path, f"{key}_{n.start}-{n.end}_L{n.level}", i, n.parent, n.level, n.kind, n.name, n.start, n.end, "\n".join(rows[n.start : n.end + 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return files.select("snapshot_id", "path", "lang", "content").mapInArrow(run, _OUT)
