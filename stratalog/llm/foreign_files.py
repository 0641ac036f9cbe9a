"""Files that are not written by hand: generated, minified, vendored, or data stored as code."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.entries import counting, owners, texts
from stratalog.llm.grammar import repair
from stratalog.session import staged
from stratalog.sources.tables import small, spread

# How tools and packagers mark what they make.
#: Paths that say so; for the JVM, so without Python's own syntax.
PATH_GENERATED = (
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|Cargo\.lock|go\.sum|gradle\.lockfile|packages\.lock\.json|flake\.lock|uv\.lock|mix\.lock)$"
    r"|\.(?:generated|g|gen|designer|pb|pb\.gw|pb\.validate)\.[A-Za-z0-9]+$|_pb2(?:_grpc)?\.pyi?$|_generated\.[A-Za-z0-9]+$|_pb\.(?:js|ts|rb)$|\.pb\.(?:go|cc|h)$|\.snap$"
    r"|(?:^|/)(?:gen|__generated__|generated|autogen)/"
)
PATH_MINIFIED = r"[.-]min\.(?:js|css|mjs|cjs|html)$|\.(?:bundle|chunk)\.js$|-[0-9a-f]{8,}\.(?:js|css)$|\.(?:js|css)\.map$"
PATH_VENDORED = r"(?:^|/)(?:vendor|third_party|third-party|thirdparty|node_modules|bower_components|external|site-packages|jspm_packages|Pods|Carthage)/|(?:^|/)[A-Za-z][A-Za-z0-9._-]*-v?[0-9]+\.[0-9]+(?:\.[0-9]+)?\.[A-Za-z]{1,4}$"
#: Notices in the comments with which a file begins.
NOTICE_GENERATED = re.compile(
    r"code generated\b.*\bdo not (?:edit|modify)|\bdo not (?:edit|modify)\b[:,.]? *(?:output of|this file|generated|by hand|manually)|@generated\b|<auto-?generated|auto-?generated (?:from|by|file|code)|^\W*auto-?generated\b"
    r"|(?:this|the) file (?:was|is|has been) (?:automatically|auto)[ -]?(?:created|generated|produced|written)|(?:automatically|auto)[ -]?(?:created|generated) by\b|machine[- ](?:written|generated|made) (?:by|from|file)|^\W*generated (?:on|at|by|from)\b.*\b(?:from|by|with|using|20\d\d)\b|manual changes will be (?:lost|overwritten)"
    r"|output of `[^`]+`|(?:diese datei wurde|wurde) automatisch|automatisch (?:erzeugt|erstellt|generiert)|(?:ce fichier a été )?(?:généré|créé) automatiquement|(?:este archivo (?:fue|ha sido) )?(?:generado|creado) automáticamente",
    re.I,
)
NOTICE_VENDORED = re.compile(
    r"\bvendored from\b|copied (?:unmodified|verbatim|unchanged|as is)? ?from (?:the )?\S+ (?:project|package|library|repository|release|v?\d)|\b\S+ v?\d+\.\d+(?:\.\d+)?\b.{0,40}\|.{0,20}\blicen[cs]e|copyright \(c\) \d{4}.{0,60}\bcontributors\b|(?:bug reports|issues|patches) (?:go|belong) to the upstream|see upstream for (?:changes|history)|\bupstream (?:version|release|commit)[: ]+\S*\d",
    re.I,
)
#: A whole notice: the remark begins by saying of this file that it was made by something, or that and not to edit it.
NOTICE_WHOLE = re.compile(
    r"^\W*(?:(?:code|source|output|(?:this|the) (?:file|code|source))\s+)?(?:(?:was|is|has been)\s+)?(?:(?:auto|machine)(?:matically)?[- ]?)?(?:generated|created|produced)\b(?:(?: on .{1,40})? (?:by|from|with|using) (?!hand\b)\w|.*\bdo not (?:edit|modify))"
    r"|^\W*(?:@generated\b|<auto-?generated|vendored from\b)|^\W*do not (?:edit|modify)\b.*\bgenerated (?:by|from)\b",
    re.I,
)
#: By its grammar a remark on other files, or a denial: the file does something to files, or was not made by a tool.
NOTICE_OWN = re.compile(
    r"\b(?:not|never|n't|no longer) (?:\w+ )?(?:auto\w*[- ]?)?(?:generated|created|produced|minified|vendored|copied)\b"
    r"|^\W*(?:(?:this|the) \w+ |it )?(?:writes|creates|produces|emits|generates|checks|verifies|rejects|detects|finds|skips|deletes|minifies|compresses|manages)\b(?! (?:this|the) file\b)",
    re.I,
)

_TOKEN = re.compile(r"""(?P<word>[^\W\d][\w$]*|\$[\w$]+)|(?P<num>\d[\w.]*)|(?P<str>"[^"\n]*"|'[^'\n]*')|(?P<nl>\n)|(?P<mark>[^\s\w])""")
_KEPT = frozenset("import from return const let var function class def if else for while await async this self new throw export try catch func package range interface public private static void yield raise with pass switch case break continue".split())
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|;|%|\"\"\"|''')")
#: Marks that open a comment of several lines, and those that close it.
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_CODE = re.compile(r"\.(?:js|mjs|cjs|jsx|ts|tsx|css|scss|less|html?|svg|php|py|go|java|rb|c|cc|h|rs|lua|vue)$", re.I)
_PROSE = re.compile(r"\.(?:md|markdown|rst|txt|adoc|csv|tsv)$", re.I)
_DIGIT = re.compile(r"\d")
_SYMBOLS: dict[str, int] = {}

#: Thresholds: least tokens for a grammar of tokens to tell; share of tokens it saves; characters to a line of minified
#: code; share of a file's characters in literals of a blob; bits that the grammar of literals takes to those of their
#: characters by frequency alone; owners (and their share), share of rules and least rules of a vendored text.
LEAST, REUSE, LONG_LINE, BLOB, DENSE, TABLE_REUSE, OWNERS, OWNER_SHARE, SHARED, LEAST_RULES = 40, 0.6, 200, 0.4, 0.9, 0.9, 20, 0.01, 0.9, 5


def _name(kind: str, text: str) -> int:
    key = text if kind == "mark" or kind == "nl" or (kind == "word" and text in _KEPT) else kind
    got = _SYMBOLS.get(key)
    if got is None:
        got = _SYMBOLS[key] = xxhash.xxh3_64_intdigest(key)
    return got


def _symbols(text: str) -> tuple[np.ndarray, list[str]]:
    """Token symbols of a text (names, numbers and strings by kind), and the literals that may be data: all its numbers
    as one, and strings of 24 characters or more, of 14 kinds or more with digits among them and no blank."""
    out, numbers, literals = [], [], []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        out.append(_name(kind, m[0]))
        if kind == "num":
            numbers.append(m[0])
        elif kind == "str" and m.end() - m.start() >= 26 and " " not in m[0] and len(set(m[0])) > 14 and _DIGIT.search(m[0]):
            literals.append(m[0][1:-1])
    return np.array(out, np.uint64), [*literals, "".join(numbers)]


def density(literals: list[str]) -> np.ndarray:
    """Of each string the bits that its Re-Pair grammar over characters takes, to those that its characters take by
    their frequency alone: 1 or more where rules save nothing (random data at any length), little where parts recur;
    0 for a string of fewer than two kinds of characters."""
    sizes = np.array([len(x) for x in literals], np.int64)
    out = np.zeros(len(literals))
    if not sizes.sum():
        return out
    symbols = np.frombuffer("".join(literals).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(literals)), sizes)
    left, rules, _ = repair(symbols, owner)
    left, rules = np.pad(left, (0, len(literals) - len(left))), np.pad(rules, (0, len(literals) - len(rules)))
    for i, x in enumerate(literals):
        if x:
            counts = np.unique(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1]
            alone = -(counts * np.log2(counts / len(x))).sum()
            if alone > 0:
                out[i] = (left[i] + 2 * rules[i]) * np.log2(len(counts) + rules[i]) / alone
    return out


def _rules(text: str, path: str) -> np.ndarray:
    """Names of the pairs of neighbouring lines of a text that hold something. Over all texts a pair that recurs is a
    rule of the first round of Re-Pair with lines as symbols; who shares it is counted in ``_shared``."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if len(x) > 3]
    names = [xxhash.xxh3_64_intdigest(x) for x in lines]
    pairs = {(a * 0x9E3779B97F4A7C15 ^ b) & 0x7FFFFFFFFFFFFFFF for a, b in zip(names, names[1:], strict=False)}
    return np.fromiter(pairs, np.int64, len(pairs))


def notice(text: str) -> str | None:
    """generated or vendored, if the comments with which a text begins say so, however long they are."""
    close = None
    for n, line in enumerate(io.StringIO(text.lstrip("\ufeff"), newline="\n")):
        bare = line.strip()
        if not bare or line.startswith("#!"):
            continue
        if close is None:
            if not _COMMENT.match(line):
                if n:
                    break
                continue  # a first line such as a package clause
            mark = next((x for x in _BLOCKS if bare.startswith(x)), None)
            if mark and _BLOCKS[mark] not in bare[len(mark) :]:
                close = _BLOCKS[mark]
        elif close in bare:
            close = None
        if NOTICE_OWN.search(line) and not NOTICE_WHOLE.search(line):
            continue
        if NOTICE_GENERATED.search(line):
            return "generated"
        if NOTICE_VENDORED.search(line):
            return "vendored"
    return None


def shape(path: str, text: str, tokens: int, left: int, rules: int, dense: int) -> str | None:
    """minified, data or generated by the grammars of the text: one of ``tokens`` tokens with ``left`` symbols in its start
    rule and ``rules`` rules of two symbols, and those of its literals, of which ``dense`` characters can't be shrunk."""
    size = len(text)
    if not size:
        return None
    if _CODE.search(path) and dense >= BLOB * size:
        return "data"
    if tokens < LEAST:
        return None
    reuse = 1 - (left + 2 * rules) / tokens
    lines = text.rstrip("\n").count("\n") + 1
    if size / lines >= LONG_LINE and not _PROSE.search(path) and reuse >= REUSE:
        long = sum(len(x) for x in text.split("\n") if len(x) >= LONG_LINE)
        if long >= 0.6 * size:
            return "minified"
    if _CODE.search(path) and not re.search(r"\.(?:css|scss|less|html?|svg)$", path) and reuse >= TABLE_REUSE and dense >= 0.2 * size:
        return "generated"
    return None


def judge(paths: list[str], contents: list[str]) -> list[str | None]:
    """The kind of each text by its notice and its grammars; grammars of all texts of the batch are inferred at once."""
    found = [notice(t) for t in contents]
    open_ = [i for i, k in enumerate(found) if k is None]
    parts = [_symbols(contents[i]) for i in open_]
    sizes = np.array([len(a) for a, _ in parts], np.int64)
    if len(sizes) and sizes.sum():
        owner = np.repeat(np.arange(len(parts)), sizes)
        left, rules, _ = repair(np.concatenate([a for a, _ in parts]), owner)
        left, rules = np.pad(left, (0, len(parts) - len(left))), np.pad(rules, (0, len(parts) - len(rules)))
        # grammars of literals, where they make up enough of the text
        literals = [(n, x) for n, (i, (_, own)) in enumerate(zip(open_, parts, strict=True)) if _CODE.search(paths[i]) and sum(map(len, own)) >= 0.2 * len(contents[i]) for x in own]
        dense = np.zeros(len(parts), np.int64)
        for (n, x), d in zip(literals, density([x for _, x in literals]), strict=True):
            dense[n] += len(x) * (d >= DENSE)
        for j, i in enumerate(open_):
            found[i] = shape(paths[i], contents[i], int(sizes[j]), int(left[j]), int(rules[j]), int(dense[j]))
    return found


def _judge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            paths, contents = part.column("path").to_pylist(), [x.replace("\r\n", "\n") for x in part.column("content").to_pylist()]
            kinds = judge(paths, contents)
            rules = [_rules(t, p) for t, p in zip(contents, paths, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rules])])
            arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(rules) if rules else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("snapshot_id"), part.column("path"), part.column("delivery"), pa.array(kinds, pa.string()), arrays], ["snapshot_id", "path", "delivery", "kind", "rules"])


def foreign_files(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(owner, path, kinds): files of a workspace that were not written by hand, by any of their texts that count.

    kinds: ``generated`` (a notice of a tool, a path of one, or a table that a few rules of the grammar produce),
    ``minified`` (long lines of code that the grammar shrinks well), ``vendored`` (a notice or path of a package,
    or a text nearly all of whose rules more than OWNERS owners and OWNER_SHARE of all owners share), ``data`` (a good part
    of it are literals that their grammar can't shrink). Re-Pair grammars over token kinds, and over the characters of literals,
    are inferred for every text where it lies; only names of rules are shuffled. Copies of a project's own files are
    shared by a few owners, so sharing by few does not tell.
    Entries that are binary, gone, without a path or superseded are left out; an empty text has no kind.
    """
    keys = counting(files)
    owner = small(owners(snapshots))
    judged = spread(texts(files)).mapInArrow(_judge_all, "snapshot_id string, path string, delivery long, kind string, rules array<long>")
    judged = staged(judged.join(keys.filter("has_text"), ["snapshot_id", "path", "delivery"], "left_semi").join(owner, "snapshot_id"))
    by_text = judged.filter("kind is not null").select("owner", "path", "kind")
    named = keys.join(owner, "snapshot_id").select("owner", "path").distinct()
    by_path = named.select("owner", "path", F.explode(F.array(*[F.when(F.col("path").rlike(p), k) for k, p in (("generated", PATH_GENERATED), ("minified", PATH_MINIFIED), ("vendored", PATH_VENDORED))])).alias("kind")).filter("kind is not null")
    return by_text.unionByName(by_path).unionByName(_shared(judged, owner)).groupBy("owner", "path").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _shared(judged: DataFrame, owner: DataFrame) -> DataFrame:
    """Texts nearly all of whose rules are shared by many owners. Hot rules are counted map-side first."""
    least = owner.agg(F.greatest(F.lit(OWNERS), F.ceil(F.count_distinct("owner") * OWNER_SHARE)).alias("least"))
    pairs = judged.select("owner", F.explode("rules").alias("rule")).distinct()
    wide = pairs.groupBy("rule").agg(F.count("*").alias("owners")).filter(F.col("owners") > OWNERS).join(F.broadcast(least)).filter("owners > least").select("rule")
    hits = judged.filter(F.size("rules") >= LEAST_RULES).select("owner", "path", "snapshot_id", "delivery", F.size("rules").alias("n"), F.explode("rules").alias("rule")).join(small(wide), "rule")
    return hits.groupBy("owner", "path", "snapshot_id", "delivery", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= SHARED * F.col("n")).select("owner", "path", F.lit("vendored").alias("kind"))
