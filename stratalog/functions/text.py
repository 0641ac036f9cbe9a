"""Column functions on texts and paths whose results agree between engines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_words(pattern: str) -> str:
    """``pattern`` with word boundaries on ASCII word characters; Java's ``\\b`` is Unicode-aware."""
    start, end = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))", None
    return pattern.replace(r"\b", end or start)


def trimmed(c: Column | str) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def lines(c: Column | str) -> Column:
    """Lines between ``\\n``; a text that ends in one has an empty last line."""
    return F.split(col(c), "\n")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Lower-cased extension with its point, '' if the base name has none or only a leading point."""
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1))


def hits(c: Column | str, pattern: str) -> Column:
    """Number of matches."""
    return F.regexp_count(col(c), F.lit(ascii_words(pattern)))


def has_any(c: Column | str, words: Iterable[str]) -> Column:
    """Whether any of ``words`` stands in the text."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(col(c), F.lit(w))
    return found


def js_round(c: Column) -> Column:
    """Half up, towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def named_when(rules: Iterable[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, holds in rules:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out.otherwise(F.lit(default))


def all_named(rules: Iterable[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))


#: Languages by extension.
LANGUAGES = {
    "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "python": ".py", "java": ".java", "c": ".c .h", "cpp": ".cpp .hpp .cxx", "csharp": ".cs", "go": ".go", "ruby": ".rb", "php": ".php", "rust": ".rs",
    "swift": ".swift", "kotlin": ".kt .kts", "html": ".html .htm", "css": ".css", "scss": ".scss", "sass": ".sass", "json": ".json", "markdown": ".md .markdown", "yaml": ".yaml .yml", "shell": ".sh",
}
#: Extensions of binary files, and the text extensions that remain text below build folders.
BINARY = ".jpg .jpeg .png .gif .bmp .tiff .ico .webp .avif .zip .tar .gz .rar .7z .bz2 .xz .ar .iso .exe .dll .so .dylib .bin .pyc .pyd .obj .lib .a .pdf .doc .docx .xls .xlsx .ppt .pptx .mp3 .wav .ogg .mp4 .avi .mov .wmv .flv .mkv .sqlite .db .mdb .accdb .frm .dbf .jar .class .ttf .otf .woff .woff2 .eot .dat".split()
BUILT_TEXT = ".js .css .html .json .txt .md .map".split()


def language(path: Column | str, content: Column | str | None = None) -> Column:
    """Language of a file by its extension, ``text`` if unknown; a ``.h`` file is C++ if its text looks so."""
    ext = extension(path)
    found = named_when(((name, ext.isin(*exts.split())) for name, exts in LANGUAGES.items()), "text")
    if content is None:
        return found
    return F.when((ext == ".h") & has_any(content, ("namespace", "class ", "template<", "::")), "cpp").otherwise(found)


def binary_name(path: Column | str) -> Column:
    """Whether a file is binary by its name."""
    ext, low, base = extension(path), F.lower(col(path)), base_name(path)
    named = base.rlike(r"^\.DS_Store$|(?i)^thumbs\.db$|^desktop\.ini$|^ntuser\.dat|^\$recycle\.bin$")
    built = low.rlike("/(dist|build|bin|node_modules)/") & ~ext.isin(*BUILT_TEXT)
    return ext.isin(*BINARY) | named | built


def glob_regex(pattern: str) -> str:
    """A glob with ``*``, ``**``, ``?``, ``{a,b}`` as a regular expression over a whole path with ``/``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out += "(?:"
        elif c == "}":
            out += ")"
        elif c == ",":
            out += "|" if out.count("(?:") > out.count(")") else ","
        else:
            out += c if c.isalnum() or c in "/_" else "\\" + c
        i += 1
    return f"^{out}$"


def path_matches(path: Column | str, pattern: str, substring: bool = False) -> Column:
    """Whether a path matches: a glob, a folder ending in ``/``, a whole path, or, if ``substring``, a part of one."""
    pattern = pattern.replace("\\", "/")
    if any(c in pattern for c in "*?{}!+@()"):
        return col(path).rlike(glob_regex(pattern))
    if pattern.endswith("/"):
        return col(path).startswith(pattern)
    return F.contains(col(path), F.lit(pattern)) if substring else col(path) == pattern
