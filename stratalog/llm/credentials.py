"""Live credentials in source files: all literals indexed with their owners, rare structured ones confirmed, searched
again everywhere by an automaton, masked."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.entries import counting, owners, texts
from stratalog.llm.literals import cover
from stratalog.session import staged, staged_path
from stratalog.sources.tables import clean_path, newest, small, spread

# How secrets are named, and how tokens of public services begin.
_PASS = r"pass(?:word|wd|wort|phrase|code)?|pwd|pw|kennwort|mot[_-]?de[_-]?passe|mdp|contrase(?:ñ|n)a|clave|senha|wachtwoord"
_TOKEN = r"(?:api|access|private|secret|signing|encryption|auth|service|master|account|storage|shared|deploy|session|webhook|client|license)[_-]?(?:api[_-]?)?(?:key|token|secret|credential)s?|token|secret|credentials?|bearer|x-api-key|apikey"
#: A name that ends in a word for a password or a token; what follows it makes it another thing (passwordField).
NAME = re.compile(rf"(?<![A-Za-z0-9])(?P<name>[A-Za-z0-9_.-]*?(?:(?P<pass>{_PASS})|(?P<token>{_TOKEN})))(?![A-Za-z0-9_-])", re.I)
PREFIXED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:A(?:KIA|SIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{18,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{32,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{18,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{40,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|dop_v1_[a-f0-9]{64}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_/+-])"
)
URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,30}://(?P<user>[^\s:/@'\"`<>]*):(?P<value>[^\s'\"`<>]+?)@(?=[\w.\[-])", re.I)
HEADER = re.compile(r"\b(?:Bearer|Basic|Token|ApiKey)[ ]+(?P<value>[A-Za-z0-9._~+/=-]{16,})")
CURL = re.compile(r"\bcurl\b.*?\s(?:-u|--user)[ =]?['\"]?(?P<user>[\w.@-]+):(?P<value>[^\s'\"]+)")
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A line of a key: its base64 in whatever marks of comments and strings, a header, or nothing.
_MATERIAL = re.compile(r"""[ \t\r"'`+#/*;,.\\-]*(?:(?:(?=[^\n]*\d)[A-Za-z0-9+/]{5,}={0,2}|=?[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]+={1,2})(?:\\[nr])*|(?:Version|Comment|Charset|Hash|MessageID|Proc-Type|DEK-Info):[^\n]*)?[ \t\r"'`+*;,)\\]*""")
_STRING = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)"""
_LITERAL = re.compile(_STRING)
#: After a name: an assignment, comparison, pair or argument, then one string or several joined ones.
_ASSIGNED = re.compile(rf"""['"\]]?\s*(?::=|===?|!==?|=>|[:=,]|\.equals\()\s*(?:\w+\s*=\s*)?(?P<value>[brfu]?{_STRING}(?:\s*[+.]?\s*{_STRING})*)""")
_BARE = re.compile(r"""['"]?\s*[:=]\s*(?P<value>[^\s'"`,;(){}\[\]][^\s'"`;,]*)\s*(?:[#;].*)?$""")
_REMARK = re.compile(r"""^\s*(?:(?:is|was|=|:)\s+)?(?P<value>[^\s'"`]+)\s*(?:\*/|-->)?\s*$""")
#: Calls and pairs that take a credential without its name. What follows a user in the first kind is one if it could be;
#: the second takes hosts, roles and names too, so there, and where it comes first, a value must be built as none of those is.
_CALL = re.compile(r"(?:(?P<login>log_?[io]n|sign_?in|authenticate|(?:basic|digest)_?auth|credentials?)|auth(?:orize)?|connect(?:ion)?)(?:_?(?:as|with\w*|user|client|provider|account|a?sync))?\s*(?:[=:]\s*)?[(\[]", re.I)
_ARGUMENT = re.compile(rf"""(?:[A-Za-z_]\w*\s*=\s*)?(?:(?P<value>[brfu]?{_STRING}(?:\s*[+.]?\s*{_STRING})*)|[^\s,()\[\]"'`][^,()\[\]"'`\n]*(?:\([^()\n]*\))?)""")
_GAP = re.compile(r"\s*(?:(?://|#)[^\n]*\s*)*")
_NEXT = re.compile(rf"{_GAP.pattern},{_GAP.pattern}")
_PLACE = re.compile(r"[.~]{0,2}/.*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|[\w-]+(?:\.[\w-]+)*:\d+(?:/.*)?", re.S)
#: What a configuration sets, and a run of one character.
_SETTING = re.compile(r"""^\s*[\w.-]+['"]?\s*[:=]\s*([^\s'"`,;][^\n'"`,;]*?)\s*$""", re.M)
_RUN = re.compile(r"(.)\1{2,}", re.S)
_COMMENT = re.compile(r"(?<![:\w])(?://|#|/\*|<!--|--\s|\*\s)")
_CONFIG = re.compile(r"(?:^|/)\.env|\.(?:ini|cfg|conf|config|env|properties|ya?ml|toml|sh|bash|zsh|tf|tfvars|dockerfile|envrc|txt|npmrc|pypirc|netrc)(?:\.[\w-]+)?$|(?:^|/)Dockerfile|(?:^|/)\.(?:npmrc|pypirc|netrc|pgpass)$", re.I)
_TEMPLATE = re.compile(r"\$\{|\$\(|\{\{|\}\}|<%|%>|#\{|^\$[A-Za-z_]\w*$|^%\(?[A-Za-z_]\w*\)?s?%?$|^@@|^__[A-Z]|^<[^>]*>$|^\[[^\]]*\]$|^\{[^}]*\}$")
#: Names under which programs look a value up.
_LOOKUP = re.compile(r"^(?:process\.env|import\.meta\.env|os\.(?:environ|getenv)|System\.getenv|ENV|env|config|settings|secrets?|vars?|local|data|module|self|this|cfg|options|params|args)\b[.\[(]", re.I)
_MASKED = re.compile(r"^(.)\1{2,}$|^[xX*•.#_\-?]+$|\*{3,}|•{2,}|x{6,}|X{6,}|\.\.\.$|…")
_HEXES = re.compile(r"^[0-9a-f]{32,}$|^[0-9A-F]{32,}$")
#: Lower-cased strings of which every line with a candidate has one: a shortcut that loses nothing.
_TRIGGERS = tuple(sorted(set().union(*(cover(x.pattern) for x in (PREFIXED, NAME, URL, HEADER, CURL, BLOCK, _CALL)))))
#: Owners beyond which a value is a placeholder; values in one automaton; characters of texts that a task holds while it
#: runs the automata over them.
PLACEHOLDER_OWNERS, RESCAN_VALUES, HELD = 50, 100_000, 32_000_000
MASK = "********"


def _trigger() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in _TRIGGERS:
        found.add_word(w, 0)
    found.make_automaton()
    return found


def _entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * log2(c / n) for c in Counter(v).values()) if n else 0.0


def plausible(value: str, kind: str) -> bool:
    """Whether ``value`` has the shape of a live secret: of a ``pass`` word (people choose them), or of a ``token``."""
    v = value.strip()
    if len(v) < 5 or " " in v or _TEMPLATE.search(v) or _MASKED.search(v) or _LOOKUP.match(v) or re.match(r"^[a-z]+://[^@]*$", v):
        return False
    if PREFIXED.search(v):
        return True
    classes = sum(bool(re.search(c, v)) for c in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    if kind == "pass":
        if re.fullmatch(r"[A-Za-z_]+", v):  # one word or name
            return False
        if re.fullmatch(r"[a-z]+(?:[-_./][a-z]+)+", v, re.I):  # words: a pass phrase has four or more, a path or name fewer
            return len(re.split(r"[-_.]", v)) >= 4 and "/" not in v and not re.search(NAME, v)
        return not re.fullmatch(r"[0-9.,]+", v) or len(v) >= 8
    if len(v) < 16 or re.fullmatch(r"[0-9.]+", v):
        return False
    if re.fullmatch(r"[A-Za-z]+(?:[-_./ ][A-Za-z]+)*", v):  # words or a name, unless capitals lie as by chance
        upper = sum(x.isupper() for x in v)
        return 0.25 <= upper / len(v) <= 0.75 and len(re.findall(r"[A-Z]{2}", v)) >= 2 and _entropy(v) >= 3.5
    return _entropy(v) >= 3.0 and classes >= 2


def _joined(strings: str) -> str:
    """The value of one string literal or of several that code joins."""
    return "".join(x[1:-1] for x in _LITERAL.findall(strings))


def _built(v: str) -> bool:
    """Whether a value is built as no host, role, path or name is: letters, digits and a mark, or a token in mixed case."""
    if len(v) < 6 or not re.search(r"[0-9]", v) or not re.search(r"[A-Za-z]", v):
        return False
    if plausible(v, "pass") and re.search(r"[^\w.@:/ -]", v):
        return True
    return plausible(v, "token") and bool(re.search(r"[A-Z]", v) and re.search(r"[a-z]", v))


def arguments(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(value, start, end) of the secrets that calls beginning between ``start`` and ``end`` take, on whatever line."""
    for m in _CALL.finditer(text, start, end):
        at, n = _GAP.match(text, m.end()).end(), 0
        while a := _ARGUMENT.match(text, at):
            if a["value"]:
                v = _joined(a["value"])
                if not _PLACE.fullmatch(v) and (_built(v) or (m["login"] and n and (plausible(v, "pass") or plausible(v, "token")))):
                    yield v, *a.span("value")
            if not (more := _NEXT.match(text, a.end())):
                break
            at, n = more.end(), n + 1


def block_end(text: str, at: int) -> tuple[int, int]:
    """(end of the material, end of the block) of a private key whose BEGIN mark ends at ``at``: up to its END mark
    however far, or where that is missing as far as lines of key material, headers and empty ones follow."""
    stop, again = BLOCK_END.search(text, at), BLOCK.search(text, at)
    if stop and not (again and again.start() < stop.start()):
        return stop.start(), stop.end()
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    while end < len(text):
        after = text.find("\n", end + 1)
        after = len(text) if after < 0 else after
        if not _MATERIAL.fullmatch(text, end + 1, after):
            break
        end = after
    return end, end


def scan_line(line: str, config: bool) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) of each plausible secret in a line; start and end enclose the literal or the value."""
    found: list[tuple[str, str, int, int]] = []

    def add(kind: str, value: str, start: int, end: int) -> None:
        if not any(s < end and start < e for _, _, s, e in found):
            found.append((kind, value, start, end))

    for m in URL.finditer(line):
        v = m["value"]
        if not _TEMPLATE.search(v) and not _MASKED.search(v) and "(" not in v and len(v) >= 4:
            add("url", v, *m.span("value"))
    if m := CURL.search(line):
        if plausible(m["value"], "pass") or plausible(m["value"], "token"):
            add("pass", m["value"], *m.span("value"))
    for m in HEADER.finditer(line):
        v = m["value"]
        if not _MASKED.search(v) and re.search(r"[0-9]", v) and re.search(r"[A-Za-z]", v) and _entropy(v) >= 3.2:
            add("token", v, *m.span("value"))
    for m in PREFIXED.finditer(line):
        if not _MASKED.search(m[0]) and not m[0].endswith("EXAMPLE"):
            add("token", m[0], *m.span())
    comment = None
    for m in NAME.finditer(line):
        kind = "pass" if m["pass"] else "token"
        at = m.end()
        if (a := _ASSIGNED.match(line, at)) and plausible(_joined(a["value"]), kind):
            add(kind, _joined(a["value"]), *a.span("value"))
        elif config and (a := _BARE.match(line, at)) and plausible(a["value"], kind):
            add(kind, a["value"], *a.span("value"))
        else:
            if comment is None:
                marks = [x.start() for x in _COMMENT.finditer(line)]
                comment = marks[-1] if marks else len(line)
            if m.start() < comment:
                continue
            if (a := _REMARK.match(line[at:])) and at < len(line) and line[at] in " :=" and plausible(a["value"], kind):
                add(kind, a["value"], at + a.start("value"), at + a.end("value"))
            elif not line[at:].strip(" \t*/->"):  # the remark names what the literal before it is
                for x in re.finditer(rf"{_STRING}(?:\s*[+.]\s*{_STRING})*", line[:comment]):
                    if plausible(_joined(x[0]), "token" if kind == "token" else "pass"):
                        add(kind, _joined(x[0]), *x.span())
    return found


def scan(text: str, path: str, trigger: ahocorasick.Automaton) -> list[tuple[int, str, str, int, int]]:
    """(line from 0, kind, value, start, end) of the plausible secrets in a text. A private key is one, of kind ``block``,
    at the line where it begins; it must hold something besides marks and masks."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length with their case
        low = "".join(x.lower() if len(x.lower()) == 1 else x for x in text)
    if next(trigger.iter(low), None) is None:
        return []
    config = bool(_CONFIG.search(path))
    out: list[tuple[int, str, str, int, int]] = []
    passed: list[tuple[str, int, int]] = []
    line_no, counted, done, closed = 0, 0, -1, -1
    for at, _ in trigger.iter(low):
        if at <= done:
            continue
        start, end = text.rfind("\n", 0, at + 1) + 1, text.find("\n", at + 1)
        end = len(text) if end < 0 else end
        done = end
        line_no += text.count("\n", counted, start)
        counted = start
        line = text[start:end].rstrip("\r")
        if start < closed:
            continue
        if b := BLOCK.search(line):
            until, close = block_end(text, start + b.end())
            body = text[start + b.end() : until]
            core = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
            if len(core) >= 24 and len(set(core)) >= 10:
                out.append((line_no, "block", xxhash.xxh3_128_hexdigest(core), b.start(), len(line)))
                closed = close
                continue
        out += [(line_no, *x) for x in scan_line(line, config)]
        passed += arguments(text, start, end)
    for v, a, b in passed:
        no, start = text.count("\n", 0, a), text.rfind("\n", 0, a) + 1
        if "\n" in text[a:b]:  # strings joined over lines: each line holds a part
            for x in _LITERAL.finditer(text, a, b):
                no, start = text.count("\n", 0, x.start()), text.rfind("\n", 0, x.start()) + 1
                _add(out, no, v, x.start() - start, x.end() - start)
        else:
            _add(out, no, v, a - start, b - start)
    return out


def _add(out: list[tuple[int, str, str, int, int]], no: int, v: str, start: int, end: int) -> None:
    if not any(n == no and s < end and start < e for n, _, _, s, e in out):
        out.append((no, "pass", v, start, end))


def literals(text: str, config: bool) -> set[int]:
    """Names of all literals of a text: its strings, what stands after ``=`` or ``:`` in a configuration, and the parts
    of addresses between ``:`` and ``@``. Runs of one character are as one, so that masks of any length are one literal."""
    found = {x[0][1:-1] for x in _LITERAL.finditer(text)}
    found.update(m["value"] for m in URL.finditer(text))
    if config:
        found.update(m[1] for m in _SETTING.finditer(text))
    return {named(x) for x in found if x}


def named(value: str) -> int:
    return xxhash.xxh3_64_intdigest(_RUN.sub(r"\1\1", value)) - (1 << 63)


def candidates(snapshots: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plausible secrets of the entries that count, owners of every literal as (name, owners), those entries).

    The scan runs where the files lie; only its finds, names of literals and keys of entries are shuffled, texts are not.
    """
    counts = counting(files).filter("has_text").drop("has_text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger = _trigger()
        for batch in batches:
            rows, index = [], []
            for sid, path, text, when in zip(*[batch.column(c).to_pylist() for c in ("snapshot_id", "path", "content", "delivery")], strict=True):
                index.append((sid, path, when, list(literals(text, bool(_CONFIG.search(path))))))
                rows += [(sid, path, when, *x, named(x[2])) for x in scan(text, path, trigger)]
            yield _batch(rows, index)

    read = staged(spread(texts(files)).mapInArrow(find, f"{_FOUND}, name long, names array<long>").join(counts, ["snapshot_id", "path", "delivery"], "left_semi").join(small(owners(snapshots)), "snapshot_id", "left"))
    index = read.filter("names is not null").select("owner", F.explode("names").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("owners"))
    return read.filter("names is null").drop("names"), index, counts


def confirmed(found: DataFrame, index: DataFrame, max_owners: int = PLACEHOLDER_OWNERS) -> DataFrame:
    """(kind, value) of the plausible secrets that are rare: of no more than ``max_owners`` owners, be it as secrets, or as
    literals of whatever use. What many unrelated owners share is a placeholder of a manual or a template."""
    by_owner = found.groupBy("value", "name", "owner").agg(F.min("kind").alias("kind"))
    rare = by_owner.groupBy("value", "name").agg(F.min("kind").alias("kind"), F.count("*").alias("owners")).filter(F.col("owners") <= max_owners)
    return rare.join(index.filter(F.col("owners") > max_owners).select("name"), "name", "left_anti").select("kind", "value")


def find_credentials(snapshots: DataFrame, files: DataFrame, max_owners: int = PLACEHOLDER_OWNERS, again: bool = True) -> DataFrame:
    """(snapshot_id, path, line_no, start, end, kind) of each live credential in the texts of entries that count.

    1. Every literal of every text is indexed with its owners; those named, built or passed like secrets are candidates.
    2. Candidates that more than ``max_owners`` owners have are placeholders; the rest, being structured and rare, are confirmed.
    3. All texts are searched again for the confirmed values, whether they stand there named or not, by automata of
       RESCAN_VALUES values; the texts are read once, however many values there are. ``again`` turns this off.
       A value that by these places has more than ``max_owners`` owners is dropped after all.

    Lines count from 0 between ``\\n``; start and end are offsets in the line. A row without text or key is passed over.
    """
    found, index, counts = candidates(snapshots, files)
    good = staged(confirmed(found, index, max_owners))
    columns = ["snapshot_id", "path", "line_no", "start", "end", "kind"]
    named_ = found.join(good.select("value"), "value", "left_semi")
    if not again:
        return named_.select(columns).distinct()
    values = good.filter(F.col("kind") != "block").select("value").distinct()
    n = values.count()
    if not n:
        return named_.select(columns).distinct()  # key blocks only
    values = values.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(-(-n // RESCAN_VALUES))).cast("int"))
    path, shards = staged_path(values, "shard"), [r.shard for r in values.select("shard").distinct().collect()]
    places = spread(texts(files)).mapInArrow(_search(path, shards), _FOUND).join(counts, ["snapshot_id", "path", "delivery"], "left_semi").join(small(owners(snapshots)), "snapshot_id", "left")
    places = staged(places)
    wide = found.select("value", "owner").unionByName(places.select("value", "owner")).distinct().groupBy("value").agg(F.count("*").alias("owners")).filter(F.col("owners") > max_owners)
    wide = small(wide.select("value"))
    first = named_.join(wide, "value", "left_anti").select(columns)
    fresh = places.join(wide, "value", "left_anti").select(columns).join(first.select("snapshot_id", "path", "line_no").distinct(), ["snapshot_id", "path", "line_no"], "left_anti")
    return first.unionByName(fresh).distinct()


def _search(path: str, shards: list[int]):
    """Where the values of the table at ``path`` stand as whole words. One of fewer than 8 characters must stand in a
    string literal, and if it is one plain word or number that literal must be passed to a call like login. A task holds
    some texts at a time and runs one automaton after the other over them; a single one is kept."""

    def machine(shard: int) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for v in ds.dataset(f"{path}/shard={shard}", format="parquet").to_table(columns=["value"]).column(0).to_pylist():
            out.add_word(v, v)
        out.make_automaton()
        return out

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = machine(shards[0]) if len(shards) == 1 else None
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("snapshot_id", "path", "content", "delivery")], strict=True):
                held.append(row)
                size += len(row[2])
            if kept or size >= HELD:
                yield from search(held, kept)
                held, size = [], 0
        if held:
            yield from search(held, kept)

    def search(held: list[tuple], kept: ahocorasick.Automaton | None) -> Iterator[pa.RecordBatch]:
        for auto in [kept] if kept else map(machine, shards):
            rows = [(sid, p, when, *x) for sid, p, text, when in held for x in _places(text, auto)]
            if rows:
                yield _batch(rows)

    return find


def _places(text: str, machine: ahocorasick.Automaton) -> Iterator[tuple]:
    for at, v in machine.iter(text):
        a, b = at - len(v) + 1, at + 1
        if (a and (text[a - 1].isalnum() or text[a - 1] in "_-/+")) or (b < len(text) and (text[b].isalnum() or text[b] in "_-/+")):
            continue
        start = text.rfind("\n", 0, a) + 1
        if len(v) < 8 and not _quoted(text, start, a, b, v):
            continue
        yield text.count("\n", 0, start), "known", v, a - start, b - start


def _quoted(text: str, start: int, a: int, b: int, v: str) -> bool:
    """Whether the short value at ``a``..``b``, in the line from ``start``, stands in a string literal as a secret may."""
    end = text.find("\n", b)
    for x in _LITERAL.finditer(text, start, len(text) if end < 0 else end):
        if x.start() < a and b < x.end():
            return plausible(v, "pass") or (x.end() - x.start() == len(v) + 2 and any(m["login"] and "," in text[m.end() : a] and ")" not in text[m.end() : a] for m in _CALL.finditer(text, start, a)))
    return False


def redact(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with each (line, start, end, kind) masked and all else as it is: quotes stay, strings that code joins
    stay joined (the first holds the mask), and of a private key the lines between its marks are masked."""
    lines = text.split("\n")
    for no, start, end, kind in sorted(spans, reverse=True):
        if no >= len(lines):
            continue
        line = lines[no]
        if kind == "block":
            head = start + BLOCK.match(line, start).end() - start
            rest = "\n".join(lines[no:])
            until, _ = block_end(rest, head)
            lines[no:] = (rest[:head] + re.sub(r"(?<!\\)[A-Za-z0-9+/=]{8,}", MASK, rest[head:until]) + rest[until:]).split("\n")
            continue
        part = line[start:end]
        if part[:1] in "\"'`" or (len(part) > 1 and part[1:2] in "\"'"):
            first = True

            def mask(m: re.Match) -> str:
                nonlocal first
                inner, first = (MASK if first else ""), False
                return m[0][0] + inner + m[0][-1]

            part = _LITERAL.sub(mask, part)
        else:
            part = MASK
        lines[no] = line[:start] + part + line[end:]
    return "\n".join(lines)


def redacted(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, path, content, secrets): the text of each entry that counts and holds credentials, masked."""
    spans = find_credentials(snapshots, files).groupBy("snapshot_id", "path").agg(F.collect_list(F.struct("line_no", "start", "end", "kind")).alias("spans"))
    counts = newest(files.filter("snapshot_id is not null and path is not null").select("snapshot_id", clean_path("path").alias("path"), "content", "received_at", "deleted"), ["snapshot_id", "path"])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("content").to_pylist(), batch.column("spans").to_pylist()
            done = [redact(t, [(s["line_no"], s["start"], s["end"], s["kind"]) for s in x]) for t, x in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("snapshot_id"), batch.column("path"), pa.array(done, pa.string()), pa.array([len({s["line_no"] for s in x}) for x in spans], pa.int64())], ["snapshot_id", "path", "content", "secrets"])

    return counts.filter("content is not null").join(spans, ["snapshot_id", "path"]).select("snapshot_id", "path", "content", "spans").mapInArrow(mask, "snapshot_id string, path string, content string, secrets long")


_FOUND = "snapshot_id string, path string, delivery long, line_no long, kind string, value string, start int, end int"


def _batch(rows: list[tuple], index: list[tuple] | None = None) -> pa.RecordBatch:
    types, names = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()], ["snapshot_id", "path", "delivery", "line_no", "kind", "value", "start", "end"]
    if index is not None:  # finds, and a row for each text with the names of its literals
        types, names = [*types, pa.int64(), pa.list_(pa.int64())], [*names, "name", "names"]
        rows = [(*r, None) for r in rows] + [(sid, path, when, *[None] * 6, found) for sid, path, when, found in index]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)
