"""Scanning a folder of files: ignore rules, globs, binary files, and the folder a project begins in."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.session import staged
from stratalog.sources.tables import spread
from stratalog.functions.text import binary_name, glob_regex

# What is always left out, the files that hold ignore rules (the first that exists counts alone), and
# what tells the folder of a project.
ALWAYS = (".snapshots/", "node_modules/", ".git/", ".venv/", "venv/", "env/", ".env/", "virtualenv/", "__pycache__/", ".tox/")
RULES = (".snapshotignore", ".gitignore")
INDICATORS, ENOUGH, CLIMB = (".git", "package.json", "src", "README.md", "tsconfig.json", "pyproject.toml"), 3, 5
SNIFFED, LARGE, STRANGE = 512, 1 << 20, 0.1


def to_glob(rule: str) -> str:
    """A line of an ignore file as a glob over whole paths."""
    rule = rule.replace("\\ ", "\0").rstrip().replace("\0", " ")
    anchored = rule.startswith("/")
    rule = rule.lstrip("/")
    if rule.endswith("/"):
        rule += "**"
    return rule if anchored else f"**/{rule}"


def ignore_rules(folder: str) -> tuple[list[str], list[str]]:
    """(globs left out, globs taken in again by ``!``) of a folder; an own rules file replaces the common one, even if empty."""
    lines: list[str] = []
    for name in RULES:
        file = Path(folder, name)
        if file.exists():
            lines = file.read_text(errors="replace").splitlines()
            break
    kept = [x.strip() if not x.endswith("\\ ") else x.lstrip() for x in lines if x.strip() and not x.lstrip().startswith("#")]
    return [to_glob(x) for x in (*ALWAYS, *(x for x in kept if not x.startswith("!")))], [to_glob(x[1:]) for x in kept if x.startswith("!")]


def any_glob(path: Column, globs: list[str]) -> Column:
    """Whether a path, or a folder it lies in, matches one of the globs."""
    if not globs:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{glob_regex(g)[:-1]}(?:/.*)?$)" for g in globs))


def strange_bytes(head: bytes) -> bool:
    """Whether the first bytes hold a NUL, or more than a tenth are neither printable ASCII nor tab or line end."""
    if not head:
        return False
    a = np.frombuffer(head, np.uint8)
    plain = ((a >= 32) & (a <= 126)) | np.isin(a, (9, 10, 13))
    return bool((a == 0).any() or (~plain).mean() > STRANGE)


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for root, path, named, sniff in part[["root", "path", "named", "sniff"]].itertuples(index=False):
            try:
                stat = os.stat(os.path.join(root, path))
                data = b"" if named or (sniff and stat.st_size > LARGE) else Path(root, path).read_bytes()
            except OSError:  # gone or unreadable since it was listed
                continue
            binary = bool(named or (sniff and (stat.st_size > LARGE or strange_bytes(data[:SNIFFED]))))
            rows.append((path, None if binary or b"\0" in data else data.decode("utf-8", "replace"), binary, stat.st_size, pd.Timestamp(stat.st_mtime_ns, unit="ns").floor("us")))
        yield pd.DataFrame(rows, columns=["path", "content", "is_binary", "bytes", "modified"])


def _listing(root: str, skipped: set[str]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for at in part["path"]:
                try:
                    with os.scandir(os.path.join(root, at)) as names:
                        rows += [(f"{at}/{x.name}" if at else x.name, x.is_dir(follow_symlinks=False)) for x in names if not (x.is_dir() and (x.is_symlink() or x.name in skipped))]
                except OSError:  # gone or unreadable since it was listed
                    continue
            yield pd.DataFrame(rows, columns=["path", "folder"])

    return run


def scan(spark: SparkSession, folder: str, sniff: bool = True) -> DataFrame:
    """(path, content, is_binary, bytes, modified) of the files below a folder, one that all executors see, which its
    rules do not leave out; files with a leading point too, which Spark's own readers pass over.

    Tasks list folders, level by level, and read the texts; folders left out entirely are not entered. A file is binary by its name, or, with
    ``sniff``, by its size of over 1 MiB or its first bytes; it has no content, nor has one with a NUL.
    """
    root = str(Path(folder).resolve())
    out, back = ignore_rules(root)
    skipped = {g.removeprefix("**/").removesuffix("/**") for g in map(to_glob, ALWAYS)}
    level, listed = spark.createDataFrame([("",)], "path string"), spark.createDataFrame([], "path string")
    while True:
        found = staged(level.mapInPandas(_listing(root, skipped), "path string, folder boolean"))
        listed = listed.unionByName(found.filter("not folder").select("path"))
        level = found.filter("folder").select("path")
        if level.isEmpty():
            break
        level = spread(level)
    kept = listed.filter(~any_glob(F.col("path"), out) | any_glob(F.col("path"), back))
    flagged = kept.select(F.lit(root).alias("root"), "path", binary_name("path").alias("named"), F.lit(sniff).alias("sniff"))
    return flagged.mapInPandas(_read, "path string, content string, is_binary boolean, bytes long, modified timestamp")


def project_folder(start: str) -> str | None:
    """The nearest folder, at most five up, that looks like a project or holds a store of snapshots."""
    at = Path(start).resolve()
    for _ in range(CLIMB + 1):
        if sum((at / x).exists() for x in INDICATORS) >= ENOUGH or (at / ".snapshots" / "index.json").exists():
            return str(at)
        if at == at.parent:
            break
        at = at.parent
    return None


def apply_actions(actions: DataFrame, folder: str) -> int:
    """Write and delete the files of an action table (path, action, content) below ``folder``, one that all executors
    see, in the tasks; to do so again changes nothing. If a path leads out of the folder, nothing is done at all.
    Returns the number of actions."""
    root = str(Path(folder).resolve())
    own = staged(actions.select("path", "action", "content"))
    bad = own.select("path").mapInPandas(_outside(root), "path string").first()
    if bad:
        raise ValueError(f"{bad.path} leads out of {root}")
    return own.mapInPandas(_applied(root), "n long").agg(F.sum("n")).first()[0] or 0


def _outside(root: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[not (Path(root) / p).resolve().is_relative_to(root) for p in part["path"]]]

    return run


def _applied(root: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, action, content in part[["path", "action", "content"]].itertuples(index=False):
                target = (Path(root) / path).resolve()
                if action == "delete":
                    target.unlink(missing_ok=True)
                else:
                    os.makedirs(target.parent, exist_ok=True)
                    target.write_text(content or "", newline="")
            yield pd.DataFrame({"n": [len(part)]})

    return run
