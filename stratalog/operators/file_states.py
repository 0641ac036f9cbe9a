"""The state of every file after every snapshot, from full, delta and selective captures."""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import patches
from stratalog.sources.tables import clean_path, newest, small

_OUT = "workspace string, path string, first_ord int, end_ord int, last_ord int, is_binary boolean, digest binary"
#: Resolved texts of one file kept at hand, and the characters of one file's texts from which they are kept compressed.
_KEEP, _COMPRESS = 256, 32_000_000


def ordered_snapshots(snapshots: DataFrame) -> DataFrame:
    """Of each snapshot the delivery that counts, with ``ord`` (1.. by ts, snapshot_id in its workspace), ``last_ord``
    of the workspace, and ``next_full``, the next snapshot that looks at all paths (last_ord + 1 if none follows)."""
    one = newest(snapshots.filter("snapshot_id is not null").select("snapshot_id", "workspace", "ts", "is_selective", "selected_files", "received_at"), ["snapshot_id"])
    one = one.withColumn("is_selective", F.coalesce("is_selective", F.lit(False)))
    up = Window.partitionBy("workspace").orderBy("ts", "snapshot_id")
    down = Window.partitionBy("workspace").orderBy(F.col("ord").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    return (
        one.withColumn("ord", F.row_number().over(up))
        .withColumn("last_ord", F.max("ord").over(down))
        .withColumn("next_full", F.coalesce(F.last(F.when(~F.col("is_selective"), F.col("ord")), ignorenulls=True).over(before), F.col("last_ord") + 1))
        .drop("received_at")
    )


def file_states(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Ranges of snapshots over which a file stays as it is: (workspace, path, first_ord, end_ord exclusive, last_ord,
    is_binary, digest of the text with ``\\n`` line ends).

    One shuffle by (workspace, path) brings the entries of a file together; they are streamed in snapshot order, so a
    task holds the texts of one file only (compressed beyond a size). A text whose base is missing or whose patch
    does not fit has one fixed digest: it equals other such texts and differs from every known one. Rows without
    snapshot id or path, and rows of unknown snapshots, are left out.
    """
    snaps = ordered_snapshots(snapshots)
    slim = small(snaps.select("snapshot_id", "workspace", "ord", "last_ord", "next_full", "is_selective"))
    entries = (
        files.filter("snapshot_id is not null and path is not null")
        .select("snapshot_id", clean_path("path").alias("path"), "content", "diff", "base_snapshot_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("is_binary", F.lit(False)).alias("is_binary"), "received_at")
        .join(slim, "snapshot_id")
        .select("workspace", "path", "ord", "last_ord", "next_full", "is_selective", F.lit(False).alias("looked"), "snapshot_id", "content", "diff", "base_snapshot_id", "deleted", "is_binary", "received_at")
    )
    looked = snaps.filter("is_selective").select(
        "workspace", F.explode(F.transform("selected_files", clean_path)).alias("path"), "ord", "last_ord", "next_full", "is_selective", F.lit(True).alias("looked"), "snapshot_id",
        *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in ("content", "diff", "base_snapshot_id", "deleted", "is_binary", "received_at")],
    )
    rows = entries.unionByName(looked).filter("path is not null").repartition("workspace", "path")
    rows = rows.sortWithinPartitions("workspace", "path", "ord", F.col("looked").desc(), F.col("received_at").desc_nulls_last(), F.xxhash64("content", "diff", "base_snapshot_id", "deleted", "is_binary").desc())
    return rows.drop("received_at").mapInArrow(_ranges, _OUT)


def resolved_entries(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """(snapshot_id, path, content): the whole text of each live text entry that counts, null where it can't be had."""
    snaps = small(ordered_snapshots(snapshots).select("snapshot_id", "workspace", "ord", "last_ord", "next_full"))
    rows = (
        files.filter("snapshot_id is not null and path is not null")
        .select("snapshot_id", clean_path("path").alias("path"), "content", "diff", "base_snapshot_id", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("is_binary", F.lit(False)).alias("is_binary"), "received_at")
        .join(snaps, "snapshot_id")
        .withColumns({"is_selective": F.lit(False), "looked": F.lit(False)})
        .repartition("workspace", "path")
        .sortWithinPartitions("workspace", "path", "ord", F.col("received_at").desc_nulls_last(), F.xxhash64("content", "diff", "base_snapshot_id", "deleted", "is_binary").desc())
    )
    return rows.drop("received_at").mapInArrow(_texts, "snapshot_id string, path string, content string")


class _Entry:
    __slots__ = ("base", "binary", "deleted", "diff", "looked", "next_full", "ord", "packed", "present", "selective", "sid", "text")

    def __init__(self, row: dict) -> None:
        self.ord, self.sid, self.next_full, self.selective = row["ord"], row["snapshot_id"], row["next_full"], row["is_selective"]
        self.looked = self.present = self.packed = False
        self.text = self.diff = self.base = None
        self.deleted = self.binary = False

    def take(self, row: dict) -> None:
        self.present, self.text, self.diff, self.base, self.deleted, self.binary = True, row["content"], row["diff"], row["base_snapshot_id"], row["deleted"], row["is_binary"]
        if self.text is not None:
            self.text = self.text.replace("\r\n", "\n")

    def pack(self) -> None:
        if self.text is not None and not self.packed:
            self.text, self.packed = zlib.compress(self.text.encode("utf-8", "surrogatepass"), 1), True

    def whole(self) -> str | None:
        return zlib.decompress(self.text).decode("utf-8", "surrogatepass") if self.packed else self.text


class _Texts:
    """Texts of one file by snapshot, resolved along their bases."""

    def __init__(self, entries: list[_Entry]) -> None:
        self.by = {e.sid: e for e in entries if e.present}
        self.known: OrderedDict[str, str | None] = OrderedDict()

    def get(self, sid: str) -> str | None:
        chain: list[_Entry] = []
        seen: set[str] = set()
        text = None
        while True:
            if sid in self.known:
                text = self.known[sid]
                break
            e = self.by.get(sid)
            if e is None or e.deleted or e.binary or sid in seen:
                break
            if e.text is not None:
                text = e.whole()
                self._keep(sid, text)
                break
            seen.add(sid)
            chain.append(e)
            sid = e.base
        for e in reversed(chain):
            if text is not None and e.diff:
                text = patches.apply(text, e.diff.replace("\r\n", "\n"))
            self._keep(e.sid, text)
        return text

    def _keep(self, sid: str, text: str | None) -> None:
        self.known[sid] = text
        if len(self.known) > _KEEP:
            self.known.popitem(last=False)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, int, list[_Entry]]]:
    """The entries of one file at a time, in snapshot order, each the delivery that counts."""
    key, last, entries, held = None, 0, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            k = (row["workspace"], row["path"])
            if k != key:
                if key is not None:
                    yield (*key, last, entries)
                key, last, entries, held = k, row["last_ord"], [], 0
            if not entries or entries[-1].ord != row["ord"]:
                entries.append(_Entry(row))
            e = entries[-1]
            if row["looked"]:
                e.looked = True
            elif not e.present:
                e.take(row)
                held += len(e.text or "")
                if held > _COMPRESS:
                    for x in entries:
                        x.pack()
    if key is not None:
        yield (*key, last, entries)


_UNKNOWN = b"\0" * 16


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["workspace", "path", "first_ord", "end_ord", "last_ord", "is_binary", "digest"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    out: list[tuple] = []
    for workspace, path, last, entries in _files(batches):
        texts = _Texts(entries)
        now = None
        for e in entries:
            if e.selective and not e.looked:
                continue
            if now:
                out.append((workspace, path, now[0], min(now[1], e.ord), last, *now[2:]))
                now = None
            if e.present and not e.deleted:
                text = None if e.binary else texts.get(e.sid)
                digest = b"binary" if e.binary else _UNKNOWN if text is None else xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                now = (e.ord, e.next_full, e.binary, digest)
        if now:
            out.append((workspace, path, now[0], min(now[1], last + 1), last, *now[2:]))
        if len(out) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size = 0
    for _, path, _, entries in _files(batches):
        texts = _Texts(entries)
        for e in entries:
            if e.present and not e.deleted and not e.binary:
                text = texts.get(e.sid)
                out.append((e.sid, path, text))
                size += len(text or "")
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["snapshot_id", "path", "content"])
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["snapshot_id", "path", "content"])
