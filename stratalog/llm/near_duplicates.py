"""Near-duplicate texts by a prefix-tree join of their n-gram sets in one global order."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.components import components
from stratalog.session import dropped, staged
from stratalog.sources.tables import spread

_WORD = re.compile(r"[a-z0-9_]+")
_LOW = np.uint64((1 << 48) - 1)
#: Texts whose n-grams are packed at once, members of a group that one task joins, words kept by name in a task, copies
#: of a text that meet in one part, hash ranges up to which all are counted in one pass over the texts.
BATCH, BLOCK, CACHE, COPIES, AT_ONCE = 4096, 1500, 1_000_000, 2000, 64


def text_key(group: str, text: str):
    """64-bit name of a text within its group; line ends ``\\r\\n`` and ``\\n`` are alike."""
    return F.xxhash64(F.col(group), F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")))


def near_pairs(docs: DataFrame, group: str, text: str, words: int = 5, threshold: float = 0.8, min_words: int = 0) -> DataFrame:
    """(group, key_a, key_b, common, size_a, size_b): all pairs of different texts of one group whose sets of ``words``
    consecutive words have a Jaccard similarity of at least ``threshold``; keys are those of ``text_key``, key_a < key_b.

    Words are runs of a-z, 0-9, _ in the lower-cased text. Texts with fewer than ``min_words`` words, or than ``words``,
    have no pairs; nor have null texts. Copies of a text are one text.

    1. Every task packs the n-grams of its texts by hash range into a few large rows.
    2. Each range counts in how many texts each n-gram is. The global order is by that count, the rare first. An n-gram
       of one text tells nothing and goes no further. With more than AT_ONCE ranges this is done for one half of them
       after the other: a pass more over the texts, so that half as much lies on disk at once.
    3. Each text puts its n-grams in order, and the set is kept once. Texts too little of which is shared with others drop out.
    4. Two similar texts share an n-gram among the first n - ceil(t n) + 1 of each. Only the key of a text, its size and
       how much is left of it go to each n-gram of its prefix. There a text stays if another one of it is such that their sizes
       and what is left of both allow the similarity; those that stay are sent to the least key of them, their leader.
    5. The texts of a leader, now with their sets, are joined in a prefix tree, the frequent n-grams first, so that overlaps
       shared by many texts are counted once; subtrees are left when the lengths that remain can't give the overlap needed.
       Leaders with more than BLOCK texts are split into pairs of blocks.
    No similar pair is dropped on the way. N-grams are known by 48 bits and those of their range, 64 at most.
    """
    ranges = _ranges(docs)
    keyed = docs.filter(F.col(text).isNotNull()).select(F.col(group).alias("g"), text_key(group, text).alias("k"), F.col(text).alias("t"))
    step = ranges if ranges <= AT_ONCE else ranges // 2
    counted = [_counted(keyed, words, min_words, ranges, lo, lo + step) for lo in range(0, ranges, step)]
    halves = [_sets(counted, threshold, lo, lo + step) for lo in range(0, ranges, step)]
    for x in counted:
        dropped(x)
    sets = reduce(DataFrame.unionByName, halves)
    thin = sets.mapInArrow(_firsts(threshold), "gram long, key long, size int, left int")
    sent = staged(thin.repartition("gram").sortWithinPartitions("gram").mapInArrow(_meeting(threshold), "leader long, key long").distinct())
    sizes = sent.groupBy("leader").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("k"))
    placed = sent.join(sizes, "leader").withColumn("k", blocks).withColumn("b", F.when(F.col("k") == 1, F.lit(0)).otherwise(own).cast("int"))
    placed = placed.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("leader", F.least("b", "c").alias("lo"), F.greatest("b", "c").alias("hi"), "b", "key")
    placed = placed.join(sets, "key").select("leader", "lo", "hi", "b", "key", "size", "grams")
    joined = placed.repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi", "size", "key").mapInArrow(_joined(threshold), "key_a long, key_b long, common int, size_a int, size_b int")
    return joined.distinct()


def _counted(keyed: DataFrame, words: int, min_words: int, ranges: int, lo: int, hi: int) -> DataFrame:
    """The n-grams of the ranges from ``lo`` to ``hi`` that texts share, by part of the texts, and with the first of them
    the sizes of all texts."""
    packed = spread(keyed).mapInArrow(_pack(words, min_words, ranges, lo, hi), "part int, grams binary, counts binary, keys binary, sizes binary")
    return staged(packed.repartition("part").sortWithinPartitions("part").mapInArrow(_grouped(_count(ranges)), "part int, range int, keys binary, grams binary, df binary, sizes binary"))


def _sets(counted: list[DataFrame], threshold: float, lo: int, hi: int) -> DataFrame:
    """(key, size, grams): the texts of the parts from ``lo`` to ``hi`` that share enough, with all n-grams they share."""
    own = reduce(DataFrame.unionByName, counted).filter((F.col("part") >= lo) & (F.col("part") < hi))
    return staged(own.repartition("part").sortWithinPartitions("part").mapInArrow(_grouped(_ordered(threshold)), "key long, size int, grams binary"))


def long_enough(text: str, min_words: int):
    """Whether a text has ``min_words`` words, so that it can be in pairs."""
    return F.regexp_count(F.lower(text), F.lit(_WORD.pattern)) >= min_words


def members(docs: DataFrame, ident: str, group: str, text: str, min_words: int = 5) -> DataFrame:
    """(group, id, k, comparable): the documents of each text, without the texts; a null text is one of its own."""
    key = F.when(F.col(text).isNull(), F.xxhash64(F.lit("null"), F.col(group), F.col(ident))).otherwise(text_key(group, text))
    return docs.select(F.col(group).alias("group"), F.col(ident).alias("id"), key.alias("k"), F.coalesce(long_enough(text, min_words), F.lit(False)).alias("comparable"))


def near_duplicates(docs: DataFrame, member: DataFrame, group: str, text: str, words: int = 5, threshold: float = 0.8, min_words: int = 0) -> DataFrame:
    """(group, id, class_id, links): of each of the ``members`` the class of texts linked to its own, directly or by
    others, and the number of different texts its own text is linked to. A text linked to none, a null or a short one
    is a class of its own. Copies have one class."""
    near = near_pairs(docs, group, text, words, threshold, min_words)
    pairs = staged(near)
    dropped(near)  # the sets
    both = pairs.select(F.col("key_a").alias("k")).unionAll(pairs.select(F.col("key_b").alias("k")))
    links = both.groupBy("k").agg(F.count("*").alias("links"))
    classes = components(pairs.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).withColumnRenamed("node", "k")
    return member.distinct().join(classes, "k", "left").join(links, "k", "left").select("group", "id", F.coalesce("component", "k").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def expand_pairs(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """(group, id_a, id_b), id_a < id_b: the ``members`` whose texts make the pairs."""
    used = pairs.select(F.col("key_a").alias("k")).unionAll(pairs.select(F.col("key_b").alias("k"))).distinct()
    own = staged(member.join(used, "k", "left_semi").select("group", "id", "k").distinct())
    a, b = (own.select(F.col("group").alias(f"g_{x}"), F.col("id").alias(x), F.col("k").alias(f"key_{x}")) for x in "ab")
    both = pairs.select("key_a", "key_b").join(a, "key_a").join(b, "key_b")
    return both.filter("a <> b").select(F.col("g_a").alias("group"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def copy_pairs(member: DataFrame) -> DataFrame:
    """(group, id_a, id_b), id_a < id_b: the ``members`` that have the very same text, if it is long enough to be
    compared. A text of m members has m (m - 1) / 2 such pairs, so this is for results that must name them all; members
    meet in parts of COPIES, whatever m is. ``near_duplicates`` gives the same groups in one row for each member."""
    own = member.filter("comparable").select("group", "id", "k").distinct()
    parts = own.groupBy("group", "k").agg(F.count("*").alias("n")).filter("n > 1").select("group", "k", F.ceil(F.col("n") / COPIES).cast("int").alias("parts"))
    own = staged(own.join(parts, ["group", "k"]))
    a = own.select("group", "k", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("id_a"))
    b = own.select("group", "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("id_b"))
    return a.join(b, ["group", "k", "part"]).filter("id_a < id_b").select("group", "id_a", "id_b")


def _ranges(docs: DataFrame) -> int:
    """Hash ranges: a power of two, so many that one holds the n-grams of about 4 MB of the input as estimated, or 2**15
    where the plan has no estimate (an input that is no table)."""
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1 << (15 if stored >= 1 << 58 else max(4, (stored // 4_000_000).bit_length()))


class _Names(dict):
    """64-bit names of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _grams(groups: list[str], contents: list[str], names: _Names, words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of texts, ascending, and the text of each."""
    parts, sizes, seeds = [], [], []
    for g, t in zip(groups, contents, strict=True):
        found = _WORD.findall(t.lower())
        n = len(found) if len(found) >= max(min_words, words) else 0
        sizes.append(n)
        seeds.append(xxhash.xxh3_64_intdigest(str(g), seed=7))
        if n:
            parts.append(np.fromiter(map(names.__getitem__, found), np.uint64, n))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.concatenate(parts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    m = len(w) - words + 1
    h = np.array(seeds, np.uint64)[owner[:m]]
    for i in range(words):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m])
    inside = owner[:m] == owner[words - 1 :]
    h, owner = h[inside], owner[:m][inside]
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], owner[new]


def _pack(words: int, min_words: int, ranges: int, lo: int, hi: int):
    bits = ranges.bit_length() - 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        held: dict[int, tuple[str, int, str]] = {}  # a text that comes again before it is sent is sent once
        size = 0
        for batch in batches:
            for row in zip(batch.column("g").to_pylist(), batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if row[1] in held:
                    continue
                held[row[1]] = row
                size += len(row[2])
                if len(held) == BATCH or size > 16_000_000:
                    yield from flush(list(held.values()), names)
                    held, size = {}, 0
        if held:
            yield from flush(list(held.values()), names)

    def flush(held: list[tuple[str, int, str]], names: _Names) -> Iterator[pa.RecordBatch]:
        groups, keys, contents = zip(*held, strict=True)
        h, owner = _grams(groups, contents, names, words, min_words)
        if not len(h):
            return
        k = np.array(keys, np.int64)
        if not lo:
            n = np.bincount(owner, minlength=len(keys)).astype(np.int32)
            order = np.flatnonzero(n)[np.argsort(k[n > 0])]
            yield _rows([(ranges + to, b"", b"", k[order[a:b]].tobytes(), n[order[a:b]].tobytes()) for to, a, b in _parts(k[order], bits)], _PACKED, _PACKED_NAMES)
        part = (h >> np.uint64(64 - bits)).astype(np.int64)
        inside = slice(*np.searchsorted(part, (lo, hi)))
        h, owner, part = h[inside], owner[inside], part[inside]
        order = np.argsort(part * len(keys) + owner, kind="stable")
        h, owner = h[order], owner[order]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        low = (h & _LOW).view(np.uint8).reshape(-1, 8)[:, :6]
        rows = []
        for a, b in pairwise(edges.tolist()):
            first = np.flatnonzero(np.r_[True, owner[a + 1 : b] != owner[a : b - 1], True])
            rows.append((int(part[a]), low[a:b].tobytes(), np.diff(first).astype(np.uint32).tobytes(), k[owner[a:b][first[:-1]]].tobytes(), b""))
        if rows:
            yield _rows(rows, _PACKED, _PACKED_NAMES)

    return pack


_PACKED, _PACKED_NAMES = (pa.int32(), *[pa.binary()] * 4), ("part", "grams", "counts", "keys", "sizes")
_COUNTED, _COUNTED_NAMES = (pa.int32(), pa.int32(), *[pa.binary()] * 4), ("part", "range", "keys", "grams", "df", "sizes")


def _parts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the stretches of ascending keys that have the same first ``bits``. Keys are sorted as signed
    numbers; parts of the negative ones come first, each part is still one stretch."""
    to = (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
    for a, b in pairwise(edges.tolist()):
        yield int(to[a]), a, b


def _wide(raw: bytes) -> np.ndarray:
    """N-grams of 48 bits as numbers."""
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _scaled(df: np.ndarray) -> np.ndarray:
    """Counts in a byte, in the same order: exact below 192, then four steps to a doubling."""
    return np.where(df < 192, df, 192 + np.minimum(63, 4 * np.log2(np.maximum(df, 192) / 192))).astype(np.uint8)


def _rows(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _grouped(work):
    """Rows sorted by ``part``, one part at a time, for ``work(part, rows)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield from work(part, held)
                    part, held = row["part"], []
                held.append(row)
        if held:
            yield from work(part, held)

    return run


def _count(ranges: int):
    bits = ranges.bit_length() - 1

    def count(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if part >= ranges:
            k, n = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", np.int64), ("sizes", np.int32)))
            k, first = np.unique(k, return_index=True)
            yield _rows([(part - ranges, -1, k.tobytes(), b"", b"", n[first].tobytes())], _COUNTED, _COUNTED_NAMES)
            return
        grams, keys = [], []
        while rows:  # a row is let go when it has been taken over
            r = rows.pop()
            grams.append(_wide(r["grams"]))
            keys.append(np.repeat(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.uint32)))
        g, k = np.concatenate(grams), np.concatenate(keys)
        order = np.lexsort((k, g))
        g, k = g[order], k[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])  # copies of a text
        g, k = g[new], k[new]
        df = np.diff(np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)])
        df = np.repeat(df, df)
        g, k, df = g[df >= 2], k[df >= 2], _scaled(df[df >= 2])
        order = np.argsort(k, kind="stable")
        g, k, df = g[order], k[order], df[order]
        low = g.view(np.uint8).reshape(-1, 8)[:, :6]
        out = [(to, part, k[a:b].tobytes(), low[a:b].tobytes(), df[a:b].tobytes(), b"") for to, a, b in _parts(k, bits)]
        if out:
            yield _rows(out, _COUNTED, _COUNTED_NAMES)

    return count


def needed(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Least n-grams that sets of such ``sizes`` must share with a similar one."""
    return np.ceil(threshold * sizes - 1e-9).astype(np.int64)


def _ordered(threshold: float):
    def ordered(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        texts, shares = [r for r in rows if r["range"] < 0], [r for r in rows if r["range"] >= 0]
        rows.clear()
        if not shares:
            return
        known, n = (np.concatenate([np.frombuffer(r[c], t) for r in texts]) for c, t in (("keys", np.int64), ("sizes", np.int32)))
        k, df = (np.concatenate([np.frombuffer(r[c], t) for r in shares]) for c, t in (("keys", np.int64), ("df", np.uint8)))
        g = np.concatenate([_wide(r["grams"]) | np.uint64((r["range"] & 0xFFFF) << 48) for r in shares])
        shares.clear()
        order = np.lexsort((g, df, k))
        k, g = k[order], g[order]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        shared = np.diff(np.r_[first, len(k)])
        by_key = np.argsort(known)
        n = n[by_key[np.searchsorted(known, k[first], sorter=by_key)]]
        enough = shared >= needed(n, threshold)
        out = []
        for a, m, size in zip(first[enough].tolist(), shared[enough].tolist(), n[enough].tolist(), strict=True):
            out.append((int(k[a]), size, g[a : a + m].tobytes()))
            if len(out) > 2000:
                yield _rows(out, _SET, ("key", "size", "grams"))
                out = []
        if out:
            yield _rows(out, _SET, ("key", "size", "grams"))

    return ordered


_SET = (pa.int64(), pa.int32(), pa.binary())


def _firsts(threshold: float):
    """The n-grams of each set's prefix: what only this text has would come first, so it is that much shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = (batch.column(c).to_numpy() for c in ("key", "size"))
            sets = [np.frombuffer(x, np.int64) for x in batch.column("grams").to_pylist()]
            if not sets:
                continue
            m = np.array([len(x) for x in sets])
            prefix = m - needed(n, threshold) + 1
            at = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            grams = np.concatenate([x[:p] for x, p in zip(sets, prefix.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(k, prefix)), pa.array(np.repeat(n, prefix)), pa.array((np.repeat(m, prefix) - at).astype(np.int32))], ["gram", "key", "size", "left"])

    return run


def _meeting(threshold: float):
    """(leader, key) of the texts at each n-gram, of rows sorted by it, that some other one there can be similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the n-gram that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("gram", "key", "size", "left")]
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if held and (cut or held[0][0][0] != new[0][0]):
                yield meet([*held, [x[:cut] for x in new]])
                held = []
            elif cut:
                yield meet([[x[:cut] for x in new]])
            held.append([x[cut:] for x in new])
        if held:
            yield meet(held)

    def meet(rows: list[list[np.ndarray]]) -> pa.RecordBatch:
        g, k, size, left = (np.concatenate(x) for x in zip(*rows, strict=True))
        stay = possible(g, size, left, threshold)
        g, k = g[stay], k[stay]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        leaders = np.repeat(np.minimum.reduceat(k, first), np.diff(np.r_[first, len(g)])) if len(g) else k
        return pa.RecordBatch.from_arrays([pa.array(leaders), pa.array(k)], ["leader", "key"])

    return run


def possible(group: np.ndarray, size: np.ndarray, left: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows, sorted by group, have another one in their group that may be similar: the two have ``left`` in common at
    most, the lesser of theirs, so neither size may be over the ``most`` that the other row allows."""
    most = np.clip(np.floor((left * (1 + threshold) + 1e-6) / threshold).astype(np.int64) - size, 0, (1 << 31) - 1)
    at = np.cumsum(np.r_[False, group[1:] != group[:-1]]) << 32  # groups in the upper half of a number
    order = np.lexsort((size, at))
    here, n, most = at[order], size[order].astype(np.int64), most[order]
    # of the rows up to each one, by size, the largest and the second largest ``most``
    top = np.maximum.accumulate(here + most)
    second = np.maximum.accumulate(np.minimum(here + most, np.r_[-1, top[:-1]]))
    last = np.searchsorted(here + n, here + most, side="right") - 1  # the last row that is not too large
    best = np.where(most >= n, second[last], top[last])  # without the row itself, where it is among them
    stay = np.empty(len(order), bool)
    stay[order] = (last >= 0) & (best >= here + n)
    return stay


class Tree:
    """A prefix tree of sets in one order. An edge holds a run of n-grams, so an overlap with it is counted once for
    all sets below. Nodes know the least and largest sizes of the sets below and the most n-grams still to come."""

    __slots__ = ("children", "ends", "last", "longest", "run", "set", "sizes")

    def __init__(self, run: tuple[int, ...] = ()) -> None:
        self.run, self.set, self.last = run, frozenset(run), run[-1] if run else -1
        self.children: dict[int, Tree] = {}
        self.ends: list[tuple[int, int, int]] = []
        self.longest, self.sizes = 0, (1 << 60, 0)

    def insert(self, grams: tuple[int, ...], end: tuple[int, int, int]) -> None:
        node, at, size = self, 0, end[1]
        node._see(len(grams), size)
        while at < len(grams):
            child = node.children.get(grams[at])
            if child is None:
                child = node.children[grams[at]] = Tree(grams[at:])
                at = len(grams)
                child._see(0, size)
                node = child
                break
            same, run = 0, child.run
            most = min(len(run), len(grams) - at)
            while same < most and run[same] == grams[at + same]:
                same += 1
            if same < len(run):
                upper = Tree(run[:same])
                upper.children[run[same]] = child
                upper.longest, upper.sizes = child.longest + len(run) - same, child.sizes
                child.run, child.set = run[same:], frozenset(run[same:])
                node.children[grams[at]] = child = upper
            at += same
            child._see(len(grams) - at, size)
            node = child
        node.ends.append(end)

    def _see(self, remaining: int, size: int) -> None:
        self.longest = max(self.longest, remaining)
        self.sizes = (min(self.sizes[0], size), max(self.sizes[1], size))

    def similar(self, grams: tuple[int, ...], size: int, threshold: float) -> Iterator[tuple[tuple[int, int, int], int]]:
        """(end, common) of each set inserted that is similar to ``grams``, a set of ``size`` with those it shares."""
        whole, todo = frozenset(grams), [(self, 0)]
        while todo:
            node, common = todo.pop()
            common += len(whole & node.set)
            ahead = len(grams) - bisect_right(grams, node.last)
            for end in node.ends:
                if common >= threshold * (size + end[1] - common) - 1e-9:
                    yield end, common
            if node.children:
                bound = common + min(ahead, node.longest)
                if bound >= threshold * (size + max(node.sizes[0], ceil(threshold * size - 1e-9)) - bound) - 1e-9 and node.sizes[1] >= threshold * size - 1e-9:
                    todo += [(child, common) for child in node.children.values()]


def join_sets(items: list[tuple[int, int, int, np.ndarray]], threshold: float, cross: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """Similar pairs of (key, size, block, n-grams in global order), by size; if ``cross``, of different blocks only."""
    order = np.concatenate([x[3] for x in items])
    # ranks in one order that all lists follow, the last of the global order first
    rank = {g: i for i, g in enumerate(_merged([x[3] for x in items]))} if len(order) else {}
    trees = (Tree(), Tree()) if cross else (Tree(),)
    first = items[0][2]
    for key, size, block, grams in items:
        own = tuple(sorted(rank[x] for x in grams.tolist()))
        mine = int(block != first) if cross else 0
        for end, common in trees[1 - mine if cross else 0].similar(own, size, threshold):
            a, b = ((key, size), end[:2]) if key < end[0] else (end[:2], (key, size))
            if a[0] != b[0]:
                yield a[0], b[0], common, a[1], b[1]
        trees[mine].insert(own, (key, size, block))


def _merged(lists: list[np.ndarray]) -> list[int]:
    """All n-grams of the lists, those in most lists of the group first; ties by hash."""
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    return values[np.lexsort((values, -counts))].tolist()


def _joined(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []
        types, names = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), ("key_a", "key_b", "common", "size_a", "size_b")
        for batch in batches:
            for leader, lo, hi, b, key, size, grams in zip(*[batch.column(c).to_pylist() for c in ("leader", "lo", "hi", "b", "key", "size", "grams")], strict=True):
                if (leader, lo, hi) != group:
                    if len(held) > 1:
                        out += join_sets(held, threshold, group[1] != group[2])
                    group, held = (leader, lo, hi), []
                held.append((key, size, b, np.frombuffer(grams, np.uint64)))
            if len(out) > 10_000:
                yield _rows(out, types, names)
                out = []
        if len(held) > 1:
            out += join_sets(held, threshold, group[1] != group[2])
        if out:
            yield _rows(out, types, names)

    return run
