"""Mixing sources to target shares, by pivotal dependent rounding of copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.residue import host
from stratalog.llm.tokens import token_counts
from stratalog.session import staged

#: Texts of a source in one leaf of the reduction tree, and nodes that one inner node combines.
LEAF, FAN = 4096, 64
_STATE = "mix_id string, source string, ident long, n_tokens int, base int, share double, part int, copies int"


def _chance(seed: int, mix: str, a: int, b: int) -> float:
    """A number in [0, 1) fixed by what it decides, so that a task that runs again decides alike."""
    return xxhash.xxh3_64_intdigest(f"{seed}|{mix}|{a}|{b}") / 2.0**64


def pivot(p: float, size: int, q: float, other: int, chance: float) -> tuple[float, float]:
    """Move size from one of two items with fractional copies p, q to the other until one has none or one copy.
    p * size + q * other stays, and so do the expected values of p and q."""
    give, take = min((1 - p) * size, q * other), min(p * size, (1 - q) * other)
    if chance * (give + take) < take:
        p, q = p + give / size, q - give / other
    else:
        p, q = p - take / size, q + take / other
    near = lambda x: 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
    return near(p), near(q)


def combine(items: Iterator[tuple[int, int, int, float]], mix: str, seed: int) -> Iterator[tuple[int, int, int, float, int | None]]:
    """(ident, size, base, fraction) to (.., copies), the fraction of all but the last rounded to none or one copy."""
    held: tuple[int, int, int, float] | None = None
    for ident, size, base, p in items:
        if p <= 0.0 or p >= 1.0:
            yield ident, size, base, 0.0, base + int(p >= 1.0)
            continue
        if held is None:
            held = (ident, size, base, p)
            continue
        i, n, b, q = held
        q, p = pivot(q, n, p, size, _chance(seed, mix, i, ident))
        held = None
        for x, m, c, r in ((i, n, b, q), (ident, size, base, p)):
            if 0.0 < r < 1.0:
                held = (x, m, c, r)
            else:
                yield x, m, c, 0.0, c + int(r)
    if held:
        yield *held, None


def settle(items: list[tuple[int, int, int, float]], mix: str, seed: int) -> Iterator[tuple[int, int, int, float, int | None]]:
    """As ``combine``, for a leaf whose items all have one fraction and come the large first. Each is paired with all that
    follow as one: mass moves between it and their common fraction until the one or the other is integral, most often
    the one, as the rest is larger. So what is left in the end is one of the last, smallest items."""
    total, q = sum(x[1] for x in items), items[0][3]
    if q <= 0.0:
        yield from ((*x[:3], 0.0, x[2]) for x in items)
        return
    for n, (ident, size, base, _) in enumerate(items):
        total -= size
        if not total:
            yield ident, size, base, q, None
            return
        p, q = pivot(q, size, q, total, _chance(seed, mix, ident, -2))
        if 0.0 < p < 1.0:  # the rest is integral
            yield ident, size, base, p, None
            yield from ((*x[:3], 0.0, x[2] + int(q)) for x in items[n + 1 :])
            return
        yield ident, size, base, 0.0, base + int(p)
        if q in (0.0, 1.0):
            yield from ((*x[:3], 0.0, x[2] + int(q)) for x in items[n + 1 :])
            return


def budgets(counted: DataFrame, targets: DataFrame, total_tokens: int | None) -> list[tuple[str, str, float, int]]:
    """(mix, source, copies of each text expected, leaves). The total of a mix is ``total_tokens``, else the
    largest at which every source that has tokens can give its share without passing its cap."""
    known = {r.source: r for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("texts")).collect()}  # one row a named source
    sums = {s: r.tokens for s, r in known.items()}
    rows = targets.collect()
    out = []
    for mix in sorted({r.mix_id for r in rows}):
        own = [(r.source, r.target_share or 0.0, r.max_repeats if r.max_repeats is not None else 1, sums.get(r.source) or 0) for r in rows if r.mix_id == mix]
        able = [(s, w, cap, t) for s, w, cap, t in own if w > 0 and cap > 0 and t > 0]
        if able:
            total = total_tokens if total_tokens is not None else min(cap * t / w for _, w, cap, t in able)
            out += [(mix, s, min(float(cap), total * w / t), -(-known[s].texts // LEAF)) for s, w, cap, t in able]
    return out


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row for each mix and source, names spelled alike; shares of one source under several spellings add up."""
    named = targets.filter("mix_id is not null and source is not null").distinct().withColumn("source", host(F.col("source")))
    return named.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def draw(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(mix_id, source, ident, n_tokens, copies) of the texts that each mix draws, copies between 1 and its cap.

    Every text of a source is expected the same number of copies; the whole part is given, the fraction is rounded by
    the pivotal method, weighted by size: in leaves of about LEAF texts, dealt by a hash of their ids, then what is left
    of the leaves in a tree, FAN nodes to one. At each step the tokens of a source stay what they are, so its total
    differs from its share by less than one text, and as in a leaf the large texts settle first against all the
    smaller ones, by a small one. The draw depends on the texts and the seed alone, not on tasks or cores. Without ``total_tokens`` every source with tokens reaches its share and one without is left out; with
    it a source that its cap holds back gives what it can. Texts without tokens, of no source, or of a source that no mix
    names are never drawn. A null ``max_repeats`` is one.
    """
    spark = docs.sparkSession
    goals = F.broadcast(clean_targets(targets))  # a dimension of a few rows
    named = docs.withColumn("source", host(F.col("source"))).select(F.col(ident).cast("long").alias("ident"), "source", text).filter("ident is not null")
    named = named.join(goals.select("source").distinct(), "source", "left_semi")
    counted = staged(token_counts(named, ["ident", "source"], text, vocabulary))
    plan = budgets(counted, goals, total_tokens)
    if not plan:
        return spark.createDataFrame([], f"mix_id string, source string, {ident} long, n_tokens int, copies int")
    per = F.broadcast(spark.createDataFrame(plan, "mix_id string, source string, expected double, leaves int"))  # a row for each target
    leaf = F.pmod(F.xxhash64(F.lit(seed), "ident"), F.col("leaves")).cast("int")
    rest = counted.filter("n_tokens > 0").join(per, "source").select("mix_id", "source", "ident", "n_tokens", F.floor("expected").cast("int").alias("base"), (F.col("expected") - F.floor("expected")).alias("share"), leaf.alias("part"), F.lit(None).cast("int").alias("copies"))
    nodes, settled, leaves = max(n for *_, n in plan), None, True
    while True:
        rest = rest.repartition("mix_id", "source", "part").sortWithinPartitions("mix_id", "source", "part", F.col("n_tokens").desc(), "ident")
        now = staged(rest.mapInArrow(_round(seed, leaves, nodes == 1), _STATE))
        done = now.filter("copies is not null")
        settled = done if settled is None else settled.unionByName(done)
        if nodes == 1:
            break
        nodes, leaves = -(-nodes // FAN), False
        rest = now.filter("copies is null").withColumn("part", F.expr(f"part div {FAN}").cast("int"))
    return settled.filter("copies > 0").select("mix_id", "source", F.col("ident").alias(ident), "n_tokens", "copies")


def _round(seed: int, leaves: bool, top: bool):
    """Round the items of each (mix, source, part), which come sorted and fit a task; at the top of the tree the one item
    left of each is decided by its chance."""

    def done(key: tuple, items: list[tuple[int, int, int, float]]) -> Iterator[tuple]:
        mix, source, part = key
        for ident, size, base, share, copies in (settle(items, mix, seed) if leaves else combine(iter(items), mix, seed)):
            if copies is None and top:
                copies = base + int(_chance(seed, mix, ident, -1) < share)
            yield mix, source, ident, size, base, share, part, copies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        items: list[tuple[int, int, int, float]] = []
        for batch in batches:
            rows: list[tuple] = []
            for mix, source, ident, size, base, share, part, _ in zip(*[batch.column(i).to_pylist() for i in range(8)], strict=True):
                if (mix, source, part) != key:
                    if items:
                        rows += done(key, items)
                    key, items = (mix, source, part), []
                items.append((ident, size, base, share))
            if rows:
                yield _batch(rows)
        if items:
            yield _batch(list(done(key, items)))

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
    names = ["mix_id", "source", "ident", "n_tokens", "base", "share", "part", "copies"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, texts, copies, most_copies, tokens, actual_share) for every target, met or not."""
    by = drawn.groupBy("mix_id", "source").agg(F.count("*").alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies").cast("long") * F.col("n_tokens")).alias("tokens"))
    totals = by.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    both = clean_targets(targets).join(by, ["mix_id", "source"], "left").join(totals, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select("mix_id", "source", "target_share", zero("texts"), zero("copies"), zero("most_copies"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("actual_share"))
