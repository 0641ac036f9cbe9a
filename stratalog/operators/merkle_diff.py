"""What changed between consecutive versions of a table, by digests of hash ranges compared from the top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import staged

#: Keys to a leaf, and bits from one level to the next.
LEAF_KEYS, STEP = 32, 4


def merkle_changes(states: DataFrame, scope: list[str], version: str, key: str, digest: str, last: str, level_bits: tuple[int, ...] | None = None, end: str | None = None) -> DataFrame:
    """Rows (scope.., version, key, change_kind) for each key added, removed or changed by a version against version - 1.

    ``states`` has a row for each (scope, key) and range of versions over which it is present with one digest, from
    ``version`` up to but not ``end`` (without ``end``: in ``version`` only), within 1..``last`` of the scope; version 1
    has no changes. A table that is delivered again and again is thus never spelled out for every version: a row counts
    where it comes and where it goes.

    Keys fall into 2**bits hash ranges. A node's digest is the xor of two 64-bit hashes of its rows, and their number;
    that of a version differs from the one before by what comes and goes, which is what is added up, by partial
    aggregation, an inner node from its children. Each level is compared only below nodes that differ on the level
    above; rows are compared only in leaves that differ. An equal digest for different rows has a chance of about 2**-128.
    Without ``level_bits`` the depth follows from the keys of the largest scope, LEAF_KEYS to a leaf. Null keys or
    digests compare as values of their own.
    """
    ends = F.col(version) + 1 if end is None else F.col(end)
    side = F.explode(F.array(F.struct(F.col(version).alias("v"), F.lit(1).alias("sign")), F.struct(ends.alias("v"), F.lit(-1).alias("sign"))))
    named = [F.col(last).alias("__last"), F.col(key).alias("__key"), F.xxhash64(key).alias("__at"), F.xxhash64(digest, key).alias("__h1"), F.xxhash64(F.lit(7), key, F.lit(1), digest).alias("__h2")]
    rows = states.select(*scope, *named, side.alias("__s")).select(*scope, "__key", "__at", "__h1", "__h2", F.col("__s.v").alias("__v"), F.col("__s.sign").alias("__sign"), "__last")
    rows = staged(rows.filter("__v > 1 and __v <= __last").drop("__last"))
    bits = level_bits or depth(rows, scope)
    node = F.shiftrightunsigned("__at", 64 - bits[-1]) if bits[-1] else F.lit(0).cast("long")
    rows = rows.withColumn("__node", node)
    nodes = _sums(rows, scope)
    levels = [nodes]
    for above, below in zip(bits[-2::-1], bits[:0:-1], strict=True):
        nodes = _sums(nodes.withColumn("__node", F.shiftright("__node", below - above)), scope)
        levels.insert(0, nodes)
    dirty = _differ(levels[0])
    for above, below, nodes in zip(bits, bits[1:], levels[1:], strict=False):
        dirty = _differ(_below(nodes, dirty, scope, below - above))
    found = _below(rows, dirty, scope, 0)
    pick = lambda c, sign: F.max(F.when(F.col("__sign") == sign, F.col(c)))
    pairs = found.groupBy(*scope, "__v", "__key").agg(pick("__h1", 1).alias("__c1"), pick("__h2", 1).alias("__c2"), pick("__h1", -1).alias("__p1"), pick("__h2", -1).alias("__p2")).filter("not (__c1 <=> __p1 and __c2 <=> __p2)")
    kind = F.when(F.col("__p1").isNull(), "added").when(F.col("__c1").isNull(), "removed").otherwise("changed")
    return pairs.select(*scope, F.col("__v").alias(version), F.col("__key").alias(key), kind.alias("change_kind"))


def depth(rows: DataFrame, scope: list[str]) -> tuple[int, ...]:
    """Bits of each level, so that a leaf of the scope with the most keys has about LEAF_KEYS of them."""
    most = rows.groupBy(*scope).agg(F.approx_count_distinct("__at").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = min(60, max(0, (most // LEAF_KEYS).bit_length()))
    return (*range(0, bits, STEP), bits)


def _sums(rows: DataFrame, scope: list[str]) -> DataFrame:
    """What comes and goes below each node of a version: the xor of the hashes, and the number."""
    return rows.groupBy(*scope, "__v", "__node").agg(F.bit_xor("__h1").alias("__h1"), F.bit_xor("__h2").alias("__h2"), F.sum("__sign").alias("__sign"))


def _differ(nodes: DataFrame) -> DataFrame:
    return nodes.filter("__h1 <> 0 or __h2 <> 0 or __sign <> 0")


def _below(rows: DataFrame, dirty: DataFrame, scope: list[str], bits: int) -> DataFrame:
    marks = dirty.select(*[F.col(c).alias(f"__d_{c}") for c in scope], F.col("__v").alias("__dv"), F.col("__node").alias("__dn"))
    on = [F.col(c).eqNullSafe(F.col(f"__d_{c}")) for c in scope] + [F.col("__v") == F.col("__dv"), F.shiftright("__node", bits) == F.col("__dn")]
    return rows.join(marks, on, "left_semi")
