"""Filling containers of fixed capacity, by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.tokens import token_counts
from stratalog.session import staged
from stratalog.sources.tables import small


class Packer:
    """Shortest-pack-first: lengths are placed longest first, each into the open packs with the least room that still
    holds it. A pattern stands for all packs made alike, so the work depends on the histogram only."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: list[int] = []
        self.open: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, packs]

    def _put(self, room: int, pattern: tuple[tuple[int, int], ...], packs: int) -> None:
        if not self.open[room]:
            insort(self.rooms, room)
        for held in self.open[room]:
            if held[0] == pattern:
                held[1] += packs
                return
        self.open[room].append([pattern, packs])

    def place(self, length: int, items: int) -> None:
        """``items`` of one length, not longer than the capacity and not longer than any length placed before."""
        while items:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length if length else items
                full, rest = divmod(items, each)
                if full:
                    self._put(self.capacity - each * length, ((length, each),), full)
                if rest:
                    self._put(self.capacity - rest * length, ((length, rest),), 1)
                return
            room = self.rooms[at]
            pattern, packs = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            each = min(room // length, items) if length else items
            used = min(packs, items // each)
            if used < packs:
                self._put(room, pattern, packs - used)
            self._put(room - each * length, (*pattern, (length, each)), used)
            items -= each * used

    def patterns(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """(pattern of (length, items), packs), in a fixed order."""
        return sorted(((p, n) for held in self.open.values() for p, n in held), key=lambda x: (x[0], x[1]))


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    packer = Packer(capacity)
    for length in sorted(histogram, reverse=True):
        packer.place(length, histogram[length])
    return packer.patterns()


def intervals(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, items to a container, first container): which ranks of a length go where."""
    out, container, rank = [], 0, defaultdict(int)
    for pattern, packs in patterns:
        for length, each in pattern:
            out.append((length, rank[length], rank[length] + each * packs, each, container))
            rank[length] += each * packs
        container += packs
    return out


def pack(docs: DataFrame, specs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(spec_id, container, ident, piece, first_token, n_tokens): for each spec every text in exactly one container,
    one larger than ``capacity_tokens`` in pieces of that many tokens and a rest.

    A container holds its texts and ``separator_tokens`` between two. A null or empty text has no tokens and takes only
    its separator. Rows with equal idents are texts of their own. Specs are a dimension of a few rows; one without
    capacity, or with one below 1, packs nothing.

    Texts are counted once and placed in one pass for all specs. Their histogram has at most capacity + 1 lengths and is all that the driver
    sees. Ranks within a length come from the rank in the task and the counts of the tasks before, so a length that a
    third of all texts share is never sorted or gathered; an equi-join on length and a range of ranks gives the containers.
    """
    spark = docs.sparkSession
    counted = staged(token_counts(docs, [ident], text, vocabulary))
    given = [(r.spec_id, r.capacity_tokens, max(0, r.separator_tokens or 0)) for r in specs.dropDuplicates(["spec_id"]).collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if not given:
        return counted.filter("false").select(F.lit("").alias("spec_id"), F.lit(0).cast("long").alias("container"), ident, F.lit(0).alias("piece"), F.lit(0).alias("first_token"), "n_tokens")
    every = F.explode(F.array(*[F.struct(F.lit(s).cast("string").alias("spec_id"), F.lit(c).cast("int").alias("capacity")) for s, c, _ in given])).alias("spec")
    whole, rest = F.expr("n_tokens div capacity").cast("int"), F.col("n_tokens") % F.col("capacity")
    sizes = counted.groupBy("part", "n_tokens").agg(F.count("*").alias("n")).select("part", "n_tokens", "n", every).select("part", "n_tokens", "n", "spec.*")
    # how many rows of the same length the tasks before have, whole texts, rests and full pieces of longer ones alike
    fits = F.col("n_tokens") <= F.col("capacity")
    by = staged(sizes.withColumn("length", F.when(fits, F.col("n_tokens")).otherwise(rest)).withColumn("full", F.when(fits, F.lit(0)).otherwise(whole)))
    tails = by.filter(fits | (F.col("length") > 0))
    order = Window.partitionBy("spec_id", "length").orderBy("n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).select("spec_id", "capacity", "part", "n_tokens", "length", "n", "before")
    fulls = by.filter("full > 0")
    histograms: dict[str, dict[int, int]] = defaultdict(dict)
    for r in tails.groupBy("spec_id", "length").agg(F.sum("n").alias("n")).collect():  # capacity + 1 lengths for each spec
        histograms[r.spec_id][r.length] = r.n
    full = {r.spec_id: r.n for r in fulls.groupBy("spec_id").agg(F.sum(F.col("n") * F.col("full")).alias("n")).collect()}
    rows, at_full = [], []
    for spec, capacity, separator in given:
        histogram = histograms[spec]
        # ranks of tails of the full length come first, then the full pieces
        at_full += [F.lit(spec), F.lit(histogram.get(capacity, 0)).cast("long")]
        if full.get(spec):
            histogram[capacity] = histogram.get(capacity, 0) + full[spec]
        packed = intervals(pack_histogram({length + separator: n for length, n in histogram.items()}, capacity + separator))
        rows += [(spec, length - separator, lo, hi, each, first) for length, lo, hi, each, first in packed]
    table = small(spark.createDataFrame(rows, "spec_id string, length int, lo long, hi long, each long, first long"))
    known = counted.join(tails.select("spec_id", "capacity", "part", "n_tokens", "length", "before"), ["part", "n_tokens"])
    ends = known.select("spec_id", "capacity", ident, F.when(fits, F.lit(0)).otherwise(whole).alias("piece"), "length", (F.col("before") + F.col("place")).alias("rank"))
    # within a task by length, and before it what all earlier tasks have: one row a task
    inside = Window.partitionBy("spec_id", "part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    tasks = fulls.groupBy("spec_id", "part").agg(F.sum(F.col("n") * F.col("full")).alias("own"))
    tasks = tasks.withColumn("earlier", F.sum("own").over(Window.partitionBy("spec_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).drop("own")
    firsts = fulls.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("full")).over(inside), F.lit(0))).join(tasks, ["spec_id", "part"]).select("spec_id", "capacity", "part", "n_tokens", "full", (F.col("before") + F.col("earlier")).alias("before"))
    pieces = counted.join(firsts, ["part", "n_tokens"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    start = F.element_at(F.create_map(*at_full), F.col("spec_id"))
    pieces = pieces.select("spec_id", "capacity", ident, "piece", F.col("capacity").alias("length"), (start + F.col("before") + F.col("place") * F.col("full") + F.col("piece")).alias("rank"))
    found = ends.unionByName(pieces).join(table, ["spec_id", "length"]).filter("rank >= lo and rank < hi")
    container = (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long")
    return found.select("spec_id", container.alias("container"), ident, "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("length").alias("n_tokens"))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, containers, pieces, tokens, separators, fill, later_pieces): fill is the share of the capacity of all
    containers that tokens and separators take."""
    each = packed.groupBy("spec_id", "container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("piece") > 0).alias("later"))
    total = each.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("items").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum(F.col("items") - 1).alias("gaps"), F.sum("later").alias("later"))
    both = total.join(F.broadcast(specs.dropDuplicates(["spec_id"])), "spec_id")
    separators = F.col("gaps") * F.coalesce("separator_tokens", F.lit(0))
    return both.select("spec_id", "containers", "pieces", "tokens", separators.alias("separators"), F.round((F.col("tokens") + separators) / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), F.col("later").alias("later_pieces"))
