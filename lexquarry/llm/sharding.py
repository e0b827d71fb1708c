"""Sharding by minimax contiguous partition.

All rows of equal text form one atom that no cut divides, and atoms are ordered
by the hash of their text.  The smallest feasible shard capacity over the
ordered atom sizes is found by binary search, each guess checked greedily, and
the order is cut there.  An atom larger than an even share of the rest (a text with very many
copies) is a shard by itself at its place in the order, and the search goes on over the rest.

The driver sees ranges of the order with their sums, never all atoms.  Ranges
in which a greedy pass of a capacity that is still possible may cut are divided
until each holds one atom, so the plan is that of the atoms themselves, while
what is read in a round is bounded by the shards and not by the rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.plans.storage import width, written


def greedy_cuts(ends: list[int], capacity: int) -> list[int]:
    """Ends (exclusive) of the runs that a greedy pass fills up to ``capacity``."""
    cuts, start = [], 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        start = bisect_right(ends, done + capacity, lo=start)
        cuts.append(start)
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Cuts of the smallest capacity that needs at most ``shards`` runs."""
    ends = list(accumulate(sizes))
    if not ends:
        return []
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(ends, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return greedy_cuts(ends, low)


def spans_of(giants: set[int], n: int) -> list[tuple[int, int]]:
    """The runs (start, end) of positions below ``n`` between ``giants``."""
    edges = [-1, *sorted(giants), n]
    return [(a + 1, b) for a, b in zip(edges, edges[1:]) if b > a + 1]


def giants_of(sizes: list[int], shards: int) -> set[int]:
    """Positions that get a shard of their own: each is larger than an even share of what the other giants leave."""
    giants: set[int] = set()
    left = sum(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        if len(giants) >= shards - 1 or sizes[at] * (shards - len(giants)) <= left:
            break
        giants.add(at)
        left -= sizes[at]
    while len(giants) + len(spans_of(giants, len(sizes))) > shards:  # more runs between giants than shards: the least giant joins its neighbours
        giants.remove(min(giants, key=lambda i: sizes[i]))
    return giants


def fluid_cuts(ends: list[int], several: list[bool], capacity: int) -> list[int]:
    """Offsets at which a greedy pass cuts when ranges of several atoms could be divided anywhere."""
    cuts, at = [], 0
    while at < ends[-1]:
        goal = at + capacity
        i = bisect_right(ends, goal)
        if i < len(ends) and not several[i]:
            goal = max(ends[i - 1] if i else 0, at + 1)
        at = min(goal, ends[-1])
        cuts.append(at)
    return cuts


def least_capacity(spans: list[list[int]], shards: int, low: int, count: Callable[[int, int], int]) -> int:
    """The smallest capacity from ``low`` on with which all spans (their ends) need at most ``shards`` runs; ``count(span, capacity)`` counts one's."""
    high = max((e[-1] for e in spans), default=low)
    while low < high:
        mid = (low + high) // 2
        if sum(count(i, mid) for i in range(len(spans))) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def plan_shards(ranges: list[tuple[int, int, bool]], shards: int) -> tuple[list[int], list[int]]:
    """(starts of the shards after the first, positions of ranges to divide before that is final) for ordered (start, size, several atoms) ranges."""
    sizes, several = [r[1] for r in ranges], [r[2] for r in ranges]
    giants = giants_of(sizes, shards)
    if divide := [i for i in sorted(giants) if several[i]]:
        return [], divide
    spans = spans_of(giants, len(ranges))
    ends = [list(accumulate(sizes[a:b])) for a, b in spans]
    kinds = [several[a:b] for a, b in spans]
    left = shards - len(giants)
    largest = max((sizes[i] for a, b in spans for i in range(a, b)), default=0)
    capacity = least_capacity(ends, left, largest, lambda i, c: len(greedy_cuts(ends[i], c)))
    atom = max((sizes[i] for a, b in spans for i in range(a, b) if not several[i]), default=1)
    least = least_capacity(ends, left, atom, lambda i, c: len(fluid_cuts(ends[i], kinds[i], c)))
    firsts, divide = set(giants) | {g + 1 for g in giants}, []
    for (start, _), e, kind in zip(spans, ends, kinds, strict=True):
        firsts |= {start + c for c in greedy_cuts(e, capacity)}
        early = 0
        for late in fluid_cuts(e, kind, capacity)[:-1]:  # no later than this, and no earlier than a pass of the least capacity over whole ranges
            at = bisect_right(e, early + least)
            early = max(early, e[at - 1] if at else 0)
            divide += [start + i for i in range(bisect_right(e, early), min(bisect_right(e, late) + 1, len(e))) if kind[i]]
    return [ranges[i][0] for i in sorted(firsts) if 0 < i < len(ranges)], sorted(set(divide))


def shard_starts(rows: DataFrame, shards: int, first_bits: int = 16, more_bits: int = 8) -> list[int]:
    """The hashes at which the shards after the first begin, for rows (hash, size)."""

    def sums(of: DataFrame, bits: int) -> list[tuple[int, int, bool, int]]:
        """(start, size, several atoms, bits) of each range of hashes that agree in so many bits; hashes are ordered as signed numbers."""
        parts = of.groupBy(F.shiftright("hash", 64 - bits).alias("at")).agg(F.sum("size"), F.min("hash") < F.max("hash")).collect()
        return [(at << (64 - bits), size, many, bits) for at, size, many in parts]

    ranges = sorted(sums(rows, first_bits))
    while True:
        starts, divide = plan_shards([r[:3] for r in ranges], shards)
        if not divide:
            return starts
        out, by_bits = {ranges[i] for i in divide}, defaultdict(list)
        for start, _, _, bits in out:
            by_bits[bits].append(start >> (64 - bits))
        for bits, at in by_bits.items():
            out_of = rows.filter(F.shiftright("hash", 64 - bits).isin(at))
            ranges += sums(out_of, min(64, bits + more_bits))
        ranges = sorted(r for r in ranges if r not in out)


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_bits: int = 16,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8 (null text: 8, and the CRC of no
    bytes).  The law is ``bytes``: shard sizes are as near equal as whole atoms
    allow.  ``slot`` counts the rows of a shard from 0 without gaps, in the
    order of salted cells so that a hot shard is numbered by many tasks.  Null
    ids are rows like any other; repeated rows get slots of their own.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    salts = width(spark, 32)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    rows = written(rows, "shard-rows")
    shard = sum(((F.col("hash") >= start).cast("int") for start in shard_starts(rows, n_shards, first_bits)), F.lit(0))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn(
        "cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).cast("int")
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # n_shards * salts rows at most
        rows.groupBy("shard", "cell")
        .count()
        .select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    place = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(place))
        .join(F.broadcast(starts), ["shard", "cell"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in 24 shards."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=24)
