"""Best-fit packing of token sequences by exact-complement hashing.

Lengths of pieces never exceed the capacity, so their histogram is all that the
plan needs and is bounded by it.  The plan works on counts: for each length,
longest first, it looks up single lengths, pairs and triples whose sum fills
the gap exactly, consumes as many as the counts allow, and packs what is left
best-fit.  Spark numbers the pieces of each length and places them by the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.llm.wordbpe import ChunkIds, chunks, flattened, load, merged, per_worker, ranges, slices, small_batches
from lexquarry.plans.storage import width, written

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Available:
    """Counts by length, with an index of the sums that pairs of lengths reach."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.copy()
        self.bits = sum(1 << int(n) for n in np.flatnonzero(self.counts))
        self.stale, self.pairs = True, 0

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n, k in Counter(lengths).items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                self.bits &= ~(1 << n)
                self.stale = True

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.counts[n]) // k for n, k in Counter(lengths).items())

    def pair_sums(self) -> int:
        """Bit s is set when two lengths in stock may sum to s."""
        if self.stale:
            self.pairs, self.stale = 0, False
            for n in np.flatnonzero(self.counts):
                self.pairs |= self.bits << int(n)
        return self.pairs

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths in stock that sum to ``total``, the longer as long as can be up to ``most``."""
        if total < 2 or not self.pair_sums() >> total & 1:
            return None
        high = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        low = total - high
        enough = (self.counts[high] > 0) & (self.counts[low] > 0) & ((high != low) | (self.counts[high] > 1))
        at = int(np.argmax(enough)) if len(high) else 0
        return (int(high[at]), int(low[at])) if len(high) and enough[at] else None

    def fill(self, gap: int, most: int, parts: int = 3) -> tuple[int, ...] | None:
        """One to ``parts`` lengths in stock that sum to ``gap``."""
        if gap <= most and self.counts[gap]:
            return (gap,)
        if parts > 1 and (two := self.pair(gap, most)):
            return two
        if parts < 3:
            return None
        sums = self.pair_sums()
        for n in np.flatnonzero(self.counts[: min(gap - 1, most + 1)])[::-1]:
            n = int(n)
            if 3 * n < gap:
                break
            if sums >> (gap - n) & 1 and (two := self.beside(n, lambda n=n: self.pair(gap - n, n))):
                return (n, *two)
        return None

    def beside(self, n: int, search: Callable[[], tuple[int, ...] | None]) -> tuple[int, ...] | None:
        """What ``search`` finds while one piece of length ``n`` is set aside."""
        self.counts[n] -= 1
        found = search()
        self.counts[n] += 1
        return found


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences) for a histogram by length.

    Fills of up to three lengths are best for most histograms; where long pieces
    outnumber short ones, fills of fewer leave more for the best-fit rest, so
    the shortest of these plans is taken.
    """
    plans = [complement_plan(counts, capacity, parts) for parts in (3, 2, 1)]
    return min([*plans, best_fit(counts, capacity)], key=lambda runs: sum(times for _, times in runs))


def complement_plan(counts: np.ndarray, capacity: int, parts: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills of up to ``parts`` lengths, longest first, then best-fit."""
    stock, runs = Available(counts), []
    if full := int(stock.counts[capacity]):
        runs.append(((capacity,), full))
        stock.take((capacity,), full)
    for n in range(capacity - 1, 0, -1):
        while stock.counts[n] and (rest := stock.beside(n, lambda n=n: stock.fill(capacity - n, n, parts))):
            times = stock.times((n, *rest))
            runs.append(((n, *rest), times))
            stock.take((n, *rest), times)
    return runs + best_fit(stock.counts, capacity)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: equal sequences stay one run."""
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in np.flatnonzero(counts)[::-1]:
        n, left = int(n), int(counts[n])
        for gap in sorted(g for g in bins if g >= n):
            while left and bins[gap]:
                lengths, times = bins[gap].pop()
                each = min(gap // n, left)
                used = min(times, left // each)
                if times > used:
                    bins[gap].append((lengths, times - used))
                bins.setdefault(gap - each * n, []).append((lengths + (n,) * each, used))
                left -= used * each
        each = capacity // n
        if left >= each:
            bins.setdefault(capacity - each * n, []).append(((n,) * each, left // each))
            left %= each
        if left:
            bins.setdefault(capacity - left * n, []).append(((n,) * left, 1))
    return [run for of in bins.values() for run in of]


def place_table(runs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), by length and rank."""
    used, rows, sequence = Counter(), [], 0
    for lengths, times in runs:
        offset = 0
        for n, k in Counter(lengths).items():
            rows.append((n, used[n], k, sequence, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each text's ids and the end id: doc_id, piece, start, length, ids_crc32.

    Null text counts as empty and gives the end id alone.
    """

    def cut(batches):
        tokenizer = per_worker(("tokenizer", path), lambda: load(path))
        cache = per_worker(("ids", path), lambda: ChunkIds(lambda words: flattened(merged(tokenizer, words))))
        for batch in (part for whole in batches for part in slices(whole, most=2_000_000)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, sizes, odd = cache.of([chunks(t) for t in texts])
            ends = np.cumsum(sizes + 1)
            flat = np.full(int(ends[-1]), end_id, "<u4")
            flat[ranges(ends - sizes - 1, sizes)] = ids
            data = memoryview(flat).cast("B")
            of = [data[4 * (e - n - 1) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            for n in np.flatnonzero(odd).tolist():
                of[n] = memoryview(np.array([*tokenizer.encode(texts[n], add_special_tokens=False).ids, end_id], "<u4")).cast("B")
            out: list[tuple] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), of, strict=True):
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its gapless offset there.

    ``pieces`` needs doc_id, piece and length; its other columns stay.  Pieces
    of one length are interchangeable: they are numbered in salted cells, so a
    length that a third of all pieces share is numbered by many tasks.
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[n] = k
    table = place_table(plan_packing(counts, capacity))
    starts = table[:, 0] << 44 | table[:, 1]
    cell = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(width(spark, 16))).cast("int")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("cell", cell)
    first = (
        pieces.groupBy("length", "cell").count().select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    order = Window.partitionBy("length", "cell").orderBy("doc_id", "piece")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(order))
        .join(first, ["length", "cell"])
        .withColumn("rank", (F.col("first") + F.col("rank") - 1).cast("long"))
        .drop("first", "cell")
    )
    kept = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = table[np.searchsorted(starts, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)],
                names=[*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{c} {t}" for c, t in ranked.select(kept).dtypes)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """All documents' pieces, placed; see :func:`token_pieces` and :func:`pack`.

    Repeated rows are packed once each, a null id like any other; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return pack(written(token_pieces(rows, path), "pieces"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table in sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
