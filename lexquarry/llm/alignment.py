"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Rows are shuffled by their full text; equal texts become one with a count.
2. Each distinct text is tokenised by A (byte-level BPE) and B (pieces with byte
   fallback).  Both spell the same bytes or the text has no tokens.  Where both end a
   token, a group ends; every stretch between two neighbouring ends of either is one
   link of an A and a B token, as two tokens overlap in one stretch at most.
3. A block of texts sums its links by id pair, each text as often as it occurs; the sums of blocks are
   added up corpus-wide, and each block gets the totals of its own pairs back.
4. The texts of a block are measured with those totals, and the measures are joined to all rows by digest.

What goes through the shuffle is a text once, its ids once, and a row for each block and pair;
no table of pairs is sent to every task.
"""

from __future__ import annotations

import base64
import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.wordbpe import flattened, per_worker, ranges, slices, small_batches, vocabulary_path
from lexquarry.plans.storage import drop_written, written

BYTE_RANKS, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: The vocabulary's own word pattern (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of both sides after which a block is full.
BLOCK = 4_000_000


class Spelling:
    """The bytes of a vocabulary's tokens in one buffer, and its ids in decimal."""

    def __init__(self, tokens: list[bytes], stop: str):
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = np.array([f"{n}{mark}" for n in range(len(tokens)) for mark in (",", stop)], "S")

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all tokens, one after another."""
        return self.flat[ranges(self.starts[ids], self.sizes[ids])]


class Pair:
    """Both tokenizers, loaded once in a worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode_a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.a = Spelling(spelled, "|")
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = partial(model.encode, num_threads=1)
        piece = lambda n: bytes([int(model.id_to_piece(n)[3:-1], 16)]) if model.is_byte(n) else model.id_to_piece(n).replace("▁", " ").encode()
        self.b = Spelling([piece(n) for n in range(model.get_piece_size())], ";")

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(all ids, each text's number of them) of A for space and text, and of B for the text, to which it adds the space; none where either spells other bytes."""
        a, b = [self.encode_a(" " + t) for t in texts], self.encode_b(texts)
        wanted = [b" " + t.encode() for t in texts]
        (a_ids, a_sizes), (b_ids, b_sizes) = flattened(a), flattened(b)
        want, size = np.frombuffer(b"".join(wanted), np.uint8), np.fromiter(map(len, wanted), np.int64, len(wanted))
        fits = lambda spelling, ids, sizes: np.array_equal(np.add.reduceat(spelling.sizes[ids], np.cumsum(sizes) - sizes), size) and np.array_equal(spelling.of(ids), want)
        if a_sizes.all() and b_sizes.all() and fits(self.a, a_ids, a_sizes) and fits(self.b, b_ids, b_sizes):
            return (a_ids, a_sizes), (b_ids, b_sizes)
        for n, text in enumerate(wanted):  # some text is spelled in other bytes
            if not (texts[n] and text == self.a.of(np.array(a[n], np.int64)).tobytes() == self.b.of(np.array(b[n], np.int64)).tobytes()):
                a[n], b[n] = [], []
        return flattened(a), flattened(b)


class Aligned:
    """Texts one after another: groups and links of all their tokens."""

    def __init__(self, pair: Pair, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray):
        self.pair, self.a, self.b, self.n_a, self.n_b = pair, a, b, a_sizes, b_sizes
        end_a, end_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])  # texts spell as many bytes on both sides
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        new = np.append(True, ends[1:] != ends[:-1])[: len(ends)]
        common, ends = ends[~new], ends[new]
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self.group_a, self.group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        self.pairs = a[link_a].astype(np.int64) << 32 | b[link_b]
        text = np.repeat(np.arange(len(a_sizes)), a_sizes)
        self.text_of_link = text[link_a]
        self.n_links = np.bincount(self.text_of_link, minlength=len(a_sizes))
        self.n_groups = np.bincount(text[np.searchsorted(end_a, common)], minlength=len(a_sizes))

    def spelled(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        groups = int(self.group_a[-1]) + 1 if len(self.group_a) else 0
        a_before, b_before = (np.cumsum(np.bincount(g, minlength=groups)) for g in (self.group_a, self.group_b))
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        words = np.zeros(len(self.a) + len(self.b), max(self.pair.a.decimal.dtype, self.pair.b.decimal.dtype))
        words[np.arange(len(self.a)) + np.append(0, b_before)[self.group_a]] = self.pair.a.decimal[2 * self.a + last(self.group_a)]
        if groups:
            words[np.arange(len(self.b)) + a_before[self.group_b]] = self.pair.b.decimal[2 * self.b + last(self.group_b)]
        stops = np.cumsum(self.n_a + self.n_b)
        return [words[s:e].tobytes().replace(b"\0", b"")[:-1] for s, e in zip((stops - self.n_a - self.n_b).tolist(), stops.tolist(), strict=True)]


def summed(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs in order, the sum of each one's weights)."""
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    cut = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[cut], np.add.reduceat(weights, cut) if len(cut) else weights


def _packed(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Each text's ids as one binary value; ids of up to 16 bits take two bytes each, which the first byte says."""
    wide = np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32
    data, ends, mark = ids.astype(wide), np.cumsum(sizes), bytes([np.dtype(wide).itemsize])
    return pa.array([mark + data[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_packed` was made of."""
    each = [np.frombuffer(v, {2: np.uint16, 4: np.uint32}[v[0]], offset=1) for v in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *each]).astype(np.int64), np.fromiter(map(len, each), np.int64, len(each))


_ENCODED = "block long, key binary, digest string, n_a long, n_b long, n_groups long, n_links long, a binary, b binary, pairs binary, sums binary"


def encoded(texts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(text, n) rows to their ids, by blocks; the last row of a block also carries the block's pairs with their sums."""
    small_batches(texts.sparkSession)

    def run(batches):
        pair, block, held, sums = per_worker((a_path, b_path), lambda: Pair(a_path, b_path)), TaskContext.get().partitionId() << 32, 0, []
        waiting = None

        def closed(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
            """The last batch of a block, its last row with the block's sums."""
            total = summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))
            rest, last = batch.slice(0, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
            carried = [*last.columns[:-2], *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in total)]
            return [rest, pa.RecordBatch.from_arrays(carried, names=batch.schema.names)]

        for batch in (part for whole in batches for part in slices(whole, 0, 2_000_000)):
            texts = batch.column(0).to_pylist()
            (a, a_sizes), (b, b_sizes) = pair.encode(texts)
            found = Aligned(pair, a, a_sizes, b, b_sizes)
            sums.append(summed(found.pairs, batch.column(1).to_numpy()[found.text_of_link]))
            held += len(a) + len(b)
            key = [hashlib.sha256(t.encode()).digest() for t in texts]
            digest = [hashlib.sha256(w).hexdigest() if w else "" for w in found.spelled()]
            columns = [pa.array(np.full(batch.num_rows, block)), pa.array(key, pa.binary()), pa.array(digest, pa.string()), *map(pa.array, (a_sizes, b_sizes, found.n_groups, found.n_links)), _packed(a, a_sizes), _packed(b, b_sizes)]
            nulls = pa.nulls(batch.num_rows, pa.binary())
            now = pa.RecordBatch.from_arrays([*columns, nulls, nulls], names=[c.split()[0] for c in _ENCODED.split(", ")])
            if waiting is not None:
                yield waiting
            waiting = now
            if held >= BLOCK:
                yield from closed(waiting)
                waiting, block, held, sums = None, block + 1, 0, []
        if waiting is not None:
            yield from closed(waiting)

    return texts.select("text", "n").mapInArrow(run, _ENCODED)


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(measures of every row; a, b, n, best of every id pair that is linked anywhere).

    Measures: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  A text that is null
    or empty, or that either tokenizer spells in other bytes, has none: zeros and an empty digest.  Repeated rows count as often as they occur, also rows
    without an id.  An empty table gives empty results; other columns are ignored.
    """
    a_path, b_path = a_path or vocabulary_path(BYTE_RANKS), b_path or vocabulary_path(PIECES)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    table = written(encoded(texts, a_path, b_path), "aligned")

    def spread(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                pairs, sums = (np.frombuffer(batch.column(k)[n].as_buffer(), np.int64) for k in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), batch.column(0)[n].as_py())), pa.array(pairs), pa.array(sums)], names=["block", "pair", "n"])

    asked = written(table.filter("pairs is not null").select("block", "pairs", "sums").mapInArrow(spread, "block long, pair long, n long"), "asked")
    totals = asked.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    totals = written(totals, "totals")
    most = written(totals.groupBy("b").agg(F.max("n").alias("most")), "most")  # a row for each id of B
    totals = written(totals.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    answers = asked.select("block", "pair").join(totals, "pair")

    def measure(block: pa.Table, told: pa.Table) -> pa.Table:
        pair = per_worker((a_path, b_path), lambda: Pair(a_path, b_path))
        keys, counts, best = (told.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order]
        sums, bests, digest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], block.column("key").combine_chunks()
        for batch in block.select(["a", "b"]).combine_chunks().to_batches(max_chunksize=256):
            found = Aligned(pair, *_ids(batch.column(0)), *_ids(batch.column(1)))
            at = np.searchsorted(keys, found.pairs)
            ends = np.cumsum(found.n_links)
            total = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x))[ends]))  # noqa: B023, E731
            sums.append(total(counts[at]))
            bests.append(total(best[at].astype(np.int64)))
        return pa.table({"key": digest, "n_best": np.concatenate(bests), "count_sum": np.concatenate(sums)})

    texts = table.filter("n_links > 0").select("block", "key", "a", "b")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(measure, "key binary, n_best long, count_sum long")
    scored = written(scored, "scored")
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    measures = written(table.select("key", "digest", *counts).filter("n_links > 0").join(scored, "key"), "measures")
    drop_written(asked, most, scored, table)
    # A hot text is one key of the written side, so AQE can split the rows of the other.
    out = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")).join(measures, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), *map(zero, counts), zero("n_best"), zero("count_sum"), F.coalesce("digest", F.lit("")).alias("groups_sha256"))
    shifted = F.call_function("shiftright", F.col("pair"), F.lit(32))
    return out, totals.select(shifted.alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b"), "n", "best")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table between the 50k byte vocabulary and the 32k pieces."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
