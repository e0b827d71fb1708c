"""Embeddings and vector search; matrix products in Arrow batches, top-k before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from lexquarry.plans.storage import written

#: Queries that one pass over the table holds at once; more go in further passes.
QUERY_BLOCK = 4096
#: Scores of points and queries that a task holds at once, and the queries whose tables of code scores it holds.
CELLS, TABLES = 2_000_000, 256
FLOATS = ArrayType(FloatType())
#: Components of a pseudo-embedding.
WIDTH = 64
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def normalized(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two array columns, 0 when either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


@pandas_udf(FLOATS)
def pseudo_embedding(seed: pd.Series) -> pd.Series:
    """A unit normal vector drawn from each seed (the hash of a text), a whole batch at once.

    Counters that a seed numbers are mixed to uniform numbers, and those turned into normal ones (Box and Muller).
    """
    at = seed.to_numpy().astype(np.uint64)[:, None] + np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = (at ^ (at >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    at = (at ^ (at >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    even = ((at ^ (at >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    far, turn = np.sqrt(-2 * np.log(1 - even[:, : WIDTH // 2])), 2 * np.pi * even[:, WIDTH // 2 :]
    v = np.concatenate([far * np.cos(turn), far * np.sin(turn)], axis=1)
    return pd.Series(list((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)))


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray] | None = None, text: str = "text", prefix: str = "") -> DataFrame:
    """``chunks`` with an ``embedding``; ``model`` maps texts to a matrix, and is made once per worker.

    Without a model the pseudo-embedding of the text's hash stands in.
    """
    said = F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))
    if model is None:
        return chunks.withColumn("embedding", pseudo_embedding(F.xxhash64(said)))

    @pandas_udf(FLOATS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model(texts.tolist()), np.float32)))

    return chunks.withColumn("embedding", run(said))


def leading(score: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` best scores of each row stand, ties by the lesser key; ``keys`` has a row for each or one for all."""
    k = min(k, score.shape[1])
    if not k or not len(score):
        return np.zeros((len(score), k), np.int64)
    value = np.where(np.isnan(score), -np.inf, score)
    least = np.partition(value, -k, axis=1)[:, -k]
    row, at = np.nonzero(value >= least[:, None])
    order = np.lexsort((np.broadcast_to(keys, score.shape)[row, at], -value[row, at], row))
    first = np.searchsorted(row, np.arange(len(score)))
    return at[order][first[:, None] + np.arange(k)]


def nearest_points(batches: Iterable[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int, key: str) -> Iterator[pa.RecordBatch]:
    """(query_id, key, score): the ``k`` best of a task's points (key, v) for each row of a matrix of unit vectors.

    Points are scored ``CELLS`` pairs at a time, and the best so far are all that stays.
    """
    score, owner = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
    step = max(1, CELLS // len(ids))
    for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
        keys = batch.column(0).to_numpy()
        x = np.asarray(batch.column(1).flatten(), float).reshape(len(keys), -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        near = np.round(matrix @ (x / np.where(size > 0, size, 1)).T, 6)
        at = leading(near, keys[None], k)
        score, owner = np.concatenate([score, np.take_along_axis(near, at, 1)], 1), np.concatenate([owner, keys[at]], 1)
        at = leading(score, owner, k)
        score, owner = np.take_along_axis(score, at, 1), np.take_along_axis(owner, at, 1)
    if score.size:
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, score.shape[1])), pa.array(owner.ravel()), pa.array(score.ravel())], names=["query_id", key, "score"])


def top_k(points: DataFrame, queries: DataFrame, k: int = 10, where: dict | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) of the nearest points by cosine.

    ``where`` filters the points first (pushed to the scan).  Queries are a
    stated set, taken in blocks of ``QUERY_BLOCK``: each block is one matrix,
    each task keeps its own ``k`` best, and only these are shuffled.
    """
    for column, value in (where or {}).items():
        points = points.filter(F.col(column) == value)
    rows = points.filter(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    blocks = 1 + queries.count() // QUERY_BLOCK
    asked = queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = []
    for block in range(blocks):
        table = asked.filter(F.col("block") == block).toArrow()  # about QUERY_BLOCK rows
        if not table.num_rows:
            continue
        ids = table.column("query_id").to_numpy()
        q = np.asarray(table.column("v").combine_chunks().values, float).reshape(len(ids), -1)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        matrix = q / np.where(size > 0, size, 1)
        parts.append(rows.mapInArrow(lambda b, i=ids, m=matrix: nearest_points(b, i, m, k, key), f"query_id long, {key} long, score double"))
    if not parts:
        return points.sparkSession.createDataFrame([], f"query_id long, {key} long, score double, rank int")
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class VectorIndex:
    """Points by cells with short codes of what their centroid leaves, as read back.

    ``codes`` has a row a point: key, cell, code (one byte for each of ``books`` slices).
    """

    codes: DataFrame
    points: DataFrame
    centers: np.ndarray
    books: np.ndarray
    probes: int
    key: str
    vector: str


def probes_for(x: np.ndarray, centers: np.ndarray, share: float, k: int = 10, tried: int = 256) -> int:
    """How many cells, nearest first, hold ``share`` of the ``k`` nearest neighbours among the sample of some of its rows; neighbours in the whole table are nearer, so it's on the safe side."""
    q = x[np.random.default_rng(5).choice(len(x), min(tried, len(x)), replace=False)]
    near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-q @ centers.T + (centers**2).sum(1) / 2, axis=1, kind="stable")
    place = np.argsort(order, axis=1)[np.arange(len(q))[:, None], _nearest(x, centers)[near]]
    return 1 + int(np.quantile(place, share)) if place.size else len(centers)


def _units(column: pa.Array, wide: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, wide)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row, a slice of rows at a time."""
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096))])


def _lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` means of the rows; an empty one stays where it was."""
    centers = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = _nearest(x, centers)
        order = np.argsort(of, kind="stable")
        ids, first = np.unique(of[order], return_index=True)
        centers = centers.copy()
        centers[ids] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return centers


def build_cells(points: DataFrame, key: str = "vec_id", vector: str = "embedding", slices: int = 16, sample: int = 16_384, held: float = 0.96) -> VectorIndex:
    """Index every point that has a vector: its cell, and a code of the rest in ``slices`` bytes.

    Cells are fitted on about ``sample`` points by the hash of their keys and grow as the root of the table, up to a sixteenth of the
    sample; code books of 256 entries a slice on the same points' residuals.  The slices of a vector are as even as its width allows.
    How many cells a query visits is measured on the sample: as many as hold ``held`` of the nearest neighbours.
    """
    rows = points.filter(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    total, wide = rows.agg(F.count(F.lit(1)), F.first(F.size("v"), True)).first()
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / max(total, 1))
    table = rows.filter(share).orderBy("key").select("v").toArrow() if total else None
    x = _units(table.column("v").combine_chunks(), wide) if table is not None and table.num_rows else np.zeros((1, wide or 1))
    centers = _lloyd(x, max(1, min(len(x) // 16, int(2 * total**0.5))))
    slices = min(slices, x.shape[1])
    cuts = np.linspace(0, x.shape[1], slices + 1).astype(int)
    rest = x - centers[_nearest(x, centers)]
    books = np.zeros((256, x.shape[1]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        book = _lloyd(rest[:, a:b], 256)
        books[: len(book), a:b], books[len(book) :, a:b] = book, book[0]

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _units(batch.column(1), len(centers[0]))
            cell = _nearest(u, centers)
            left = u - centers[cell]
            codes = np.stack([_nearest(left[:, a:b], books[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["key", "cell", "code"])

    codes = rows.mapInArrow(code, f"key {dict(rows.dtypes)['key']}, cell int, code binary")
    return VectorIndex(written(codes.repartition("cell").sortWithinPartitions("cell"), "codes"), points, centers, books, probes_for(x, centers, held), key, vector)


def search_cells(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, short: int = 10) -> DataFrame:
    """(query_id, key, score, rank) of about the ``k`` nearest points by cosine: each query (query_id, vector) scores the codes of its ``probes`` nearest cells (the index tells how many unless given), and its ``short`` x ``k`` best are scored exactly.

    Every task keeps its own short list of each query, and only these are shuffled; queries go in blocks of ``QUERY_BLOCK``, and within a batch of codes ``TABLES`` at a time.
    """
    centers, books, spark = index.centers, index.books, index.codes.sparkSession
    kind = dict(index.codes.dtypes)["key"]
    probes = probes or index.probes
    cuts = np.linspace(0, centers.shape[1], len(index.codes.select("code").first()[0]) + 1).astype(int) if not index.codes.isEmpty() else np.array([0, centers.shape[1]])
    asked = queries.select("query_id", F.col(index.vector).cast("array<double>").alias("v"))
    blocks = 1 + queries.count() // QUERY_BLOCK
    lists = []
    for block in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()  # about QUERY_BLOCK rows
        if not table.num_rows:
            continue
        ids, q = table.column("query_id").to_numpy(), _units(table.column("v").combine_chunks(), centers.shape[1])
        toward = q @ centers.T
        visits: dict[int, np.ndarray] = {}
        near = np.argsort(-toward + (centers**2).sum(1) / 2, axis=1, kind="stable")[:, :probes]
        for cell in np.unique(near):
            visits[int(cell)] = np.flatnonzero((near == cell).any(1))

        def shortlist(batches, ids=ids, q=q, toward=toward, visits=visits):
            held: dict[int, tuple[np.ndarray, pa.Array]] = {}
            for batch in batches:
                cell = batch.column(1).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
                rows_of = {int(c): np.flatnonzero(cell == c) for c in np.unique(cell) if int(c) in visits}
                for first in range(0, len(ids), TABLES):
                    some = q[first : first + TABLES]
                    tables = np.stack([some[:, a:b] @ books[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)])  # slice, query, entry
                    best: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
                    for c, at in rows_of.items():
                        of = visits[c]
                        of = of[np.searchsorted(of, first) : np.searchsorted(of, first + TABLES)]
                        if not len(of):
                            continue
                        score = np.repeat(toward[of, c][:, None], len(at), 1)
                        for s in range(len(tables)):
                            score += tables[s][of - first][:, codes[at, s]]
                        for n, row in zip(of.tolist(), score, strict=True):
                            best.setdefault(n, []).append((at, row))
                    for n, parts in best.items():
                        at, score = (np.concatenate(p) for p in zip(*parts, strict=True))
                        top = np.argsort(-score, kind="stable")[: short * k]
                        score, key = score[top], batch.column(0).take(pa.array(at[top]))
                        if n in held:
                            score, key = np.concatenate([held[n][0], score]), pa.concat_arrays([held[n][1], key])
                            top = np.argsort(-score, kind="stable")[: short * k]
                            score, key = score[top], key.take(pa.array(top))
                        held[n] = score, key
            if held:
                size = [len(score) for score, _ in held.values()]
                owner = ids[np.repeat(np.fromiter(held, np.int64, len(held)), size)]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.concat_arrays([key for _, key in held.values()]), pa.array(np.concatenate([score for score, _ in held.values()]))], names=["query_id", "key", "near"])

        cells = index.codes.filter(F.col("cell").isin(sorted(visits))) if len(visits) <= 1000 else index.codes
        lists.append(cells.mapInArrow(shortlist, f"query_id {dict(queries.dtypes)['query_id']}, key {kind}, near double"))
    if not lists:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {index.key} {kind}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "key")
    few = reduce(DataFrame.unionByName, lists).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= short * k).select("query_id", "key")
    exact = few.join(index.points.select(F.col(index.key).alias("key"), F.col(index.vector).alias("p")), "key").join(asked, "query_id")
    scored = exact.select("query_id", F.col("key").alias(index.key), F.round(cosine(F.col("p"), F.col("v")), 6).alias("score"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)
    return scored.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)


def ann_cells(points: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, key: str = "vec_id") -> DataFrame:
    """V08 in one step: an index of ``points`` and a search in it."""
    return search_cells(build_cells(points, key), queries, k, probes)


def text_hits(queries: DataFrame, chunks: DataFrame, k: int = 30) -> DataFrame:
    """V09 over texts: (query_id, doc_key, text, score, rank) of the chunks (doc_key, text, embedding) nearest to each query (query_id, text); the best chunk of a document counts."""
    points = chunks.withColumn("vec_id", F.xxhash64("doc_key", "text"))
    asked = embed(queries.select("query_id", "text"), prefix=QUERY_PREFIX).select("query_id", "embedding")
    hits = written(top_k(points, asked, k), "nearest")  # ``k`` rows a query: of the texts only theirs are shuffled
    named = points.select("vec_id", "doc_key", "text").join(hits.select("vec_id").distinct(), "vec_id", "left_semi")
    hits = hits.join(named.dropDuplicates(["vec_id"]), "vec_id")
    best = Window.partitionBy("query_id", "doc_key").orderBy("rank")
    return hits.withColumn("n", F.row_number().over(best)).filter("n = 1").select("query_id", "doc_key", "text", "score", "rank")


def vector_hits(points: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id") -> DataFrame:
    """Top-k hits tagged with their retriever; the payload's own source stays apart."""
    return top_k(points, queries, k, key=key).withColumn("retriever", F.lit("vector"))
