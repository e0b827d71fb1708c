"""A stored inverted index with impact-ordered blocks, and search that reads only what can matter.

``build_index`` tokenises every document once and writes four tables:

* ``forward``: each document's distinct terms with their impacts (the part of BM25 that doesn't depend on the query),
* ``blocks``: each term's postings by falling impact, up to ``BLOCK`` of them a row with the largest impact beside them,
* ``terms``: documents and largest impact of each term,
* ``stats``: number of documents and the mean length.

A common term's blocks are spread over range partitions, so no task holds one term.

``search`` first scores a few documents with the largest impacts in full, which gives a score
that the k-th best reaches at least.  A document whose largest possible term is w can't reach it unless
its posting of w, with the bounds of all lesser terms, does; so of each term only a prefix of blocks is read, and of what is read
only documents whose bound reaches the score are scored in full.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.functions.batches import bounded
from lexquarry.plans.storage import shared_dir, width, written

K1, B = 1.5, 0.75
#: Postings of a block.
BLOCK = 128
#: Terms of a query whose first blocks propose the documents that are scored first, and how many of these for each of the k.
SEED_TERMS, SEEDS = 6, 4
#: Queries of one pass, and scores of documents and queries that a task holds at once.
QUERY_BLOCK, CELLS = 4096, 2_000_000
#: Bounds are compared with this much room, as scores are rounded to six places.
ROOM = 2e-6
TABLES = ("forward", "blocks", "terms", "stats")


@dataclass
class Index:
    """The tables of an index as read back, and its statistics."""

    forward: DataFrame
    blocks: DataFrame
    terms: DataFrame
    documents: int
    mean: float
    key: str


def counted_terms(docs: DataFrame, key: str) -> DataFrame:
    """(key, raw, length, terms, counts) of every document: distinct terms with their counts, in one pass.

    The terms are those of :func:`text.tokens` and ``raw`` is :func:`text.raw_length`, made from the bytes of a few
    megabytes of texts at a time: whether a word is a term is asked once for each distinct one.
    """

    def count(batches):
        for batch in (part for whole in batches for part in bounded(whole)):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            words = [T.term_bytes(t or b"") for t in texts]
            size = np.fromiter(map(len, words), np.int64, len(words))
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            at = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
            term = np.fromiter((len(w) > 1 and not w.isdigit() for w in number), bool, len(number))
            row, held = np.repeat(np.arange(len(words)), size), term[at]
            row, at, width = row[held], at[held], max(len(number), 1)
            cell, n = np.unique(row * width + at, return_counts=True)
            ends = pa.array(np.searchsorted(cell // width, np.arange(len(words) + 1)).astype(np.int32))
            names = pa.array(list(number), pa.binary()).cast(pa.string()).take(pa.array(cell % width))
            raw = pa.array([None if t is None else len(t.split()) for t in texts], pa.int32())
            length = pa.array(np.bincount(row, minlength=len(words)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, length, pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(n))], names=["key", "raw", "length", "terms", "counts"])

    return docs.select(key, "text").mapInArrow(count, f"key {dict(docs.dtypes)[key]}, raw int, length long, terms array<string>, counts array<long>")


def impact_blocks(postings: DataFrame, kind: str) -> DataFrame:
    """(term, n, top, keys, impacts): postings (term, impact, key) in blocks by falling impact."""
    order = ["term", F.desc("impact"), "key"]
    spread = postings.repartitionByRange(width(postings.sparkSession), *order).sortWithinPartitions(*order)

    def cut(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            terms = table.column("term").combine_chunks()
            n = len(terms)
            if not n:
                continue
            new = np.append(True, pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False))
            first = np.flatnonzero(new)
            within = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            starts = np.flatnonzero(within % BLOCK == 0)
            held = table.slice(int(starts[-1]))  # it may go on in the next batch
            yield from blocks(table.slice(0, int(starts[-1])), starts)
        if held is not None:
            yield from blocks(held, np.array([0, held.num_rows]))

    def blocks(table: pa.Table, ends: np.ndarray):
        if len(ends) < 2:
            return
        table = table.combine_chunks()
        term, impact, key = (table.column(c).combine_chunks() for c in ("term", "impact", "key"))
        at, bounds = pa.array(ends[:-1]), pa.array(ends.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [term.take(at), pa.array(np.diff(ends)), impact.take(at), pa.ListArray.from_arrays(bounds, key), pa.ListArray.from_arrays(bounds, impact)], names=["term", "n", "top", "keys", "impacts"]
        )

    return spread.mapInArrow(cut, f"term string, n long, top double, keys array<{kind}>, impacts array<double>")


def build_index(docs: DataFrame, path: str | None = None, key: str = "doc_id", token_mean: bool = False) -> Index:
    """Write the index of ``docs`` (key, text) below ``path``, or in the session's shared folder.

    The mean length is that of raw words, or of tokens with ``token_mean``; null texts have no terms but count as documents.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    path = path or f"{shared_dir(spark)}/lexquarry/index-{spark.range(1).select(F.uuid()).first()[0]}"
    counted = written(counted_terms(docs, key), "terms")
    n, mean = counted.agg(F.count(F.lit(1)), F.avg("length" if token_mean else F.coalesce("raw", F.lit(0)))).first()
    mean = float(mean or 1.0)
    impact = F.transform("counts", lambda c: c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("length") / mean)))
    counted.select("key", "terms", impact.alias("impacts")).write.mode("overwrite").parquet(f"{path}/forward")
    forward = spark.read.parquet(f"{path}/forward")
    postings = forward.select("key", F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.impacts").alias("impact"), "key")
    impact_blocks(postings, kind).write.mode("overwrite").parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(n, mean, key)], "documents long, mean double, key string").write.mode("overwrite").parquet(f"{path}/stats")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that :func:`build_index` wrote."""
    forward, blocks, terms, stats = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
    n, mean, key = stats.select("documents", "mean", "key").first()
    return Index(forward, blocks, terms, n, mean, key)


def _weights(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight, bound, rest, place): a query's known terms by falling bound; ``rest`` is the sum of the bounds behind."""
    asked = queries.select("query_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    idf = F.log((index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    rows = asked.join(index.terms, "term").withColumn("weight", F.col("qf") * idf).withColumn("bound", F.col("weight") * F.col("top"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")
    behind = F.coalesce(F.sum("bound").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return rows.select("query_id", "term", "weight", "bound", F.col("top").alias("most"), behind.alias("rest"), F.row_number().over(order).alias("place"))


def _read(index: Index, asked: DataFrame, *keep: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, key, part, and what is carried) of the postings in the blocks and with the parts that ``keep`` allows."""
    at_block, at_posting = keep
    hits = index.blocks.join(asked, "term").filter(at_block)
    rows = hits.select("query_id", "weight", "rest", *carry, F.explode(F.arrays_zip("keys", "impacts")).alias("p"))
    return rows.select("query_id", F.col("p.keys").alias("key"), (F.col("weight") * F.col("p.impacts")).alias("part"), "rest", *carry).filter(at_posting)


def _scores(index: Index, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, key, score, scored): the full score of each pair (query_id, key), and how many postings it took; ``asked`` is of one block of queries."""
    table = asked.select("term", "query_id", "weight").orderBy("term", "query_id").toArrow()  # the terms of QUERY_BLOCK queries
    kinds = dict(pairs.dtypes)
    schema = f"query_id {kinds['query_id']}, key {kinds['key']}, score double, scored long"
    if not table.num_rows:
        return pairs.select("query_id", "key", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("scored")).limit(0)
    terms, first, count = np.unique(table.column("term").to_numpy(zero_copy_only=False).astype(object), return_index=True, return_counts=True)
    ids, query = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    weight = table.column("weight").to_numpy()
    value_set = pa.array(terms.tolist(), pa.string())

    def run(batches):
        step = max(1, CELLS // len(ids))
        for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
            n, of = batch.num_rows, batch.column(1)
            wanted = np.repeat(np.arange(n), pc.list_value_length(of).to_numpy(zero_copy_only=False)) * len(ids) + np.searchsorted(ids, of.flatten().to_numpy(zero_copy_only=False))
            at = pc.fill_null(pc.index_in(batch.column(2).flatten(), value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))[at >= 0]
            impact, at = batch.column(3).flatten().to_numpy(zero_copy_only=False)[at >= 0], at[at >= 0]
            each = count[at]
            ends = np.cumsum(each)
            hit = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each - first[at], each)
            cell = np.repeat(row * len(ids), each) + query[hit]
            total = np.bincount(cell, np.repeat(impact, each) * weight[hit], n * len(ids))[wanted]
            scored = np.bincount(cell, minlength=n * len(ids))[wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[wanted % len(ids)]), batch.column(0).take(pa.array(wanted // len(ids))), pa.array(np.floor(total * 1e6 + 0.5) / 1e6), pa.array(scored)], names=["query_id", "key", "score", "scored"]
            )

    rows = pairs.groupBy("key").agg(F.collect_list("query_id").alias("of")).join(index.forward, "key")  # a list holds a block's queries at most
    return rows.select("key", "of", "terms", "impacts").mapInArrow(run, schema)


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def candidates(index: Index, asked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, n_read) of all documents that can be among the ``k`` best of the weighted queries ``asked``."""
    first = asked.filter(F.col("place") <= SEED_TERMS)
    seeds = _read(index, first, F.col("top") >= F.col("most"), F.lit(True)).groupBy("query_id", "key").agg(F.sum("part").alias("part"))
    order = Window.partitionBy("query_id").orderBy(F.desc("part"), "key")
    seeds = seeds.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SEEDS * k).select("query_id", "key")
    known = _best(_scores(index, seeds, asked), k).filter(F.col("rank") == k).select("query_id", (F.col("score") - ROOM).alias("least"))
    # What a term's unread postings can add at most, once all that can lead a document to ``least`` are read.
    bounded = asked.join(known, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    bounded = written(bounded.withColumn("unread", F.least("bound", F.greatest(F.lit(0.0), F.col("least") - F.col("rest")))), "bounds")
    reach = lambda part: part + F.col("rest") >= F.col("least")
    read = _read(index, bounded, reach(F.col("weight") * F.col("top")), reach(F.col("part")), carry=("least", "unread"))
    unread = bounded.groupBy("query_id").agg(F.sum("unread").alias("all_unread"))
    gathered = read.groupBy("query_id", "key").agg(F.sum("part").alias("part"), F.sum("unread").alias("own"), F.first("least").alias("least"), F.count(F.lit(1)).alias("n_read"))
    able = gathered.join(unread, "query_id").filter(F.col("part") + F.col("all_unread") - F.col("own") >= F.col("least") - ROOM)
    return able.select("query_id", "key", "n_read")


def _blocks(index: Index, queries: DataFrame) -> list[DataFrame]:
    """The weighted terms of the queries, in written tables of about ``QUERY_BLOCK`` queries."""
    parts = 1 + queries.count() // QUERY_BLOCK
    return [written(_weights(index, queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)), "asked") for part in range(parts)]


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, key, score, rank) of the ``k`` best documents with a score above 0; repeated query terms count again, ties go to the smaller key."""
    found = [_scores(index, candidates(index, asked, k).select("query_id", "key"), asked) for asked in _blocks(index, queries)]
    return _best(reduce(DataFrame.unionByName, found), k).select("query_id", F.col("key").alias(index.key), "score", "rank")


def read_share(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, postings, n_read, n_scored, n_candidates): what a search touches of all postings of a query's terms."""
    shares = []
    for asked in _blocks(index, queries):
        able = candidates(index, asked, k)
        touched = able.join(_scores(index, able.select("query_id", "key"), asked), ["query_id", "key"])
        touched = touched.groupBy("query_id").agg(F.sum("n_read").alias("n_read"), F.sum("scored").alias("n_scored"), F.count(F.lit(1)).alias("n_candidates"))
        shares.append(asked.join(index.terms, "term").groupBy("query_id").agg(F.sum("df").alias("postings")).join(touched, "query_id", "left"))
    return reduce(DataFrame.unionByName, shares)
