"""Which texts contain which: joins on containment through an index of character triples.

A text holds a needle only if it holds all of the needle's triples, so a needle asks for the texts of its
rarest one alone, and what comes back is compared exactly.  Needles shorter than three characters ask for
their own one or two.  Nothing is compared with everything, and only candidates' texts are shuffled.
A stated set of needles needs no index: an automaton of a block of them reads every text once, where it is.
"""

from __future__ import annotations

from bisect import insort
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexquarry.plans.storage import shared_dir, written

SIZE = 3
#: Needles of one automaton.
BLOCK = 4096


def grams(text: Column, *sizes: int) -> Column:
    """Distinct runs of ``sizes`` characters, in one walk over the characters for each size."""
    of = lambda letters, n: F.transform(letters, lambda c, i: F.concat(c, *[F.get(letters, i + k) for k in range(1, n)]) if n > 1 else c)
    every = F.transform(F.array(F.split(text, "")), lambda letters: F.concat(*[of(letters, n) for n in sizes]))  # split once
    return F.array_distinct(F.filter(F.flatten(every), lambda g: g.isNotNull() & (g != "")))


@dataclass
class GramIndex:
    """``postings`` (gram, key) and ``counts`` (gram, n) as read back."""

    postings: DataFrame
    counts: DataFrame

    @staticmethod
    def open(spark: SparkSession, path: str) -> GramIndex:
        return GramIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts"))


def _spelled(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(gram, key) of every row's lower-case fields, each once."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.lower(F.coalesce(f, F.lit(""))), 1, 2, SIZE) for f in fields])))
    return rows.select(F.explode(every).alias("gram"), F.col(key).alias("key"))


def build_grams(rows: DataFrame, key: str, fields: tuple[str, ...], path: str | None = None) -> GramIndex:
    """Index the lower-case ``fields`` of every row below ``path``, or in the session's shared folder; null fields hold nothing."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/lexquarry/grams-{spark.range(1).select(F.uuid()).first()[0]}"
    _spelled(rows, key, fields).write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
    return GramIndex.open(spark, path)


def containing(rows: DataFrame, needles: DataFrame, index: GramIndex | None, key: str, fields: tuple[str, ...], k: int | None = None) -> DataFrame:
    """(query_id, key, and the fields) of the rows of which some field contains a needle (query_id, needle), letters in either case.

    An empty or null needle finds nothing.  With an index a needle's rarest piece is asked for, the lesser one on ties, and a piece that no row has ends it.
    Without one, the texts are read once for each block of distinct needles, by an automaton of the whole block.
    With ``k`` the caller wants each query's rows with the ``k`` least keys: others of a needle may be left out.
    """
    asked = needles.filter("needle <> ''").select("query_id", F.lower("needle").alias("needle")).distinct()
    if index is None:
        return _by_automaton(rows, asked, key, fields, k)
    own = F.when(F.length("needle") >= SIZE, grams(F.col("needle"), SIZE)).otherwise(F.array("needle"))
    asked = asked.select("query_id", "needle", F.explode(own).alias("gram"))
    rarest = Window.partitionBy("query_id", "needle").orderBy("n", "gram")
    counted = asked.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = counted.withColumn("place", F.row_number().over(rarest)).filter("place = 1 and n > 0").select("query_id", "needle", "gram")
    near = index.postings.join(chosen, "gram").select("query_id", "needle", F.col("key").alias(key))
    found = near.join(rows.select(key, *fields), key)
    holds = F.lit(False)
    for f in fields:
        holds |= F.coalesce(F.lower(f).contains(F.col("needle")), F.lit(False))
    return found.filter(holds).drop("needle")


def _by_automaton(rows: DataFrame, asked: DataFrame, key: str, fields: tuple[str, ...], k: int | None) -> DataFrame:
    """:func:`containing` for a stated set of needles: every text goes once through an automaton of ``BLOCK`` distinct needles, which each task builds.

    Queries with the same needle share its rows.  With ``k`` a task keeps the least keys of each needle, so what is
    shuffled is ``k`` rows for a needle and a task, however many texts hold it.
    """
    texts = rows.select(key, *[F.lower(F.coalesce(f, F.lit(""))).alias(f"_{n}") for n, f in enumerate(fields)])
    stated = written(asked.select("needle").distinct().withColumn("at", F.monotonically_increasing_id()), "needles")
    blocks, parts = 1 + stated.count() // BLOCK, []
    schema = f"at long, {key} {dict(rows.dtypes)[key]}"
    kind = to_arrow_type(rows.schema[key].dataType)
    for block in range(blocks):
        wanted = {r.needle: r["at"] for r in stated.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == block).collect()}  # about BLOCK needles
        if not wanted:
            continue

        def run(batches, wanted=wanted):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for needle, at in wanted.items():
                automaton.add_word(needle, at)
            automaton.make_automaton()
            least: dict[int, list] = {}
            for batch in batches:
                ids, at = [], []
                for n in range(batch.num_rows):
                    held = {found for column in batch.columns[1:] for _, found in automaton.iter(column[n].as_py())}
                    if k is None:
                        ids += held
                        at += [n] * len(held)
                        continue
                    own = batch.column(0)[n].as_py() if held else None
                    for one in held if own is not None else ():
                        few = least.setdefault(one, [])
                        if (len(few) < k or own < few[-1]) and own not in few:
                            insort(few, own)
                            del few[k:]
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0).take(pa.array(at, pa.int32()))], names=["at", key])
            for one, few in least.items():
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(few), pa.int64()), pa.array(few, kind)], names=["at", key])

        parts.append(texts.mapInArrow(run, schema))
    if not parts:
        none = rows.sparkSession.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, query_id {dict(asked.dtypes)['query_id']}")
        return none.join(rows.select(key, *fields), key)
    hits = reduce(DataFrame.unionByName, parts).distinct()
    if k is not None:
        hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(key))).filter(F.col("nth") <= k).drop("nth")
    pairs = asked.join(stated, "needle").join(hits, "at").select("query_id", key).distinct()
    return pairs.join(rows.select(key, *fields), key)


def passages_held(docs: DataFrame, passages: DataFrame, index: GramIndex | None = None, key: str = "doc_id") -> DataFrame:
    """(query_id, key) of the documents (key, text) that contain a whole passage (query_id, text), white space squeezed on both sides: the relevance that E01-E04 need."""
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    texts = docs.select(key, squeezed("text").alias("text"))
    needles = passages.select("query_id", squeezed("text").alias("needle"))
    return containing(texts, needles, index, key, ("text",)).select("query_id", key).distinct()
