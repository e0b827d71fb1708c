"""Exact deduplication by progressive refinement.

Rows are grouped by length, then by a hash of a prefix, and only groups that
are still crowded are told apart by the SHA-256 of their whole text.  Everything
after the scan works on narrow rows; the text itself is never shuffled unless
a row's digest was not needed before its group turned out to be crowded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.plans.storage import written

#: A run of ASCII white space other than one plain space.
RUNS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def squeezed(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after :func:`squeezed`.  ``keep_id`` is the
    smallest id of the group.  ``digest_all`` computes the digest of every row
    during the first scan (when the caller wants it anyway); otherwise
    ``text_sha256`` is null for rows whose length and prefix nobody shares,
    whose text is then never hashed in full.

    Null text counts as empty and empty texts equal one another.  A null id
    never stays in front of an id; a group of null ids only keeps them all.
    Rows that repeat an id and its text are all kept or dropped with that id.
    An empty table gives an empty result; other columns are ignored.
    """
    norm = squeezed(F.col("text"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys = base.select(
        "doc_id",
        F.length(norm).alias("len"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("pre"),
        *([F.sha2(norm, 256).alias("sha")] if digest_all else []),
    )
    keys = written(keys, "dedup-keys")
    # Narrow sides are written, so that AQE can split the rows of a hot length and prefix, or of a hot digest, on the other side.
    crowded = written(keys.groupBy("len", "pre").count().filter("count > 1").drop("count"), "crowded")
    if digest_all:
        full = keys.join(crowded, ["len", "pre"], "left_semi")
    else:
        full = base.select(
            "doc_id", F.length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("pre"), norm.alias("norm")
        ).join(crowded, ["len", "pre"], "left_semi")
        full = written(full.select("doc_id", "len", "pre", F.sha2("norm", 256).alias("sha")), "dedup-full")
        lone = keys.join(crowded, ["len", "pre"], "left_anti").withColumn("sha", F.lit(None).cast("string"))
        keys = full.unionByName(lone)
    groups = (
        full.groupBy("sha")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    return keys.join(written(groups, "groups"), "sha", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, every digest included."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
