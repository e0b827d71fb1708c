"""Near-duplicate vectors by spherical k-means cells.

Equal vectors form one class first.  Centroids are fitted on a bounded sample;
every class is assigned to its nearest cell, and also visits each cell of a lower number that a
vector within the threshold of it could belong to, so every link is found in one cell.  There are as many cells
as send the fewest rows to blocks, by the visits of the sample: where all vectors visit most cells, few or one.
Within a cell and label, blocks are compared by cosine products in double precision.  All pairs of blocks
of a cell meet, so what is sent grows with the square of a cell; it goes in rounds of about the table's size, each freed before the next.
Links leave a block as counts and a forest; components name the groups and
the least id of each is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.functions.batches import bounded
from lexquarry.llm.components import Forest, components, groups
from lexquarry.plans.storage import drop_written, width, written

#: Vectors of one side of a block, on average, in small cells; of the k-means sample; a cell has at least so many of the sample.
BLOCK, SAMPLE, LEAST = 1024, 16_384, 8
#: Bytes of one side of the largest blocks; vectors of either side that are multiplied at a time.
SIDE, TILE = 2 << 20, 1024
#: Rows that a round sends to blocks at least.
ROUND = 400_000


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """``k`` unit centroids of unit rows; empty cells keep their centroid."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = np.argmax(x @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return centers


def cells_of(x: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own) of every cell that each unit row is in or visits; of two rows in different cells the one of the higher cell visits.

    A vector within ``reach`` of row v lies in cell c only if v is at most
    ``reach`` beyond the plane between its own centroid and c's.
    """
    near = x @ centers.T
    own = np.argmax(near, axis=1)
    gap = near[np.arange(len(x)), own][:, None] - near
    apart = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0))[own]
    row, cell = np.nonzero((gap <= reach * apart + 1e-9) & (np.arange(len(centers)) <= own[:, None]))
    return row, cell, cell == own[row]


def block_size(cell: float, wide: int) -> int:
    """Vectors of one side of a block of a cell of so many: a quarter of them, within bounds."""
    return int(max(BLOCK, min(SIDE // (4 * max(1, wide)), cell // 4)))


def fitted_cells(x: np.ndarray, largest: int, reach: float) -> np.ndarray:
    """The centroids, of several numbers of them, with which the fewest rows go to blocks: a row's visits times the blocks of a cell."""
    some, best, least = x[:4096], None, math.inf
    k = max(1, min(len(x) // LEAST, -(-largest // BLOCK)))
    while True:
        centers = spherical_kmeans(x, k)
        visits = len(cells_of(some, centers, reach)[0]) / len(some)
        cell = largest * visits / k
        sent = visits * max(1.0, cell / block_size(cell, x.shape[1]))
        if sent < least:
            best, least = centers, sent
        if k == 1:
            return best
        k = max(1, k // 8)


def join_all(forest: Forest, a: np.ndarray, b: np.ndarray) -> None:
    """Join all pairs; of many pairs each b's first one, then those that are still apart."""
    while len(a):
        first = np.unique(b, return_index=True)[1] if len(a) > 1000 else np.arange(len(a))
        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            forest.join(x, y)
        if len(first) == len(a):
            return
        root = forest.roots()
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]


def near_vectors(
    table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows are compared only when their labels are equal and not null and their vectors
    have the same length.  Null, empty and zero vectors, and those that hold nulls or
    non-finite numbers, link with nothing.  Repeated rows of an id count as vectors of their own
    that link with each other.  An empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    narrow = table.schema[vector_col].dataType.simpleString() == "array<float>"  # kept so: half the bytes, the same numbers
    vector = F.col(vector_col) if narrow else F.col(vector_col).cast("array<double>")
    kept = np.float32 if narrow else np.float64
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & sound, F.lit(False))
    keyed = rows.select("vec_id", "label", F.when(usable, F.col("v")).alias("v"))
    classes = written(
        keyed.filter("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors"
    )
    total, wide = classes.agg(F.count(F.lit(1)), F.mode(F.size("v"))).first()
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    reach = math.sqrt(2 - 2 * threshold)
    centers = None
    if total:
        share = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / total)  # about SAMPLE rows by the hash of their ids
        sample = classes.filter((F.size("v") == wide) & share).select("v").toArrow()
        x = np.asarray(sample.column("v").combine_chunks().flatten(), np.float64).reshape(-1, wide)
        if not len(x):
            x = np.ones((1, wide))
        x = x / np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centers = fitted_cells(x, largest, reach)

    def unit_rows(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def visit(batches):
        for batch in (part for whole in batches for part in bounded(whole)):
            v = batch.column(batch.schema.get_field_index("v"))
            sizes = np.array([len(a) for a in v])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = np.asarray(v.take(pa.array(at)).flatten(), kept).reshape(-1, size)
                if size == wide:
                    row, cell, own = cells_of(unit_rows(x), centers, reach)
                else:  # vectors of another length share one cell of their own
                    row, cell, own = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
                taken = batch.take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays(
                    [*(taken.column(k) for k in ("label", "rep", "copies")), pa.array(np.full(len(row), size)), pa.array(cell), pa.array(own), pa.array([u.tobytes() for u in x[row]], pa.binary())],
                    names=["label", "rep", "copies", "size", "cell", "own", "raw"],
                )

    label_type = dict(classes.dtypes)["label"]
    visits = classes.mapInArrow(visit, f"label {label_type}, rep long, copies long, size long, cell long, own boolean, raw binary")
    visits = written(visits.withColumn("label", F.col("label").cast("string")), "visits")
    place = ["label", "size", "cell"]
    sized = visits.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).withColumn("most", F.floor(F.lit(SIDE) / (4 * F.col("size"))))
    side = F.greatest(F.lit(BLOCK), F.least("most", F.floor(F.col("n") / 4)))  # as block_size
    blocks = written(sized.select(*place, "n", F.ceil(F.col("n") / side).cast("int").alias("blocks")), "blocks")
    rows, sent = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()
    rounds = max(1, -(-sent // max(rows, ROUND)))
    spread = (
        visits.join(blocks.drop("n"), place)
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*place, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "copies", "own", "raw")
    )

    def compare(batches):
        for table in groups(batches, [*place, "i", "j"]):
            rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
            own, first = table.column("own").to_numpy(), table.column("block").to_numpy() == table.column("i")[0].as_py()
            x = unit_rows(np.stack([np.frombuffer(u.as_buffer(), kept) for u in table.column("raw")]))
            same = table.column("i")[0] == table.column("j")[0]
            order = np.argsort(~first, kind="stable")
            rep, copies, own, x, n = rep[order], copies[order], own[order], x[order], int(first.sum())
            count, forest = np.zeros(len(rep), np.int64), Forest(len(rep))
            for a in range(0, n, TILE):
                left = slice(a, min(n, a + TILE))
                for b in range(a if same else n, len(rep), TILE):
                    right = slice(b, min(len(rep), b + TILE))
                    linked = x[left] @ x[right].T >= threshold
                    linked &= own[left][:, None] | own[right][None, :]
                    if same and a == b:
                        linked = np.triu(linked, 1)  # each pair once
                    one, two = np.nonzero(linked)
                    np.add.at(count, one + a, copies[two + b])
                    np.add.at(count, two + b, copies[one + a])
                    join_all(forest, one + a, two + b)
            root = forest.roots()
            some = np.flatnonzero((count > 0) | (root != np.arange(len(rep))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(count[some])], names=["a", "b", "n"]
            )

    keys = [*place, "i", "j"]
    found = None
    for n in range(rounds):
        dealt = spread.filter(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == n).repartition(width(spark, 16), *keys)
        part = written(dealt.sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, n long"), "near")
        found = part if found is None else found.unionByName(part)
    drop_written(visits, blocks)
    counts = found.groupBy("a").agg(F.sum("n").alias("near"))
    named = (
        classes.join(components(found.select("a", "b")).withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .select("label", "v", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    lone = keyed.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = keyed.filter("v is not null").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    out = linked.unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``embeddings`` table: cosine 0.98 or more within a label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
  SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), r(a, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.c FROM r JOIN l ON l.a = r.a WHERE r.c < l.b
), c AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM embeddings JOIN c ON c.a = vec_id
"""
