"""Centroid clustering in integers, exact, by shallot search.

Every vector remembers its nearest and second-nearest centroid with an upper bound of the
distance to the one and a lower bound of the distance to all others.  A round
moves the bounds by how far the centroids moved; a vector whose bounds still
part keeps its centroid unseen.  Any other one starts from the closer of its two centroids
and scans that one's neighbours by distance, as far as a ball that
shrinks with each better second-nearest found; distances of what is scanned are
exact integers.  Bounds are doubles with a margin, so a tie is always left to
the integers, where the smaller number wins.

State is one narrow table a round; of the corpus the driver sees sums of clusters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.plans.storage import drop_written, written

#: Scaled components lie within this bound, so that squared distances of up to 256 of them fit 64 bits.
MOST = 1 << 26
_SLACK = 1 + 1e-9


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """Integer centroids with their neighbours by distance."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        self.apart = np.sqrt(np.stack([squared(points, p[None]) for p in points]).astype(np.float64))
        keyed = self.apart.copy()
        np.fill_diagonal(keyed, -1)  # a centroid is its own first neighbour, equal ones follow
        self.order = np.argsort(keyed, axis=1, kind="stable")
        self.half = np.array([self.apart[c, self.order[c, 1]] / 2 for c in range(k)]) if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(points, before).astype(np.float64))
        most = np.argsort(self.moved)[::-1]
        self.others_moved = np.where(np.arange(k) == most[0], self.moved[most[1]] if k > 1 else 0.0, self.moved[most[0]])

    def search(self, x: np.ndarray, start: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """(nearest, its squared distance, second-nearest, its squared distance) of every row of ``x``; start and other differ."""
        if len(self.points) == 1:
            return start, squared(x, self.points[start]), start, np.full(len(x), np.iinfo(np.int64).max)
        d1, d2 = squared(x, self.points[start]), squared(x, self.points[other])
        swap = (d2 < d1) | ((d2 == d1) & (other < start))
        first, second = np.where(swap, other, start), np.where(swap, start, other)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        home, from_home = first.copy(), np.sqrt(d1.astype(np.float64))
        live = np.arange(len(x))
        for step in range(1, len(self.points)):
            c = self.order[home[live], step]
            inside = self.apart[home[live], c] <= (from_home[live] + np.sqrt(d2[live].astype(np.float64))) * _SLACK + 1e-6
            live, c = live[inside], c[inside]
            if not len(live):
                break
            d = squared(x[live], self.points[c])
            better = (d < d1[live]) | ((d == d1[live]) & (c < first[live]))
            at = live[better]
            second[at], d2[at] = first[at], d1[at]
            first[at], d1[at] = c[better], d[better]
            next_best = ~better & (d < d2[live]) & (c != first[live])
            at = live[next_best]
            second[at], d2[at] = c[next_best], d[next_best]
        return first, d1, second, d2

    def assign(self, x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Bring the state of the rows up to these centroids, in place; how many were searched."""
        upper += self.moved[cluster]
        lower -= self.others_moved[cluster]
        parted = lambda at: upper[at] * _SLACK + 1e-6 < np.maximum(lower[at], self.half[cluster[at]])
        at = np.arange(len(x))
        at = at[~parted(at)]
        upper[at] = np.sqrt(squared(x[at], self.points[cluster[at]]).astype(np.float64))
        at = at[~parted(at)]
        first, d1, other, d2 = self.search(x[at], cluster[at], second[at])
        cluster[at], second[at] = first, other
        upper[at], lower[at] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
        return len(at)


def integer_points(table: DataFrame, wide: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, point) of the vectors with exactly ``wide`` components, none null, non-finite or scaled beyond ``MOST``."""
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < MOST))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    return rows.filter(F.coalesce((F.size("v") == wide) & sound, F.lit(False))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("point"))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` points with the smallest SHA-256 of salt and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(key.alias("key"), "point").orderBy("key", "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64)


_STATE = "vec_id long, point array<long>, cluster int, second int, upper double, lower double"


def _matrix(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)


def assigned(state: DataFrame, centers: Centroids, wide: int) -> DataFrame:
    """The state after one assignment; points that have none yet begin at centroid 0."""
    fresh = "cluster" not in state.columns

    def run(batches):
        for batch in batches:
            x, n = _matrix(batch, wide), batch.num_rows
            if fresh:
                cluster, second = np.zeros(n, np.int64), np.full(n, centers.order[0, min(1, len(centers.points) - 1)])
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                cluster, second = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
                upper, lower = (batch.column(k).to_numpy().copy() for k in (4, 5))
            centers.assign(x, cluster, second, upper, lower)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower)],
                names=["vec_id", "point", "cluster", "second", "upper", "lower"],
            )

    return state.mapInArrow(run, _STATE)


def moved(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of its points; one without points stays."""
    k, wide = centers.shape

    def add(batches):
        sums, count = np.zeros((k, wide), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            np.add.at(sums, cluster, _matrix(batch, wide))
            count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * wide, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), flat], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "point").mapInArrow(add, "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("pos", "part"))
    rows = each.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = centers.copy()
    for r in rows:
        out[r.cluster, r.pos] = int(r.total) // r.n
    return out


def centroid_clusters(
    table: DataFrame, k: int = 40, rounds: int = 5, wide: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every vector kept; the centroids).

    Vectors that are null, of another length than ``wide``, or hold a null, a non-finite
    number or one of a magnitude of ``MOST`` / ``scale`` (262,144) or more take no part.  A null id takes part
    and is hashed as the empty text; repeated rows of an id are vectors of their own, ordered by
    their components where they are first centroids.  With fewer than ``k`` vectors each is a first centroid; an
    empty table gives an empty result.  Other columns are ignored.
    """
    points = written(integer_points(table, wide, scale, id_col, vector_col), "points")
    at = first_centroids(points, k, salt)
    if not len(at):
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), at.reshape(0, wide)
    state, centers = points, Centroids(at)
    for number in range(rounds + 1):
        last, state = state, written(assigned(state, centers, wide), "clusters")
        drop_written(last)
        if number < rounds:
            at, before = moved(state, at), at
            centers = Centroids(at, before)

    def distances(batches):
        for batch in batches:
            d = squared(_matrix(batch, wide), at[batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], names=["vec_id", "cluster", "distance"])

    ends = written(state.select("vec_id", "point", "cluster").mapInArrow(distances, "vec_id long, cluster int, distance long"), "ends")
    drop_written(state)
    return ends, at


def with_inertia(ends: DataFrame, centers: np.ndarray) -> DataFrame:
    """``ends`` with the inertia of each cluster and of all, and a digest of the final centroid; a sum beyond 64 bits is null."""
    spark = ends.sparkSession
    sums = {r.cluster: int(r.s) for r in ends.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centers]
    rows = [(c, long(sums.get(c, 0)), long(sum(sums.values())), digest[c]) for c in range(len(centers))]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``embeddings`` table: 40 centroids, five rounds."""
    return with_inertia(*centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """The same in DuckDB's SQL, every vector against every centroid in each round."""
    steps = f"""WITH points AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cell AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM points
), c0 AS MATERIALIZED (
  SELECT f.c, e.i, e.x AS y FROM (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM points QUALIFY c < {k}
  ) f JOIN cell e ON e.vec_id = f.vec_id
)"""
    near = "SELECT vec_id, min(d * 64 + c) AS best FROM (SELECT e.vec_id, c.c, sum((e.x - c.y) * (e.x - c.y)) AS d FROM cell e JOIN c{0} c ON e.i = c.i GROUP BY e.vec_id, c.c) GROUP BY vec_id"
    for r in range(rounds + 1):
        steps += f", a{r} AS MATERIALIZED (\n  SELECT vec_id, CAST(best % 64 AS INTEGER) AS c, CAST((best - best % 64) / 64 AS BIGINT) AS d FROM ({near.format(r)})\n)"
        if r < rounds:
            mean = "CAST(floor(CAST(sum(e.x) AS DOUBLE) / count(*)) AS BIGINT)"  # sums below 2 ** 53: the quotient floors right
            steps += f""", c{r + 1} AS MATERIALIZED (
  SELECT o.c, o.i, coalesce(n.y, o.y) AS y FROM c{r} o LEFT JOIN (
    SELECT a.c, e.i, {mean} AS y FROM a{r} a JOIN cell e ON e.vec_id = a.vec_id GROUP BY a.c, e.i
  ) n ON n.c = o.c AND n.i = o.i
)"""
    return f"""{steps}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.s AS centroid_sha256
FROM a{rounds} a JOIN (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS s FROM c{rounds} GROUP BY c) h ON h.c = a.c"""


OP13_SQL = clusters_sql()
