"""Approximate neighbours against exact ones."""

import numpy as np

from lexquarry.operators import vectors as V

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v) for i, v in enumerate(x.tolist())], SCHEMA)


def hits(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.query_id, set()).add(r.vec_id)
    return out


def test_clustered_points_need_few_cells(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(0, 1, (60, 20))
    points = table(spark, centers[rng.integers(0, 60, 3000)] + rng.normal(0, 0.2, (3000, 20)))
    queries = points.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.build_cells(points, slices=7)
    assert index.codes.count() == 3000 and index.probes < len(index.centers) / 4
    want, got = hits(V.top_k(points, queries)), hits(V.search_cells(index, queries))
    assert sum(len(want[q] & got[q]) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_scores_are_exact_and_all_cells_give_all(spark):
    rng = np.random.default_rng(7)
    points = table(spark, rng.normal(0, 1, (400, 6)))
    queries = points.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    index = V.build_cells(points)
    every = V.search_cells(index, queries, probes=len(index.centers), short=40).collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, V.top_k(points, queries).collect()))


def test_odd_tables(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, 0.0]), (5, [1.0, 0.1])]
    points = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.vec_id, r["rank"]) for r in V.ann_cells(points, queries, probes=9).orderBy("rank").collect()]
    assert got == [(4, 1), (5, 2), (1, 3)]
    assert V.ann_cells(points.limit(0), queries).collect() == []
