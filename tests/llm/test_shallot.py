"""Integer k-means by shallot search against a plain version, with ties, equal points and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from lexquarry.llm.shallot import Centroids, centroid_clusters, squared, with_inertia

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, point int"


def plain(rows, k, rounds, wide):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and len(v) == wide and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(((key(i), v) for i, v in kept))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, c), n) for n, c in enumerate(centers))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(centers)):
            if own := [v for (_, v), n in zip(kept, of, strict=True) if n == c]:
                centers[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    ends = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = {c: sum(d for _, n, d in ends if n == c) for c in range(len(centers))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, total[c], sum(total.values()), digest[c]) for i, c, d in ends), key=repr)


def run(spark, rows, **how):
    table = spark.createDataFrame([(i, v, 1, "x", "y", 3) for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, with_inertia(*centroid_clusters(table, **how)).collect()), key=repr)


@pytest.mark.parametrize("k", [1, 2, 7, 60])
def test_matches_the_plain_version(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, (rng.integers(-3, 4, 4) / 256).tolist()) for i in range(50)]  # a small grid: ties, equal points, equal centroids
    rows += [(i, (rng.normal(0, 1, 4) + 5 * (i % 5)).tolist()) for i in range(50, 200)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, []), (202, [1.0, 2.0, 3.0]), (203, [1.0, nan, 0.0, 0.0]), (204, [1.0, inf, 0.0, 0.0]), (205, [1.0, None, 0.0, 0.0]), (206, [0.0] * 4), (None, [0.1] * 4), rows[3], rows[3]]
    assert run(spark, rows, k=k, wide=4, rounds=3) == plain(rows, k, 3, 4)


def test_empty_and_fewer_than_the_centroids(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [0.5] * 64)]) == plain([(1, [0.5] * 64)], 40, 5, 64)


def test_huge_components_take_no_part(spark):
    assert [r[0] for r in run(spark, [(1, [3e38] * 4), (2, [1.0] * 4)], wide=4)] == [2]


def test_search_skips_and_still_finds_both(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2000, 2000, (2000, 6)) + 40_000 * rng.integers(0, 10, 2000)[:, None]
    points = x[rng.choice(len(x), 30, replace=False)]
    centers = Centroids(points)
    every = np.stack([squared(x, p[None]) for p in points])
    want = np.sort(every, axis=0)[:2]
    first, d1, second, d2 = centers.search(x, np.full(len(x), 4), np.full(len(x), 9))
    assert (first == every.argmin(0)).all() and (d1 == want[0]).all() and (d2 == want[1]).all()
    assert (every[second, np.arange(len(x))] == want[1]).all()
    cluster, other, upper, lower = np.zeros(len(x), np.int64), np.ones(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    assert centers.assign(x, cluster, other, upper, lower) > len(x) / 2
    assert Centroids(points + 1, points).assign(x, cluster, other, upper, lower) < len(x) / 2  # most keep their centroid unseen
