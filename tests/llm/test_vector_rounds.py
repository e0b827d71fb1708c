"""What op3 sends to blocks: few cells where all vectors visit all, and rounds."""

from collections import Counter
from pathlib import Path

import numpy as np

from lexquarry.llm import vectors as V
from lexquarry.llm.components import Forest
from lexquarry.plans.storage import shared_dir


def test_cells_follow_what_vectors_visit():
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(V.fitted_cells(unit(rng.normal(size=(4000, 64))), 60_000, 0.2)) <= 2  # any cell is visited by most
    heads = unit(rng.normal(size=(50, 64)))
    near = unit(heads[rng.integers(0, 50, 4000)] + rng.normal(size=(4000, 64)) * 0.005)
    assert len(V.fitted_cells(near, 60_000, 0.2)) > 20


def test_pairs_are_joined_whatever_their_number():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, (2, 5000))
    a, b = a // 40 * 40 + b % 40, b  # ten crowds
    one, other = Forest(400), Forest(400)
    V.join_all(one, a, b)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        other.join(x, y)
    assert one.roots().tolist() == other.roots().tolist()


def test_rounds_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x = np.concatenate([x, x + 0.02, x * 2, x[:20] + 0.1, x[:7]]).astype(np.float32)
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    result = lambda t: Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(t).collect())
    whole = result(table)
    monkeypatch.setattr(V, "BLOCK", 8)
    monkeypatch.setattr(V, "TILE", 3)
    monkeypatch.setattr(V, "ROUND", 30)
    folder = Path(shared_dir(spark).removeprefix("file://")) / "lexquarry"
    before = set(folder.glob("near-*"))
    assert result(table) == whole
    assert len(set(folder.glob("near-*")) - before) > 1  # several rounds
    assert result(table.withColumn("embedding", table["embedding"].cast("array<double>"))) == whole
