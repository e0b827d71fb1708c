"""Memory of a search's tasks: bounded by a number of scores, not by queries times the rows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexquarry.operators import vectors as V


def batch_of(keys, x):
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["key", "v"])


def test_leading_breaks_ties_by_key_and_puts_missing_scores_last():
    score = np.array([[0.5, 0.9, 0.5, np.nan], [np.nan, np.nan, 0.1, 0.1]])
    assert V.leading(score, np.array([[4, 3, 1, 0]]), 2).tolist() == [[1, 2], [3, 2]]
    assert V.leading(score, np.array([[4, 3, 1, 0]]), 9).tolist() == [[1, 2, 0, 3], [3, 2, 1, 0]]
    assert V.leading(score[:, :0], np.zeros((1, 0), int), 3).shape == (2, 0)


def test_a_task_keeps_the_best_of_all_its_batches(monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.integers(-2, 3, (300, 4)).astype(float), rng.integers(-2, 3, (20, 4)).astype(float)
    x[7] = 0
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    keys = rng.permutation(1000)[:300]
    batches = [batch_of(keys[i : i + 110], x[i : i + 110]) for i in range(0, 300, 110)]
    monkeypatch.setattr(V, "CELLS", 700)
    (got,) = V.nearest_points(batches, np.arange(20), unit(q), 5, "vec_id")
    score = np.round(unit(q) @ unit(x).T, 6)
    want = [(n, int(keys[i])) for n in range(20) for i in np.lexsort((keys, -score[n]))[:5]]
    assert list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) == want


def test_a_block_of_queries_meets_a_whole_batch_in_little_memory():
    rng = np.random.default_rng(5)
    batch, q = batch_of(np.arange(5000), rng.normal(size=(5000, 16))), rng.normal(size=(4096, 16))
    tracemalloc.start()
    try:
        list(V.nearest_points([batch], np.arange(4096), q, 10, "vec_id"))
        assert tracemalloc.get_traced_memory()[1] < 120e6  # all pairs at once were 164 MB in each of several copies
    finally:
        tracemalloc.stop()
