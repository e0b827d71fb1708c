"""Parts of Arrow batches: all rows in their order, none too large."""

import numpy as np
import pyarrow as pa

from lexquarry.functions import batches as A
from lexquarry.operators import chunking as K


def test_parts_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * (i * 7 % 50) for i in range(99)] + ["y" * 5000])], names=["a", "t"])
    parts = list(A.bounded(batch, 600))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.nbytes <= 600 or p.num_rows == 1 for p in parts) and len(parts) > 5
    assert [p.num_rows for p in A.bounded(batch.slice(0, 0), 1)] == [0]


def test_steps_bound_rows_and_work():
    work = np.array([1, 1, 9, 0, 0, 3, 3, 3, 0])
    assert list(A.steps(work, 4, 6)) == [(0, 2), (2, 3), (3, 7), (7, 9)]
    assert list(A.steps(work[:0], 4, 6)) == []


def test_chunks_leave_a_task_in_small_batches(spark, monkeypatch):
    """The chunks of one Arrow batch were one batch of chunks before; a task now hands them on part by part."""
    monkeypatch.setattr(A, "PART", 3000)
    monkeypatch.setattr(K, "bounded", lambda batch: A.bounded(batch, 3000))
    docs = spark.createDataFrame([(i, f"word{i} " * 100) for i in range(40)], "doc_id long, text string").coalesce(1)
    cut = K.recursive_chunks(docs, 100, 10)
    sizes = cut.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in bs), "n long")
    assert {r.doc_id for r in cut.collect()} == set(range(40)) and cut.filter("length(text) > 100").isEmpty()
    assert sum(r.n for r in sizes.collect()) == cut.count()
