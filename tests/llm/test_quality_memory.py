"""What a task of the quality classifier holds at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lexquarry.llm.quality import encode_texts, encoded


def test_a_task_encodes_a_bounded_part_at_a_time():
    texts = pa.array(["some words of a text " * 100] * 3000)  # 6 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), texts], names=["id", "text"])
    whole, _ = encode_texts(texts.slice(0, 500))
    rows, at = 0, 0
    tracemalloc.start()
    for part, x, bag in encoded([batch]):
        same = whole[at : at + len(x)]
        assert np.allclose(x[: len(same)], same)
        rows, at = rows + part.num_rows, at + len(x)
        assert bag.max() == part.num_rows - 1
    assert rows == 3000 and tracemalloc.get_traced_memory()[1] < 80_000_000
    tracemalloc.stop()
