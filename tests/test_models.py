"""Plugged-in models: loaded once a worker, fed small batches, and their scores decide."""

import numpy as np

from lexquarry.operators import models as M
from lexquarry.operators import retrieval as R


def test_an_embedder_is_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def factory():
        import os

        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")

        def model(texts):
            assert len(texts) <= 32
            return np.array([[len(t), 1.0] for t in texts])

        return model

    rows = spark.createDataFrame([(i, "x" * (i % 50) if i % 9 else None) for i in range(500)], "n long, text string").repartition(12)
    name = f"test-{tmp_path.name}"
    got = {r.n: list(r.embedding) for r in M.embed_with(rows, factory, name, prefix="ab").collect()}
    assert got == {i: [2.0 + (i % 50 if i % 9 else 0), 1.0] for i in range(500)}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))
    M.embed_with(rows, factory, name).collect()
    again = open(log).read().split()
    assert len(again) == len(set(again))


def test_a_pair_scorer_changes_the_order(spark):
    queries = spark.createDataFrame([(1, "one two"), (2, "three")], "query_id long, text string")
    hits = [(q, f"d{i}", 1.0 / (i + 1), f"{'y' * 600}{i}" if i else None, 0.9 - i / 10, ["keyword"]) for q in (1, 2) for i in range(8)]
    fused = spark.createDataFrame(hits, "query_id long, doc_key string, rrf double, text string, score double, matched_sources array<string>")
    plain = sorted((r.query_id, r.doc_key, r["rank"]) for r in R.rerank(fused.fillna({"text": ""}), queries, 3).collect())
    assert sorted((r.query_id, r.doc_key, r["rank"]) for r in M.rerank_with(fused.fillna({"text": ""}), queries, k=3).collect()) == plain

    def factory():
        def model(asked, texts):
            assert all(len(t) <= 500 for t in texts) and set(asked) <= {"one two", "three"}
            return np.array([-len(t) for t in texts])

        return model

    got = sorted((r.query_id, r["rank"], r.doc_key) for r in M.rerank_with(fused, queries, factory, k=2, keep=5, name="shortest").collect())
    assert [g for g in got if g[0] == 1][0][2] in {"d0", "d1"} and len(got) == 4
