"""The rerank takes the hits of every query, whatever its id."""

from lexquarry import catalog


def test_every_query_is_reranked(spark, tmp_path):
    rows = [(i, f"topic{i}a topic{i}b common words") for i in range(0, 120, 3)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(5 * i, f"some topic{i}a text") for i, _ in rows] + [(5 * i + 1, f"some topic{i}a topic{i}b text") for i, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.query_id, r.rank): r.doc_key for r in catalog.QUERIES["rerank_hits"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): 5 * i + 2 - k for i, _ in rows for k in (1, 2)}
