"""Intents, weights and variants of whole query texts: a cue beyond the fortieth character counts."""

from lexquarry import catalog


def test_cues_past_forty_characters_count(spark, tmp_path):
    text = "x" * 60 + " bail, arrest and warrant"
    spark.createDataFrame([(0, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r.intent for r in run("intent_score_whole")] == ["procedural_check"]
    assert {r.retriever: r.weight for r in run("retriever_weights_whole")}.keys() == {"vector", "kg", "citation", "keyword"}
    assert min(run("query_variants_whole"), key=lambda r: r.nth).variant == text
    assert all("text[1:40]" not in catalog.ORACLE_SQL[f"{n}_whole"] for n in ("intent_score", "retriever_weights", "query_variants"))
