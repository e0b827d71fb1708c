"""What the hybrid search makes, reads and shuffles follows its hits: edges and texts are cut to what is asked."""

from lexquarry.operators import retrieval as R
from lexquarry.operators import vectors as V
from lexquarry.plans.views import view


def test_edges_are_made_for_the_sections_found(spark):
    sf = "/root/testdata/sf0.001"
    sections, edges = view(spark, sf, "sections"), view(spark, sf, "edges")
    asked = spark.createDataFrame([(1, "see Section 7"), (2, "Section 12 and Section 3"), (3, "no number")], "query_id int, text string")
    hits = R.graph_hits(asked, sections, edges)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi, (l_partkey") == 2  # at the lines, below what makes the pairs
    seeds = R.section_lookup(R.numbers_asked(asked), sections).select("section_id").distinct()
    want, got = R.neighbours(seeds, edges).collect(), R.neighbours(seeds, edges, few=True).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, got)) and got
    none = R.graph_hits(asked.filter("query_id = 3"), sections, edges)
    assert "l_partkey" not in none._jdf.queryExecution().optimizedPlan().toString()


def test_only_texts_of_hits_are_shuffled(spark):
    chunks = V.embed(spark.createDataFrame([(f"doc:{i}", f"text {i % 40}") for i in range(60)] + [("doc:1", "text 1")], "doc_key string, text string"))
    queries = spark.createDataFrame([(q, f"text {q}") for q in range(3)], "query_id long, text string")
    hits = V.text_hits(queries, chunks, 5)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
    rows = hits.collect()
    assert len(rows) == 15 and all(r.text == f"text {int(r.doc_key[4:]) % 40}" for r in rows)
