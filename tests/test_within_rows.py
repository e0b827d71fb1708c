"""Extraction within a row gives what the joins give, without a shuffle."""

from pyspark.sql import functions as F

from lexquarry import catalog
from lexquarry.operators import grounding as P

TEXTS = [
    "Section 302 read with Section 34(2) of the Indian Penal Code, 1860. Later Section 302 of the Insurance Act and Section 9A of an unknown thing.",
    "under Sec. 66A and 67 of the IT Act; Sections 12 of the Evidence Act, 1872 and Section 12 of the Contract Act",
    "nothing here", "", None,
]


def test_snippets_within_rows(spark):
    docs = spark.createDataFrame([(i, t, s) for i, t in enumerate(TEXTS) for s in ("302", "12", "9A")], "doc_id long, text string, section string")
    pages = spark.createDataFrame([(i, 3 - k, (t or "")[60 * k :]) for i, t in enumerate(TEXTS) for k in range(2)], "doc_id long, page int, text string")
    own = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "text")).alias("pages"))
    want = P.section_snippets(docs.select("doc_id", "section"), docs.select("doc_id", "text").dropDuplicates(["doc_id"]), pages).collect()
    got = P.snippets_within(docs.join(own, "doc_id")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 3


def test_texts_are_not_shuffled(spark):
    sf = "/root/testdata/sf0.001"
    plan = catalog.QUERIES["section_snippets"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("orders.parquet") == 1
