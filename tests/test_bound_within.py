"""Sections bound within a row, and the query on top of them, against the rows made by a shuffle."""

from pyspark.sql import functions as F

from lexquarry import catalog
from lexquarry.operators import extraction as X

TEXTS = [
    "Guilty under Section 302 read with Section 34(2) of the Indian Penal Code, 1860. Then Section 302 of the Evidence Act and Sections 7 and 7A of the Arbitration Act, 1996.",
    "Section 12A of the Insurance Act was read; section 12 of The Companies Act too, then Section 12A of the Limitation Act",
    "Section 5 of the Act. Section 9 and Section 9 of the Customs Act; Sec. 4(a)(b) of the Motor Vehicles Act, 1988",
    "nothing is named here",
    None,
]


def test_bound_within_gives_the_rows_of_bindings(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {tuple(r) for r in X.bindings(docs).collect()}
    got = docs.select("doc_id", F.explode(X.bound_within(F.col("text"))).alias("b")).select("doc_id", "b.number", "b.act").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 8
    group = lambda n: F.regexp_extract_all("text", F.lit(X.BINDING), F.lit(n))
    whole = docs.select(F.explode(F.arrays_zip(group(0).alias("m"), group(1).alias("s"), group(2).alias("t"), group(3).alias("a"))).alias("x")).select("x.*")
    for n, c in ((1, "s"), (2, "t"), (3, "a")):
        assert whole.filter(F.regexp_extract("m", X.BINDING, n) != F.col(c)).isEmpty()


def test_issue_statements_shuffle_no_text(spark):
    plan = catalog.QUERIES["issue_statements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") <= 3 and plan.count("Aggregate") == 1
