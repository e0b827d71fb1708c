"""Wide steps run in more partitions when they read more."""

from lexquarry.operators import graph as G
from lexquarry.plans import storage


def test_partitions_follow_the_files(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id AS case_id", "id % 7 AS section_id").write.parquet(f"file://{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t")
    few = storage.spread(table, "case_id").rdd.getNumPartitions()
    monkeypatch.setattr(storage, "SPREAD", 1000)
    many = storage.spread(table, "case_id").rdd.getNumPartitions()
    assert few <= 16 < many and storage.spread(table, "case_id").count() == 20_000
    assert "RepartitionByExpression" in G.co_occurrence(table)._jdf.queryExecution().optimizedPlan().toString()


def test_related_stays_a_set(spark):
    seeds = spark.createDataFrame([(1,), (1,), (2,)], "section_id long")
    edges = spark.createDataFrame([(1, 3, "X"), (1, 3, "X"), (3, 2, "Y"), (4, 3, "X")], "src long, dst long, type string")
    vertices = spark.createDataFrame([(3, "t", "A", 1), (3, "t", "A", 1), (3, "u", "A", 1), (2, "v", "B", 2)], "section_id long, title string, act string, year int")
    got = sorted((r.section_id, r.other, r.type, r.title) for r in G.related(seeds, edges, vertices).collect())
    assert got == [(1, 3, "X", "t"), (1, 3, "X", "u"), (2, 3, "Y", "t"), (2, 3, "Y", "u")]
