"""The registered stream leaves its rows in the shared folder, not on the driver."""

import os

import pytest

from lexquarry import catalog
from lexquarry.plans.storage import shared_dir

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_distinct_events_are_written(spark):
    got = catalog.QUERIES["stream_distinct_events"](spark, DATA)
    folder = shared_dir(spark).removeprefix("file://")
    files = got.inputFiles()
    assert files and all(f"{folder}/lexquarry/events-" in f for f in files)
    want = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type").dropDuplicates(["event_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ingestion_matches_a_batch(spark):
    import __spark_entry__
    from lexquarry.functions import text as T
    from lexquarry.operators import chunking
    from pyspark.sql import functions as F

    got = {r.doc_id: (r.n_chunks, r.n_ids) for r in __spark_entry__.queries()["stream_ingest"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", T.clean_text(F.col("text")).alias("text")).filter("length(text) >= 100")
    want = {r.doc_id: (r["count"], r["count"]) for r in chunking.chunk_documents(docs).groupBy("doc_id").count().collect()}
    assert got == want
