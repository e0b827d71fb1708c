"""Structured Streaming flows: ingestion, idempotent chunks, progress and outstanding steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexquarry.functions import text as T
from lexquarry.operators import chunking, vectors
from lexquarry.plans.storage import shared_dir
from lexquarry.sources import files
from lexquarry.sources.versions import VersionedTable

# The steps of an analysis in order, and what the user sees of each.
STEPS = ("understanding", "research", "graph", "evidence", "contradiction", "procedure", "reasoning", "strategy", "risk", "fusion", "explanation", "report")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, max_files: int = 1000) -> StreamingQuery:
    """New document files, cleaned, chunked, embedded and merged by document into versions of the chunk table.

    Each micro-batch is one version, and its number goes with it: a batch that is run
    again after a failure changes nothing, and reading costs the same after any number of batches.
    """
    table = VersionedTable(spark, target, ("path", "doc_id"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        docs = batch.select("doc_id", T.clean_text(F.col("text")).alias("text")).filter("length(text) >= 100").dropDuplicates(["doc_id"])
        chunks = vectors.embed(chunking.chunk_documents(docs))
        chunks = files.chunk_ids(chunks.withColumn("path", F.lit(source)))
        table.merge(chunks.dropDuplicates(["chunk_id"]), number)
        table.clean()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_table(spark: SparkSession, target: str) -> DataFrame:
    """The merged chunks: of each document those of the latest batch that has it, so none of an older, longer version stays."""
    return VersionedTable(spark, target, ("path", "doc_id")).read()


def distinct_events(stream: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; what comes later meets the merge key."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def stage_table(spark: SparkSession, names: tuple[str, ...] = STEPS) -> DataFrame:
    """(step, ordinal, progress) of a run; a fixed dimension."""
    rows = ", ".join(f"('{n}', {i}, {round(100 * (i + 1) / len(names))})" for i, n in enumerate(names))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(step, ordinal, progress)")


def progress(events: DataFrame, stages: DataFrame, step: str = "step") -> DataFrame:
    """Completion events with the ordinal and percentage of their stage; a stream joined with a table, or a table."""
    return events.join(F.broadcast(stages), events[step] == stages["step"]).drop(stages["step"])


def outstanding(cases: DataFrame, completed: DataFrame, stages: DataFrame) -> DataFrame:
    """(case_id, next_step): the first step that a case hasn't completed, or done.

    The completed steps of a case are few distinct ordinals; they are reduced to one bit set before the shuffle.
    """
    bits = completed.join(F.broadcast(stages), "step").groupBy("case_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("ordinal"))).alias("bits"))
    rows = cases.select("case_id").join(bits, "case_id", "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    names = [r["step"] for r in stages.orderBy("ordinal").collect()]
    out = F.lit("done")
    for i, name in reversed(list(enumerate(names))):
        out = F.when(F.shiftright("bits", i).bitwiseAND(1) == 0, name).otherwise(out)
    return rows.select("case_id", out.alias("next_step"))


def run_to_table(stream: DataFrame, tag: str) -> DataFrame:
    """Drain a stream of files to Parquet in the shared folder, with a checkpoint of its own, and return it as read back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/lexquarry/{tag}-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
