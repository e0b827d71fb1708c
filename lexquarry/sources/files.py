"""Sources and sinks: explicit schemas, reject tables instead of exceptions, key-based merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lexquarry.functions import text as T

DOCUMENT = "id string, text string, question string, answer string, section_text string, act string, section_number string, question_type string, source_type string, document_type string, metadata map<string,string>"
SECTION = "section_id string, section_number string, section_title string, title string, section_text string, text string, act string, year int, chapter_title string"
EDGE_FIELDS = {
    "source": "string", "source_id": "string", "target": "string", "target_id": "string", "relationship": "string", "edge_type": "string", "reason": "string",
    "confidence": "string", "deterministic": "boolean", "direction": "string", "properties": "map<string,string>", "metadata": "map<string,string>",
}
CODES = ("bns", "bnss", "bsa", "ipc")


def file_format(path: Column, mime: Column) -> Column:
    """Pdf, docx or txt by suffix, then by mime type; null for anything else (a quarantine row)."""
    low = F.lower(path)
    by_mime = F.when(mime == "application/pdf", "pdf").when(mime.contains("wordprocessingml"), "docx").when(mime.startswith("text/"), "txt")
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").when(low.endswith(".txt"), "txt").otherwise(by_mime)


def read_texts(spark: SparkSession, path: str, suffixes: str = "txt", exclude: str = r"graph|edges") -> DataFrame:
    """One row per file below ``path``, invalid bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{suffixes}}}").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(text, F.make_valid_utf8(F.col("content").cast("string")))
    rows = files.filter(~F.regexp_extract("path", r"([^/]*)$", 1).rlike(exclude)).select("path", text.alias("text"))
    return rows.select("path", "text", F.array("text").alias("pages"), F.lit(1).alias("page_count"), F.lit("txt").alias("format"), F.lit(False).alias("needs_ocr"))


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENT, glob: str = "*.jsonl") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON files (objects or arrays) and JSON lines (files by ``glob``) below ``path``."""
    fields = StructType.fromDDL(schema)
    reader = spark.read.option("recursiveFileLookup", "true")
    lines = reader.option("pathGlobFilter", glob).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", fields).alias("r"))
    whole = reader.option("pathGlobFilter", "*.json").option("wholetext", "true").text(path)
    whole = whole.select(F.col("_metadata.file_path").alias("path"), "value", F.explode_outer(F.from_json("value", ArrayType(fields))).alias("r"))
    rows = lines.unionByName(whole).filter("trim(value) <> ''")
    said = F.lit(False)
    for name in fields.names:  # a line that isn't an object has no field at all
        said |= F.col(f"r.{name}").isNotNull()
    good = F.coalesce(said, F.lit(False))
    return rows.filter(good).select("path", "r.*"), rows.filter(~good).select("path", F.col("value").alias("_corrupt_record"))


def qa_rows(docs: DataFrame) -> DataFrame:
    """Question and answer pairs as texts; keys are hashes of file and pair, so they don't depend on order."""
    act = F.coalesce("act", F.lit("BNS"))
    text = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    rows = docs.filter("question is not null and answer is not null").select("path", text.alias("text"), F.coalesce("act", F.lit("")).alias("act"), F.concat_ws("_", F.lit("qa"), act, "section_number").alias("source"))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws("|", "path", "source", "text"), 256))


def page_rows(docs: DataFrame) -> DataFrame:
    """Corpus pages with their defaults; blank ones dropped."""
    rows = docs.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return rows.withColumns({"source_type": F.coalesce("source_type", F.lit("pdf")), "document_type": F.coalesce("document_type", F.lit("act"))})


def read_sections(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The catalogues of several codes, one JSON array each, in one table; a code without a file adds nothing."""
    rows = spark.createDataFrame([], f"{SECTION}, code string")
    for code, path in paths.items():
        found = spark.read.schema(SECTION).option("multiLine", "true").json(path).withColumn("code", F.lit(code))
        rows = rows.unionByName(found)
    return rows.select("code", "section_id", "section_number", F.coalesce("section_title", "title").alias("title"), F.coalesce("section_text", "text").alias("text"), "act", "year", "chapter_title")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of files that are a list, or an object with an ``edges`` list; field names by either spelling."""
    flat = ", ".join(f"{n} {t}" for n, t in EDGE_FIELDS.items())
    item = ", ".join(f"{n}: {t}" for n, t in EDGE_FIELDS.items())
    raw = spark.read.schema(f"{flat}, edges array<struct<{item}>>").option("multiLine", "true").json(path)
    rows = raw.select(F.explode(F.coalesce("edges", F.array(F.struct(*EDGE_FIELDS)))).alias("e")).select("e.*")
    return rows.select(
        F.coalesce("source", "source_id").alias("src"), F.coalesce("target", "target_id").alias("dst"), F.coalesce("relationship", "edge_type", F.lit("RELATED_TO")).alias("type"),
        F.coalesce("properties", "metadata").alias("properties"), "reason", F.coalesce("confidence", F.lit("medium")).alias("confidence"), "deterministic", "direction",
    )


def evaluation_queries(rows: DataFrame, k: int = 100, order: str = "conv_id") -> DataFrame:
    """The last message of each conversation as a query, blank ones skipped, the first ``k`` in a stated order."""
    text = F.element_at("messages", -1)["content"]
    return rows.select(order, text.alias("text")).filter(F.length(F.trim("text")) > 0).orderBy(order).limit(k)


def html_text(html: Column) -> Column:
    """A page without its tags."""
    return F.regexp_replace(html, r"<[^>]+>", "")


def judgment_records(judgments: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of known cases, rejects): clean text, counts and a metadata struct."""
    clean = T.clean_text(html_text(F.col("doc")))
    rows = judgments.withColumn("text", clean)
    rows = rows.select("case_id", "text", F.length("text").alias("char_count"), T.raw_length(F.col("text")).alias("word_count"), F.struct("tid", "title", "author", "bench", "publishdate", "docsource").alias("metadata"))
    return rows.join(cases.select("case_id"), "case_id", "left_semi"), rows.join(cases.select("case_id"), "case_id", "left_anti")


def chunk_ids(chunks: DataFrame, path: str = "path", doc: str = "doc_id") -> DataFrame:
    """Chunks with an id from file, document and index alone."""
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", path, F.col(doc).cast("string"), F.col("chunk_index").cast("string")), 256))


def upsert_chunks(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Embedded new chunks in front of existing ones of the same id; write the result to a new version's path."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in new.columns if c not in (key, "embedding", "metadata")])  # a stated one of several versions
    fresh = new.filter("embedding is not null").withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def collection_stats(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """Rows, least and greatest vector width and health, for a table or for its groups."""
    size = F.size("embedding")
    rows = vectors.groupBy(group) if group else vectors.groupBy()
    out = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min(size).alias("min_width"), F.max(size).alias("max_width"))
    return out.withColumn("status", F.when(F.col("n_rows") == 0, "unavailable").when(F.col("min_width") == F.col("max_width"), "healthy").otherwise("degraded"))


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("errorifexists").json(path)


def json_rows(rows: DataFrame, key: str) -> DataFrame:
    """S19 as a table: (key, json)."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def import_summary(**tables: DataFrame) -> DataFrame:
    """(source_kind, n) of the tables of a run."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source_kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def numbered_lines(rows: DataFrame, path: str = "path") -> DataFrame:
    """A line number within each file, for display only."""
    return rows.withColumn("line", F.row_number().over(Window.partitionBy(path).orderBy("chunk_id")))
