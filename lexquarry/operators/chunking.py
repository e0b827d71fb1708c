"""Chunking: one document row to many chunk rows, all within the row that holds the document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.functions.batches import bounded

SIZE, OVERLAP, SMALL = 1000, 200, 100
# Fixed value: where a numbered or named section starts.
SECTION_START = r"(?m)(?:^|\n)((?:(?:SECTION|Section|Art\.|Article)\s+)?\d{1,4}[A-Z]?\.?\s+[A-Z])"
# Where a window may end, best first.
BREAKS = tuple(map(re.compile, (r"\.\s+[A-Z]", r"\.\n", r"\n\n", r"\n", r"\s+")))
SEPARATORS = ("\n\n", "\n", "Article ", "Section ", " ", "")
# Fixed value: the separators for chunks of a number of tokens, legal headings first.
TOKEN_SEPARATORS = ("\n## ", "\n### ", "\nArticle ", "\nPart ", "\nSchedule ", "\n\n", "\n", " ")


def section_parts(text):
    """The text cut before every section start; blank parts dropped."""
    marked = F.split(F.regexp_replace(text, SECTION_START, "\u0001$1"), "\u0001")
    return F.filter(F.transform(marked, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")


def window_end(text: str, start: int, size: int) -> int:
    """The last best break past half of the window, or the window's end."""
    part = text[start : start + size]
    for pattern in BREAKS:
        places = [m.start() for m in pattern.finditer(part, len(part) // 2) if m.start() > len(part) * 0.5]
        if places:
            return start + places[-1] + 1
    return start + size


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of overlapping windows that end at sentence breaks where they can; the overlap is half of the size at most."""
    if not 0 <= 2 * overlap <= size or size < 1:
        raise ValueError(f"an overlap of {overlap} doesn't fit windows of {size}")
    start = 0
    while start < len(text):
        if start + size >= len(text):
            yield start, len(text)
            return
        end = window_end(text, start, size)
        yield start, end
        start = end - overlap


def recursive_parts(text: str, size: int, overlap: int, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Split on the first separator present, merge greedily up to ``size``, recurse on what is too long."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    cut, deeper = separators[at], separators[at + 1 :]
    pieces = [cut + p if i and cut.strip() else p for i, p in enumerate(text.split(cut))] if cut else list(text)
    glue = "" if cut.strip() else cut
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if joined := glue.join(held).strip():
            out.append(joined)

    for piece in pieces:
        if length(piece) > size and deeper:
            flush()
            held.clear()
            out += recursive_parts(piece, size, overlap, length, deeper)
            continue
        if held and length(glue.join([*held, piece])) > size:
            flush()
            while held and (length(glue.join(held)) > overlap or length(glue.join([*held, piece])) > size):
                held.pop(0)
        held.append(piece)
    flush()
    return out


def _chunked(df: DataFrame, texts: str, cut: Callable[..., list[str]]) -> DataFrame:
    """The rows of ``df`` with column ``texts`` replaced by (chunk_index, text, total_chunks) of what ``cut`` makes of it; nothing is shuffled, and a task holds the chunks of a few megabytes of text at once."""
    kept = [c for c in df.columns if c not in (texts, "chunk_index", "text", "total_chunks")]

    def run(batches):
        for batch in (part for whole in batches for part in bounded(whole)):
            chunks = [cut(t) for t in batch.column(len(kept)).to_pylist()]
            size = np.array([len(c) for c in chunks], np.int64)
            owner = pa.array(np.repeat(np.arange(len(chunks)), size))
            at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            made = [pa.array(at, pa.int32()), pa.array([t for c in chunks for t in c], pa.string()), pa.array(np.repeat(size, size))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(owner) for n in range(len(kept))), *made], names=[*kept, "chunk_index", "text", "total_chunks"])

    schema = T.schema_of(df.select(kept))
    return df.select(*kept, texts).mapInArrow(run, schema.add("chunk_index", "integer").add("text", "string").add("total_chunks", "long"))


def merged_small(parts: list[str], least: int = SMALL) -> list[str]:
    """Parts under ``least`` characters joined with their successor; a small last one stays."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for part in parts:
        if held and size >= least:
            out.append("\n\n".join(held))
            held, size = [], 0
        size += len(part) + 2 * bool(held)
        held.append(part)
    return [*out, "\n\n".join(held)] if held else out


def chunk_documents(docs: DataFrame, key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, the other columns, chunk_index, text, char_count): section parts, windows of long ones, small ones merged.

    A text without parts has no chunks.  All of a text's chunks are made within its row.
    """

    def cut(parts: list[str] | None) -> list[str]:
        pieces = []
        for part in parts or ():
            pieces += [part] if len(part) <= size else [part[a:b].strip() for a, b in windows(part, size, overlap)]
        return merged_small(pieces)

    rows = docs.withColumn("text", section_parts(F.col("text")))
    return _chunked(rows, "text", cut).drop("total_chunks").withColumn("char_count", F.length("text"))


def chunk_pages(pages: DataFrame) -> DataFrame:
    """Chunks of (filename, pages array), page numbers from 1, blank pages skipped, ids by file, page and index."""
    rows = pages.select("filename", F.posexplode("pages").alias("at", "text")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = rows.select(F.struct("filename", (F.col("at") + 1).alias("page_number")).alias("place"), "text")
    out = chunk_documents(rows, "place")
    return out.select(
        "place.filename", "place.page_number", "chunk_index", "text", "char_count",
        F.format_string("%s_p%d_c%d", "place.filename", "place.page_number", "chunk_index").alias("chunk_id"),
    )


def fixed_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, key: str = "doc_id") -> DataFrame:
    """K02 without sentence breaks: (key, chunk_index, text) at a fixed stride, built-in expressions alone."""
    last = F.greatest(F.length("text") - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    rows = docs.filter("length(text) > 0").select(key, "text", F.posexplode(starts).alias("chunk_index", "start"))
    return rows.select(key, "chunk_index", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def recursive_chunks(docs: DataFrame, size: int = 800, overlap: int = 100, by_tokens: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, chunk_index, text, total_chunks); token lengths are a quarter of the characters, and split at legal headings first."""
    length, separators = (lambda t: len(t) // 4, TOKEN_SEPARATORS) if by_tokens else (len, SEPARATORS)
    return _chunked(docs.select(key, "text"), "text", lambda t: recursive_parts(t, size, overlap, length, separators) if t and t.strip() else [])


def line_chunks(docs: DataFrame, key: str = "doc_id", longer_than: int = 30) -> DataFrame:
    """Lines longer than 30 characters, or the whole text when there are none."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > longer_than)
    return docs.select(key, F.posexplode(F.when(F.size(lines) > 0, lines).otherwise(F.array("text"))).alias("line_index", "line"))


def pages_of(docs: DataFrame, footer: str, key: str = "doc_id") -> DataFrame:
    """(key, page, text): lines between footers that carry a page number, white space squeezed.

    A page's number is one more than that of the footer before it.
    """
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = T.first_match(F.col("line"), footer)
    lines = lines.withColumn("footer", number.cast("int"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    paged = lines.withColumn("page", F.coalesce(F.last("footer", True).over(before) + 1, F.lit(1)))
    body = F.array_sort(F.collect_list(F.when(F.col("footer").isNull(), F.struct("pos", "line"))))
    text = F.regexp_replace(F.array_join(F.transform(body, lambda x: x["line"]), " "), r"\s+", " ")
    return paged.groupBy(key, "page").agg(F.trim(text).alias("text"))


def sentence_rows(docs: DataFrame, longer_than: int = 15, key: str = "doc_id") -> DataFrame:
    """(key, pos, sentence)."""
    return docs.select(key, F.posexplode(T.sentences(F.col("text"), longer_than)).alias("pos", "sentence"))


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks and their mean size by document."""
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
