"""Secret scanning with an incremental blob ledger.

Every text version is addressed by the SHA-256 of its bytes.  The ledger holds
one row per (blob, rule version) that was ever scanned, with its findings, so
a run scans only blobs that are new or rules that changed, each blob once
however many paths carry it, and joins the findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.prefilter import bitmap, found, fresh, split_by_ids
from lexquarry.llm.wordbpe import slices, small_batches, tidy
from lexquarry.plans.storage import drop_written, written

#: Bits of the map of rows to scan: 16 MB at most; a full map only has copies scanned again.
BITS = 1 << 27


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


#: Fixed values of the base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scanner(rules: tuple[Rule, ...]):
    """text -> (kind number, start, end) of all findings, by start and then kind."""
    ready = []
    for number, rule in enumerate(rules):
        pattern = rule.pattern
        if re.fullmatch(r"\[[^]]+\]\+", pattern) and rule.least > 1:
            pattern = f"{pattern[:-1]}{{{rule.least},}}"  # whole runs of one class: short ones needn't be matched to be dropped
        ready.append((number, re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)), rule.group, rule.least))

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = []
        for number, pattern, group, least in ready:
            for m in pattern.finditer(text):
                if m.end(group) - m.start(group) >= least:
                    found.append((m.start(), number, m.end()))
        return [(number, start, end) for start, number, end in sorted(found)]

    return scan


def scan_blobs(rows: DataFrame, rules: tuple[Rule, ...], wanted: np.ndarray) -> DataFrame:
    """(blob, text, key) rows to ledger rows (blob, rule_version, findings) of those whose key is in the map ``wanted``; each blob once in a task."""
    version, kinds = rule_version(rules), [r.kind for r in rules]
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    @tidy
    def run(batches):
        scan, seen = scanner(rules), set()
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in (part for whole in batches for part in slices(whole)):
            batch = batch.filter(pa.array(found(sent.value, batch.column(2).to_numpy().view(np.uint64))))
            blobs, texts, of = batch.column(0).to_pylist(), batch.column(1), []
            fresh = [n for n, b in enumerate(blobs) if not (b in seen or seen.add(b))]
            for n in fresh:
                of.append([{"kind": kinds[k], "start": s, "end": e} for k, s, e in scan(texts[n].as_py())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([blobs[n] for n in fresh], pa.binary()), pa.array([version] * len(fresh), pa.string()), pa.array(of, pa.list_(item))],
                names=["blob", "rule_version", "findings"],
            )

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "blob binary, rule_version string, findings array<struct<kind:string,start:bigint,end:bigint>>")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES,
    ledger: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, blob, findings per row; the ledger rows that this run added).

    ``ledger`` is what earlier runs returned, stored by the caller; its blobs of
    the same rule version are not scanned again.  Null text counts as empty and
    has no findings; repeated rows share one blob and its findings; an empty
    table gives empty results; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))
    paths = written(rows.select("doc_id", "blob"), "paths")
    todo = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        todo = todo.join(ledger.filter(F.col("rule_version") == rule_version(rules)).select("blob"), "blob", "left_anti")
    todo = written(todo, "unseen")
    # One row stands for each unseen blob.  Texts stay where they are: a map of those rows tells a task which ones to scan.
    key = F.xxhash64("blob", "doc_id").alias("key")
    scanned = scan_blobs(rows.select("blob", "text", key), rules, bitmap(todo.select(key), BITS))
    added = written(scanned.join(todo.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]), "ledger")
    drop_written(todo)
    full = added if ledger is None else added.unionByName(ledger.filter(F.col("rule_version") == rule_version(rules)))
    hits = full.filter(F.size("findings") > 0).select("blob", "findings")
    empty = F.array().cast(dict(added.dtypes)["findings"])
    paths = paths.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", empty))
    return paths.select("doc_id", "blob", "findings"), added


def redact_secrets(docs: DataFrame, ledger: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every finding of ``ledger`` in their texts replaced by ``mark``; overlapping ones once.

    Rows are matched by blob; texts without findings stay as they are, null included.
    """
    blob = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    key, spans_of = fresh(docs, "_blob"), fresh(docs, "_findings")
    hits = ledger.filter(F.size("findings") > 0).select(F.col("blob").alias(key), F.col("findings").alias(spans_of))
    may, rest = split_by_ids(docs.withColumn(key, blob), hits, key)  # texts that surely have none stay where they are
    joined = may.join(hits.dropDuplicates([key]).hint("shuffle_hash"), key, "left").drop(key)
    names, at = docs.columns, docs.columns.index(text_col)

    def mask(text: str, spans: list[dict]) -> str:
        out, done = [], 0
        for span in sorted(spans, key=lambda f: f["start"]):
            if span["start"] >= done:
                out += [text[done : span["start"]], mark]
            done = max(done, span["end"])
        return "".join(out) + text[done:]

    @tidy
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index(text_col))):
            spans = batch.column(batch.schema.get_field_index(spans_of)).to_pylist()
            texts = [mask(t, f) if f else t for t, f in zip(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), spans, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    return rest.select(names).unionByName(joined.mapInArrow(run, docs.schema))


def span_digest(findings: str = "findings") -> tuple:
    """Columns n_assign, n_access, n_hex, base_sha256 and spans over a findings column."""
    base = [r.kind for r in BASE_RULES]
    of = F.col(findings)
    joined = lambda a: F.array_join(F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    def count(kind: str):
        return F.size(F.filter(of, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter(of, lambda f: f["kind"].isin(base))
    return (*map(count, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(of).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table against a new ledger."""
    found, _ = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *span_digest())
