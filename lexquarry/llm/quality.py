"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of even passages of up to about ``PASSAGE`` bytes, cut at
white space.  Every passage of every text is encoded from its own characters; a gated attention network
learns from document labels alone which passages speak for the document, and
the attention-weighted passage representation is scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.wordbpe import slices, small_batches, tidy

PASSAGE = 600
#: Bytes of text that a task encodes at a time; each takes about a hundred bytes of memory.
PART = 400_000
#: Classes of neighbouring bytes: lower, upper, digit, blank, newline, stop marks, other marks, beyond ASCII.
_CLASS = np.full(256, 7, np.int64)
_CLASS[:128] = 6
for _n, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"!?-()")):
    _CLASS[list(_set)] = _n
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_KINDS, _BYTES, _SIZES = 8, 128 + 16, 12
WIDTH = _BYTES + _KINDS * _KINDS + _SIZES + 2


def encode_passages(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, bag number of each passage) of texts in one byte buffer.

    Features: share of each ASCII byte and of groups of other bytes, of each
    pair of neighbouring byte classes, of word lengths, the share of words that repeat an
    earlier one of the passage, and the logarithm of the passage's length, which only
    tells how far to trust the rest.  A text without bytes has one passage of zeros.
    """
    bag, first, last = [], [], []
    for n, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        edges = [start]
        if end - start > PASSAGE:
            blanks = np.flatnonzero(_BLANK[data[start:end]]) + start
            even = (end - start) // -(-(end - start) // PASSAGE) + 1
            while end - edges[-1] > even:
                at = int(np.searchsorted(blanks, edges[-1] + even))
                edges.append(int(blanks[at]) + 1 if at < len(blanks) else end)
        if edges[-1] < end or len(edges) == 1:
            edges.append(end)
        bag += [n] * (len(edges) - 1)
        first += edges[:-1]
        last += edges[1:]
    bag, first, last = (np.array(x, np.int64) for x in (bag, first, last))
    size = last - first
    out = np.zeros((len(bag), WIDTH), np.float32)
    owner = np.repeat(np.arange(len(bag)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    byte = data[at].astype(np.int64)
    share = 1 / np.maximum(size, 1)[:, None]

    def put(column: int, wide: int, rows: np.ndarray, what: np.ndarray, by: np.ndarray) -> None:
        out[:, column : column + wide] = np.bincount(rows * wide + what, minlength=len(bag) * wide).reshape(-1, wide) * by

    put(0, _BYTES, owner, np.where(byte < 128, byte, 128 + (byte >> 3 & 15)), share)
    if len(byte) > 1:
        kind = _CLASS[byte]
        same = owner[1:] == owner[:-1]
        put(_BYTES, _KINDS**2, owner[1:][same], (kind[:-1] * _KINDS + kind[1:])[same], share)
    blank = _BLANK[byte]
    new = np.ones(len(byte), bool)
    new[1:] = owner[1:] != owner[:-1]
    head = np.flatnonzero(~blank & (new | np.concatenate([[True], blank[:-1]]))) if len(byte) else np.zeros(0, np.int64)
    if len(head):
        stop = np.flatnonzero(blank | new)
        nxt = np.append(stop, len(byte))[np.searchsorted(stop, head, side="right")]
        words = np.bincount(owner[head], minlength=len(bag))
        each = 1 / np.maximum(words, 1)[:, None]
        put(_BYTES + _KINDS**2, _SIZES, owner[head], np.minimum(nxt - head, _SIZES) - 1, each)
        code = byte.astype(np.uint64) + np.uint64(1)
        hashed, live, at = np.zeros(len(head), np.uint64), np.arange(len(head)), head.copy()
        while len(live):  # whole words, a byte of each at a time
            h = (hashed[live] + code[at]) * np.uint64(0x9E3779B97F4A7C15)
            hashed[live] = h ^ (h >> np.uint64(29))
            more = at + 1 < nxt[live]
            live, at = live[more], at[more] + 1
        key = (owner[head].astype(np.uint64) << np.uint64(40)) ^ (hashed >> np.uint64(24))
        distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=len(bag))[: len(bag)]
        out[:, -2] = np.where(words > 0, 1 - distinct / np.maximum(words, 1), 0)
    out[:, -1] = np.log1p(size) / 8
    return out, bag


def encode_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passages of an Arrow array of texts; null counts as empty."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64, len(filled) + 1, filled.offset * 8)
    data = np.frombuffer(filled.buffers()[2], np.uint8) if filled.buffers()[2] is not None else np.zeros(0, np.uint8)
    return encode_passages(data, offsets[:-1], offsets[1:])


def encoded(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in parts of at most ``PART`` text bytes (or one row), each with its passages."""
    for part in (part for whole in batches for part in slices(whole, column, PART)):
        yield part, *encode_texts(part.column(column))


class GatedAttention:
    """Gated-attention pooling over passage embeddings, trained by Adam."""

    def __init__(self, seed: int = 7, hidden: int = 32, gate: int = 16):
        rng = np.random.default_rng(seed)
        shape = {"E": (WIDTH, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "b": ()}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 else rng.normal(0, 0.1, s) if k in "wc" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict:
        p = self.p
        size = np.expm1(8 * x[:, -1:])
        x = np.clip((x - self.mean) / self.scale * (size / (size + 64)), -8, 8)  # short passages lean to the mean
        x[:, -1] = 0
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        a = np.exp(s - top[bag])
        a /= np.bincount(bag, a, bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "y": y}

    def fit(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.01, decay: float = 1e-4) -> GatedAttention:
        """Full-batch training on the log loss, both labels weighted alike."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
        m = {k: np.zeros_like(q) for k, q in self.p.items()}
        r = {k: np.zeros_like(q) for k, q in self.p.items()}
        for t in range(1, rounds + 1):
            f, p = self.forward(x, bag, len(label)), self.p
            dy = weight * (f["y"] - label)
            dz = dy[:, None] * p["c"]
            along = (dz[bag] * f["h"]).sum(1)
            ds = f["a"] * (along - np.bincount(bag, f["a"] * along, len(label))[bag])
            dv, du = ds[:, None] * p["w"] * f["u"] * (1 - f["v"] ** 2), ds[:, None] * p["w"] * f["v"] * f["u"] * (1 - f["u"])
            dh = (f["a"][:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
            grad = {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ ds, "c": f["z"].T @ dy, "b": dy.sum()}
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k], r[k] = 0.9 * m[k] + 0.1 * g, 0.999 * r[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(r[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        return self.forward(x, bag, bags)["y"]


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> GatedAttention:
    """Fit on about ``per_class`` labelled documents of each label outside fold 1, or all when there are fewer.

    The sample is those whose hashed ids lie under the share wanted, so it is the same on
    every run.  Labels other than 0 and 1 are ignored; with no document of one
    of the labels the untrained network is returned.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    marks = marks.filter(fold(F.col("_id")) != 1).dropDuplicates(["_id"])
    counts = dict(marks.groupBy("label").count().collect())
    share = F.when(F.col("label") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    chosen = F.broadcast(marks.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30)))  # about 2 * per_class rows

    @tidy
    def run(batches):
        for batch, x, bag in encoded(batches):
            ends = np.searchsorted(bag, np.arange(batch.num_rows + 1)).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends * WIDTH, pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], names=["_id", "label", "x"])

    small_batches(docs.sparkSession)
    sample = rows.join(chosen, "_id").mapInArrow(run, "_id long, label int, x array<float>").toArrow().sort_by("_id")
    model = GatedAttention()
    label = sample.column("label").to_numpy().astype(np.float64)
    if len(set(label.tolist())) < 2:
        return model
    each = [np.asarray(v.values, np.float32).reshape(-1, WIDTH) for v in sample.column("x")]
    bag = np.repeat(np.arange(len(each)), [len(v) for v in each])
    return model.fit(np.concatenate(each).astype(np.float64), bag, label)


def score_quality(docs: DataFrame, model: GatedAttention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, from its whole text alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    @tidy
    def run(batches):
        for batch, x, bag in encoded(batches):
            score = model.scores(x, bag, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_quality(docs: DataFrame, model: GatedAttention, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose whole text scores ``least`` or more."""
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        for batch, x, bag in encoded(batches, at):
            yield batch.filter(pa.array(model.scores(x, bag, batch.num_rows) >= least))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as one passage without characters.
    Repeated rows get equal scores; an empty table gives an empty result;
    other columns are ignored.
    """
    model = fit_quality(docs, labels, per_class)
    return score_quality(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, learnt from ``labels``."""
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def in_fold(doc_id: int, parts: int = 3) -> int:
    """The fold of an id outside Spark, for tests."""
    return zlib.crc32(str(doc_id).encode()) % parts
