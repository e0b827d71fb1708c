"""BPE encoding through a minimal acyclic transducer of frequent words.

Spark counts the words of the corpus; the most frequent become a deterministic
automaton whose equal suffixes are shared.  Each edge carries the number of
lexicon words that come before it, so a walk yields a word's rank, and the rank
its ids: the automaton maps words to ids without storing the words.  It is
compiled once, sent to the executors as a file and memory-mapped there.  Words
outside it are merged exactly by the tokenizers library.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm.wordbpe import ChunkIds, chunks, flattened, load, merged, per_worker, ranges, slices, small_batches, split_words
from lexquarry.plans.storage import written

#: A transducer file: a header of section lengths, then these arrays in order.
SECTIONS = (("keys", "<i8"), ("targets", "<i4"), ("skips", "<i4"), ("final", "u1"), ("starts", "<i4"), ("ids", "<i4"))


def compile_words(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal automaton of sorted distinct ``words`` with their ids, as bytes.

    Words come in byte order, so all states off the path of the latest word are
    final; each is replaced by an equal one that is registered already.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (final, ((byte, target), ...)), by number

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states: [final, edges]
    letters: list[int] = []
    for word in words:
        shared = next((i for i, (a, b) in enumerate(zip(letters, word)) if a != b), min(len(letters), len(word)))
        while len(path) > shared + 1:
            done = settle(path.pop())
            path[-1][1].append((letters.pop(), done))
        for byte in word[shared:]:
            path.append([False, []])
            letters.append(byte)
        path[-1][0] = True
    while letters:
        done = settle(path.pop())
        path[-1][1].append((letters.pop(), done))
    root = settle(path[0])
    behind = [0] * len(states)  # words that can be completed from a state; targets precede sources
    keys, targets, skips = [], [], []
    for number, (final, edges) in enumerate(states):
        before = int(final)
        for byte, target in edges:
            keys.append((number if number != root else -1) + 1 << 8 | byte)
            targets.append((target if target != root else -1) + 1)
            skips.append(before)
            before += behind[target]
        behind[number] = before
    finals = np.zeros(len(states) + 1, "u1")
    for number, (final, _) in enumerate(states):
        finals[(number if number != root else -1) + 1] = final
    order = np.argsort(np.array(keys, "<i8"), kind="stable")
    arrays = (
        np.array(keys, "<i8")[order],
        np.array(targets, "<i4")[order],
        np.array(skips, "<i4")[order],
        finals,
        np.cumsum([0, *map(len, ids)]).astype("<i4"),
        np.array(list(itertools.chain.from_iterable(ids)), "<i4"),
    )
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


class Transducer:
    """A memory-mapped automaton; state 0 is the root."""

    def __init__(self, path: str):
        size, at = np.fromfile(path, "<i8", len(SECTIONS)), 8 * len(SECTIONS)
        for (name, kind), n in zip(SECTIONS, size.tolist(), strict=True):
            mapped = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.zeros(0, kind)
            setattr(self, name, mapped)
            at += n * np.dtype(kind).itemsize

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those outside the lexicon; all words walk at once."""
        state = np.zeros(len(words), np.int64)
        rank = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words], np.int64)
        joined = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        rank[size == 0] = -1
        step = 0
        while len(live):
            key = state[live] << 8 | joined[start[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            found = self.keys[at] == key if len(self.keys) else np.zeros(len(live), bool)
            rank[live[~found]] = -1
            live, at = live[found], at[found]
            state[live] = self.targets[at]
            rank[live] += self.skips[at]
            step += 1
            ended = size[live] == step
            last = live[ended]
            rank[last[self.final[state[last]] == 0]] = -1
            live = live[~ended]
        return rank

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()

    def ids_of_all(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these words in one array, each word's number of ids)."""
        sizes = (self.starts[ranks + 1] - self.starts[ranks]).astype(np.int64)
        return self.ids[ranges(self.starts[ranks], sizes)], sizes


class Spelling:
    """What each id is written as, every one followed by a blank."""

    def __init__(self, written: list[str]):
        parts = [f"{w} ".encode() for w in written]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def of(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The written ids of each text, joined by blanks."""
        each = self.sizes[ids]
        flat = self.data[ranges(self.starts[ids], each)].tobytes()
        at = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [flat[a : max(a, b - 1)] for a, b in zip(at, at[1:])]


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the plain texts of all rows; counted per task before the shuffle."""

    def words_of(seen: Counter) -> pa.RecordBatch:
        words: Counter = Counter()
        for chunk, n in seen.items():
            if chunk.isalpha():
                words[chunk.decode()] += n
                continue
            for word in split_words(chunk.decode()) or ():
                words[word] += n
        return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    def count(batches):
        seen: Counter = Counter()
        for batch in (part for whole in batches for part in slices(whole)):
            for text in batch.column(1).to_pylist():
                seen.update(chunks(text))
            if len(seen) > 300_000:
                yield words_of(seen)
                seen.clear()
        yield words_of(seen)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(rows: DataFrame, path: str | None = None, max_words: int = 1 << 16) -> str:
    """Compile the most frequent words, ``max_words`` at most, and send the file to all executors.

    Counts are put in some 900 logarithmic classes first; the words of the highest classes that fit
    are read, so no task sends the driver more than the lexicon.  The bound is the lexicon's size by
    design; every other word is merged exactly, so it never changes a result.  Returns the file's name there.
    """
    spark = rows.sparkSession
    counts = written(word_counts(rows).withColumn("class", F.floor(16 * F.log2("n")).cast("int")), "words")
    left, least = max_words, 1 << 30
    for level, n in sorted(counts.groupBy("class").count().collect(), reverse=True):
        if n > left:
            break
        left, least = left - n, level
    top = counts.filter(F.col("class") >= least).select("word").collect()
    words = sorted(r[0].encode() for r in top)
    data = compile_words(words, merged(load(path), [w.decode() for w in words]))
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}-{uuid.uuid4().hex[:8]}.bin"  # a session takes each name once
    local = os.path.join(tempfile.mkdtemp(prefix="spark-lexicon-"), name)
    with open(local, "wb") as out:
        out.write(data)
    spark.sparkContext.addFile(local)  # the driver serves it to every executor, new ones too
    return name


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row; with ``keep_ids`` also ids and decoded.

    Null text counts as empty: no ids, and the digests of no bytes.  Repeated
    rows give repeated results; an empty table an empty one; other columns are
    ignored.  Decoding joins the ids' tokens by spaces, as the library does
    for a vocabulary without a decoder.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    name = build_lexicon(rows, path)
    kept = ", ids array<int>, decoded string" if keep_ids else ""

    def run(batches):
        tokenizer = per_worker(("tokenizer", path), lambda: load(path))
        vocabulary = range(tokenizer.get_vocab_size())
        digits = per_worker(("digits", path), lambda: Spelling([str(i) for i in vocabulary]))
        tokens = per_worker(("tokens", path), lambda: Spelling([tokenizer.id_to_token(i) or "" for i in vocabulary]))
        lexicon = Transducer(SparkFiles.get(name))

        def merge(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ranks = lexicon.ranks([w.encode() for w in words])
            known = ranks >= 0
            sizes = np.zeros(len(words), np.int64)
            ids, sizes[known] = lexicon.ids_of_all(ranks[known])
            rest, sizes[~known] = flattened(merged(tokenizer, [w for w, k in zip(words, known.tolist(), strict=True) if not k]))
            out, starts = np.zeros(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
            out[ranges(starts[known], sizes[known])] = ids
            out[ranges(starts[~known], sizes[~known])] = rest
            return out, sizes

        cache = per_worker(("lexicon ids", path, name.rpartition("-")[0]), lambda: ChunkIds(merge))
        for batch in (part for whole in batches for part in slices(whole, most=1_000_000)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, sizes, odd = cache.of([chunks(t) for t in texts])
            lists, decoded, counts = digits.of(ids, sizes), tokens.of(ids, sizes), sizes.tolist()
            for n in np.flatnonzero(odd).tolist():
                found = tokenizer.encode(texts[n], add_special_tokens=False).ids
                lists[n], counts[n] = " ".join(map(str, found)).encode(), len(found)
                decoded[n] = tokenizer.decode(found, skip_special_tokens=False).encode()
            out = []
            for n, own, back in zip(counts, lists, decoded, strict=True):
                row = [n, hashlib.sha256(own).hexdigest(), hashlib.sha256(back).hexdigest()]
                out.append([*row, [int(x) for x in own.split()], back.decode()] if keep_ids else row)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())[: 5 if keep_ids else 3]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, encoded and decoded."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
