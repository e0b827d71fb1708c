"""Per-word view of the 49k word-BPE tokenizer, for use inside tasks.

That tokenizer normalises (NFC, white space, lower case), splits a text into
words by a pattern and merges within each word only, so a word's ids never
depend on its neighbours.  Texts of plain characters are split here and looked
up chunk by chunk; a text holding any other character, or the start of a special
token's string, goes whole through the tokenizers library.
"""

from __future__ import annotations

import ctypes
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

VOCABULARY = "word_bpe_49k.json"

#: Characters that the library's normaliser only lower-cases: no composition,
#: no white space beyond ASCII, no letter whose lower case is two characters.
_PLAIN = [chr(c) for c in range(0x21, 0x7F)] + [chr(c) for c in range(0xA1, 0x250) if c not in (0xAD, 0x130)]
_LETTERS = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == "N")
_ODD = re.compile("[^" + "".join(map(re.escape, _PLAIN)) + r"\t-\r ]|<\|")
#: The vocabulary's own word pattern (a fixed value) over those characters.
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r {_LETTERS}{_NUMBERS}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str | None = None):
    """The library's tokenizer, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or vocabulary_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def chunks(text: str | None) -> list[bytes]:
    """The lower-cased text between runs of ASCII white space; words never cross these."""
    return (text or "").lower().encode().split()


def split_words(chunk: str) -> list[str] | None:
    """The words of a plain chunk, or None when only the library may split its text."""
    return None if _ODD.search(chunk) else _WORD.findall(chunk)


_POINTS = frozenset(b".,;:!?)\"")


def parted(chunk: bytes) -> list[str] | None:
    """:func:`split_words` of a chunk's bytes; ASCII letters alone, or with one point behind them, need no pattern."""
    if chunk.isalpha():
        return [chunk.decode()]
    if chunk[-1] in _POINTS and chunk[:-1].isalpha():
        return [chunk[:-1].decode(), chr(chunk[-1])]
    return split_words(chunk.decode())


#: How byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on.
_PRINTED = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
_WRITTEN = {b: b for b in _PRINTED} | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def merged(tokenizer, words: list[str]) -> list[list[int]]:
    """Ids of single words, merged exactly by the library's model; ASCII letters and digits are written as themselves."""
    merge = tokenizer.model.tokenize
    return [[t.id for t in merge(w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(_WRITTEN))] for w in words]


_KEPT: dict = {}


def per_worker(key: object, make: Callable[[], object]):
    """What ``make`` returns, made once in each Python worker and kept for its later tasks."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Drop what :func:`per_worker` keeps, and hand freed memory back to the machine; otherwise a reused worker holds it through all later steps."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a step that keeps nothing in its worker: a task begins without what other steps kept, and leaves nothing behind."""

    def whole(batches):
        give_back()
        yield from run(batches)
        give_back()

    return whole


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every range, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values in one array, the size of each list)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class Generation:
    """Numbered chunks and their ids in flat arrays; a size of -1 marks a chunk that isn't plain."""

    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.starts = self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        held = np.maximum(sizes, 0)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(held) - held])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])


class ChunkIds:
    """Ids of chunks, kept from batch to batch; serves all tasks of a worker.

    ``merge(words)`` gives (ids of all words in one array, each word's number of
    ids).  When a generation has ``bound`` chunks a new one begins, which takes
    what it needs from the last; so frequent chunks stay, memory is flat, and no
    result depends on the bound.
    """

    def __init__(self, merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bound: int = 200_000):
        self.merge, self.bound, self.now, self.last = merge, bound, Generation(), Generation()

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts in one array, each text's number of ids, which texts the library must encode whole)."""
        if len(self.now.numbers) > self.bound:
            self.now, self.last = Generation(), self.now
        now, known = self.now, len(self.now.numbers)
        words = np.fromiter(map(len, texts), np.int64, len(texts))
        number = np.fromiter(map(now.numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(words.sum()))
        if len(now.numbers) > known:
            self.learn(list(islice(now.numbers, known, None)))
        owner = np.repeat(np.arange(len(texts)), words)
        size = now.sizes[number]
        odd = np.bincount(owner, size < 0, len(texts)) > 0
        size[odd[owner]] = 0
        ids = now.flat[ranges(now.starts[number], size)]
        return ids, np.bincount(owner, size, len(texts)).astype(np.int64), odd

    def learn(self, new: list[bytes]) -> None:
        """Add chunks to the present generation, from the last one where it has them."""
        last, size = self.last, np.zeros(len(new), np.int64)
        before = np.fromiter((last.numbers.get(c, -1) for c in new), np.int64, len(new))
        old, rest = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
        before = before[old]
        size[old] = last.sizes[before]
        split = [parted(c) for c in map(new.__getitem__, rest.tolist())]
        number: defaultdict[str, int] = defaultdict()
        number.default_factory = number.__len__
        plain = [w or [] for w in split]
        words = np.fromiter(map(len, plain), np.int64, len(plain))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(plain)), np.int64, int(words.sum()))
        ids, sizes = self.merge(list(number))
        ids = ids[ranges((np.cumsum(sizes) - sizes)[at], sizes[at])]
        made = np.bincount(np.repeat(np.arange(len(plain)), words), sizes[at], len(plain)).astype(np.int64)
        size[rest] = made
        starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        flat = np.zeros(int(np.maximum(size, 0).sum()), np.int32)
        flat[ranges(starts[rest], made)] = ids
        held = np.maximum(size[old], 0)
        flat[ranges(starts[old], held)] = last.flat[ranges(last.starts[before], held)]
        size[rest[[w is None for w in split]]] = -1
        self.now.add(flat, size)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small where the session has Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most`` text bytes each (or one row)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
