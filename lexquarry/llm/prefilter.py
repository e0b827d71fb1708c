"""Which rows may have an id of a set: a bitmap of hashed ids, of bounded size.

Whole texts that surely aren't concerned stay out of a shuffle.  A bit may be
set by another id, so what passes is joined exactly; the bound costs nothing but
how many rows pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 2048 rows of 4 KB, 8 MB broadcast at most.
BITS = 1 << 26


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A map of ``bits`` bits, a power of two, with the bits of all keys (one column of longs) set; the driver gets its bytes and no more."""
    at = keys.select((F.pmod(F.col(keys.columns[0]), F.lit(bits)) + 1).alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for n, b in rows:
        out[(n - 1) * len(b) : n * len(b)] = np.frombuffer(b, np.uint8)
    return out


def found(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit) may be in a map of :func:`bitmap`."""
    at = (keys & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def split_by_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` whose key may be among ``ids``, rows whose key surely isn't); null keys never are."""
    bit = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bucket, bits, may = (fresh(docs, n) for n in ("_bucket", "_bits", "_may"))
    place = ids.select(bit.alias("bit"))
    bitmap = place.groupBy(F.bitmap_bucket_number("bit").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(bits))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1
    marked = docs.withColumn(bucket, F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), bucket, "left")
    marked = marked.withColumn(may, F.col(key).isNotNull() & F.coalesce(on, F.lit(False)))
    return marked.filter(F.col(may)).select(docs.columns), marked.filter(~F.col(may)).select(docs.columns)


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is among ``ids``; only rows that may be among them are shuffled."""
    may, stays = split_by_ids(docs, ids, key)
    return stays.unionByName(may.join(ids.select(key).hint("shuffle_hash"), key, "left_anti").select(docs.columns))
