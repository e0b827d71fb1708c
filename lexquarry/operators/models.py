"""Plugged-in models: each is made by a factory once in a Python worker and fed small batches of an Arrow stream.

A factory is sent to the workers, the model never is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lexquarry.operators.retrieval import rerank
from lexquarry.operators.vectors import FLOATS

#: Texts, or pairs, that a model gets at once; characters of a text that a pair scorer sees.
BATCH, CUT = 32, 500
_MADE: dict[str, object] = {}


def once(name: str, factory: Callable[[], object]) -> object:
    """What ``factory`` makes, made once in this worker and kept under ``name`` for its later tasks."""
    if name not in _MADE:
        _MADE[name] = factory()
    return _MADE[name]


def embed_with(chunks: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], name: str = "embedder", text: str = "text", prefix: str = "", batch: int = BATCH) -> DataFrame:
    """``chunks`` with an ``embedding`` by the model that ``factory`` makes; it maps texts to a matrix.  A null text counts as empty."""

    @pandas_udf(FLOATS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from lexquarry.operators import models

        model = models.once(name, factory)
        for texts in parts:
            rows = [np.asarray(model(texts.iloc[a : a + batch].tolist()), np.float32) for a in range(0, len(texts), batch)]
            yield pd.Series([v for part in rows for v in part], dtype=object)

    return chunks.withColumn("embedding", run(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))


def rerank_with(
    fused: DataFrame, queries: DataFrame, factory: Callable[[], Callable[[list[str], list[str]], np.ndarray]] | None = None,
    k: int = 10, keep: int = 50, name: str = "pairs", key: str = "doc_key", cut: int = CUT, batch: int = BATCH,
) -> DataFrame:
    """A cascade: the built-in score (R14) keeps ``keep`` hits of a query, and the model of ``factory`` scores the pairs of query and text, cut at ``cut``; the ``k`` best by it, ties by key.

    Without a factory this is R14.  The built-in score stays beside it as ``first``.
    """
    few = rerank(fused, queries, k if factory is None else keep, key)
    if factory is None:
        return few

    @pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from lexquarry.operators import models

        model = models.once(name, factory)
        for asked, texts in parts:
            rows = [np.asarray(model(asked.iloc[a : a + batch].tolist(), texts.iloc[a : a + batch].tolist()), np.float64) for a in range(0, len(asked), batch)]
            yield pd.Series(np.concatenate(rows) if rows else np.zeros(0))

    pairs = few.drop("rank").withColumnRenamed("final", "first").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scored = pairs.withColumn("final", score(F.coalesce("query", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, cut)))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("query")
