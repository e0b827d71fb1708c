"""Retrieval, matching and calibration metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The weights of the four parts of a legal analysis.
BUCKETS = 4096
IRAC = {"issue": 0.15, "rule": 0.30, "application": 0.40, "conclusion": 0.15}


def recall_precision(retrieved: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Recall and precision at ``k`` of every query; 0 where nothing is relevant, ``k`` always the divisor of precision."""
    top = retrieved.filter(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    hits = top.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    every = retrieved.select("query_id").unionByName(relevant.select("query_id")).distinct()
    rows = every.join(hits, "query_id", "left").join(wanted, "query_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return rows.select("query_id", F.round(F.coalesce(F.try_divide(h, F.col("wanted")), F.lit(0.0)), 6).alias("recall"), F.round(h / k, 6).alias("precision"))


def reciprocal_rank(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """One over the first relevant rank, 0 with none."""
    first = retrieved.join(relevant, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    return retrieved.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def ndcg(retrieved: DataFrame, graded: DataFrame, k: int = 10) -> DataFrame:
    """The discounted gain of the first ``k`` over the best possible; ``graded`` is (query_id, doc_id, gain)."""
    gain = lambda rank: F.col("gain") / F.log2(rank + 1)
    got = retrieved.filter(F.col("rank") <= k).join(graded, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("got"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id"))
    best = graded.withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.sum(gain(F.col("place"))).alias("best"))
    rows = retrieved.select("query_id").distinct().join(got, "query_id", "left").join(best, "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce(F.try_divide(F.col("got"), F.col("best")), F.lit(0.0)), 6).alias("ndcg"))


def key_f1(predicted: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and F1 over distinct keys."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys).distinct().withColumn("t", F.lit(1))
    n = p.join(t, list(keys), "full_outer").agg(F.count("p").alias("p"), F.count("t").alias("t"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("both"))
    share = lambda d: F.coalesce(F.try_divide(F.col("both"), F.col(d)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * share("p") * share("t"), share("p") + share("t")), F.lit(0.0))
    return n.select(F.round(share("p"), 6).alias("precision"), F.round(share("t"), 6).alias("recall"), F.round(f1, 6).alias("f1"))


def contradiction_key(kind: Column, a: Column, b: Column) -> Column:
    """The type and the first 50 characters of both statements."""
    return F.concat_ws("::", kind, F.substring(a, 1, 50), F.substring(b, 1, 50))


def routing_accuracy(pairs: DataFrame) -> DataFrame:
    """The share of predictions equal to the truth of the same id."""
    return pairs.agg(F.round(F.avg((F.col("predicted").eqNullSafe(F.col("truth"))).cast("double")), 6).alias("accuracy"))


def irac_component(text: Column) -> Column:
    """.6 for something said, .1 each for more than 100 and more than 300 characters, a word of law and a word of conclusion, 1 at most."""
    said, low = T_said(text), F.lower(text)
    bonus = [F.length(text) > 100, F.length(text) > 300, low.rlike("section|act|provision|code"), low.rlike("therefore|conclusion|held")]
    return F.when(said, F.least(F.lit(1.0), F.lit(0.6) + sum((F.when(b, 0.1).otherwise(0.0) for b in bonus), F.lit(0.0)))).otherwise(0.0)


def T_said(text: Column) -> Column:
    """Whether a component says anything."""
    return F.coalesce(~text.isin("", "N/A"), F.lit(False))


def irac(analyses: DataFrame, weights: dict[str, float] = IRAC) -> DataFrame:
    """(analysis_id, each component's score, total)."""
    parts = {c: irac_component(F.col(c)) for c in weights}
    total = sum((parts[c] * w for c, w in weights.items()), F.lit(0.0))
    return analyses.select("analysis_id", *[F.round(v, 6).alias(c) for c, v in parts.items()], F.round(total, 6).alias("total"))


def irac_means(analyses: DataFrame, weights: dict[str, float] = IRAC) -> DataFrame:
    """(component, mean): the mean of every component and of the total over all analyses."""
    scores = irac(analyses, weights)
    names = [*weights, "total"]
    means = scores.agg(*[F.avg(n).alias(n) for n in names])
    return means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.round(n, 6).alias("mean")) for n in names])).alias("m")).select("m.*")


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-count bins cut at int(i * n / bins); ``pairs`` is (id, confidence, accuracy).

    Ranks come from counts of rows per confidence, so one value held by very many rows costs one group.
    """
    n = pairs.count()
    steps = pairs.groupBy("confidence").agg(F.count(F.lit(1)).alias("rows"), F.sum("accuracy").alias("right"))
    # A confidence's rank: the rows of lower buckets (BUCKETS sums at most), then the running count in its own bucket.
    steps = steps.withColumn("bucket", F.floor(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * BUCKETS))
    before = lambda order: order.rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("bucket").agg(F.sum("rows").alias("in_bucket"))
    below = sums.select("bucket", F.coalesce(F.sum("in_bucket").over(before(Window.orderBy("bucket"))), F.lit(0)).alias("below"))
    within = F.coalesce(F.sum("rows").over(before(Window.partitionBy("bucket").orderBy("confidence"))), F.lit(0))
    placed = steps.withColumn("within", within).join(below, "bucket").withColumn("first", F.col("below") + F.col("within"))
    edges = [i * n // bins for i in range(bins + 1)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])).alias("e")
    inside = F.least(F.col("first") + F.col("rows"), F.col("e.b")) - F.greatest("first", F.col("e.a"))
    parts = placed.select("*", each).withColumn("inside", inside).filter("inside > 0")
    of = parts.groupBy("e.bin").agg(F.sum("inside").alias("k"), F.sum(F.col("inside") * F.col("confidence")).alias("c"), F.sum(F.col("inside") * F.col("right") / F.col("rows")).alias("r"))
    return of.select("bin", F.col("k").alias("n"), F.round(F.col("c") / F.col("k"), 6).alias("confidence"), F.round(F.col("r") / F.col("k"), 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("r")) / F.lit(max(n, 1)), 9).alias("error"))


def metric_bundle(**frames: DataFrame) -> DataFrame:
    """(metric, value): the mean of every numeric column but ids, for the frames that there are."""
    rows = None
    for name, frame in frames.items():
        for column, kind in frame.dtypes:
            if kind in ("double", "float") and not column.endswith("_id"):
                one = frame.agg(F.round(F.avg(column), 6).alias("value")).select(F.lit(f"{name}.{column}").alias("metric"), "value")
                rows = one if rows is None else rows.unionByName(one)
    return rows


def overall(metrics: DataFrame) -> DataFrame:
    """The mean of the metrics that there are, errors turned so that more is better."""
    good = F.when(F.col("metric").contains("error"), 1 - F.col("value")).otherwise(F.col("value"))
    return metrics.agg(F.round(F.avg(good), 6).alias("overall"))
