"""Queries over the application tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T


def cases_of(cases: DataFrame, user: int | None = None, k: int | None = None) -> DataFrame:
    """Q01, Q02: cases of a user, newest first."""
    rows = cases if user is None else cases.filter(F.col("user_id") == user)
    rows = rows.orderBy(F.desc("created_at"), "case_id")
    return rows if k is None else rows.limit(k)


def newest_per(rows: DataFrame, partition: str, k: int = 1, at: str = "created_at", tie: str = "case_id") -> DataFrame:
    """Q01 for every user at once, Q04: the ``k`` latest rows of each partition."""
    order = Window.partitionBy(partition).orderBy(F.desc(at), tie)
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def documents_of(docs: DataFrame, cases: DataFrame, user: int | None = None) -> DataFrame:
    """Q03: documents with the cases they belong to."""
    rows = docs.join(cases.select("case_id", "user_id", "title"), "case_id")
    return rows if user is None else rows.filter(F.col("user_id") == user)


def section_pivot(sections: DataFrame, titles: tuple[str, ...]) -> DataFrame:
    """Q05: one column for each wanted title."""
    return sections.groupBy("case_id").pivot("title", list(titles)).agg(F.first("content"))


def backfilled(value: Column, live: Column) -> Column:
    """Q06: a stored value, or the live one when it is missing or the sentinel."""
    return F.coalesce(T.missing_to_null(value), live)


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Q07: rows with the non-null changes of their key."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    joined = rows.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns])


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Q08: rows whose key is not deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def upserted(existing: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest new row of each key replaces the existing one."""
    last = Window.partitionBy(key).orderBy(F.desc(at))
    newest = new.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    return existing.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def search_cases(cases: DataFrame, text: str, category: str | None = None) -> DataFrame:
    """Q10: a substring of title, type, description (where there is one) or id, and a category."""
    described = F.coalesce(F.lower("description").contains(text.lower()), F.lit(False)) if "description" in cases.columns else F.lit(False)
    hit = described | F.lower("title").contains(text.lower()) | F.lower("case_type").contains(text.lower()) | F.col("case_id").cast("string").contains(text)
    return cases.filter(hit if category is None else hit & (F.lower("case_type") == category.lower()))


def to_analyse(cases: DataFrame, analyses: DataFrame) -> DataFrame:
    """Q13: cases without an analysis."""
    return cases.join(analyses.select("case_id"), "case_id", "left_anti")
