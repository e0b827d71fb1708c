"""Terms made from bytes are those of the text columns."""

from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators import inverted as I

TEXTS = [
    "The IPC/1860 no 42 a, THE the end x-y 9/9 007", "KKelvin İIİ straße ΑΣ ﬁne ÅngstrÅm ٣٣ 12٣12",
    "a\tb\x0bc\fd\re\n ff\x1cgg\x85hh", "  -- // - / 1 22 2b ", "\U0001f600x\U0001f600 éé áb", " ", "", None,
]


def test_terms_from_bytes_are_those_of_the_columns(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    want = docs.select("doc_id", T.raw_length(F.col("text")).alias("raw"), T.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()
    counted = I.counted_terms(docs, "doc_id")
    got = {r.key: (r.raw, r.length, dict(zip(r.terms, r["counts"], strict=True))) for r in counted.collect()}
    assert got == {r.doc_id: (r.raw, len(r.t), {w: r.t.count(w) for w in r.t}) for r in want}
    assert "regexp_replace" not in counted._jdf.queryExecution().executedPlan().toString()
