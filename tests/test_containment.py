"""Containment joins against plain comparison, with short, odd and missing needles."""

import random

from lexquarry.operators import containment as N
from lexquarry.operators import retrieval as R


def test_matches_plain_comparison(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    say = lambda n: "".join(rng.choice("abcA é🙂.") for _ in range(n))
    rows = [(i, say(rng.randint(0, 60)), say(rng.randint(0, 20))) for i in range(120)] + [(500, None, "abc"), (501, "", None), (502, "x" * 30_000 + "needle in it", "t")]
    needles = [(n, say(rng.randint(1, 6))) for n in range(80)] + [(200, ""), (201, None), (202, "NEEDLE IN"), (203, "a"), (204, "zz"), (205, "🙂"), (206, rows[3][1][:100]), (206, rows[4][1][:100])]
    table = spark.createDataFrame(rows, "k long, text string, title string")
    path = f"file://{tmp_path}/grams"
    N.build_grams(table, "k", ("text", "title"), path)
    index = N.GramIndex.open(spark, path)
    got = N.containing(table, spark.createDataFrame(needles, "query_id long, needle string"), index, "k", ("text", "title"))
    want = {(q, k) for q, n in needles if n for k, *fields in rows if any(f is not None and n.lower() in f.lower() for f in fields)}
    assert {(r.query_id, r.k) for r in got.collect()} == want
    for block in (4096, 7):  # without an index, in one block of needles and in several
        monkeypatch.setattr(N, "BLOCK", block)
        plain = N.containing(table, spark.createDataFrame(needles, "query_id long, needle string"), None, "k", ("text", "title"))
        assert {(r.query_id, r.k) for r in plain.collect()} == want and plain.columns == ["k", "query_id", "text", "title"]
    assert N.containing(table, spark.createDataFrame([], "query_id long, needle string"), None, "k", ("text",)).collect() == []
    assert index.postings.count() == sum(r.n for r in index.counts.collect())


def test_only_the_first_rows_of_a_needle_are_kept(spark, monkeypatch):
    """300 queries share four needles that 500 rows hold: a task hands on k rows for a needle, not all pairs."""
    rows = spark.createDataFrame([(i % 400, "abcd" if i % 3 else "ab", None) for i in range(500)], "k long, text string, title string").repartition(3)
    needles = spark.createDataFrame([(q, ("ab", "AB", "bc", "zz")[q % 4]) for q in range(300)] + [(0, "d"), (7, None)], "query_id long, needle string")
    made = []
    plain = N.reduce

    def watched(of, parts):
        made.append(sum(p.count() for p in parts))
        return plain(of, parts)

    monkeypatch.setattr(N, "reduce", watched)
    got = N.containing(rows, needles, None, "k", ("text", "title"), 5).select("query_id", "k").distinct().collect()
    holds = lambda n: sorted({i % 400 for i in range(500) if n in ("abcd" if i % 3 else "ab")})[:5]
    want = {(q, i) for q in range(300) for i in holds(("ab", "ab", "bc", "zz")[q % 4])} | {(0, i) for i in holds("d")}
    assert {(r.query_id, r.k) for r in got} == want
    assert made and made[0] <= 3 * 3 * 5  # needles found, tasks, k


def test_queries_without_a_number_reach_the_sections_text(spark):
    sections = spark.createDataFrame([(1, "12", "Theft of goods", "A", 1990, "whoever takes"), (2, "13", "Fraud", "A", 1991, "theft of goods by fraud"), (3, "14", None, "B", 1992, None)], "section_id long, section_number string, title string, act string, year int, text string")
    queries = spark.createDataFrame([(1, "THEFT OF GOODS"), (2, "see section 13"), (3, "nothing like it"), (4, None)], "query_id long, text string")
    got = sorted((r.query_id, r.section_id, r["rank"], round(r.score, 2)) for r in R.graph_hits(queries, sections).collect())
    assert got == [(1, 1, 1, 0.9), (1, 2, 2, 0.88), (2, 2, 1, 0.9)]


def test_near_copies_are_fused(spark):
    hits = spark.createDataFrame([(1, "a", "keyword", 1, 2.0, 0.5, "Same  text"), (1, "b", "vector", 2, 1.0, 0.5, "same text"), (1, "c", "vector", 1, 1.0, 0.5, "other"), (1, "d", "kg", 3, 1.0, 0.5, "")], "query_id long, doc_key string, retriever string, rank int, score double, weight double, text string")
    got = {r.doc_key: (round(r.rrf, 6), r.matched_sources) for r in R.fuse(hits, near_copies=True).collect()}
    assert got == {"a": (round(0.5 / 61 + 0.5 / 62, 6), ["keyword", "vector"]), "c": (round(0.5 / 61, 6), ["vector"]), "d": (round(0.5 / 63, 6), ["kg"])}
