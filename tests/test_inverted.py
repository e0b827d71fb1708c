"""The stored index: blocks, pruning against full scoring, and what a search reads."""

import random

import pytest

from lexquarry.operators import inverted as I
from lexquarry.operators import lexical as L


def corpus(seed=4, n=600):
    rng = random.Random(seed)
    common, rare = [f"co{i}" for i in range(12)], [f"ra{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randint(1, 60)))) for i in range(n)]
    rows[7] = (7, "ra1 ra2 ra3 " * 5)
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, rows[3][1])]


QUERIES = [(0, "ra1 ra2 ra3"), (1, "co1 co2 co3 co4"), (2, "co1 ra5 ra5 co2"), (3, "unknown words"), (4, ""), (5, None), (6, "ra9")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/one"
    I.build_index(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3), path)
    return I.open_index(spark, path)


def test_blocks_fall_and_hold_every_posting(index):
    rows = index.blocks.collect()
    assert all(1 <= r.n <= I.BLOCK and r.n == len(r["keys"]) == len(r.impacts) and r.impacts == sorted(r.impacts, reverse=True) and r.top == r.impacts[0] for r in rows)
    assert sum(r.term == "co1" for r in rows) > 2
    got = sorted((r.term, k) for r in rows for k in r["keys"])
    assert got == sorted({(w, i) for i, t in corpus() for w in (t or "").split()})
    assert index.documents == len(corpus())


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_pruning_changes_nothing(spark, index, k):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    want = sorted(map(tuple, L.bm25(docs, queries, k).select("query_id", "doc_id", "score", "rank").collect()))
    assert sorted(map(tuple, I.search(index, queries, k).collect())) == want
    assert {r[0] for r in want} == {0, 1, 2, 6}


def test_several_blocks_of_queries(spark, index, monkeypatch):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    want = sorted(map(tuple, I.search(index, queries).collect()))
    monkeypatch.setattr(I, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, I.search(index, queries).collect())) == want


def test_a_search_reads_few_postings(spark, index):
    share = {r.query_id: r for r in I.read_share(index, spark.createDataFrame([(0, "ra1 co1 co2 co3")], "query_id long, text string"), 1).collect()}
    assert share[0].n_read < share[0].postings / 5 and share[0].n_scored < share[0].postings / 5


def test_an_index_of_nothing(spark):
    empty = I.build_index(spark.createDataFrame([], "doc_id long, text string"))
    assert I.search(empty, spark.createDataFrame(QUERIES, "query_id long, text string")).collect() == []
