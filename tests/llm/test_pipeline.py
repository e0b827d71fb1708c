"""The pipeline's stages on small documents, and its registration."""

import os
import re

import pytest

import __spark_entry__
import corpus_pipeline
from lexquarry.plans.storage import written
from lexquarry.llm.secrets import BASE_RULES
from tests.llm.fixtures import documents, frame, grouped, shingles, squeezed

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, DATA), "test")
        assert docs.columns == columns
        kept.append(docs)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = {r.doc_id for r in kept[1].collect()}
    marked = [(i, i in good) for i in {r.doc_id for r in kept[0].collect()} & quality.keys()]
    assert sum(quality[i] == int(k) for i, k in marked) / len(marked) > 0.95
    texts = [squeezed(r.text) for r in kept[2].collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {squeezed(r.text) for r in kept[1].collect()}
    assert kept[3].count() <= kept[2].count() == len(texts)
    assert kept[4].count() == kept[3].count()
    packed = corpus_pipeline.STAGES[4][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == kept[4].count()


def test_stages_against_brute_force(spark):
    rows, (_, dedup, near, secrets, packing) = documents(), [f for _, f in corpus_pipeline.STAGES]
    docs = frame(spark)  # nulls, empty and long texts, ties, repeated rows and columns with clashing names
    texts = {i: t for i, t in rows if i is not None}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)
    first = {}
    for i in sorted(texts):
        first.setdefault(squeezed(texts[i]), i)
    out = dedup(spark, docs, DATA)
    assert out.columns == docs.columns and ids(out) == sorted(i for i in texts if first[squeezed(texts[i])] == i)  # one row of repeated ones
    assert out.count() == len(ids(out))  # rows without an id are copies here, null and empty texts alike
    sets = {i: shingles(t, 5) for i, t in texts.items()}
    of = grouped(sorted(sets), lambda a, b: bool(sets[a] & sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    out = near(spark, docs, DATA)
    assert out.columns == docs.columns and ids(out) == sorted(i for i, _ in rows if i is not None and of[i] == i)
    assert [r.text for r in out.filter("doc_id is null").collect()] == [None]  # the other one is a near copy

    def masked(text):
        spans = sorted((m.start(), m.end()) for r in BASE_RULES for m in re.finditer(r.pattern, text, re.ASCII | (re.IGNORECASE if r.any_case else 0)) if len(m.group(r.group)) >= r.least)
        done, parts = 0, []
        for a, b in spans:
            if a >= done:
                parts += [text[done:a], "[secret]"]
            done = max(done, b)
        return "".join(parts) + text[done:]

    out = secrets(spark, docs, DATA)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(i, t if t is None else masked(t)) for i, t in rows}
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert packing(spark, docs, DATA).select("doc_id").distinct().count() == len(texts) + 1


def test_copies_without_ids_go(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (5, " ".join(words)), (None, "of  its own"), (None, "of its own"), (None, " ".join([*words, "more"])), (7, "same x"), (7, "same  x"), (7, "other")]
    _, dedup, near, *_ = [f for _, f in corpus_pipeline.STAGES]
    docs = frame(spark, rows)
    once = written(dedup(spark, docs, DATA), "test")
    got = sorted(((r.doc_id, squeezed(r.text)) for r in once.collect()), key=repr)
    assert got == sorted([(5, " ".join(words)), (7, "other"), (7, "same x"), (None, "of its own"), (None, " ".join([*words, "more"]))], key=repr) and once.columns == docs.columns
    last = near(spark, once, DATA)
    assert sorted((str(r.doc_id) for r in last.collect())) == ["5", "7", "7", "None"] and last.columns == docs.columns


def test_stages_on_an_empty_table(spark):
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame(spark, []), DATA)
        assert out.count() == 0 and (n == 4 or out.columns == frame(spark, []).columns)


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
