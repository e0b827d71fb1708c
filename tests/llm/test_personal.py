"""Personal data: base rules against Python's regular expressions, boosted trees, calibration, added spans and redaction."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm.personal import BASE_KINDS, KINDS, SAMPLE, Detector, Trees, fit_detector, find_personal, isotonic, proposals, redact_personal, scan, span_digest
from tests.llm.fixtures import documents, frame

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def plain(text):
    out = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(3)
    out = [t for _, t in documents()] + [
        "a@b.c_d@e.f", "a@b", "a@b..c x@y.z.", "é.x@mail.example.com", "@@a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 999.1.2.3.4 1.2.3",
        "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111", "+1 (212) 555-0199 +49 30 901820 +1 2 +12345678901234567890 +5 ((((", "0 0 0 0 0 0 0 0 0 0 0 0 0",
        "🙂 me@site.org 🙂 10.0.0.1", "1 " * 5000, "9" * 4000, ("call 2001-02-03 or " * 900) + "x@y.zz", "w" * 20_000 + "@" + "a." * 3000 + "b", "mail: " + "ab.cd@" * 400,
        "4111111111111111 -4111111111111111", "5 4111111111111111", "5-4111111111111111 6",
    ]
    bits = ["@", ".", "-", "+", " ", "(", ")", "1", "22", "333", "4111111111111111", "a", "b.c", "é", "\n", "mail", "_", "+1 212 555 0199", "10.0.0.1"]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_base_spans_match_the_plain_rules(spark):
    rows = [(None if n % 50 == 7 else n, t) for n, t in enumerate(texts())]
    got, _ = find_personal(frame(spark, [*rows, rows[5]]))
    got = sorted(((r.doc_id, tuple(map(tuple, r.base)), r) for r in span_digest(got).join(got.select("doc_id", "base"), "doc_id").collect()), key=lambda r: r[0])
    want = {i: plain(t) for i, t in rows if i is not None}
    for i, base, r in got:
        assert list(base) == want[i]
        joined = ",".join(f"{BASE_KINDS[k]}:{s}:{e}" for s, k, e in want[i])
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(x[1] == n for x in want[i]) for n in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(","))
    assert {i for i, *_ in got} == set(want) and len(got) >= len(want)


def test_rows_without_an_id_and_empty_tables(spark):
    got = span_digest(find_personal(frame(spark, [(None, "a@b.cc"), (None, None), (3, None)]))[0]).collect()
    assert sorted(r.spans for r in got) == ["", "", "email:0:6"]
    assert span_digest(find_personal(frame(spark, []))[0]).collect() == []


def test_scan_walks_long_arrays(spark):
    row = spark.range(1).select(F.sequence(F.lit(1), F.lit(2000)).alias("a"), F.array().cast("array<int>").alias("none"))
    step = lambda s, x: (s + x, s + x)
    sums, none = row.select(scan(F.col("a"), F.lit(0).cast("long"), step, "bigint"), scan(F.col("none"), F.lit(0).cast("long"), step, "bigint")).first()
    assert sums == np.cumsum(np.arange(1, 2001)).tolist() and none == []


def test_trees_learn_and_say_the_same_in_sql(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (3000, 4))
    y = ((x[:, 0] > 3) ^ (x[:, 2] <= 1)).astype(float)
    trees = Trees().fit(x[:2000], y[:2000], np.ones(2000))
    score = trees.scores(x)
    assert ((score[2000:] > 0) == y[2000:]).mean() > 0.97
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x[:50])], "n int, f array<int>")
    assert [r.s for r in rows.selectExpr("n", f"{trees.sql('f')} AS s").orderBy("n").collect()] == pytest.approx(score[:50].tolist())


def test_isotonic():
    fit = isotonic(np.array([0, 1, 0, 1, 1.0]), np.array([1, 1, 3, 1, 1.0]))
    assert fit.tolist() == [0, 0.25, 0.25, 1, 1]


def test_proposals_mark_what_touches_a_base_span(spark):
    got = proposals(frame(spark, [(1, "call +1 (212) 555-0199 or 212 555 0199 now"), (2, "me@site.org me@localhost"), (3, "pay DE44 5001 0517 5407 3249 31")])).collect()
    of = {r.doc_id: [(x.start, x.end, x.generator, x.hit) for x in r.proposed] for r in got}
    assert (5, 22, 1, True) in of[1] and (26, 38, 1, False) in of[1]
    assert of[2] == [(0, 11, 0, True), (12, 24, 0, False)]
    assert any(g == 2 for *_, g, _ in of[3])


def corpus():
    """Phone numbers mostly with a plus and always after a cue; part numbers of another shape after other words."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        number = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        bare = i % 60 == 0
        lead = f"please call {'' if bare else '+'}1 {number} today" if i % 2 == 0 else f"order {rng.randint(10**7, 10**8)}/{rng.randint(100, 999)} shipped"
        rows.append((i, f"{lead} and more words"))
    return rows


def test_look_alikes_are_added_and_others_left_alone(spark):
    rows = corpus()
    found, detector = find_personal(frame(spark, rows), id_col="doc_id")
    assert detector.least[1] is not None and len(detector.trees.trees) == Trees().rounds
    bare = []
    for r in found.collect():
        added = [x for x in r.spans if x.rank >= len(BASE_KINDS)]
        if r.doc_id % 2:
            assert not r.spans
        elif r.doc_id % 60:
            assert len(r.base) == 1 and not added
        else:
            assert not r.base and {KINDS[x.rank] for x in added} <= {"number"}
            bare.append(len(added))
    assert max(bare) == 1 and sum(bare) >= len(bare) / 3  # those that look like the others to the features
    again, same = find_personal(frame(spark, rows[:4]), detector)
    assert same is detector and again.count() == 4


def test_sample_bounds_the_driver(spark):
    table = proposals(frame(spark, corpus()))
    assert isinstance(fit_detector(table, sample=10), Detector) and SAMPLE > 10


def test_no_feature_row_is_left_out(spark):
    rows = corpus() + [(i + 2000, f"call {'' if i % 3 else '+'}{'1 ' * (i % 4)}{10**6 + 7919 * i} or mail {'x' * (i % 9)}@{'y' * (i % 5)}.{'z' * (i % 3)}") for i in range(300)]
    table = proposals(frame(spark, rows))
    whole, apart = fit_detector(table), fit_detector(table, sample=10)
    assert apart.trees.trees == whole.trees.trees and apart.least == whole.least and whole.least[1] is not None


def test_redaction(spark):
    rows = [(1, "x 🙂 me@site.org, 10.0.0.1!"), (2, None), (3, "clean"), (4, "call +1 (212) 555-0199, 4111111111111111")]
    got = redact_personal(frame(spark, rows), Detector(Trees(), {0: None, 1: None, 2: None}))
    assert got.columns == frame(spark, rows).columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "x 🙂 [email], [ip]!", 2: None, 3: "clean", 4: "call [phone], [card]"}
