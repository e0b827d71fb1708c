"""Personal data by candidate gradient boosting, in DataFrame functions alone.

1. Base rules find spans that always stay.  Generators with a high recall propose further,
   overlapping spans: anything around an @, long groups of digits, account-like codes.
2. Every proposal has small integers as features: its format (digits, groups, separators,
   letters, repeats) and its context (neighbouring characters, cue words before it).  The signs that
   the base rules themselves test (a leading plus, check digits, ranges) are not among them.
3. Boosted trees learn which proposals hold a base span, from counts of distinct feature rows over all
   documents.  Up to ``SAMPLE`` of these the driver holds them; of more, Spark sums what each level of a tree needs.
4. On a fold of documents that the trees haven't seen, scores are calibrated by an isotonic fit, and each
   generator's threshold is the least score whose calibrated share reaches ``least``.  Proposals
   above it that touch no base span are added.

A document's spans are made within its row; texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexquarry.plans.storage import written

#: Fixed values of the base rules, in the order in which kinds are listed.  Possessive
#: repeats and the look-behinds find the same matches as the plain patterns without going over a run twice.
BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of proposals: kind of what they add, and pattern.
_PART = "[^\\s@<>\"'(),;:\\[\\]{}]"
GENERATORS = {
    "contact": rf"(?<!{_PART}){_PART}{{1,80}}+@{_PART}{{1,120}}+",
    "number": r"(?<![0-9])[(+]{0,2}+[0-9](?:[\x20()./-]{0,3}+[0-9]){6,}+",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){8,30}+(?![A-Za-z0-9])",
}
KINDS = (*BASE_KINDS, *GENERATORS)
#: Words before a proposal that speak for or against it.
CUES = ("phone", "tel", "call", "mobile", "fax", "mail", "contact", "address", "card", "account", "iban", "ip", "host", "ssn")
COUNTER_CUES = ("version", "license", "token", "secret", "password", "isbn", "page", "order", "figure", "table", "total", "price")
#: Distinct feature rows that the driver holds at most; more are summed by Spark, none is left out.
SAMPLE = 20_000
FOLDS = 4
#: Values that a feature may have, from 0 on; parts of a whole in the sums that trees grow from; score ranges in a unit.
WIDE, _FINE, _RANGES = 81, float(1 << 24), 1024
_CHUNK = 256


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """Walk an array once from the left: ``step(state, item)`` gives the next state and what to put out.

    Parts of ``_CHUNK`` items are gathered and joined at the end, so that no array is copied once an item.
    """
    none, whole = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def take(acc: Column, item: Column) -> Column:
        after, made = step(acc["s"], item)
        return F.struct(after.alias("s"), F.concat(acc["cur"], F.array(made.cast(out))).alias("cur"), acc["out"].alias("out"))

    def part(acc: Column, chunk: Column) -> Column:
        zero = F.struct(acc["s"].alias("s"), none.alias("cur"), acc["out"].alias("out"))
        return F.aggregate(chunk, zero, take, lambda a: F.struct(a["s"].alias("s"), F.concat(a["out"], F.array(a["cur"])).alias("out")))

    n = F.size(items)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda i: F.slice(items, i * _CHUNK + 1, _CHUNK))
    done = F.aggregate(chunks, F.struct(state.alias("s"), whole.alias("out")), part)
    return F.when(n > 0, F.flatten(done["out"])).otherwise(none)


def digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    of = F.transform(
        F.sequence(F.lit(0), F.length(number) - 1),
        lambda i: F.when(i % 2 == 0, F.substr(number, F.length(number) - i, F.lit(1)).cast("int")).otherwise(F.substr(number, F.length(number) - i, F.lit(1)).cast("int") * 2),
    )
    return F.aggregate(of, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, piece: Column) -> Column:
    """The check that a match of a base pattern has to pass."""
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(piece, r"\."), lambda p: (F.length(short(p)) <= 3) & (F.right(short(p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return passes_luhn(digits(piece))
    if kind == "phone":
        return F.length(digits(piece)).between(9, 15)
    return F.lit(True)


#: What each feature measures; the position is the feature's number.
FEATURES = ("generator", "digits", "length", "digit groups", "longest group", "letters", "dots", "blanks", "hyphens", "brackets", "distinct digits", "before", "after", "cue", "counter cue")


def features(number: int, piece: Column, before: Column, after: Column) -> Column:
    """Small integers about a proposal's format and context; ``before`` and ``after`` are the characters beside it."""
    count = lambda p: F.length(F.regexp_replace(piece, f"[^{p}]", ""))
    groups = F.filter(F.split(F.regexp_replace(piece, r"^\+", ""), "[^0-9]+"), lambda g: g != "")
    beside = lambda c: F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z]"), 2).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^\p{IsAlphabetic}"), 2).otherwise(4)
    words = F.lower(before)
    has = lambda cues: words.rlike(rf"(?<![a-z])({'|'.join(cues)})[a-z]*[^a-z]*$").cast("int")
    most = lambda c, top: F.least(c, F.lit(top)).cast("int")
    return F.array(
        F.lit(number), most(F.length(digits(piece)), 40), most(F.length(F.regexp_replace(piece, r"^\+", "")), 80), most(F.size(groups), 12),
        most(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), 40), most(count("A-Za-z"), 40), most(count("."), 8), most(count(r"\x20"), 8), most(count("-"), 8), most(count("()"), 4),
        F.size(F.array_distinct(F.split(digits(piece), ""))).cast("int"), beside(F.right(before, F.lit(1))), beside(after), has(CUES), has(COUNTER_CUES),
    )


_BASE = "struct<start:bigint,rank:int,end:bigint>"
_PROPOSAL = "struct<start:bigint,end:bigint,generator:int,hit:boolean,f:array<int>>"


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base (start, rank of the kind, end) and proposed (start, end, generator, hit: touches a base span, f: features) of every row, by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    patterns = BASE_PATTERNS | GENERATORS
    # A pattern's matches and what lies between them come from one engine, so their lengths are all that positions need.
    guard = {"email": text.contains("@"), "phone": text.contains("+"), "contact": text.contains("@")}
    looked = lambda k, found: F.when(guard[k], found).otherwise(F.array().cast("array<string>")) if k in guard else found
    cut = docs.select(
        F.col(id_col).alias("doc_id"),
        *[looked(k, F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))).alias(f"hit_{k}") for k, p in patterns.items()],
        *[looked(k, F.split(text, p, -1)).alias(f"gap_{k}") for k, p in patterns.items()],
    )
    item = lambda k: F.transform(F.col(f"hit_{k}"), lambda h, i: F.struct(
        F.length(F.get(f"gap_{k}", i)).cast("long").alias("gap"), h.alias("piece"), F.right(F.get(f"gap_{k}", i), F.lit(40)).alias("before"), F.substr(F.get(f"gap_{k}", i + 1), F.lit(1), F.lit(1)).alias("after"),
    ))
    cut = cut.select("doc_id", *[item(k).alias(k) for k in patterns])

    def placed(kind: str) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + x["gap"]
            end = start + F.length(x["piece"])
            return end, F.struct(start.alias("start"), end.alias("end"), x["piece"].alias("piece"), x["before"].alias("before"), x["after"].alias("after"))

        return scan(F.col(kind), F.lit(0).cast("long"), step, "struct<start:bigint,end:bigint,piece:string,before:string,after:string>")

    cut = cut.select("doc_id", *[placed(k).alias(k) for k in patterns])
    base = [F.transform(F.filter(k, lambda x: valid(k, x["piece"])), lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("rank"), x["end"].alias("end")).cast(_BASE)) for n, k in enumerate(BASE_KINDS)]  # noqa: B023
    none = F.array().cast("array<int>")
    offered = [
        F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(n).alias("generator"), F.lit(False).alias("hit"), features(n, x["piece"], x["before"], x["after"]).alias("f")).cast(_PROPOSAL))  # noqa: B023
        for n, k in enumerate(GENERATORS)
    ]
    cut = cut.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*offered).alias("offered"))
    stands = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(-1).alias("generator"), F.lit(True).alias("hit"), none.alias("f")).cast(_PROPOSAL))
    cut = cut.select("doc_id", "base", F.array_sort(F.concat("offered", stands)).alias("all"))

    def mark(touches: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]):
        def step(s: Column, x: Column) -> tuple[Column, Column]:
            hit = (x["hit"] | touches(s, x)).alias("hit")
            return F.when(x["generator"] < 0, after(s, x)).otherwise(s), F.struct(x["start"].alias("start"), x["end"].alias("end"), x["generator"].alias("generator"), hit, x["f"].alias("f"))

        return step

    onward = mark(lambda s, x: s > x["start"], lambda s, x: F.greatest(s, x["end"]))
    back = mark(lambda s, x: s < x["end"], lambda s, x: F.least(s, x["start"]))
    cut = cut.select("doc_id", "base", F.reverse(scan(F.col("all"), F.lit(-1).cast("long"), onward, _PROPOSAL)).alias("all"))
    cut = cut.select("doc_id", "base", scan(F.col("all"), F.lit((1 << 62)).cast("long"), back, _PROPOSAL).alias("all"))
    return cut.select("doc_id", "base", F.reverse(F.filter("all", lambda x: x["generator"] >= 0)).alias("proposed"))


@dataclass
class Trees:
    """Boosted regression trees of the logistic loss over small integer features."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.3
    least: float = 5.0
    first: float = 0.0
    trees: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        wide = int(x.max(initial=0)) + 1
        return self.learn(float(np.average(y, weights=weight)), lambda part, nodes: self.sums(x, y, weight, part, nodes, wide))

    def learn(self, share: float, sums: Callable[[object, int], np.ndarray]) -> Trees:
        """Grow all trees from sums by node, feature and value alone; ``share`` is that of the rows that are hits."""
        share = float(np.clip(share, 1e-3, 1 - 1e-3))
        self.first = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            self.trees.append(self.grow(sums))
        return self

    def sums(self, x, y, weight, part, nodes: int, wide: int) -> np.ndarray:
        """Gradient, curvature and weight of rows by (node that ``part`` leads to, feature, value), as whole numbers: their order and place make no difference."""
        node = self.values(part, x).astype(np.int64)
        p = 1 / (1 + np.exp(-self.scores(x)))
        own = np.rint(np.stack([weight * (y - p), weight * p * (1 - p), weight], 1) * _FINE).astype(np.int64)
        out, on = np.zeros((nodes * x.shape[1] * wide, 3), np.int64), node >= 0
        for f in range(x.shape[1]):
            np.add.at(out, (node[on] * x.shape[1] + f) * wide + x[on, f], own[on])
        return out.reshape(nodes, x.shape[1], wide, 3)

    def grow(self, sums):
        """(feature, threshold, left, right), or the value of a leaf; a level at a time."""
        done, level = {"": 0.0}, [""]

        def nested(path: str, open_: dict | None = None):
            if open_ is not None and path in open_:
                return open_[path]
            if isinstance(done[path], tuple):
                return (*done[path], nested(path + "L", open_), nested(path + "R", open_))
            return done[path] if open_ is None else -1.0

        value = lambda at: float(self.rate * at[0] / (at[1] + 1))
        for _ in range(self.depth):
            split = []
            for path, cells in zip(level, sums(nested("", {p: float(i) for i, p in enumerate(level)}), len(level)) / _FINE, strict=True):
                left, total = np.cumsum(cells, 1)[:, :-1], cells[0].sum(0)
                done[path] = value(total)
                right = total - left
                fits = (left[..., 2] >= self.least) & (right[..., 2] >= self.least)
                gain = np.where(fits, left[..., 0] ** 2 / (left[..., 1] + 1) + right[..., 0] ** 2 / (right[..., 1] + 1) - total[0] ** 2 / (total[1] + 1), 0)
                if gain.size and gain.max() > 1e-6:
                    f, t = np.unravel_index(gain.argmax(), gain.shape)
                    done[path], done[path + "L"], done[path + "R"] = (int(f), int(t)), value(left[f, t]), value(right[f, t])
                    split += [path + "L", path + "R"]
            level = split
            if not level:
                break
        return nested("")

    def values(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, t, left, right = tree
        return np.where(x[:, f] <= t, self.values(left, x), self.values(right, x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.first + sum(self.values(t, x) for t in self.trees)

    def sql(self, row: str) -> str:
        """The score as an expression over an array of features."""
        say = lambda t: f"CASE WHEN {row}[{t[0]}] <= {t[1]} THEN {say(t[2])} ELSE {say(t[3])} END" if isinstance(t, tuple) else f"CAST({t!r} AS DOUBLE)"
        return " + ".join([f"CAST({self.first!r} AS DOUBLE)", *map(say, self.trees)])


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of ``y`` in its order, by pooling neighbours."""
    pools: list[list[float]] = []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        pools.append([value * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.repeat([s / w for s, w, _ in pools], [int(n) for *_, n in pools])


@dataclass
class Detector:
    """Trees and the least score of each generator that is redacted; None adds nothing."""

    trees: Trees
    least: dict[int, float | None]


def fit_detector(table: DataFrame, least: float = 0.95, sample: int = SAMPLE, support: float = 50) -> Detector:
    """Fit on all documents' proposals but a fourth's, calibrate on that fourth.

    Above ``sample`` distinct feature rows Spark does the sums, with the same detector.  A generator with less than ``support`` proposals in the fourth has no threshold.  Repeated rows count as
    often as they occur; rows without an id are of one fold.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0
    rows = table.filter(F.size("proposed") > 0).select(fold.alias("held"), F.explode("proposed").alias("x"))
    counts = written(rows.groupBy("held", F.col("x.f").alias("f"), F.col("x.hit").alias("hit")).agg(F.count(F.lit(1)).alias("n")), "proposals")
    if counts.count() > sample:
        return _fit_apart(counts, least, support)
    got = counts.collect()
    x = np.array([r.f for r in got], np.int64).reshape(-1, len(FEATURES))
    y, n, held = (np.array([r[k] for r in got], np.float64) for k in ("hit", "n", "held"))
    fit, kept = held == 0, dict.fromkeys(range(len(GENERATORS)))
    if not (y[fit] == 1).any() or not (y[fit] == 0).any():
        return Detector(Trees(), kept)
    trees = Trees().fit(x[fit], y[fit], n[fit])
    score = trees.scores(x)
    for g in kept:
        own = np.flatnonzero((held == 1) & (x[:, 0] == g))
        if n[own].sum() < support:
            continue
        level, at = np.unique(score[own], return_inverse=True)
        total = np.bincount(at, n[own])
        reached = np.flatnonzero(isotonic(np.bincount(at, n[own] * y[own]) / total, total) >= least)
        kept[g] = float(level[reached[0]]) - 1e-9 if len(reached) else None
    return Detector(trees, kept)


def _columns(batch) -> tuple[np.ndarray, ...]:
    """Features, hits and counts of a batch of (f, hit, n)."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return x, batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64), batch.column(2).to_numpy().astype(np.float64)


def _fit_apart(counts: DataFrame, least: float, support: float) -> Detector:
    """The same detector where the driver can't hold the feature rows: Spark sums what each level of a tree needs, over all of them."""
    fit, kept, trees = counts.filter("not held").select("f", "hit", "n"), dict.fromkeys(range(len(GENERATORS))), Trees()
    total, hits = fit.agg(F.sum("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0))).first()
    if not total or not 0 < hits < total:
        return Detector(trees, kept)

    def sums(part, nodes: int) -> np.ndarray:
        def run(batches):
            cells = np.zeros((nodes, len(FEATURES), WIDE, 3), np.int64)
            for batch in batches:
                cells += trees.sums(*_columns(batch), part, nodes, WIDE)
            flat = cells.reshape(-1, 3)
            at = np.flatnonzero(flat.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(flat[at, i]) for i in range(3))], names=["cell", "g", "h", "w"])

        rows = fit.mapInArrow(run, "cell long, g long, h long, w long").groupBy("cell").agg(F.sum("g"), F.sum("h"), F.sum("w")).collect()  # no more than cells
        out = np.zeros((nodes * len(FEATURES) * WIDE, 3), np.int64)
        for cell, *own in rows:
            out[cell] = own
        return out.reshape(nodes, len(FEATURES), WIDE, 3)

    trees.learn(hits / total, sums)

    def score(batches):
        for batch in batches:
            x, y, n = _columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0], pa.int32()), pa.array(trees.scores(x)), pa.array((n * y).astype(np.int64)), pa.array(n.astype(np.int64))], names=["g", "score", "hits", "n"])

    # The isotonic fit reaches ``least`` from where on the sum of hits - least * n, of all greater scores too, is greatest; of equal sums, the least score.
    levels = counts.filter("held").select("f", "hit", "n").mapInArrow(score, "g int, score double, hits long, n long").groupBy("g", "score").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    levels = levels.select("g", "score", "n", F.floor(F.col("score") * _RANGES).alias("range"), (F.col("hits") - least * F.col("n")).alias("over"))
    down = Window.partitionBy("g", "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranges = levels.withColumn("sum", F.round(F.sum("over").over(down), 6)).groupBy("g", "range").agg(F.max(F.struct("sum", (-F.col("score")).alias("less"))).alias("best"), F.sum("over").alias("over"), F.sum("n").alias("n"))
    by: dict[int, list] = {}
    for r in ranges.collect():  # one row for each range of scores
        by.setdefault(r.g, []).append(r)
    for g, own in by.items():
        if sum(r.n for r in own) < support:
            continue
        top, above = -1e-6, 0.0
        for r in sorted(own, key=lambda r: -r.range):
            if above + r.best["sum"] >= top - 1e-6:
                top, kept[g] = max(top, above + r.best["sum"]), -r.best["less"] - 1e-9
            above += r.over
    return Detector(trees, kept)


def find_personal(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Detector]:
    """(doc_id, base, spans of every row; the detector, fitted here unless given).

    Spans are (start, rank, end): code points, end exclusive, ``rank`` the place in ``KINDS``; base ones are always
    among them, added ones touch neither a base span nor each other (the leftmost stays).  A null text counts as empty and has none, repeated
    rows have equal spans, an empty table gives an empty result; other columns are ignored.
    """
    table = written(proposals(docs, id_col, text_col), "personal")
    detector = detector or fit_detector(table)
    allowed = " OR ".join(f"(x.generator = {g} AND {detector.trees.sql('x.f')} >= CAST({t!r} AS DOUBLE))" for g, t in detector.least.items() if t is not None) or "false"
    chosen = F.expr(f"filter(proposed, x -> NOT x.hit AND ({allowed}))")
    added = table.select("doc_id", "base", chosen.alias("chosen"))

    def leftmost(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["end"]).otherwise(end), F.struct(x["start"].alias("start"), F.when(free, x["generator"] + len(BASE_KINDS)).alias("rank"), x["end"].alias("end"))

    apart = F.filter(scan(F.col("chosen"), F.lit(0).cast("long"), leftmost, _BASE), lambda x: x["rank"].isNotNull())
    return added.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("spans")), detector


def redact_personal(docs: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of a detector replaced by the name of its kind in brackets; overlapping spans once, by the first."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    found, _ = find_personal(docs.select(F.struct(*docs.columns).alias("doc_id"), F.col(text_col).alias("text")), detector)
    found = found.select(F.col("doc_id").alias("_row"), "spans").alias("_found")  # the whole row went along in the place of its id
    row = lambda c: F.col("_found._row")[c]

    def join(end: Column, x: Column) -> tuple[Column, Column]:
        inside = x["start"] < end
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substr(row(text_col), (end + 1).cast("int"), (x["start"] - end).cast("int")), F.get(names, x["rank"])))
        return F.greatest(end, x["end"]), piece

    tail = F.greatest(F.lit(0).cast("long"), F.array_max(F.transform("spans", lambda x: x["end"])))
    text = F.concat(F.array_join(scan(F.col("spans"), F.lit(0).cast("long"), join, "string"), ""), F.substr(row(text_col), (tail + 1).cast("int"), F.length(row(text_col))))
    masked = F.when(F.size("spans") > 0, text).otherwise(row(text_col))
    return found.select(*[masked.alias(c) if c == text_col else row(c).alias(c) for c in docs.columns])


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, a count of base spans of each kind, base_sha256 and all spans as one string."""
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"], x["end"])), ",")
    count = [F.size(F.filter("base", lambda x: x["rank"] == n)).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)]  # noqa: B023
    return found.select("doc_id", *count, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table, the detector fitted on it."""
    return span_digest(find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0])
