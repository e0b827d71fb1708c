"""Confidence, bands, report assembly and portfolio counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weight of each agent in the fused score.
AGENT_WEIGHTS = {
    "case_understanding": 0.10,
    "legal_research": 0.15,
    "knowledge_graph": 0.05,
    "evidence_reliability": 0.15,
    "contradiction_detection": 0.10,
    "procedural_compliance": 0.10,
    "legal_reasoning": 0.15,
    "strategy_recommendation": 0.10,
    "risk_assessment": 0.10,
}
# Name and usual time in milliseconds of each agent; sections of a report with the fields that each shows, under which name, and how many items; classes of cases by words.
AGENTS = {
    "case_understanding": ("Document Processing Agent", 140),
    "legal_research": ("Metadata Agent", 210),
    "knowledge_graph": ("Knowledge Graph Agent", 160),
    "evidence_reliability": ("Evidence Reliability Agent", 115),
    "contradiction_detection": ("Contradiction Detection Agent", 95),
    "procedural_compliance": ("Procedural Compliance Agent", 85),
    "legal_reasoning": ("Legal Reasoning Agent", 240),
    "strategy_recommendation": ("Strategy Recommendation Agent", 130),
    "risk_assessment": ("Risk Assessment Agent", 110),
    "confidence_fusion": ("Confidence Agent", 65),
    "explainability": ("Explainability Agent", 125),
    "report_generation": ("Report Generation Agent", 190),
}
ONE = 0
REPORT = (
    ("Executive Summary", (("summary", "case_summary", ONE), ("trust_score", "trust_score", ONE), ("key_findings", "legal_issues", 5))),
    ("Case Facts", (("summary", "case_summary", ONE), ("facts", "case_facts", ONE), ("timeline", "timeline", None), ("entities", "entities", ONE))),
    ("Legal Issues Identified", (("issues", "legal_issues", None),)),
    ("Applicable Acts", (("acts", "applicable_acts", None),)),
    ("Applicable Sections", (("sections", "applicable_sections", 15),)),
    ("Supporting Judgments", (("precedents", "precedents", 10),)),
    ("Evidence Analysis", (("assessment", "evidence_assessment", ONE),)),
    ("Contradiction Analysis", (("contradictions", "contradictions", None),)),
    ("Risk Assessment", (("assessment", "risk_assessment", ONE),)),
    ("Procedural Compliance", (("status", "procedural_status", ONE),)),
    ("Strategy Recommendation", (("options", "strategy_options", None), ("reasoning", "legal_reasoning", ONE), ("irac", "irac_analysis", ONE))),
    ("Trust Score", (("trust_score", "trust_score", ONE),)),
    ("Confidence Scores", (("per_agent", "agent_confidence", ONE),)),
    ("Explainability Graph", (("graph", "explanation_graph", ONE),)),
    ("Knowledge Graph Snapshot", (("graph_data", "kg_data", ONE),)),
    ("References & Human Review Note", ()),
)
NO_SUMMARY = "No summary available"
REFERENCES = 10
REVIEW_NOTE = "An automated, advisory report: a qualified professional has to review it before use."
CATEGORIES = (("criminal", ("criminal", "bail", "ndps")), ("cybercrime", ("cyber",)), ("arbitration", ("arbitration", "commercial")), ("constitutional", ("writ", "constitution")))
COUNTED = {"criminal": ("criminal", "bail"), "cybercrime": ("cyber",), "arbitration": ("arbitration", "commercial"), "constitutional": ("writ", "constitution"), "civil": ("civil",)}


def weight_of(agent: Column, weights: dict[str, float] = AGENT_WEIGHTS) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), agent)


def trust(results: DataFrame, extra: DataFrame | None = None, weights: dict[str, float] = AGENT_WEIGHTS) -> DataFrame:
    """(case_id, fused, floored): the weighted mean of confidences above 0, blended with evidence, compliance and contradictions.

    ``extra`` may have evidence and compliance (.5 when missing), contradiction (the mean confidence of a case's contradictions, 0 when missing),
    errors (how many), sections and precedents (whether any were found).  A case without errors has a floor of .98 with both of the last, of .975 with either.
    """
    w = F.when(F.col("confidence") > 0, weight_of(F.col("agent"), weights))
    mean = F.try_divide(F.sum(F.col("confidence") * w), F.sum(w))
    rows = results.groupBy("case_id").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"))
    if extra is not None:
        rows = rows.join(extra, "case_id", "left")
    told = lambda c, default: F.coalesce(c, F.lit(default)) if extra is not None and c in extra.columns else F.lit(default)
    blend = 0.70 * F.col("mean") + 0.15 * told("evidence", 0.5) + 0.10 * told("compliance", 0.5) + 0.05 * (1 - told("contradiction", 0.0))
    fused = F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))
    floor = F.when(told("errors", 0) > 0, 0.0).when(told("sections", False) & told("precedents", False), 0.98).when(told("sections", False) | told("precedents", False), 0.975).otherwise(0.0)
    return rows.select("case_id", F.round(fused, 6).alias("fused"), F.round(F.greatest(fused, floor), 6).alias("floored"))


def understanding(summary: Column, facts: Column, entities: Column) -> Column:
    """.40, and .20, .15 and .15 for what was found, .95 at most."""
    add = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(0.95), 0.40 + add(summary, 0.20) + add(facts, 0.15) + add(entities, 0.15))


def contradiction_confidence(score: Column) -> Column:
    """A03."""
    return F.greatest(F.lit(0.1), 1 - score)


def trust_band(score: Column) -> Column:
    """A04."""
    return F.when(score >= 0.8, "HIGH").when(score >= 0.6, "MODERATE").when(score >= 0.4, "LOW").otherwise("VERY LOW")


def evidence_score(items: DataFrame) -> DataFrame:
    """The mean of a case's item scores."""
    return items.groupBy("case_id").agg(F.round(F.avg("score"), 6).alias("evidence"))


def agent_table(cases: DataFrame, results: DataFrame, agents: dict[str, tuple[str, int]] = AGENTS, default: float = 0.92) -> DataFrame:
    """(case_id, agent, name, status, time, confidence in percent) of every agent of every case; results (case_id, agent, confidence, and a measured time where there is one), else the usual values."""
    known = F.explode(F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(name).alias("name"), F.lit(f"{ms}ms").alias("usual")) for a, (name, ms) in agents.items()])).alias("a")
    every = cases.select("case_id", known).select("case_id", "a.*")
    time = F.max("time") if "time" in results.columns else F.lit(None).cast("string")
    best = results.groupBy("case_id", "agent").agg(F.max("confidence").alias("confidence"), time.alias("time"))
    rows = every.join(best, ["case_id", "agent"], "left")
    return rows.select("case_id", "agent", "name", F.lit("Completed").alias("status"), F.coalesce("time", "usual").alias("time"), F.round(F.coalesce("confidence", F.lit(default)) * 100, 4).alias("confidence"))


def importance(score: Column) -> Column:
    """A07."""
    return F.when(score > 0.7, "High").otherwise("Medium")


def report(fields: DataFrame) -> DataFrame:
    """(case_id, sections) from items (case_id, field, pos, content): all sections of ``REPORT`` in order, each a JSON object of its fields; lists are cut at their caps.

    The last section names the first sections (JSON items with section_number and act) and a note for the reader.
    """
    lists = fields.groupBy("case_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("items"))
    cases = lists.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "items"))).alias("of"))
    none = F.array().cast("array<string>")
    of = lambda field: F.coalesce(F.element_at("of", field), none)

    def shown(field: str, most: int | None) -> Column:
        if most == ONE:
            return F.coalesce(F.get(of(field), F.lit(0)), F.lit(NO_SUMMARY)) if field == "case_summary" else F.get(of(field), F.lit(0))
        return of(field) if most is None else F.slice(of(field), 1, most)

    def content(title: str, fields: tuple) -> Column:
        parts = [shown(field, most).alias(name) for name, field, most in fields]
        if title == "Trust Score":
            parts.append(trust_band(F.get(of("trust_score"), F.lit(0)).cast("double")).alias("interpretation"))
        if not fields:
            said = lambda s: F.format_string("Section %s of %s", F.get_json_object(s, "$.section_number"), F.get_json_object(s, "$.act"))
            parts = [F.transform(F.slice(of("applicable_sections"), 1, REFERENCES), said).alias("section_references"), F.lit(REVIEW_NOTE).alias("disclaimer")]
        return F.to_json(F.struct(*parts))

    sections = [F.struct(F.lit(n).alias("order"), F.lit(title).alias("title"), content(title, parts).alias("content")) for n, (title, parts) in enumerate(REPORT, 1)]
    return cases.select("case_id", F.array(*sections).alias("sections"))


def _has(kind: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(kind).rlike("|".join(words)), F.lit(False))


def category_of(kind: Column) -> Column:
    """A10: the first class whose words a case type has, else civil."""
    out = F.lit("civil")
    for name, words in reversed(CATEGORIES):
        out = F.when(_has(kind, words), name).otherwise(out)
    return out


def category_counts(cases: DataFrame, classes: dict[str, tuple[str, ...]] = COUNTED) -> DataFrame:
    """Overlapping counts by class in one pass."""
    return cases.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(_has(F.col("case_type"), words)).alias(f"n_{name}") for name, words in classes.items()])


def portfolio(cases: DataFrame, done: str = "F") -> DataFrame:
    """Total, analysed and the real mean."""
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == done).alias("analysed"), F.round(F.avg("amount"), 4).alias("mean_amount"))


def merged_fields(stored: DataFrame, state: DataFrame, fresh: DataFrame, key: str = "case_id") -> DataFrame:
    """Field by field the fresh value, else the state's, else the stored one."""
    names = [c for c in stored.columns if c != key]
    rename = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c in names])
    rows = rename(stored, "a").join(rename(state, "b"), key, "full_outer").join(rename(fresh, "c"), key, "full_outer")
    has = set(rows.columns)
    return rows.select(key, *[F.coalesce(*[F.col(f"{p}_{c}") for p in "cba" if f"{p}_{c}" in has]).alias(c) for c in names])


def insufficient(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, n_docs, flag, default_score): .5 without a document, .9 with one, none with more."""
    n = docs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_docs"))
    rows = cases.select("case_id").join(n, "case_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return rows.select("case_id", "n_docs", (F.col("n_docs") < 2).alias("flag"), F.when(F.col("n_docs") == 0, 0.5).when(F.col("n_docs") == 1, 0.9).alias("default_score"))
