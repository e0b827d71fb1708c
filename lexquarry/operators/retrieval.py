"""Hybrid retrieval over a table of queries: intent, variants, four retrievers, fusion and rerank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators.containment import GramIndex, containing
from lexquarry.operators.lexical import bm25
from lexquarry.plans.storage import written

# Cue words of each intent in declared order, and the weight of each retriever for it.
INTENTS = {
    "section_lookup": ("section", "provision", "article", "clause", "subsection", "act", "code", "sanhita", "adhiniyam", "statute", "under which section", "which section", "what section", "ipc", "bns", "bnss", "bsa", "crpc"),
    "precedent_search": ("precedent", "judgment", "case law", "ruling", "held that", "supreme court", "high court", "citation", "ratio decidendi", "overruled", "distinguished", "followed"),
    "procedural_check": ("procedure", "fir", "arrest", "bail", "charge sheet", "jurisdiction", "limitation", "court fee", "affidavit", "summon", "warrant", "cognizance", "investigation", "compliance", "due process"),
    "strategy_advice": ("strategy", "approach", "how to", "what should", "recommend", "best course", "option", "alternative", "settlement", "mediation", "plea bargaining", "defense", "prosecution"),
    "case_understanding": ("summarize", "summary", "facts", "brief", "explain", "what happened", "timeline", "parties", "evidence", "document", "petition", "complaint"),
    "legal_reasoning": ("reasoning", "analysis", "apply", "argue", "interpret", "construction", "doctrine", "principle", "rule of law", "ratio", "obiter", "issue rule application conclusion"),
}
WEIGHTS = {
    "section_lookup": {"vector": 0.3, "kg": 0.25, "citation": 0.35, "keyword": 0.1},
    "precedent_search": {"vector": 0.3, "kg": 0.2, "citation": 0.25, "keyword": 0.25},
    "procedural_check": {"vector": 0.2, "kg": 0.3, "citation": 0.3, "keyword": 0.2},
    "strategy_advice": {"vector": 0.4, "kg": 0.2, "citation": 0.1, "keyword": 0.3},
    "case_understanding": {"vector": 0.4, "kg": 0.15, "citation": 0.1, "keyword": 0.35},
    "legal_reasoning": {"vector": 0.3, "kg": 0.25, "citation": 0.2, "keyword": 0.25},
    "general": {"vector": 0.3, "kg": 0.2, "citation": 0.2, "keyword": 0.3},
}
RRF = 60
ACT_SUFFIXES = ("BNS 2023", "BNSS 2023", "BSA 2023", "IPC 1860")
ACT_ALIASES = {
    "ipc": "Indian Penal Code",
    "indian penal code": "Indian Penal Code",
    "crpc": "Code of Criminal Procedure 1973",
    "iea": "Indian Evidence Act 1872",
    "bns": "Bharatiya Nyaya Sanhita",
    "bharatiya nyaya sanhita": "Bharatiya Nyaya Sanhita",
    "bnss": "Bharatiya Nagarik Suraksha Sanhita",
    "bharatiya nagarik suraksha sanhita": "Bharatiya Nagarik Suraksha Sanhita",
    "bsa": "Bharatiya Sakshya Adhiniyam",
    "bharatiya sakshya adhiniyam": "Bharatiya Sakshya Adhiniyam",
}
_ACTS = "BNSS|BNS|BSA|IPC|CrPC|IEA|Indian Penal Code|Bharatiya Nyaya Sanhita|Bharatiya Nagarik Suraksha Sanhita|Bharatiya Sakshya Adhiniyam"
#: Fixed forms of a citation, each with the groups that hold the section and the act (or a constant act).
CITATION_FORMS = (
    (rf"(?i)(?:Section|Sec\.?)\s*(\d+[A-Za-z]*(?:\(\d+\))?)\s*(?:of\s+)?(?:the\s+)?({_ACTS})", 1, 2),
    (r"(?i)(BNSS|BNS|BSA|IPC|CrPC|IEA)\s*(?:Section|Sec\.?)?\s*(\d+[A-Za-z]*)", 2, 1),
    (r"(?i)(?:Article|Art\.?)\s*(\d+[A-Za-z]*)", 1, "Constitution of India"),
    (r"(?i)(?:under|u/s|u\.s\.|as per)\s+(?:Section|Sec\.?)?\s*(\d+[A-Za-z]*)", 1, ""),
)


def citations(queries: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, pos, section_number, act, matched), distinct on section and act in first-seen order."""
    forms = []
    for pattern, section, act in CITATION_FORMS:
        every = lambda g, p=pattern: F.regexp_extract_all("text", F.lit(p), F.lit(g))
        acts = every(act) if isinstance(act, int) else F.array_repeat(F.lit(act), F.size(every(0)))
        forms.append(F.arrays_zip(every(section).alias("section_number"), acts.alias("act"), every(0).alias("matched")))
    found = queries.select(key, F.posexplode(F.flatten(F.array(*forms))).alias("pos", "c")).select(key, "pos", "c.section_number", "c.act", "c.matched")
    alias = F.create_map(*[F.lit(x) for pair in ACT_ALIASES.items() for x in pair])
    found = found.withColumn("act", F.coalesce(F.element_at(alias, F.lower("act")), "act"))
    first = Window.partitionBy(key, "section_number", "act").orderBy("pos")
    return found.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def citation_hits(queries: DataFrame, sections: DataFrame, k: int = 20) -> DataFrame:
    """Hits of the first five citations of a query, five sections each by number and act when known; misses keep a row of score 1."""
    order = Window.partitionBy("query_id").orderBy("pos")
    cited = citations(queries).withColumn("nth", F.row_number().over(order)).filter("nth <= 5")
    same = (F.col("c.section_number") == F.col("s.section_number")) & ((F.col("c.act") == "") | (F.col("c.act") == F.col("s.act")))
    nth = Window.partitionBy("query_id", "nth").orderBy("section_id")
    hits = cited.alias("c").join(sections.alias("s"), same, "left").select("c.query_id", "c.nth", F.col("c.section_number"), F.col("c.act"), "s.section_id", "s.title")
    hits = hits.withColumn("place", F.row_number().over(nth)).filter("place <= 5")
    text = F.coalesce("title", F.concat(F.lit("Citation: Section "), "section_number", F.lit(" of "), "act"))
    ranked = Window.partitionBy("query_id").orderBy("nth", "place")
    out = hits.select("query_id", "section_id", text.alias("text"), F.lit(1.0).alias("score"), F.row_number().over(ranked).alias("rank"), F.lit("citation").alias("retriever"))
    return out.filter(F.col("rank") <= k)


def section_lookup(numbers: DataFrame, sections: DataFrame, each: int = 3) -> DataFrame:
    """Sections whose number contains a query's number (five numbers, ``each`` rows), text cut at 300."""
    order = Window.partitionBy("query_id", "number").orderBy("section_id")
    wanted = Window.partitionBy("query_id").orderBy("number")
    few = numbers.withColumn("nth", F.row_number().over(wanted)).filter("nth <= 5").drop("nth")
    # A number is short: its digits' pieces give an equality to join on instead of comparing all pairs.
    pieces = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("section_number")), lambda i: F.transform(F.sequence(i, F.length("section_number")), lambda j: F.substring("section_number", i, j - i + 1))))))
    index = sections.select("section_id", "section_number", "title", "act", F.substring("text", 1, 300).alias("text"), pieces.alias("number"))
    hits = few.join(index, "number").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each)
    return hits.drop("n")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverse: (a, b, type)."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type"))


def neighbours(seeds: DataFrame, edges: DataFrame, each: int = 5, few: bool = False) -> DataFrame:
    """Up to ``each`` neighbours of every seed section, undirected.

    With ``few`` seeds, a small table that is read back, Spark asks for them in what ``edges`` are made of, so only their edges are made.
    """
    order = Window.partitionBy("section_id").orderBy("b", "type")
    pairs = both_ways(edges)
    if few:
        pairs = pairs.join(seeds.select(F.col("section_id").alias("a")).distinct(), "a", "left_semi")
    hits = seeds.join(pairs, F.col("section_id") == F.col("a")).withColumn("n", F.row_number().over(order))
    return hits.filter(F.col("n") <= each).select("section_id", F.col("b").alias("neighbour"), "type")


def numbers_asked(queries: DataFrame) -> DataFrame:
    """(query_id, number) of the sections that a query names."""
    found = F.regexp_extract_all("text", F.lit(r"(?i)(?:section|sec\.?)\s*(\d+[A-Za-z]*)"), F.lit(1))
    return queries.select("query_id", F.explode(F.array_distinct(found)).alias("number"))


def graph_hits(queries: DataFrame, sections: DataFrame, edges: DataFrame | None = None, k: int = 20) -> DataFrame:
    """(query_id, section_id, text, score, rank): sections named by number, each with its neighbours behind it.

    A query that names no section is answered by :func:`section_text_hits`.
    """
    found = section_lookup(numbers_asked(queries), sections).select("query_id", "number", "section_id", F.format_string("Section %s: %s\n%s", "section_number", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
    found = written(found, "named")  # a few rows a query
    rows = found.withColumns({"near": F.lit(0), "other": F.col("section_id")})
    if edges is not None and not found.isEmpty():
        near = neighbours(found.select("section_id").distinct(), edges, few=True)
        named = sections.select(F.col("section_id").alias("neighbour"), F.format_string("Related: Section %s (%s): %s\nRelationship: ", "section_number", F.coalesce("act", F.lit("")), F.coalesce("title", F.lit(""))).alias("said"))
        near = near.join(named, "neighbour").select(F.col("section_id").alias("of"), "neighbour", F.concat("said", "type").alias("said"))
        rows = rows.unionByName(found.join(near, F.col("section_id") == F.col("of")).select("query_id", "number", "section_id", F.col("said").alias("text"), F.lit(1).alias("near"), F.col("neighbour").alias("other")))
    first = Window.partitionBy("query_id", "other").orderBy("number", "section_id", "near", "text")
    order = Window.partitionBy("query_id").orderBy("number", "section_id", "near", "other")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = rows.select("query_id", F.col("other").alias("section_id"), "text", decay(F.col("rank")).alias("score"), "rank")
    unnamed = queries.join(numbers_asked(queries).select("query_id").distinct(), "query_id", "left_anti")
    return named.unionByName(section_text_hits(unnamed, sections, k=k))


def section_text_hits(queries: DataFrame, sections: DataFrame, index: GramIndex | None = None, k: int = 20) -> DataFrame:
    """(query_id, section_id, text, score, rank) of up to ``k`` sections whose title or text contains a query's first 100 characters, by id; a table of queries at once."""
    fields = ("title", "text")
    needles = queries.select("query_id", F.substring("text", 1, 100).alias("needle"))
    found = containing(sections, needles, index, "section_id", fields, k).join(sections.select("section_id", "section_number"), "section_id")
    order = Window.partitionBy("query_id").orderBy("section_id")
    rows = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    said = F.format_string("Section %s: %s\n%s", "section_number", F.coalesce("title", F.lit("")), F.substring(F.coalesce("text", F.lit("")), 1, 500))
    return rows.select("query_id", "section_id", said.alias("text"), decay(F.col("rank")).alias("score"), "rank")


def text_search(sections: DataFrame, query: str, k: int) -> DataFrame:
    """Sections whose title or text contains the query (cut at 100), in order of id; a query that names sections is answered by their numbers."""
    if named := re.findall(r"(?:section|sec\.?)\s*(\d+[A-Za-z]*)", query, re.IGNORECASE):
        few = sections.sparkSession.createDataFrame([(0, n) for n in dict.fromkeys(named)], "query_id int, number string")
        hits = section_lookup(few, sections).select("section_id").distinct()
        return sections.join(hits, "section_id", "left_semi").orderBy("section_id").limit(k)
    q = query[:100].lower()
    return sections.filter(F.lower("title").contains(q) | F.lower("text").contains(q)).orderBy("section_id").limit(k)


def decay(rank: Column) -> Column:
    """A score that falls with the rank, never below 0."""
    return F.greatest(F.lit(0.0), F.lit(0.9) - F.lit(0.02) * (rank - 1))


def intent_scores(text: Column) -> list[Column]:
    """Each intent's share of its cue words, in declared order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return [(sum((low.contains(w).cast("int") for w in words), F.lit(0)) / len(words)).alias(name) for name, words in INTENTS.items()]


def detect_intent(text: Column) -> Column:
    """The best intent, the first declared on ties; general when blank or under 0.05."""
    scores = intent_scores(text)
    best = F.greatest(*scores)
    out = F.lit("general")
    for name, score in reversed(list(zip(INTENTS, scores, strict=True))):
        out = F.when(score == best, name).otherwise(out)
    return F.when((F.trim(F.coalesce(text, F.lit(""))) == "") | (best < 0.05), "general").otherwise(out)


def weight_of(intent: Column, retriever: Column) -> Column:
    """The weight of a retriever for an intent."""
    table = F.create_map(*[x for i, w in WEIGHTS.items() for r, v in w.items() for x in (F.lit(f"{i}/{r}"), F.lit(v))])
    return F.element_at(table, F.concat_ws("/", intent, retriever))


def variants(queries: DataFrame) -> DataFrame:
    """(query_id, pos, variant): the query first, then rule-made variants, distinct, longer than 3, five at most."""
    q, low = F.trim("text"), F.lower("text")
    words = F.split(F.trim("text"), r"\s+")
    fewer = F.filter(words, lambda w: ~F.lower(w).isin(*T.STOP_WORDS))
    made = F.array(
        q,
        F.when(~low.contains("section"), F.concat("text", F.lit(" applicable legal section"))),
        F.concat("text", F.lit(" precedent case law judgment")),
        *[F.when(~low.contains(a.lower()), F.concat("text", F.lit(f" {a}"))) for a in ACT_SUFFIXES],
        F.when(F.size(fewer) < F.size(words), F.array_join(fewer, " ")),
    )
    rows = queries.select("query_id", F.posexplode(F.array_compact(made)).alias("pos", "variant")).filter("length(variant) > 3")
    first = Window.partitionBy("query_id", F.lower("variant")).orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    order = Window.partitionBy("query_id").orderBy("pos")
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth <= 5").select("query_id", "nth", "variant")


def fuse(hits: DataFrame, key: str = "doc_key", near_copies: bool = False) -> DataFrame:
    """Weighted reciprocal-rank fusion of hits (query_id, retriever, key, rank, score, weight, text).

    One shuffle on query and key; the representative is the hit of best rank, then of best score.  With ``near_copies``
    hits whose texts begin alike (R13) are one, known by the least key among those of its best rank and score.
    """
    best = F.min_by(F.struct("text", "score"), F.struct("rank", (-F.col("score")).alias("s"), "retriever"))
    if near_copies:
        alike = F.coalesce(F.nullif(T.near_dup_key(F.col("text")), F.lit("")), F.col(key).cast("string"))
        named = F.min_by(key, F.struct("rank", (-F.col("score")).alias("s"), "retriever", key)).alias(key)
        fused = hits.withColumn("_alike", alike).groupBy("query_id", "_alike").agg(
            named, F.round(F.sum(F.col("weight") / (RRF + F.col("rank"))), 9).alias("rrf"), best.alias("best"), F.array_sort(F.collect_set("retriever")).alias("matched_sources")
        )
        return fused.select("query_id", key, "rrf", "best.text", "best.score", "matched_sources")
    fused = hits.groupBy("query_id", key).agg(
        F.round(F.sum(F.col("weight") / (RRF + F.col("rank"))), 9).alias("rrf"), best.alias("best"), F.array_sort(F.collect_set("retriever")).alias("matched_sources")
    )
    return fused.select("query_id", key, "rrf", "best.text", "best.score", "matched_sources")


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct white-space terms that the text has."""
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(terms(query), terms(text))) / F.greatest(F.size(terms(query)), F.lit(1))


def rerank(fused: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_key", scorer: Column | None = None) -> DataFrame:
    """The ``k`` best by half the raw score, three tenths of the fused one and two tenths of the overlap, or by ``scorer``."""
    rows = fused.join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    score = scorer if scorer is not None else 0.5 * F.coalesce("score", F.lit(0.5)) + 0.3 * F.col("rrf") + 0.2 * term_overlap(F.col("query"), F.col("text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), key)
    return rows.withColumn("final", F.round(score, 6)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("query")


def hybrid_search(queries: DataFrame, docs: DataFrame, sections: DataFrame, vectors: DataFrame | None = None, k: int = 10, edges: DataFrame | None = None, where: dict | None = None) -> DataFrame:
    """Intents, the first variant of each query, four retrievers (3k, 2k, k, 2k), fusion by intent's weights, rerank to ``k``; one plan for all queries.

    ``vectors`` are ready vector hits (query_id, doc_key, text, score, rank), ``edges`` lead from the sections found to
    their neighbours; without either that part adds nothing.  A query that names no section is looked for in the sections' texts.
    ``where`` keeps the documents with these column values before they are searched.  Hits that begin alike are fused into one; whole texts are reranked.
    """
    for column, value in (where or {}).items():
        docs = docs.filter(F.col(column) == value)
    asked = queries.select("query_id", F.trim("text").alias("text")).withColumn("intent", detect_intent(F.col("text")))
    queries = asked.select("query_id", "text")
    lexical = written(bm25(docs, queries, 2 * k), "lexical").join(docs.select("doc_id", "text"), "doc_id")  # few rows: the texts stay where they are
    lexical = lexical.select("query_id", F.concat(F.lit("doc:"), "doc_id").alias("doc_key"), "text", "score", "rank", F.lit("keyword").alias("retriever"))
    cited = citation_hits(queries, sections, k).select("query_id", F.concat(F.lit("sec:"), F.coalesce(F.col("section_id").cast("string"), "text")).alias("doc_key"), "text", "score", "rank", "retriever")
    graph = graph_hits(queries, sections, edges, 2 * k).select("query_id", F.concat(F.lit("sec:"), "section_id").alias("doc_key"), "text", "score", "rank", F.lit("kg").alias("retriever"))
    hits = lexical.unionByName(cited).unionByName(graph)
    if vectors is not None:
        hits = hits.unionByName(vectors.select("query_id", "doc_key", "text", "score", "rank", F.lit("vector").alias("retriever")))
    weighted = hits.join(asked.select("query_id", "intent"), "query_id").withColumn("weight", weight_of(F.col("intent"), F.col("retriever")))
    return rerank(fuse(weighted, near_copies=True), queries, k)


def search_stats(results: DataFrame) -> DataFrame:
    """Results, distinct sources and mean score of each query."""
    return results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.size(F.array_distinct(F.flatten(F.collect_list("matched_sources")))).alias("n_sources"), F.round(F.avg("final"), 6).alias("mean_score")
    )


def context_blocks(hits: DataFrame, k: int = 5, separator: str = "\n---\n") -> DataFrame:
    """Per query the ``k`` best hits (rank, source, page, text) as labelled blocks joined by rules."""
    block = F.concat(F.lit("Source (Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("): "), "text")
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    top = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(blocks.alias("b"))
    return top.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), separator).alias("context"))


def hit_kind(doc_type: Column, act: Column, source: Column) -> Column:
    """Precedent or statute, by type, act and source name."""
    low = F.lower(F.coalesce(source, F.lit("")))
    judged = F.lower(F.coalesce(doc_type, F.lit(""))).isin("judgment", "case", "precedent") | low.contains(" vs ") | low.contains("_vs_")
    return F.when(judged & (F.coalesce(act, F.lit("")) == ""), "precedent").otherwise("statute")


def direct_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, section_number, snippet, score): sections named in a text, 40 characters before and 140 after the first place."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)Section\s+(\d+[A-Z]?)"), F.lit(1)))
    rows = docs.select("doc_id", "text", F.explode(numbers).alias("section_number"))
    at = F.regexp_instr("text", F.concat(F.lit(r"(?i)Section\s+"), "section_number", F.lit(r"\b")))
    start = F.greatest(at - 40, F.lit(1))
    return rows.select("doc_id", "section_number", F.trim(F.regexp_replace(F.substring("text", start, at - start + 140), r"\s+", " ")).alias("snippet"), F.lit(0.95).alias("score"))


def research_sections(mentions: DataFrame, cap: int = 12) -> DataFrame:
    """(doc_id, section_number, act, nth) distinct on number and act, first kept, capped."""
    first = Window.partitionBy("doc_id", "section_number", "act").orderBy("pos")
    order = Window.partitionBy("doc_id").orderBy("pos")
    once = mentions.withColumn("n", F.row_number().over(first)).filter("n = 1")
    return once.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= cap).select("doc_id", "section_number", "act", "nth")


def research_confidence(sections: Column, acts: Column, precedents: Column) -> Column:
    """The ladder from what was found."""
    return F.when((sections > 0) & (precedents > 0), 0.98).when((sections > 0) & (acts > 0), 0.975).when((sections > 0) | (acts > 0) | (precedents > 0), 0.85).otherwise(0.40)


def case_context(docs: DataFrame, each: int = 3, cut: int = 1000, label: bool = False, separator: str = "\n\n") -> DataFrame:
    """The first documents of a case, each cut, labelled or not, joined in order."""
    order = Window.partitionBy("case_id").orderBy("doc_id")
    rows = docs.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= each)
    part = F.substring("text", 1, cut)
    part = F.concat(F.lit("DOC "), "rn", F.lit(": "), part) if label else part
    parts = F.array_sort(F.collect_list(F.struct("rn", part.alias("part"))))
    return rows.groupBy("case_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), separator).alias("context"))
