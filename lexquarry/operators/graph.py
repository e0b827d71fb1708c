"""Knowledge-graph jobs over vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.operators.retrieval import both_ways
from lexquarry.plans.storage import spread


def edge_type(name: Column) -> Column:
    """Upper case, blanks and slashes as underscores."""
    return F.upper(F.translate(name, " /", "__"))


def party_edges(cases: DataFrame) -> DataFrame:
    """(src, dst, type, role) from a ``parties`` map of role to name and an ``others`` array."""
    named = cases.select("case_id", F.explode("parties").alias("role", "dst"))
    other = cases.select("case_id", F.lit("other").alias("role"), F.explode("others").alias("dst"))
    return named.unionByName(other).filter("dst is not null").select(F.col("case_id").alias("src"), "dst", F.lit("INVOLVES_PARTY").alias("type"), "role")


def issue_edges(issues: DataFrame) -> DataFrame:
    """Issue ids from a stable hash."""
    return issues.select(F.col("case_id").alias("src"), F.concat(F.lit("issue_"), F.pmod(F.xxhash64("issue"), F.lit(100_000))).alias("dst"), F.lit("HAS_ISSUE").alias("type"), "issue")


def simple_edges(rows: DataFrame, target: str, kind: str, *props: str) -> DataFrame:
    """One edge a row, with named properties."""
    return rows.select(F.col("case_id").alias("src"), F.col(target).alias("dst"), F.lit(kind).alias("type"), *props)


def section_pairs(case_section: DataFrame) -> DataFrame:
    """Pairs of a case's sections, the smaller first, tagged with the case; an equality join with a residual filter."""
    a, b = case_section.alias("a"), case_section.alias("b")
    return a.join(b, F.col("a.case_id") == F.col("b.case_id")).filter("a.section_id < b.section_id").select("a.case_id", F.col("a.section_id").alias("src"), F.col("b.section_id").alias("dst"))


def sequence_edges(cases: DataFrame, items: str, kind: str) -> DataFrame:
    """Edges to the items of an array column, numbered from 1."""
    return cases.select(F.col("case_id").alias("src"), F.posexplode(items).alias("pos", "item")).select("src", (F.col("pos") + 1).alias("sequence"), "item", F.lit(kind).alias("type"))


def contradiction_edges(cases: DataFrame) -> DataFrame:
    """Edges to the items (severity, confidence, type) of an array ``contradictions``, numbered from 0, with their properties or defaults."""
    rows = cases.select("case_id", F.posexplode("contradictions").alias("pos", "c"))
    return rows.select(
        F.col("case_id").alias("src"), F.format_string("contradiction:%s:%s", F.col("case_id").cast("string"), F.col("pos").cast("string")).alias("dst"), F.lit("HAS_CONTRADICTION").alias("type"),
        F.coalesce("c.severity", F.lit("unknown")).alias("severity"), F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("c.type", F.lit("")).alias("kind"),
    )


def with_stored_neighbours(case_section: DataFrame, edges: DataFrame, each: int = 5, of: int = 8) -> DataFrame:
    """(case_id, section_id, neighbour, type): up to ``each`` stored neighbours of the first ``of`` sections of every case."""
    first = Window.partitionBy("case_id").orderBy("section_id")
    few = case_section.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= of).drop("n")
    order = Window.partitionBy("a").orderBy("b", "type")
    near = both_ways(edges).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each)
    return few.join(near, F.col("section_id") == F.col("a")).select("case_id", "section_id", F.col("b").alias("neighbour"), "type")


def case_graph(records: DataFrame, cites: int = 6) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of cases from their fields: parties, judges, court, articles, sections, citations.

    ``records`` has case_id, title, petitioner, respondent, court, and arrays judges, articles, sections and citations.
    """

    def many(column: Column, label: str, kind: str) -> DataFrame:
        return records.select("case_id", F.explode(column).alias("name")).filter("name is not null and lower(name) <> 'keyword'").select("case_id", F.lit(label).alias("label"), "name", F.lit(kind).alias("type"))

    parts = [
        many(F.array("petitioner", "respondent"), "Party", "INVOLVES"),
        many(F.col("judges"), "Judge", "DECIDED_BY"),
        many(F.array("court"), "Court", "HEARD_IN"),
        many(F.transform("articles", lambda a: F.concat(F.lit("Article "), a)), "Article", "RAISES"),
        many(F.transform("sections", lambda s: F.concat(F.lit("Section "), s)), "Section", "APPLIES"),
        many(F.slice("citations", 1, cites), "Citation", "CITES"),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    edges = every.select("case_id", F.lit("case").alias("source"), F.concat_ws("|", "label", "name").alias("target"), "type").distinct()
    own = records.select("case_id", F.lit("case").alias("id"), F.lit("Case").alias("label"), F.col("title").alias("name"))
    vertices = own.unionByName(every.select("case_id", F.concat_ws("|", "label", "name").alias("id"), "label", "name")).dropDuplicates(["case_id", "id"])
    return vertices, edges


def explanation_graph(cases: DataFrame) -> DataFrame:
    """The fixed chain from facts to conclusion, up to eight sections and five contradictions (with negative weight)."""
    chain = [("facts", "issues", 0.9), ("issues", "law", 0.85), ("law", "application", 0.8), ("application", "conclusion", 0.75)]
    fixed = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(w).alias("weight")) for a, b, w in chain])
    law = F.transform(F.slice("sections", 1, 8), lambda s: F.struct(F.concat(F.lit("section:"), s).alias("src"), F.lit("law").alias("dst"), F.lit(0.7).alias("weight")))
    against = F.transform(F.slice("contradictions", 1, 5), lambda c: F.struct(F.concat(F.lit("contradiction:"), c).alias("src"), F.lit("application").alias("dst"), F.lit(-0.5).alias("weight")))
    return cases.select("case_id", F.explode(F.concat(fixed, law, against)).alias("e")).select("case_id", "e.*")


def sections_where(sections: DataFrame, number: str | None = None, act: str | None = None, contains: str | None = None, until: int | None = None, k: int | None = None) -> DataFrame:
    """Sections by number, act, substring of title or text, or year, in a stated order."""
    for column, value in (("section_number", number), ("act", act)):
        if value is not None:
            sections = sections.filter(F.col(column) == value)
    if contains is not None:
        sections = sections.filter(F.lower("title").contains(contains.lower()) | F.lower("text").contains(contains.lower()))
    if until is not None:
        sections = sections.filter(F.col("year") <= until).orderBy(F.desc("year"), "section_id")
    else:
        sections = sections.orderBy("section_id")
    return sections if k is None else sections.limit(k)


def related(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, types: tuple[str, ...] = (), directed: bool = False) -> DataFrame:
    """One hop from seed sections, over some types or all, undirected unless said."""
    links = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type") if directed else both_ways(edges)
    if types:
        links = links.filter(F.col("type").isin(*types))
    links = spread(links.select(F.col("a").alias("section_id"), F.col("b").alias("other"), "type"), "section_id", source=edges)
    hop = links.join(seeds.select("section_id"), "section_id", "left_semi").distinct()  # narrow rows, before titles are joined to them
    return spread(hop, "other", source=edges).join(vertices.select(F.col("section_id").alias("other"), "title", "act", "year").distinct(), "other")


def precedents_of(case_section: DataFrame, cases: DataFrame, section: int, k: int) -> DataFrame:
    """Cases of a section, newest first."""
    return case_section.filter(F.col("section_id") == section).join(cases, "case_id").orderBy(F.desc("created_at"), "case_id").limit(k)


def case_neighbourhood(cases: DataFrame, case_section: DataFrame, vertices: DataFrame) -> DataFrame:
    """Every case with its distinct sections collected; a case without any keeps an empty list."""
    hop = case_section.join(vertices.select("section_id", "act"), "section_id").select("case_id", F.struct("section_id", "act").alias("s"))
    grouped = hop.groupBy("case_id").agg(F.array_sort(F.collect_set("s")).alias("sections"))
    return cases.select("case_id").join(grouped, "case_id", "left").withColumn("n", F.coalesce(F.size("sections"), F.lit(0)))


def collected_related(case_section: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """Each case's sections with up to ``k`` related ones collected; sections without any keep an empty list."""
    order = Window.partitionBy("a").orderBy("b")
    near = both_ways(edges).select("a", "b").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    lists = near.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("related"))
    return case_section.join(lists, F.col("section_id") == F.col("a"), "left").select("case_id", "section_id", F.coalesce("related", F.array().cast("array<bigint>")).alias("related"))


def find_entity(vertices: DataFrame, text: str, k: int) -> DataFrame:
    """Vertices whose id or name contains a text."""
    return vertices.filter(F.col("section_id").cast("string").contains(text) | F.lower("title").contains(text.lower())).orderBy("section_id").limit(k)


def most_referenced(case_section: DataFrame, k: int) -> DataFrame:
    """Sections by how many cases refer to them."""
    return case_section.groupBy("section_id").agg(F.count(F.lit(1)).alias("n_cases")).orderBy(F.desc("n_cases"), "section_id").limit(k)


def co_occurrence(case_section: DataFrame, k: int | None = None) -> DataFrame:
    """Pairs of sections by the cases they share, counted in as many partitions as the input calls for."""
    pairs = spread(section_pairs(case_section).select("src", "dst"), "src", "dst", source=case_section).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_cases"))
    return pairs if k is None else pairs.orderBy(F.desc("n_cases"), "src", "dst").limit(k)


def contradictions_by_severity(rows: DataFrame, severities: tuple[str, ...]) -> DataFrame:
    """Contradictions of some severities, surest first."""
    return rows.filter(F.col("severity").isin(*severities)).orderBy(F.desc("confidence"), "contradiction_id")


def graph_view(vertices: DataFrame, edges: DataFrame, contains: str = "", label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices by name and label, and the edges with both ends among them."""
    seen = vertices.filter(F.lower("title").contains(contains.lower()))
    if label is not None:
        seen = seen.filter(F.col("act") == label)
    ids = seen.select(F.col("section_id").alias("id"))
    shown = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")
    return seen, shown


def merge_vertices(existing: DataFrame, new: DataFrame, key: str, latest: str) -> DataFrame:
    """New rows, the latest of each key, in front of existing ones."""
    order = Window.partitionBy(key).orderBy(F.desc(latest))
    newest = new.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return existing.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def merge_edges(edges: DataFrame, vertices: DataFrame, order_by: str) -> DataFrame:
    """Edges with both ends known, types sanitised, the last of each (src, dst, type)."""
    ids = vertices.select(F.col("section_id").alias("id"))
    kept = edges.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi").withColumn("type", edge_type(F.col("type")))
    last = Window.partitionBy("src", "dst", "type").orderBy(F.desc(order_by))
    return kept.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
