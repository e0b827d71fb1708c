"""Queries of cleaning, chunking, lexical and vector search and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions import text as T
from lexquarry.operators import chunking as K
from lexquarry.operators import containment as N
from lexquarry.operators import evaluation as E
from lexquarry.operators import inverted as I
from lexquarry.operators import lexical as B
from lexquarry.operators import retrieval as R
from lexquarry.operators import vectors as V
from lexquarry.plans.storage import written
from lexquarry.plans.views import view
from lexquarry.queries.base import ORACLE_SQL, QUERIES, query
from lexquarry.sources import files as S

C = F.col


# ---- cleaning ---------------------------------------------------------------
def _replaced(expression: str, *pairs: tuple[str, str]) -> str:
    for pattern, by in pairs:
        expression = f"regexp_replace({expression}, '{pattern}', '{by}', 'g')"
    return expression


def _encoding_sql(column: str = "text") -> str:
    out = f"translate({column}, '{T.ONE_FOR_ONE[0]}', '{T.ONE_FOR_ONE[1].replace(chr(39), chr(39) * 2)}')"
    for old, new in T.LONGER:
        out = f"replace({out}, '{old}', '{new}')"
    return out


_CLEAN_SQL = _replaced(
    _encoding_sql(),
    *[(p, "") for p in (*T.PAGE_NUMBER_LINES, *T.HEADER_LINES)],
    (r"[ \t]+", " "), (r"(?m)^[ \t\r\f]+", ""), (r"(?m)[ \t\r\f]+$", ""), (r"\n{3,}", "\n\n"), (r"(?m)^\s*[-_=]{3,}\s*$", ""), (r"(\w+)-\n(\w+)", r"\1\2"), (r"^\s+", ""), (r"\s+$", ""),
)
_TOKENS_SQL = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s\-/]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\d+'))"


@query("clean_text_stats", "documents", sql=f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE {_CLEAN_SQL} END AS c FROM documents)")
def _(docs):
    return docs.select("doc_id", T.clean_text(C("text")).alias("c")).select("doc_id", F.length("c").alias("n"), F.md5("c").alias("digest"))


@query("encoding_fix", "documents", sql=f"SELECT doc_id, md5({_encoding_sql()}) AS digest FROM documents")
def _(docs):
    return docs.select("doc_id", F.md5(T.fix_encoding(C("text"))).alias("digest"))


@query("join_lines", "documents", sql=r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS digest FROM documents")
def _(docs):
    return docs.select("doc_id", F.md5(T.join_lines(C("text"))).alias("digest"))


@query("min_length_filter", "documents", sql=f"SELECT lang, count(*) AS n FROM (SELECT lang, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE {_CLEAN_SQL} END AS c FROM documents) WHERE length(c) >= 100 GROUP BY lang")
def _(docs):
    return docs.filter(F.length(T.clean_text(C("text"))) >= 100).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("short_pieces_dropped", "documents", sql="SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE length(trim(line)) >= 10 GROUP BY 1")
def _(docs):
    """Pieces of under ten characters, stripped, are dropped."""
    pieces = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return T.long_enough(pieces, "line", 10).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("needs_ocr_flag", "documents", sql="SELECT doc_id, CASE WHEN 1 + n_chars // 2000 > 0 THEN length(trim(coalesce(text, ''))) < 50 * (1 + n_chars // 2000) ELSE false END AS needs_ocr FROM documents")
def _(docs):
    return docs.select("doc_id", T.needs_ocr(C("text"), 1 + F.floor(C("n_chars") / 2000)).alias("needs_ocr"))


@query("text_choice", "documents", "benchmark", sql="SELECT doc_id, md5(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN text END, ''), CASE WHEN doc_id % 3 = 1 THEN 'Q: ' || lang || chr(10) || 'A: ' || source END, nullif(source, ''), '')) AS digest, length(CASE WHEN length(text) > length(source) THEN text ELSE source END) AS longer FROM documents")
def _(docs, _b):
    t, q = F.when(C("doc_id") % 3 == 0, C("text")), F.when(C("doc_id") % 3 == 1, C("lang"))
    return docs.select("doc_id", F.md5(T.text_of(t, q, F.when(C("doc_id") % 3 == 1, C("source")), C("source"))).alias("digest"), F.length(T.longer_of(C("text"), C("source"))).alias("longer"))


@query("title_from_file", "documents", sql="SELECT doc_id, array_to_string(list_transform(string_split(replace(source || '_' || lang || '-part', '_', ' ').replace('-', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM documents")
def _(docs):
    return docs.select("doc_id", T.title_of(F.concat("source", F.lit("_"), "lang", F.lit("-part.pdf"))).alias("title"))


@query("html_to_text", "pages", sql="SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest, regexp_replace(url, '[^\\w\\-_.]', '_', 'g')[1:60] || '_' || page_id AS file FROM pages")
def _(pages):
    return pages.select("page_id", F.md5(S.html_text(C("html"))).alias("digest"), T.file_title(C("url"), C("page_id").cast("string")).alias("file"))


@query("near_dup_key", "documents", sql=r"SELECT lower(trim(regexp_replace(text[1:120], '\s+', ' ', 'g'))) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1")
def _(docs):
    return docs.select("doc_id", T.near_dup_key(C("text")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("section_split", "judgments", sql="SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 2 THEN 4 ELSE 3 END AS n_sections, CASE WHEN o_orderkey % 4 = 2 THEN CAST(year(o_orderdate) AS STRING) || ',' ELSE '' END || '1,2,3' AS numbers FROM orders")
def _(docs):
    return docs.select("doc_id", T.sections_of(C("text")).alias("s")).select("doc_id", F.size("s").alias("n_sections"), F.array_join(F.transform("s", lambda x: x["section_number"]), ",").alias("numbers"))


# ---- chunking ---------------------------------------------------------------
@query("sentence_split", "documents", sql=r"SELECT doc_id, len(s) AS n, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::BIGINT AS chars FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]'), lambda x: trim(x)), lambda x: length(x) > 15) AS s FROM documents)")
def _(docs):
    s = T.sentences(C("text"), 15)
    return docs.select("doc_id", F.size(s).alias("n"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("line_chunks", "documents", sql="SELECT doc_id, i - 1 AS line_index, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE [text] END AS l FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 30) AS k FROM documents)))")
def _(docs):
    return K.line_chunks(docs).select("doc_id", "line_index", F.md5("line").alias("digest"))


@query("fixed_chunks", "documents", sql="SELECT doc_id, i AS chunk_index, md5(text[i * 800 + 1 : i * 800 + 1000]) AS digest FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0) // 800)) AS i FROM documents WHERE length(text) > 0)")
def _(docs):
    return K.fixed_chunks(docs).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query("chunk_stats", "documents", sql="SELECT doc_id, count(*) AS n_chunks, round(avg(length(text[i * 800 + 1 : i * 800 + 1000])), 6) AS mean_chars FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0) // 800)) AS i FROM documents WHERE length(text) > 0) GROUP BY doc_id")
def _(docs):
    return K.chunk_stats(K.fixed_chunks(docs))


@query("chunk_documents", "documents")
def _(docs):
    return K.chunk_documents(docs.select("doc_id", "source", T.clean_text(C("text")).alias("text")))


@query("recursive_chunks", "documents")
def _(docs):
    return K.recursive_chunks(docs)


@query("recursive_token_chunks", "documents")
def _(docs):
    return K.recursive_chunks(docs, by_tokens=True)


@query("page_chunks", "documents")
def _(docs):
    pages = F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(1500)), lambda i: F.substring(C("text"), i + 1, F.lit(1500)))
    return K.chunk_pages(docs.select(F.concat("source", F.lit("_"), "doc_id").alias("filename"), pages.alias("pages")))


@query("pages_from_footers", "documents", sql=r"SELECT doc_id, i AS page, md5(trim(regexp_replace(replace(text, chr(10), ' ')[(i - 1) * 1500 + 1 : i * 1500], '\s+', ' ', 'g'))) AS digest FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) // 1500 + 1)) AS i FROM documents)")
def _(docs):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    pages = F.transform(F.sequence(F.lit(1), F.floor(F.length("text") / 1500).cast("int") + 1), lambda i: F.concat(F.substring(flat, (i - 1) * 1500 + 1, F.lit(1500)), F.lit("\nFooter page "), i))
    paged = docs.select("doc_id", F.array_join(pages, "\n").alias("text"))
    return _pages(docs, paged)


def _pages(docs, paged):
    last = docs.select("doc_id", (F.floor(F.length("text") / 1500) + 1).alias("last"))
    return K.pages_of(paged, r"^Footer page (\d+)$").join(last, "doc_id").filter(C("page") <= C("last")).select("doc_id", "page", F.md5("text").alias("digest"))


# ---- lexical ----------------------------------------------------------------
@query("tokenize_df", "documents", sql=f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def _(docs):
    return B.document_frequency(B.postings(docs))


_BM25_SQL = f"""WITH d AS (SELECT doc_id, text, {_TOKENS_SQL} AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS raw FROM documents),
 st AS (SELECT count(*) AS n, avg(raw) AS mean FROM d), p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d),
 tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({_TOKENS_SQL}) AS term FROM queries) GROUP BY ALL),
 sc AS (SELECT query_id, doc_id, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10"""


@query("bm25_topk", "documents", "queries", sql=_BM25_SQL)
def _(docs, queries):
    return B.bm25(docs, queries).select("query_id", "doc_id", "score", "rank")


@query("bm25_index_topk", "documents", "queries", sql=_BM25_SQL)
def _(docs, queries):
    """Through a stored index, whose blocks are read as far as they can matter."""
    return I.search(I.build_index(docs), queries)


_RAW_QUERY = "the tion of that ing stea"
_RAW_SQL = _BM25_SQL.replace("FROM queries", f"FROM (SELECT 0 AS query_id, '{_RAW_QUERY}' AS text)")


@query("raw_text_search", "documents", sql=_RAW_SQL)
def _(docs):
    """One query over texts that have no index."""
    return B.search_texts(docs, _RAW_QUERY).select("query_id", "doc_id", "score", "rank")


@query("keywords_top20", "documents", sql="""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{5,}')) AS w FROM documents),
 c AS (SELECT doc_id, w[i] AS word, count(*) AS n, min(i) AS pos FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w) WHERE w[i] NOT IN (
 'about', 'above', 'after', 'again', 'against', 'because', 'before', 'being', 'below', 'between', 'cannot', 'could', 'doing', 'during', 'further', 'having', 'herself', 'himself', 'itself', 'myself', 'other', 'ought', 'ourselves',
 'should', 'their', 'theirs', 'themselves', 'there', 'these', 'those', 'through', 'under', 'until', 'where', 'which', 'while', 'would', 'yours', 'yourself', 'yourselves', 'shall', 'court', 'judgment', 'plaintiff', 'defendant',
 'petitioner', 'respondent', 'appeal', 'sections', 'section', 'article') GROUP BY 1, 2)
 SELECT doc_id, upper(word[1]) || word[2:] AS keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c) WHERE rank <= 20
 UNION ALL SELECT doc_id, f.keyword, 0, f.rank FROM documents, (VALUES ('Judgment', 1), ('Appeal', 2), ('Defendant', 3), ('Petitioner', 4), ('Court', 5)) f(keyword, rank) WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def _(docs):
    return B.keywords(docs)


# ---- vectors ----------------------------------------------------------------
@query("l2_norm", "embeddings", sql="SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def _(points):
    unit = points.select("vec_id", V.normalized(C("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


def _topk_sql(where: str = "true") -> str:
    return f"""SELECT query_id, vec_id, score, rank FROM (SELECT q.vec_id AS query_id, p.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) DESC, p.vec_id) AS rank
 FROM embeddings q, embeddings p WHERE q.vec_id % 50 = 0 AND {where}) WHERE rank <= 10"""


def _asked(points: DataFrame) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 50."""
    return points.filter("vec_id % 50 = 0").select(C("vec_id").alias("query_id"), "embedding")


@query("cosine_batch_topk", "embeddings", sql=_topk_sql())
def _(points):
    return V.top_k(points, _asked(points)).select("query_id", "vec_id", "score", "rank")


@query("cosine_topk_filtered", "embeddings", sql=_topk_sql("p.label = 3"))
def _(points):
    return V.top_k(points, _asked(points), where={"label": 3}).select("query_id", "vec_id", "score", "rank")


@query("vector_retriever", "embeddings", sql=f"SELECT query_id, vec_id, rank, 'vector' AS retriever FROM ({_topk_sql()})")
def _(points):
    return V.vector_hits(points, _asked(points), 10).select("query_id", "vec_id", "rank", "retriever")


@query("ann_recall", "embeddings")
def _(points):
    exact, near = V.top_k(points, _asked(points)), V.ann_cells(points, _asked(points))
    found = exact.join(near.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    return exact.select("query_id").distinct().join(found, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / 10).alias("recall"))


@query("embed_chunks", "documents")
def _(docs):
    return V.embed(K.fixed_chunks(docs), prefix=V.QUERY_PREFIX).select("doc_id", "chunk_index", F.size("embedding").alias("width"))


# ---- retrieval --------------------------------------------------------------
_CUED = "SELECT query_id, CASE query_id % 6 WHEN 0 THEN 'which section of the act' WHEN 1 THEN 'Supreme Court ruling held that' WHEN 2 THEN 'bail and arrest procedure' WHEN 3 THEN 'best strategy for settlement' WHEN 4 THEN 'summary of the facts' ELSE 'plain words' END || ' ' || text[1:40] AS text FROM queries"


def _cued(queries: DataFrame) -> DataFrame:
    cue = F.element_at(F.array(*map(F.lit, ("which section of the act", "Supreme Court ruling held that", "bail and arrest procedure", "best strategy for settlement", "summary of the facts", "plain words"))), (C("query_id") % 6 + 1).cast("int"))
    return queries.select("query_id", F.concat_ws(" ", cue, F.substring("text", 1, 40)).alias("text"))


def _intent_sql() -> str:
    scores = {n: "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f") / {len(words)}.0" for n, words in R.INTENTS.items()}
    best = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {s} = {best} THEN '{n}'" for n, s in scores.items())
    return f"CASE WHEN {best} < 0.05 THEN 'general' {cases} END"


@query("intent_score", "queries", sql=f"SELECT query_id, {_intent_sql()} AS intent FROM ({_CUED})")
def _(queries):
    return _cued(queries).select("query_id", R.detect_intent(C("text")).alias("intent"))


@query("retriever_weights", "queries", sql="SELECT query_id, r AS retriever, CASE r WHEN 'vector' THEN {v} WHEN 'kg' THEN {g} WHEN 'citation' THEN {c} ELSE {k} END AS weight FROM (SELECT query_id, {i} AS intent FROM ({q})), (SELECT unnest(['vector', 'kg', 'citation', 'keyword']) AS r)".format(
    i=_intent_sql(), q=_CUED, **{s: "CASE intent " + " ".join(f"WHEN '{n}' THEN {w[r]}::DOUBLE" for n, w in R.WEIGHTS.items()) + " END" for s, r in (("v", "vector"), ("g", "kg"), ("c", "citation"), ("k", "keyword"))}))
def _(queries):
    rows = _cued(queries).select("query_id", R.detect_intent(C("text")).alias("intent"), F.explode(F.array(*map(F.lit, ("vector", "kg", "citation", "keyword")))).alias("retriever"))
    return rows.select("query_id", "retriever", R.weight_of(C("intent"), C("retriever")).alias("weight"))


@query("query_variants", "queries", sql=f"""SELECT query_id, nth, variant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS nth FROM (SELECT query_id, v[i] AS variant, i AS pos, row_number() OVER (PARTITION BY query_id, lower(v[i]) ORDER BY i) AS n
 FROM (SELECT query_id, v, unnest(generate_series(1, len(v))) AS i FROM (SELECT query_id, list_filter([trim(text), CASE WHEN NOT contains(lower(text), 'section') THEN text || ' applicable legal section' END, text || ' precedent case law judgment',
 {', '.join(f"CASE WHEN NOT contains(lower(text), '{a.lower()}') THEN text || ' {a}' END" for a in R.ACT_SUFFIXES)},
 CASE WHEN len(f) < len(w) THEN array_to_string(f, ' ') END], lambda x: x IS NOT NULL) AS v
 FROM (SELECT query_id, text, regexp_split_to_array(trim(text), '\\s+') AS w, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: lower(x) NOT IN {T.STOP_WORDS}) AS f FROM ({_CUED})))) WHERE length(v[i]) > 3) WHERE n = 1) WHERE nth <= 5""")
def _(queries):
    return R.variants(_cued(queries))


# The same on the whole texts of the queries; the three above hold the operators against SQL on short texts with a cue.
def _whole(name: str, of) -> None:
    QUERIES[f"{name}_whole"] = lambda spark, sf_dir: of(view(spark, sf_dir, "queries"))
    ORACLE_SQL[f"{name}_whole"] = ORACLE_SQL[name].replace(_CUED, "SELECT query_id, text FROM queries")


_whole("intent_score", lambda queries: queries.select("query_id", R.detect_intent(C("text")).alias("intent")))
_whole("query_variants", R.variants)


def _weights(queries: DataFrame) -> DataFrame:
    rows = queries.select("query_id", R.detect_intent(C("text")).alias("intent"), F.explode(F.array(*map(F.lit, ("vector", "kg", "citation", "keyword")))).alias("retriever"))
    return rows.select("query_id", "retriever", R.weight_of(C("intent"), C("retriever")).alias("weight"))


_whole("retriever_weights", _weights)


_HITS_SQL = """h AS (SELECT query_id, doc_key, 'a' AS retriever, q AS score, row_number() OVER (PARTITION BY query_id ORDER BY q DESC, doc_key) AS rank, 0.6 AS weight FROM (SELECT l_suppkey AS query_id, l_partkey AS doc_key, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
 UNION ALL SELECT query_id, doc_key, 'b', n::DOUBLE, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_key), 0.4 FROM (SELECT l_suppkey AS query_id, l_partkey AS doc_key, count(*) AS n FROM lineitem GROUP BY 1, 2))"""


@query("rrf_merge", "lineitem", sql=f"WITH {_HITS_SQL} SELECT query_id, doc_key, round(sum(weight / (60 + rank)), 9) AS rrf, array_to_string(list_sort(list_distinct(list(retriever))), ',') AS sources FROM h WHERE rank <= 20 GROUP BY 1, 2")
def _(lines):
    def ranked(value, name, weight):
        rows = lines.groupBy(C("l_suppkey").alias("query_id"), C("l_partkey").alias("doc_key")).agg(value.alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key")
        return rows.select("*", F.row_number().over(order).alias("rank"), F.lit(name).alias("retriever"), F.lit(weight).alias("weight"), F.lit("").alias("text")).filter("rank <= 20")

    hits = ranked(F.sum("l_quantity"), "a", 0.6).unionByName(ranked(F.count(F.lit(1)).cast("double"), "b", 0.4))
    return R.fuse(hits).select("query_id", "doc_key", "rrf", F.array_join("matched_sources", ",").alias("sources"))


@query("term_overlap_rerank", "documents", "queries", sql=r"""WITH t AS (SELECT doc_id, query_id, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '\s+'), lambda w: w <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda w: w <> '')) AS t FROM documents d JOIN queries q ON d.doc_id % 40 = q.query_id)
SELECT doc_id, query_id, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS overlap FROM t""")
def _(docs, queries):
    rows = docs.join(queries.withColumnRenamed("text", "q"), C("doc_id") % 40 == C("query_id"))
    return rows.select("doc_id", "query_id", F.round(R.term_overlap(C("q"), C("text")), 6).alias("overlap"))


@query("rerank_hits", "documents", "queries")
def _(docs, queries):
    """R14 over the fused BM25 hits of every query; term_overlap_rerank only holds the overlap itself against SQL."""
    hits = B.bm25(docs, queries, 20).join(docs.select("doc_id", "text"), "doc_id")
    hits = hits.withColumnsRenamed({"doc_id": "doc_key"}).withColumns({"retriever": F.lit("keyword"), "weight": F.lit(1.0)})
    return R.rerank(R.fuse(hits), queries).select("query_id", "doc_key", "final", "rank")


@query("position_decay", "sections", sql="SELECT section_id, round(greatest(0.0, 0.9 - 0.02 * (row_number() OVER (PARTITION BY act ORDER BY section_id) - 1))::DOUBLE, 6) AS score FROM sections")
def _(sections):
    order = Window.partitionBy("act").orderBy("section_id")
    return sections.select("section_id", F.round(R.decay(F.row_number().over(order)), 6).alias("score"))


def _hybrid(queries: DataFrame, docs: DataFrame, sections: DataFrame, edges: DataFrame) -> DataFrame:
    """R16 with all four retrievers; without a model at hand the vectors are pseudo-embeddings of the chunks' and queries' texts."""
    chunks = V.embed(K.fixed_chunks(docs)).select(F.concat(F.lit("doc:"), "doc_id").alias("doc_key"), "text", "embedding")
    return R.hybrid_search(queries, docs, sections, V.text_hits(queries, chunks, 30), 10, edges)


@query("hybrid_search", "queries", "documents", "sections", "edges")
def _(queries, docs, sections, edges):
    return _hybrid(queries, docs, sections, edges).select("query_id", "doc_key", "final", "rank", F.array_join("matched_sources", ",").alias("sources"))


@query("pipeline_stats", "queries", "documents", "sections", "edges")
def _(queries, docs, sections, edges):
    return R.search_stats(_hybrid(queries, docs, sections, edges))


@query("citation_misses", "queries", "sections", sql="SELECT query_id, 'Citation: Section ' || (query_id + 900) || ' of Indian Penal Code' AS text, 1 AS rank, 1.0::DOUBLE AS score FROM queries")
def _(queries, sections):
    """A citation that no section answers keeps a row of its own."""
    asked = queries.select("query_id", F.concat(F.lit("liable under Section "), C("query_id") + 900, F.lit(" of the IPC")).alias("text"))
    return R.citation_hits(asked, sections).filter("section_id is null").filter(C("text").contains("Penal")).select("query_id", "text", "rank", "score")


@query("graph_retriever", "queries", "sections", "edges", sql="""WITH q AS (SELECT query_id, CAST(query_id % 50 + 1 AS STRING) AS number FROM queries), f AS (SELECT query_id, section_id FROM (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY section_id) AS n FROM q JOIN sections ON contains(section_number, number)) WHERE n <= 3),
 b AS (SELECT a, b, type, row_number() OVER (PARTITION BY a ORDER BY b, type) AS n FROM (SELECT src AS a, dst AS b, type FROM edges UNION ALL SELECT dst, src, type FROM edges)),
 h AS (SELECT query_id, section_id AS via, 0 AS near, section_id FROM f UNION ALL SELECT DISTINCT query_id, f.section_id, 1, b FROM f JOIN b ON a = f.section_id JOIN sections s ON s.section_id = b WHERE n <= 5),
 o AS (SELECT query_id, via, near, section_id, row_number() OVER (PARTITION BY query_id, section_id ORDER BY via, near) AS k FROM h)
 SELECT query_id, section_id, rank, round(greatest(0.0, 0.9 - 0.02 * (rank - 1))::DOUBLE, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY via, near, section_id) AS rank FROM o WHERE k = 1) WHERE rank <= 20""")
def _(queries, sections, edges):
    """The sections that a query names with their neighbours behind them."""
    asked = queries.select("query_id", F.concat(F.lit("see Section "), C("query_id") % 50 + 1).alias("text"))
    return R.graph_hits(asked, sections, edges).select("query_id", "section_id", "rank", F.round("score", 6).alias("score"))


@query("context_blocks", "conversations", sql="SELECT conv_id AS query_id, md5(string_agg('Source (Page ' || turn || '): ' || coalesce(text, ''), chr(10) || '---' || chr(10) ORDER BY turn)) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) WHERE rank <= 5 GROUP BY 1")
def _(turns):
    order = Window.partitionBy("conv_id").orderBy("turn")
    hits = turns.select(C("conv_id").alias("query_id"), C("turn").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).alias("rank"))
    return R.context_blocks(hits).select("query_id", F.md5("context").alias("digest"))


@query("citation_extract", "part", sql="SELECT p_partkey AS query_id, CAST(p_size AS STRING) AS section_number, 'Indian Penal Code' AS act FROM part UNION ALL SELECT p_partkey, CAST(p_partkey AS STRING), 'Bharatiya Nyaya Sanhita' FROM part UNION ALL SELECT p_partkey, '21', 'Constitution of India' FROM part")
def _(parts):
    text = F.concat(F.lit("Section "), "p_size", F.lit(" of the IPC, then BNS Section "), "p_partkey", F.lit("; and Article 21 with Section "), "p_size", F.lit(" IPC"))
    return R.citations(parts.select(C("p_partkey").alias("query_id"), text.alias("text"))).select("query_id", "section_number", "act")


@query("citation_lookup", "queries", "sections", sql="SELECT query_id, section_id, rank FROM (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY section_id) AS rank FROM queries JOIN sections ON section_number = CAST(query_id % 50 + 1 AS STRING)) WHERE rank <= 5")
def _(queries, sections):
    asked = queries.select("query_id", F.concat(F.lit("liable under section "), C("query_id") % 50 + 1).alias("text"))
    return R.citation_hits(asked, sections).filter("section_id is not null").select("query_id", "section_id", "rank")


@query("section_lookup", "queries", "sections", sql="SELECT query_id, section_id FROM (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY section_id) AS n FROM queries JOIN sections ON contains(section_number, CAST(query_id % 50 + 1 AS STRING))) WHERE n <= 3")
def _(queries, sections):
    return R.section_lookup(queries.select("query_id", (C("query_id") % 50 + 1).cast("string").alias("number")), sections).select("query_id", "section_id")


@query("section_neighbours", "sections", "edges", sql="SELECT section_id, neighbour, type FROM (SELECT a AS section_id, b AS neighbour, type, row_number() OVER (PARTITION BY a ORDER BY b, type) AS n FROM (SELECT src AS a, dst AS b, type FROM edges UNION ALL SELECT dst, src, type FROM edges) JOIN sections ON a = section_id) WHERE n <= 5")
def _(sections, edges):
    return R.neighbours(sections.select("section_id"), edges)


@query("section_text_search", "sections", sql="SELECT section_id, title FROM sections WHERE contains(lower(title), '1') OR contains(lower(text), '1') ORDER BY section_id LIMIT 20")
def _(sections):
    return R.text_search(sections, "1", 20).select("section_id", "title")


@query("section_text_hits", "sections", sql="""WITH q AS (SELECT section_id AS query_id, CASE WHEN section_id % 4 = 0 THEN upper(title) WHEN section_id % 4 = 1 THEN text[3:9] WHEN section_id % 4 = 2 THEN text[2:3] ELSE 'no such words' END AS needle FROM sections)
 SELECT query_id, section_id, rank, round(greatest(0.0, 0.9 - 0.02 * (rank - 1)), 6)::DOUBLE AS score FROM (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY section_id) AS rank FROM q JOIN sections s ON contains(lower(s.title), lower(needle)) OR contains(lower(s.text), lower(needle))) WHERE rank <= 20""")
def _(sections):
    """R06 for a table of queries: pieces of every section's text, two characters to whole titles."""
    n = C("section_id") % 4
    asked = F.when(n == 0, F.upper("title")).when(n == 1, F.substring("text", 3, 7)).when(n == 2, F.substring("text", 2, 2)).otherwise("no such words")
    hits = R.section_text_hits(sections.select(C("section_id").alias("query_id"), asked.alias("text")), sections)
    return hits.select("query_id", "section_id", "rank", F.round("score", 6).alias("score"))


_QRELS = r"SELECT query_id, doc_id FROM (SELECT query_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM queries) q JOIN (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents) d ON contains(t, p)"


@query("qrels", "documents", "queries", sql=_QRELS)
def _(docs, queries):
    """Which documents contain which whole passages."""
    return N.passages_held(docs, queries)


@query("lexical_relevance", "documents", "queries", sql=f"""WITH b AS ({_BM25_SQL}), r AS ({_QRELS}), w AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1), h AS (SELECT b.query_id, b.rank FROM b JOIN r ON r.query_id = b.query_id AND r.doc_id = b.doc_id)
 SELECT q.query_id, round(coalesce((SELECT count(*) FROM h WHERE h.query_id = q.query_id) / w.n, 0), 6)::DOUBLE AS recall, round(coalesce(1.0 / (SELECT min(rank) FROM h WHERE h.query_id = q.query_id), 0), 6)::DOUBLE AS rr,
 round(coalesce((SELECT sum(1 / log2(rank + 1)) FROM h WHERE h.query_id = q.query_id) / (SELECT sum(1 / log2(i + 1)) FROM generate_series(1, least(w.n, 10)) t(i)), 0), 6)::DOUBLE AS ndcg FROM (SELECT DISTINCT query_id FROM b) q LEFT JOIN w ON w.query_id = q.query_id""")
def _(docs, queries):
    """E01, E03, E04 of lexical search with containment as relevance."""
    return _relevance(B.bm25(docs, queries).select("query_id", "doc_id", "rank"), N.passages_held(docs, queries))


def _relevance(got: DataFrame, relevant: DataFrame) -> DataFrame:
    got, relevant = written(got, "got"), written(relevant, "relevant")
    scored = E.recall_precision(got, relevant).join(E.reciprocal_rank(got, relevant), "query_id").join(E.ndcg(got, relevant.withColumn("gain", F.lit(1.0))), "query_id")
    return scored.select("query_id", "recall", "rr", "ndcg")


@query("hybrid_relevance", "queries", "documents", "sections", "edges")
def _(queries, docs, sections, edges):
    """The same of hybrid search; a document of a near copy's key counts as itself."""
    got = _hybrid(queries, docs, sections, edges).filter("doc_key like 'doc:%'").select("query_id", F.substring("doc_key", 5, 20).cast("long").alias("doc_id"), "rank")
    return _relevance(got, N.passages_held(docs, queries))


@query("hit_classes", "documents", sql="SELECT CASE WHEN (doc_id % 3 = 0 OR contains(lower(source || CASE WHEN doc_id % 5 = 0 THEN '_vs_x' ELSE '' END), '_vs_')) AND doc_id % 2 = 0 THEN 'precedent' ELSE 'statute' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def _(docs):
    kind = R.hit_kind(F.when(C("doc_id") % 3 == 0, "judgment").otherwise("act"), F.when(C("doc_id") % 2 == 0, "").otherwise("IPC"), F.concat("source", F.when(C("doc_id") % 5 == 0, "_vs_x").otherwise("")))
    return docs.select(kind.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("direct_mentions", "judgments", sql="SELECT doc_id, CAST(doc_id % 50 + 1 AS STRING) AS section_number FROM judgments UNION SELECT doc_id, CAST(doc_id % 90 + 1 AS STRING) FROM judgments")
def _(docs):
    return R.direct_mentions(docs).select("doc_id", "section_number")


@query("research_sections", "case_section", "sections", sql="SELECT case_id AS doc_id, section_number, act, nth FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS nth FROM (SELECT case_id, section_number, act, min(section_id) AS pos FROM case_section JOIN sections USING (section_id) GROUP BY 1, 2, 3)) WHERE nth <= 12")
def _(links, sections):
    rows = links.join(sections, "section_id").select(C("case_id").alias("doc_id"), "section_number", "act", C("section_id").alias("pos"))
    return R.research_sections(rows)


@query("research_confidence", "orders", sql="SELECT o_orderkey AS case_id, CAST(CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 3 > 0 THEN 0.98 WHEN o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 THEN 0.975 WHEN o_orderkey % 4 > 0 OR o_orderkey % 5 > 0 OR o_orderkey % 3 > 0 THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence FROM orders")
def _(orders):
    return orders.select(C("o_orderkey").alias("case_id"), R.research_confidence(C("o_orderkey") % 4, C("o_orderkey") % 5, C("o_orderkey") % 3).cast("double").alias("confidence"))


@query("case_context", "documents", sql="SELECT source AS case_id, md5(string_agg('DOC ' || rn || ': ' || text[1:1000], chr(10) || chr(10) ORDER BY rn)) AS digest FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3 GROUP BY 1")
def _(docs):
    return R.case_context(docs.select(C("source").alias("case_id"), "doc_id", "text"), label=True).select("case_id", F.md5("context").alias("digest"))
