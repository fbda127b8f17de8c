"""Queries of the retrieval kernel over ``documents``, ``embeddings`` and, as questions, ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import postings as P
from quarrylight.operators import retrieval as R
from quarrylight.queries.base import query, read, sql_list
from quarrylight.shared import kept, saved

TOK = r"list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_\-]{{1,}}'), lambda x: lower(x))"
QTERMS = (
    r"list_distinct_ordered(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_\-'']{{1,}}'), lambda x: trim(lower(x), '''')), lambda t: length(t) >= 3 AND NOT list_contains(STOP, t)))"
).replace("STOP", sql_list(T.QUERY_STOPWORDS).replace("{", "{{"))


def ordered_distinct(sql: str) -> str:
    """``list_distinct_ordered(x)`` spelled out for DuckDB: list_distinct() loses the order of first use."""
    mark = "list_distinct_ordered("
    while mark in sql:
        a = sql.index(mark)
        depth, z = 1, a + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[z], 0)
            z += 1
        inner = sql[a + len(mark) : z - 1]
        sql = sql[:a] + f"list_reduce(list_prepend(list_value()::VARCHAR[], list_transform({inner}, lambda y: [y])), lambda acc, y: CASE WHEN list_contains(acc, y[1]) THEN acc ELSE list_concat(acc, y) END)" + sql[z:]
    return sql


def qterms_sql(x: str) -> str:
    return ordered_distinct(QTERMS.format(x))


NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"

POSTINGS = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) GROUP BY ALL"

BM25 = f"""
WITH tok AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format('text')}) AS term FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT qid, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / greatest(1.0, avgdl)))) AS bm25
  FROM tf JOIN q USING (term) JOIN df USING (term), stats GROUP BY qid, doc_id),
lex AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 5) DESC, doc_id) AS rank
  FROM (SELECT qid, doc_id, bm25, round(least(1.0, bm25 / 8), 6) AS score FROM scores))
"""

COS = "greatest(0.0, least(1.0, coalesce(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / nullif(sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 0), 0.0)))"
DENSE = f"""
dense AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS qid, e.vec_id, round({COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0))
"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


#: Indexes of this session by the files that they were made of.
_indexes: dict[tuple, P.PostingsIndex] = {}


def index_of(spark: SparkSession, sf_dir: str) -> P.PostingsIndex:
    """The stored index of ``documents``: made once for these files as they are, then used by every query."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = raw.select(F.max("_metadata.file_modification_time")).collect()[0][0]
    key = (spark.sparkContext.applicationId, changed, *sorted(raw.inputFiles()))
    if key not in _indexes or not kept(spark, _indexes[key].path):
        _indexes[key] = P.build(read(spark, sf_dir, "documents"))
    return _indexes[key]


def lexical(spark: SparkSession, sf_dir: str, q: DataFrame, k: int, threshold: float = 0.0, floor: float = 0.05) -> DataFrame:
    """As R.lexical() over ``documents``, from the stored index. Found rows are written, and sent to all tasks if they are few, so that no text is shuffled to meet them."""
    found = saved(index_of(spark, sf_dir).topk(q, k).hits, "hits")
    found = F.broadcast(found) if found.count() <= R.MOST_TERMS else found
    return R.hits(found.withColumn("doc_id", F.col("doc_id").cast("long")), threshold, floor)


@query("inverted_index_postings", POSTINGS)
def inverted_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.postings(read(spark, sf_dir, "documents"))


@query("term_df", f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM ({POSTINGS}) GROUP BY term")
def term_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_df(R.postings(read(spark, sf_dir, "documents")))


@query("lexical_index_stats", f"SELECT count(*) AS n_docs, round(avg(dl), 6) AS avgdl, sum(dl)::BIGINT AS n_tokens FROM (SELECT len({TOK.format('text')}) AS dl FROM documents)")
def lexical_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index_stats(read(spark, sf_dir, "documents")).withColumn("avgdl", F.round("avgdl", 6))


@query("bm25_scores", BM25 + "SELECT qid, doc_id, round(bm25, 5) AS bm25 FROM scores")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(read(spark, sf_dir, "documents"), questions(spark, sf_dir)).withColumn("bm25", F.round("bm25", 5))


@query("bm25_topk", BM25 + "SELECT qid, rank::INT AS rank, doc_id, score, 'S' || rank AS label FROM lex WHERE rank <= 10 AND score >= 0.05")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.labelled(lexical(spark, sf_dir, questions(spark, sf_dir), 10))


#: One source's documents are deleted, another's are replaced by their text and the source's name.
CHANGED = "SELECT doc_id, CASE WHEN source = 'src3' THEN text || ' ' || source || ' revised' ELSE text END AS text FROM documents WHERE source IS DISTINCT FROM 'src2'"


@query("bm25_after_changes", BM25.replace("FROM documents)", "FROM now)").replace("WITH tok", f"WITH now AS ({CHANGED}), tok") + "SELECT qid, rank::INT AS rank, doc_id, score FROM lex WHERE rank <= 10 AND score >= 0.05")
def bm25_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index to which deletions and replacements were applied gives what one made anew would."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = P.build(docs).delete(docs.where("source = 'src2'")).upsert(docs.where("source = 'src3'").select("doc_id", F.concat("text", F.lit(" "), "source", F.lit(" revised")).alias("text")))
    found = index.topk(questions(spark, sf_dir), 10).hits.withColumn("doc_id", F.col("doc_id").cast("long"))
    return R.hits(found)


@query("bm25_document_filter", BM25.replace("FROM documents)", "FROM documents WHERE source = 'src3')") + "SELECT qid, rank::INT AS rank, doc_id, score FROM lex WHERE rank <= 10 AND score >= 0.05")
def bm25_document_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one source only, its own statistics."""
    return R.lexical(read(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, document="src3")


@query("dense_topk", f"WITH {DENSE} SELECT qid, rank::INT AS rank, vec_id, score FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense(read(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 10)


@query("dense_threshold", f"WITH {DENSE} SELECT qid, rank::INT AS rank, vec_id, score FROM dense WHERE rank <= 30 AND score >= 0.25")
def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense(read(spark, sf_dir, "embeddings"), query_vectors(spark, sf_dir), 30, 0.25)


@query(
    "hybrid_rrf",
    BM25 + f""", {DENSE.replace('WHERE q.vec_id % 20 = 0', 'JOIN benchmark b ON b.item_id = q.vec_id').replace('FROM embeddings e, embeddings q', 'FROM embeddings e CROSS JOIN embeddings q')},
both_ AS (
  SELECT coalesce(d.qid, l.qid) AS qid, coalesce(d.vec_id, l.doc_id) AS id, greatest(coalesce(d.score, 0.0), coalesce(l.score, 0.0)) AS best, d.rank AS rd, l.rank AS rb
  FROM (SELECT * FROM dense WHERE rank <= 48 AND score >= 0.1) d FULL JOIN (SELECT * FROM lex WHERE rank <= 48 AND score >= 0.05) l ON d.qid = l.qid AND d.vec_id = l.doc_id),
f AS (SELECT *, round(28.0 * (coalesce(1.0 / (60 + rd), 0.0) + coalesce(1.0 / (60 + rb), 0.0)) + 0.25 * best, 6) AS fused FROM both_),
s AS (SELECT *, round(greatest(best, least(1.0, fused / 1.2)), 6) AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, id) AS rank FROM s WHERE score >= 0.2)
SELECT qid, rank::INT AS rank, id, score, fused, concat_ws('+', CASE WHEN rb IS NOT NULL THEN 'bm25' END, CASE WHEN rd IS NOT NULL THEN 'dense' END) AS retrieval FROM r WHERE rank <= 8""",
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists for each benchmark item: BM25 of its text, cosine of the vector with its number; k = 8, threshold 0.2, pools of 48."""
    q, threshold, k = questions(spark, sf_dir), 0.2, 8
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.join(q.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    d = R.dense(vectors, asked, max(k * 6, 30), threshold * 0.5).withColumnRenamed("vec_id", "id")
    b = lexical(spark, sf_dir, q, max(k * 6, 30), threshold * 0.3).withColumnRenamed("doc_id", "id")
    return R.fused(d, b, k, threshold)


@query("sample_by_document", "SELECT source AS document, doc_id, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS nth FROM documents) WHERE nth <= 2")
def sample_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("document"), "doc_id", "n_chars")
    return R.sample_by_document(d, 2, order=("n_chars", "doc_id")).select("document", "doc_id", "nth")


_W = "1.0 + least(1.1, greatest(0.0, (length(t) - 4) * 0.12)) + CASE WHEN regexp_matches(t, '[0-9]') THEN 0.35 ELSE 0.0 END + CASE WHEN length(t) >= 10 THEN 0.45 ELSE 0.0 END"
_SUMW = f"list_sum(list_transform({{0}}, lambda t: {_W}))"
RERANK = (
    BM25
    + f""", cand AS (
  SELECT l.qid, l.doc_id, l.score AS base, b.text AS question, d.source AS title, {qterms_sql('b.text')} AS terms, {NORM.format('d.source')} AS tnorm,
    {NORM.format("d.source || ' ' || substring(" + SQUEEZE.format('d.text') + ", 1, 2600)")} AS hay, {NORM.format('b.text')} AS qnorm
  FROM lex l JOIN benchmark b ON b.item_id = l.qid JOIN documents d ON d.doc_id = l.doc_id WHERE l.rank <= 30 AND l.score >= 0.05),
m AS (SELECT *, list_filter(terms, lambda t: list_contains({qterms_sql('hay')}, t)) AS hit, list_filter(terms, lambda t: list_contains({qterms_sql('tnorm')}, t)) AS thit FROM cand),
w AS (SELECT *, coalesce({_SUMW.format('terms')}, 0.0) AS w, coalesce({_SUMW.format('hit')}, 0.0) AS wh, coalesce({_SUMW.format('thit')}, 0.0) AS wt,
    CASE WHEN qnorm <> '' AND contains(hay, qnorm) THEN 0.28 WHEN len(terms) >= 2 AND contains(hay, array_to_string(terms[1:2], ' ')) THEN 0.16 ELSE 0.0 END AS phrase FROM m),
fast AS (SELECT *, CASE WHEN len(terms) = 0 THEN 0 ELSE len(hit) END AS matched, CASE WHEN len(terms) = 0 THEN 0.0 ELSE round(wh / w, 6) END AS coverage,
    CASE WHEN len(terms) = 0 THEN base ELSE (base * 0.52 + least(1.0, wh / w * 0.72 + wt / w * 0.22 + phrase) * 0.48) * (CASE WHEN len(hit) = 0 AND base < 0.72 THEN 0.55 ELSE 1.0 END) * (CASE WHEN len(hit) = 1 AND len(terms) >= 3 AND base < 0.78 THEN 0.78 ELSE 1.0 END) END AS f FROM w),
fr AS (SELECT *, round(greatest(0.0, least(1.0, f)), 6) AS fastscore FROM fast)
"""
)


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = read(spark, sf_dir, "documents"), questions(spark, sf_dir)
    c = lexical(spark, sf_dir, q, 30).select("qid", "doc_id", F.col("score").alias("base"))
    c = c.join(docs.select("doc_id", "text", "source"), "doc_id").join(q, "qid")
    return R.fast_rerank(c, F.col("question"), F.col("source"), F.col("text"), F.col("base"))


@query("fast_rerank", RERANK + "SELECT qid, rank::INT AS rank, doc_id, fastscore AS fast, matched::INT AS matched, coverage, round(greatest(base, fastscore), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fastscore DESC, doc_id) AS rank FROM fr) WHERE rank <= 8")
def fast_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top(reranked(spark, sf_dir), 8, "fast", "doc_id", by="qid")
    return best.select("qid", "rank", "doc_id", "fast", "matched", "coverage", F.round(F.greatest("base", "fast"), 6).alias("score"))


@query("relevance_filter", RERANK + "SELECT qid, doc_id, fastscore AS fast, (matched >= 2 OR coverage >= 0.18 OR fastscore >= 0.62 OR base >= 0.78) AS kept, (matched >= 2 OR coverage >= 0.24 OR (matched >= 1 AND fastscore >= 0.58) OR base >= 0.82) AS kept_for_file FROM fr")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = (F.lit(False), F.col("matched"), F.col("coverage"), F.col("fast"), F.col("base"), F.lit(True))
    return reranked(spark, sf_dir).select("qid", "doc_id", "fast", R.relevant(F.lit(False), *args).alias("kept"), R.relevant(F.lit(True), *args).alias("kept_for_file"))


@query(
    "rare_terms",
    BM25 + f""", cand AS (SELECT l.qid, list_filter({qterms_sql('b.text')}, lambda t: list_contains({qterms_sql('d.text')}, t)) AS hit FROM lex l JOIN benchmark b ON b.item_id = l.qid JOIN documents d ON d.doc_id = l.doc_id WHERE l.rank <= 30 AND l.score >= 0.05),
n AS (SELECT qid, count(*) AS n FROM cand GROUP BY qid), h AS (SELECT qid, term, count(*) AS df FROM (SELECT qid, unnest(hit) AS term FROM cand) WHERE length(term) >= 6 GROUP BY ALL)
SELECT qid, term, df FROM h JOIN n USING (qid) WHERE df <= greatest(1, floor(n * 0.25))""",
)
def rare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = read(spark, sf_dir, "documents"), questions(spark, sf_dir)
    c = lexical(spark, sf_dir, q, 30).join(docs.select("doc_id", "text"), "doc_id").join(q, "qid")
    return R.rare_terms(c.select("qid", T.query_terms(F.col("question")).alias("terms"), T.query_terms(F.col("text")).alias("text_terms")))
