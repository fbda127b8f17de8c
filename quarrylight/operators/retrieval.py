"""The retrieval kernel: inverted index, BM25, cosine search, rank fusion, re-ranking and relevance filters.

Questions are a table (``qid``, ``question`` or a vector), so one plan answers any number of them; a single question is a
table of one row. Nothing here collects; a side is broadcast only where Catalyst knows that it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.scoring import clamp, dot, term_weight, total_weight
from quarrylight.operators.nearest import nearest
from quarrylight.shared import saved

K1, B = 1.5, 0.75
RRF_CONSTANT, RRF_SCALE, RRF_BOOST = 60, 28.0, 0.25


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``term``, ``tf``."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(T.tokens(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``dl``: documents without a token have length 0 and count."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(T.tokens(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("dl"))


def index_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``n_docs``, ``avgdl``, ``n_tokens``."""
    return doc_lengths(docs, id_col, text_col).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("n_tokens"))


def term_df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def question_terms(questions: DataFrame) -> DataFrame:
    """``qid``, ``term``, ``qtf``."""
    return questions.select("qid", F.explode(T.tokens(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


#: Rows of question terms that are broadcast at most; beyond that they are joined by shuffle.
MOST_TERMS = 500_000


def bm25(docs: DataFrame, questions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``qid``, ``doc_id``, ``bm25`` of every document that shares a term with a question; the statistics cover all documents.

    Texts are tokenized once, into a table of documents with their counted terms. Documents are dealt by their id, and the
    questions' weighted terms, if they are few enough (counted first), come to them: the pairs, which are nearly all of
    questions times documents, are summed up where the document is and never shuffled.
    """
    q = question_terms(questions)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = T.held(texts, terms=T.counted(T.tokens(F.col("text")))).drop("text")
    index = saved(counted.withColumn("dl", F.aggregate("terms", F.lit(0), lambda a, x: a + x["n"])), "postings")
    stats = index.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))  # one row
    df = index.select(F.explode("terms.term").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = saved(q.join(df, "term").crossJoin(F.broadcast(stats)).select("qid", "term", (F.col("qtf") * idf * (K1 + 1)).alias("w"), "avgdl"), "weights")
    weighted = F.broadcast(weighted) if weighted.count() <= MOST_TERMS else weighted
    each = index.repartition("doc_id").select("doc_id", "dl", F.inline("terms")).join(weighted, "term")
    part = F.col("n") / (F.col("n") + K1 * (1 - B + B * F.col("dl") / F.greatest(F.lit(1.0), "avgdl")))
    return each.groupBy("doc_id", "qid").agg(F.sum(F.col("w") * part).alias("bm25")).select("qid", "doc_id", "bm25")


def lexical(docs: DataFrame, questions: DataFrame, k: int, threshold: float = 0.0, document: str | None = None, floor: float = 0.05) -> DataFrame:
    """``qid``, ``rank``, ``doc_id``, ``score`` of the ``k`` best by BM25, every pair scored. A ``document`` restricts the candidates before they are scored."""
    if document is not None:
        docs = docs.where(F.col("source") == document)
    scored = bm25(docs, questions).withColumn("order", F.round("bm25", 5))
    return hits(top(scored, k, "order", "doc_id", by="qid"), threshold, floor)


def hits(ranked: DataFrame, threshold: float = 0.0, floor: float = 0.05) -> DataFrame:
    """Documents ranked by ``bm25`` with their ``score``, BM25 divided by 8 and 1 at most, where that is over the floor."""
    scored = ranked.withColumn("score", F.round(F.least(F.lit(1.0), F.col("bm25") / 8), 6))
    return scored.where(F.col("score") >= max(floor, threshold * 0.45)).select("qid", "rank", "doc_id", "score")


def top(df: DataFrame, k: int, score: str, tie: str, by: str | None = None, name: str = "rank") -> DataFrame:
    """The ``k`` rows with the largest score (of each ``by``), ranked from 1, ties to the smaller ``tie``."""
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc(score), tie)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, clamped to 0 to 1; 0 where one is missing or zero."""
    return clamp(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def dense(vectors: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``qid``, ``rank``, ``vec_id``, ``score``: exact cosine top-k of query vectors (``qid``, ``qv``) against all vectors, those of ``threshold`` or more."""
    return nearest(vectors, queries, k, id_col, vector_col).where(F.col("score") >= threshold)


def fused(dense_ranked: DataFrame, lexical_ranked: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (``qid``, ``id``, ``rank``, ``score``): ``qid``, ``rank``, ``id``, ``score``, ``fused``, ``retrieval``."""
    d = dense_ranked.select("qid", "id", F.col("rank").alias("rd"), F.col("score").alias("sd"))
    b = lexical_ranked.select("qid", "id", F.col("rank").alias("rb"), F.col("score").alias("sb"))
    both = d.join(b, ["qid", "id"], "full_outer")
    best = F.greatest(F.coalesce("sd", F.lit(0.0)), F.coalesce("sb", F.lit(0.0)))
    part = lambda r: F.coalesce(1.0 / (RRF_CONSTANT + F.col(r)), F.lit(0.0))
    out = both.withColumn("fused", F.round(RRF_SCALE * (part("rd") + part("rb")) + RRF_BOOST * best, 6))
    out = out.withColumn("score", F.round(F.greatest(best, F.least(F.lit(1.0), F.col("fused") / 1.2)), 6)).where(F.col("score") >= threshold)
    out = out.withColumn("retrieval", F.array_join(F.array_compact(F.array(F.when(F.col("rb").isNotNull(), "bm25"), F.when(F.col("rd").isNotNull(), "dense"))), "+"))
    return top(out, k, "fused", "id", by="qid").select("qid", "rank", "id", "score", "fused", "retrieval")


def fast_rerank(cands: DataFrame, question: Column, title: Column, text: Column, score: Column) -> DataFrame:
    """Adds ``matched``, ``coverage`` and ``fast`` (the blend of the score with the terms', title's and phrase's matches)."""
    body = F.substring(T.squeezed(text), 1, 2600)
    d = cands.withColumn("_terms", T.query_terms(question)).withColumn("_title", T.normalized(title)).withColumn("_hay", T.normalized(F.concat_ws(" ", title, body)))
    d = d.withColumn("_in", F.array_intersect("_terms", T.query_terms(F.col("_hay")))).withColumn("_int", F.array_intersect("_terms", T.query_terms(F.col("_title"))))
    d = d.withColumn("_w", total_weight(F.col("_terms"))).withColumn("_q", T.normalized(question)).withColumn("_base", clamp(F.coalesce(score, F.lit(0.0))))
    none = F.size("_terms") == 0
    phrase = F.when((F.col("_q") != "") & F.contains("_hay", "_q"), 0.28).when((F.size("_terms") >= 2) & F.contains(F.col("_hay"), F.array_join(F.slice("_terms", 1, 2), " ")), 0.16).otherwise(0.0)
    d = d.withColumn("matched", F.when(none, 0).otherwise(F.size("_in"))).withColumn("coverage", F.when(none, 0.0).otherwise(F.round(F.try_divide(total_weight(F.col("_in")), F.col("_w")), 6)))
    lex = F.least(F.lit(1.0), F.try_divide(total_weight(F.col("_in")), F.col("_w")) * 0.72 + F.try_divide(total_weight(F.col("_int")), F.col("_w")) * 0.22 + phrase)
    s = F.col("_base") * 0.52 + lex * 0.48
    s = s * F.when((F.col("matched") == 0) & (F.col("_base") < 0.72), 0.55).otherwise(1.0) * F.when((F.col("matched") == 1) & (F.size("_terms") >= 3) & (F.col("_base") < 0.78), 0.78).otherwise(1.0)
    return d.withColumn("fast", F.round(F.when(none, F.col("_base")).otherwise(clamp(s)), 6)).drop("_terms", "_title", "_hay", "_in", "_int", "_w", "_q", "_base")


def relevant(file_question: Column, explicit: Column, overlap: Column, coverage: Column, fast: Column, semantic: Column, lexical_hit: Column) -> Column:
    """Whether a re-ranked local source is kept."""
    asked = explicit | (overlap >= 2) | (coverage >= 0.24) | (lexical_hit & (overlap >= 1) & (fast >= 0.58)) | (semantic >= 0.82)
    other = (overlap >= 2) | (coverage >= 0.18) | (fast >= 0.62) | (semantic >= 0.78)
    return F.when(file_question, asked).otherwise(other)


def rare_terms(cands: DataFrame, by: str = "qid") -> DataFrame:
    """``by``, ``term``, ``df`` of question terms (``terms``) of six characters or more that few candidates' texts (``text_terms``) hold: a quarter at most, one at least."""
    n = cands.groupBy(by).agg(F.count("*").alias("n"))
    hit = cands.select(by, F.explode(F.array_intersect("terms", "text_terms")).alias("term")).where(F.length("term") >= 6).groupBy(by, "term").agg(F.count("*").alias("df"))
    return hit.join(n, by).where(F.col("df") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.25))).select(by, "term", "df")


def sample_by_document(chunks: DataFrame, per_document: int = 2, document: str = "document", order: tuple[str, ...] = ("page", "chunk_id")) -> DataFrame:
    """The first chunks of each document."""
    w = Window.partitionBy(document).orderBy(*order)
    return chunks.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_document)


def labelled(ranked: DataFrame, prefix: str = "S", rank: str = "rank") -> DataFrame:
    return ranked.withColumn("label", F.concat(F.lit(prefix), F.col(rank).cast("string")))
