"""Queries of names, documents, cached questions and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import match as M
from quarrylight.operators import segment as S
from quarrylight.queries import extract  # noqa: F401  (its SQL describes documents)
from quarrylight.queries.base import SQL, query, read, sql_list, sql_values
from quarrylight.queries.retrieval import TOK, questions

ASKED = [(1, "Report 12.pdf"), (2, "doc7"), (3, "energy source 9"), (4, "missing.txt"), (5, "DOC-003.txt")]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.format_string("doc-%03d.txt", "doc_id").alias("document"), F.concat(F.lit("Energy "), F.replace("source", F.lit("src"), F.lit("source "))).alias("title"), "doc_id", "n_chars", "text", "lang")


@query("filename_match")
def filename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.name_matches(spark.createDataFrame(ASKED, "qid int, name string"), _docs(spark, sf_dir).select("document", "title"))


_ABOUT = f"""about AS (SELECT doc_id AS document, n_chars AS size, concat_ws(' ', source, title, summary, kind, keywords) AS about FROM documents JOIN (SELECT doc_id, CASE WHEN title = 'doc ' || doc_id THEN NULL ELSE title END AS title FROM ({SQL['doc_title']})) USING (doc_id) JOIN ({SQL['doc_summary']}) USING (doc_id) JOIN ({SQL['doc_kind']}) USING (doc_id) LEFT JOIN ({SQL['doc_keywords']}) USING (doc_id))"""


@query("rank_documents", f"""WITH {_ABOUT}, q AS (SELECT item_id AS qid, unnest(list_distinct({TOK.format('text')})) AS term FROM benchmark), d AS (SELECT document, size, unnest(list_distinct({TOK.format('about')})) AS term FROM about),
h AS (SELECT qid, document, size, count(*) AS n FROM q JOIN d USING (term) GROUP BY ALL), s AS (SELECT *, round(least(1.0, 0.25 + n * 0.12), 6)::DOUBLE AS score FROM h)
SELECT qid, document, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, size DESC, document) AS rank FROM s) WHERE rank <= 8""")
def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source, title, summary, keywords of the whole text and kind."""
    d = read(spark, sf_dir, "documents")
    t = F.col("text")
    about = F.concat_ws(" ", "source", S.title(t, F.lit(None).cast("string")), S.summary(t), S.kind(t), S.keyword_list(t))
    return M.metadata_matches(questions(spark, sf_dir), d.select(F.col("doc_id").alias("document"), F.col("n_chars").alias("size"), about.alias("about")))


@query("doc_importance", "SELECT doc_id, round(least(0.36, (n_chars // 3000) / 300) + least(0.3, (n_chars // 880 + 1) / 500) + CASE WHEN n_chars > 200 THEN 0.18 ELSE 0.0 END + 0.1 + CASE WHEN lang = 'en' THEN 0.06 ELSE 0.0 END, 6)::DOUBLE AS importance FROM documents")
def doc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    x = M.importance(F.floor(F.col("n_chars") / 3000), F.floor(F.col("n_chars") / 880) + 1, F.col("n_chars") > 200, F.lit(True), F.col("lang") == "en")
    return d.select("doc_id", F.round(x, 6).alias("importance"))


@query("confidence_calibration", "SELECT event_id, CASE WHEN s > 0.8 THEN 'High' WHEN s > 0.6 THEN 'Medium' ELSE 'Low' END AS confidence FROM (SELECT event_id, (CASE WHEN user_id % 2 = 0 THEN b * 0.7 + 0.9 * 0.3 ELSE b END) * CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.85 END AS s FROM (SELECT event_id, user_id, greatest(0.0, least(1.0, value / 100)) * CASE WHEN event_type = 'click' THEN 0.9 ELSE 1.0 END AS b FROM events))")
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select("event_id", M.calibrated(F.col("value") / 100, F.col("event_type") == "click", F.when(F.col("user_id") % 2 == 0, 0.9).otherwise(0.0), F.col("user_id") % 3 == 0).alias("confidence"))


@query("payload_confidence", "WITH g AS (SELECT user_id, max(value) / 100 AS best, bool_or(event_type = 'purchase') AS official, count(DISTINCT event_type) FILTER (value > 50) AS n FROM events GROUP BY user_id) SELECT user_id, CASE WHEN (official AND best >= 0.68) OR (n >= 2 AND best >= 0.62) THEN 'High' WHEN best >= 0.52 OR n > 0 THEN 'Medium' ELSE 'Low' END AS payload, CASE WHEN best >= 0.78 AND (n >= 2 OR official) THEN 'High' WHEN best >= 0.5 OR n > 0 THEN 'Medium' ELSE 'Low' END AS extractive FROM g")
def payload_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("user_id").agg((F.max("value") / 100).alias("best"), F.max(F.col("event_type") == "purchase").alias("official"), F.countDistinct(F.when(F.col("value") > 50, F.col("event_type"))).alias("n"))
    return g.select("user_id", M.payload_confidence(F.col("best"), F.col("official"), F.col("n"), F.lit(False)).alias("payload"), M.extractive_confidence(F.col("best"), F.col("official"), F.col("n")).alias("extractive"))


_W = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9][a-z0-9''-]*'), lambda t: NOT list_contains({sql_list(M.CACHE_STOPWORDS)}, t) AND length(t) > 1))"
_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "semantic_cache_lookup",
    f"""WITH r AS (SELECT conv_id * 1000 + turn AS rid, role AS scope, {_N.format('text')} AS rq, {_W.format('text')} AS rw FROM conversations), e AS (SELECT conv_id * 1000 + turn AS eid, role AS scope, {_N.format('text')} AS eq, {_W.format('text')} AS ew FROM (SELECT * FROM conversations ORDER BY conv_id * 1000 + turn DESC LIMIT {M.CAPACITY})),
rx AS (SELECT rid, scope, rq, len(rw) AS nr, unnest(rw) AS w FROM r), ex AS (SELECT eid, scope, eq, len(ew) AS ne, unnest(ew) AS w FROM e), m AS (SELECT rid, eid, rq, eq, nr, ne, count(*) AS both_ FROM rx JOIN ex USING (scope, w) GROUP BY ALL),
s AS (SELECT rid, eid, round(CASE WHEN rq = eq THEN 1.0 ELSE greatest(both_ / (nr + ne - both_), both_ / least(nr, ne) * 0.96) END, 6)::DOUBLE AS similarity FROM m)
SELECT rid, eid, similarity FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY similarity DESC, eid) AS k FROM s WHERE similarity >= 0.88) WHERE k = 1""",
)
def semantic_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a request against the newest turns, as many as a cache holds, as cached questions, scoped by role."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("rid"), F.col("role").alias("scope"), F.col("text").alias("question"), "turn")
    return M.cache_lookup(c, c.orderBy(F.desc("rid")).limit(M.CAPACITY).withColumnRenamed("rid", "eid"))


@query("role_election", "WITH g AS (SELECT user_id % 50 AS qid, event_type AS name, bool_or(value > 90) AS current, count(DISTINCT user_id) AS n_domains, max(value) AS score FROM events GROUP BY ALL) SELECT qid, name, n_domains, current FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY current DESC, n_domains DESC, score DESC, name DESC) AS k FROM g) WHERE k = 1")
def role_election(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("qid"), F.col("event_type").alias("name"), (F.col("value") > 90).alias("current"), F.col("user_id").alias("domain"), F.col("value").alias("score"))
    return M.elected(e)


TEMPLATES = [("en", "Summarise {subject}", 0.9), ("en", "What are the key findings in {subject}?", 0.85), ("en", "List the methods of {subject}", 0.8), ("de", "Summarise {subject}", 0.9), ("fr", "Translate {subject}", 0.7), ("es", "Translate {subject}", 0.7), ("es", "Summarise {subject}", 0.7)]


@query("prompt_suggestions", f"WITH t AS (SELECT * FROM (VALUES {sql_values(TEMPLATES)}) AS v(kind, template, priority)), p AS (SELECT 'doc ' || doc_id AS document, replace(template, '{{subject}}', 'doc ' || doc_id) AS prompt, round(priority + least(1.0, n_chars / 10000.0::DOUBLE) * 0.08, 6)::DOUBLE AS priority FROM documents JOIN t ON lang = kind) SELECT document, prompt, priority, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY priority DESC, prompt) AS rank FROM p) WHERE rank <= 2")
def prompt_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("document"), F.col("lang").alias("kind"), F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("importance"))
    return M.suggestions(spark.createDataFrame(TEMPLATES, "kind string, template string, priority double"), d, 2)


@query("block_topk", "SELECT doc_id, term_hits, rank::INT AS rank FROM (SELECT doc_id, term_hits, row_number() OVER (ORDER BY term_hits DESC, doc_id) AS rank FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS term_hits FROM documents)) WHERE rank <= 20")
def block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by how often a term stands in them, the 20 best: a partial limit in each task, then a merge."""
    hits = read(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("the"), F.lit(0))).cast("long").alias("term_hits"))
    best = hits.orderBy(F.desc("term_hits"), "doc_id").limit(20)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("term_hits"), "doc_id")))
