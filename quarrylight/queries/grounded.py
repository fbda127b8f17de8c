"""Answers from sources alone, and texts made of a question's normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import answers as A
from quarrylight.operators import dialog as D
from quarrylight.operators import display
from quarrylight.operators import retrieval as R
from quarrylight.plans import normal as N
from quarrylight.queries.base import query, read
from quarrylight.queries.extract import SENT, SQ
from quarrylight.queries.normal import NORMAL, all_questions
from quarrylight.queries.retrieval import BM25, lexical, qterms_sql, questions

#: Sources of an answer.
SOURCES = 5


@query(
    "extractive_answer",
    BM25
    + f""", b AS (SELECT item_id AS qid, {qterms_sql('text')} AS terms FROM benchmark), l AS (SELECT qid, rank, doc_id FROM lex WHERE rank <= {SOURCES} AND score >= 0.05), d AS (SELECT qid, rank, {SENT.format(SQ.format('text'))} AS ss FROM l JOIN documents USING (doc_id)),
z AS (SELECT qid, rank, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM d), n AS (SELECT z.*, len(list_intersect({qterms_sql('sentence')}, terms)) AS n FROM z JOIN b USING (qid)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, rank, pos) AS k FROM n WHERE n > 0) SELECT b.qid, coalesce(sentence || ' [S' || rank || ']', 'The sources hold not enough information.') AS answer FROM b LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (qid)""",
)
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the SOURCES documents that retrieval finds best; only their texts are joined."""
    docs, q = read(spark, sf_dir, "documents"), questions(spark, sf_dir)
    return A.extractive(lexical(spark, sf_dir, q, SOURCES).join(docs.select("doc_id", "text"), "doc_id"), q)


_ASKED = SQ.format("coalesce(question, '')")


@query("web_rerank_query", NORMAL + f" SELECT qid, array_to_string(list_filter([{_ASKED}, canonical, array_to_string(key_terms, ' '), array_to_string(entities, ' ')], lambda x: x <> ''), ' ') AS text FROM n")
def web_rerank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What web sources are ranked by: the question, its canonical text, its terms and its entities."""
    n = N.normal(all_questions(spark, sf_dir))
    parts = F.array(T.squeezed(F.col("question")), F.col("canonical"), F.array_join("key_terms", " "), F.array_join("entities", " "))
    return n.select("qid", F.array_join(F.filter(parts, lambda x: x != ""), " ").alias("text"))


_LOWER = SQ.format("lower(coalesce(question, ''))")


@query("response_cache_key", NORMAL + f" SELECT qid, CASE WHEN canonical <> '' THEN canonical ELSE {_LOWER} END || chr(31) || 'France|President' || chr(31) || chr(31) || CASE WHEN qid % 2 = 0 THEN 'a.txt' ELSE '' END AS key FROM n")
def response_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N.normal(all_questions(spark, sf_dir))
    key = display.cache_key(F.col("canonical"), F.coalesce("question", F.lit("")), F.lit("France|President"), F.lit(None).cast("string"), F.when(F.col("qid") % 2 == 0, "a.txt"))
    return n.select("qid", key.alias("key"))


@query("state_after_interpretation")
def state_after_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interpreted question taken over into its state; a fold over what was found, which SQL has not: tested against literals."""
    from quarrylight.plans import interpret as I
    from quarrylight.queries.interpret import asked_in_states

    d = I.interpreted(asked_in_states(spark, sf_dir))
    none = F.array().cast("array<string>")
    texts = {"country": F.col("country"), "person": F.col("person"), "role": F.col("role"), "topic": F.col("topic")}
    roles = F.when((F.col("role") != "") & (F.col("holder") != ""), F.create_map(D.role_key(F.col("role")), F.col("holder"))).otherwise(F.create_map().cast("map<string,string>"))
    state = F.struct(*(texts.get(t, F.lit("")).alias(t) for t in D.TEXTS), *(none.alias(x) for x in D.LISTS), roles.alias("roles")).cast(D.SCHEMA)
    found = F.filter(F.array(*(F.struct(F.col(c).alias("name"), F.lit(k).alias("type"), r.alias("role")) for c, k, r in (("person", "person", F.col("role")), ("country", "country", F.lit("")), ("topic", "topic", F.lit(""))))), lambda x: x["name"] != "")
    s = D.taken_over(state, F.col("intent"), F.col("resolved"), found, F.split("preferred", ", "))
    d = T.held(d.select("qid", "sid", s.alias("s_")), s=F.col("s_"))
    roles = F.array_join(F.array_sort(F.transform(F.map_entries("s.roles"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return d.select("qid", "sid", "s.intent", "s.country", "s.person", "s.topic", *(F.array_join(f"s.{x}", ",").alias(x) for x in ("topics", "entities", "sources")), roles.alias("roles"))
