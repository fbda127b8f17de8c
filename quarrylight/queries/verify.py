"""Claims, citations, evidence and confidence: claims are the benchmark's passages, sources are the documents."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import evidence as E
from quarrylight.operators import extract as X
from quarrylight.operators import retrieval as R
from quarrylight.operators import verify as V
from quarrylight.queries.base import query, read, sql_list, sql_values
from quarrylight.queries.extract import SQ
from quarrylight.queries.retrieval import BM25, COS, lexical, questions

CT = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9][a-z0-9''\\-]{{{{2,}}}}'), lambda t: NOT list_contains({sql_list(T.CLAIM_STOPWORDS)}, t)))"
SUPPORT = f"""
WITH c AS (SELECT item_id AS claim_id, ['S' || (item_id % 100)] AS cited, {CT.format('text')} AS t FROM benchmark),
s AS (SELECT 'S' || doc_id AS label, {CT.format('text')} AS t FROM documents),
ct AS (SELECT claim_id, cited, len(t) AS nc, unnest(t) AS term FROM c), st AS (SELECT label, len(t) AS ns, unnest(t) AS term FROM s),
b AS (SELECT claim_id, label, cited, nc, ns, count(*) AS n FROM ct JOIN st USING (term) GROUP BY ALL),
sc AS (SELECT claim_id, label, round(least(1.0, least(1.0, n / nc * 0.78 + n / greatest(1, least(ns, nc * 4)) * 0.22) + CASE WHEN list_contains(cited, label) THEN 0.18 ELSE 0.0 END), 6) AS score FROM b)
"""


def claims_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"), F.array(F.concat(F.lit("S"), (F.col("item_id") % 100).cast("string"))).alias("cited"))


def sources_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("label"), "text")


@query("claim_support_scores", SUPPORT + "SELECT * FROM sc")
def claim_support_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.support(claims_of(spark, sf_dir), sources_of(spark, sf_dir))


VERDICT = (
    SUPPORT
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, label) AS r FROM sc),
best AS (SELECT claim_id, max(score) AS best, coalesce(string_agg(label, ',' ORDER BY r) FILTER (score >= 0.18), '') AS supporting FROM r WHERE r <= 3 GROUP BY claim_id),
v AS (SELECT claim_id, coalesce(best, 0.0) AS best, coalesce(supporting, '') AS supporting, CASE WHEN best >= 0.42 AND supporting <> '' THEN 'supported' WHEN best >= 0.22 AND supporting <> '' THEN 'weakly_supported' WHEN supporting <> '' THEN 'weakly_supported' ELSE 'unsupported' END AS verdict FROM c LEFT JOIN best USING (claim_id))
"""
)


@query("claim_support", VERDICT + "SELECT * FROM v")
def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claims_of(spark, sf_dir)
    return V.verified(c, V.best_support(c, sources_of(spark, sf_dir)))


@query("claim_summary", VERDICT + "SELECT count(*) AS n, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'weakly_supported') AS weak, count(*) FILTER (verdict = 'unsupported') AS unsupported FROM v")
def claim_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = claim_support(spark, sf_dir)
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "supported").alias("supported"), F.count_if(F.col("verdict") == "weakly_supported").alias("weak"), F.count_if(F.col("verdict") == "unsupported").alias("unsupported"))


CASES = [
    (1, "The plant opened on 3 May 2021.", "The plant was opened on 2021-05-03 by the mayor.", True), (2, "The plant opened on 4 May 2021.", "The plant was opened on 2021-05-03 by the mayor.", True),
    (3, "Wind turbines are tall.", "Solar panels are flat and wide.", False), (4, "The bridge is not safe for trucks.", "The bridge is safe for trucks and cars.", False), (5, "Batteries store energy.", "", True),
]


@query("date_grounding", f"SELECT * FROM (VALUES {sql_values([(1, True, 'supported'), (2, False, 'weakly_supported'), (3, True, 'unsupported'), (4, True, 'supported'), (5, True, 'unsupported')])}) AS t(case_id, grounded, verdict)")
def date_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full date that no source holds lowers the verdict by a step."""
    from quarrylight.functions.scoring import downgraded, support_score, verdict

    c = spark.createDataFrame(CASES, "case_id int, claim string, source string, cited boolean")
    dates = X.calendar_dates(F.col("claim"))
    grounded = (F.size(dates) == 0) | F.arrays_overlap(dates, X.calendar_dates(F.col("source")))
    score = F.least(F.lit(1.0), support_score(T.claim_terms(F.col("claim")), T.claim_terms(F.col("source"))) + F.when(F.col("cited") & (F.col("source") != ""), 0.18).otherwise(0.0))
    v = verdict(score, score >= 0.18, F.col("cited"))
    return c.select("case_id", grounded.alias("grounded"), F.when(grounded, v).otherwise(downgraded(v)).alias("verdict"))


_STOP2 = sql_list(V.COMPARISON_STOPWORDS)
_T2 = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9][a-z0-9''-]*'), lambda t: NOT list_contains({_STOP2}, t) AND length(t) > 1))"
_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"

_NEG = "regexp_matches(lower({0}), '(^|[^a-z0-9_])(" + "|".join(V.NEGATIONS).replace("'", "''") + ")($|[^a-z0-9_])')"
_ENTITY = V.ENTITY.replace("'", "''")
#: Claims that are broadcast at most, to be joined with their best sentences.
MOST_CLAIMS = 10_000
_BEST = f"""WITH c AS (SELECT item_id AS claim_id, text AS claim, {_T2.format('text')} AS t FROM benchmark), s0 AS (SELECT 'S' || doc_id AS label, {_SENT.format(SQ.format('text'))} AS ss FROM documents),
s AS (SELECT label, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM s0), st AS (SELECT label, pos, unnest({_T2.format('sentence')}) AS term FROM s), ct AS (SELECT claim_id, len(t) AS nc, unnest(t) AS term FROM c),
h AS (SELECT claim_id, label, pos, nc, count(*) AS n FROM ct JOIN st USING (term) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY claim_id, label ORDER BY n DESC, pos) AS r FROM h),
x AS (SELECT b.claim_id, label, claim, sentence, round(n / nc, 6) AS overlap FROM b JOIN s USING (label, pos) JOIN c USING (claim_id) WHERE r = 1),
y AS (SELECT *, list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace({SQ.format('claim')}, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '[^\\x00-\\x7F]', ' ', 'g'), '{_ENTITY}'), lambda e: NOT list_contains({sql_list(V.NO_ENTITY)}, lower(e)))) AS es FROM x),
k AS (SELECT *, CASE WHEN len(es) > 0 THEN len(list_filter(es, lambda e: contains(lower(sentence), lower(e)))) / len(es) ELSE 0.0 END AS named, round(greatest(overlap, named) * 0.82 + 0.8 * 0.18, 6) AS confidence, {_NEG.format('claim')} <> {_NEG.format('sentence')} AS neg FROM y),
o AS (SELECT claim_id, label, overlap, confidence, CASE WHEN confidence < 0.28 THEN 'not_found' WHEN neg AND confidence >= 0.42 THEN 'contradicts' WHEN confidence >= 0.38 THEN 'supports' ELSE 'unclear' END AS support FROM k)"""


@query("claim_comparison", _BEST + " SELECT * FROM o")
def claim_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim against the best sentence of every source that shares a term, by shared terms or by shared entities, base score 0.8."""
    c = claims_of(spark, sf_dir).select("claim_id", "claim", F.transform(V.claim_entities(F.col("claim")), F.lower).alias("entities"), V.negated(F.col("claim")).alias("negates"))
    own = c.drop("claim")
    b = V.best_sentences(c, sources_of(spark, sf_dir)).join(F.broadcast(own) if own.count() <= MOST_CLAIMS else own, "claim_id")
    b = b.withColumn("confidence", F.round(F.greatest("overlap", V.entity_score(F.col("entities"), F.col("low"))) * 0.82 + F.lit(0.8 * 0.18), 6))
    return b.select("claim_id", "label", "overlap", "confidence", V.support_label(F.col("negates"), F.col("neg"), F.col("low") == "", F.col("confidence")).alias("support"))


@query("claim_decision", _BEST + """, t AS (SELECT *, CASE hash_ WHEN 0 THEN 'local' WHEN 1 THEN 'web' ELSE 'ai' END AS stream FROM (SELECT *, length(label) % 3 AS hash_ FROM o WHERE support <> 'not_found')),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id, stream ORDER BY confidence DESC, label) AS r FROM t),
g AS (SELECT claim_id, bool_or(stream = 'local' AND support = 'supports') AS l, bool_or(stream = 'web' AND support = 'supports') AS w, bool_or(stream = 'ai' AND support = 'supports') AS a, bool_or(support = 'supports') AND bool_or(support = 'contradicts') AS conflict FROM r WHERE r <= 3 GROUP BY 1)
SELECT item_id AS claim_id, CASE WHEN item_id % 3 < 2 AND coalesce(w, false) THEN 'web' WHEN item_id % 2 = 0 AND coalesce(l, false) THEN 'local' WHEN coalesce(l, false) AND coalesce(w, false) THEN 'hybrid' WHEN coalesce(l, false) THEN 'local' WHEN coalesce(w, false) THEN 'web' WHEN coalesce(a, false) THEN 'ai' ELSE 'unsupported' END AS winner, coalesce(conflict, false) AS conflict FROM benchmark LEFT JOIN g ON claim_id = item_id""")
def claim_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's stream here is by the length of its label, a claim's kind of fact and policy by its number."""
    stream = F.when(F.length("label") % 3 == 0, "local").when(F.length("label") % 3 == 1, "web").otherwise("ai")
    i = F.col("item_id")
    kind = F.when(i % 3 == 0, "dynamic").when(i % 3 == 1, "news").otherwise("stable")
    facts = read(spark, sf_dir, "benchmark").select(i.alias("claim_id"), kind.alias("fact_type"), F.when(i % 2 == 0, "local_only").otherwise("local_model_web").alias("policy"))
    return V.decisions(claim_comparison(spark, sf_dir).withColumn("stream", stream), facts)


@query("claim_entities", f"SELECT item_id AS claim_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(regexp_replace({SQ.format('text')}, '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '[^\\x00-\\x7F]', ' ', 'g'), '{_ENTITY}'), lambda e: NOT list_contains({sql_list(V.NO_ENTITY)}, lower(e))))), '; ') AS entities FROM benchmark")
def claim_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.array_join(F.array_sort(V.claim_entities(F.col("text"))), "; ").alias("entities"))


@query("citation_verify", "WITH a AS (SELECT item_id AS answer_id, unnest(['S' || item_id, 'W' || (item_id % 7), 'S' || (item_id * 1000)]) AS label FROM benchmark) SELECT DISTINCT answer_id, label, label IN (SELECT 'S' || doc_id FROM documents) AS known FROM a")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    answer = F.concat(F.col("text"), F.format_string(" [S%d] and [W%d], [S%d] again [S%d].", i, i % 7, i * 1000, i))
    answers = read(spark, sf_dir, "benchmark").select(i.alias("answer_id"), answer.alias("answer"))
    return V.citations(answers, sources_of(spark, sf_dir))


@query("citation_cleanup", "SELECT item_id AS answer_id, " + SQ.format("text || '  and .'") + " AS answer FROM benchmark")
def citation_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select(i.alias("answer_id"), T.without_citations(F.concat(F.col("text"), F.format_string(" [S%d] and [W3].", i))).alias("answer"))


@query(
    "answer_verification",
    f"""WITH p AS (SELECT b.item_id, {CT.format('b.text')} AS claim, {CT.format("substring(b.text, 1, 20)")} AS q, {CT.format('d.text')} AS ev, b.item_id % 2 = 0 AS cited FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
o AS (SELECT *, list_filter(claim, lambda t: NOT list_contains(q, t)) AS own FROM p), s AS (SELECT item_id, cited, len(list_filter(own, lambda t: list_contains(ev, t))) / greatest(1, len(own)) AS share FROM o)
SELECT item_id, CASE WHEN share >= 0.18 AND cited THEN 'verified' WHEN share >= 0.09 THEN 'partial' ELSE 'unsupported' END AS status FROM s""",
)
def answer_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("evidence"))
    return b.join(d, "item_id").select("item_id", V.answer_check(F.col("text"), F.substring("text", 1, 20), F.col("evidence"), F.col("item_id") % 2 == 0).alias("status"))


CAPS = [(n, *r) for n, r in enumerate(itertools.product(("high", "medium", "low"), (0, 1, 3), (0, 2), (False, True)))]


@query("confidence_cap", f"SELECT id, CASE WHEN unsupported >= 3 AND supported = 0 THEN 'low' WHEN (conflict OR unsupported > 0) AND confidence = 'high' THEN 'medium' ELSE confidence END AS capped FROM (VALUES {sql_values(CAPS)}) AS t(id, confidence, unsupported, supported, conflict)")
def confidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(CAPS, "id int, confidence string, unsupported int, supported int, conflict boolean")
    return c.select("id", V.capped(F.col("confidence"), F.col("unsupported"), F.col("supported"), F.col("conflict")).alias("capped"))


#: Candidates of a question that retrieval hands to the ranking of evidence (its depth).
POOL = 30
ITEMS = f"""near AS (SELECT q.vec_id AS qid, e.vec_id AS doc_id, {COS} AS cosine FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)), items AS (
  SELECT l.qid, d.doc_id AS item, st AS source_type, d.source AS title, d.text AS content, l.score AS retrieval, coalesce(cosine, 0.0) AS semantic, au AS authority,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE DATE '2023-01-01' + (d.doc_id % 700)::INT END AS document_date, l.qid % 2 = 0 AS dated, l.qid % 3 = 0 AS local_question, l.qid % 5 = 0 AS scientific
  FROM lex l JOIN documents d USING (doc_id) JOIN (VALUES (0, 'local', 'internal'), (1, 'web', 'news'), (2, 'ai', 'model'), (3, 'web', 'scientific_paper')) AS y(m, st, au) ON d.doc_id // 40 % 4 = m LEFT JOIN near n ON n.qid = l.qid AND n.doc_id = l.doc_id WHERE l.rank <= {POOL})"""
RANKED = f"""{BM25}, {ITEMS}, s AS (SELECT *, 0.30 * greatest(0.0, least(1.0, CASE WHEN retrieval > 1 THEN retrieval / (1 + retrieval) ELSE retrieval END)) + 0.25 * greatest(0.0, least(1.0, semantic)) + 0.20 * 0.65
  + 0.10 * (MAP {{'internal': 0.9, 'news': 0.8, 'model': 0.6, 'scientific_paper': 0.95}})[authority]::DOUBLE
  + 0.10 * (CASE WHEN NOT dated THEN 0.65 WHEN source_type = 'ai' THEN 0.05 WHEN document_date IS NULL THEN CASE WHEN source_type = 'web' THEN 0.45 ELSE 0.25 END ELSE greatest(0.0, least(1.0, 1.0 - greatest(0, DATE '2024-06-30' - document_date) / 365)) END)
  + 0.05 * (CASE WHEN source_type <> 'ai' THEN 0.65 WHEN dated THEN 0.05 WHEN local_question THEN 0.10 ELSE 0.70 END)
  + CASE WHEN local_question AND source_type = 'local' THEN 0.12 ELSE 0.0 END - CASE WHEN dated AND source_type = 'ai' THEN 0.35 ELSE 0.0 END + CASE WHEN scientific AND authority = 'scientific_paper' THEN 0.06 ELSE 0.0 END AS raw FROM items),
r AS (SELECT *, round(greatest(0.0, least(1.0, raw)), 6)::DOUBLE AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM r)"""


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each question the POOL documents that retrieval finds best, with their score and, where both have one, the cosine of the vectors with their numbers. Only the pool's texts are joined."""
    q, docs, vectors = questions(spark, sf_dir), read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    pool = lexical(spark, sf_dir, q, POOL, floor=0.0).select("qid", F.col("doc_id").alias("item"), F.col("score").alias("retrieval"))
    asked = vectors.join(q.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    found = pool.select("item").distinct()  # a row a found document: their vectors and texts are picked where they are
    found = F.broadcast(found) if pool.count() <= R.MOST_TERMS else found
    theirs = pool.join(asked, "qid", "left").join(vectors.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")).join(found, "item", "left_semi"), "item", "left")
    kinds = F.array(*[F.struct(F.lit(st).alias("source_type"), F.lit(au).alias("authority")) for st, au in (("local", "internal"), ("web", "news"), ("ai", "model"), ("web", "scientific_paper"))])
    date = F.when(F.col("doc_id") % 4 != 0, F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")))
    d = docs.select(F.col("doc_id").alias("item"), F.get(kinds, (F.floor(F.col("doc_id") / 40) % 4).cast("int")).alias("kind"), F.col("source").alias("title"), F.col("text").alias("content"), date.alias("document_date")).join(found, "item", "left_semi")
    j = theirs.select("qid", "item", "retrieval", R.cosine(F.col("qv"), F.col("v")).alias("semantic")).join(d, "item").select("qid", "item", "kind.*", "title", "content", "retrieval", "semantic", "document_date")
    return j.withColumns({"dated": F.col("qid") % 2 == 0, "local_question": F.col("qid") % 3 == 0, "scientific": F.col("qid") % 5 == 0, "lookup": F.lit(False), "terms": F.array().cast("array<string>")})


def ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranked(items_of(spark, sf_dir), F.lit("2024-06-30").cast("date"))


@query("evidence_rank", RANKED + " SELECT qid, rank::INT AS rank, item, score FROM k")
def evidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_items(spark, sf_dir).select("qid", "rank", "item", "score")


@query("conflict_resolution", RANKED + """, g AS (SELECT qid, bool_or(source_type = 'web') AS hw, bool_or(source_type = 'local') AS hl, bool_or(dated) AS dated, bool_or(local_question) AS lq, arg_min(source_type, rank) AS t, min(score) FILTER (rank = 1) AS s, count(DISTINCT item) FILTER (rank <= 4 AND source_type <> 'ai') AS labels FROM k GROUP BY qid)
SELECT qid, CASE WHEN dated AND hw THEN 'web' WHEN lq AND hl THEN 'local' ELSE t END AS winner, CASE WHEN dated AND hw THEN CASE WHEN t = 'web' THEN 'high' ELSE 'medium' END WHEN lq AND hl THEN 'high' WHEN t = 'local' THEN CASE WHEN s >= 0.7 THEN 'high' ELSE 'medium' END WHEN t = 'web' THEN CASE WHEN s >= 0.72 THEN 'high' ELSE 'medium' END ELSE CASE WHEN dated THEN 'low' ELSE 'medium' END END AS confidence,
CASE WHEN labels > 1 THEN 'multiple sources' ELSE 'single source' END AS agreement FROM g""")
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conflicts(ranked_items(spark, sf_dir))


@query("date_reconcile", f"{BM25}, {ITEMS}, y AS (SELECT qid, source_type, year(document_date)::INT AS y FROM items WHERE document_date IS NOT NULL UNION ALL SELECT qid, source_type, trim(unnest(regexp_extract_all(' ' || title || ' ' || substring(content, 1, 500) || ' ', '[^A-Za-z0-9_](20[0-9]{{2}}|19[0-9]{{2}})[^A-Za-z0-9_]', 1)))::INT FROM items) SELECT qid, max(y) AS newest, max(y) FILTER (source_type = 'web') AS newest_web, max(y) FILTER (source_type = 'local') AS newest_local, coalesce(max(y) FILTER (source_type = 'local') < max(y) FILTER (source_type = 'web'), false) AS local_is_older FROM y GROUP BY qid")
def date_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.date_reconciliation(items_of(spark, sf_dir))


@query("freshness_decay", "SELECT o_orderkey, round(greatest(0.0, least(1.0, 1.0 - greatest(0, DATE '2025-01-01' - o_orderdate::DATE) / 365)), 6) AS freshness FROM orders")
def freshness_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(E.freshness(F.lit("web"), F.to_date("o_orderdate"), F.lit("2025-01-01").cast("date"), F.lit(True)), 6).alias("freshness"))
