"""Queries of names, ages, tenure and pages about people."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import people as P
from quarrylight.queries.base import query, read, sql_values
from quarrylight.queries.retrieval import qterms_sql
from quarrylight.queries.web import _any
from quarrylight.sources.files import public_url as is_public

NAMES = [(1, "Maria Rossi", "María Rossi"), (2, "M. Rossi", "Anna Rossi"), (3, "Jan Peter Novak", "Jan Novak"), (4, "Jan Novak", "Petr Svoboda"), (5, "", "Jan"), (6, "Jan Novak", "Eva Novak"), (7, "Jürgen Groß", "Jurgen Groß")]


@query("fold_text", "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.folded(F.col("text")).alias("folded"))


@query("name_compatibility", f"""WITH n AS (SELECT id::BIGINT AS id, a, b FROM (VALUES {sql_values(NAMES)}) AS t(id, a, b) UNION ALL SELECT 1000 + doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{{3,}}')[1:2], ' '), array_to_string(regexp_extract_all(text, '[A-Za-z]{{3,}}')[2:4], ' ') FROM documents), p AS (SELECT id, {{A}} AS x, {{B}} AS y FROM n)
SELECT id, len(x) > 0 AND len(y) > 0 AND coalesce(len(list_intersect(x, y)) = least(len(x), len(y)) OR (x[1] = y[1] AND x[-1] = y[-1]) OR (len(list_intersect(x, y)) > 0 AND x[-1] = y[-1]), false) AS compatible FROM p""".replace("{A}", "list_filter(string_split(trim(regexp_replace(strip_accents(lower(a)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda q: length(q) > 1)").replace("{B}", "list_filter(string_split(trim(regexp_replace(strip_accents(lower(b)), '[^a-z0-9]+', ' ', 'g')), ' '), lambda q: length(q) > 1)"))
def name_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    own = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.array_join(F.slice(w, 1, 2), " ").alias("a"), F.array_join(F.slice(w, 2, 3), " ").alias("b"))
    return spark.createDataFrame(NAMES, "id long, a string, b string").unionByName(own).select("id", P.compatible(F.col("a"), F.col("b")).alias("compatible"))


@query("age_on_date", "SELECT o_orderkey, (year(o_orderdate) - 1960 - CASE WHEN month(o_orderdate) < 6 OR (month(o_orderdate) = 6 AND day(o_orderdate) < 15) THEN 1 ELSE 0 END)::INT AS age FROM orders")
def age_on_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", P.age_on(F.lit("1960-06-15").cast("date"), F.to_date("o_orderdate")).alias("age"))


TENURE = [(1, "She was the president of the club."), (2, "The president, in office 2010-2014, retired."), (3, "The president since 2020."), (4, "Former minister."), (5, "He is president until 2030."), (6, "")]


@query("past_tenure", f"SELECT id, CASE WHEN {_any('l', P.ENDED)} OR regexp_matches(l, 'was (the )?president') OR regexp_matches(l, 'president[^.;]{{0,40}}(19|20)[0-9]{{2}} *[-–] *(19|20)[0-9]{{2}}') OR regexp_matches(l, 'president[^.;]{{0,25}}until (19|20)[0-9]{{2}}') THEN 2.5 ELSE 0.0 END::DOUBLE AS penalty FROM (SELECT id::BIGINT AS id, lower(coalesce(t, '')) AS l FROM (SELECT id, t FROM (VALUES {sql_values(TENURE)}) AS v(id, t) UNION ALL SELECT 1000 + doc_id, text FROM documents))")
def past_tenure(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t"))
    return spark.createDataFrame(TENURE, "id long, t string").unionByName(own).select("id", P.past_tenure(F.col("t"), F.lit("president")).alias("penalty"))


@query(
    "web_rank",
    f"""WITH q AS (SELECT {qterms_sql("'wind energy the and of research'")} AS terms), p AS (SELECT page_id, lower(url) AS d, lower(concat_ws(' ', url, html)) AS hay, (page_id % 5) / 4.0::DOUBLE AS base FROM pages),
s AS (SELECT page_id, round(CASE WHEN {_any('d', P.OFFICIAL)} THEN 4.0 WHEN {_any('d', P.UNIVERSITY)} THEN 3.0 WHEN {_any('d', P.SCHOLARLY)} THEN 2.8 WHEN {_any('d', P.PRESS)} THEN 2.0 ELSE 0.0 END + least(2.0, len(list_filter(terms, lambda t: contains(hay, t))) * 0.25)
 - (CASE WHEN {_any('hay', ('blog', 'opinion', 'editorial'))} THEN 1.5 ELSE 0.0 END + CASE WHEN {_any('d', P.LOW_QUALITY)} THEN 3.0 ELSE 0.0 END + CASE WHEN {_any('hay', P.NOISY)} THEN 2.5 ELSE 0.0 END) + least(1.0, greatest(0.0, base)), 6)::DOUBLE AS rank_score, base FROM p, q)
SELECT page_id, rank_score, round(greatest(base, least(1.0, rank_score / 6.0)), 6)::DOUBLE AS score FROM s""",
)
def web_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms, base = T.query_terms(F.lit("wind energy the and of research")), F.col("page_id") % 5 / 4.0
    s = read(spark, sf_dir, "pages").select("page_id", F.round(P.page_score(F.col("url"), F.lit(None).cast("string"), F.col("html"), terms, base), 6).alias("rank_score"), base.alias("base"))
    return s.select("page_id", "rank_score", F.round(F.greatest("base", F.least(F.lit(1.0), F.col("rank_score") / 6.0)), 6).alias("score"))


URLS = [(1, "http://example.org/a"), (2, "https://user:pw@example.org"), (3, "http://127.0.0.1:80/x"), (4, "http://172.16.0.1"), (5, "ftp://example.org"), (6, "http://LOCALHOST/"), (7, "http://[::1]/"), (8, "https://172.32.0.1/")]


@query("public_url", rf"SELECT id, bare <> '' AND NOT contains(host, '@') AND NOT regexp_matches(bare, '^(localhost|.*\.local|.*\.internal|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|\[.*\])$') AS public FROM (SELECT id, host, regexp_replace(host, ':[0-9]+$', '') AS bare FROM (SELECT id::BIGINT AS id, lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) AS host FROM (SELECT id, u FROM (VALUES {sql_values(URLS)}) AS v(id, u) UNION ALL SELECT 1000 + page_id, url FROM pages)))")
def public_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), F.col("url").alias("u"))
    return spark.createDataFrame(URLS, "id long, u string").unionByName(own).select("id", is_public(F.col("u")).alias("public"))


@query("page_urls_public", r"SELECT page_id, bare <> '' AND NOT contains(host, '@') AND NOT regexp_matches(bare, '^(localhost|.*\.local|.*\.internal)$') AS public FROM (SELECT page_id, host, regexp_replace(host, ':[0-9]+$', '') AS bare FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages))")
def page_urls_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", is_public(F.col("url")).alias("public"))


@query("entity_mentions_name", "SELECT doc_id, len(list_intersect(['university', 'trento'], string_split(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'), ' '))) >= 1 AS mentions FROM documents")
def entity_mentions_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.mentions(F.col("text"), F.lit("University Trento")).alias("mentions"))


@query("best_document_date", "SELECT o_custkey AS doc_id, arg_max(o_orderdate::DATE, struct_pack(s := score, d := o_orderdate::DATE)) AS date FROM (SELECT *, (o_orderkey % 5) - 1 AS score FROM orders) WHERE score > 0 GROUP BY 1")
def best_document_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderkey") % 5 - 1).alias("score"))
    return P.best_date(c)


@query("entity_snippets", "SELECT doc_id, coalesce(list_filter(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), lambda x: contains(lower(x), 'the'))[1], substring(trim(text), 1, 500)) AS snippet FROM documents")
def entity_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.first_sentence_with(F.col("text"), F.lit("the")).alias("snippet"))
