"""Queries over ``pages`` and constant URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import web as W
from quarrylight.queries.base import query, read, sql_list, sql_values

URLS = [
    (1, "https://www.Example.org:443/a//b/index.html?utm_source=x&b=2&a=1#top"), (2, "http://example.org/a/b/?a=1&b=2"), (3, "example.org/a/b?b=2&a=1&ref=z"), (4, "https://example.org/"), (5, "https://example.org"), (6, "https://www.gov.example/x"),
    (7, "https://news.bbc.co.uk/story/default.aspx"), (8, "https://en.wikipedia.org/wiki/A?spm=1"), (9, ""), (10, "https://arxiv.org/abs/1?c="), (11, "https://blog.medium.com/p"), (12, "https://x.com/u"), (13, "https://github.com/a/b"), (14, "https://www.uni.example/paper"), (15, "https://youtu.be/q"), (16, None),
]


def _domain(u: str) -> str:
    return rf"regexp_replace(lower(regexp_extract(coalesce({u}, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"


def _key(u: str) -> str:
    full = f"(CASE WHEN regexp_matches(trim(coalesce({u}, '')), '^[A-Za-z][A-Za-z0-9+.-]*://') OR trim(coalesce({u}, '')) = '' THEN trim(coalesce({u}, '')) ELSE 'https://' || trim({u}) END)"
    host = f"regexp_replace({_domain(full)}, ':(80|443)$', '')"
    path = f"regexp_replace(regexp_extract({full}, '^[^:]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')"
    path = rf"regexp_replace(regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '/(index|default)\.(html?|aspx?)$', '/', 'i'), '/+$', '')"
    q = rf"array_to_string(list_sort(list_filter(list_transform(string_split(regexp_extract({full}, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: lower(regexp_extract(x, '^([^=]*)=', 1)) || '=' || regexp_extract(x, '^[^=]*=(.*)$', 1)), lambda p: NOT regexp_matches(p, '^utm_') AND NOT list_contains({sql_list([*W.TRACKING, ''])}, regexp_extract(p, '^([^=]*)=', 1)) AND NOT regexp_matches(p, '=$'))), '&')"
    return f"CASE WHEN {host} = '' THEN '' ELSE {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END END"


def _any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


FIX = f"urls AS (SELECT id::BIGINT AS id, url FROM (VALUES {sql_values(URLS)}) AS t(id, url) UNION ALL SELECT 1000 + page_id, url FROM pages)"


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The awkward addresses and those of all pages."""
    return spark.createDataFrame(URLS, "id long, url string").unionByName(read(spark, sf_dir, "pages").select((F.col("page_id") + 1000).alias("id"), "url"))


@query("url_keys", f"WITH {FIX} SELECT id, {_key('url')} AS url_key FROM urls")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("id", W.url_key(F.col("url")).alias("url_key"))


@query("url_key_dedupe", f"SELECT page_id, url, url_key FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS nth FROM (SELECT page_id, url, {_key('url')} AS url_key FROM pages) WHERE url_key <> '') WHERE nth = 1")
def url_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.deduped(read(spark, sf_dir, "pages").select("page_id", "url"))


_AUTH = "CASE " + " ".join(f"WHEN {_any('hay', ms)} THEN '{n}'" for n, ms in W.AUTHORITY) + " ELSE 'standard' END"


@query("authority_infer", f"WITH {FIX} SELECT id, a AS authority, (MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {v!r}' for k, v in W.AUTHORITY_SCORE.items())}}})[a]::DOUBLE AS trust FROM (SELECT id, {_AUTH} AS a FROM (SELECT id, lower({_domain('url')} || ' ' || coalesce(url, '') || ' ') AS hay FROM urls))")
def authority_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.functions.scoring import mapped

    a = urls(spark, sf_dir).select("id", W.authority(F.lit("web"), F.col("url"), F.lit("")).alias("authority"))
    return a.withColumn("trust", mapped(F.col("authority"), W.AUTHORITY_SCORE))


_TYPE = "CASE " + " ".join(f"WHEN {_any('d', ds)}{' OR ' + _any('hay', anyw) if anyw else ''} THEN '{n}'" for n, ds, anyw in W.SOURCE_TYPES) + " ELSE 'Web' END"


@query("source_type_groups", f"SELECT source_type, count(*) AS n, source_type || ' (' || count(*) || ')' AS title, min(page_id) AS first_page FROM (SELECT page_id, {_TYPE} AS source_type FROM (SELECT page_id, {_domain('url')} AS d, lower(concat_ws(' ', url, html)) AS hay FROM pages)) GROUP BY 1")
def source_type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = read(spark, sf_dir, "pages").select("page_id", W.source_type(F.col("url"), F.lit(None).cast("string"), F.col("html")).alias("source_type"))
    return typed.groupBy("source_type").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).withColumn("title", F.concat("source_type", F.lit(" ("), F.col("n").cast("string"), F.lit(")")))


@query("source_types", f"WITH {FIX} SELECT id, {_TYPE} AS source_type FROM (SELECT id, {_domain('url')} AS d, lower(concat_ws(' ', url)) AS hay FROM urls)")
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("id", W.source_type(F.col("url"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("source_type"))


@query("priority_boost", "SELECT page_id, round(CASE WHEN contains(lower(url), 'blog') OR contains(lower(url), '.example.org') THEN least(1.0, s * 1.3) ELSE s END, 6) AS score FROM (SELECT page_id, url, (page_id % 10) / 10.0::DOUBLE AS s FROM pages)")
def priority_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.round(W.boosted(F.col("page_id") % 10 / 10.0, F.col("url"), ("blog", ".example.org")), 6).alias("score"))


@query("html_links", "SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a [^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.explode(W.links(F.col("html"))).alias("link"))


DATED = [(-1, "Ordered 2024-01-31, confirmed 2024-02-01 and 2024-01-31; 2023-12-24 2022-01-01 2021-01-01 2020-01-01"), (-2, "no date, 2024-1-1"), (-3, None)]


@query("visible_dates", f"""SELECT page_id, array_to_string(list_slice(list_filter(d, lambda x, i: list_position(d, x) = i), 1, 5), ',') AS dates FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS d FROM (SELECT page_id::BIGINT AS page_id, html FROM (VALUES {sql_values(DATED)}) AS v(page_id, html) UNION ALL SELECT page_id, html FROM pages UNION ALL SELECT 1000000000 + doc_id, text FROM documents))""")
def visible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant texts, every page and every document."""
    t = spark.createDataFrame(DATED, "page_id long, html string").unionByName(read(spark, sf_dir, "pages").select("page_id", "html"))
    t = t.unionByName(read(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("page_id"), F.col("text").alias("html")))
    return t.select("page_id", F.array_join(W.visible_dates(F.col("html")), ",").alias("dates"))


@query(
    "merge_web_sources",
    f"""WITH s AS (SELECT page_id AS pos, url, html AS content, (page_id % 7) / 7.0::DOUBLE AS score, page_id % 3 = 0 AS authoritative, page_id % 5 = 0 AS noisy FROM pages),
k AS (SELECT *, {_key('url')} AS url_key, round(score + CASE WHEN authoritative THEN 1.0 ELSE 0.0 END + least(0.5, length(content) / 1000) - CASE WHEN noisy THEN 1.0 ELSE 0.0 END, 6) AS worth FROM s)
SELECT url_key, arg_max(pos, worth * 1000000 - pos / 1000000.0) AS best_pos, min(pos) AS first_pos, max(worth) AS worth FROM k GROUP BY url_key""",
)
def merge_web_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    s = p.select(F.col("page_id").alias("pos"), "url", F.col("html").alias("content"), (F.col("page_id") % 7 / 7.0).alias("score"), (F.col("page_id") % 3 == 0).alias("authoritative"), (F.col("page_id") % 5 == 0).alias("noisy"))
    return W.merged(s)
