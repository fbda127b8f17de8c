"""Web-like sources: URL keys, source types, authority, priority boosts, links and dates of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "mkt_tok", "msclkid", "oly_enc_id", "ref", "ref_src", "spm", "utm"]

# Markers of each authority, the first that fits counts.
AUTHORITY = (
    ("official", ("gov", "gouv", "gouvernement", "government", "europa.eu", "public.lu", "who.int", "oecd.org", "worldbank.org")),
    ("university", (".edu", ".ac.", "university", "universite", "uni.lu", "harvard.edu", "mit.edu")),
    ("scientific_paper", ("nature.com", "science.org", "arxiv.org", "doi.org", "springer", "sciencedirect", "journal", "pubmed")),
    ("wikipedia", ("wikipedia.org",)),
    ("news", ("reuters", "apnews", "bbc", "financialtimes", "ft.com", "guardian")),
    ("blog", ("medium.com", "substack", "blog", "wordpress")),
    ("social_media", ("linkedin.com", "facebook.com", "x.com", "twitter.com", "instagram.com", "tiktok.com")),
)
# How far each authority is trusted.
AUTHORITY_SCORE = {"internal": 0.90, "university": 0.95, "scientific_paper": 0.95, "wikipedia": 0.70, "news": 0.80, "blog": 0.40, "social_media": 0.25, "model": 0.60, "standard": 0.55, "official": 1.00}

# Source types by domain markers and by words anywhere, the first that fits counts.
SOURCE_TYPES = (
    ("GitHub", ("github.com",), ()),
    ("Government", ("gouv", "gov.", ".gov", "government", "public.lu", "royal.uk"), ()),
    ("University", ("university", "uni.", ".edu", "edu.", "uni.lu", "college"), ()),
    ("Research", ("acm.org", "arxiv.org", "doi.org", "ieee.org", "semanticscholar.org", "researchgate.net", "sciencedirect.com", "zenodo.org"), ("journal", "paper", "publication", "thesis", "research explorer")),
    ("News", ("bbc.", "reuters.", "apnews.", "rtl.", "today.rtl", "nytimes.", "guardian.", "euronews."), ("news",)),
    ("Wikipedia", ("wikipedia.org", "wikimedia.org"), ()),
    ("Video", ("youtube.com", "youtu.be"), ()),
    ("Social media", ("linkedin.com", "facebook.com", "instagram.com", "x.com", "twitter.com"), ()),
    ("Blog", ("blog", "medium.com", "substack.com", "wordpress.com", "blogspot.", "reddit.com", "forum"), ()),
)


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Host without www. and default port, squeezed path without index page, query without tracking, sorted."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | (u == ""), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(domain(u), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^:]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"(?i)/(index|default)\.(html?|aspx?)$", "/")
    path = F.regexp_replace(path, "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    items = F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&")
    pairs = F.transform(items, lambda x: F.concat(F.lower(F.regexp_extract(x, "^([^=]*)=", 1)), F.lit("="), F.regexp_extract(x, "^[^=]*=(.*)$", 1)))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p.rlike("^utm_") & ~F.regexp_extract(p, "^([^=]*)=", 1).isin([*TRACKING, ""]) & ~p.rlike("=$")))
    query = F.array_join(kept, "&")
    return F.when(host == "", "").otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def any_of(text: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(m))
    return out


def authority(source_type: Column, url: Column, metadata: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", domain(url), F.coalesce(url, F.lit("")), F.coalesce(metadata, F.lit(""))))
    c = F.when(source_type == "local", "internal").when(source_type == "ai", "model")
    for name, markers in AUTHORITY:
        c = c.when(any_of(hay, markers), name)
    return c.otherwise("standard")


def source_type(url: Column, title: Column, content: Column) -> Column:
    d, hay = domain(url), F.lower(F.concat_ws(" ", title, url, content))
    c = None
    for name, domains, anywhere in SOURCE_TYPES:
        test = any_of(d, domains) | any_of(hay, anywhere) if anywhere else any_of(d, domains)
        c = F.when(test, name) if c is None else c.when(test, name)
    return c.otherwise("Web")


def boosted(score: Column, url: Column, markers, boost: float = 1.3) -> Column:
    s = F.coalesce(score, F.lit(0.5))
    return F.when(any_of(F.lower(F.coalesce(url, F.lit(""))), markers), F.least(F.lit(1.0), s * boost)).otherwise(s)


def deduped(pages: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    """The first row of each URL key."""
    keyed = pages.withColumn("url_key", url_key(F.col(url))).where(F.col("url_key") != "")
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("url_key").orderBy(order))).where("nth = 1").drop("nth")


def merged(sources: DataFrame) -> DataFrame:
    """Of rows with one URL key (``url``, ``content``, ``score``, ``authoritative``, ``noisy``, ``pos``) the best; keys in order of their first place."""
    worth = F.coalesce("score", F.lit(0.0)) + F.when(F.col("authoritative"), 1.0).otherwise(0.0) + F.least(F.lit(0.5), F.length("content") / 1000) - F.when(F.col("noisy"), 1.0).otherwise(0.0)
    k = sources.withColumn("url_key", url_key(F.col("url"))).withColumn("worth", F.round(worth, 6))
    return k.groupBy("url_key").agg(F.max_by("pos", F.struct("worth", -F.col("pos"))).alias("best_pos"), F.min("pos").alias("first_pos"), F.max("worth").alias("worth"))


def links(html: Column) -> Column:
    """Targets of a page's links."""
    return F.regexp_extract_all(html, F.lit('(?i)<a [^>]*href="([^"]*)"'), F.lit(1))


def visible_dates(text: Column, most: int = 5) -> Column:
    """The first distinct ISO dates of a text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0))), 1, most)
