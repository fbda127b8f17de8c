"""Names, offices, ages: folding, compatibility, identity filters, tenure, ranking of pages about people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.web import any_of, domain

# Latin letters with marks, and without.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# Page addresses that tell nothing, and words of a finished term of office.
NOISY = ("facebook.com", "instagram.com", "linkedin.com/posts", "reddit.com", "tiktok.com", "twitter.com", "x.com", "youtube.com", "youtu.be")
LOW_QUALITY = ("gettyimages.", "getty.com", "shutterstock.", "istockphoto.", "alamy.", "dreamstime.", "123rf.", "depositphotos.", "pinterest.", "factsnippet.")
OFFICIAL = ("gov.", ".gov", "gouv", "government", "europa.eu", "public.lu")
UNIVERSITY = ("university", ".edu", "uni.", "ac.")
SCHOLARLY = ("arxiv.org", "doi.org", "ieee.org", "nature.com")
PRESS = ("reuters.", "apnews.", "bbc.", "euronews.")
ENDED = ("former ", "served as", "predecessor", "ex-president", "left office", "stepped down", "term ended")


def folded(text: Column) -> Column:
    """Lower case without marks on Latin letters."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)


def name_parts(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(folded(name), "[^a-z0-9]+", " ")), " "), lambda p: F.length(p) > 1)


def compatible(a: Column, b: Column) -> Column:
    """Whether two names can be one person's: one's parts within the other's, the same ends, or a shared part and the same last name."""
    x, y = name_parts(a), name_parts(b)
    shared = F.size(F.array_intersect(x, y))
    ends = (F.get(x, F.lit(0)) == F.get(y, F.lit(0))) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1)))
    last = (shared > 0) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1)))
    return (F.size(x) > 0) & (F.size(y) > 0) & F.coalesce((shared == F.least(F.size(x), F.size(y))) | ends | last, F.lit(False))


def mentions(text: Column, name: Column) -> Column:
    """The whole name, or all of its parts but one, or a single name."""
    hay, parts = F.split(F.regexp_replace(folded(text), "[^a-z0-9]+", " "), " "), F.filter(name_parts(name), lambda p: F.length(p) > 2)
    hit = F.size(F.array_intersect(F.array_distinct(parts), hay))
    n = F.size(F.array_distinct(parts))
    return F.when(n == 0, False).when(n == 1, hit == 1).otherwise(hit >= n - 1)


def age_on(birth: Column, day: Column) -> Column:
    before = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    return F.year(day) - F.year(birth) - before.cast("int")


def past_tenure(text: Column, role: Column) -> Column:
    """2.5 if a page tells of a finished term: ended, "was the <role>", or a closed range of years behind the role."""
    t = F.lower(F.coalesce(text, F.lit("")))
    at = lambda pattern: F.rlike(t, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pattern]))
    closed = at(["was (the )?", role]) | at([role, "[^.;]{0,40}(19|20)[0-9]{2} *[-–] *(19|20)[0-9]{2}"]) | at([role, "[^.;]{0,25}until (19|20)[0-9]{2}"])
    return F.when(any_of(t, ENDED) | closed, 2.5).otherwise(0.0)


def page_score(url: Column, title: Column, content: Column, terms: Column, base: Column) -> Column:
    """Additive rank of a page for a question's terms: who publishes it, what it shares with the question, what speaks against it."""
    hay, d = F.lower(F.concat_ws(" ", title, url, content)), F.lower(F.coalesce(url, F.lit("")))
    who = F.when(any_of(d, OFFICIAL), 4.0).when(any_of(d, UNIVERSITY), 3.0).when(any_of(d, SCHOLARLY), 2.8).when(any_of(d, PRESS), 2.0).otherwise(0.0)
    overlap = F.least(F.lit(2.0), F.size(F.filter(terms, lambda t: F.contains(hay, t))) * 0.25)
    against = F.when(any_of(hay, ("blog", "opinion", "editorial")), 1.5).otherwise(0.0) + F.when(any_of(d, LOW_QUALITY), 3.0).otherwise(0.0) + F.when(any_of(hay, NOISY), 2.5).otherwise(0.0)
    return who + overlap - against + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(base, F.lit(0.0))))


def relevant_pages(pages: DataFrame, name: str) -> DataFrame:
    """Pages (``url``, ``title``, ``content``) that mention a person and are no noise."""
    hay = F.concat_ws(" ", "title", "content")
    return pages.where(mentions(hay, F.lit(name)) & ~any_of(F.lower(F.concat_ws(" ", "url", "title", "content")), NOISY))


def corroborated(candidates: DataFrame) -> DataFrame:
    """Candidates (``name``, ``url``) that two domains at least name."""
    ok = candidates.groupBy("name").agg(F.countDistinct(domain(F.col("url"))).alias("n_domains")).where("n_domains >= 2")
    return candidates.join(ok, "name")


def best_date(candidates: DataFrame, issue: bool = False) -> DataFrame:
    """``doc_id``, ``date``: of dates with a context score (``doc_id``, ``date``, ``score``) the best; on ties the earliest for an issue date, else the latest; none at 0 or below."""
    c = candidates.where("score > 0")
    tie = -F.datediff("date", F.lit("1970-01-01").cast("date")) if issue else F.datediff("date", F.lit("1970-01-01").cast("date"))
    return c.groupBy("doc_id").agg(F.max_by("date", F.struct("score", tie)).alias("date"))


def first_sentence_with(text: Column, name: Column) -> Column:
    """The first sentence that holds the name, else the first 500 characters."""
    s = F.filter(T.sentences(text), lambda x: F.contains(F.lower(x), F.lower(name)))
    return F.coalesce(F.get(s, F.lit(0)), F.substring(F.trim(text), 1, 500))
