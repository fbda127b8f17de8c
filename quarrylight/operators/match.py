"""Matching names, documents and cached questions; confidence from scores."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarrylight.functions import text as T
from quarrylight.functions.scoring import clamp
from quarrylight.shared import saved

LEAST_NAME = 0.55
CACHE_SIMILARITY = 0.88
#: Questions that a cache holds, and distinct terms of questions that are broadcast at most.
CAPACITY = 250
MOST_TERMS = 1_000_000
#: Pairs of a question and a document that a task counts, about.
TASK_PAIRS = 1_000_000
#: Cached questions that are sent to the requests at most.
MOST_ENTRIES = 1000
# Words that don't distinguish questions.
CACHE_STOPWORDS = ["a", "an", "and", "are", "at", "by", "do", "does", "for", "from", "in", "is", "of", "on", "or", "please", "tell", "me", "the", "to", "was", "were", "what", "when", "where", "which", "who"]


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings by their longest matching blocks; no builtin gives it. Arrow batches, for small sides."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def name_score(asked: Column, filename: Column, title: Column) -> Column:
    """How well an asked name fits a file: the same name, the same stem, either holding the other, the title, else 0."""
    a, f, sa, sf, t = T.filename_key(asked), T.filename_key(filename), T.stem_key(asked), T.stem_key(filename), T.normalized(title)
    within = lambda x, y: (F.length(x) >= 3) & (F.contains(y, x))
    return F.when(a == f, 1.0).when((sa != "") & (sa == sf), 0.96).when(within(a, f) | within(f, a), 0.86).when(within(sa, sf) | within(sf, sa), 0.82).when(within(T.normalized(asked), t), 0.72).otherwise(0.0)


def name_matches(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """``qid``, ``document``, ``score``, ``rank``, ``ambiguous``: documents that an asked name (``qid``, ``name``) fits.

    Candidates share a three-letter piece of their stems or titles, so names meet only where one may hold the other. A
    question is ambiguous if its two best are near each other and neither is certain.
    """
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = asked.select("qid", "name", F.explode(pieces(T.stem_key(F.col("name")))).alias("piece"))
    d = documents.select("document", "title", F.explode(F.array_union(pieces(T.stem_key(F.col("document"))), pieces(key(F.col("title"))))).alias("piece"))
    met = a.join(d, "piece").select("qid", "name", "document", "title").distinct()
    best = met.withColumn("score", name_score(F.col("name"), F.col("document"), F.col("title"))).where(F.col("score") >= LEAST_NAME).groupBy("qid", "document").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "document")
    r = best.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).withColumn("first", F.max("score").over(Window.partitionBy("qid")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score"))).over(Window.partitionBy("qid"))
    return r.withColumn("ambiguous", F.coalesce((F.col("first") < 0.95) & (second >= 0.72) & (F.col("first") - second <= 0.08), F.lit(False))).drop("next", "first")


def metadata_matches(questions: DataFrame, documents: DataFrame, most: int = 8) -> DataFrame:
    """``qid``, ``document``, ``score``, ``rank`` by the words that a question shares with a document's description (``about``); larger documents (``size``) first on ties.

    Nearly every question shares a word with nearly every document, so the pairs are counted where the documents are:
    these are dealt by their name once, and if the questions' words are few enough (counted first) they are broadcast.
    Small documents make many pairs, so the number of tasks follows the pairs and is not left to the bytes that are dealt.
    Each task then hands on its ``most`` best of a question only.
    """
    words = lambda c: F.array_distinct(T.tokens(c))
    q = questions.select("qid", F.explode(words(F.col("question"))).alias("term"))
    d = T.held(documents.select("document", "size", "about"), w=words(F.col("about"))).select("document", "size", "w")
    if q.limit(MOST_TERMS + 1).count() <= MOST_TERMS:
        n = max(d.sparkSession.sparkContext.defaultParallelism, -(-documents.count() * questions.count() // TASK_PAIRS))
        hit = d.repartition(n, "document").select("document", "size", F.explode("w").alias("term")).join(F.broadcast(q), "term")
    else:
        hit = d.select("document", "size", F.explode("w").alias("term")).join(q, "term")
    hit = hit.groupBy("document", "size", "qid").agg(F.count("*").alias("n"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("size"), "document")
    scored = hit.withColumn("score", F.round(F.least(F.lit(1.0), 0.25 + F.col("n") * 0.12), 6))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("qid", "document", "score", "rank")


def importance(pages: Column, chunks: Column, has_summary: Column, has_keywords: Column, has_title: Column) -> Column:
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(0.36), F.greatest(F.lit(0), pages) / 300) + F.least(F.lit(0.3), F.greatest(F.lit(0), chunks) / 500) + flag(has_summary, 0.18) + flag(has_keywords, 0.1) + flag(has_title, 0.06)


def calibrated(score: Column, current: Column, agreement: Column, cited: Column) -> Column:
    """High, Medium or Low: less sure for what changes and without citations, blended with the sources' agreement."""
    s = clamp(score) * F.when(current, 0.9).otherwise(1.0)
    s = F.when(agreement > 0, s * 0.7 + clamp(agreement) * 0.3).otherwise(s) * F.when(cited, 1.0).otherwise(0.85)
    return F.when(s > 0.8, "High").when(s > 0.6, "Medium").otherwise("Low")


def payload_confidence(best: Column, official: Column, citations: Column, ai_only: Column) -> Column:
    return F.when(best.isNull() | ai_only, "Low").when((official & (best >= 0.68)) | ((citations >= 2) & (best >= 0.62)), "High").when((best >= 0.52) | (citations > 0), "Medium").otherwise("Low")


def extractive_confidence(best: Column, official: Column, labels: Column) -> Column:
    return F.when(best.isNull(), "Low").when((best >= 0.78) & ((labels >= 2) | official), "High").when((best >= 0.5) | (labels > 0), "Medium").otherwise("Low")


def cache_words(question: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit("[a-z0-9][a-z0-9'-]*"), F.lit(0)), lambda t: ~t.isin(CACHE_STOPWORDS) & (F.length(t) > 1)))


def cache_lookup(requests: DataFrame, entries: DataFrame, with_sequence: bool = False) -> DataFrame:
    """``rid``, ``eid``, ``similarity`` of the best cached question (``eid``, ``scope``, ``question``) for each request (``rid``, ``scope``, ``question``) of its scope: an equal one, else the most similar at 0.88 or more.

    Similarity is the larger of Jaccard and 0.96 of the overlap coefficient of words; ``with_sequence`` also takes the
    ratio of matching blocks. Candidates share a word. Entries are as few as a cache holds, so they are sent to the
    requests, which are shuffled once; pairs are compared where the request is. More entries meet them in an equi-join on words.
    """
    norm = lambda c: T.normalized(c)
    r = requests.select("rid", "scope", norm(F.col("question")).alias("rq"), cache_words(F.col("question")).alias("rw"))
    e = entries.select("eid", "scope", norm(F.col("question")).alias("eq"), cache_words(F.col("question")).alias("ew"))
    e = saved(e, "cache_entries")
    if e.limit(MOST_ENTRIES + 1).count() <= MOST_ENTRIES:
        once = lambda d, *keys, name: d.groupBy(*keys).agg(F.collect_list("scope").alias(name))  # noqa: E731  # repeated rows count as often as they are there
        pairs = once(r, "rid", "rq", "rw", name="rs").join(F.broadcast(once(e, "eid", "eq", "ew", name="es")), F.arrays_overlap("rs", "es"))
        times = F.aggregate("rs", F.lit(0), lambda n, s: n + F.size(F.filter("es", lambda x: x == s)))
        met = T.held(pairs, both=F.size(F.array_intersect("rw", "ew")) * times).where("both > 0").select("rid", "eid", "rq", "eq", "both", F.size("rw").alias("nr"), F.size("ew").alias("ne"))
    else:
        met = r.withColumn("w", F.explode("rw")).join(e.withColumn("w", F.explode("ew")), ["scope", "w"]).groupBy("rid", "eid", "rq", "eq").agg(F.count("*").alias("both"), F.first(F.size("rw")).alias("nr"), F.first(F.size("ew")).alias("ne"))
    s = F.greatest(F.coalesce(F.try_divide(F.col("both"), F.col("nr") + F.col("ne") - F.col("both")), F.lit(float("inf"))), F.col("both") / F.least("nr", "ne") * 0.96)
    s = F.greatest(s, sequence_ratio("rq", "eq")) if with_sequence else s
    met = met.withColumn("similarity", F.round(F.when(F.col("rq") == F.col("eq"), 1.0).otherwise(s), 6)).where(F.col("similarity") >= CACHE_SIMILARITY)
    return met.groupBy("rid").agg(F.max(F.struct("similarity", (-F.col("eid")).alias("neg"))).alias("x")).select("rid", (-F.col("x.neg")).alias("eid"), F.col("x.similarity").alias("similarity"))


def elected(candidates: DataFrame) -> DataFrame:
    """``qid``, ``name``, ``n_domains``, ``current``: the candidate of each question that most domains corroborate, current ones first."""
    g = candidates.groupBy("qid", "name").agg(F.max("current").alias("current"), F.countDistinct("domain").alias("n_domains"), F.max("score").alias("score"))
    return g.groupBy("qid").agg(F.max(F.struct("current", "n_domains", "score", "name")).alias("x")).select("qid", "x.name", "x.n_domains", "x.current")


def suggestions(templates: DataFrame, documents: DataFrame, most: int = 6) -> DataFrame:
    """``document``, ``rank``, ``prompt``, ``priority``: a document kind's templates (``kind``, ``template``, ``priority``) with the document's name, raised by 0.08 of its importance."""
    p = documents.join(templates, "kind").select("document", F.replace("template", F.lit("{subject}"), F.col("document")).alias("prompt"), F.round(F.col("priority") + F.col("importance") * 0.08, 6).alias("priority"))
    w = Window.partitionBy("document").orderBy(F.desc("priority"), "prompt")
    return p.groupBy("document", "prompt").agg(F.max("priority").alias("priority")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
