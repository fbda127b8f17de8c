"""Joins of sets that share many terms, exact and without the pairs that share few.

The sets of one side are few enough to be asked about (claims, questions), those of the other are a corpus. A set's terms are
ordered from the rarest in the corpus to the commonest. If a partner has to share at least m of n terms, it holds at least h of
the first n - m + h, so the commonest terms, which would bring nearly every pair, need not be looked up (prefix filter); how
many it has to share follows from the score wanted and its own size (length filter). The score wanted is that of the k-th best
among partners found by the rarest terms alone. Only pairs that pass are compared set against set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.shared import saved

#: Postings of a set's rarest terms that are read to find a first k-th best score, and partners scored for it as a multiple of k.
SEED_POSTINGS, SEED_PARTNERS = 400, 4
#: Share of the terms a partner has to share that it must show in the prefix: more reads more postings and leaves fewer pairs.
DEPTH = 0.5
#: Rows of asked terms that are sent to all tasks at most; beyond that both sides are shuffled by term.
MOST_TERMS = 500_000
#: Pairs of ids that are sent to all tasks at most.
MOST_PAIRS = 200_000
#: Postings of a term in one piece of the shuffled join.
PIECE = 100_000
#: Scores are rounded to six decimals before they are compared.
HALF = 1e-6


@dataclass
class Found:
    """``pairs``: ``lid``, ``rid``, ``both``, ``nl``, ``nr``, ``score``, the ``k`` best of each ``lid``. ``work``: one row of ``all_postings`` (what a join on every term reads), ``postings`` read and ``scored`` pairs."""

    pairs: DataFrame
    work: DataFrame


def _postings(sets: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """``asked`` (``term``, ``pieces`` and others) met with the corpus's ``rid``, ``nr``, ``term``. A term of many postings is met in pieces where both sides are shuffled."""
    each = sets.select("rid", "nr", F.explode("own").alias("term"))
    if few:
        return each.join(F.broadcast(asked), "term")
    hot = asked.where("pieces > 1").select("term", "pieces").distinct()  # at most one in PIECE postings
    dealt = each.join(hot, "term", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    return dealt.join(asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))), ["term", "piece"])


def best_partners(left: DataFrame, right: DataFrame, k: int, slope: Callable[[Column, Column], Column], also: DataFrame | None = None, extra: float = 0.0) -> Found:
    """For each set of ``left`` (``lid``, ``terms``: distinct) the ``k`` sets of ``right`` (``rid``, ``terms``) with the best score, ties to the smaller ``rid``; sets that share no term are no partners.

    The score is ``slope(nl, nr)`` times the number of shared terms, 1 at most, rounded to six decimals. Pairs in ``also``
    (``lid``, ``rid``) get ``extra`` more, 1 at most, and are looked at in any case. Ids are distinct on either side; null ids
    and empty sets have no partners.
    """
    lefts = saved(left.where("lid IS NOT NULL").select("lid", F.size("terms").alias("nl"), "terms"), "asked_sets")
    sets = saved(right.where(F.col("rid").isNotNull() & (F.size("terms") > 0)).select("rid", F.size("terms").alias("nr"), F.col("terms").alias("own")), "corpus_sets")
    asked = lefts.select("lid", "nl", F.explode("terms").alias("term"))
    few = lefts.agg(F.coalesce(F.sum("nl"), F.lit(0))).collect()[0][0] <= MOST_TERMS
    sent = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    words = asked.select("term").distinct()
    df = sets.select(F.explode("own").alias("term")).join(sent(words), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("lid").orderBy("df", "term")
    ranked = asked.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumn("place", F.row_number().over(rare) - 1).withColumn("before", F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = saved(ranked.where("df > 0").withColumn("pieces", F.ceil(F.col("df") / PIECE).cast("int")), "ranked_terms")

    marked = None if also is None else also.where("lid IS NOT NULL AND rid IS NOT NULL").select("lid", "rid").distinct()

    def scored(pairs: DataFrame, n: int) -> DataFrame:
        """The ``n`` pairs at most with the terms that they share; nothing but a pair's own sets is compared. Few pairs go to where the sets are, which are not shuffled then."""
        pairs = F.broadcast(pairs) if n <= MOST_PAIRS else pairs
        met = sets.join(pairs, "rid").join(sent(lefts), "lid").select("lid", "rid", "nl", "nr", F.size(F.array_intersect("terms", "own")).alias("both"))
        own = F.least(F.lit(1.0), F.col("both") * slope(F.col("nl"), F.col("nr")))
        if marked is None:
            return met.withColumn("score", F.round(own, 6))
        met = met.join(sent(marked.withColumn("also", F.lit(True))), ["lid", "rid"], "left")
        return met.withColumn("score", F.round(F.least(F.lit(1.0), own + F.when(F.col("also"), F.lit(extra)).otherwise(0.0)), 6)).drop("also")

    first = _postings(sets, ranked.where(F.col("before") < SEED_POSTINGS).select("lid", "term", "pieces"), few).groupBy("rid", "lid").agg(F.count("*").alias("n"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("n"), "rid"))).where(F.col("nth") <= SEED_PARTNERS * k)
    asking = lefts.count() * SEED_PARTNERS * k
    kth = scored(first.select("lid", "rid"), asking).withColumn("nth", F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("score")))).where(F.col("nth") == k)
    floors = saved(kth.select("lid", F.col("score").alias("floor")), "floors")  # a row a set asked about

    wanted = ranked.join(sent(floors), "lid", "left").select("lid", "nl", "term", "place", "pieces", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("floor") - HALF) / slope(F.col("nl"), F.col("nr")) - HALF))
    met = F.ceil(needed * DEPTH)
    read = _postings(sets, wanted, few).where(F.col("place") <= F.col("nl") - needed + met - 1)
    able = saved(read.groupBy("rid", "lid", "nl", "nr", "floor").agg(F.count("*").alias("hits")).withColumn("able", F.col("hits") >= met).select("rid", "lid", "hits", "able"), "able_pairs")
    work = ranked.agg(F.sum("df").alias("all_postings")).crossJoin(able.agg(F.sum("hits").alias("postings"), F.count_if("able").alias("scored")))  # two rows of one
    able = able.where("able")
    pairs = able.select("lid", "rid") if marked is None else able.select("lid", "rid").union(marked).distinct()
    best = scored(pairs, able.count() + (0 if marked is None else marked.count())).where("both > 0").withColumn("nth", F.row_number().over(Window.partitionBy("lid").orderBy(F.desc("score"), "rid"))).where(F.col("nth") <= k)
    return Found(best.drop("nth"), work)
