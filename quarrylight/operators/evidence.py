"""Evidence from several streams: components, ranking, dates, conflicts, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.scoring import clamp, mapped, squash
from quarrylight.operators.web import AUTHORITY_SCORE, any_of

# Words of identity documents and of scholarly ones.
PASSPORT = ("passport", "passp", "identity card", "date of birth", "place of birth")
SCHOLARLY = ("thesis", "prof", "professor", "supervisor", "advisor", "university", "publication", "cv")


def freshness(source_type: Column, document_date: Column, today: Column, dated: Column, days: int = 365) -> Column:
    """``dated``: the question asks for something that changes."""
    age = F.greatest(F.lit(0), F.datediff(today, document_date))
    return F.when(~dated, 0.65).when(source_type == "ai", 0.05).when(document_date.isNull(), F.when(source_type == "web", 0.45).otherwise(0.25)).otherwise(clamp(1.0 - age / days))


def entity_match(text: Column, terms: Column, lookup: Column) -> Column:
    hay = F.lower(text)
    n = F.size(terms)
    present = F.size(F.filter(terms, lambda t: F.array_contains(F.split(hay, "[^a-z0-9_]+"), t)))
    whole = F.contains(hay, F.array_join(terms, " ")) | F.contains(hay, F.array_join(F.reverse(terms), " "))
    return F.when(~lookup | (n == 0), 0.65).when(whole, 1.0).when(present == n, 0.9).when(present > 0, F.greatest(F.lit(0.15), present / n)).otherwise(0.0)


def authority_score(authority: Column) -> Column:
    return mapped(authority, AUTHORITY_SCORE, 0.55)


def consistency(source_type: Column, dated: Column, local_question: Column) -> Column:
    return F.when(source_type != "ai", 0.65).when(dated, 0.05).when(local_question, 0.10).otherwise(0.70)


def lookup_adjustment(text: Column) -> Column:
    t = F.lower(text)
    return F.when(any_of(t, PASSPORT), -0.18).when(any_of(t, SCHOLARLY), 0.08).otherwise(0.0)


def ranked(items: DataFrame, today: Column) -> DataFrame:
    """Scores items (``qid``, ``item``, ``source_type``, ``title``, ``content``, ``retrieval``, ``semantic``, ``authority``, ``document_date``) for a question's flags (``terms``, ``lookup``, ``dated``, ``local_question``, ``scientific``): ``score``, ``rank``."""
    text = F.concat_ws(" ", "title", "content")
    local = F.col("source_type") == "local"
    s = (
        0.30 * clamp(squash(F.col("retrieval"))) + 0.25 * clamp(F.col("semantic")) + 0.20 * entity_match(text, F.col("terms"), F.col("lookup")) + 0.10 * authority_score(F.col("authority"))
        + 0.10 * freshness(F.col("source_type"), F.col("document_date"), today, F.col("dated")) + 0.05 * consistency(F.col("source_type"), F.col("dated"), F.col("local_question"))
    )
    s = s + F.when(F.col("local_question") & local, 0.12).otherwise(0.0) - F.when(F.col("dated") & (F.col("source_type") == "ai"), 0.35).otherwise(0.0)
    s = s + F.when(F.col("lookup") & local, lookup_adjustment(text)).otherwise(0.0) + F.when(F.col("scientific") & F.col("authority").isin("university", "scientific_paper"), 0.06).otherwise(0.0)
    out = items.withColumn("score", F.round(clamp(s), 6))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item")))


def years(document_date: Column, title: Column, content: Column) -> Column:
    """Years of a document's date, title and first 500 characters."""
    return F.concat(F.array_compact(F.array(F.year(document_date))), F.transform(F.regexp_extract_all(F.concat_ws(" ", F.lit(""), title, F.substring(content, 1, 500), F.lit("")), F.lit("(?<![A-Za-z0-9_])(20[0-9]{2}|19[0-9]{2})(?![A-Za-z0-9_])"), F.lit(1)), lambda y: y.cast("int")))


def date_reconciliation(items: DataFrame) -> DataFrame:
    """``qid``, ``newest``, ``newest_web``, ``newest_local``, ``local_is_older``, from items with ``document_date``, ``title`` and ``content`` or with their ``years``."""
    found = F.col("years") if "years" in items.columns else years(F.col("document_date"), F.col("title"), F.col("content"))
    y = items.select("qid", "source_type", F.explode(found).alias("year"))
    g = y.groupBy("qid").agg(F.max("year").alias("newest"), F.max(F.when(F.col("source_type") == "web", F.col("year"))).alias("newest_web"), F.max(F.when(F.col("source_type") == "local", F.col("year"))).alias("newest_local"))
    return g.withColumn("local_is_older", F.coalesce(F.col("newest_local") < F.col("newest_web"), F.lit(False)))


def conflicts(rank: DataFrame) -> DataFrame:
    """``qid``, ``winner``, ``confidence``, ``agreement``: web wins for what changes, local for local questions, else the best item."""
    g = rank.groupBy("qid").agg(
        F.max(F.col("source_type") == "web").alias("has_web"), F.max(F.col("source_type") == "local").alias("has_local"), F.max("dated").alias("dated"), F.max("local_question").alias("local_question"),
        F.min_by(F.struct("source_type", "score"), "rank").alias("top"), F.countDistinct(F.when((F.col("rank") <= 4) & (F.col("source_type") != "ai"), F.col("item"))).alias("labels"),
    )
    t, s = F.col("top.source_type"), F.col("top.score")
    winner = F.when(F.col("dated") & F.col("has_web"), "web").when(F.col("local_question") & F.col("has_local"), "local").otherwise(t)
    confidence = (
        F.when(F.col("dated") & F.col("has_web"), F.when(t == "web", "high").otherwise("medium")).when(F.col("local_question") & F.col("has_local"), "high")
        .when(t == "local", F.when(s >= 0.70, "high").otherwise("medium")).when(t == "web", F.when(s >= 0.72, "high").otherwise("medium")).otherwise(F.when(F.col("dated"), "low").otherwise("medium"))
    )
    return g.select("qid", winner.alias("winner"), confidence.alias("confidence"), F.when(F.col("labels") > 1, "multiple sources").otherwise("single source").alias("agreement"))
