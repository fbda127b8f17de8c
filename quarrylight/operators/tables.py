"""The table agent: which operation, which column, which table, and the aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

# Question words of each operation, the first that fits counts.
OPERATIONS = (("mean", "mean|average|avg"), ("sum", "sum|total"), ("max", "max|maximum|highest|largest"), ("min", "min|minimum|lowest|smallest"), ("median", "median"), ("count", "count|how many|number of"))
NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")


def operation(question: Column) -> Column:
    c, q = None, F.lower(question)
    for name, words in OPERATIONS:
        test = q.rlike(rf"(^|[^a-z])({words})($|[^a-z])")
        c = F.when(test, name) if c is None else c.when(test, name)
    return c.otherwise("mean")


def numeric_column(df: DataFrame, question: str) -> str | None:
    """The first numeric column whose name shares a word with the question, else the first numeric one. Reads the schema only."""
    words = set(question.lower().replace("?", " ").replace("_", " ").split())
    numeric = [n for n, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]
    return next((n for n in numeric if words & set(n.lower().split("_"))), numeric[0] if numeric else None)


def aggregate(df: DataFrame, op: str, column: str) -> DataFrame:
    """One row: ``value``, ``n_used`` of a column, cast to a number where it can be."""
    x = F.col(column).try_cast("double")
    f = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "median": F.median, "count": F.count}[op]
    return df.agg(f(x).cast("double").alias("value"), F.count(x).alias("n_used"))


def formatted(value: Column) -> Column:
    """Thousands separated; two decimals unless the number is whole."""
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))


def table_match(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """``qid``, ``table_id``, ``score``: the share of a question's terms that a table's description (``about``) holds. An equi-join on terms: only pairs that share one exist."""
    q = questions.select("qid", T.query_terms(F.col("question")).alias("t")).select("qid", F.size("t").alias("n"), F.explode("t").alias("term"))
    d = tables.select("table_id", F.explode(T.query_terms(F.col("about"))).alias("term"))
    return q.join(d, "term").groupBy("qid", "table_id", "n").agg(F.count("*").alias("hit")).select("qid", "table_id", F.round(F.col("hit") / F.greatest(F.lit(1), "n"), 6).alias("score"))
