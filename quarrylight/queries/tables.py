"""Table-agent queries over the star schema, and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import tables as A
from quarrylight.operators.retrieval import top
from quarrylight.queries.base import query, read, sql_values

_SQL = {"mean": "avg", "sum": "sum", "max": "max", "min": "min", "median": "median", "count": "count"}
for _op in _SQL:
    _digits = 2 if _op == "sum" else 4

    def _run(spark: SparkSession, sf_dir: str, op: str = _op, digits: int = _digits) -> DataFrame:
        li = read(spark, sf_dir, "lineitem")
        column = A.numeric_column(li, f"what is the {op} of the extendedprice")
        return A.aggregate(li, op, column).withColumn("value", F.round("value", digits))

    query(f"table_{_op}", f"SELECT round({_SQL[_op]}(l_extendedprice)::DOUBLE, {_digits}) AS value, count(l_extendedprice) AS n_used FROM lineitem")(_run)


QUESTIONS = [(1, "What is the average price of the apartments?"), (2, "Total quantity sold"), (3, "How many orders are there"), (4, "highest discount in the table"), (5, "median size"), (6, "smallest account balance"), (7, "summarize the orders"), (8, "price")]
TABLES = [(1, "lineitem quantity extendedprice discount tax sold"), (2, "orders totalprice orderdate status"), (3, "part name brand size price apartments"), (4, "customer account balance segment")]


@query("table_operation", f"""SELECT qid, CASE {' '.join(f"WHEN regexp_matches(lower(question), '(^|[^a-z])({w})($|[^a-z])') THEN '{n}'" for n, w in A.OPERATIONS)} ELSE 'mean' END AS operation FROM (SELECT qid::BIGINT AS qid, question FROM (VALUES {sql_values(QUESTIONS)}) AS t(qid, question) UNION ALL SELECT 1000 + item_id, text FROM benchmark)""")
def table_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("qid"), F.col("text").alias("question"))
    return spark.createDataFrame(QUESTIONS, "qid long, question string").unionByName(asked).select("qid", A.operation(F.col("question")).alias("operation"))


@query("table_match")
def table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = spark.createDataFrame(QUESTIONS, "qid int, question string"), spark.createDataFrame(TABLES, "table_id int, about string")
    return top(A.table_match(q, t), 1, "score", "table_id", by="qid")


@query("group_table_answer", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_discount <= 0.05 AND l_quantity >= 10 GROUP BY ALL")
def group_table_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_discount <= 0.05 and l_quantity >= 10")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n"))


@query("corpus_stats", "SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, count(DISTINCT lang) AS n_langs, sum(n_chars)::BIGINT AS n_chars, max(n_chars) AS longest FROM documents")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.countDistinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), F.max("n_chars").alias("longest"))


@query("inventory_answer", "SELECT 'The corpus holds ' || count(*) || ' documents of ' || count(DISTINCT source) || ' sources in ' || count(DISTINCT lang) || ' languages.' AS answer FROM documents")
def inventory_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = corpus_stats(spark, sf_dir)
    return s.select(F.format_string("The corpus holds %d documents of %d sources in %d languages.", "n_docs", "n_sources", "n_langs").alias("answer"))


@query("source_rows", "SELECT 'S' || row_number() OVER (ORDER BY doc_id) AS citation, 'doc ' || doc_id AS document, round(least(1.0, n_chars / 4096.0::DOUBLE), 6) AS score, CASE WHEN length(t) > 220 THEN rtrim(substring(t, 1, 219)) || '...' ELSE t END AS preview FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS t FROM documents)")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation numbers follow the order of ids: the index within its range partition plus the sizes of those before it, so no task sees all rows."""
    from quarrylight.functions import text as T
    from quarrylight.operators.order import numbered

    d = numbered(read(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), ["doc_id"], "nth")
    return d.select(F.concat(F.lit("S"), F.col("nth").cast("string")).alias("citation"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("document"), F.round(F.least(F.lit(1.0), F.col("n_chars") / 4096.0), 6).alias("score"), T.compact(F.col("text"), 220).alias("preview"))
