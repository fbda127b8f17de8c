"""Queries of forms, targets, citations and stated confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import answers as A
from quarrylight.operators import extract as X
from quarrylight.queries.base import query, read, sql_values
from quarrylight.queries.plans import SRC, questions
from quarrylight.queries.retrieval import qterms_sql

_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{A.WORD.format(w)}') THEN " + (f"CASE WHEN regexp_matches(t, '{A.WORD.format(A.ACADEMIC)}') THEN 'academic_document' ELSE 'certificate' END" if n == "certificate" else f"'{n}'") for n, w in A.FORM_CLASSES) + " WHEN numbered THEN 'form' ELSE 'unknown_structured_document' END"
_CODE = X.PATTERNS[0][2]
CLASSES = f"c AS (SELECT doc_id, {_CLASS} AS form_class FROM (SELECT doc_id, lower(text) AS t, regexp_matches(text, '{_CODE}') AS numbered FROM documents))"


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", A.form_class(F.col("text"), F.col("text").rlike(_CODE)).alias("form_class"))


@query("form_class", f"WITH {CLASSES} SELECT * FROM c")
def form_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir)


@query("form_confidence", f"WITH {CLASSES}, f AS ({' UNION ALL '.join(f'SELECT doc_id, unnest(regexp_extract_all(text, {chr(39)}{p}{chr(39)})) AS v, {c}::DOUBLE AS confidence FROM documents' for _, c, p in X.PATTERNS)}), m AS (SELECT doc_id, avg(confidence) AS m FROM f GROUP BY doc_id) SELECT doc_id, form_class, round(CASE WHEN m IS NULL THEN 0.0 ELSE least(1.0, m + CASE WHEN form_class <> 'unknown_structured_document' THEN 0.08 ELSE 0.0 END) END, 6)::DOUBLE AS confidence FROM c LEFT JOIN m USING (doc_id)")
def form_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.form_confidence(X.pattern_fields(read(spark, sf_dir, "documents").select("doc_id", "text")), classes(spark, sf_dir))


_TARGET = "CASE " + " ".join(f"WHEN contains(l, '{k}') THEN '{v}'" for k, v in A.TARGETS.items()) + " " + " ".join(f"WHEN regexp_matches(l, '{k}') THEN '{v}'" for k, v in A.LOOSE) + " END"
FORM_QUESTIONS = [(-101, "What is the date of birth?"), (-102, "When does it expire?"), (-103, "invoice total"), (-104, "which number"), (-105, "Surname on the passport")]


@query("field_target", f"WITH {SRC.replace('UNION ALL SELECT item_id', f'UNION ALL SELECT * FROM (VALUES {sql_values(FORM_QUESTIONS)}) AS f(a, b) UNION ALL SELECT item_id')} SELECT qid, {_TARGET} AS field FROM q")
def field_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).unionByName(spark.createDataFrame(FORM_QUESTIONS, "qid long, question string"))
    return q.select("qid", A.field_target(F.col("question")).alias("field"))


@query(
    "missing_citation",
    f"""WITH a AS (SELECT item_id AS answer_id, {qterms_sql('text')} AS t FROM benchmark), s AS (SELECT 'S' || doc_id AS label, (doc_id % 10) / 10.0::DOUBLE AS score, {qterms_sql('text')} AS t FROM documents),
ax AS (SELECT answer_id, len(t) AS na, unnest(t) AS term FROM a), sx AS (SELECT label, score, len(t) AS ns, unnest(t) AS term FROM s), h AS (SELECT answer_id, label, score, na, ns, count(*) AS n FROM ax JOIN sx USING (term) GROUP BY ALL),
w AS (SELECT answer_id, label, round(n / least(na, ns) + least(0.2, score * 0.2), 6)::DOUBLE AS worth FROM h)
SELECT answer_id, label, worth AS score FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY worth DESC, label) AS k FROM w WHERE worth >= 0.28) WHERE k = 1""",
)
def missing_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.col("text").alias("answer"))
    s = read(spark, sf_dir, "documents").select(F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("label"), "text", (F.col("doc_id") % 10 / 10.0).alias("score"))
    return A.missing_citation(a, s)


@query("stated_confidence", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'high' WHEN turn % 7 = 0 THEN 'low' WHEN conv_id % 2 = 0 AND turn % 3 > 0 THEN 'current-information' WHEN turn % 3 > 0 AND turn % 2 > 0 THEN 'local-web-assisted' WHEN turn % 3 > 0 THEN 'web-assisted' WHEN turn % 2 > 0 THEN 'local-grounded' ELSE 'model-only' END AS confidence FROM conversations")
def stated_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    answer = F.concat("text", F.when(t % 5 == 0, " Confidence: High.").when(t % 7 == 0, " I could not find it.").otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", A.stated_confidence(answer, F.col("conv_id") % 2 == 0, t % 3, t % 2).alias("confidence"))


@query("document_cards", "SELECT doc_id, 'Document: doc ' || doc_id || chr(10) || 'File: ' || source || CASE WHEN length(trim(substring(text, 1, 60))) > 0 THEN chr(10) || 'Summary: ' || substring(text, 1, 60) ELSE '' END || CASE WHEN n_chars > 0 THEN chr(10) || 'Size: ' || n_chars || ' characters' ELSE '' END AS card FROM documents")
def document_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", A.document_card(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.col("source"), F.substring("text", 1, 60), F.lit(None).cast("string"), F.col("n_chars")).alias("card"))


@query("formula_repair")
def formula_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word borders have no counterpart in the other dialect; tested against literals."""
    from quarrylight.queries.extract import formula_lines

    return formula_lines(spark, sf_dir).select("doc_id", "pos", A.repaired_formula(F.col("line")).alias("repaired"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(t, '{A.WORD.format(w)}') THEN '{k}'" for k, w in A.KIND_WORDS) + " ELSE 'document' END"
_NAMED = "CASE doc_id % 4 WHEN 0 THEN 'a.CSV' WHEN 1 THEN 'b.pptx' ELSE 'c.txt' END"


@query("document_type", f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'spreadsheet' WHEN 1 THEN 'presentation' ELSE {_KIND} END AS document_type FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth document is named as a table, the next as a presentation."""
    return read(spark, sf_dir, "documents").select("doc_id", A.document_type(F.expr(_NAMED), F.col("text")).alias("document_type"))


@query("requested_names")
def requested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-behind has no counterpart in the other dialect; tested against literals."""
    return questions(spark, sf_dir).select("qid", F.array_join(A.requested_names(F.col("question")), ",").alias("names"))


@query("answer_payload")
def answer_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrylight.queries.verify import ranked_items

    return A.payload(ranked_items(spark, sf_dir).withColumn("label", F.concat(F.lit("S"), F.col("item").cast("string"))))


from quarrylight.queries.base import SQL  # noqa: E402
from quarrylight.queries.verify import RANKED  # noqa: E402

SQL["answer_payload"] = RANKED + """, t AS (SELECT * FROM k WHERE rank <= 10), g AS (SELECT qid, string_agg('S' || item, ',' ORDER BY rank) AS citations, count(*) AS n_blocks, sum(length(substring(content, 1, 1200)))::BIGINT AS n_chars, coalesce(string_agg(DISTINCT source_type, ',' ORDER BY source_type) FILTER (source_type <> 'ai'), '') AS streams FROM t GROUP BY qid)
SELECT *, CASE WHEN contains(streams, ',') THEN 'hybrid' WHEN streams <> '' THEN streams ELSE 'model' END AS winner FROM g"""


@query("formula_variables")
def formula_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As formula_repair(): tested against literals."""
    from quarrylight.queries.extract import formula_lines

    lines = formula_lines(spark, sf_dir).where(F.contains("line", F.lit("=")))
    return lines.select("doc_id", "pos", F.explode(A.formula_variables(F.col("line"), F.lit("where x_i is the dose, and y denotes the outcome"))).alias("variable", "meaning"))
