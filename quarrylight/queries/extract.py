"""Queries of segmentation and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import extract as X
from quarrylight.operators import segment as S
from quarrylight.queries.base import query, read, sql_list, sql_values

SQ = r"trim(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
LINES = f"list_filter(list_transform(string_split(coalesce({{0}}, ''), chr(10)), lambda x: {SQ.format('x')}), lambda x: x <> '')"
SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query("sliding_chunks", "SELECT doc_id, i::INT AS chunk_index, doc_id || '-0-' || i AS chunk_id, trim(substring(t, (i * 880 + 1)::BIGINT, 1000)) AS text FROM (SELECT doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 1000) / 880.0))::BIGINT + 1)) AS i FROM (SELECT doc_id, trim(text) AS t FROM documents) WHERE t <> '')")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunks(docs(spark, sf_dir), S.sliding(F.col("text")))


@query("semantic_chunks")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A greedy fold, which SQL has not: the tests hold it against a loop."""
    return S.chunks(docs(spark, sf_dir), S.semantic(F.col("text")))


@query("doc_keywords", rf"""SELECT doc_id, string_agg(term, ',' ORDER BY r) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS r FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9\-]{{3,}}'), lambda x: lower(x))) AS term FROM documents) WHERE NOT list_contains({sql_list(S.KEYWORD_STOPWORDS)}, term) GROUP BY ALL)) WHERE r <= 12 GROUP BY doc_id""")
def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.keywords(docs(spark, sf_dir))


@query("doc_title", f"SELECT doc_id, coalesce(list_filter(list_slice({LINES.format('text')}, 1, 18), lambda x: length(x) BETWEEN 8 AND 180 AND len(string_split(x, ' ')) >= 2 AND NOT regexp_matches(lower(x), '^(abstract|keywords|doi|http)'))[1], 'doc ' || doc_id) AS title FROM documents")
def doc_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", S.title(F.col("text"), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("title"))


@query("section_heading", f"SELECT doc_id, coalesce(list_filter(list_slice({LINES.format('text')}, 1, 4), lambda x: length(x) <= 100 AND (regexp_matches(x, '^[0-9]+([.][0-9]+)*[.)]? +[A-Z]') OR regexp_matches(x, '^[A-Z][A-Za-z0-9 ,:-]+$')))[1], '') AS heading FROM documents")
def section_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", S.heading(F.col("text")).alias("heading"))


@query("doc_kind", "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in ms)} THEN '{n}'" for n, ms in S.KINDS) + " ELSE 'document' END AS kind FROM (SELECT doc_id, lower(substring(text, 1, 4000)) AS t FROM documents)")
def doc_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", S.kind(F.col("text")).alias("kind"))


@query("doc_summary", f"SELECT doc_id, array_to_string(list_slice(list_filter({SENT.format(SQ.format('text'))}, lambda s: length(s) >= 45 AND len(string_split(s, ' ')) >= 7), 1, 3), ' ') AS summary FROM documents")
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", S.summary(F.col("text")).alias("summary"))


@query("text_cleanup", f"SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {SQ.format('x')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS clean, length(regexp_replace(text, '([A-Za-z0-9_])-\\n([A-Za-z0-9_])', '\\1\\2', 'g')) AS joined_chars FROM documents")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.clean_extracted(F.col("text")).alias("clean"), F.length(T.dehyphenated(F.col("text"))).cast("long").alias("joined_chars"))


@query("sentences", f"SELECT doc_id, unnest({SENT.format('text')}) AS sentence FROM documents")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


FORMULAS = [
    (1, 1, "Let us model the outcome of interest as follows."), (1, 2, "y = beta0 + beta1 x_i + epsilon"), (1, 3, "+ gamma z_i ="), (1, 4, "where x_i is the dose"), (1, 5, "P(A|B) = P(B|A) P(A) / P(B)"), (2, 1, "∑ x_i^2 / n ≤ σ²"), (2, 2, "No formula here, only a long sentence about the weather in spring."), (2, 3, ""), (3, 1, "argmin f(x) = sum(x_i)"),
]


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant lines, and every line of every document."""
    f = spark.createDataFrame(FORMULAS, "doc_id long, pos int, line string")
    return f.unionByName(docs(spark, sf_dir).select((F.col("doc_id") + 1000).alias("doc_id"), F.posexplode(T.lines(F.col("text"))).alias("pos", "line")))


@query("formula_score")
def formula_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-behind has no counterpart in the other dialect."""
    return formula_lines(spark, sf_dir).select("doc_id", "pos", F.round(X.formula_score(F.col("line")), 6).alias("score"), X.formula_type(F.col("line"), F.lit("")).alias("formula_type"))


@query("formula_blocks")
def formula_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.formula_blocks(formula_lines(spark, sf_dir))


FORM_LINES = [(1, 1, "Surname: Müller"), (1, 2, "Date of birth: 12/03/1980"), (1, 3, "Passport no | AB-12345"), (1, 4, "Total: EUR 120.50"), (2, 1, "name: A. Person"), (2, 2, "email: a@b.org"), (2, 3, "unknown label: x"), (2, 4, "Email: A@B.org"), (3, 1, "Ref: 2024/AB-77 issued 2024-01-31")]
_P = r"^([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ .''-]{1,49}?) *[:|] *([^ ].*)$"
_ALIAS = sql_values([(a, c) for c, names in X.ALIASES.items() for a in names])


@query(
    "field_extract",
    f"""WITH l AS (SELECT * FROM (VALUES {sql_values(FORM_LINES)}) AS t(doc_id, pos, line)), a AS (SELECT * FROM (VALUES {_ALIAS}) AS t(alias, canonical)),
f AS (SELECT doc_id::BIGINT AS doc_id, lower(trim(regexp_extract(line, '{_P}', 1))) AS alias, trim(regexp_extract(line, '{_P}', 2)) AS value FROM l)
SELECT doc_id, canonical, value, 0.98::DOUBLE AS confidence FROM f JOIN a USING (alias) WHERE value <> ''
UNION ALL SELECT doc_id, canonical, trim(value) AS value, confidence FROM ({' UNION ALL '.join(f"SELECT doc_id, '{n}' AS canonical, unnest(regexp_extract_all(text, '{p}')) AS value, {c}::DOUBLE AS confidence FROM documents" for n, c, p in X.PATTERNS)})""",
)
def field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = X.labelled_fields(spark.createDataFrame(FORM_LINES, "doc_id long, pos int, line string"))
    return labelled.unionByName(X.pattern_fields(docs(spark, sf_dir).select("doc_id", "text")))


@query(
    "field_dedupe",
    f"""SELECT doc_id, canonical, max(value) AS value, max(confidence) AS confidence FROM ({' UNION ALL '.join(f"SELECT doc_id, '{n}' AS canonical, trim(unnest(regexp_extract_all(text, '{p}'))) AS value, {c}::DOUBLE AS confidence FROM documents" for n, c, p in X.PATTERNS)}) GROUP BY doc_id, canonical, lower(value)""",
)
def field_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dedupe_fields(X.pattern_fields(docs(spark, sf_dir).select("doc_id", "text")))


_PERSON = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿ''-]+( [A-Z][A-Za-zÀ-ÖØ-öø-ÿ''-]+){1,3}"
_ORG = r"(University|Université|Institute|Laboratory|Department|Faculty) of [A-Z][A-Za-z.''-]*( [A-Z][A-Za-z.''-]*){0,5}"
_DOI = r"10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+"
GRAPH_TEXT = [(1, "Maria Rossi works at University of Trento. She met Jan de Vries."), (2, "Jan Novak was supervised by Maria Rossi at the Institute of Physics, doi 10.1234/abc.5."), (3, "Maria Rossi and Jan Novak wrote 10.1234/abc.5 together."), (4, "no names here")]
ENT = f"""ent AS (SELECT doc_id, type, regexp_replace(v, '^[ .,;:]+|[ .,;:]+$', '', 'g') AS name, confidence FROM (
  SELECT doc_id, 'person' AS type, unnest(regexp_extract_all(text, '{_PERSON}')) AS v, 0.78::DOUBLE AS confidence FROM src UNION ALL
  SELECT doc_id, 'organization', unnest(regexp_extract_all(text, '{_ORG}')), 0.88 FROM src UNION ALL SELECT doc_id, 'publication', unnest(regexp_extract_all(text, '{_DOI}')), 0.9 FROM src)),
e AS (SELECT doc_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS normalized, type, min(name) AS name, max(confidence) AS confidence FROM ent GROUP BY ALL HAVING normalized <> '')"""
SRC = f"src AS (SELECT doc_id::BIGINT AS doc_id, text FROM (VALUES {sql_values(GRAPH_TEXT)}) AS t(doc_id, text) UNION ALL SELECT doc_id + 1000, text FROM documents)"


def graph_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(GRAPH_TEXT, "doc_id long, text string")
    return fixed.unionByName(docs(spark, sf_dir).select((F.col("doc_id") + 1000).alias("doc_id"), "text"))


@query("entity_extract", f"WITH {SRC}, {ENT.replace('GROUP BY ALL HAVING', 'GROUP BY doc_id, 2, type HAVING')} SELECT * FROM e")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.entities(graph_source(spark, sf_dir))


@query("relation_extract")
def relation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relations(graph_source(spark, sf_dir))


def _in(text: str, markers) -> str:
    return f"len(list_filter({sql_list(markers)}, lambda m: contains({text}, m))) > 0"


_CS = r"list_transform(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\[[SW][0-9]+\]', '', 'g'), '([.!?])[ \t\r\n]+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(" + SQ.format("s") + r", '^([-*]|[0-9]+[.)]) *', '')), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END)"
_LOW = "(' ' || lower(s) || ' ')"
_WORDS = "len(regexp_split_to_array(s, ' +'))"
_FACT = f"{_WORDS} >= 4 AND NOT {_in(_LOW, X.VAGUE)} AND ({_in(_LOW, X.FACT_VERBS)} OR regexp_matches(s, '(^|[^A-Za-z0-9_])[0-9]{{3,4}}($|[^A-Za-z0-9_])') OR (regexp_matches(s, '(^| )[A-Z]') AND {_WORDS} >= 6))"
CLAIMS = f"""SELECT doc_id, 'C' || n AS claim_id, s AS claim, CASE WHEN regexp_matches(s, '(^|[^0-9])[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,4}}($|[^0-9])|(^|[^A-Za-z0-9_])[0-9]{{4}}($|[^A-Za-z0-9_])') THEN 'date'
  WHEN {_in(_LOW, [' refers to ', ' means '])} THEN 'definition' WHEN {_in(_LOW, [' is ', ' are '])} THEN 'identity' WHEN {_in(_LOW, [' contains ', ' includes ', ' covers '])} THEN 'document_summary' ELSE 'factual' END AS claim_type
FROM (SELECT doc_id, unnest(c) AS s, generate_subscripts(c, 1) AS n FROM (SELECT doc_id, list_filter({_CS}, lambda s: {_FACT}) AS c FROM SOURCE_TABLE))"""


@query("claims_extract", CLAIMS.replace("SOURCE_TABLE", "documents"))
def claims_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.claims(docs(spark, sf_dir))


@query("calendar_dates", "SELECT o_orderkey, y || '-' || m || '-' || d AS dates FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same day written in three ways is one date; a month and year alone are none."""
    d = F.col("o_orderdate")
    text = F.concat_ws(" ", F.lit("On"), F.date_format(d, "d MMMM yyyy"), F.lit("or"), F.date_format(d, "MMM d, yyyy"), F.lit("("), F.date_format(d, "yyyy-MM-dd"), F.lit(") in May 1999."))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.calendar_dates(text), ",").alias("dates"))
