"""Planning queries over constant questions and, as questions too, the benchmark's passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.plans import questions as P
from quarrylight.queries.base import query, read, sql_list, sql_values

QUESTIONS = [
    (-1, "What is the population of Luxembourg?"), (-2, "Who is the CEO of Example?"), (-3, "Summarize the uploaded documents"), (-4, "Explain Bayes theorem"), (-5, "latest news about the election"), (-6, "How old was he when he became president?"), (-7, "average price in the table"), (-8, "y = beta0 + x"),
    (-9, "Maria Rossi"), (-10, "compare cats and dogs"), (-11, "Why is the sky blue?"), (-12, "recommend a book"), (-13, "translate this to French"), (-14, "find papers on arxiv about spectral analysis"), (-15, "search the web for Spark"), (-16, "which document mentions wind?"), (-17, ""), (-18, "Who founded Example?"),
]
MESSAGES = [(1, "Hello!"), (2, "thanks"), (3, "What can you do?"), (4, "who are you"), (5, "  "), (6, "What is wind power?"), (7, "good  morning"), (8, None)]
NAMES = [(1, "Auto"), (2, "Local + AI + Web"), (3, "local_only"), (4, "hybrid"), (5, "Research Mode"), (6, "nonsense"), (7, "AI only"), (8, None), (9, "web")]
SRC = f"q AS (SELECT qid::BIGINT AS qid, question, lower(coalesce(question, '')) AS l FROM (SELECT * FROM (VALUES {sql_values(QUESTIONS)}) AS t(qid, question) UNION ALL SELECT item_id, text FROM benchmark))"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(QUESTIONS, "qid long, question string")
    return fixed.unionByName(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question")))


def _any(markers, x: str = "l") -> str:
    return f"len(list_filter({sql_list(markers)}, lambda m: contains({x}, m))) > 0"


def _m(pattern: str, x: str = "l") -> str:
    return f"regexp_matches({x}, '{pattern}')"


_SQ = r"trim(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"
_BARE = _SQ.format("regexp_replace(" + _SQ.format("coalesce(question, '')") + ", '^[.,;:!?]+|[.,;:!?]+$', '', 'g')")
_TERMS = f"list_filter(list_transform(regexp_extract_all(regexp_replace(b, '{P.ASKS_FOR.replace(chr(39), chr(39) * 2)}', ''), '[{P.LETTER}][{P.LETTER}''’-]+'), lambda x: lower(regexp_replace(x, '^[''’]+|[''’]+$', '', 'g'))), lambda x: length(x) > 1 AND NOT list_contains({sql_list([*P.NO_STATEMENT, *P.NO_TERMS])}, x))"
CLASS = f"""WITH {SRC},
h AS (SELECT *, starts_with(l, 'how old') AND {_any(P.TENURE)} AS hist, NOT {_m(P.RATES)} AND {_m(P.DEFINE)} AND NOT {_m(P.FRESH)} AS stable FROM q),
f AS (SELECT *, {_any(P.LOCAL)} AS local, ({_any(P.CURRENT)} OR ({_any(P.DYNAMIC)} AND NOT stable AND NOT hist)) AND NOT hist AS current, {_any(P.RESEARCH)} AS research, {_any(P.LOOKUP)} OR (contains(b, ' ') AND NOT contains(coalesce(question, ''), '?') AND NOT regexp_matches(lower(b), '(^|{P.OUTER})({P.VERBS})($|{P.OUTER})') AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda x: length(x) <= 2 OR list_contains({sql_list(P.NO_STATEMENT)}, x))) = 0) AS lookup
  FROM (SELECT *, list_transform(regexp_extract_all(b, '[A-Za-z][A-Za-z''’-]+'), lambda x: lower(regexp_replace(x, '^[''’]+|[''’]+$', '', 'g'))) AS w FROM (SELECT *, {_BARE} AS b FROM h))),
t AS (SELECT *, CASE WHEN local THEN 'local_document' WHEN {_any(P.NEWS)} THEN 'news' WHEN current THEN 'dynamic' WHEN lookup AND {_any(P.COMPANY)} THEN 'company_lookup' WHEN lookup THEN 'person_lookup' WHEN research OR {_any(P.SCIENTIFIC)} THEN 'scientific' ELSE 'stable' END AS fact_type,
  CASE WHEN current THEN 'time_sensitive' WHEN local THEN 'local' WHEN research THEN 'research' ELSE 'general' END AS primary_ FROM f),
p AS (SELECT *, CASE WHEN fact_type = 'local_document' THEN 'local_only' WHEN fact_type IN ('dynamic', 'news') OR current THEN 'web_only' ELSE 'local_model_web' END AS policy FROM t)"""


@query("classify_question", CLASS + ' SELECT qid, local, current, research, lookup, fact_type, primary_ AS "primary", policy, concat_ws(\',\', CASE WHEN local THEN \'local\' END, CASE WHEN current THEN \'time_sensitive\' END, CASE WHEN research THEN \'research\' END, CASE WHEN NOT local AND NOT current AND NOT research THEN \'general\' END) AS types, current OR research OR lookup AS needs_web, current AS needs_dates, NOT current AS model_may_decide, CASE WHEN lookup THEN array_to_string(' + _TERMS + ', \' \') ELSE \'\' END AS entity_terms FROM p')
def classify_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.classified(questions(spark, sf_dir)).drop("question")


@query("query_domain", f"WITH {SRC} SELECT qid, CASE {' '.join(f'WHEN {_any(ms)} THEN {chr(39)}{n}{chr(39)}' for n, ms in P.DOMAINS)} ELSE 'general' END AS domain FROM q")
def query_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", P.domain(F.col("question")).alias("domain"))


@query("intent_route", f"SELECT id, CASE WHEN m = '' THEN 'empty' {' '.join(f'WHEN list_contains({sql_list(v)}, m) THEN {chr(39)}{k}{chr(39)}' for k, v in P.ROUTES.items())} ELSE 'rag' END AS route FROM (SELECT id, trim(regexp_replace(regexp_replace(lower(coalesce(t, '')), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS m FROM (SELECT id::BIGINT AS id, t FROM (VALUES {sql_values(MESSAGES)}) AS v(id, t) UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations))")
def intent_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("t"))
    return spark.createDataFrame(MESSAGES, "id long, t string").unionByName(said).select("id", P.route(F.col("t")).alias("route"))


@query("search_mode", f"SELECT id, coalesce((MAP {{{', '.join(f'{chr(39)}{k}{chr(39)}: {chr(39)}{v}{chr(39)}' for k, v in P.MODE_ALIASES.items())}}})[m], 'auto') AS mode FROM (SELECT id, trim(regexp_replace(translate(lower(coalesce(t, '')), '+-_', '   '), ' +', ' ', 'g')) AS m FROM (SELECT id::BIGINT AS id, t FROM (VALUES {sql_values(NAMES)}) AS v(id, t) UNION ALL SELECT 1000 + event_id, event_type FROM events))")
def search_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("id"), F.col("event_type").alias("t"))
    return spark.createDataFrame(NAMES, "id long, t string").unionByName(asked).select("id", P.mode(F.col("t")).alias("mode"))


_RULE = {"yes": "true", "no": "false", "stable": "NOT dynamic", "ready": "web_enabled"}


@query("policy_matrix", "SELECT mode, web_enabled, dynamic, " + ", ".join(f"CASE mode {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {_RULE[r[k]]}' for m, r in P.MODES.items())} END AS {c}" for k, c in enumerate(("use_local", "use_ai", "use_web", "ai_as_evidence"))) + f" FROM (SELECT unnest({sql_list(P.MODES)}) AS mode), (VALUES (true), (false)) AS w(web_enabled), (VALUES (true), (false)) AS d(dynamic)")
def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.policy_table(spark)


_TYPE = rf"""CASE WHEN regexp_matches(question, '\\(alpha|beta|theta|lambda|sigma|sum|int|sqrt)|[α-ωΑ-Ω∑∫≈∝≤≥=]') OR {_m(P.WORD.format('formula|equation|notation'))} THEN 'formula' WHEN {_m(P.AGGREGATE)} AND {_m(P.TABLE)} THEN 'table_calculation'
WHEN fact_type = 'local_document' AND {_m(P.SUMMARY)} THEN 'local_document_summary' WHEN fact_type = 'local_document' THEN 'local_document' WHEN fact_type = 'news' THEN 'news' WHEN fact_type = 'dynamic' THEN 'current_dynamic_fact' WHEN {_m(P.WORD.format('what is|define|explain|meaning of'))} THEN 'definition'
WHEN fact_type = 'scientific' THEN 'scientific_explanation' WHEN fact_type = 'person_lookup' THEN 'person_lookup' WHEN fact_type = 'company_lookup' THEN 'company_lookup' WHEN {_m(P.WORD.format('compare|versus|vs|difference between'))} THEN 'comparison' WHEN {_m(P.WORD.format('translate|translation'))} THEN 'translation'
WHEN {_m(P.WORD.format('calculate|compute|solve'))} THEN 'calculation' WHEN {_m(P.WORD.format('recommend|suggest|best'))} THEN 'recommendation' WHEN {_m(P.WORD.format('why|reason|infer|deduce'))} THEN 'reasoning' ELSE 'general' END"""


@query(
    "action_plan",
    CLASS + f""", ty AS (SELECT *, {_TYPE} AS question_type, fact_type IN ('dynamic', 'news') AS dyn FROM p), md AS (SELECT unnest({sql_list(P.MODES)}) AS mode)
SELECT qid, mode, question_type, concat_ws(',', CASE WHEN mode <> 'web_only' THEN 'search_local' END, CASE WHEN mode <> 'web_only' AND question_type = 'formula' THEN 'retrieve_formula' END, CASE WHEN mode <> 'web_only' AND question_type = 'table_calculation' THEN 'extract_table,calculate' END,
CASE WHEN mode <> 'web_only' AND question_type = 'local_document_summary' THEN 'summarize_documents' END, CASE WHEN mode NOT IN ('web_only', 'local_only') AND question_type IN ('person_lookup', 'company_lookup', 'scientific_explanation', 'definition') THEN 'build_graph_context' END,
CASE WHEN mode IN ('auto', 'local_ai', 'local_ai_web', 'research') AND policy <> 'local_only' AND NOT dyn THEN 'answer_model' END,
CASE WHEN mode = 'web_only' OR (mode <> 'local_only' AND (mode IN ('local_ai_web', 'research') OR {_m(P.ONLINE)} OR dyn OR (policy <> 'local_only' AND mode = 'auto'))) THEN 'search_web' END) AS actions FROM ty, md""",
)
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of every question in every mode (seven constants), web enabled and ready."""
    out = None
    for m in P.MODES:
        one = P.actions(questions(spark, sf_dir), F.lit(m), F.lit(True), F.lit(True)).select("qid", F.lit(m).alias("mode"), "question_type", "actions")
        out = one if out is None else out.unionByName(one)
    return out


@query("short_entity", "SELECT qid, q <> '' AND NOT ends_with(q, '?') AND len(w) BETWEEN 1 AND 5 AND CASE WHEN len(w) = 1 THEN regexp_matches(q, '^[A-Z]') ELSE len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= greatest(2, len(w) - 1) END AND lower(w[1]) NOT IN ('what','who','when','where','which','why','how','is','are','does','do','can','tell','show','find','search') AS short_entity FROM (SELECT qid, q, string_split(q, ' ') AS w FROM (SELECT qid, trim(regexp_replace(question, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS q FROM (WITH " + SRC + " SELECT * FROM q)))")
def short_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", P.short_entity(F.col("question")).alias("short_entity"))


@query("query_variants")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-behind has no counterpart in the other dialect; tested against literals."""
    return questions(spark, sf_dir).select("qid", F.explode(P.variants(F.col("question"))).alias("variant"))


@query("query_terms", "")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("qid", F.array_join(T.query_terms(F.col("question")), " ").alias("terms"))


from quarrylight.queries.base import SQL  # noqa: E402
from quarrylight.queries.retrieval import qterms_sql  # noqa: E402

SQL["query_terms"] = f"WITH {SRC} SELECT qid, array_to_string({qterms_sql('question')}, ' ') AS terms FROM q"
