"""Interpretation of follow-ups in every conversation state, search plans and web queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.plans import interpret as I
from quarrylight.plans import questions as P
from quarrylight.queries.base import query, read, sql_list, sql_values
from quarrylight.queries.plans import SRC, _any, questions

ASKED = [
    (-1, "The president of the country"), (-2, "The smallest country in Europe"), (-3, "The president of the smallest country in Europe"), (-4, "Where is Alex from"), (-5, "When did the president come into power?"), (-6, "Which ones have erupted in history?"),
    (-7, "which lakes have erupted in the last 50 years?"), (-8, "Reuters"), (-9, "search bbc and tell me why"), (-10, "Who invented it?"), (-11, "Maria Rossi"), (-12, "How old is he?"), (-13, "How old was he when he will become president?"), (-14, "Who is the prime minister of Norway?"),
    (-15, "When did he take office?"), (-16, "list all volcanic lakes in the world"), (-17, "What is Bayesian inference?"), (-18, "which document mentions wind?"), (-19, "search the web for Spark"), (-20, "news channels about the election"), (-21, "Is it the same?"), (-22, ""), (-23, "who is the king"),
    (-24, "What are the known moons of Jupiter"), (-25, None), (-26, "the guardian and more"), (-27, "How old will she become director?"), (-28, "Tell me about the local files today"), (-29, "École Été"), (-30, "Did the finance minister of the UK resign?"),
]
#: sid, country, person, role, holder of the role, topic.
STATES = [
    (0, "", "", "", "", ""), (1, "France", "", "", "", ""), (2, "Luxembourg", "Luc Frieden", "Prime Minister", "Luc Frieden", ""), (3, "", "", "", "", "volcanic lakes"), (4, "", "Maria Rossi", "", "", "HMC"),
    (5, "Democratic Republic of the Congo", "Judith Suminwa", "President", "Félix Tshisekedi", ""), (6, "United Kingdom", "Keir Starmer", "Prime Minister", "", ""),
]
_COLUMNS = "sid int, country string, person string, role string, holder string, topic string"


def asked_in_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every constant question in every state (both are constants), and each passage of the benchmark as a question in one of them."""
    states = spark.createDataFrame(STATES, _COLUMNS)
    fixed = spark.createDataFrame([(q, t, s[0]) for q, t in ASKED for s in STATES], "qid long, question string, sid int")
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.pmod("item_id", F.lit(len(STATES))).cast("int").alias("sid"))
    return fixed.unionByName(passages).join(F.broadcast(states), "sid")


def _first(table: dict[str, str], x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '\\b{k}\\b') THEN '{v}'" for k, v in table.items()) + " ELSE '' END"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _phrase(x: str) -> str:
    return f"(CASE WHEN {x} IN ({', '.join(repr(c) for c in I.WITH_ARTICLE)}) THEN 'the ' || {x} ELSE {x} END)"


def _subst(x: str, by: str) -> str:
    return f"replace(regexp_replace({x}, '(?is)^(.*?)(^|{I.OUTER})(?:{I.PRONOUN_WORDS})($|{I.OUTER}.*$)', '\\1\\2' || chr(1) || '\\3'), chr(1), {by})"


_SQUEEZE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_NAME = I.NAME_WORD.replace("'", "''")
_LONGEST = dict(sorted(I.COUNTRIES.items(), key=lambda kv: (-len(kv[0]), kv[0])))
_TOPIC = lambda p, g: f"(SELECT CASE WHEN length(t) < 4 OR regexp_matches(t, 'local file|document|uploaded') THEN NULL ELSE t END FROM (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(n, '{p}', {g}), '{I.TOPIC_TAIL}', ''), '^(the|a|an) +', ''), '{I.TOPIC_WEAK}', '', 'g'), ' +', ' ', 'g')) AS t))"
_STORY = "CASE WHEN country <> '' AND role <> '' AND person <> '' THEN CASE WHEN country = 'United Kingdom' THEN 'UK' ELSE country END || ' ' || role || ' ' || person WHEN country <> '' THEN country || ' government' WHEN topic <> '' THEN topic ELSE own END"

STEPS = f"""WITH s AS (SELECT * FROM (VALUES {sql_values(STATES)}) AS v(sid, country, person, role, holder, topic)),
a AS (SELECT qid::BIGINT AS qid, question, sid FROM (VALUES {sql_values(ASKED)}) AS v(qid, question), (SELECT sid FROM s) UNION ALL SELECT item_id, text, (item_id % {len(STATES)})::INT FROM benchmark),
b AS (SELECT qid, trim(coalesce(question, '')) AS q, question, {_norm('question')} AS n, s.* FROM a JOIN s USING (sid)),
c AS (SELECT *, {_first(_LONGEST, 'n')} AS said, {_first(I.ROLES, 'n')} AS asked_role,
  list_distinct(list_filter([{', '.join(f"CASE WHEN regexp_matches(n, '{chr(92)}b{k}{chr(92)}b') THEN '{v}' END" for k, v in I.OUTLETS.items())}], lambda x: x IS NOT NULL)) AS named0, contains(n, 'news channel') AS channels,
  {_SQUEEZE.format("regexp_replace(" + _SQUEEZE.format("coalesce(question, '')") + ", '^[.,;:!?]+|[.,;:!?]+$', '', 'g')")} AS bare0,
  trim(regexp_replace(regexp_replace(n, '{I.SOURCE_FILLER}', ' ', 'g'), ' +', ' ', 'g')) AS rest, string_split({_norm('topic')}, ' ')[-1] AS head,
  coalesce({', '.join(_TOPIC(p, g) for p, g in I.TOPIC_ASKED)}, '') AS listed FROM b),
d AS (SELECT *, regexp_extract_all(bare0, '{_NAME}') AS w, CASE WHEN said <> '' THEN said ELSE country END AS place,
  CASE WHEN holder <> '' AND role <> '' THEN holder WHEN person <> '' THEN person ELSE topic END AS own, CASE WHEN role = asked_role AND asked_role <> '' THEN holder ELSE '' END AS held, NOT regexp_matches(n, '{I.SOURCE_MORE}') AND list_contains({sql_list(I.ONLY_SOURCE)}, rest) AS only_source,
  regexp_matches(n, '{I.PRONOUN}') AS pronoun, regexp_matches(n, '{I.OFFICE_START}') AS starts FROM c),
e AS (SELECT *, CASE WHEN bare0 <> '' AND NOT contains(coalesce(question, ''), '?') AND NOT regexp_matches(lower(bare0), '(^|{I.OUTER})({I.NO_PERSON})($|{I.OUTER})') AND len(w) BETWEEN 2 AND 5 AND len(list_filter(w, lambda x: length(x) <= 2)) = 0 THEN bare0 ELSE '' END AS bare,
  CASE WHEN topic = '' THEN '' WHEN starts_with(n, 'which ones') THEN replace(regexp_replace(q, '(?is)^(.*?)\\bwhich ones\\b(.*)$', '\\1Which ' || chr(1) || '\\2'), chr(1), topic) WHEN head <> '' AND (starts_with(n, 'which ' || head) OR starts_with(n, 'what ' || head)) THEN replace(CASE WHEN regexp_matches(q, '(?is)\\b' || head || 's?\\b') THEN regexp_replace(q, '(?i)\\b' || head || 's?\\b', chr(1)) ELSE q END, chr(1), topic) ELSE '' END AS again,
  list_filter({sql_list(list(dict.fromkeys(I.OUTLETS.values())))}, lambda x: channels OR list_contains(named0, x)) AS outlets,
  {_STORY} AS story, regexp_matches(n, '{I.ORIGIN}') AND topic <> '' AS origin, trim(regexp_extract(q, '(?is)^.*?\\b(?:he|she|they|him|her)?\\s*(?:will\\s+)?become\\s+(.+?)\\??$', 1)) AS becomes FROM d),
f AS (SELECT *, CASE WHEN only_source AND country <> '' THEN country || ' government' ELSE story END AS subject FROM e),
g AS (SELECT *, CASE WHEN regexp_matches(n, '{I.ANY_COUNTRY}') AND place = '' THEN 1 WHEN len(outlets) > 0 THEN 2 WHEN bare <> '' THEN 3 WHEN starts_with(n, 'how old') AND own <> '' THEN 4 WHEN regexp_matches(n, '{I.SUPERLATIVE}') THEN 5 WHEN place <> '' AND asked_role <> '' THEN 6 WHEN again <> '' THEN 7
  WHEN pronoun AND own <> '' THEN 8 WHEN listed <> '' THEN 9 WHEN regexp_matches(n, '{I.DEFINING}') AND NOT regexp_matches(n, '{I.NO_SCIENCE}') THEN 10 WHEN regexp_matches(n, '{I.LOCAL}') THEN 11 ELSE 12 END AS rule FROM f),
h AS (SELECT *, CASE rule WHEN 1 THEN 'clarification' WHEN 2 THEN 'news' WHEN 3 THEN 'person' WHEN 4 THEN 'current_or_public_fact' WHEN 6 THEN 'government' WHEN 8 THEN CASE WHEN origin THEN 'scientific_definition' ELSE 'follow_up' END WHEN 10 THEN 'scientific_explanation' WHEN 11 THEN 'local_document' WHEN 12 THEN 'general' ELSE 'public_knowledge' END AS intent,
  CASE rule WHEN 2 THEN CASE WHEN subject <> '' AND (only_source OR pronoun OR regexp_matches(n, '\\b(why|more|whether)\\b')) THEN 'What does ' || array_to_string(outlets, ', ') || ' report about ' || subject || '?' ELSE q END WHEN 3 THEN bare
    WHEN 4 THEN CASE WHEN role <> '' AND country <> '' AND contains(n, 'president') THEN 'How old was ' || own || ' when he became ' || role || ' of ' || {_phrase('country')} || '?' WHEN becomes <> '' THEN 'How old was ' || own || ' when he became ' || becomes || '?' ELSE {_subst('q', 'own')} END
    WHEN 6 THEN CASE WHEN starts THEN 'When did ' || CASE WHEN held <> '' THEN held ELSE 'the ' || asked_role END || ' become ' || asked_role || ' of ' || {_phrase('place')} || '?' WHEN held <> '' AND pronoun THEN {_subst('q', 'held')} ELSE 'Who is the ' || asked_role || ' of ' || {_phrase('place')} || '?' END
    WHEN 7 THEN again WHEN 8 THEN CASE WHEN starts AND role <> '' AND country <> '' THEN 'When did ' || own || ' become ' || role || ' of ' || {_phrase('country')} || '?' WHEN origin THEN 'Who introduced ' || topic || '?' ELSE {_subst('q', 'own')} END ELSE q END AS resolved,
  CASE rule WHEN 1 THEN country <> '' OR person <> '' OR topic <> '' OR holder <> '' WHEN 2 THEN subject <> '' WHEN 4 THEN true WHEN 6 THEN said = '' WHEN 7 THEN true WHEN 8 THEN true ELSE false END AS follow_up FROM g),
p AS (SELECT *, {_norm('resolved')} AS m FROM h),
o AS (SELECT qid, sid, intent, resolved, follow_up, rule = 1 AS clarify, rule <> 1 AS use_local, rule <> 1 AND (regexp_matches(m, '{I.WEB}') OR (rule <> 11 AND (rule IN (2, 4, 6) OR regexp_matches(m, '{I.CURRENT}') OR ({_first(I.ROLES, 'm')} <> '' AND NOT regexp_matches(m, '{I.OFFICE_START}'))))) AS use_web, rule NOT IN (1, 11) AS use_model, rule IN (2, 4, 6) AS fresh, outlets, subject,
  coalesce((MAP {{{', '.join(f"'{k}': '{v}'" for k, v in I.RESPONSE_MODES.items())}}})[intent], 'answer') AS response_mode, CASE WHEN rule = 2 THEN array_to_string(outlets, ', ') ELSE coalesce((MAP {{{', '.join(f"'{k}': '{v}'" for k, v in I.PREFERRED.items())}}})[intent], 'reliable web') END AS preferred FROM p)"""


@query("query_interpretation", STEPS + " SELECT qid, sid, intent, resolved, follow_up, clarify FROM o")
def query_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.interpreted(asked_in_states(spark, sf_dir)).select("qid", "sid", "intent", "resolved", "follow_up", "clarify")


@query("search_plan", STEPS + " SELECT qid, sid, intent, use_local, use_web, use_model, fresh, response_mode, preferred FROM o")
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.interpreted(asked_in_states(spark, sf_dir)).select("qid", "sid", "intent", "use_local", "use_web", "use_model", "fresh", "response_mode", "preferred")


_WIDE = " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in I.SUFFIXES.items())


@query(
    "web_query_widening",
    f"""WITH {SRC}, k AS (SELECT qid, trim(regexp_replace(question, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS q, CASE {' '.join(f'WHEN {_any(ms)} THEN {chr(39)}{n}{chr(39)}' for n, ms in P.DOMAINS)} ELSE 'general' END AS domain FROM q),
w AS (SELECT qid, unnest(list_concat([q], list_transform(CASE domain {_WIDE} END, lambda s: q || ' ' || s))) AS query, unnest(range(4)) AS pos FROM k WHERE q <> '') SELECT qid, arg_min(query, pos) AS query FROM w GROUP BY qid, lower(query)""",
)
def web_query_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.widened(questions(spark, sf_dir), P.domain(F.col("question")))
