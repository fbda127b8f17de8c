"""Normal forms, search forms and likeness of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.plans import normal as N
from quarrylight.queries.base import query, sql_list, sql_values
from quarrylight.queries.extract import SQ
from quarrylight.queries.plans import QUESTIONS, questions

MORE = [
    (-40, "How big is France's area?"), (-41, "what is the size of France"), (-42, "population of new york city in the united states"), (-43, 'Tell me about "solar wind" in Padua'), (-44, "Who is the prime minister of Luxembourg"), (-45, "prime minister Luxembourg"), (-46, "luxembourg capital city"),
    (-47, "The area of Rome"), (-48, "iPhone d'Artagnan Foo- bar"), (-49, "   "), (-50, None), (-51, "When was IBM founded?"), (-52, "André Éluard of andré in x"),
]
_E = lambda x: x.replace("'", "''")
_STOP = sql_list([*N.STOPWORDS, *(p for p, _ in N.PHRASES)])


def _loose(pattern: str) -> str:
    return f"list_transform(regexp_extract_all(wide, '{_E(pattern)}', 1), lambda x: array_to_string(list_reverse(list_slice(list_reverse(list_filter(regexp_extract_all(x, '[a-z][a-z0-9''-]*'), lambda w: NOT list_contains({_STOP}, w))), 1, 4)), ' '))"


_TERMS = f"flatten(list_transform(entities, lambda x: regexp_extract_all(lower(x), '{_E(N.TERM)}')))"
_SINGLE = "MAP {" + ", ".join(f"'{p}': '{a}'" for p, a in N.PHRASES if " " not in p) + "}"
NORMAL = f"""WITH q AS (SELECT qid::BIGINT AS qid, question FROM (SELECT * FROM (VALUES {sql_values(QUESTIONS + MORE)}) AS t(qid, question) UNION ALL SELECT item_id, text FROM benchmark)),
a AS (SELECT qid, question, {SQ.format("coalesce(question, '')")} AS t FROM q), b AS (SELECT *, replace(lower(t), ' ', '  ') AS wide, {SQ.format("regexp_replace(replace(lower(t), '''s', ' '), '[^a-z0-9_à-öø-ÿ'' \\t\\n\\r-]+', ' ', 'g')")} AS c FROM a),
c AS (SELECT *, list_concat(list_filter(list_transform(regexp_extract_all(t, '{_E(N.CAPITALISED)}', 1), lambda x: regexp_replace(x, '[''-]+$', '')), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, lower(x))), regexp_extract_all(t, '"([^"]+)"', 1), {_loose(N.BEHIND)}, {_loose(N.BEFORE)}) AS found FROM b),
d0 AS (SELECT *, list_filter(list_transform(found, lambda v: {SQ.format(f"lower(regexp_replace(v, '^[{N.OUTER}]+|[{N.OUTER}]+$', '', 'g'))")}), lambda v: v <> '') AS z FROM c),
d AS (SELECT *, list_transform(list_filter(z, lambda v, i: list_position(z, v) = i), lambda v: array_to_string(list_transform(string_split(v, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) AS entities FROM d0),
e AS (SELECT *, {_TERMS} AS et, list_filter([{', '.join(f"CASE WHEN regexp_matches(' ' || c || ' ', '[^a-z0-9_à-öø-ÿ]{p}[^a-z0-9_à-öø-ÿ]') THEN '{a}' END" for p, a in N.PHRASES)}], lambda x: x IS NOT NULL) AS meant, list_filter(string_split(c, ' '), lambda w: length(w) > 2 AND NOT list_contains({sql_list(N.STOPWORDS)}, w)) AS own FROM d),
f AS (SELECT *, list_concat(meant, list_filter(list_transform(own, lambda w: coalesce(({_SINGLE})[w], w)), lambda w: NOT list_contains(et, w)), et) AS y FROM e),
g AS (SELECT *, list_slice(list_filter(y, lambda v, i: list_position(y, v) = i), 1, {N.MOST_TERMS}) AS key_terms, array_to_string(list_slice(string_split(c, ' '), 1, 3), ' ') AS head FROM f),
n AS (SELECT qid, question, t, entities, et, key_terms, array_to_string(key_terms, ' ') AS canonical, CASE WHEN c = '' THEN 'statement' {' '.join(f"WHEN contains(head, '{_E(w)}') THEN '{k}'" for k, ws in N.INTENTS.items() for w in ws)} ELSE 'statement' END AS intent FROM g)"""


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).unionByName(spark.createDataFrame(MORE, "qid long, question string"))


@query("query_normal_form", NORMAL + " SELECT qid, intent, array_to_string(entities, '; ') AS entities, array_to_string(key_terms, '; ') AS key_terms, canonical FROM n")
def query_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normal(all_questions(spark, sf_dir)).select("qid", "intent", F.array_join("entities", "; ").alias("entities"), F.array_join("key_terms", "; ").alias("key_terms"), "canonical")


_OWN = "list_filter(key_terms, lambda k: NOT list_contains(et, k))"


@query(
    "query_search_forms",
    NORMAL
    + f""", s AS (SELECT *, array_to_string(entities, ' ') AS e, array_to_string(CASE WHEN len({_OWN}) > 0 THEN {_OWN} ELSE key_terms END, ' ') AS w FROM n), v AS (SELECT *, CASE WHEN e <> '' THEN e ELSE w END AS sub FROM s),
x AS (SELECT qid, list_filter(list_transform(list_filter([t, canonical, CASE WHEN e <> '' AND w <> '' THEN e || ' ' || w END, CASE WHEN e <> '' AND w <> '' THEN w || ' ' || e END, CASE WHEN intent IN ('what', 'statement') AND w <> '' THEN w || ' information' END, CASE WHEN list_contains(key_terms, 'area') THEN sub || ' area square kilometers' END,
  CASE WHEN list_contains(key_terms, 'area') THEN sub || ' total area' END, CASE WHEN list_contains(key_terms, 'population') THEN sub || ' population inhabitants' END], lambda f: f IS NOT NULL), lambda f: {SQ.format('lower(f)')}), lambda f: f <> '') AS fs FROM v)
SELECT DISTINCT qid, unnest(fs) AS form FROM x""",
)
def query_search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.search_forms(N.normal(all_questions(spark, sf_dir))).select("qid", F.explode("forms").alias("form"))


@query(
    "questions_alike",
    NORMAL
    + """, p AS (SELECT a.qid AS a, b.qid AS b, a.canonical AS ca, b.canonical AS cb, a.key_terms AS x, b.key_terms AS y, a.et AS ex, b.et AS ey FROM n a JOIN n b ON a.qid < b.qid AND len(list_intersect(a.key_terms, b.key_terms)) > 0)
SELECT a, b, ca = cb OR len(list_intersect(x, y)) / greatest(1, len(x), len(y)) >= 0.8 OR (len(list_intersect(ex, ey)) > 0 AND len(list_filter(x, lambda k: NOT list_contains(ex, k))) > 0 AND list_sort(list_filter(x, lambda k: NOT list_contains(ex, k))) = list_sort(list_filter(y, lambda k: NOT list_contains(ey, k)))) AS alike FROM p WHERE ca <> '' AND cb <> ''""",
)
def questions_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions that share a term; an equi-join on terms finds them."""
    n = N.normal(all_questions(spark, sf_dir)).select("qid", F.struct("canonical", "key_terms", "entities").alias("x"))
    terms = n.select("qid", F.explode("x.key_terms").alias("term"))
    met = terms.withColumnRenamed("qid", "ia").join(terms.withColumnRenamed("qid", "ib"), "term").where("ia < ib").select("ia", "ib").distinct()
    pairs = met.join(n.select(F.col("qid").alias("ia"), F.col("x").alias("a")), "ia").join(n.select(F.col("qid").alias("ib"), F.col("x").alias("b")), "ib")
    return pairs.select(F.col("ia"), F.col("ib"), N.alike(pairs).alias("alike")).toDF("a", "b", "alike")
