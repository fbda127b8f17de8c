"""Queries of office-holders: each document makes a statement about people who are named after its first words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import offices as O
from quarrylight.operators import people as P
from quarrylight.queries.base import query, read, sql_list
from quarrylight.queries.web import _any

#: Role, title and content of the statements, dealt by document number: {n} is the name, {g} and {f} its parts, {u} the last in capitals.
FORMS = (
    ("prime minister", "{n} | Portal", "Yesterday in {f}. Rt. Hon. {n} MP, the Prime Minister, spoke."),
    ("prime minister", "Archive", "{n} became the Prime Minister in 2010."),
    ("president", "Profile", "Dr {n} is the current President of {f}"),
    ("president", "{u} {g} - The Government", "Current role: President"),
    ("secretary of state", "U.S. Department of State", "Mr {n} was sworn in as the 70th Secretary of State"),
    ("king", "Royal house of {f}", "King {n} visits {g}"),
    ("president", "President {g} {u} Army of {f}", "{f} said so."),
)
HOSTS = ("www.gov.example", "{f}.example.org", "{g}.example.com", "{f}.example.org")


def _said(template: Column) -> Column:
    for mark, value in (("{n}", F.concat("g", F.lit(" "), "f")), ("{g}", F.col("g")), ("{f}", F.col("f")), ("{u}", F.upper("f"))):
        template = F.replace(template, F.lit(mark), value)
    return template


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per document with two words: question by source and role, a country for every other source."""
    form = lambda k: F.get(F.array(*[F.lit(x[k]) for x in FORMS]), (F.col("doc_id") % len(FORMS)).cast("int"))
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.initcap(F.get(w, F.lit(0))).alias("g"), F.initcap(F.get(w, F.lit(1))).alias("f")).where("f IS NOT NULL")
    host = F.get(F.array(*[F.lit(x) for x in HOSTS]), F.length("f") % len(HOSTS))
    d = d.select("*", F.col("doc_id").alias("source_id"), F.concat_ws("/", "source", form(0)).alias("qid"), form(0).alias("role"), F.when(F.length("source") == 4, F.col("source")).alias("country"), F.concat(F.lit("W"), F.col("doc_id").cast("string")).alias("label"))
    return T.held(d, url=F.lower(F.concat(F.lit("https://"), _said(host), F.lit("/"))), title=_said(form(1)), content=_said(form(2))).drop("doc_id", "source", "g", "f")


def _sql_said(values) -> str:
    x = f"({sql_list(values)})[doc_id % {len(FORMS)} + 1]" if len(values) == len(FORMS) else f"({sql_list(values)})[length(f) % {len(HOSTS)} + 1]"
    return f"replace(replace(replace(replace({x}, '{{n}}', g || ' ' || f), '{{g}}', g), '{{f}}', f), '{{u}}', upper(f))"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _bare(x: str) -> str:
    return f"trim({x}, {_lit(O.EDGES)})"


def _plain(x: str) -> str:
    return f"trim(lower({_bare(x)}), '''’')"


def _cap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, '-'), lambda p: upper(p[1:1]) || lower(p[2:])), '-')"


def _cut(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace(trim({x}), {_lit(O.HONORIFICS)}, ''), {_lit(O.TITLES)}, ''), {_lit(O.LETTERS_BEHIND)}, '', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({bare}, {_lit(O.SENTENCE_BEFORE)}, '\\2'), '(?i)[''’]s$', ''), {_lit(O.VERB_BEHIND)}, '')"


def _names_sql() -> str:
    """Raw matches of every statement, then cleaned words, then names of persons."""
    raw = []
    for from_title, text in ((False, "content"), (True, "title")):
        for n, (role, pattern, kind) in enumerate(O.STATEMENTS):
            raw.append(f"SELECT source_id, {n + 100 * from_title} AS pos, regexp_extract({text}, {_lit(pattern)}, 1) AS raw, '{kind}' AS kind, {from_title} AS from_title FROM s WHERE role = '{role}'")
    head = r"trim(string_split_regex(title, '\s+\|\s+|\s+-\s+')[1])"
    raw.append(rf"SELECT source_id, 200 AS pos, CASE WHEN regexp_full_match(h, '[A-Z][A-Z\-'']+\s+[A-Z][a-z\-'']+') THEN regexp_extract(h, '^\S+\s+(\S+)$', 1) || ' ' || regexp_extract(h, '^(\S+)\s', 1) ELSE h END AS raw, 'current' AS kind, true AS from_title FROM (SELECT *, {head} AS h FROM s) WHERE regexp_matches(content, '(?i)\bcurrent\s+role\b[:\s]*(?:the\s+)?' || role || '\b') AND NOT {_any('lower(title)', O.NEWS_TITLES)}")
    acronym = f"(regexp_full_match({_bare('x')}, '[A-Z][A-Z0-9&./-]+') AND NOT regexp_full_match({_bare('x')}, '[A-Z]{{4,}}') AND NOT list_contains({sql_list(O.SUFFIXES)}, lower({_bare('x')})))"
    over = f"list_transform(w, lambda x, i: {_plain('x')} <> '' AND ((i > 1 AND list_contains({sql_list(O.ACTIONS)}, {_plain('x')})) OR (i > 2 AND (list_contains({sql_list(O.BODIES)}, {_plain('x')}) OR {acronym}))))"
    shown = f"CASE WHEN length({_bare('x')}) > 1 AND {_bare('x')} = upper({_bare('x')}) AND {_bare('x')} <> lower({_bare('x')}) AND NOT list_contains({sql_list(O.SUFFIXES)}, lower({_bare('x')})) THEN replace(x, {_bare('x')}, {_cap(_bare('x'))}) ELSE x END"
    bad = sql_list((*O.NO_PERSON_WORDS, *O.ACTIONS, *O.BODIES))
    return f"""
WITH d AS (SELECT doc_id, source, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS ws FROM documents), n AS (SELECT *, upper(ws[1][1:1]) || lower(ws[1][2:]) AS g, upper(ws[2][1:1]) || lower(ws[2][2:]) AS f FROM d WHERE len(ws) >= 2),
s AS (SELECT doc_id AS source_id, concat_ws('/', source, {_sql_said([x[0] for x in FORMS])}) AS qid, {_sql_said([x[0] for x in FORMS])} AS role, CASE WHEN length(source) = 4 THEN source END AS country, 'W' || doc_id AS label, 'https://' || lower({_sql_said(HOSTS)}) || '/' AS url, {_sql_said([x[1] for x in FORMS])} AS title, {_sql_said([x[2] for x in FORMS])} AS content FROM n),
raw AS ({' UNION ALL '.join(raw)}),
cut AS (SELECT *, string_split_regex(trim({_cut('raw')}), '\\s+') AS w FROM raw WHERE raw <> ''),
kept AS (SELECT *, list_filter(CASE WHEN stop > 0 THEN w[1:stop - 1] ELSE w END, lambda x: {_plain('x')} <> '') AS k FROM (SELECT *, coalesce(list_position({over}, true), 0) AS stop FROM cut)),
cleaned AS (SELECT *, array_to_string(list_transform(string_split(trim(array_to_string(k, ' '), ' ,.-'), ' '), lambda x: {shown}), ' ') AS name FROM kept),
persons AS (SELECT *, len(list_filter(string_split_regex(name, '\\s+'), lambda x: x <> '')) AS nw FROM cleaned WHERE name <> '' AND regexp_matches(name, '[A-Za-z]') AND NOT regexp_matches(name, '(?i)^(?:of|the)\\b') AND NOT regexp_matches(name, {_lit(O.NO_PERSON)}) AND len(list_filter(string_split_regex(name, '\\s+'), lambda x: list_contains({bad}, trim(lower({_bare('x')}), '''’!?')))) = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY nw * 2.0 + CASE WHEN from_title THEN 1 ELSE 0 END - CASE WHEN nw = 1 THEN 1.5 ELSE 0 END + CASE WHEN contains(name, '.') THEN 0.3 ELSE 0 END DESC, length(name) DESC, pos) AS r FROM persons WHERE nw BETWEEN 1 AND 5),
cand AS (SELECT b.source_id, b.name, CASE WHEN bool_or(p.kind = 'current') THEN 'current' ELSE 'historical' END AS kind FROM ranked b JOIN persons p ON p.source_id = b.source_id AND lower(p.name) = lower(b.name) WHERE b.r = 1 GROUP BY ALL)"""


@query("office_candidates", _names_sql() + " SELECT s.source_id, role, name, kind FROM cand JOIN s USING (source_id)")
def office_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who each source says holds the office, and whether it says so of now."""
    s = statements(spark, sf_dir)
    return O.candidates(s).join(s.select("source_id", "role"), "source_id").select("source_id", "role", "name", "kind")


def _holders_sql() -> str:
    hay = "lower(concat_ws(' ', title, url, content))"
    running = " OR ".join(f"contains(lower(title || ' ' || content), replace({_lit(m)}, '{{role}}', role))" for m in O.RUNNING)
    low = "lower(title || ' ' || content)"
    past = f"({_any(low, P.ENDED)} OR regexp_matches({low}, 'was (the )?' || role) OR regexp_matches({low}, role || '[^.;]{{0,40}}(19|20)[0-9]{{2}} *[-–] *(19|20)[0-9]{{2}}') OR regexp_matches({low}, role || '[^.;]{{0,25}}until (19|20)[0-9]{{2}}'))"
    tokens = "list_filter(regexp_extract_all(strip_accents(lower(name)), '[a-z''-]+'), lambda t: length(t) > 1)"
    agree = "len(a.t) > 0 AND len(b.t) > 0 AND (len(list_intersect(a.t, b.t)) = least(len(a.t), len(b.t)) OR (len(a.t) > 1 AND len(b.t) > 1 AND a.t[1] = b.t[1] AND a.t[-1] = b.t[-1]) OR (len(list_intersect(a.t, b.t)) > 0 AND a.last = b.last))"
    return _names_sql() + f""",
c AS (SELECT s.*, name, kind, lower(name) AS key, regexp_extract(url, '^https://([^/]*)', 1) AS host FROM cand JOIN s USING (source_id) WHERE NOT {_any(hay, P.NOISY)} AND NOT {_any(hay, O.DIRECTORIES)} AND (role <> 'secretary of state' OR {_any(hay, O.US_STATE)})),
o AS (SELECT *, regexp_replace(host, '^www\\.', '') AS domain, {_any('url', P.OFFICIAL)} OR {_any('lower(title)', O.OFFICIAL_TITLES)} AS official FROM c),
sc AS (SELECT *, 1.0 + CASE WHEN official THEN 5 ELSE 0 END + CASE WHEN starts_with(lower(title), role) THEN 2 ELSE 0 END + CASE WHEN {running} THEN 1 ELSE 0 END - CASE WHEN {past} THEN 3 ELSE 0 END AS score FROM o),
m AS (SELECT *, bool_or(official) OVER (PARTITION BY qid) AS any_official FROM sc), nd AS (SELECT qid, key, count(DISTINCT domain) AS n FROM sc GROUP BY ALL),
e AS (SELECT m.* FROM m JOIN nd USING (qid, key) WHERE CASE WHEN any_official THEN official ELSE country IS NOT NULL OR n >= 2 END),
g AS (SELECT qid, key, bool_or(kind = 'current') AS current, count(DISTINCT domain) AS n_domains, max(score) AS score, arg_min(struct_pack(name := name, label := label), struct_pack(s := -score, i := source_id)) AS best FROM e GROUP BY qid, key),
f1 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY current DESC, n_domains DESC, score DESC, key) AS r FROM g),
t AS (SELECT DISTINCT qid, key, list_sort(list_distinct(list_filter({tokens}, lambda x: NOT list_contains({sql_list(O.COURTESIES)}, x)))) AS t, coalesce(({tokens})[-1], '') AS last FROM e),
x AS (SELECT DISTINCT a.qid FROM t a JOIN t b ON a.qid = b.qid AND a.key < b.key WHERE NOT ({agree}))
SELECT f1.qid, best.name AS name, CASE WHEN current THEN 'current' ELSE 'historical' END AS kind, best.label AS label, n_domains, x.qid IS NOT NULL AS conflict FROM f1 LEFT JOIN x ON x.qid = f1.qid WHERE r = 1"""


@query("office_holders", _holders_sql())
def office_holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds each office by all sources, and whether they disagree."""
    return O.holders(statements(spark, sf_dir))
