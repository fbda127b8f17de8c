"""Queries of dates by what stands around them, over papers that are written from the rows of ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import dates as D
from quarrylight.operators.metadata import BLURRED, CLEAR_DATE, DATE, DIGITS
from quarrylight.operators.people import MARKED, PLAIN
from quarrylight.queries.base import query, read, sql_list
from quarrylight.queries.web import _any

QUESTIONS = ("When was it issued?", "When does it expire?", "What is the exam date?", "What is the date of payment?", "What is the date?", "Issue and expiry of the passport")
#: Papers, dealt by order number: {a} is the order's date, {b} 400 days on in another form, {c} 30 days on with letters for digits.
PAPERS = (
    "Passport No 12. Date of issue: {a} Luxembourg. Date of expiry: {b}. {x}", "Date de délivrance {c}, expiry {a}; {x} seen {b}", "Exam session {a}, paid en date du {b}. {x} Examen {c}", "{x}. Montant reglé {c}; payment {b}; session of {a}",
    "{x} {a} {b} {c} {a} date", "No dates. {x}", "Dates: {a}{b} and {b},{c} 1ssue 0f {c} and {x}",
)
WRITTEN = ("She defended her doctoral thesis on {w}. Born {v}.", "Born on {v}. The PhD, a long work on many things, was finished and its author left on {w}", "1{w} {x} {v}", "{x}", "Doctoral thesis of {v}; defence date {w}; {x}")


def _paper(forms):
    day = F.to_date("o_orderdate")
    blurred = F.translate(F.date_format(F.date_add(day, 30), "dd/MM/yyyy"), "015", "OlS")
    marks = {"{a}": F.date_format(day, "yyyy-MM-dd"), "{b}": F.date_format(F.date_add(day, 400), "dd.MM.yyyy"), "{c}": blurred, "{w}": F.date_format(day, "d MMMM yyyy"), "{v}": F.date_format(F.date_add(day, -9000), "d MMM yyyy"), "{x}": F.lit("the paper of the order")}
    text = F.get(F.array(*[F.lit(p) for p in forms]), (F.col("o_orderkey") % len(forms)).cast("int"))
    for mark, value in marks.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def _paper_sql(forms) -> str:
    day = "o_orderdate::DATE"
    marks = {"{a}": f"strftime({day}, '%Y-%m-%d')", "{b}": f"strftime({day} + 400, '%d.%m.%Y')", "{c}": f"translate(strftime({day} + 30, '%d/%m/%Y'), '015', 'OlS')", "{w}": f"strftime({day}, '%-d %B %Y')", "{v}": f"strftime({day} - 9000, '%-d %b %Y')", "{x}": "'the paper of the order'"}
    text = f"({sql_list(forms)})[o_orderkey % {len(forms)} + 1]"
    for mark, value in marks.items():
        text = f"replace({text}, '{mark}', {value})"
    return text


def _plain(text: str) -> str:
    return f"regexp_replace(regexp_replace(translate(lower({text}), '{MARKED}', '{PLAIN}'), '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '[^\\x00-\\x7F]', ' ', 'g')"


def _placed(pattern: str) -> str:
    """A row per match with its place from 1, from the lengths of what stands between."""
    return f"""m AS (SELECT *, regexp_extract_all(t, '{pattern}') AS ds, string_split_regex(t, '{pattern}') AS gs FROM d),
p AS (SELECT * EXCLUDE (ds, gs), ds[k] AS raw, (list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ds[1:k - 1], lambda x: length(x))), 0) + 1)::BIGINT AS pos FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS k FROM m))"""


def _mend(x: str) -> str:
    for pattern, word in D.MENDED:
        x = f"regexp_replace({x}, '{pattern}', '{word}', 'g')"
    return x


def _near(terms) -> str:
    return " + ".join(f"CASE WHEN contains(near, '{t}') THEN {D.NEAR} ELSE 0 END" for t in terms)


def _best_sql() -> str:
    by = {name: terms for name, _, terms in D.PURPOSES}
    wants = {name: f"regexp_matches(q, '{pattern}')" for name, pattern, _ in D.PURPOSES} | {"exam_date": f"regexp_matches(q, '{D.EXAM_DATE}')"}
    points = [f"CASE WHEN NOT ({' OR '.join(wants[n] for n in by)}) THEN {_near(D.ANY_DATE)} ELSE 0 END"] + [f"CASE WHEN {wants[n]} THEN {_near(t)} ELSE 0 END" for n, t in by.items()]
    for own, other in (("issue", "expiry"), ("expiry", "issue")):
        points.append(f"CASE WHEN {wants[own]} THEN CASE WHEN {_any('lead', by[own])} THEN {D.LEADS} WHEN {_any('near', by[own])} THEN {D.ELSEWHERE} ELSE 0 END - CASE WHEN {_any('lead', by[other])} THEN {D.LEADS} ELSE 0 END ELSE 0 END")
    points.append(f"CASE WHEN {wants['exam_date']} THEN CASE WHEN contains(near, 'session') THEN {D.SESSION} WHEN {_any('near', D.PAID)} THEN {D.PAID_NOT_SAT} ELSE 0 END ELSE 0 END")
    points.append(f"CASE WHEN {wants['payment']} AND {_any('near', D.SAT)} THEN {D.SAT_NOT_PAID} ELSE 0 END + CASE WHEN value <> raw THEN {D.REPAIRED} ELSE 0 END + CASE WHEN regexp_matches(value, '^[0-9]{{4}}-') THEN {D.ORDERED} ELSE 0 END")
    return f"""
WITH d AS (SELECT o_orderkey AS doc_id, lower(({sql_list(QUESTIONS)})[o_custkey % {len(QUESTIONS)} + 1]) AS q, {_plain(_paper_sql(PAPERS))} AS t FROM orders), {_placed(D.DATE)},
c AS (SELECT *, translate(regexp_replace(raw, '-[a-z]{{2}}$', ''), '{BLURRED}', '{DIGITS}') AS value, {_mend(f"substring(t, greatest(1, pos - {D.AROUND}), length(raw) + {D.AROUND} + least({D.AROUND}, pos - 1))")} AS near, {_mend(f"substring(t, greatest(1, pos - {D.LEADING}), least({D.LEADING}, pos - 1))")} AS lead FROM p),
s AS (SELECT *, {' + '.join(points)} AS score, {wants['issue']} AND NOT {wants['expiry']} AS first_wins FROM c WHERE regexp_matches(value, '{CLEAR_DATE}')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CASE WHEN first_wins THEN -pos ELSE pos END DESC) AS r FROM s)
SELECT doc_id, value, score::INT AS score FROM r WHERE r = 1 AND score > 0"""


@query("date_by_context", _best_sql())
def date_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each paper that its question asks for."""
    q = F.get(F.array(*[F.lit(x) for x in QUESTIONS]), (F.col("o_custkey") % len(QUESTIONS)).cast("int"))
    return D.best(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), q.alias("question"), _paper(PAPERS).alias("text")))


def _defence_sql() -> str:
    stated = ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in D.DEFENDED)
    points = " + ".join(f"CASE WHEN {_any('near', words)} THEN {n} ELSE 0 END" for words, n in D.THESIS_POINTS)
    return f"""
WITH d AS (SELECT o_orderkey AS doc_id, {_plain(_paper_sql(WRITTEN))} AS t FROM orders), {_placed(D.WRITTEN)},
c AS (SELECT doc_id, raw, pos, substring(t, greatest(1, pos - {D.THESIS_AROUND}), length(raw) + {D.THESIS_AROUND} + least({D.THESIS_AROUND}, pos - 1)) AS near FROM p WHERE NOT regexp_matches(substring(t, greatest(1, pos - 1), least(1, pos - 1)), '[0-9]')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS r FROM (SELECT *, {points} AS score FROM c) WHERE score > 0),
f AS (SELECT d.doc_id, regexp_replace(coalesce({stated}, raw), '\\s+', ' ', 'g') AS found FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND r = 1)
SELECT doc_id, array_to_string(list_transform(string_split(found, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS date FROM f"""


@query("defence_dates", _defence_sql())
def defence_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each paper's thesis was defended."""
    return D.defence_date(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _paper(WRITTEN).alias("text")))
