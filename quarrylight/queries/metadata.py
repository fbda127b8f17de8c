"""Queries of document metadata, of what readers are shown, and of what sources are about."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import display as D
from quarrylight.operators import identity as N
from quarrylight.operators import metadata as M
from quarrylight.operators.people import MARKED, PLAIN
from quarrylight.queries.base import query, read, sql_list, sql_values
from quarrylight.queries.extract import LINES, SQ
from quarrylight.queries.web import _domain

_ABSTRACT = "We study the wind and what it does to the turbines of a coast, over ten years and in all weathers, and find that it blows."
PAPERS = [
    (-1, f"On the wind\nMaria Rossi and John Smith\nUniversity of Padua\nAnna Nowak\nJane Roe Doe\nPeter Paul Ruben\nAbstract: {_ABSTRACT}\nKeywords: wind, power ; turbines\n1. Introduction\nText by Karl Marx."),
    (-2, f"Title\nabstract. {_ABSTRACT * 9}\n  REFERENCES\n[1] A"), (-3, "Abstract: too short\nIntroduction"), (-4, ""), (-5, None), (-6, "One line"), (-7, "Title\n\n  Key words -  solar\nKeywords: wind"),
]
SCANS = [
    (-1, "Issued O1.l2.2O2S and 2024-0l-3I, not 12.ab.2020 or 1.2.2020; ref 2024-05-06-AB 31/12/1999"), (-2, "Place of Birth : Esch-sur-Alzette 12. Height 170\nNationality: LUXEMB0URGEOISE"), (-3, "lieu de naissance / Yaoundé signature of bearer, nationality cameroun"),
    (-4, "Place of issue, Washington D.C.\nissued in Paris"), (-5, "nationality unknown"), (-6, None), (-7, "Date B8.0S.l97T and x12.12.2012 ÉO1.01.2001 place of birth"),
]


def _with_documents(spark: SparkSession, sf_dir: str, rows: list[tuple]) -> DataFrame:
    """Constant texts and every document's whole text."""
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _texts(rows: list[tuple]) -> str:
    values = ", ".join("(" + str(i) + ", " + ("NULL" if t is None else "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'") + ")" for i, t in rows)
    return f"x AS (SELECT doc_id::BIGINT AS doc_id, text FROM (VALUES {values}) AS v(doc_id, text) UNION ALL SELECT doc_id, text FROM documents)"


@query(
    "paper_metadata",
    f"""WITH {_texts(PAPERS)}, a AS (SELECT *, list_slice({LINES.format('text')}, 2, 10) AS head FROM x), b AS (SELECT *, list_position(list_transform(head, lambda l: regexp_matches(lower(l), '{M.AUTHORS_END}')), true) AS stop FROM a)
SELECT doc_id, array_to_string(list_slice(list_filter(CASE WHEN stop IS NULL OR stop = 0 THEN head ELSE list_slice(head, 1, stop - 1) END, lambda l: NOT regexp_matches(lower(l), '{M.NO_AUTHOR}') AND regexp_matches(l, '{M.NAMES}')), 1, 3), '; ') AS authors,
trim(substring({SQ.format(f"regexp_extract(coalesce(text, ''), '{M.ABSTRACT}', 1)")}, 1, {M.ABSTRACT_CHARS})) AS abstract, trim(substring({SQ.format(f"regexp_extract(coalesce(text, ''), '{M.KEYWORDS}', 1)")}, 1, {M.KEYWORDS_CHARS})) AS keywords FROM b""",
)
def paper_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _with_documents(spark, sf_dir, PAPERS).select("doc_id", M.authors(t).alias("authors"), M.abstract(t).alias("abstract"), M.stated_keywords(t).alias("keywords"))


_APART = r"regexp_replace(regexp_replace(coalesce(text, ''), '[À-ÖØ-öø-ÿŒœ]', '_', 'g'), '[^\x00-\x7F]', ' ', 'g')"
_CLEAR = rf"list_filter(list_transform(regexp_extract_all({_APART}, '{M.DATE}'), lambda d: translate(regexp_replace(d, '-[A-Za-z]{{2}}$', ''), '{M.BLURRED}', '{M.DIGITS}')), lambda d: regexp_matches(d, '{M.CLEAR_DATE}'))"


@query("blurred_dates", f"WITH {_texts(SCANS)} SELECT doc_id, array_to_string({_CLEAR}, ' ') AS dates FROM x")
def blurred_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_documents(spark, sf_dir, SCANS).select("doc_id", F.array_join(M.blurred_dates(F.col("text")), " ").alias("dates"))


def _place(kind: str) -> str:
    def behind(marker: str) -> str:
        n = len(marker)
        tail = f"regexp_replace(substring(t, (instr(t, '{marker}') + {n})::BIGINT, {M.PLACE_CHARS}), '^[ /:;,-]+', '')"
        tail = f"regexp_replace(string_split_regex({tail}, '{M.PLACE_END}')[1], '^[a-z] +', '')"
        tail = f"regexp_replace(regexp_replace({tail}, '[^a-z ''’-]+$', ''), '^[ .,;:-]+|[ .,;:-]+$', '', 'g')"
        return f"CASE WHEN instr(t, '{marker}') > 0 AND {tail} <> '' THEN array_to_string(list_transform(string_split({tail}, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END"

    return f"coalesce({', '.join(behind(m) for m in M.PLACE_MARKERS[kind])})"


_COMPACT = "regexp_replace(replace(substring(t, (instr(t, 'nationality') + 11)::BIGINT, 48), '0', 'o'), '[^a-z]+', '', 'g')"


@query(
    "stated_places",
    f"""WITH {_texts(SCANS)}, y AS (SELECT doc_id, {SQ.format(f"translate(lower(coalesce(text, '')), '{MARKED}', '{PLAIN}')")} AS t FROM x)
SELECT doc_id, {_place('birth_place')} AS born, {_place('issue_place')} AS issued, CASE WHEN instr(t, 'nationality') > 0 THEN CASE {' '.join(f"WHEN regexp_matches({_COMPACT}, '{p}') THEN '{n}'" for n, p in M.ORIGINS)} END END AS origin FROM y""",
)
def stated_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _with_documents(spark, sf_dir, SCANS).select("doc_id", M.place(t, "birth_place").alias("born"), M.place(t, "issue_place").alias("issued"), M.origin(t).alias("origin"))


FORMULAS = [(1, "y = β₀ + x", "y = beta_0 + x", "linear_model", "a line"), (2, "", "x^2", None, ""), (3, None, "a = b", "identity", None)]


@query("formula_text", f"""SELECT id, concat_ws(chr(10), 'Formula: ' || CASE WHEN coalesce(repaired, '') <> '' THEN repaired ELSE raw END, 'Raw formula: ' || raw, 'Type: ' || coalesce(kind, 'unknown'), CASE WHEN id = 1 THEN 'Variables: x: the input; y: not defined' END, 'Surrounding text: ' || coalesce(around, '')) AS text FROM (VALUES {sql_values(FORMULAS)}) AS t(id, repaired, raw, kind, around)""")
def formula_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = spark.createDataFrame(FORMULAS, "id int, repaired string, raw string, kind string, around string")
    named = F.when(F.col("id") == 1, F.create_map(F.lit("x"), F.lit("the input"), F.lit("y"), F.lit("not defined"))).otherwise(F.create_map().cast("map<string,string>"))
    return f.select("id", M.formula_text(F.col("repaired"), F.col("raw"), F.col("kind"), named, F.col("around")).alias("text"))


_TITLE = SQ.format("coalesce(title, '')")


@query("source_name", f"""SELECT page_id, CASE WHEN t = '' THEN CASE WHEN d <> '' THEN d ELSE 'Web source' END WHEN lower(t) IN ('official site', 'home', 'homepage', 'videos') AND d <> '' THEN d ELSE t END AS name FROM (SELECT page_id, d, CASE WHEN length(s) > 58 THEN rtrim(substring(s, 1, 57)) || '...' ELSE s END AS t FROM (SELECT page_id, {_domain('url')} AS d, {_TITLE} AS s FROM (SELECT page_id, url, CASE page_id % 9 WHEN 0 THEN 'Home' WHEN 1 THEN NULL ELSE regexp_extract(html, '(?s)<title>(.*?)</title>', 1) END AS title FROM pages)))""")
def source_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page under its title; every ninth has a generic one, and every ninth none."""
    title = F.when(F.col("page_id") % 9 == 0, "Home").when(F.col("page_id") % 9 != 1, F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return read(spark, sf_dir, "pages").select("page_id", D.source_name(title, F.col("url")).alias("name"))


COUNTS = [(n, *r) for n, r in enumerate(itertools.product((0, 1, 4), (0, 2), (0, 3)))]


@query("support_label_text", f"SELECT id, CASE WHEN s + w + u = 0 THEN '' WHEN w > 0 OR u > 0 THEN s || '/' || (s + w + u) || ' supported, ' || w || ' weak, ' || u || ' unsupported' ELSE s || '/' || (s + w + u) || ' supported' END AS label FROM (VALUES {sql_values(COUNTS)}) AS t(id, s, w, u)")
def support_label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(COUNTS, "id int, s int, w int, u int")
    return c.select("id", D.support_summary(F.col("s"), F.col("w"), F.col("u")).alias("label"))


SHOWN = [(n, *r) for n, r in enumerate(itertools.product(("High", "Medium", "Low", "odd"), (False, True), (None, "single", "multiple sources", "Conflict"), (False, True), (False, True)))]


@query("shown_confidence", f"SELECT id, CASE WHEN confidence NOT IN ('High', 'Medium', 'Low') THEN confidence WHEN unverified THEN 'Low' WHEN confidence = 'High' AND (older OR contains(lower(coalesce(agreement, '')), 'conflict') OR (dated AND lower(coalesce(agreement, '')) IN ('', 'none', 'single', 'single_source'))) THEN 'Medium' ELSE confidence END AS shown FROM (VALUES {sql_values(SHOWN)}) AS t(id, confidence, unverified, agreement, older, dated)")
def shown_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(SHOWN, "id int, confidence string, unverified boolean, agreement string, older boolean, dated boolean")
    return c.select("id", D.shown_confidence(F.col("confidence"), F.col("unverified"), F.col("agreement"), F.lit(False), F.col("older"), F.lit(False), F.col("dated")).alias("shown"))


STREAMS = [(n, *r) for n, r in enumerate(itertools.product((None, "High", "Medium", "Low"), (None, "High", "Medium", "Low"), (False, True)))]


@query("hybrid_confidence", f"SELECT id, CASE WHEN l = 'High' OR w = 'High' THEN 'High' WHEN l = 'Medium' OR w = 'Medium' OR m THEN 'Medium' ELSE 'Low' END AS confidence FROM (VALUES {sql_values(STREAMS)}) AS t(id, l, w, m)")
def hybrid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame(STREAMS, "id int, l string, w string, m boolean")
    return c.select("id", D.hybrid_confidence(F.col("l"), F.col("w"), F.col("m")).alias("confidence"))


ANSWERS = [(n, *r) for n, r in enumerate(itertools.product(("Yes.", "  ", None), ("high", "low", "generation-error", "model-only", "local-grounded"), (0, 2), (0, 1), (None, True)))]
_A = f"(VALUES {sql_values(ANSWERS)}) AS t(id, answer, confidence, n_local, n_web, stated)"


def _answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANSWERS, "id int, answer string, confidence string, n_local int, n_web int, stated boolean")


@query("cacheable_answers", f"SELECT id, trim(coalesce(answer, '')) <> '' AND confidence NOT IN ('needs-token', 'model-selection-warning', 'generation-error', 'clarification') AND NOT (confidence = 'low' AND n_local = 0 AND n_web = 0) AS cacheable FROM {_A}")
def cacheable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark).select("id", D.cacheable(*(F.col(c) for c in ("answer", "confidence", "n_local", "n_web"))).alias("cacheable"))


@query("diagnostic_flags", f"SELECT id, coalesce(stated, n_local > 0 OR confidence IN ('local-grounded', 'local-web-assisted')) AS used_local, n_web > 0 AS used_web, confidence = 'model-only' AS used_model_knowledge, false AS parallel_model_with_web, coalesce(stated, false) AS local_sufficient, false AS model_sufficient FROM {_A}")
def diagnostic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = D.flags(F.col("confidence"), F.col("n_local"), F.col("n_web"), F.lit(False), {"used_local": F.col("stated"), "local_sufficient": F.col("stated")})
    return _answers(spark).select("id", *(c.alias(n) for n, c in f.items()))


@query("supporting_sources", f"SELECT id, (CASE WHEN confidence = 'high' THEN 0 WHEN n_local > 0 THEN n_local WHEN id % 4 > 0 THEN id % 4 WHEN coalesce(stated, false) THEN 1 ELSE 0 END + CASE WHEN confidence <> 'low' THEN n_web ELSE 0 END)::INT AS n FROM {_A}")
def supporting_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.supporting_sources(F.col("n_local"), F.col("confidence") != "high", F.col("id") % 4, F.coalesce("stated", F.lit(False)), F.col("n_web"), F.col("confidence") != "low")
    return _answers(spark).select("id", n.alias("n"))


BEST = [(n, *r) for n, r in enumerate(itertools.product((None, 0.3, 0.62, 0.83, 0.9), (0.5, 0.7), (0.1, 0.2, 0.4), (0, 2)))]
_B = f"(VALUES {sql_values(BEST)}) AS t(id, score, fast, coverage, overlap)"


@query("file_confidence", f"SELECT id, CASE WHEN score IS NULL THEN 'Low' WHEN (score >= 0.82 AND overlap >= 2) OR (fast >= 0.68 AND coverage >= 0.34 AND overlap >= 2) THEN 'High' WHEN score >= 0.62 OR coverage >= 0.2 OR overlap >= 2 THEN 'Medium' ELSE 'Low' END AS confidence, coalesce(score >= 0.84 OR (fast >= 0.68 AND coverage >= 0.34 AND overlap >= 2), false) AS enough FROM {_B}")
def file_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("score", "fast", "coverage", "overlap")]
    return spark.createDataFrame(BEST, "id int, score double, fast double, coverage double, overlap int").select("id", D.file_confidence(*c).alias("confidence"), D.files_are_enough(*c).alias("enough"))


@query("embedding_batches", "SELECT source, CASE WHEN a <= 450 THEN 256 ELSE least(CASE WHEN a >= 2200 THEN 64 ELSE 128 END, greatest(1, floor(floor(1000000 * 0.15) / (greatest(512, floor(a * 4)) + 6144)))) END::INT AS batch FROM (SELECT source, sum(coalesce(length(text), 0)) / count(*) AS a FROM documents GROUP BY source)")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a batch for each source with a base of 128 and 1 MB free."""
    a = read(spark, sf_dir, "documents").groupBy("source").agg((F.sum(F.coalesce(F.length("text"), F.lit(0))) / F.count("*")).alias("a"))
    return a.select("source", D.batch_size(F.col("a"), F.lit(128), F.lit(1_000_000)).alias("batch"))


RUNS = [(1, "full", "high", 5, 1.234, 0.905), (2, "local_only", "medium", 2, 0.5, None), (3, "other", "low", 0, 12.0, 0.125), (4, "ai_only", "low", 0, 3.456, 1.0)]


@query("benchmark_rows", f"SELECT id, '| ' || coalesce((MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in D.MODE_LABELS.items())}}})[mode], mode) || ' | ' || confidence || ' | ' || sources || ' | ' || printf('%.2f', seconds::DOUBLE) || 's | ' || CASE WHEN share IS NULL THEN 'N/A' ELSE round_even(share::DOUBLE * 100, 0)::INT || '%' END || ' |' AS line FROM (VALUES {sql_values(RUNS)}) AS t(id, mode, confidence, sources, seconds, share)")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(RUNS, "id int, mode string, confidence string, sources int, seconds double, share double")
    return r.select("id", D.benchmark_row(*(F.col(c) for c in ("mode", "confidence", "sources", "seconds", "share"))).alias("line"))


NAMED = [
    (1, "cv_maria_rossi.pdf", "Curriculum of Maria Rossi"), (2, "notes.txt", "A passport of Maria Rossi, price = 3"), (3, "notes.txt", "Maria Rossi is a student. See her homepage at the university"), (4, "profile.txt", "John Smith and Anna Nowak"), (5, "list.txt", "Rossi Maria, publication list"),
    (11, "pass.txt", "Passport: Rossi. Date of birth 1 May"), (12, "note.txt", "Maria Rossi. This is not a cv or portfolio; without the profile"), (6, "x.txt", "Research by John Smith with Maria Rossi of the thesis committee; profile page"), (7, "exam guide.pdf", "a paper on research"), (8, "study guide thesis.pdf", "journal"), (9, "y.txt", ""), (10, "z.txt", None),
]
_SRC = f"""s AS (SELECT id::BIGINT AS id, document, text, 0.5 AS score FROM (VALUES {sql_values(NAMED)}) AS v(id, document, text) UNION ALL SELECT 1000 + doc_id, source, text, (doc_id % 100) / 100.0 FROM documents),
n AS (SELECT *, ['maria', 'rossi'] AS name FROM s)"""
_W = lambda x: f"' ' || trim(regexp_replace(translate(lower(coalesce({x}, '')), '{MARKED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g')) || ' '"
_PAIR = N.NAME_PAIR.replace("'", "''")
_NAMES = lambda x: f"list_filter(list_transform(regexp_extract_all(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g'), '{_PAIR}'), lambda p: lower(regexp_replace(regexp_replace(p, '^[^A-Za-z]+', ''), ' +', ' ', 'g'))), lambda p: len(list_intersect(string_split(p, ' '), {sql_list([*N.NO_NAME, *N.NOT_IN_NAMES])})) = 0)"
_OTHER = lambda x: f"len(list_filter({_NAMES(x)}, lambda p: len(list_intersect(string_split(p, ' '), ['maria', 'rossi'])) < 2)) > 0"
_HAS = lambda x: f"(contains({x}, ' maria rossi ') OR contains({x}, ' rossi maria '))"
_ANY = lambda ms, x: f"len(list_filter({sql_list(ms)}, lambda m: contains({x}, m))) > 0"
_DENIED = f" (?:{'|'.join(N.DENIALS)}) +(?:(?:a|an|the) +)?(?:{'|'.join(N.DENIABLE)})(?: +or +(?:{'|'.join(N.DENIABLE)}))* "
CONTAMINATED = f"CASE WHEN {_HAS('d')} THEN false WHEN {_OTHER('document')} THEN true WHEN {_HAS('t')} THEN false ELSE {_OTHER('both_')} END"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame([(i, d, t, 0.5) for i, d, t in NAMED], "id long, document string, text string, score double")
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("source").alias("document"), "text", (F.col("doc_id") % 100 / 100.0).alias("score"))
    return fixed.unionByName(docs).withColumn("name", F.array(F.lit("maria"), F.lit("rossi")))


@query(
    "sources_about",
    f"""WITH {_SRC}, w AS (SELECT *, concat_ws(' ', document, text) AS both_, {_W('document')} AS d, {_W("concat_ws(' ', document, text)")} AS t, {_W('text')} AS body FROM n),
den AS (SELECT *, regexp_replace(regexp_replace(t, '{_DENIED}', '  ', 'g'), '{_DENIED}', '  ', 'g') AS said FROM w),
k AS (SELECT *, {CONTAMINATED} AS other, ({_ANY(N.PAPERS, 't')} OR contains(t, '{N.PAPER_WORD}')) AND len(list_intersect(string_split(replace(t, 'ph', 'f'), ' '), ['maria', 'rossi'])) > 0 AS paper, contains(d, 'maria') AND contains(d, 'rossi') AS in_name, {_ANY([m for m in N.STRONG if m not in N.WEAKLY_STRONG], 'said')} AS profile, {_ANY(N.STRONG, 'said')} AS strong, {_ANY(N.CONTEXT, 't')} AS context, {_ANY(N.AGAINST, 't')} AS against, instr(t, ' maria rossi ') AS spot FROM den),
z AS (SELECT *, spot > 0 AND {_ANY([*N.STRONG, 'doctoral researcher', 'profile page'], f"substring(t, greatest(1, spot - {N.BEFORE})::BIGINT, (11 + least(spot - 1, {N.BEFORE}) + {N.BEHIND})::BIGINT)")} AS near FROM k)
SELECT id, other AS contaminated, ({_HAS('t')} OR paper) AND NOT other AND CASE WHEN paper THEN true WHEN against AND NOT (profile OR in_name) THEN false WHEN in_name OR strong THEN true ELSE context AND near END AS about, NOT ({_ANY(N.NO_SCIENCE, 'd')} AND NOT {_ANY(N.STILL_SCIENCE, 'd')}) AND ({_ANY(N.SCIENCE, 'body')} OR score >= {N.SURE}) AS scientific FROM z""",
)
def sources_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant sources and every document, held against one name."""
    d, t, name = F.col("document"), F.col("text"), F.col("name")
    return _sources(spark, sf_dir).select("id", N.contaminated(d, t, name).alias("contaminated"), N.about_person(d, t, name, F.lit(True)).alias("about"), N.scientific(d, t, F.col("score")).alias("scientific"))


@query("question_names", r"SELECT item_id AS qid, array_to_string(CASE WHEN len(t) >= 2 THEN t ELSE [] END, ' ') AS names FROM (SELECT item_id, list_filter(list_transform(list_distinct(list_transform(regexp_extract_all(text, '[A-Z][A-Za-z''-]+'), lambda x: lower(x))), lambda x: x), lambda x: NOT list_contains(" + sql_list(N.NO_NAME) + ", x) AND length(x) > 2) AS t0, list_sort(t0) AS t FROM benchmark)")
def question_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.array_sort(N.name_tokens(F.col("text"))), " ").alias("names"))
