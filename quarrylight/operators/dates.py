"""Dates scored by what stands around them: each match with its place, the text before and behind it, and the best one for a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.metadata import BLURRED, CLEAR_DATE, DATE, DIGITS, words_apart
from quarrylight.operators.people import folded
from quarrylight.operators.web import any_of

#: Characters before and behind a date that count, of those before it the ones that lead up to it, and both sides of a written date.
AROUND, LEADING, THESIS_AROUND = 48, 32, 90
#: Pieces of text and dates looked at on a side: a date has eight characters at least, so that these cover the sides.
PIECES = 13

# What a question asks for, and the words near a date that speak for it.
PURPOSES = (
    ("issue", r"\b(?:issue|issued|issuance|delivrance)\b", ("date of issue", "issued", "date de delivrance", "delivrance")),
    ("expiry", r"\b(?:expiration|expiry|expire|expires|valid until)\b", ("date of expiry", "expiration", "expiry", "expire")),
    ("exam", r"exam|session|test", ("session", "exam", "examen", "sproochentest", "passation")),
    ("payment", r"\b(?:payment|fee|amount)\s+date\b|\bdate\s+(?:of\s+)?(?:payment|fee)\b|paid on", ("payment", "paid", "regle", "montant", "en date du")),
    ("thesis", r"\b(?:thesis|phd|doctoral|doctorate)\b.*\b(?:defen[cs]e|defend|defended)\b|\b(?:defen[cs]e|defend|defended)\b.*\b(?:thesis|phd|doctoral|doctorate)\b", ("defended", "defend", "doctoral thesis", "thesis", "phd")),
)
EXAM_DATE = r"\b(?:exam|test|session)\s+date\b|date.*exam|exam.*date"
ANY_DATE = ("date",)
PAID, SAT = ("en date du", "paid", "regle", "montant"), ("session", "exam", "examen", "passation")
# Words that a scan has blurred, and what they are.
MENDED = ((r"\b0f\b", "of"), (r"\b[l1]ssue\b", "issue"), (r"\bd6livrance\b", "delivrance"), (r"\bexp[l1]ry\b", "expiry"))
# The points of a word near a date, of a word that leads up to it, of one elsewhere, of a repaired date and of one in the order year, month, day.
NEAR, LEADS, ELSEWHERE, REPAIRED, ORDERED, SESSION, PAID_NOT_SAT, SAT_NOT_PAID = 3, 8, 2, 1, 1, 4, -6, -1
# A written date, the sentences that state a thesis defence, and points of words around other written dates.
WRITTEN = r"[0-9]{1,2}\s+(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t|tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+[0-9]{4}\b"
DEFENDED = (rf"\bdefended\s+(?:his|her|their)?\s*(?:doctoral\s+)?thesis\s+on\s*({WRITTEN})", rf"\b(?:doctoral\s+)?thesis\s+(?:was\s+)?defended\s+on\s*({WRITTEN})", rf"\bdefen[cs]e\s+(?:date\s+)?(?:on\s+)?({WRITTEN})")
THESIS_POINTS = ((("defended", "defend"), 6), (("doctoral",), 4), (("thesis",), 4), (("phd", "doctorate"), 2))


def plain(text: Column) -> Column:
    """The text that dates are looked for in: lower case, without marks on Latin letters, a character for a character."""
    return words_apart(folded(text))


def placed(text: Column, pattern: str, around: int) -> Column:
    """The matches of a pattern in order: structs of ``pos`` (from 0), ``raw``, and ``before`` and ``behind``, up to ``around`` characters on each side.

    Places are the summed lengths of what stands between the matches. The sides are put together from the pieces next to a
    match, so that work stays linear in the text however many dates it holds.
    """
    between, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(both: Column) -> Column:
        gaps, dates = both["gaps"], both["dates"]
        last = F.transform(gaps, lambda g: F.right(g, F.lit(around)))
        first = F.transform(gaps, lambda g: F.left(g, F.lit(around)))
        pairs = lambda g: F.concat(F.flatten(F.transform(dates, lambda d, k: F.array(F.get(g, k), d))), F.array(F.get(g, F.size(dates))))
        left, right = pairs(last), pairs(first)
        sizes = F.transform(dates, lambda d, k: F.length(F.get(gaps, k)) + F.length(d))
        start = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        side = lambda flat, a, n: F.array_join(F.slice(flat, a, n), "")

        def one(d: Column, k: Column) -> Column:
            behind = 2 * k + 3  # the place of the gap after the date, from 1
            head = F.greatest(F.lit(1), 2 * k + 2 - PIECES)
            return F.struct((F.get(start, k) + F.length(F.get(gaps, k))).alias("pos"), d.alias("raw"), F.right(side(left, head, 2 * k + 2 - head), F.lit(around)).alias("before"), F.left(side(right, behind, F.lit(PIECES)), F.lit(around)).alias("behind"))

        return F.transform(dates, one)

    return F.get(F.transform(F.array(F.struct(between.alias("gaps"), found.alias("dates"))), build), F.lit(0))


def purposes(question: Column) -> Column:
    """What a question asks the date of, as names from PURPOSES; ``exam_date`` too where it asks for an exam's day."""
    q = folded(question)
    return F.array_compact(F.array(*[F.when(q.rlike(pattern), name) for name, pattern, _ in PURPOSES], F.when(q.rlike(EXAM_DATE), "exam_date")))


def mended(text: Column) -> Column:
    for pattern, word in MENDED:
        text = F.regexp_replace(text, pattern, word)
    return text


def scored(asked: DataFrame) -> DataFrame:
    """``doc_id``, ``pos``, ``value``, ``score``, ``first_wins`` of every numeric date of ``asked`` (``doc_id``, ``text``, ``question``); letters that a scan put for digits are put right, and what is no date then is left out."""
    d = T.held(asked.select("doc_id", "text", "question"), t=plain(F.col("text")), want=purposes(F.col("question")))
    d = d.select("doc_id", "want", F.explode(placed(F.col("t"), DATE, AROUND)).alias("x")).select("doc_id", "want", "x.*")
    cut = F.regexp_replace("raw", "-[a-z]{2}$", "")
    d = T.held(d, value=F.translate(cut, BLURRED, DIGITS), near=mended(F.concat("before", "raw", "behind")), lead=mended(F.right("before", F.lit(LEADING)))).where(F.col("value").rlike(CLEAR_DATE))
    wants = lambda name: F.array_contains("want", name)
    n_near = lambda terms: sum((F.when(F.contains("near", F.lit(t)), NEAR).otherwise(0) for t in terms), F.lit(0))
    points = F.when(F.size(F.array_except("want", F.array(F.lit("exam_date")))) == 0, n_near(ANY_DATE)).otherwise(F.lit(0))
    for name, _, terms in PURPOSES:
        points = points + F.when(wants(name), n_near(terms)).otherwise(0)
    by = {name: terms for name, _, terms in PURPOSES}
    for own, other in (("issue", "expiry"), ("expiry", "issue")):
        led = F.when(any_of(F.col("lead"), by[own]), LEADS).when(any_of(F.col("near"), by[own]), ELSEWHERE).otherwise(0)
        points = points + F.when(wants(own), led - F.when(any_of(F.col("lead"), by[other]), LEADS).otherwise(0)).otherwise(0)
    session = F.contains("near", F.lit("session"))
    points = points + F.when(wants("exam_date"), F.when(session, SESSION).when(any_of(F.col("near"), PAID), PAID_NOT_SAT).otherwise(0)).otherwise(0)
    points = points + F.when(wants("payment") & any_of(F.col("near"), SAT), SAT_NOT_PAID).otherwise(0)
    points = points + F.when(F.col("value") != F.col("raw"), REPAIRED).otherwise(0) + F.when(F.col("value").rlike("^[0-9]{4}-"), ORDERED).otherwise(0)
    return d.select("doc_id", "pos", "value", points.cast("int").alias("score"), (wants("issue") & ~wants("expiry")).alias("first_wins"))


def best(asked: DataFrame) -> DataFrame:
    """``doc_id``, ``value``, ``score``: the date of each text that answers its question best. Of equal scores the last one counts, for a date of issue the first; none at 0 or less. Texts without such a date have no row; ids are distinct, a null text has no date."""
    order = F.struct("score", F.when(F.col("first_wins"), -F.col("pos")).otherwise(F.col("pos")).alias("place"), "value")
    top = scored(asked).groupBy("doc_id").agg(F.max(order).alias("x"))
    return top.where("x.score > 0").select("doc_id", "x.value", "x.score")


def defence_date(texts: DataFrame) -> DataFrame:
    """``doc_id``, ``date``: when a thesis was defended, by a sentence that says so, else the written date (``12 May 2020``) with most words of a defence around it, the first of equals; null if there is none."""
    d = T.held(texts.select("doc_id", "text"), t=plain(F.col("text")))
    stated = F.coalesce(*[F.nullif(F.regexp_extract("t", p, 1), F.lit("")) for p in DEFENDED])
    d = T.held(d, stated=stated, all=placed(F.col("t"), WRITTEN, THESIS_AROUND)).select("doc_id", "stated", "all")

    def points(x: Column) -> Column:
        near = F.concat(x["before"], x["raw"], x["behind"])
        return sum((F.when(any_of(near, words), n).otherwise(0) for words, n in THESIS_POINTS), F.lit(0))

    whole = F.filter("all", lambda x: ~x["before"].rlike("[0-9]$"))
    ranked = F.transform(whole, lambda x: F.struct(points(x).alias("score"), (-x["pos"]).alias("place"), x["raw"].alias("raw")))
    best_one = F.array_max(F.filter(ranked, lambda x: x["score"] > 0))
    return d.select("doc_id", F.initcap(F.regexp_replace(F.coalesce("stated", best_one["raw"]), r"\s+", " ")).alias("date"))
