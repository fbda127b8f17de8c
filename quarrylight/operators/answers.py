"""Form classes, question targets, formula repair, missing citations, stated confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

# Words of each class of form, the first that fits counts.
FORM_CLASSES = (
    ("identity_document", "passport|nationality|date of birth|surname|given names|identity card"), ("certificate", "certificate|certificat|attestation|diploma|degree"), ("invoice", "invoice|bill to|subtotal|vat|total due"),
    ("receipt", "receipt|paid|payment"), ("letter", "dear|to whom it may concern|sincerely|letter"), ("contract", "contract|agreement|party|clause"),
)
ACADEMIC = "university|degree|diploma|thesis"
# Asked labels and the fields they mean.
TARGETS = {"date of birth": "date_of_birth", "issue date": "issue_date", "expiry date": "expiry_date", "document number": "document_number", "reference number": "reference_number", "nationality": "nationality", "surname": "surname", "given names": "given_names", "amount": "amount", "authority": "authority", "organization": "organization_name"}
LOOSE = (("expire|valid until", "expiry_date"), ("issued|issuer", "issue_date"), ("number", "document_number"), ("total", "amount"))
# Names of Greek letters.
GREEK = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "sigma": "σ", "omega": "ω", "pi": "π"}
WORD = "(^|[^a-z0-9_])({})($|[^a-z0-9_])"
INSUFFICIENT = ("not enough information", "could not find", "no relevant", "insufficient")
LEAST_CITATION = 0.28


def form_class(text: Column, has_number_or_date: Column) -> Column:
    def first(t: Column) -> Column:
        c = F
        for name, words in FORM_CLASSES:
            c = c.when(T.has_word(t, words), F.when(T.has_word(t, ACADEMIC), "academic_document").otherwise("certificate") if name == "certificate" else F.lit(name))
        return c

    return F.coalesce(T.bound(F.lower(F.coalesce(text, F.lit(""))), first), F.when(has_number_or_date, "form").otherwise("unknown_structured_document"))


def form_confidence(fields: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id``, ``confidence``: the fields' mean, 0.08 more for a known class; 0 without fields."""
    mean = fields.groupBy("doc_id").agg(F.avg("confidence").alias("m"))
    bonus = F.when(F.col("form_class") != "unknown_structured_document", 0.08).otherwise(0.0)
    return classes.join(mean, "doc_id", "left").select("doc_id", "form_class", F.round(F.when(F.col("m").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.col("m") + bonus)), 6).alias("confidence"))


def field_target(question: Column) -> Column:
    """The form field that a question asks for, or null."""
    q, c = F.lower(F.coalesce(question, F.lit(""))), None
    for label, field in TARGETS.items():
        c = F.when(F.contains(q, F.lit(label)), field) if c is None else c.when(F.contains(q, F.lit(label)), field)
    for words, field in LOOSE:
        c = c.when(q.rlike(words), field)
    return c


def repaired_formula(text: Column) -> Column:
    """Comparison signs, arrows and Greek names as symbols, digits behind them as subscripts, one space around operators."""
    t = F.coalesce(text, F.lit(""))
    for a, b in (("<=", "≤"), (">=", "≥"), ("->", "→"), ("=>", "⇒")):
        t = F.replace(t, F.lit(a), F.lit(b))

    def symbols(t: Column) -> Column:
        for name, symbol in GREEK.items():
            for d, sub in zip("0123456789", "₀₁₂₃₄₅₆₇₈₉"):
                t = F.regexp_replace(t, rf"(?i)\\?\b{name}[_ ]?{d}\b", symbol + sub)
            t = F.regexp_replace(t, rf"(?i)\\?\b{name}\b", symbol)
        return t

    named = rf"(?i)\b(?:{'|'.join(GREEK)})(?:[_ ]?[0-9])?\b"  # what one of symbols() matches at least, so a line without it stays as it is
    t = T.bound(t, lambda x: F.when(x.rlike(named), symbols(x)).otherwise(x))
    t = F.regexp_replace(t, r"σ ?(\^ ?)?2\b", "σ²")
    return T.squeezed(F.regexp_replace(t, r"\s*([=≈∝≤≥+*/→⇒])\s*", " $1 "))


def missing_citation(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``answer_id``, ``label``, ``score``: of sources (``label``, ``text``, ``score``) that share a term with an answer, the one it should have cited, at 0.28 or more. Joined on terms."""
    a = answers.select("answer_id", T.query_terms(F.col("answer")).alias("t")).select("answer_id", F.size("t").alias("na"), F.explode("t").alias("term"))
    s = sources.select("label", "score", T.query_terms(F.col("text")).alias("t")).select("label", "score", F.size("t").alias("ns"), F.explode("t").alias("term"))
    hit = a.join(s, "term").groupBy("answer_id", "label", "score", "na", "ns").agg(F.count("*").alias("n"))
    worth = hit.withColumn("worth", F.round(F.col("n") / F.least("na", "ns") + F.least(F.lit(0.2), F.col("score") * 0.2), 6)).where(F.col("worth") >= LEAST_CITATION)
    best = worth.groupBy("answer_id").agg(F.max("worth").alias("score"))
    return worth.join(best.withColumnRenamed("score", "top"), "answer_id").where("worth = top").groupBy("answer_id").agg(F.min("label").alias("label"), F.max("worth").alias("score"))


def stated_confidence(answer: Column, current: Column, n_web: Column, n_local: Column) -> Column:
    """What an answer states itself; low if it admits to know nothing; else by the streams it rests on."""
    a = F.lower(F.coalesce(answer, F.lit("")))
    own = F.regexp_extract(a, "(^|[^a-z0-9_])confidence: *(high|medium|low)($|[^a-z0-9_])", 2)
    weak = F.lit(False)
    for m in INSUFFICIENT:
        weak = weak | F.contains(a, F.lit(m))
    return F.when(own != "", own).when(weak, "low").when(current & (n_web > 0), "current-information").when((n_web > 0) & (n_local > 0), "local-web-assisted").when(n_web > 0, "web-assisted").when(n_local > 0, "local-grounded").otherwise("model-only")


def document_card(title: Column, name: Column, summary: Column, keywords: Column, size: Column) -> Column:
    """A document's description as a source text; lines without a value are left out."""
    line = lambda label, v: F.when(v.isNotNull() & (F.trim(v) != ""), F.concat(F.lit(label + ": "), v))
    return F.concat_ws("\n", line("Document", F.coalesce(title, name)), line("File", name), line("Summary", summary), line("Keywords", keywords), line("Size", F.when(size > 0, F.concat(size.cast("string"), F.lit(" characters")))))


# Kinds of documents by file suffix, then by words.
SUFFIXES = {"pptx": "presentation", "pptm": "presentation", "ppsx": "presentation", "potx": "presentation", "csv": "spreadsheet", "png": "image_document", "jpg": "image_document", "jpeg": "image_document", "bmp": "image_document", "gif": "image_document", "tif": "image_document", "tiff": "image_document", "webp": "image_document"}
KIND_WORDS = (("identity_document", "passport|identity card|id card|nationality"), ("certificate", "certificate|diploma"), ("invoice", "invoice|bill to"), ("contract", "contract|agreement"), ("thesis", "thesis|dissertation"), ("scientific_paper", "abstract|doi|journal"), ("manual", "manual|installation"), ("policy", "policy"))
MOST_BLOCKS, BLOCK_CHARS = 10, 1200


def document_type(name: Column, text: Column) -> Column:
    """A document's kind by its file's suffix, else by its words."""
    suffix = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    by_suffix = F.try_element_at(F.create_map([F.lit(x) for kv in SUFFIXES.items() for x in kv]), suffix)

    def first(t: Column) -> Column:
        c = F
        for kind, words in KIND_WORDS:
            c = c.when(T.has_word(t, words), kind)
        return c

    return F.coalesce(by_suffix, T.bound(F.lower(F.coalesce(text, F.lit(""))), first), F.lit("document"))


def requested_names(question: Column) -> Column:
    """File names that a question spells out; else what stands behind "file", "document" or "summary of"."""
    q = F.coalesce(question, F.lit(""))
    spelled = F.regexp_extract_all(q, F.lit(r"(?i)(?<![A-Za-z0-9_])([a-z0-9][a-z0-9._-]*\.(?:pdf|docx|pptx|txt|md|csv|tsv|png|jpg))(?![A-Za-z0-9_])"), F.lit(1))
    implied = F.regexp_extract_all(q, F.lit(r"(?i)(?:file|document|summary of|summari[sz]e)\s+([a-z0-9][a-z0-9._-]{2,})"), F.lit(1))
    generic = ["document", "documents", "file", "files", "the", "this", "that", "these", "those", "all", "uploaded", "indexed", "local", "it"]
    return F.array_distinct(F.when(F.size(spelled) > 0, spelled).otherwise(F.filter(implied, lambda x: ~F.lower(x).isin(generic))))


def formula_variables(formula: Column, around: Column) -> Column:
    """Up to 16 variables of a formula with what the text beside it says they are ("x is ..." or "x denotes ...")."""
    names = F.slice(F.array_distinct(F.regexp_extract_all(formula, F.lit(r"(?<![A-Za-z0-9_\\])([A-Za-zα-ω](?:_[0-9a-z])?)(?![A-Za-z0-9_(])"), F.lit(1))), 1, 16)
    meaning = lambda n: F.get(F.regexp_extract_all(F.coalesce(around, F.lit("")), F.concat(F.lit(r"(?:^|[^A-Za-z0-9_])"), n, F.lit(r" (?:is|denotes|are) ([^.,;]{2,80})")), F.lit(1)), F.lit(0))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(meaning(n), F.lit("not defined in nearby text"))))


def payload(ranked: DataFrame) -> DataFrame:
    """``qid``, ``citations`` (comma-joined), ``n_blocks``, ``streams``, ``winner`` of ranked evidence (``qid``, ``rank``, ``label``, ``source_type``, ``content``): ten blocks of 1200 characters at most; hybrid if several streams hold something."""
    top = ranked.where(F.col("rank") <= MOST_BLOCKS).select("qid", "rank", "label", "source_type", F.substring("content", 1, BLOCK_CHARS).alias("block"))
    g = top.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("x"), F.count("*").alias("n_blocks"), F.sum(F.length("block")).alias("n_chars"), F.array_sort(F.collect_set(F.when(F.col("source_type") != "ai", F.col("source_type")))).alias("s"))
    winner = F.when(F.size("s") > 1, "hybrid").when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise("model")
    return g.select("qid", F.array_join(F.transform("x", lambda v: v["label"]), ",").alias("citations"), "n_blocks", "n_chars", F.array_join("s", ",").alias("streams"), winner.alias("winner"))


def extractive(pool: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid``, ``answer``: of each question's sources (``qid``, ``rank``, ``text``) the sentence that holds most of its terms, with its label; the better source, then the earlier sentence, on ties. A question without such a sentence is told so."""
    q = questions.select("qid", T.query_terms(F.col("question")).alias("terms"))
    s = pool.join(q, "qid").select("qid", "rank", "terms", F.posexplode(T.sentences(T.squeezed(F.col("text")))).alias("pos", "sentence"))
    n = F.size(F.array_intersect(T.query_terms(F.col("sentence")), F.col("terms")))
    best = T.held(s, n=n).where("n > 0").groupBy("qid").agg(F.max_by(F.struct("rank", "sentence"), F.struct("n", -F.col("rank"), -F.col("pos"))).alias("x"))
    answer = F.concat(F.col("x.sentence"), F.lit(" [S"), F.col("x.rank").cast("string"), F.lit("]"))
    return q.select("qid").join(best, "qid", "left").select("qid", F.coalesce(answer, F.lit("The sources hold not enough information.")).alias("answer"))
