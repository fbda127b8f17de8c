"""Expressions over whole texts: what they cost on prose, and that their short cuts change nothing."""

import time

from pyspark.sql import functions as F

from quarrylight.operators import answers, extract, identity

PROSE = "Die Sache war, wie man so sagt, entschieden and the people of the old town walked along the river until the evening came "


def seconds(spark, value, lines=5000):
    """What an expression over ``lines`` lines of 480 characters takes in one task, the second time."""
    df = spark.range(lines, numPartitions=1).select(F.concat(F.repeat(F.lit(PROSE), 4), F.col("id").cast("string")).alias("t"))
    df = df.select(F.xxhash64(value(F.col("t"))).alias("h")).agg(F.sum(F.col("h") % 97))
    df.collect()
    began = time.time()
    df.collect()
    return time.time() - began


def both(spark, texts, new, old):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(new(F.col("t")).alias("a"), old(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


def test_formula_repair_passes_prose_by(spark):
    assert seconds(spark, answers.repaired_formula) < 4
    rows = spark.createDataFrame([("the alphabet of mu_2",), (r"\alpha1 and Beta 3, pi",), ("alphas = 1",), ("sigma ^2",), (None,)], "t string").select(answers.repaired_formula(F.col("t")).alias("r")).collect()
    assert [r.r for r in rows] == ["the alphabet of μ₂", "α₁ and β₃, π", "alphas = 1", "σ²", ""]


ODD = ["Passport", "passports", "a passport", "passport_no", "_passport", "x-VAT.", "vatican", "cover letter\n", "bill to: me", "bill  to", "certificate of the University", "certificate", "AB-12345", "", None, "éclause", "clauseé", "9party", "party", "to whom it may concern", "ID card", "kid card", "the manual", "manually", "doi:1", "İdentity card"]


def test_form_class_passes_prose_by(spark):
    assert seconds(spark, lambda t: answers.form_class(t, F.lit(True))) < 1.5

    def old(text):
        t, c = F.lower(F.coalesce(text, F.lit(""))), F
        for name, words in answers.FORM_CLASSES:
            c = c.when(t.rlike(answers.WORD.format(words)), F.when(t.rlike(answers.WORD.format(answers.ACADEMIC)), "academic_document").otherwise("certificate") if name == "certificate" else F.lit(name))
        return c.when(text == "AB-12345", "form").otherwise("unknown_structured_document")

    both(spark, ODD, lambda t: answers.form_class(t, t == "AB-12345"), old)


def test_document_type_passes_prose_by(spark):
    assert seconds(spark, lambda t: answers.document_type(F.lit("a.txt"), t)) < 1.5

    def old(text):
        t, c = F.lower(F.coalesce(text, F.lit(""))), F
        for kind, words in answers.KIND_WORDS:
            c = c.when(t.rlike(answers.WORD.format(words)), kind)
        return c.otherwise("document")

    both(spark, ODD, lambda t: answers.document_type(F.lit("a.txt"), t), old)


def test_formula_score_passes_prose_by(spark):
    assert seconds(spark, extract.formula_score) < 2
    assert seconds(spark, lambda t: extract.formula_type(t, F.lit(""))) < 1

    def old(text):
        line = answers.T.squeezed(text)
        found = extract.formula_features(line)
        points = sum((F.least(F.lit(most), found[name] * each) for name, each, most, _ in extract.FORMULA_EVIDENCE), F.lit(0.0))
        return F.when(line == "", F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), points)))

    texts = ["", None, " ", "x 2", "B_3", "b3.", "f (x)", "Cov(x)", "checksum (1)", "INTEGRALLY", "Sum of it", "summary", "dy / dx", r"\sqrt 2", "the mu of", "µ", "Beta2", "exp log", "a = b", "long " * 40 + "= 1.", "σ² ≤ 1", "1/2"]
    both(spark, texts, extract.formula_score, old)
    kinds = {"y ~ x": "linear_model", "my = x": "identity", "P(A | B)": "posterior", "l (x)": "likelihood", "E (x)": "expectation", "one (x)": "unknown", "a matrix": "matrix_equation", "[1; 2]": "matrix_equation", "dy / dx": "differential_equation", "p(x)": "probability", "a=b": "identity", "": "unknown"}
    rows = spark.createDataFrame([(t,) for t in [*kinds, None]], "t string").select("t", extract.formula_type(F.col("t"), F.lit("")).alias("k")).collect()
    assert {r.t: r.k for r in rows} == kinds | {None: "unknown"}


def test_sources_about_passes_prose_by(spark):
    name = F.array(F.lit("maria"), F.lit("rossi"))
    assert seconds(spark, lambda t: F.size(identity.names_in(t))) < 1
    assert seconds(spark, lambda t: identity.about_person(F.lit("a.txt"), F.concat(t, F.lit(" maria rossi thesis")), name, F.lit(False)), 1000) < 2
    texts = ["Maria Rossi", "xMaria Rossi", "_Maria Rossi", "9Maria Rossi", "Maria  Rossi-Bianchi John Smith", "éMaria Rossi", "", None, "Anna Maria Rossi", "(Jan\nde Vries) Karl Marx."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(identity.names_in(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [["maria rossi"], [], [], [], ["maria rossi-bianchi", "john smith"], ["maria rossi"], [], [], ["anna maria"], ["karl marx"]]
