"""Chunking, and what a document says about itself: title, heading, kind, keywords, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T

SIZE, OVERLAP = 1000, 120
# Words that are no keywords.
KEYWORD_STOPWORDS = ["about", "after", "also", "and", "are", "because", "been", "between", "document", "from", "have", "into", "more", "most", "other", "such", "than", "that", "their", "there", "these", "this", "those", "through", "using", "were", "which", "with"]
# Kinds by marker, the first that fits counts.
KINDS = (("invoice", ("invoice", "bill to")), ("contract", ("agreement", "contract")), ("license", ("license",)), ("paper", ("abstract", "doi", "arxiv")), ("report", ("report", "summary")), ("letter", ("dear ", "sincerely")), ("manual", ("manual", "installation")))


def sliding(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before, until one reaches the end."""
    t, step = F.trim(F.coalesce(text, F.lit(""))), max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / step)).cast("int")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.trim(F.substring(t, i * step + 1, F.lit(size)))))


def packed(parts: Column, size: int = SIZE, joint: str = "\n\n") -> Column:
    """Consecutive parts joined while they fit into ``size``: a fold over the array, in the JVM. A part over ``size`` is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, p):
        grown = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit(joint), p))
        fits = F.length(grown) <= size
        return F.struct(F.when(fits | (acc["open"] == ""), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits | (acc["open"] == ""), grown).otherwise(p).alias("open"))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def semantic(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed up to ``size``; longer ones are packed by sentence, longer sentences slide."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    by_sentence = lambda p: F.flatten(F.transform(packed(T.sentences_capital(p), size, " "), lambda s: F.when(F.length(s) > size, sliding(s, size, overlap)).otherwise(F.array(s))))
    split = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size, by_sentence(p)).otherwise(F.array(p))))
    return packed(split, size, "\n\n")


def chunks(docs: DataFrame, cut: Column, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``chunk_index``, ``chunk_id``, ``text``."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("chunk_index", "text"))
    return out.withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("-0-"), F.col("chunk_index").cast("string")))


def title(text: Column, fallback: Column) -> Column:
    """The first of 18 lines with 8 to 180 characters and two words that is no abstract, keyword list, DOI or address."""
    ok = F.filter(F.slice(T.lines(text), 1, 18), lambda x: F.length(x).between(8, 180) & (F.size(F.split(x, " ")) >= 2) & ~F.lower(x).rlike("^(abstract|keywords|doi|http)"))
    return F.coalesce(F.get(ok, F.lit(0)), fallback)


def heading(text: Column) -> Column:
    """The first of four lines, of 100 characters at most, that is numbered or begins with a capital and holds no sentence end."""
    ok = F.filter(F.slice(T.lines(text), 1, 4), lambda x: (F.length(x) <= 100) & (x.rlike("^[0-9]+([.][0-9]+)*[.)]? +[A-Z]") | x.rlike("^[A-Z][A-Za-z0-9 ,:-]+$")))
    return F.coalesce(F.get(ok, F.lit(0)), F.lit(""))


def kind(text: Column) -> Column:
    t, c = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 4000)), None
    for name, markers in KINDS:
        test = F.lit(False)
        for m in markers:
            test = test | F.contains(t, F.lit(m))
        c = F.when(test, name) if c is None else c.when(test, name)
    return c.otherwise("document")


def summary(text: Column) -> Column:
    """The first three sentences of 45 characters and seven words at least."""
    ok = F.filter(T.sentences(T.squeezed(text)), lambda s: (F.length(s) >= 45) & (F.size(F.split(s, " ")) >= 7))
    return F.array_join(F.slice(ok, 1, 3), " ")


def keyword_list(text: Column, most: int = 12) -> Column:
    """The most frequent words of four characters at least, comma-joined, ties in alphabetical order; empty without any. Counted within the row, so nothing is shuffled."""
    w = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(T.WORD_TOKEN), F.lit(0)), F.lower), lambda x: ~x.isin(KEYWORD_STOPWORDS))
    by_count = F.sort_array(F.transform(T.counted(w), lambda x: F.struct((-x["n"]).alias("n"), x["term"].alias("term"))))
    return F.array_join(F.transform(F.slice(by_count, 1, most), lambda x: x["term"]), ",")


def keywords(docs: DataFrame, most: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``keywords`` of keyword_list(); documents without any have no row."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return T.held(d, keywords=keyword_list(F.col("text"), most)).select("doc_id", "keywords").where("keywords != ''")
