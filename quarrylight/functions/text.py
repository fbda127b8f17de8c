"""Text normalisation and scalar string functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The token patterns.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-]{1,}"
QUERY_TOKEN = r"[A-Za-z0-9][A-Za-z0-9_\-']{1,}"
CLAIM_TOKEN = r"[a-z0-9][a-z0-9'\-]{2,}"
WORD_TOKEN = r"[A-Za-z][A-Za-z0-9\-]{3,}"

# Words without meaning for a question.
QUERY_STOPWORDS = ["about", "after", "also", "and", "answer", "are", "based", "can", "contains", "does", "document", "documents", "file", "files", "find", "for", "from", "have", "how", "into", "local", "more", "my", "of", "on", "say", "search", "source", "sources", "the", "there", "this", "what", "when", "where", "which", "who", "with", "your"]
# Words without meaning for a claim.
CLAIM_STOPWORDS = ["about", "also", "and", "are", "confidence", "document", "documents", "file", "from", "has", "have", "indexed", "into", "local", "page", "pages", "source", "summary", "that", "the", "this", "used", "with"]


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later steps read as values: the optimizer copies no expression through a generator, so a large one is computed once however often it is used."""
    own = f"held_{len(df.columns)}"
    return df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias(own)).select(*df.columns, f"{own}.*")


def bound(value: Column, use) -> Column:
    """``use(value)``, for which ``value`` is computed once however often it is used: a lambda's body is computed for each element, with all that it is made of."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def has_word(text: Column, words: str) -> Column:
    """Whether one of ``words`` (plain words with ``|`` between them) stands in a lower-case text without a letter, digit or underscore at its ends. Those that are nowhere cost no pattern."""
    return reduce(or_, [F.contains(text, F.lit(w)) & text.rlike(f"(?<![a-z0-9_]){w}(?![a-z0-9_])") for w in words.split("|")])


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters at least, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def counted(words: Column, name: str = "term") -> Column:
    """The distinct words of an array in alphabetical order with their number of places: structs of ``name``, ``n``. Within a row, so nothing is shuffled."""
    def runs(w: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return F.get(F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(F.get(w, i).alias(name), (F.coalesce(F.get(s, k + 1), F.size(w)) - i).alias("n")))), F.lit(0))

    none = F.array().cast(f"array<struct<{name}:string,n:int>>")
    sorted_ = F.get(F.transform(F.array(F.sort_array(words)), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(none)), F.lit(0))  # bound once, not copied into every use
    return F.coalesce(sorted_, none)


def query_terms(text: Column) -> Column:
    """Distinct meaningful terms in order of first use: three characters at least, no stop words, outer apostrophes gone."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), "^'+|'+$", ""))
    return F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 3) & ~t.isin(QUERY_STOPWORDS)))


def claim_terms(text: Column) -> Column:
    """Distinct terms of a claim or of a source that a claim is held against."""
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(CLAIM_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(raw, lambda t: ~t.isin(CLAIM_STOPWORDS)))


def normalized(text: Column) -> Column:
    """Lower-case letters and digits; anything else is one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))


def compact(text: Column, limit: int) -> Column:
    """Squeezed; if longer than ``limit``, cut and marked with an ellipsis."""
    t = squeezed(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("..."))).otherwise(t)


def metadata_text(text: Column, limit: int = 1200) -> Column:
    return F.trim(F.substring(squeezed(text), 1, limit))


def lines(text: Column) -> Column:
    """Squeezed lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeezed), lambda x: x != "")


def clean_raw(text: Column) -> Column:
    """Line feeds only, no soft hyphens, no control characters but tab and line feed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "­", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    return F.regexp_replace(t, r"[\x00-\x08\x0B-\x1F\x7F]", "")


def clean_extracted(text: Column) -> Column:
    """Lines squeezed, runs of blank lines cut to one, no blank line at the ends."""
    joined = F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), squeezed), "\n")
    return F.regexp_replace(F.regexp_replace(joined, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def dehyphenated(text: Column) -> Column:
    """Words that a line end cut are joined."""
    return F.regexp_replace(text, r"([A-Za-z0-9_])-\n([A-Za-z0-9_])", "$1$2")


def clean_ocr(text: Column) -> Column:
    """Typographic quotes folded, repeated punctuation and blanks squeezed, hyphenation undone."""
    t = F.translate(F.coalesce(text, F.lit("")), "‘’“”–—", "''\"\"--")
    t = dehyphenated(t)
    t = F.regexp_replace(t, r"[ \t]+", " ")
    for mark in (".", ",", ";", ":", "!", "?", "-", "_"):
        t = F.regexp_replace(t, rf"[{mark}]{{3,}}", mark)
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


def corrected_digits(token: Column) -> Column:
    """Letters that OCR reads for digits, between digits: O is 0, I and l are 1, S is 5."""
    for letters, digit in (("[Oo]", "0"), ("[Il]", "1"), ("S", "5")):
        token = F.regexp_replace(token, rf"(?<=[0-9]){letters}(?=[0-9])", digit)
    return token


def sentences(text: Column) -> Column:
    """Split after . ! or ? where white space follows. (transform() gives a function of two parameters the index as well, and F.trim has two.)"""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\r]+"), lambda s: F.trim(s)), lambda s: s != "")


def sentences_capital(text: Column) -> Column:
    """Split after . ! or ? where white space and a capital letter or a digit follow."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\n\r]+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def claim_sentences(text: Column) -> Column:
    """Sentences of an answer: labels removed, split at sentence ends and line feeds, bullets stripped, each ending in punctuation."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[SW][0-9]+\]", "")
    parts = F.split(bare, r"(?<=[.!?])[ \t\r\n]+|\n+")
    clean = F.filter(F.transform(parts, lambda s: F.regexp_replace(squeezed(s), r"^([-*]|[0-9]+[.)]) *", "")), lambda s: s != "")
    return F.transform(clean, lambda s: F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))


def without_citations(text: Column) -> Column:
    return squeezed(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[SW][0-9]+\]", ""))


def labels_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[([SW][0-9]+)\]"), F.lit(1)))


def without_stated_confidence(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)^[ \t]*\**confidence\**[ \t]*:[ \t]*\**(high|medium|low)\**\.?[ \t]*$", "")
    return F.trim(F.regexp_replace(t, "\n{3,}", "\n\n"))


# British spellings and what they are folded to.
SPELLINGS = {
    "optimisation": "optimization", "optimise": "optimize", "optimised": "optimized", "optimising": "optimizing", "organisation": "organization", "organise": "organize", "organised": "organized",
    "organising": "organizing", "behaviour": "behavior", "colour": "color", "analyse": "analyze", "analysed": "analyzed", "analysing": "analyzing",
}


def american(text: Column) -> Column:
    for a, b in SPELLINGS.items():
        text = F.regexp_replace(text, rf"\b{a}\b", b)
    return text


def filename_key(name: Column) -> Column:
    base = F.element_at(F.split(F.lower(name), "[/\\\\]"), -1)
    return F.regexp_replace(base, "[^a-z0-9.]", "")


def stem_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename_key(name), r"\.[a-z0-9]+$", ""), "[^a-z0-9]", "")


def caption(existing: Column, ocr: Column, formula: Column, fallback: Column) -> Column:
    """The first of what is not blank."""
    clean = lambda c: F.nullif(squeezed(c), F.lit(""))
    f = clean(formula)
    return F.coalesce(clean(existing), F.substring(clean(ocr), 1, 240), F.when(f.isNotNull(), F.concat(F.lit("Formula: "), f)), fallback)
