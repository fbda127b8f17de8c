"""What a document says about itself: authors, abstract, keywords, dates and places that OCR has blurred, formulas as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.people import folded

# Lines at which a list of authors ends, lines that name no author, and how a name looks.
AUTHORS_END = "^(abstract|keywords|introduction)"
NO_AUTHOR = r"(^|[^a-z0-9_])(university|department|faculty|school|http|doi)($|[^a-z0-9_])"
NAMES = r"[A-Z][a-z]+([ \t]+[A-Z][a-z]+)+"
AUTHOR_LINES, MOST_AUTHORS = (2, 9), 3
# Where an abstract stands (80 to 1600 characters up to the next section) and where keywords do, and how much of each is kept.
ABSTRACT = r"(?is)\babstract\b\s*[:.\-]?\s*(.{80,800}?.{0,800}?)\n\s*(?:keywords?|1\.?\s+introduction|introduction|references)\b"
KEYWORDS = r"(?im)^[ \t]*key[ \t]*words?[ \t]*[:\-][ \t]*([^\n]+)$"
ABSTRACT_CHARS, KEYWORDS_CHARS = 900, 400
# Letters that OCR reads for digits, and those digits.
BLURRED, DIGITS = "BbIiLlOoRrSsTtZz", "8811110011551122"
ONE_DIGIT = f"[0-9{BLURRED}]"
DATE = rf"\b(?:{ONE_DIGIT}{{2}}[./-]{ONE_DIGIT}{{2}}[./-]{ONE_DIGIT}{{4}}|{ONE_DIGIT}{{4}}-{ONE_DIGIT}{{2}}-{ONE_DIGIT}{{2}}(?:-[A-Za-z]{{2}})?)\b"
CLEAR_DATE = r"^([0-9]{2}[./-][0-9]{2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})$"
# Words before a place, words behind it, and nationalities by what stands for them.
PLACE_MARKERS = {"birth_place": ("place of birth", "lieu de naissance"), "issue_place": ("place of issue", "lieu de delivrance", "issued in")}
PLACE_CHARS, ORIGIN_CHARS = 64, 48
PLACE_END = r"\s+[0-9]{1,2}\.?\s+|\s+(signature|bearer|profession|occupation|height|date|place of issue|place of birth)\b"
ORIGINS = (
    ("Cameroon", "cameroon|cameroun"), ("Democratic Republic Of The Congo", "congo|congolese|rdc"), ("France", "france|french"), ("Luxembourg", "luxembourg"), ("Belgium", "belgium|belgian|belgique"), ("Nigeria", "nigeria"), ("Ghana", "ghana"),
    ("Kenya", "kenya"), ("Uganda", "uganda"), ("Rwanda", "rwanda"), ("Burundi", "burundi"), ("United States", "unitedstates|american|usa"), ("United Kingdom", "unitedkingdom|british|uk"),
)


def words_apart(text: Column) -> Column:
    r"""The text with marked letters as underscores and other characters beyond ASCII as blanks, so that ``\b`` means the same everywhere."""
    return F.regexp_replace(F.regexp_replace(text, "[À-ÖØ-öø-ÿŒœ]", "_"), r"[^\x00-\x7F]", " ")


def authors(text: Column) -> Column:
    """Up to three of a document's second to tenth lines, those before its abstract that hold capitalised names and no institution."""
    first, n = AUTHOR_LINES
    head = F.slice(T.lines(text), first, n)
    end = F.array_position(F.transform(head, lambda x: F.lower(x).rlike(AUTHORS_END)), True)
    before = F.when(end > 0, F.slice(head, 1, F.greatest(end.cast("int") - 1, F.lit(0)))).otherwise(head)
    return F.array_join(F.slice(F.filter(before, lambda x: ~F.lower(x).rlike(NO_AUTHOR) & x.rlike(NAMES)), 1, MOST_AUTHORS), "; ")


def abstract(text: Column) -> Column:
    return T.metadata_text(F.regexp_extract(words_kept(text), ABSTRACT, 1), ABSTRACT_CHARS)


def words_kept(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stated_keywords(text: Column) -> Column:
    """What a line "Keywords: ..." lists."""
    return T.metadata_text(F.regexp_extract(words_kept(text), KEYWORDS, 1), KEYWORDS_CHARS)


def blurred_dates(text: Column) -> Column:
    """Numeric dates in order of their place, with letters that stand for digits put right; what is no date then is left out."""
    found = F.regexp_extract_all(words_apart(F.coalesce(text, F.lit(""))), F.lit(DATE), F.lit(0))
    clear = F.transform(found, lambda x: F.translate(F.regexp_replace(x, "-[A-Za-z]{2}$", ""), BLURRED, DIGITS))
    return F.filter(clear, lambda x: x.rlike(CLEAR_DATE))


def place(text: Column, kind: str) -> Column:
    """The place behind the first marker of its kind, as a title; null if there is none."""
    t = T.squeezed(folded(text))

    def behind(marker: str) -> Column:
        at = F.instr(t, marker)
        tail = F.regexp_replace(F.substring(t, at + len(marker), F.lit(PLACE_CHARS)), "^[ /:;,-]+", "")
        tail = F.regexp_replace(F.get(F.split(tail, PLACE_END, 2), F.lit(0)), "^[a-z] +", "")
        tail = F.regexp_replace(F.regexp_replace(tail, "[^a-z '’-]+$", ""), "^[ .,;:-]+|[ .,;:-]+$", "")
        return F.when((at > 0) & (tail != ""), F.initcap(tail))

    return F.coalesce(*[behind(m) for m in PLACE_MARKERS[kind]])


def origin(text: Column) -> Column:
    """The country of a stated nationality, blanks and marks aside; null if it is none of ORIGINS."""
    t = T.squeezed(folded(text))
    at = F.instr(t, "nationality")
    tail = F.regexp_replace(F.translate(F.substring(t, at + len("nationality"), F.lit(ORIGIN_CHARS)), "0", "o"), "[^a-z]+", "")
    return F.when(at > 0, F.coalesce(*[F.when(tail.rlike(p), name) for name, p in ORIGINS]))


def formula_text(repaired: Column, raw: Column, kind: Column, variables: Column, around: Column) -> Column:
    """A formula as a text to index: a labelled line for each thing known of it (``variables``: a map of names and meanings)."""
    line = lambda label, v: F.concat(F.lit(f"{label}: "), v)
    blank = lambda c: F.coalesce(c, F.lit(""))
    named = F.array_join(F.transform(F.map_entries(variables), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return F.concat_ws("\n", line("Formula", F.when(blank(repaired) != "", repaired).otherwise(blank(raw))), line("Raw formula", blank(raw)), line("Type", F.when(blank(kind) != "", kind).otherwise("unknown")), F.when(named != "", line("Variables", named)), line("Surrounding text", blank(around)))
