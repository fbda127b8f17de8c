"""The normal form of a question: what it asks, its terms, its entities, its canonical text, its search variants, and likeness of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

# Words that carry no meaning, first words by what is asked, and attributes by the words that mean them.
STOPWORDS = (
    "a", "about", "an", "are", "be", "been", "being", "by", "can", "could", "does", "for", "from", "give", "how", "in", "is", "me", "of", "on", "please", "show", "tell", "the", "to", "total", "was", "were", "what", "what's", "whats", "when", "where", "which", "who", "why", "with", "would",
)
INTENTS = {
    "what": ("what", "whats", "what's", "define", "explain"), "who": ("who", "whose", "whom"), "when": ("when", "what date", "what year", "what time"), "where": ("where", "which location", "which place"), "why": ("why", "how come"), "how": ("how", "in what way"),
    "yes_no": ("is", "are", "was", "were", "do", "does", "did", "can", "could", "should"),
}
ATTRIBUTES = {
    "area": ("area", "big", "bigger", "extent", "landmass", "size", "surface"), "population": ("inhabitants", "people", "population", "residents"), "capital": ("capital", "capital city", "seat"), "date": ("date", "founded", "time", "when", "year"),
    "leader": ("chief executive officer", "ceo", "chancellor", "head", "leader", "president", "prime minister"),
}
#: (phrase, attribute), longest phrase first, then by the alphabet.
PHRASES = sorted(((p, a) for a, ps in ATTRIBUTES.items() for p in ps), key=lambda x: (-len(x[0]), x[0]))
MOST_TERMS = 12
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
CAPITALISED = f"(?:^|[^{LETTER}0-9_])([A-Z][{LETTER}0-9'-]+(?: +[A-Z][{LETTER}0-9'-]+)*)"
EDGE = f"(?:$|[^{LETTER}0-9_])"
BEHIND = f"(?:^|[^{LETTER}0-9_])(?:of|in|for|from) +([a-z][a-z0-9'-]+(?: +[a-z][a-z0-9'-]+){{0,4}}){EDGE}"
BEFORE = f"(?:^|[^{LETTER}0-9_])([a-z][a-z0-9'-]+) +(?:area|size|population|capital){EDGE}"
TERM = "[a-z0-9][a-z0-9'-]*"
OUTER = " .,:;?!"


def clean(text: Column) -> Column:
    """Lower case without possessives and without marks but apostrophes and hyphens, one blank between."""
    t = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("'s"), F.lit(" "))
    return T.squeezed(F.regexp_replace(t, "[^a-z0-9_à-öø-ÿ' \t\n\r-]+", " "))


def intent(cleaned: Column) -> Column:
    """By what the first three words hold; the first kind that fits counts."""
    head = F.array_join(F.slice(F.split(cleaned, " "), 1, 3), " ")
    c = F.when(cleaned == "", "statement")
    for name, words in INTENTS.items():
        for w in words:
            c = c.when(F.contains(head, F.lit(w)), name)
    return c.otherwise("statement")


def unique(values: Column) -> Column:
    """Squeezed lower-case values, each once."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: T.squeezed(F.lower(x))), lambda x: x != ""))


def _listed(x: Column) -> Column:
    return x.isin(*STOPWORDS, *(p for p, _ in PHRASES))


def entities(text: Column) -> Column:
    """Capitalised spans, quoted ones, and what stands behind "of", "in", "for", "from" or before an attribute; first letters capital, each once."""
    t = T.squeezed(text)
    wide = F.replace(F.lower(t), F.lit(" "), F.lit("  "))  # so that one blank can end a match and the next begin another
    spans = F.filter(F.transform(F.regexp_extract_all(t, F.lit(CAPITALISED), F.lit(1)), lambda x: F.regexp_replace(x, "['-]+$", "")), lambda x: (F.length(x) > 1) & ~_listed(F.lower(x)))

    def loose(pattern: str) -> Column:
        words = lambda x: F.filter(F.regexp_extract_all(x, F.lit("[a-z][a-z0-9'-]*"), F.lit(0)), lambda w: ~_listed(w))
        return F.transform(F.regexp_extract_all(wide, F.lit(pattern), F.lit(1)), lambda x: F.array_join(F.reverse(F.slice(F.reverse(words(x)), 1, 4)), " "))

    every = F.concat(spans, F.regexp_extract_all(t, F.lit('"([^"]+)"'), F.lit(1)), loose(BEHIND), loose(BEFORE))
    return F.transform(unique(F.transform(every, lambda x: F.regexp_replace(x, f"^[{OUTER}]+|[{OUTER}]+$", ""))), F.initcap)


def terms_of(names: Column) -> Column:
    return F.flatten(F.transform(names, lambda x: F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0))))


def key_terms(cleaned: Column, names: Column) -> Column:
    """Attributes that phrases mean, then words (attributes for those that mean one) that are in no entity, then the entities' words; twelve at most."""
    padded = F.concat(F.lit(" "), cleaned, F.lit(" "))
    meant = F.array_compact(F.array(*[F.when(padded.rlike(f"[^a-z0-9_à-öø-ÿ]{p}[^a-z0-9_à-öø-ÿ]"), F.lit(a)) for p, a in PHRASES]))
    single = F.create_map(*[F.lit(x) for p, a in PHRASES if " " not in p for x in (p, a)])
    own = F.filter(F.split(cleaned, " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
    own = F.filter(F.transform(own, lambda w: F.coalesce(F.try_element_at(single, w), w)), lambda w: ~F.array_contains(terms_of(names), w))
    return F.slice(unique(F.concat(meant, own, terms_of(names))), 1, MOST_TERMS)


def normal(questions: DataFrame) -> DataFrame:
    """Adds ``intent``, ``entities``, ``key_terms``, ``canonical`` to questions; null and blank ones are statements without terms."""
    t = T.squeezed(F.col("question"))
    d = T.held(questions, c_=clean(t), entities=entities(t))
    d = T.held(d, key_terms=key_terms(F.col("c_"), F.col("entities")))
    return d.withColumns({"intent": intent(F.col("c_")), "canonical": F.array_join("key_terms", " ")}).drop("c_")


def search_forms(normals: DataFrame) -> DataFrame:
    """``qid``, ``forms``: the question, its canonical text, its entities before and behind its terms, and what its attributes add, in lower case, each once."""
    e, own = F.array_join("entities", " "), F.array_except("key_terms", terms_of(F.col("entities")))
    t = F.array_join(F.when(F.size(own) > 0, own).otherwise(F.col("key_terms")), " ")
    subject = F.when(e != "", e).otherwise(t)
    has = lambda a: F.array_contains("key_terms", a)
    every = F.array(
        T.squeezed(F.col("question")), F.col("canonical"), F.when((e != "") & (t != ""), F.concat_ws(" ", e, t)), F.when((e != "") & (t != ""), F.concat_ws(" ", t, e)), F.when(F.col("intent").isin("what", "statement") & (t != ""), F.concat(t, F.lit(" information"))),
        F.when(has("area"), F.concat(subject, F.lit(" area square kilometers"))), F.when(has("area"), F.concat(subject, F.lit(" total area"))), F.when(has("population"), F.concat(subject, F.lit(" population inhabitants"))),
    )
    return normals.select("qid", unique(F.array_compact(every)).alias("forms"))


def alike(pairs: DataFrame, threshold: float = 0.8) -> Column:
    """Whether the normal forms ``a`` and ``b`` (structs) of a pair ask the same: equal canonical texts, enough shared terms, or a shared entity with the same other terms. Where this is false, match.string_similarity() of the canonical texts may still say so."""
    x, y = F.col("a.key_terms"), F.col("b.key_terms")
    shared = F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(x), F.size(y))
    ex, ey = terms_of(F.col("a.entities")), terms_of(F.col("b.entities"))
    core = lambda k, e: F.array_sort(F.array_except(k, e))
    same_core = F.arrays_overlap(ex, ey) & (F.size(core(x, ex)) > 0) & (core(x, ex) == core(y, ey))
    both = (F.col("a.canonical") != "") & (F.col("b.canonical") != "")
    return both & ((F.col("a.canonical") == F.col("b.canonical")) | (shared >= threshold) | same_core)
