"""Who holds an office: candidates named by sources, their names made comparable, one elected, and whether the sources disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import people as P
from quarrylight.operators.web import any_of, domain
from quarrylight.shared import saved

CURRENT, HISTORICAL = "current", "historical"

# A word of a name, and a name of two words at least.
WORD = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ.\-']+"
PLAIN = r"[A-Z][A-Za-z.\-]+"
LONG = rf"{WORD}(?:\s+{WORD}){{1,5}}"
PLAIN_LONG = rf"{PLAIN}(?:\s+{PLAIN}){{1,5}}"
# How a text names who holds an office, and whether it says so of now. Each pattern's first match counts.
STATEMENTS = (
    ("prime minister", r"\bCurrent role holder\s+([^.]+?)\.", CURRENT),
    ("prime minister", r"\bIncumbent\s+([^.]+?)\s+since\b", CURRENT),
    ("prime minister", rf"\b({LONG})\s*,\s+(?:the\s+)?(?:current\s+)?Prime Minister\b", CURRENT),
    ("prime minister", rf"\b({LONG})\s+became\s+(?:the\s+)?Prime Minister\b", HISTORICAL),
    ("prime minister", rf"\b({LONG})\s+(?:is|serves\s+as|has\s+served\s+as)\s+(?:the\s+)?(?:current\s+)?Prime Minister\b", CURRENT),
    ("president", rf"\bPresident\s+({WORD}(?:\s+{WORD}){{0,5}})\b", CURRENT),
    ("president", rf"\b({LONG})\s*,\s+(?:the\s+)?(?:current\s+)?President\b", CURRENT),
    ("president", rf"\b({LONG})\s+became\s+(?:the\s+)?President\b", HISTORICAL),
    ("president", rf"\b({LONG})\s+(?:is|has\s+been|serves\s+as|has\s+served\s+as)\s+(?:the\s+)?(?:current\s+)?President\b", CURRENT),
    ("president", rf"\b({LONG})\s+is\s+the\s+\d+(?:st|nd|rd|th)\s+and\s+\d+(?:st|nd|rd|th)\s+President\b", CURRENT),
    ("president", rf"\b({LONG})\s+is\s+the\s+[^.]{{0,40}}?\bcurrent\s+president\b", CURRENT),
    ("secretary of state", rf"\bSecretary\s+of\s+State\s+({PLAIN}(?:\s+{PLAIN}){{0,5}})\b", CURRENT),
    ("secretary of state", rf"\b({PLAIN_LONG})\s*:\s+[^.]{{0,120}}\b[Ss]ecretary\s+of\s+[Ss]tate\b", CURRENT),
    ("secretary of state", rf"\b({PLAIN_LONG})\s+(?:was\s+sworn\s+in\s+as|is)\s+(?:the\s+)?(?:\d+(?:st|nd|rd|th)\s+)?[Ss]ecretary\s+of\s+[Ss]tate\b", CURRENT),
    ("secretary of state", rf"\b({PLAIN_LONG})\s+serves\s+as\s+(?:the\s+)?(?:U\.S\.\s+)?[Ss]ecretary\s+of\s+[Ss]tate\b", CURRENT),
    ("king", rf"\bKing\s+({PLAIN}(?:\s+{PLAIN}){{0,4}})\b", CURRENT),
    ("king", rf"\b({PLAIN}(?:\s+{PLAIN}){{0,4}})\s+has\s+been\s+King\b", CURRENT),
    ("king", rf"\b({PLAIN}(?:\s+{PLAIN}){{0,4}})\s+became\s+(?:the\s+)?King\b", HISTORICAL),
    ("king", rf"\b({PLAIN}(?:\s+{PLAIN}){{0,4}})\s+is\s+(?:the\s+)?King\b", CURRENT),
)
ROLES = ("prime minister", "president", "secretary of state", "king")
# What stands before and behind a name without being part of it.
HONORIFICS = r"(?i)^(?:the\s+)?(?:(?:rt\.?\s+hon\.?|hon\.?|sir|dr|mr|mrs|ms|prof\.?|professor|h\.?\s*e\.?|his\s+excellency|her\s+excellency|his\s+majesty|her\s+majesty|hrh|h\.?r\.?h\.?)\s+)+"
TITLES = r"(?i)^(?:president|prime minister|secretary of state|king|queen)\s+"
LETTERS_BEHIND = r"\b(?:KCB|KC|MP|PC|OBE|CBE|Jr\.?|Sr\.?)\b"
SENTENCE_BEFORE = r"^(.*?[a-z])\.\s+([A-Z].*)$"
VERB_BEHIND = r"(?i)\s+(?:has\s+been|has\s+served|is|was|became|since|between|serves\s+as|served\s+as)\b.*$"
# Words at which a name is over, those of offices and bodies from the third word on only; suffixes that stay.
ACTIONS = (
    "addresses", "addressed", "announces", "announced", "appoints", "appointed", "attends", "attended", "calls", "called", "congratulates", "congratulated", "gives", "gave", "holds", "held", "hosts", "hosted", "inaugurates", "inaugurated", "launches", "launched", "meets", "met",
    "names", "named", "opens", "opened", "receives", "received", "says", "said", "signs", "signed", "takes", "took", "update", "updates", "urges", "urged", "visits", "visited", "welcomes", "welcomed",
)
BODIES = (
    "ambassador", "army", "assembly", "command", "commander", "commission", "council", "delegation", "department", "deputy", "director", "embassy", "force", "forces", "government", "house", "minister", "ministry", "office", "parliament", "presidency", "secretary",
)
SUFFIXES = ("ii", "iii", "iv", "jr", "sr")
# What no person's name holds.
NO_PERSON_WORDS = ("find", "contact", "elected", "officials", "breaking", "latest", "updates", "news")
NO_PERSON = r"(?i)\b(?:department|duties|government|house|minister|official|prime|secretary|state|united states)\b"
# Pages that list officials, those of the one country whose secretary of state is meant, titles of news pages, official titles, and words that tell of a term that runs.
DIRECTORIES = ("find and contact elected officials", "contact elected officials", "current list of all elected officials", "government directory", "officials directory")
US_STATE = ("state.gov", "usembassy.gov", "u.s. department of state", "united states department of state")
NEWS_TITLES = ("news", "breaking", "latest updates", "opinion")
OFFICIAL_TITLES = ("royal house", "white house")
RUNNING = ("current role holder", "incumbent", "has been king", "current role {role}", "is the {role}", "is {role}", "serves as {role}", "sworn in as {role}")
# Words that are no part of a name when names are compared.
COURTESIES = ("the", "rt", "hon", "sir", "dr", "mr", "mrs", "ms")
EDGES = " ,.;:()[]{}"


def _bare(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGES))


def _shown(word: Column) -> Column:
    """A word all in capitals, but for suffixes, as names are written."""
    bare = _bare(word)
    parts = lambda x, mark: F.array_join(F.transform(F.split(x, mark), F.initcap), mark)
    written = F.array_join(F.transform(F.split(bare, "-"), lambda p: parts(p, "'")), "-")
    return F.when((F.length(bare) > 1) & (bare == F.upper(bare)) & (bare != F.lower(bare)) & ~F.lower(bare).isin(*SUFFIXES), F.replace(word, bare, written)).otherwise(word)


def with_name(df: DataFrame, raw: str, name: str = "name") -> DataFrame:
    """``df`` with the name in ``raw`` without titles and letters behind it, up to the first word that cannot be part of it: an ordered fold over its words, each judged by its place. In two steps, so that the words are made once."""
    t = F.trim(F.coalesce(F.col(raw), F.lit("")))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, HONORIFICS, ""), TITLES, ""), LETTERS_BEHIND, "")
    t = F.regexp_replace(F.regexp_replace(t, SENTENCE_BEFORE, "$2"), r"(?i)['’]s$", "")
    words = F.split(F.trim(F.regexp_replace(t, VERB_BEHIND, "")), r"\s+")
    bare = lambda w: F.struct(w.alias("word"), _bare(w).alias("bare"), F.btrim(F.lower(_bare(w)), F.lit("'’")).alias("plain"))
    acronym = lambda x: x["bare"].rlike(r"^[A-Z][A-Z0-9&./-]+$") & ~x["bare"].rlike(r"^[A-Z]{4,}$") & ~F.lower(x["bare"]).isin(*SUFFIXES)
    over = lambda x, i: (x["plain"] != "") & (((i > 0) & x["plain"].isin(*ACTIONS)) | ((i >= 2) & (x["plain"].isin(*BODIES) | acronym(x))))
    d = T.held(df, words_=F.transform(words, bare))
    d = T.held(d, end_=F.array_position(F.transform("words_", over), F.lit(True)).cast("int"))
    kept = F.filter(F.when(F.col("end_") > 0, F.slice("words_", F.lit(1), F.col("end_") - 1)).otherwise(F.col("words_")), lambda x: x["plain"] != "")
    joined = F.btrim(F.array_join(F.transform(kept, lambda x: x["word"]), " "), F.lit(" ,.-"))
    return d.withColumn(name, F.array_join(F.transform(F.split(joined, " "), _shown), " ")).drop("words_", "end_")


def is_person_name(name: Column) -> Column:
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    folded = F.transform(words, lambda w: F.lower(_bare(w)))
    other = F.exists(folded, lambda w: F.btrim(w, F.lit("'’!?")).isin(*NO_PERSON_WORDS, *ACTIONS, *BODIES))
    return F.coalesce(name.rlike("[A-Za-z]") & ~name.rlike(r"(?i)^(?:of|the)\b") & F.size(words).between(1, 5) & ~other & ~name.rlike(NO_PERSON), F.lit(False))


def title_head(title: Column) -> Column:
    """A title up to a bar or a dash, ``SURNAME Given`` turned round."""
    head = F.trim(F.get(F.split(F.coalesce(title, F.lit("")), r"\s+\|\s+|\s+-\s+"), F.lit(0)))
    turned = F.concat(F.regexp_extract(head, r"^\S+\s+(\S+)$", 1), F.lit(" "), F.regexp_extract(head, r"^(\S+)\s", 1))
    return F.when(head.rlike(r"^[A-Z][A-Z\-']+\s+[A-Z][a-z\-']+$"), turned).otherwise(head)


def quality(name: Column, from_title: Column) -> Column:
    n = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    return n * 2.0 + F.when(from_title, 1.0).otherwise(0.0) - F.when(n == 1, 1.5).otherwise(0.0) + F.when(F.contains(name, F.lit(".")), 0.3).otherwise(0.0)


def named(role: Column, title: Column, content: Column) -> Column:
    """Where a source names candidates for a role: structs of ``pos``, ``kind``, ``from_title`` and the ``raw`` match, the content's statements first, then the title's; last the title of a page that says it is a holder's profile."""
    found = []
    for from_title, text in ((False, content), (True, title)):
        for n, (office, pattern, kind) in enumerate(STATEMENTS):
            raw = F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
            found.append(F.when(role == office, F.struct(F.lit(n + 100 * from_title).alias("pos"), F.lit(kind).alias("kind"), F.lit(from_title).alias("from_title"), raw.alias("raw"))))
    profile = F.coalesce(F.rlike(F.coalesce(content, F.lit("")), F.concat(F.lit(r"(?i)\bcurrent\s+role\b[:\s]*(?:the\s+)?"), role, F.lit(r"\b"))), F.lit(False))
    found.append(F.when(profile & ~any_of(F.lower(F.coalesce(title, F.lit(""))), NEWS_TITLES), F.struct(F.lit(200).alias("pos"), F.lit(CURRENT).alias("kind"), F.lit(True).alias("from_title"), title_head(title).alias("raw"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull() & (x["raw"] != ""))


def candidates(sources: DataFrame) -> DataFrame:
    """``source_id``, ``name``, ``kind``: of each source (``source_id``, distinct, ``role``, ``title``, ``content``) the best candidate; sources that name none have no row. A name that any of its statements gives as of now is current."""
    each = sources.select("source_id", F.explode(named(F.col("role"), F.col("title"), F.col("content"))).alias("x")).select("source_id", "x.*")
    persons = with_name(each, "raw").where(is_person_name(F.col("name"))).withColumn("key", F.lower("name"))
    worth = F.struct(quality(F.col("name"), F.col("from_title")).alias("q"), F.length("name").alias("n"), (-F.col("pos")).alias("order"), "name", "key")
    told = persons.groupBy("source_id").agg(F.max(worth).alias("best"), F.collect_set(F.when(F.col("kind") == CURRENT, F.col("key"))).alias("now"))
    return told.select("source_id", "best.name", F.when(F.array_contains("now", F.col("best.key")), CURRENT).otherwise(HISTORICAL).alias("kind"))


def official(url: Column, title: Column) -> Column:
    return any_of(F.lower(F.coalesce(url, F.lit(""))), P.OFFICIAL) | any_of(F.lower(F.coalesce(title, F.lit(""))), OFFICIAL_TITLES)


def source_score(role: Column, url: Column, title: Column, content: Column) -> Column:
    """How much a source that names a candidate is worth for a question of now."""
    t, hay = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))))
    listed = F.exists(T.lit_array(DIRECTORIES), lambda m: F.contains(F.lower(F.concat_ws(" ", title, url, content)), m))
    running = F.exists(T.lit_array(RUNNING), lambda m: F.contains(hay, F.replace(m, F.lit("{role}"), role)))
    plus = lambda test, x: F.when(test, x).otherwise(0.0)
    return 1.0 + plus(official(url, title), 5.0) + plus(F.startswith(t, role), 2.0) + plus(running, 1.0) - plus(P.past_tenure(hay, role) > 0, 3.0) - plus(listed, 4.0)


def evidence(sources: DataFrame) -> DataFrame:
    """The candidates of each question (``qid``, ``role``, ``country`` or null) that count, with ``score`` and ``domain``.

    Noise and directories of officials are left out. Where official sources name anybody, they alone count; else, where the
    question has a country, all do, and without one those whose name two domains at least give.
    """
    held = T.held(sources, hay_=F.lower(F.concat_ws(" ", "title", "url", "content")))
    has = lambda markers: F.exists(T.lit_array(markers), lambda m: F.contains(F.col("hay_"), m))
    usable = held.where(~has(P.NOISY) & ~has(DIRECTORIES) & ((F.col("role") != "secretary of state") | has(US_STATE))).drop("hay_")
    c = usable.join(candidates(usable), "source_id").withColumns({"official": official(F.col("url"), F.col("title")), "domain": domain(F.col("url")), "key": F.lower("name"), "score": source_score(F.col("role"), F.col("url"), F.col("title"), F.col("content"))})
    c = saved(c.drop("title", "content"), "office_candidates")  # read several times below
    by_name = c.groupBy("qid", "key").agg(F.countDistinct(F.when(F.col("domain") != "", F.col("domain"))).alias("n_domains"))
    any_official = c.groupBy("qid").agg(F.bool_or("official").alias("some_official"))
    c = c.join(by_name, ["qid", "key"]).join(any_official, "qid")
    return c.where(F.when(F.col("some_official"), F.col("official")).otherwise(F.col("country").isNotNull() | (F.col("n_domains") >= 2))).drop("n_domains", "some_official")


def name_tokens(name: Column) -> Column:
    """The words that names are compared by, in order."""
    return F.filter(F.regexp_extract_all(P.folded(name), F.lit("[a-zà-öø-ÿ'-]+"), F.lit(0)), lambda t: F.length(t) > 1)


def agree(a: Column, b: Column, last_a: Column, last_b: Column) -> Column:
    """Whether two names, as sorted arrays of distinct words, can be one person's: one's words within the other's, the same first and last word of the alphabet, or a shared word and the same last word. Not transitive."""
    shared = F.size(F.array_intersect(a, b))
    ends = (F.size(a) >= 2) & (F.size(b) >= 2) & (F.array_min(a) == F.array_min(b)) & (F.array_max(a) == F.array_max(b))
    return (F.size(a) > 0) & (F.size(b) > 0) & ((shared == F.least(F.size(a), F.size(b))) | ends | ((shared > 0) & (last_a == last_b)))


def conflicts(names: DataFrame, by: str = "qid") -> DataFrame:
    """``by``, ``conflict``: whether any two names (``name``) of a group cannot be one person's. Null and empty names don't count; a group without names has no row.

    Names that share their last word agree. So all are first held against the group's shortest and longest name, which takes
    one join; only groups where nobody disagrees with those two compare the names that have different last words, pair by pair.
    """
    tokens = T.held(names.select(by, "name").where(F.trim(F.coalesce("name", F.lit(""))) != ""), t=name_tokens(F.col("name")))
    n = tokens.select(by, F.array_sort(F.array_distinct(F.filter("t", lambda x: ~x.isin(*COURTESIES)))).alias("t"), F.coalesce(F.try_element_at("t", F.lit(-1)), F.lit("")).alias("last"), F.lower("name").alias("key"))
    n = n.groupBy(by, "t", "last").agg(F.min("key").alias("key"), F.max("key").alias("other_key"))
    ends = n.groupBy(by).agg(F.min(F.struct(F.size("t").alias("n"), "key", "t", "last")).alias("short"), F.max(F.struct(F.size("t").alias("n"), "key", "t", "last")).alias("long"), F.count("*").alias("classes"), F.bool_or((F.size("t") == 0) & (F.col("key") != F.col("other_key"))).alias("unreadable"))
    held = n.join(ends, by)
    same = lambda x: (F.col("t") == F.col(x)["t"]) & (F.col("last") == F.col(x)["last"])
    against = lambda x: ~same(x) & ~agree(F.col("t"), F.col(x)["t"], F.col("last"), F.col(x)["last"])
    told = held.groupBy(by).agg((F.bool_or(against("short") | against("long")) | F.bool_or("unreadable")).alias("conflict"), F.countDistinct("last").alias("lasts"))
    left = n.join(told.where(~F.col("conflict") & (F.col("lasts") > 1)).select(by), by)
    a, b = left.select(by, F.col("t").alias("ta"), F.col("last").alias("la")), left.select(by, F.col("t").alias("tb"), F.col("last").alias("lb"))
    bad = a.join(b, by).where((F.col("la") < F.col("lb")) & ~agree(F.col("ta"), F.col("tb"), F.col("la"), F.col("lb"))).select(by).distinct()
    return told.join(bad.withColumn("bad", F.lit(True)), by, "left").select(by, F.coalesce(F.col("conflict") | F.col("bad"), F.col("conflict")).alias("conflict"))


def holders(sources: DataFrame) -> DataFrame:
    """``qid``, ``name``, ``kind``, ``label``, ``n_domains``, ``conflict``: of each question's sources (``source_id``, ``qid``, ``role``, ``country``, ``label``, ``url``, ``title``, ``content``) the elected holder, and whether the names that count disagree.

    A name given as of now comes before one of the past, then the name that more domains give, then that of the best source;
    ties go to the smaller name, of a name's sources to the smaller id. Questions without a candidate have no row.
    """
    e = evidence(sources)
    g = e.groupBy("qid", "key").agg(F.bool_or(F.col("kind") == CURRENT).alias("current"), F.countDistinct(F.when(F.col("domain") != "", F.col("domain"))).alias("n_domains"), F.max("score").alias("score"), F.min_by(F.struct("name", "label"), F.struct((-F.col("score")).alias("s"), "source_id")).alias("best"))
    w = Window.partitionBy("qid").orderBy(F.desc("current"), F.desc("n_domains"), F.desc("score"), "key")
    first = g.withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return first.join(conflicts(e.select("qid", "name")), "qid").select("qid", "best.name", F.when(F.col("current"), CURRENT).otherwise(HISTORICAL).alias("kind"), "best.label", "n_domains", "conflict")
