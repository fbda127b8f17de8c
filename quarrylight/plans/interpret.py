"""Interpretation of a question beside what a conversation is about: intent, standalone question, sources, search plan.

One row per question and state (``country``, ``person``, ``role``, ``holder`` of that role, ``topic``; empty where nothing is
known), all as Column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T

# Names of countries, of offices and of news outlets, as questions have them and as plans do.
COUNTRIES = {
    "britain": "United Kingdom", "cameroon": "Cameroon", "cameroun": "Cameroon", "democratic republic of congo": "Democratic Republic of the Congo", "democratic republic of the congo": "Democratic Republic of the Congo",
    "dr congo": "Democratic Republic of the Congo", "drc": "Democratic Republic of the Congo", "france": "France", "french": "France", "great britain": "United Kingdom", "luxembourg": "Luxembourg", "netherlands": "Netherlands",
    "norway": "Norway", "norwegian": "Norway", "rdc": "Democratic Republic of the Congo", "the congo": "Democratic Republic of the Congo", "the netherlands": "Netherlands", "the uk": "United Kingdom",
    "the united kingdom": "United Kingdom", "the united states": "United States", "u k": "United Kingdom", "u s": "United States", "uk": "United Kingdom", "united kingdom": "United Kingdom", "united states": "United States", "usa": "United States",
}
WITH_ARTICLE = ["Democratic Republic of the Congo", "Netherlands", "United Kingdom", "United States"]
ROLES = {
    "prime minister": "Prime Minister", "premier": "Prime Minister", "defence minister": "Minister of Defence", "defense minister": "Minister of Defence", "minister of defence": "Minister of Defence", "minister of defense": "Minister of Defence",
    "foreign minister": "Minister of Foreign Affairs", "minister of foreign affairs": "Minister of Foreign Affairs", "finance minister": "Minister of Finance", "minister of finance": "Minister of Finance", "interior minister": "Minister of the Interior",
    "president": "President", "secretary of state": "Secretary of State", "king": "King", "queen": "Queen", "monarch": "Monarch", "grand duke": "Grand Duke", "grand duchess": "Grand Duchess", "ceo": "CEO", "chief executive officer": "CEO",
    "founder": "Founder", "chair": "Chair", "chairman": "Chair", "chairwoman": "Chair", "director": "Director", "head of": "Head",
}
OUTLETS = {
    "reuters": "Reuters", "ap": "AP News", "ap news": "AP News", "associated press": "AP News", "bbc": "BBC News", "bbc news": "BBC News", "sky": "Sky News", "sky news": "Sky News", "financial times": "Financial Times", "ft": "Financial Times",
    "guardian": "The Guardian", "the guardian": "The Guardian",
}
ALL_OUTLETS = ["Reuters", "AP News", "BBC News", "Sky News", "Financial Times", "The Guardian"]
DOMAINS = {"Reuters": "reuters.com", "AP News": "apnews.com", "BBC News": "bbc.com", "Sky News": "news.sky.com", "Financial Times": "ft.com", "The Guardian": "theguardian.com"}
# Words and phrases that decide, as patterns of normalized questions.
ANY_COUNTRY = r"\bpresident of (the )?country\b"
PRONOUN_WORDS = "he|him|his|she|her|they|them|their|it|its|this|that|same"
PRONOUN = rf"\b({PRONOUN_WORDS})\b"
OFFICE_START = r"\b(became|become|came into power|come into power|came to power|come to power|took office|assumed office|in power)\b"
SUPERLATIVE = r"\b(smallest|largest|biggest|least populated|most populated) country\b|\bpresident of (the )?(smallest|largest|biggest) country\b"
SOURCE_MORE = r"\b(why|whether|resigned|resignation|happened|more)\b"
SOURCE_FILLER = r"\b(search|check|look up|tell me|about|on|and|more|why)\b"
ONLY_SOURCE = ["reuters", "bbc", "bbc news", "ap", "ap news", "news", "news channels"]
LOCAL = r"\b(local files?|uploaded documents?|my files?|the files?|which document|which file)\b"
WEB = r"\b(web|online|internet|latest|current|recent|today|news|search)\b"
CURRENT = r"\b(current|latest|recent|today|now|breaking|updated|newest|most recent)\b"
DEFINING = r"^(what is|what are|explain|define) "
NO_SCIENCE = r"\b(president|prime minister|king|queen|country|capital|population)\b"
ORIGIN = r"^who (invented|introduced|developed) "
NO_PERSON = "search|check|find|look|show|tell|what|who|when|where|why|how|is|are|does|do|did|minister|president"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
NAME_WORD = f"[{LETTER}][{LETTER}'’-]+"
OUTER = f"[^{LETTER}0-9_]"
TOPIC_ASKED = (
    (r"^(name|list|identify|show)( me)?( the)? (.+?)( in the world| around the world| worldwide| globally| in history| over time| in the last [0-9]+ years| during the last [0-9]+ years|$)", 4),
    (r"^(which|what) (.+?) (have|has|are|were|was|erupted|occurred|exist|exist in|are found|can be found)\b", 2),
    (r"^(what are|what were)( the)? (.+?)( in the world| around the world| worldwide| globally| in history|$)", 3),
)
TOPIC_TAIL = r"\b(that|which|who|where|when|with|from|not only|only)\b.*$"
TOPIC_WEAK = r"\b(all|some|major|main|known|famous)\b"
# What a plan prefers, and how an answer is given, by intent.
PREFERRED = {
    "person": "University, ORCID, Google Scholar, GitHub, ResearchGate", "current_or_public_fact": "official biography, reliable web", "government": "Government, Official biography, Reuters, Wikipedia",
    "scientific_definition": "Local papers, University, arXiv, DOI, Model knowledge", "scientific_explanation": "local files, scientific web, model knowledge", "local_document": "local files", "general": "local evidence, web, model knowledge",
}
RESPONSE_MODES = {"local_document": "document-grounded", "news": "current-summary", "current_or_public_fact": "current-fact", "government": "current-fact", "scientific_explanation": "explanation", "public_knowledge": "public-answer"}
FRESH_INTENTS = ["current_or_public_fact", "government", "news"]


def normalized(text: Column) -> Column:
    """Lower-case ASCII letters, digits and apostrophes, one space between."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9' ]+", " "), " +", " "))


def _first(text: Column, table: dict[str, str]) -> Column:
    """The value of the first key of ``table`` that stands in the text as whole words; empty without one."""
    return F.coalesce(*[F.when(text.rlike(rf"\b{k}\b"), v) for k, v in table.items()], F.lit(""))


def country_of(norm: Column) -> Column:
    """The longest country name that counts."""
    return _first(norm, dict(sorted(COUNTRIES.items(), key=lambda kv: (-len(kv[0]), kv[0]))))


def role_of(norm: Column) -> Column:
    return _first(norm, ROLES)


def phrase(country: Column) -> Column:
    return F.when(country.isin(WITH_ARTICLE), F.concat(F.lit("the "), country)).otherwise(country)


def outlets_of(norm: Column) -> Column:
    """The news outlets that a question names, in the order of OUTLETS, all of them for "news channels"."""
    named = F.array_compact(F.array(*[F.when(norm.rlike(rf"\b{k}\b"), F.lit(v)) for k, v in OUTLETS.items()]))
    every = F.when(F.contains(norm, F.lit("news channel")), T.lit_array(ALL_OUTLETS)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(named, every))


def only_sources(norm: Column) -> Column:
    rest = F.trim(F.regexp_replace(F.regexp_replace(norm, SOURCE_FILLER, " "), " +", " "))
    return ~norm.rlike(SOURCE_MORE) & rest.isin(ONLY_SOURCE)


def bare_person(question: Column) -> Column:
    """Two to five words of three letters at least and none that asks: a name on its own; else empty."""
    text = T.squeezed(F.regexp_replace(T.squeezed(question), "^[.,;:!?]+|[.,;:!?]+$", ""))
    words = F.regexp_extract_all(text, F.lit(NAME_WORD), F.lit(0))
    asks = F.lower(text).rlike(f"(^|{OUTER})({NO_PERSON})($|{OUTER})")
    ok = (text != "") & ~F.contains(F.coalesce(question, F.lit("")), F.lit("?")) & ~asks & F.size(words).between(2, 5) & ~F.exists(words, lambda w: F.length(w) <= 2)
    return F.when(ok, text).otherwise("")


def with_reference(question: Column, subject: Column) -> Column:
    """The question with its first pronoun replaced."""
    marked = F.regexp_replace(question, rf"(?is)^(.*?)(^|{OUTER})(?:{PRONOUN_WORDS})($|{OUTER}.*$)", "$1$2\u0001$3")
    return F.replace(marked, F.lit("\u0001"), subject)


def public_topic(norm: Column) -> Column:
    """What a question asks to name or list; empty if it asks for nothing of the kind."""
    def clean(t: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(t, TOPIC_TAIL, ""), "^(the|a|an) +", "")
        t = F.trim(F.regexp_replace(F.regexp_replace(t, TOPIC_WEAK, ""), " +", " "))
        return F.when((F.length(t) < 4) | t.rlike("local file|document|uploaded"), F.lit("")).otherwise(t)

    found = [clean(F.regexp_extract(norm, p, g)) for p, g in TOPIC_ASKED]
    return F.coalesce(*[F.when(t != "", t) for t in found], F.lit(""))


def topic_follow_up(question: Column, norm: Column, topic: Column) -> Column:
    """The question with "which ones", or the topic's last word behind which or what, replaced by the topic; empty otherwise."""
    head = F.try_element_at(F.split(normalized(topic), " "), F.lit(-1))
    ones = F.replace(F.regexp_replace(question, r"(?is)^(.*?)\bwhich ones\b(.*)$", "$1Which \u0001$2"), F.lit("\u0001"), topic)
    named = F.regexp_replace(question, F.concat(F.lit(r"(?is)^(.*?)\b"), head, F.lit(r"s?\b(.*)$")), F.lit("$1\u0001$2"))
    starts = F.startswith(norm, F.concat(F.lit("which "), head)) | F.startswith(norm, F.concat(F.lit("what "), head))
    return F.when(topic == "", "").when(norm.startswith("which ones"), ones).when(starts & (head != ""), F.replace(named, F.lit("\u0001"), topic)).otherwise("")


def interpreted(asked: DataFrame) -> DataFrame:
    """Adds ``intent``, ``resolved``, ``follow_up``, ``clarify``, ``use_local``, ``use_web``, ``use_model``, ``fresh``, ``response_mode``, ``preferred`` to questions with a state.

    The first rule that fits counts: an office without a country is asked back; then named news outlets, a bare name, an
    age, a superlative, an office of a country, a follow-up on the topic, a pronoun, a list, a definition; the rest is
    about local documents if it says so. Local files and the model are always allowed but where something must be asked
    back; the model not for local documents; the web only where a question asks for it or is about what changes.
    """
    q = F.trim(F.coalesce("question", F.lit("")))
    d = asked.withColumn("q_", q).withColumn("n_", normalized(F.col("q_")))
    d = d.withColumns({"said_": country_of(F.col("n_")), "role_": role_of(F.col("n_")), "news_": outlets_of(F.col("n_")), "bare_": bare_person(F.col("q_")), "list_": public_topic(F.col("n_")), "again_": topic_follow_up(F.col("q_"), F.col("n_"), F.col("topic"))})
    n, said, role, question = F.col("n_"), F.col("said_"), F.col("role_"), F.col("q_")
    country = F.when(said != "", said).otherwise(F.col("country"))
    own = F.when((F.col("holder") != "") & (F.col("role") != ""), F.col("holder")).when(F.col("person") != "", F.col("person")).otherwise(F.col("topic"))
    holder = F.when((F.col("role") == role) & (role != ""), F.col("holder")).otherwise("")
    d = d.withColumns({"country_": country, "own_": own, "holder_": holder})
    country, own, holder = F.col("country_"), F.col("own_"), F.col("holder_")
    pronoun, starts = n.rlike(PRONOUN), n.rlike(OFFICE_START)

    story = F.when((F.col("country") != "") & (F.col("role") != "") & (F.col("person") != ""), F.concat_ws(" ", F.when(F.col("country") == "United Kingdom", "UK").otherwise(F.col("country")), "role", "person"))
    government = F.concat(F.col("country"), F.lit(" government"))
    story = story.when(F.col("country") != "", government).when(F.col("topic") != "", F.col("topic")).otherwise(own)
    subject = F.when(only_sources(n) & (F.col("country") != ""), government).otherwise(story)
    of_news = F.when((subject != "") & (only_sources(n) | pronoun | n.rlike(r"\b(why|more|whether)\b")), F.concat(F.lit("What does "), F.array_join("news_", ", "), F.lit(" report about "), subject, F.lit("?"))).otherwise(question)

    becomes = F.trim(F.regexp_extract(question, r"(?is)^.*?\b(?:he|she|they|him|her)?\s*(?:will\s+)?become\s+(.+?)\??$", 1))
    of_age = F.when((F.col("role") != "") & (F.col("country") != "") & F.contains(n, F.lit("president")), F.concat(F.lit("How old was "), own, F.lit(" when he became "), F.col("role"), F.lit(" of "), phrase(F.col("country")), F.lit("?")))
    of_age = of_age.when(becomes != "", F.concat(F.lit("How old was "), own, F.lit(" when he became "), becomes, F.lit("?"))).otherwise(with_reference(question, own))

    who = F.when(holder != "", holder).otherwise(F.concat(F.lit("the "), role))
    of_office = F.when(starts, F.concat(F.lit("When did "), who, F.lit(" become "), role, F.lit(" of "), phrase(country), F.lit("?")))
    of_office = of_office.when((holder != "") & pronoun, with_reference(question, holder)).otherwise(F.concat(F.lit("Who is the "), role, F.lit(" of "), phrase(country), F.lit("?")))

    origin = n.rlike(ORIGIN) & (F.col("topic") != "")
    of_pronoun = F.when(starts & (F.col("role") != "") & (F.col("country") != ""), F.concat(F.lit("When did "), own, F.lit(" become "), F.col("role"), F.lit(" of "), phrase(F.col("country")), F.lit("?")))
    of_pronoun = of_pronoun.when(origin, F.concat(F.lit("Who introduced "), F.col("topic"), F.lit("?"))).otherwise(with_reference(question, own))

    yes, no = F.lit(True), F.lit(False)
    rules = [  # condition, intent, resolved, follow-up
        (n.rlike(ANY_COUNTRY) & (country == ""), F.lit("clarification"), question, reduce(lambda a, b: a | b, (F.col(c) != "" for c in ("country", "person", "topic", "holder")))),
        (F.size("news_") > 0, F.lit("news"), of_news, subject != ""),
        (F.col("bare_") != "", F.lit("person"), F.col("bare_"), no),
        (n.startswith("how old") & (own != ""), F.lit("current_or_public_fact"), of_age, yes),
        (n.rlike(SUPERLATIVE), F.lit("public_knowledge"), question, no),
        ((country != "") & (role != ""), F.lit("government"), of_office, said == ""),
        (F.col("again_") != "", F.lit("public_knowledge"), F.col("again_"), yes),
        (pronoun & (own != ""), F.when(origin, "scientific_definition").otherwise("follow_up"), of_pronoun, yes),
        (F.col("list_") != "", F.lit("public_knowledge"), question, no),
        (n.rlike(DEFINING) & ~n.rlike(NO_SCIENCE), F.lit("scientific_explanation"), question, no),
        (n.rlike(LOCAL), F.lit("local_document"), question, no),
    ]

    def chosen(at: int, otherwise: Column) -> Column:
        out = F.when(rules[0][0], rules[0][at])
        for r in rules[1:]:
            out = out.when(r[0], r[at])
        return out.otherwise(otherwise)

    d = d.withColumns({"intent": chosen(1, F.lit("general")), "resolved": chosen(2, question), "follow_up": chosen(3, no)})
    d = d.withColumn("m_", normalized(F.col("resolved")))
    intent, m = F.col("intent"), F.col("m_")
    asked_web, asks_back, local = m.rlike(WEB), intent == "clarification", intent == "local_document"
    changing = intent.isin(FRESH_INTENTS) | m.rlike(CURRENT) | ((role_of(m) != "") & ~m.rlike(OFFICE_START))
    modes = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RESPONSE_MODES.items() for x in kv]), intent), F.lit("answer"))
    preferred = F.when(intent == "news", F.array_join("news_", ", ")).otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREFERRED.items() for x in kv]), intent), F.lit("reliable web")))
    d = d.withColumns({"clarify": asks_back, "use_local": ~asks_back, "use_web": ~asks_back & (asked_web | (~local & changing)), "use_model": ~asks_back & ~local, "fresh": intent.isin(FRESH_INTENTS), "response_mode": modes, "preferred": preferred})
    return d.drop(*[c for c in d.columns if c.endswith("_")])


def source_queries(plans: DataFrame) -> DataFrame:
    """``qid``, ``sid``, ``query``: of news questions (``outlets``, ``subject``) each outlet's name and its site with the subject."""
    site = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    each = plans.select("qid", "sid", "subject", F.explode("outlets").alias("outlet"))
    return each.select("qid", "sid", F.explode(F.array(F.concat_ws(" ", "outlet", "subject"), F.concat(F.lit("site:"), F.element_at(site, F.col("outlet")), F.lit(" "), F.col("subject")))).alias("query")).distinct()


# What is put behind a web query to widen it, by its domain.
SUFFIXES = {
    "government": ("official", "government biography", "incumbent"), "news": ("Reuters", "AP News", "BBC"), "science": ("DOI", "arxiv", "university"), "person": ("profile", "biography", "official"),
    "laws": ("reliable source", "official", "reference"), "general": ("reliable source", "official", "reference"),
}


def widened(questions: DataFrame, domain: Column) -> DataFrame:
    """``qid``, ``query``: each question and its three widened forms, once each regardless of case and white space."""
    by = F.create_map(*[x for k, v in SUFFIXES.items() for x in (F.lit(k), T.lit_array(v))])
    q = questions.select("qid", T.squeezed(F.col("question")).alias("q"), domain.alias("domain")).where("q != ''")
    every = F.concat(F.array("q"), F.transform(F.element_at(by, F.col("domain")), lambda s: F.concat_ws(" ", "q", s)))
    each = q.select("qid", F.posexplode(every).alias("pos", "query"))
    return each.groupBy("qid", F.lower("query").alias("key")).agg(F.min_by("query", "pos").alias("query")).select("qid", "query")
