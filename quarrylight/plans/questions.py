"""Question understanding as Column expressions: type, facts, policy, domain, route, actions. One row per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.web import any_of

# Markers by what they tell of a question.
CURRENT = (
    "latest", "current", "recent", "today", "now", "this year", "2026", "2025", "price", "prices", "stock price", "share price", "exchange rate", "weather", "forecast", "schedule", "deadline", "population", "gdp", "inflation", "unemployment", "interest rate", "law", "directive", "regulation",
    "reach regulation", "eu reach", "ceo", "president", "prime minister", "secretary of state", "foreign secretary", "foreign minister", "defence minister", "defense minister", "minister of defence", "minister of defense", "finance minister", "interior minister", "king", "queen", "monarch",
    "news", "breaking", "resign", "resigned", "resignation", "updated", "newest", "most recent",
)
DYNAMIC = (
    "population", "gdp", "gross domestic product", "stock price", "share price", "market cap", "exchange rate", "weather", "forecast", "temperature", "schedule", "timetable", "deadline", "law", "regulation", "directive", "tax rate", "inflation", "unemployment", "interest rate", "price", "prices",
    "latest paper", "new paper", "newest paper", "recent paper", "current ceo", "ceo of", "president of", "prime minister of", "minister of", "head of", "director of",
)
LOCAL = ("local file", "local files", "uploaded", "indexed", "document", "documents", "doc", "docs", "knowledge base", "in my files", "in the files", "which file", "which document", "database", "data base")
RESEARCH = ("paper", "papers", "scientific", "study", "studies", "publication", "review", "research", "doi", "arxiv", "journal", "conference")
SCIENTIFIC = ("explain", "what is", "define", "bayes", "hmc", "spectral analysis", "regression", "model", "algorithm", "method", "factor", "theorem")
LOOKUP = ("who is", "who's", "ceo", "president", "prime minister", "secretary of state", "foreign secretary", "foreign minister", "minister", "founder", "owner", "chair", "director", "head of")
COMPANY = ("company", "ceo", "founder", "owner", "chair", "director")
NEWS = ("news", "breaking", "resigned", "resignation")
TENURE = ("became", "become", "took office", "assumed office", "when he", "when she", "when they")
DOMAINS = (
    ("government", ("government", "official", "minister", "president", "king", "queen", "grand duke")), ("laws", ("law", "regulation", "legal", "directive", "statute")), ("science", ("paper", "study", "research", "journal", "scientific", "doi", "arxiv")),
    ("news", ("news", "recent", "latest", "breaking", "resign")), ("person", ("who is", "biography", "profile", "researcher", "professor", "ceo", "founder")),
)
# Messages that need no retrieval.
ROUTES = {
    "greeting": ["afternoon", "evening", "good afternoon", "good evening", "good morning", "hello", "hello there", "hey", "hey there", "hi", "hi there", "hiya", "how are you", "how are you doing", "morning", "sup", "yo"],
    "conversation": ["alright", "awesome", "bye", "cool", "good night", "goodbye", "great", "nice", "no", "ok", "okay", "see you", "thank you", "thanks", "thx", "yes"],
    "identity": ["what are you", "who are you"],
    "capability": ["capabilities", "help", "how can you help", "what can you do", "what do you do"],
}
# Names of search modes, and which sources each allows: local, ai, web, ai as evidence ("stable" or "ready": only then).
MODE_ALIASES = {
    "auto": "auto", "auto recommended": "auto", "default": "auto", "local": "local_only", "local only": "local_only", "local files": "local_only", "local ai": "local_ai", "local model": "local_ai", "local ai web": "local_ai_web", "local model web": "local_ai_web", "hybrid": "local_ai_web",
    "hybrid local ai web": "local_ai_web", "web": "web_only", "web only": "web_only", "research": "research", "research mode": "research", "ai": "ai_only", "ai only": "ai_only", "model": "ai_only", "model only": "ai_only",
}
MODES = {
    "local_only": ("yes", "no", "no", "no"), "local_ai": ("yes", "yes", "no", "stable"), "local_ai_web": ("yes", "stable", "ready", "stable"), "web_only": ("no", "no", "ready", "no"),
    "research": ("yes", "stable", "ready", "stable"), "ai_only": ("no", "yes", "no", "stable"), "auto": ("yes", "stable", "ready", "stable"),
}
WORD = "(^|[^a-z0-9_])({})($|[^a-z0-9_])"
# Words that a name on its own does not hold.
NO_STATEMENT = ("about", "and", "are", "can", "does", "find", "for", "from", "how", "into", "latest", "local", "near", "news", "online", "please", "search", "show", "tell", "the", "there", "this", "what", "when", "where", "which", "who", "with")
NO_TERMS = ("is", "are", "was", "were", "current", "latest", "profile", "person", "company")
VERBS = "is|are|was|were|has|have|had|do|does|did|should|could|would|will"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
OUTER = f"[^{LETTER}0-9_]"
ASKS_FOR = r"(?i)^ *(who +is|who's|tell +me +about|search +for|find|profile +of) +"
# Patterns of what changes, what defines, what is fresh, what is calculated, what is online.
RATES = WORD.format("population|gdp|gross domestic product|stock price|share price|exchange rate|weather|forecast|inflation|unemployment|interest rate|price|prices")
DEFINE = WORD.format("what is|what are|define|explain|describe")
FRESH = WORD.format("current|latest|recent|today|now|newest|most recent|this year")
AGGREGATE = WORD.format("average|mean|sum|total|maximum|minimum|median|count|how many|trend|correlation|group by|percentage|increase|decrease|ratio|difference")
TABLE = WORD.format("csv|table|column|row|value|price|amount|data|dataset")
SUMMARY = WORD.format("summari[sz]e|summary|overview")
ONLINE = WORD.format("search the web|search web|web search|look up|online|internet|reuters|bbc|news")


def bare(question: Column) -> Column:
    return T.squeezed(F.regexp_replace(T.squeezed(question), "^[.,;:!?]+|[.,;:!?]+$", ""))


def entity_statement(question: Column) -> Column:
    """Two to five words of three letters at least, no verb and no question among them: something to be looked up."""
    text = bare(question)
    w = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z][A-Za-z'’-]+"), F.lit(0)), lambda x: F.lower(F.regexp_replace(x, "^['’]+|['’]+$", "")))
    verb = F.lower(text).rlike(f"(^|{OUTER})({VERBS})($|{OUTER})")
    return F.contains(text, F.lit(" ")) & ~F.contains(F.coalesce(question, F.lit("")), F.lit("?")) & ~verb & F.size(w).between(2, 5) & ~F.exists(w, lambda x: (F.length(x) <= 2) | x.isin(*NO_STATEMENT))


def entity_terms(question: Column) -> Column:
    """The words of what a question looks up, in lower case."""
    w = F.regexp_extract_all(F.regexp_replace(bare(question), ASKS_FOR, ""), F.lit(f"[{LETTER}][{LETTER}'’-]+"), F.lit(0))
    return F.filter(F.transform(w, lambda x: F.lower(F.regexp_replace(x, "^['’]+|['’]+$", ""))), lambda x: (F.length(x) > 1) & ~x.isin(*NO_STATEMENT, *NO_TERMS))


def classified(questions: DataFrame) -> DataFrame:
    """Adds ``primary``, ``fact_type``, ``policy``, the flags ``local``, ``current``, ``research``, ``lookup``, ``types`` (comma-joined), ``needs_web``, ``needs_dates``, ``model_may_decide`` and ``entity_terms`` (blank-joined, of lookups)."""
    q = F.lower(F.coalesce("question", F.lit("")))
    d = questions.withColumn("_q", q)
    c = F.col("_q")
    historical = c.startswith("how old") & any_of(c, TENURE)
    stable = ~c.rlike(RATES) & c.rlike(DEFINE) & ~c.rlike(FRESH)
    dynamic = any_of(c, DYNAMIC) & ~stable & ~historical
    d = d.withColumns({"local": any_of(c, LOCAL), "current": (any_of(c, CURRENT) | dynamic) & ~historical, "research": any_of(c, RESEARCH), "lookup": any_of(c, LOOKUP) | entity_statement(F.col("question"))})
    local, current, research, lookup = (F.col(x) for x in ("local", "current", "research", "lookup"))
    fact = F.when(local, "local_document").when(any_of(c, NEWS), "news").when(current, "dynamic").when(lookup & any_of(c, COMPANY), "company_lookup").when(lookup, "person_lookup").when(research | any_of(c, SCIENTIFIC), "scientific").otherwise("stable")
    d = d.withColumn("fact_type", fact).withColumn("primary", F.when(current, "time_sensitive").when(local, "local").when(research, "research").otherwise("general"))
    policy = F.when(F.col("fact_type") == "local_document", "local_only").when(F.col("fact_type").isin("dynamic", "news") | current, "web_only").otherwise("local_model_web")
    types = F.concat_ws(",", F.when(local, "local"), F.when(current, "time_sensitive"), F.when(research, "research"), F.when(~local & ~current & ~research, "general"))
    more = {"types": types, "needs_web": current | research | lookup, "needs_dates": current, "model_may_decide": ~current, "entity_terms": F.when(lookup, F.array_join(entity_terms(F.col("question")), " ")).otherwise("")}
    return d.withColumn("policy", policy).withColumns(more).drop("_q")


def domain(question: Column) -> Column:
    q, c = F.lower(T.squeezed(question)), None
    for name, markers in DOMAINS:
        c = F.when(any_of(q, markers), name) if c is None else c.when(any_of(q, markers), name)
    return c.otherwise("general")


def route(message: Column) -> Column:
    m = T.squeezed(F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), "[^a-z0-9' ]+", " "))
    c = F.when(m == "", "empty")
    for name, texts in ROUTES.items():
        c = c.when(m.isin(texts), name)
    return c.otherwise("rag")


def mode(name: Column) -> Column:
    m = T.squeezed(F.translate(F.lower(F.coalesce(name, F.lit(""))), "+-_", "   "))
    return F.coalesce(F.try_element_at(F.create_map([F.lit(x) for kv in MODE_ALIASES.items() for x in kv]), m), F.lit("auto"))


def policy_table(spark) -> DataFrame:
    """``mode``, ``web_enabled``, ``dynamic``, ``use_local``, ``use_ai``, ``use_web``, ``ai_as_evidence``."""
    rows = []
    for m, rule in MODES.items():
        for web in (False, True):
            for dyn in (False, True):
                rows.append((m, web, dyn, *({"yes": True, "no": False, "stable": not dyn, "ready": web}[r] for r in rule)))
    return spark.createDataFrame(rows, "mode string, web_enabled boolean, dynamic boolean, use_local boolean, use_ai boolean, use_web boolean, ai_as_evidence boolean")


def question_type(question: Column, fact_type: Column) -> Column:
    q = F.lower(question)
    formula = question.rlike(r"\\(alpha|beta|theta|lambda|sigma|sum|int|sqrt)|[α-ωΑ-Ω∑∫≈∝≤≥=]") | q.rlike(WORD.format("formula|equation|notation"))
    table = q.rlike(AGGREGATE) & q.rlike(TABLE)
    return (
        F.when(formula, "formula").when(table, "table_calculation").when((fact_type == "local_document") & q.rlike(SUMMARY), "local_document_summary").when(fact_type == "local_document", "local_document").when(fact_type == "news", "news")
        .when(fact_type == "dynamic", "current_dynamic_fact").when(q.rlike(WORD.format("what is|define|explain|meaning of")), "definition").when(fact_type == "scientific", "scientific_explanation").when(fact_type == "person_lookup", "person_lookup").when(fact_type == "company_lookup", "company_lookup")
        .when(q.rlike(WORD.format("compare|versus|vs|difference between")), "comparison").when(q.rlike(WORD.format("translate|translation")), "translation").when(q.rlike(WORD.format("calculate|compute|solve")), "calculation").when(q.rlike(WORD.format("recommend|suggest|best")), "recommendation")
        .when(q.rlike(WORD.format("why|reason|infer|deduce")), "reasoning").otherwise("general")
    )


def actions(questions: DataFrame, search_mode: Column, web_enabled: Column, web_ready: Column) -> DataFrame:
    """``qid``, ``question_type``, ``actions`` (comma-joined, in order): local search first, then what the type asks for, then model and web as the mode and the facts allow."""
    d = classified(questions).withColumn("question_type", question_type(F.col("question"), F.col("fact_type")))
    t, dynamic, local_only = F.col("question_type"), F.col("fact_type").isin("dynamic", "news"), F.col("policy") == "local_only"
    web_mode, only_local = search_mode == "web_only", search_mode == "local_only"
    wants_web = search_mode.isin("local_ai_web", "research") | F.lower("question").rlike(ONLINE) | dynamic | (web_enabled & ~local_only & (search_mode == "auto"))
    steps = F.array_compact(
        F.array(
            F.when(~web_mode, "search_local"), F.when(~web_mode & (t == "formula"), "retrieve_formula"), F.when(~web_mode & (t == "table_calculation"), "extract_table"), F.when(~web_mode & (t == "table_calculation"), "calculate"), F.when(~web_mode & (t == "local_document_summary"), "summarize_documents"),
            F.when(~web_mode & ~only_local & t.isin("person_lookup", "company_lookup", "scientific_explanation", "definition"), "build_graph_context"),
            F.when(~web_mode & ~only_local & ~local_only & ~dynamic & search_mode.isin("auto", "local_ai", "local_ai_web", "research"), "answer_model"), F.when(web_mode | (~only_local & wants_web & web_ready), "search_web"),
        )
    )
    return d.select("qid", "question_type", F.array_join(steps, ",").alias("actions"))


def short_entity(question: Column) -> Column:
    """One to five words, no question mark, capitalised like a name."""
    q = T.squeezed(question)
    w = F.split(q, " ")
    named = F.size(F.filter(w, lambda x: x.rlike("^[A-Z]")))
    asks = F.lower(F.get(w, F.lit(0))).isin(["what", "who", "when", "where", "which", "why", "how", "is", "are", "does", "do", "can", "tell", "show", "find", "search"])
    return (q != "") & ~q.endswith("?") & F.size(w).between(1, 5) & F.when(F.size(w) == 1, q.rlike("^[A-Z]")).otherwise(named >= F.greatest(F.lit(2), F.size(w) - 1)) & ~asks


def variants(question: Column) -> Column:
    """Search variants of a question: itself, its terms, its names before and after its terms, each once."""
    q = T.squeezed(question)
    terms = F.array_join(T.query_terms(q), " ")
    names = F.array_join(F.array_distinct(F.regexp_extract_all(q, F.lit("(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9'-]+( [A-Z][A-Za-z0-9'-]+)*"), F.lit(0))), " ")
    every = F.array(q, terms, F.when((names != "") & (terms != ""), F.concat_ws(" ", names, terms)), F.when((names != "") & (terms != ""), F.concat_ws(" ", terms, names)))
    return F.array_distinct(F.filter(F.array_compact(every), lambda x: x != ""))
