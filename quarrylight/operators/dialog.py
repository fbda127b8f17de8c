"""What a conversation is about, as a struct column: merging two states, taking over an interpretation, remembered roles.

A state holds text fields (empty: nothing known), ordered lists, and a map of roles and their holders.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.plans import interpret as I

TEXTS = ("topic", "country", "person", "document", "story", "role", "research_topic", "intent", "event", "summary", "last_question")
LISTS = ("entities", "topics", "documents", "sources", "dates")
SCHEMA = "struct<" + ", ".join([*(f"{t}:string" for t in TEXTS), *(f"{x}:array<string>" for x in LISTS), "roles:map<string,string>"]) + ">"

_roles: dict[str, str] = {}


def register_role(alias: str, role: str) -> None:
    """Another word for an office, which role_of() finds from then on before the built-in ones."""
    _roles[" ".join(alias.lower().split())] = role


def role_of(question: Column) -> Column:
    """The office that a question names, by registered and by built-in words."""
    return I._first(I.normalized(question), {**_roles, **I.ROLES})


def role_key(role: Column) -> Column:
    return T.squeezed(F.lower(role))


def in_order(values: Column) -> Column:
    """Squeezed values that are not empty, each once regardless of case, as it is written first."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.squeezed), lambda x: x != "")
    low = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def map_union(base: Column, override: Column) -> Column:
    """Both maps' entries, those of ``override`` where both have a key."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(base, empty), F.coalesce(override, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def _text(state: Column, name: str) -> Column:
    return F.coalesce(state[name], F.lit(""))


def merged(base: Column, override: Column) -> Column:
    """Field by field: texts of ``override`` where it has them, both lists in order with its own first, both role maps.

    Without a person the holder of the role in focus becomes the person. A null state counts as an empty one.
    """
    texts = {t: F.when(_text(override, t) != "", _text(override, t)).otherwise(_text(base, t)) for t in TEXTS}
    none = F.array().cast("array<string>")
    lists = {x: in_order(F.concat(F.coalesce(override[x], none), F.coalesce(base[x], none))) for x in LISTS}
    roles = map_union(base["roles"], override["roles"])
    holder = F.coalesce(F.try_element_at(roles, role_key(texts["role"])), F.lit(""))
    texts["person"] = F.when((texts["person"] == "") & (texts["role"] != ""), holder).otherwise(texts["person"])
    return F.struct(*(c.alias(t) for t, c in texts.items()), *(c.alias(x) for x, c in lists.items()), roles.alias("roles")).cast(SCHEMA)


def taken_over(state: Column, intent: Column, resolved: Column, found: Column, preferred: Column) -> Column:
    """The state after an interpretation: its intent and question, and what it found (structs of ``name``, ``type``, ``role``).

    A question for a person forgets country, roles and topics. Then each thing found counts in its order: a country is in
    focus and, without a topic, makes its government the topic; a person is in focus and holds the role said with it; a
    document is in focus; a topic is in focus and first of the topics. What it prefers comes before what the state preferred.
    """
    person, none, no_roles = intent == "person", F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    kind = lambda x: F.lower(F.coalesce(x["type"], F.lit("")))
    named = F.transform(F.filter(F.coalesce(found, F.array().cast("array<struct<name:string,type:string,role:string>>")), lambda x: T.squeezed(x["name"]) != ""), lambda x: F.struct(T.squeezed(x["name"]).alias("name"), kind(x).alias("type"), T.squeezed(x["role"]).alias("role")))
    last = lambda *kinds: F.coalesce(F.try_element_at(F.filter(named, lambda x: x["type"].isin(*kinds)), F.lit(-1))["name"], F.lit(""))
    start = F.struct(F.when(person, "").otherwise(_text(state, "topic")).alias("topic"), F.when(person, none).otherwise(F.coalesce(state["topics"], none)).alias("topics"))

    def step(at: Column, x: Column) -> Column:
        topic = F.when(x["type"].isin("topic", "research_topic"), x["name"]).when((x["type"] == "country") & (at["topic"] == ""), F.concat(x["name"], F.lit(" government"))).otherwise(at["topic"])
        moved = x["type"].isin("topic", "research_topic", "country")
        return F.struct(topic.alias("topic"), F.when(moved, F.concat(F.array(topic), at["topics"])).otherwise(at["topics"]).alias("topics"))

    about = F.aggregate(named, start.cast("struct<topic:string,topics:array<string>>"), step)
    held = F.filter(named, lambda x: (x["type"] == "person") & (x["role"] != ""))
    latest = F.filter(held, lambda x, i: ~F.exists(F.slice(held, i + 2, F.greatest(F.size(held), F.lit(1))), lambda y: role_key(y["role"]) == role_key(x["role"])))
    roles = map_union(F.when(person, no_roles).otherwise(state["roles"]), F.map_from_entries(F.transform(latest, lambda x: F.struct(role_key(x["role"]), x["name"]))))
    newer = lambda value, old: F.when(value != "", value).otherwise(old)
    own = {t: _text(state, t) for t in TEXTS}
    own |= {
        "topic": about["topic"], "country": newer(last("country"), F.when(person, "").otherwise(own["country"])), "person": newer(last("person"), own["person"]), "document": newer(last("document", "file"), own["document"]), "role": F.when(person, "").otherwise(own["role"]),
        "research_topic": newer(last("topic", "research_topic"), own["research_topic"]), "intent": newer(F.coalesce(intent, F.lit("")), own["intent"]), "last_question": newer(F.coalesce(resolved, F.lit("")), own["last_question"]),
    }
    lists = {x: F.coalesce(state[x], none) for x in LISTS}
    lists |= {"entities": in_order(F.concat(F.reverse(F.transform(named, lambda x: x["name"])), lists["entities"])), "topics": in_order(about["topics"]), "sources": in_order(F.concat(F.coalesce(preferred, none), lists["sources"]))}
    return F.struct(*(c.alias(t) for t, c in own.items()), *(c.alias(x) for x, c in lists.items()), roles.alias("roles")).cast(SCHEMA)


# Words that point back, and how a question that goes on begins.
POINTS_BACK = ("above", "earlier", "he", "her", "him", "his", "it", "its", "previous", "same", "she", "that", "their", "them", "these", "they", "this", "those")
GOES_ON = ("and ", "also ", "what about", "how about")
REPEATED = 0.92


def wants_rewriting(question: Column, before: Column, n_turns: Column, small_talk: Column, ratio: Column) -> Column:
    """Whether a question leans on what came before: it points back, or goes on in four words; not small talk, not without a user's turn before, and not if it repeats that turn (``ratio``: likeness of the two)."""
    q, words = I.normalized(question), F.split(I.normalized(question), " ")
    repeated = (I.normalized(before) != "") & (ratio >= REPEATED)
    short = (F.size(F.array_distinct(words)) <= 4) & (q.startswith(GOES_ON[0]) | q.startswith(GOES_ON[1]) | q.startswith(GOES_ON[2]) | q.startswith(GOES_ON[3]))
    return (n_turns >= 1) & (q != "") & ~small_talk & ~repeated & (F.exists(words, lambda w: w.isin(*POINTS_BACK)) | short)
