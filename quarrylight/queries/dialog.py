"""Conversation states: merged, and questions that lean on the turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.operators import dialog as D
from quarrylight.operators.match import sequence_ratio
from quarrylight.plans import interpret as I
from quarrylight.plans import questions as P
from quarrylight.queries.base import query, read

NAMES = ("country", "person", "role", "topic")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id``, ``day``, ``state``: a state for each user and day of the events, its fields by what happened then."""
    e = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    g = e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("kinds"), F.max("event_id").alias("last"))
    text = {"country": F.when(F.col("n") > 1, F.get("kinds", F.lit(0))).otherwise(""), "role": F.when(F.col("last") % 3 == 0, "President").otherwise(""), "topic": F.when(F.col("last") % 2 == 0, F.concat(F.lit("topic "), F.col("day").cast("string"))).otherwise("")}
    lists = {"entities": F.concat(F.transform("kinds", F.upper), F.array(F.lit(" "))), "topics": F.col("kinds")}
    roles = F.map_from_arrays(F.transform("kinds", lambda k: F.when(k == "click", "president").otherwise(k)), F.transform("kinds", lambda k: F.concat(k, F.lit(" of "), F.col("day").cast("string"))))
    none = F.array().cast("array<string>")
    state = F.struct(*(text.get(t, F.lit("")).alias(t) for t in D.TEXTS), *(lists.get(x, none).alias(x) for x in D.LISTS), roles.alias("roles")).cast(D.SCHEMA)
    return g.select("user_id", "day", state.alias("state"))


_G = """g AS (SELECT user_id, ts::DATE AS day, count(*) AS n, list_sort(list(DISTINCT event_type)) AS kinds, max(event_id) AS last FROM events GROUP BY 1, 2),
s AS (SELECT user_id, day, CASE WHEN n > 1 THEN kinds[1] ELSE '' END AS country, CASE WHEN last % 3 = 0 THEN 'President' ELSE '' END AS role, CASE WHEN last % 2 = 0 THEN 'topic ' || day ELSE '' END AS topic, kinds FROM g),
p AS (SELECT *, lag(day) OVER w AS d0, lag(country) OVER w AS c0, lag(role) OVER w AS r0, lag(topic) OVER w AS t0, coalesce(lag(kinds) OVER w, []) AS k0 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY day)),
m AS (SELECT user_id, day, d0, CASE WHEN country <> '' THEN country ELSE coalesce(c0, '') END AS country, CASE WHEN role <> '' THEN role ELSE coalesce(r0, '') END AS role, CASE WHEN topic <> '' THEN topic ELSE coalesce(t0, '') END AS topic, kinds, list_concat(kinds, list_filter(k0, lambda k: NOT list_contains(kinds, k))) AS names FROM p)"""


@query(
    "state_merge",
    f"""WITH {_G} SELECT user_id, day, country, role, topic, CASE WHEN role = '' THEN '' WHEN list_contains(kinds, 'click') THEN 'click of ' || day WHEN list_contains(names, 'click') THEN 'click of ' || d0 ELSE '' END AS person, array_to_string(list_transform(names, lambda k: upper(k)), ',') AS entities, array_to_string(names, ',') AS topics,
array_to_string(list_sort(list_transform(names, lambda k: CASE WHEN k = 'click' THEN 'president' ELSE k END || '=' || k || ' of ' || CASE WHEN list_contains(kinds, k) THEN day ELSE d0 END)), ';') AS roles FROM m""",
)
def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's state over that of the user's day before."""
    days = Window.partitionBy("user_id").orderBy("day")
    both = states(spark, sf_dir).withColumn("base", F.lag("state").over(days))
    m = both.select("user_id", "day", D.merged(F.col("base"), F.col("state")).alias("s"))
    roles = F.array_join(F.array_sort(F.transform(F.map_entries("s.roles"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return m.select("user_id", "day", "s.country", "s.role", "s.topic", "s.person", F.array_join("s.entities", ",").alias("entities"), F.array_join("s.topics", ",").alias("topics"), roles.alias("roles"))


@query("rewrite_wanted")
def rewrite_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's turn against the user's turn before it; the likeness of two strings has no SQL."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    u = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    u = u.withColumn("before", F.lag("text").over(turns)).withColumn("n", (F.row_number().over(turns) - 1).cast("int"))
    ratio = sequence_ratio(I.normalized(F.col("text")), I.normalized(F.col("before")))
    r = u.withColumn("ratio", ratio)
    return r.select("conv_id", "turn", D.wants_rewriting(F.col("text"), F.col("before"), F.col("n"), P.route(F.col("text")) != "rag", F.col("ratio")).alias("rewrite"))
