"""Caches, manifests, conversations, events and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import evaluate as V
from quarrylight.operators import state as S
from quarrylight.queries.base import query, read
from quarrylight.queries.retrieval import BM25, lexical, questions


@query("last_n_turns", "SELECT conv_id, turn, role, back::INT AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 8")
def last_n_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_turns(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "back")


@query("latest_user_turn", "SELECT conv_id, turn, text, last - turn AS after FROM (SELECT conv_id, max(turn) FILTER (role = 'user') AS turn, max(turn) AS last FROM conversations GROUP BY conv_id) JOIN conversations USING (conv_id, turn)")
def latest_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_user_turn(read(spark, sf_dir, "conversations"))


@query("chat_markdown", "SELECT conv_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def chat_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.markdown(read(spark, sf_dir, "conversations"))


@query("cache_ttl_hits", "SELECT event_type, count(*) AS n, count(*) FILTER (hit) AS hits FROM (SELECT event_type, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 300000000::BIGINT * 60, false) AS hit FROM events) GROUP BY 1")
def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a user's request within five hours."""
    h = S.ttl_hits(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 300 * 60)
    return h.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


@query("ttl_selection", "SELECT event_id, CASE WHEN event_type = 'click' THEN 3600 WHEN event_type = 'view' THEN 0 ELSE 604800 END AS ttl, CASE WHEN event_type = 'click' THEN value <= 3600 ELSE true END AND user_id % 3 <> 0 AS fresh FROM events")
def ttl_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    ttl = S.ttl_for(t == "click", F.lit(True), t == "view")
    return read(spark, sf_dir, "events").select("event_id", ttl.alias("ttl"), S.fresh(F.col("value"), ttl, F.when(F.col("user_id") % 3 == 0, "old").otherwise("now"), F.lit("now")).alias("fresh"))


@query("manifest_diff", "WITH b AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0), n AS (SELECT doc_id AS path, CASE WHEN doc_id % 10 = 1 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 2) SELECT path, CASE WHEN b.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'removed' WHEN b.h <> n.h THEN 'changed' ELSE 'unchanged' END AS status FROM b FULL JOIN n USING (path)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = read(spark, sf_dir, "documents"), F.col("doc_id") % 10
    h = lambda x: F.sha2(x, 256)
    before = d.where(m != 0).select(F.col("doc_id").alias("path"), h(F.col("text")).alias("hash"))
    now = d.where(m != 2).select(F.col("doc_id").alias("path"), h(F.when(m == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return S.manifest_diff(before, now)


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return S.upsert_latest(e, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("document_fingerprint", "SELECT source, count(*) AS n, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h")).groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "h"))).alias("x"))
    return g.select("source", "n", F.sha2(F.array_join(F.transform("x", lambda x: x["h"]), ","), 256).alias("fingerprint"))


@query("history_partition", "SELECT CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' ELSE 'Earlier' END AS bucket, count(*) AS n FROM (SELECT DATE '2024-01-20' - ts::DATE AS d FROM events) GROUP BY 1")
def history_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(S.history_bucket(F.col("ts"), F.lit("2024-01-20").cast("date")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("event_tumbling", "SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "total")


@query("event_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = read(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "users")


@query("event_sessions", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sid")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sessions(read(spark, sf_dir, "events"), "user_id", "ts", 30)
    f = lambda c: F.date_format(F.date_trunc("second", c), "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", f("session_start"), f("session_end"), "n")


@query("event_dedupe", "SELECT user_id, event_type, strftime(d, '%Y-%m-%d') AS day, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, date_trunc('day', ts) AS d FROM events) GROUP BY user_id, event_type, d")
def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query(
    "hit_at_k",
    BM25
    + """, gold AS (SELECT item_id AS qid, CASE WHEN item_id % 7 = 6 THEN NULL ELSE (SELECT min(doc_id) FROM documents d WHERE contains(d.text, b.text)) END AS id FROM benchmark b),
first AS (SELECT qid, min(rank) AS first FROM lex JOIN gold USING (qid) WHERE doc_id = id AND rank <= 10 AND score >= 0.05 GROUP BY qid), found AS (SELECT DISTINCT qid, true AS hit FROM lex WHERE rank <= 10 AND score >= 0.05),
qq AS (SELECT gold.qid, id IS NOT NULL AS should, first, hit FROM gold LEFT JOIN first USING (qid) LEFT JOIN found USING (qid))
SELECT count(*) AS n, round(coalesce(avg(CASE WHEN should THEN CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS hit_at_1, round(coalesce(avg(CASE WHEN should THEN CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS hit_at_3,
round(coalesce(avg(CASE WHEN should THEN CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS hit_at_5, round(coalesce(avg(CASE WHEN NOT should THEN CASE WHEN hit IS NULL THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS not_found_accuracy FROM qq""",
)
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold: the first document that holds the passage; every seventh question is one that nothing should answer."""
    docs, q = read(spark, sf_dir, "documents"), questions(spark, sf_dir)
    ranked = lexical(spark, sf_dir, q, 10).withColumnRenamed("doc_id", "id")
    run = lambda w, i: F.xxhash64(*[F.get(w, i + j) for j in range(5)])
    words = F.split("text", "[ \n]+")
    places = docs.select("doc_id", "text", words.alias("w")).where(F.size("w") >= 5).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: run(F.col("w"), i)))).alias("h"))
    asked = q.select("qid", "question", run(F.split("question", "[ \n]+"), F.lit(1)).alias("h"))
    near = places.join(asked, "h").join(docs.select("doc_id", "text"), "doc_id")
    holds = near.where(F.contains("text", "question")).groupBy("qid").agg(F.min("doc_id").alias("id"))
    gold = q.select("qid").join(holds, "qid", "left").select("qid", F.when(F.col("qid") % 7 != 6, F.col("id")).alias("id"))
    return V.hit_at(ranked, gold)


@query(
    "benchmark_winner",
    """WITH r AS (SELECT user_id, event_type AS mode, CASE WHEN avg(value) > 60 THEN 'high' WHEN avg(value) > 40 THEN 'medium' ELSE 'low' END AS confidence, count(*) % 4 AS n_sources, NULL::DOUBLE AS faithfulness, count(*) / 10.0::DOUBLE AS latency FROM events GROUP BY ALL),
s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, n_sources DESC, latency, mode DESC) AS k FROM r WHERE n_sources > 0)
SELECT user_id, coalesce(max(s.mode), '') AS winner FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT * FROM s WHERE k = 1) s USING (user_id) GROUP BY user_id""",
)
def benchmark_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average is rounded, so that the order in which doubles are summed decides nothing at 40 and 60. Events without a user have no winner."""
    mean = F.round(F.avg("value"), 9)
    g = read(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("mode")).agg(F.when(mean > 60, "high").when(mean > 40, "medium").otherwise("low").alias("confidence"), (F.count("*") % 4).alias("n_sources"), F.lit(None).cast("double").alias("faithfulness"), (F.count("*") / 10.0).alias("latency"))
    return V.winner(g, "user_id").withColumn("winner", F.when(F.col("user_id").isNull(), "").otherwise(F.col("winner")))


@query("conversation_state")
def conversation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered fold, which SQL has not: the tests hold it against a loop."""
    from quarrylight.session import ship
    from quarrylight.streaming.conversation import state

    ship(spark)
    return state(read(spark, sf_dir, "conversations"))


@query("semantic_cache_topk", "SELECT user_id || '|' || event_type AS key, max(event_id)::BIGINT AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS r FROM events) WHERE r = 1 GROUP BY 1 ORDER BY max(ts) DESC, key LIMIT 250")
def semantic_cache_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache keeps the newest answer of each key and 250 keys in all; the limit is the feature."""
    from quarrylight.sources.sinks import cached_answers

    e = read(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), "ts", F.col("event_id").alias("last"))
    return cached_answers(e).select("key", "last")
