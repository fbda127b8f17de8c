"""Claims against sources, citations against labels, confidence against evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.functions.scoring import downgraded, support_score, verdict
from quarrylight.operators.metadata import words_apart
from quarrylight.operators.overlap import Found, best_partners
from quarrylight.session import ship
from quarrylight.shared import saved

# How an entity of a claim looks, and words that are none.
ENTITY = r"\b[A-Z][A-Za-z0-9'&.-]*(?: [A-Z][A-Za-z0-9'&.-]*){0,4}\b"
NO_ENTITY = ("i", "the", "this", "it")


#: What a cited source's score is raised by, and terms of claims that are sent to all tasks at most.
CITED, MOST_TERMS = 0.18, 500_000


def _sent(df: DataFrame) -> DataFrame:
    """Terms of claims (each row one) to be joined with sources: to all tasks while they are few, so that no source is shuffled and a common word lands nowhere."""
    return F.broadcast(df) if df.count() <= MOST_TERMS else df


def support_slope(nc: Column, ns: Column) -> Column:
    """What each shared term adds to the support of a claim of ``nc`` terms by a source of ``ns``: 0.78 by coverage, 0.22 by density."""
    return 0.78 / nc + 0.22 / F.greatest(F.lit(1), F.least(ns, nc * 4))


def support(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``claim_id``, ``label``, ``score`` of claims (``claim_id``, ``claim``, ``cited`` labels) and sources (``label``, ``text``) that share a term, every pair of them; best_support() has the best without the others.

    An equi-join on terms, so no pair is made that shares nothing; the score needs only the three counts. A cited source
    gets 0.18 more.
    """
    c = claims.select("claim_id", "cited", T.claim_terms(F.col("claim")).alias("t")).select("claim_id", "cited", F.size("t").alias("nc"), F.explode("t").alias("term"))
    s = sources.select("label", T.claim_terms(F.col("text")).alias("t")).repartition("label").select("label", F.size("t").alias("ns"), F.explode("t").alias("term"))
    both = s.join(_sent(saved(c, "claim_terms")), "term").groupBy("label", "claim_id", "cited", "nc", "ns").agg(F.count("*").alias("both"))
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("both") * support_slope(F.col("nc"), F.col("ns"))) + F.when(F.array_contains("cited", F.col("label")), CITED).otherwise(0.0))
    return both.select("claim_id", "label", F.round(score, 6).alias("score"))


def best_support(claims: DataFrame, sources: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best rows of support() of each claim, found without the pairs that share too few terms. Claim ids and labels are distinct."""
    return support_search(claims, sources, k).pairs.select(F.col("lid").alias("claim_id"), F.col("rid").alias("label"), "score")


def support_search(claims: DataFrame, sources: DataFrame, k: int = 3) -> Found:
    c = claims.select(F.col("claim_id").alias("lid"), T.claim_terms(F.col("claim")).alias("terms"))
    s = sources.select(F.col("label").alias("rid"), T.claim_terms(F.col("text")).alias("terms"))
    return best_partners(c, s, k, support_slope, claims.select(F.col("claim_id").alias("lid"), F.explode("cited").alias("rid")), CITED)


def verified(claims: DataFrame, scores: DataFrame, ungrounded: Column | None = None) -> DataFrame:
    """``claim_id``, ``best``, ``supporting`` (three labels at most, comma-joined), ``verdict``: every claim has a row."""
    w = Window.partitionBy("claim_id").orderBy(F.desc("score"), "label")
    best = scores.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("claim_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.when(F.col("score") >= 0.18, F.struct("r", "label")))).alias("ids"))
    out = claims.join(best, "claim_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0))).withColumn("ids", F.coalesce("ids", F.array().cast("array<struct<r:int,label:string>>")))
    v = verdict(F.col("best"), F.size("ids") > 0, F.size("cited") > 0)
    v = v if ungrounded is None else F.when(ungrounded, downgraded(v)).otherwise(v)
    return out.select("claim_id", "best", F.array_join(F.transform("ids", lambda x: x["label"]), ",").alias("supporting"), v.alias("verdict"))


# Words that don't count when a claim is compared with a sentence.
COMPARISON_STOPWORDS = ["a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with"]


def comparison_terms(text: Column) -> Column:
    raw = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9'-]*"), F.lit(0))
    return F.array_distinct(F.filter(raw, lambda t: ~t.isin(*COMPARISON_STOPWORDS) & (F.length(t) > 1)))


# Words that negate.
NEGATIONS = ("not", "never", "no", "without", "isn't", "aren't", "wasn't", "weren't", "cannot", "can't")


def negated(text: Column) -> Column:
    return F.lower(text).rlike(f"(^|[^a-z0-9_])({'|'.join(NEGATIONS)})($|[^a-z0-9_])")


def support_label(claim_negates: Column, snippet_negates: Column, empty: Column, confidence: Column) -> Column:
    return F.when(empty | (confidence < 0.28), "not_found").when((claim_negates != snippet_negates) & (confidence >= 0.42), "contradicts").when(confidence >= 0.38, "supports").otherwise("unclear")


#: Words of sources that are met with claims at once.
STEP_WORDS = 50_000


def _best_in_batches(batches, words: pa.Array, first: np.ndarray, of: np.ndarray, claims: int):
    """Of each source (``label``, ``t``: terms by sentence, other columns are kept) and claim that share a term: ``best``, structs of ``c``, ``pos``, ``n``. The claims of ``words[w]`` are ``of[first[w]:first[w + 1]]``."""
    kind = pa.struct([("c", pa.int32()), ("pos", pa.int32()), ("n", pa.int32())])
    for b in batches:
        t = b.column("t")
        size = np.cumsum([0] + [sum(map(len, x)) for x in t.to_pylist()])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + STEP_WORDS, "right")) - 1)
            part = b.slice(at, to - at)
            at, sentences = to, part.column("t").flatten()
            doc = pc.list_parent_indices(part.column("t")).to_numpy()
            word = pc.index_in(sentences.flatten(), value_set=words).fill_null(-1).to_numpy()
            known = word >= 0
            sentence, word = pc.list_parent_indices(sentences).to_numpy()[known].astype(np.int64), word[known]
            n = first[word + 1] - first[word]
            claim = of[np.repeat(first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            key, n = np.unique(np.repeat(sentence, n) * claims + claim, return_counts=True)
            sentence, claim = key // claims, key % claims
            d, pos = doc[sentence], sentence - np.searchsorted(doc, doc[sentence])
            order = np.lexsort((pos, -n, claim, d))
            order = order[np.append(True, (np.diff(d[order]) != 0) | (np.diff(claim[order]) != 0))[: len(order)]]
            found = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int32)) for x in (claim, pos, n)], fields=list(kind))
            ends = pa.array(np.searchsorted(d[order], np.arange(part.num_rows + 1)).astype(np.int32))
            keep = [c for c in part.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.ListArray.from_arrays(ends, found)], names=[*keep, "best"])


def best_sentences(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``claim_id``, ``label``, ``overlap``, and ``low`` and ``neg`` (lower-case and whether it negates) of the sentence: of each source the sentence that covers most of the claim's terms, the first on ties.

    While the claims' terms are few they are sent to where the sources are, a source is met with all of them in its row and
    nothing is shuffled. With more, or where ids repeat, sentences and terms are joined.
    """
    c = saved(claims.select("claim_id", comparison_terms(F.col("claim")).alias("t")), "claims")
    count, ids, terms = c.agg(F.count("*"), F.countDistinct("claim_id"), F.coalesce(F.sum(F.size("t")), F.lit(0))).collect()[0]
    labels = sources.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if count != ids or terms > MOST_TERMS or not labels.isEmpty():
        return _best_by_join(claims, sources)
    rows = c.collect()
    words = sorted({x for r in rows for x in r.t})
    number = {x: i for i, x in enumerate(words)}
    pairs = np.array(sorted((number[x], i) for i, r in enumerate(rows) for x in r.t), np.int64).reshape(-1, 2)
    first, of = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1]
    ship(claims.sparkSession)
    s = sources.where("label IS NOT NULL").select("label", T.sentences(T.squeezed(F.col("text"))).alias("s"))
    s = s.select("label", F.transform("s", lambda x: F.lower(x)).alias("low"), F.transform("s", lambda x: negated(x)).alias("neg"), F.transform("s", lambda x: comparison_terms(x)).alias("t"))
    met = s.mapInArrow(lambda it: _best_in_batches(it, pa.array(words, pa.string()), first, of, len(rows)), "label string, low array<string>, neg array<boolean>, best array<struct<c:int,pos:int,n:int>>")
    best = met.select("label", F.explode(F.transform("best", lambda x: F.struct(x["c"].alias("c"), x["n"].alias("n"), F.get("low", x["pos"]).alias("low"), F.get("neg", x["pos"]).alias("neg")))).alias("x")).select("label", "x.*")
    own = claims.sparkSession.createDataFrame([(i, r.claim_id, len(r.t)) for i, r in enumerate(rows)], f"c int, claim_id {claims.schema['claim_id'].dataType.simpleString()}, nc int")
    return best.join(F.broadcast(own), "c").select("claim_id", "label", F.round(F.col("n") / F.col("nc"), 6).alias("overlap"), "low", "neg")


def _best_by_join(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """best_sentences() on terms, where the sentences are: a source's sentences stay in one task, with the claims' terms sent there."""
    c = claims.select("claim_id", comparison_terms(F.col("claim")).alias("t")).select("claim_id", F.size("t").alias("nc"), F.explode("t").alias("term"))
    s = sources.select("label", F.posexplode(T.sentences(T.squeezed(F.col("text")))).alias("pos", "sentence"))
    s = saved(s.select("label", "pos", F.lower("sentence").alias("low"), negated(F.col("sentence")).alias("neg"), comparison_terms(F.col("sentence")).alias("t")), "sentences").repartition("label")
    hit = s.select("label", "pos", F.explode("t").alias("term")).join(_sent(saved(c, "claim_terms")), "term").groupBy("label", "claim_id", "pos", "nc").agg(F.count("*").alias("n"))
    best = hit.groupBy("label", "claim_id", "nc").agg(F.max(F.struct("n", (-F.col("pos")).alias("pos"))).alias("x")).select("claim_id", "label", (-F.col("x.pos")).alias("pos"), F.round(F.col("x.n") / F.col("nc"), 6).alias("overlap"))
    return best.join(s.select("label", "pos", "low", "neg"), ["label", "pos"]).select("claim_id", "label", "overlap", "low", "neg")


def claim_entities(claim: Column) -> Column:
    """Distinct spans of up to five capitalised words, but for those that only begin a sentence."""
    return F.array_distinct(F.filter(F.regexp_extract_all(words_apart(T.squeezed(claim)), F.lit(ENTITY), F.lit(0)), lambda x: ~F.lower(x).isin(*NO_ENTITY)))


def entity_score(entities: Column, snippet: Column) -> Column:
    """The share of a claim's entities that a snippet holds; 0 without any. Both in lower case."""
    held = F.filter(entities, lambda e: F.contains(snippet, e))
    return F.when(F.size(entities) > 0, F.size(held) / F.size(entities)).otherwise(0.0)


def _surest_of_task(batches, k: int = 3):
    """The ``k`` surest rows of each claim and stream in a task, ties by label: all that can still be among the surest of all tasks."""
    best = None
    for b in batches:
        rows = b.to_pandas()
        rows = rows if best is None else pd.concat([best, rows])
        named = rows.assign(named=rows["label"].notna())  # as Spark orders: null labels first
        best = named.sort_values(["confidence", "named", "label"], ascending=[False, True, True]).groupby(["claim_id", "stream"]).head(k).drop(columns="named")
        schema = b.schema
    if best is not None:
        yield pa.RecordBatch.from_pandas(best, schema, preserve_index=False)


def decisions(supports: DataFrame, facts: DataFrame) -> DataFrame:
    """``claim_id``, ``winner``, ``conflict``: which stream decides on each claim of ``facts`` (``claim_id``, ``fact_type``, ``policy``).

    Of ``supports`` (``claim_id``, ``stream``: local, web or ai, ``label``, ``support``, ``confidence``) the three surest of
    each stream count, ties by label; each task keeps its own three first, so that few rows are sorted and shuffled. The web decides on what changes, local files where only they may; both agree as
    hybrid; then whatever supports the claim, the model last. A conflict is support and contradiction among what counts.
    A claim without any support is unsupported.
    """
    surest = Window.partitionBy("claim_id", "stream").orderBy(F.desc("confidence"), "label")
    told = supports.where("support != 'not_found' AND claim_id IS NOT NULL").select("claim_id", "stream", "label", "support", "confidence")
    part = told.mapInArrow(_surest_of_task, told.schema)
    top = part.withColumn("r", F.row_number().over(surest)).where("r <= 3")
    has = lambda s, what: F.coalesce(F.bool_or((F.col("stream") == s) & (F.col("support") == what)), F.lit(False))
    told = top.groupBy("claim_id").agg(*(has(s, "supports").alias(s) for s in ("local", "web", "ai")), (F.bool_or(F.col("support") == "supports") & F.bool_or(F.col("support") == "contradicts")).alias("conflict"))
    d = facts.join(told, "claim_id", "left").fillna(False, ["local", "web", "ai", "conflict"])
    winner = F.when(F.col("fact_type").isin("dynamic", "news") & F.col("web"), "web").when((F.col("policy") == "local_only") & F.col("local"), "local").when(F.col("local") & F.col("web"), "hybrid").when(F.col("local"), "local").when(F.col("web"), "web").when(F.col("ai"), "ai").otherwise("unsupported")
    return d.select("claim_id", winner.alias("winner"), "conflict")


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``answer_id``, ``label``, ``known`` of every label that an answer cites."""
    cited = answers.select("answer_id", F.explode(T.labels_in(F.col("answer"))).alias("label"))
    return cited.join(sources.select("label", F.lit(True).alias("k")).distinct(), "label", "left").select("answer_id", "label", F.coalesce("k", F.lit(False)).alias("known"))


def answer_check(claim: Column, question: Column, evidence: Column, cited: Column) -> Column:
    """verified, partial or unsupported by the share of an answer's own terms (those of the question aside) that the evidence holds."""
    own = F.array_except(T.claim_terms(claim), T.claim_terms(question))
    share = F.size(F.array_intersect(own, T.claim_terms(evidence))) / F.greatest(F.lit(1), F.size(own))
    return F.when((share >= 0.18) & cited, "verified").when(share >= 0.09, "partial").otherwise("unsupported")


def capped(confidence: Column, unsupported: Column, supported: Column, conflict: Column) -> Column:
    """Three unsupported claims without a supported one: low; a conflict or an unsupported claim: medium at most."""
    return F.when((unsupported >= 3) & (supported == 0), "low").when((conflict | (unsupported > 0)) & (confidence == "high"), "medium").otherwise(confidence)


__all__ = ["answer_check", "best_sentences", "best_support", "capped", "citations", "claim_entities", "decisions", "entity_score", "comparison_terms", "negated", "support", "support_label", "support_score", "verified"]
