"""A stored lexical index with bounds per block of postings: top-k answers read only the blocks that can hold them.

A posting's *impact* is the part of BM25 that depends on the document alone, between 0 and 1. A block holds the postings of
one term and one level of impact in one segment of the documents; the level's largest impact is its bound. A question takes
its terms' levels from the highest down, those first that lower the bound of what is left by most a posting, until a document
in none of them stays under the k-th best score known so far. What was seen of a document gives its own bound, and only
documents that can still be among the k best are scored in full: what was seen of the k-th best of them is a second, higher
score to reach.

A change is a further generation: its documents are indexed on their own, the rows that it replaces or deletes are listed as
dead, and their counts are taken off the statistics, so that scores are those of an index made anew. compact() makes it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators.retrieval import B, K1, MOST_TERMS, question_terms
from quarrylight.session import ship
from quarrylight.shared import new_path, saved

#: Levels of impact, bits of a key that number the documents of a segment.
LEVELS, SEGMENT_BITS = 16, 12
#: Postings of a question that are read to learn a first k-th best score, and documents scored for it, as a multiple of k.
SEED_POSTINGS, SEED_DOCS = 4000, 3
#: Blocks are read until what is left is worth less than this share of the k-th best score: less leaves fewer documents to score in full, more reads fewer blocks.
SHARE = 0.3
#: Scores are ranked by five decimals, so a bound within one of them may still matter.
SLACK = 2e-5
#: Of the packed sums: cells of questions times documents that are held at once, pairs of a posting and a question that are added at once, pairs of question and document, ids or dead rows that are sent to the documents.
CELLS, PAIRS, MOST_PAIRS = 1 << 21, 1 << 20, 2_000_000


@dataclass
class Found:
    """``hits``: ``qid``, ``rank``, ``doc_id``, ``bm25``. ``work``: of each question its terms' ``postings``, those ``read``, the ``candidates`` that they gave and those ``scored`` in full."""

    hits: DataFrame
    work: DataFrame


class PostingsIndex:
    """The index at ``path``; any number of questions and sessions can use it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")

    def _gen(self) -> int:
        """Generations so far. A generation counts once its statistics are there; they are written last."""
        return self._read("stats").agg(F.coalesce(F.max("gen") + 1, F.lit(0))).collect()[0][0]

    def totals(self):
        """One row: ``n_docs``, ``n_tokens``, ``base`` (the mean length that levels were made for), ``dead``, of what is live."""
        s = self._read("stats")
        return s.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("base").alias("base"), F.sum("n_dead").alias("dead"), F.max("gen").alias("last")).collect()[0]

    # Writing

    def _add(self, counted: DataFrame | None, gen: int, base: float | None, dead: DataFrame | None = None) -> PostingsIndex:
        """Writes a generation. ``counted``: ``doc_id``, ``terms``, ``dl``; ``dead``: rows of the forward table that are replaced. Without ``base`` the levels are made for the mean length here."""
        n_docs, n_tokens, n_dead = 0, 0, 0
        if counted is not None:
            rows = counted.withColumn("key", F.monotonically_increasing_id()).withColumn("segment", F.hash(F.shiftright("key", SEGMENT_BITS)))  # neighbours in a task's rows
            rows.select("doc_id", "key", "dl", "terms", "segment").write.parquet(f"{self.path}/forward/gen={gen}")
            own = self._read("forward").where(F.col("gen") == gen)
            n_docs, n_tokens = own.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).collect()[0]
            base = base or (max(1.0, n_tokens / n_docs) if n_docs else 1.0)
            ship(self.spark)
            blocks = own.select("segment", "key", "dl", "terms").mapInArrow(_grouped(base), SCHEMAS["blocks"].rpartition(",")[0])  # where the documents are: nothing is shuffled
            blocks.write.parquet(f"{self.path}/blocks/gen={gen}")
        if dead is not None:
            dead.select("key", F.col("gen").alias("of")).write.parquet(f"{self.path}/dead/gen={gen}")
            dead.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.path}/gone/gen={gen}")
            n_dead, off = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).collect()[0]
            n_docs, n_tokens = n_docs - n_dead, n_tokens - off
        self.spark.createDataFrame([(n_docs, n_tokens, base, n_dead)], "n_docs long, n_tokens long, base double, n_dead long").write.parquet(f"{self.path}/stats/gen={gen}")
        return self

    def live(self) -> DataFrame:
        """The forward table's rows that are neither replaced nor deleted: ``doc_id``, ``key``, ``dl``, ``terms``, ``gen``, ``segment``."""
        return self._alive(self._read("forward"), self.totals().dead)

    def _alive(self, rows: DataFrame, dead: int) -> DataFrame:
        if not dead:
            return rows
        gone = self._read("dead").select("key", F.col("of").alias("gen"))
        return rows.join(F.broadcast(gone) if dead <= MOST_PAIRS else gone, ["gen", "key"], "left_anti")

    def _named(self, ids: DataFrame) -> DataFrame:
        """The live rows with one of the ids, which go to the forward table if they are few: its terms are not shuffled."""
        ids = saved(ids.where("doc_id IS NOT NULL").distinct(), "ids")
        return self.live().join(F.broadcast(ids) if ids.count() <= MOST_PAIRS else ids, "doc_id", "left_semi")

    def upsert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PostingsIndex:
        """``docs`` in place of the rows with their ids, which need not be there. Rows with a null id are added."""
        t, counted = self.totals(), saved(_counted(docs, id_col, text_col), "counted")
        old = saved(self._named(counted.select("doc_id")), "replaced")
        return self._add(counted, t["last"] + 1, t.base, old)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> PostingsIndex:
        """Without the rows whose id is among ``ids``."""
        t = self.totals()
        old = saved(self._named(ids.select(F.col(id_col).cast("string").alias("doc_id"))), "deleted")
        return self._add(None, t["last"] + 1, t.base, old)

    def compact(self, path: str | None = None) -> PostingsIndex:
        """An index of the live rows alone, of one generation, at another path."""
        return _build(self.spark, self.live().select("doc_id", "terms", "dl"), path)

    # Reading

    def topk(self, questions: DataFrame, k: int) -> Found:
        """The ``k`` best documents for each question (``qid``, ``question``) by BM25, ties within five decimals to the smaller id; every row that was indexed is a document. A question without a term of the index has no hits.

        Where the questions' terms are too many to be sent to all tasks, the same joins shuffle them.
        """
        t = self.totals()
        mean = max(1.0, (t.n_tokens or 0) / (t.n_docs or 1))
        wider = max(1.0, mean / (t.base or 1.0))  # an impact grows by no more than the mean length has
        q = question_terms(questions.select("qid", "question"))
        asked = q.select("term").distinct()
        levels = self._read("blocks").select("term", "level", "n", "top").join(asked, "term", "left_semi").groupBy("term", "level").agg(F.sum("n").alias("n"), F.max("top").alias("top"))  # no posting is read for this
        gone = self._read("gone").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("off"))
        levels = saved(levels.select("term", "level", "n", F.least(F.lit(1.0), F.col("top") * wider).alias("top")), "levels")  # at most LEVELS rows a term
        df = levels.groupBy("term").agg(F.sum("n").alias("df")).join(gone, "term", "left").withColumn("df", F.col("df") - F.coalesce("off", F.lit(0)))
        idf = F.log(1 + (F.lit(t.n_docs or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = saved(q.join(df.where("df > 0"), "term").select("qid", "term", (F.col("qtf") * idf * (K1 + 1)).alias("w")), "weights")
        few = weights.count() <= MOST_TERMS
        plan = saved(_plan(levels.join(weights, "term")), "plan")
        packed = few and 0 < plan.count() <= MOST_TERMS  # then tasks hold them as arrays, and add up the postings of a segment or of documents at once

        def seen_of(chosen: DataFrame, limits: DataFrame | None = None, most: int | None = None) -> DataFrame:
            return self._alive(self._seen_packed(chosen, mean, limits, most) if packed else self._seen(chosen, mean, few), t.dead)

        first = seen_of(plan.where(F.col("before_n") < SEED_POSTINGS), most=SEED_DOCS * k)
        most = Window.partitionBy("qid").orderBy(F.desc("seen"), "gen", "key")
        best = first.withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= SEED_DOCS * k)
        best = saved(best.select("qid", "gen", "segment", "key"), "first_best")
        scored_of = self._scored_packed if packed else self._scored
        exact = scored_of(best, weights, mean, few)
        kth = exact.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25")))).where(F.col("nth") == k).select("qid", F.col("bm25").alias("floor"))
        kth = saved(kth, "floors")  # a row a question

        known = plan.join(F.broadcast(kth) if few else kth, "qid", "left").withColumn("is_read", F.coalesce(F.col("before") >= F.col("floor") * SHARE, F.lit(True)))
        left = known.groupBy("qid").agg(F.sum(F.when(~F.col("is_read"), F.col("gain")).otherwise(0.0)).alias("left"), F.max("floor").alias("floor"), F.sum("n").alias("postings"), F.sum(F.when(F.col("is_read"), F.col("n")).otherwise(0)).alias("read"))
        left = saved(left, "left")
        seen = seen_of(known.where("is_read"))
        able = seen_of(known.where("is_read"), left) if packed else seen
        able = able.join(F.broadcast(left) if few else left, "qid").where(F.coalesce(F.col("over") + F.col("left") >= F.col("floor") - SLACK, F.lit(True)))
        able = saved(able.select("qid", "gen", "segment", "key", "seen", F.col("over") + F.col("left") + SLACK).toDF("qid", "gen", "segment", "key", "seen", "most"), "able")
        reached = able.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("seen")))).where(F.col("nth") == k).select("qid", F.col("seen").alias("reached"))
        reached = saved(reached, "reached")  # k documents have this score at least
        able = able.join(F.broadcast(reached) if few else reached, "qid", "left").where(F.coalesce(F.col("most") >= F.col("reached"), F.lit(True)))
        able = saved(able.select("qid", "gen", "segment", "key"), "still_able")
        scored = scored_of(able, weights, mean, few).withColumn("order", F.round("bm25", 5))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("order"), "id_order", "doc_id"))).where(F.col("rank") <= k)
        counts = seen.groupBy("qid").agg(F.count("*").alias("candidates")).join(able.groupBy("qid").agg(F.count("*").alias("scored")), "qid", "left")
        work = left.select("qid", "postings", "read").join(counts, "qid", "left").fillna(0, ["candidates", "scored"])
        return Found(ranked.select("qid", "rank", "doc_id", "bm25"), work)

    def _seen(self, chosen: DataFrame, mean: float, few: bool) -> DataFrame:
        """``qid``, ``segment``, ``gen``, ``key``, ``seen`` (what the chosen levels hold of the document's score) and ``over`` (by how much that is more than the bounds of what is left of these terms)."""
        below = Window.partitionBy("qid", "term")
        chosen = chosen.select("qid", "term", "level", "w", F.min("next").over(below).alias("rest"))
        wanted = chosen.select("term", "level").distinct()
        blocks = self._read("blocks").join(F.broadcast(wanted) if few else wanted, ["term", "level"], "left_semi").repartition("segment")  # whole blocks travel, once for all questions; a document's blocks meet
        each = blocks.join(F.broadcast(chosen) if few else chosen, ["term", "level"]).select("qid", "segment", "gen", "w", "rest", F.inline("docs"))
        worth = impact(F.col("tf"), F.col("dl"), mean)
        return each.groupBy("segment", "gen", "key", "qid").agg(F.sum(F.col("w") * worth).alias("seen"), F.sum(F.col("w") * (worth - F.col("rest"))).alias("over"))

    def _seen_packed(self, chosen: DataFrame, mean: float, limits: DataFrame | None, most: int | None) -> DataFrame:
        """As _seen(), a segment's postings added up together. ``limits``: each question's ``left`` and ``floor``, without what cannot reach them; ``most``: of each question and segment that many of the largest ``seen``."""
        below = Window.partitionBy("qid", "term")
        rows = chosen.select("qid", "term", "level", "w", (F.col("w") * F.min("next").over(below)).alias("wr")).toArrow()
        names = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("term", "level")], ["term", "level"])
        at, distinct = _numbered(rows["term"].combine_chunks(), rows["level"].to_numpy())
        asked = pc.unique(rows["qid"].combine_chunks())
        limit = np.full((2, len(asked)), np.nan)
        if limits is not None:
            known = limits.select("qid", "left", "floor").toArrow()
            where = pc.index_in(known["qid"].combine_chunks(), asked)
            for n, c in enumerate(("left", "floor")):
                limit[n, where.drop_null().to_numpy()] = known[c].combine_chunks().filter(where.is_valid()).to_numpy(zero_copy_only=False)
        qi = pc.index_in(rows["qid"].combine_chunks(), asked).to_numpy()
        order = np.argsort(at, kind="stable")
        packed = self.spark.sparkContext.broadcast((asked, np.searchsorted(at[order], np.arange(len(distinct) + 1)), qi[order], *(rows[c].to_numpy()[order] for c in ("w", "wr")), limit))
        codes = self.spark.createDataFrame(pa.table({"term": names.field("term").take(pa.array(distinct)), "level": names.field("level").take(pa.array(distinct)), "code": pa.array(np.arange(len(distinct), dtype=np.int32))}))
        blocks = self._read("blocks").join(F.broadcast(codes), ["term", "level"]).select("segment", "gen", "code", "docs")
        ship(self.spark)
        return blocks.groupBy("segment", "gen").applyInArrow(_added(packed, mean, most), f"qid {chosen.schema['qid'].dataType.simpleString()}, segment int, gen int, key long, seen double, over double")

    def _scored(self, pairs: DataFrame, weights: DataFrame, mean: float, few: bool) -> DataFrame:
        """``qid``, ``doc_id``, ``id_order``, ``bm25`` of pairs of question and document."""
        on = ["gen", "segment", "key"]
        if few:  # a document's terms are spread once for all of its questions
            asked = pairs.groupBy(*on).agg(F.collect_list("qid").alias("qids"))
            docs = self._read("forward").join(F.broadcast(asked) if pairs.count() <= MOST_TERMS else asked, on).select("qids", "gen", "key", "doc_id", "dl", F.inline("terms")).alias("d")
            each = docs.join(F.broadcast(weights.alias("q")), F.expr("d.term = q.term AND array_contains(d.qids, q.qid)"))
        else:
            docs = self._read("forward").join(pairs, on).select("qid", "gen", "key", "doc_id", "dl", F.inline("terms"))
            each = docs.join(weights, ["qid", "term"])
        s = each.groupBy("qid", "gen", "key", "doc_id").agg(F.sum(F.col("w") * impact(F.col("n"), F.col("dl"), mean)).alias("bm25"))
        return s.withColumn("id_order", F.expr("try_cast(doc_id AS decimal(38,0))"))

    def _scored_packed(self, pairs: DataFrame, weights: DataFrame, mean: float, few: bool) -> DataFrame:
        """As _scored(), the documents of a batch scored together."""
        on = ["gen", "segment", "key"]
        asked = pairs.groupBy(*on).agg(F.collect_list("qid").alias("qids"))
        docs = self._read("forward").join(F.broadcast(asked) if pairs.count() <= MOST_PAIRS else asked, on).select("qids", "gen", "key", "doc_id", "dl", "terms")
        rows = weights.select("qid", "term", "w").toArrow()
        terms, qids = pc.unique(rows["term"].combine_chunks()), pc.unique(rows["qid"].combine_chunks())
        at = pc.index_in(rows["term"].combine_chunks(), terms).to_numpy()
        order = np.argsort(at, kind="stable")
        qi = pc.index_in(rows["qid"].combine_chunks(), qids).to_numpy()
        packed = self.spark.sparkContext.broadcast((terms, qids, np.searchsorted(at[order], np.arange(len(terms) + 1)), qi[order], rows["w"].to_numpy()[order]))
        ship(self.spark)
        s = docs.mapInArrow(_scores(packed, mean), f"qid {weights.schema['qid'].dataType.simpleString()}, gen int, key long, doc_id string, bm25 double")
        return s.withColumn("id_order", F.expr("try_cast(doc_id AS decimal(38,0))"))


#: Document ids are kept as text, so that an index serves any table; ids that are whole numbers are ordered as such.
SCHEMAS = {
    "forward": "doc_id string, key long, dl int, terms array<struct<term:string,n:int>>, gen int, segment int",
    "blocks": "term string, level int, segment int, docs array<struct<key:long,tf:int,dl:int>>, top double, n int, gen int",
    "stats": "n_docs long, n_tokens long, base double, n_dead long, gen int",
    "dead": "key long, of int, gen int",
    "gone": "term string, n long, gen int",
}


def impact(tf, dl, mean: float):
    """The document's part of BM25, without K1 + 1."""
    return tf / (tf + K1 * (1 - B + B * dl / F.lit(max(1.0, mean))))


def _grouped(base: float):
    """Of batches of ``segment``, ``key``, ``dl``, ``terms``: their blocks. A segment that goes on in the next batch has a further block there."""
    def run(batches):
        for b in batches:
            lists = b.column("terms")
            places = lists.flatten()
            if not len(places):
                continue
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            words, tf, dl = places.field("term").dictionary_encode(), places.field("n").to_numpy(), b.column("dl").to_numpy()[at]
            segments, nth = np.unique(b.column("segment").to_numpy(), return_inverse=True)
            worth = tf / (tf + K1 * (1 - B + B * dl / max(1.0, base)))
            level = np.minimum(LEVELS - 1, np.floor(worth * LEVELS)).astype(np.int64)
            code = (nth[at] * len(words.dictionary) + words.indices.to_numpy()) * LEVELS + level
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            first, ends = order[starts], np.append(starts, len(order)).astype(np.int32)
            docs = pa.StructArray.from_arrays([pa.array(x[order]) for x in (b.column("key").to_numpy()[at], tf, dl)], ["key", "tf", "dl"])
            yield pa.RecordBatch.from_arrays(
                [words.dictionary.take(words.indices.take(pa.array(first))), pa.array(level[first].astype(np.int32)), pa.array(segments[nth[at[first]]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), docs), pa.array(np.maximum.reduceat(worth[order], starts)), pa.array(np.diff(ends))],
                names=["term", "level", "segment", "docs", "top", "n"],
            )

    return run


def _numbered(terms: pa.Array, levels: np.ndarray):
    """For each row the number of its term and level, and for each number a row that has it."""
    code = terms.dictionary_encode().indices.to_numpy().astype(np.int64) * LEVELS + levels
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return at, first


def _pairs(code: np.ndarray, starts: np.ndarray):
    """Of rows with a ``code``, whose entries stand from ``starts[code]`` to the next: slices of rows and of their entries, PAIRS at a time or those of one row."""
    n = starts[code + 1] - starts[code]
    upto = np.append(0, np.cumsum(n))
    a = 0
    while a < len(code):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        row = np.repeat(np.arange(a, z), n[a:z])
        yield row, np.arange(upto[a], upto[z]) - np.repeat(upto[a:z] - starts[code[a:z]], n[a:z])
        a = z


def _added(packed, mean: float, most: int | None):
    """Of a segment's blocks (``code``, ``docs``): what _seen_packed() returns."""
    def run(group, table):
        asked, starts, qi, w, wr, (left, floor) = packed.value
        lists = table["docs"].combine_chunks()
        d = lists.flatten()
        key, doc = np.unique(d.field("key").to_numpy(), return_inverse=True)
        worth = _impact(d.field("tf").to_numpy(), d.field("dl").to_numpy(), mean)
        code = np.repeat(table["code"].to_numpy(), lists.value_lengths().to_numpy())
        step = max(1, CELLS // max(1, len(key)))
        out = []
        for q0 in range(0, len(asked), step):  # so many questions that their sums for all documents fit
            nq = min(step, len(asked) - q0)
            seen, rest = np.zeros(nq * len(key)), np.zeros(nq * len(key))
            for row, at in _pairs(code, starts):
                if nq < len(asked):
                    own = (qi[at] >= q0) & (qi[at] < q0 + nq)
                    row, at = row[own], at[own]
                cell = (qi[at] - q0) * len(key) + doc[row]
                seen += np.bincount(cell, w[at] * worth[row], len(seen))
                rest += np.bincount(cell, wr[at], len(rest))
            at = np.flatnonzero(seen)
            over = seen[at] - rest[at]
            q = at // len(key) + q0
            able = ~(over + left[q] < floor[q] - SLACK)  # a question without a floor keeps all
            at, over, q = at[able], over[able], q[able]
            if most is not None:
                order = np.lexsort((-seen[at], q))
                order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < most]
                at, over, q = at[order], over[order], q[order]
            out.append((asked.take(pa.array(q)), pa.array(key[at % len(key)]), pa.array(seen[at]), pa.array(over)))
        cols = [pa.chunked_array([o[n] for o in out]) for n in range(4)]
        segment, gen = (pa.array(np.full(len(cols[0]), g.as_py(), np.int32)) for g in group)
        return pa.table([cols[0], segment, gen, *cols[1:]], names=["qid", "segment", "gen", "key", "seen", "over"])

    return run


def _scores(packed, mean: float):
    """Of batches of ``qids``, ``gen``, ``key``, ``doc_id``, ``dl``, ``terms``: a row for each question of each document with its score."""
    def run(batches):
        terms, qids, starts, qi, w = packed.value
        step = max(1, CELLS // max(1, len(qids)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                lists, asked = b.column("terms"), b.column("qids")
                wanted = np.zeros(b.num_rows * len(qids), bool)
                wanted[np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy()) * len(qids) + pc.index_in(asked.flatten(), qids).to_numpy()] = True
                at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
                places = lists.flatten()
                code = pc.fill_null(pc.index_in(places.field("term"), terms), -1).to_numpy()
                known = np.flatnonzero(code >= 0)
                worth = _impact(places.field("n").to_numpy()[known], b.column("dl").to_numpy()[at[known]], mean)
                score = np.zeros(len(wanted))
                for row, e in _pairs(code[known], starts):
                    cell = at[known[row]] * len(qids) + qi[e]
                    own = wanted[cell]
                    score += np.bincount(cell[own], (w[e] * worth[row])[own], len(score))
                hit = np.flatnonzero(wanted & (score > 0))
                row = pa.array(hit // len(qids))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(hit % len(qids))), *(b.column(c).take(row) for c in ("gen", "key", "doc_id")), pa.array(score[hit])], names=["qid", "gen", "key", "doc_id", "bm25"])

    return run


def _impact(tf: np.ndarray, dl: np.ndarray, mean: float) -> np.ndarray:
    return tf / (tf + K1 * (1 - B + B * dl / max(1.0, mean)))


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``terms`` (T.counted() of T.tokens()), ``dl``."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_terms, "doc_id string, terms array<struct<term:string,n:int>>, dl int")


#: Lower-case bytes of T.TOKEN; all others, those of letters beyond ASCII too, are 0 and part tokens.
FOLDED = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_-":
    FOLDED[[_c, ord(chr(_c).upper())]] = _c
#: Bytes of text whose terms are counted together.
SLICE_BYTES = 4 << 20


def _terms(batches):
    """Of batches of ``doc_id``, ``text``: the texts' counted terms and their number of tokens."""
    for b in batches:
        if not b.num_rows:
            continue
        texts = b.column("text")
        wide = pa.types.is_large_string(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
            terms, dl = _term_counts(raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), terms, pa.array(dl.astype(np.int32))], names=["doc_id", "terms", "dl"])
            at = to


def _term_counts(raw: np.ndarray, ends: np.ndarray):
    """Of texts, from each of ``ends`` to the next in ``raw`` (UTF-8): lists of their terms in alphabetical order with counts, and their numbers of tokens. A run of a token's characters holds one token at most, from its first letter or digit on."""
    low = FOLDED[raw]
    is_in = low != 0
    begins, stops = is_in.copy(), is_in.copy()
    begins[1:] &= ~is_in[:-1]
    stops[:-1] &= ~is_in[1:]
    held = ends[:-1] < ends[1:]  # where a text begins or ends, a run does
    borders = ends[:-1][held], ends[1:][held] - 1
    begins[borders[0]], stops[borders[1]] = is_in[borders[0]], is_in[borders[1]]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    signs = is_in & ((low == ord("_")) | (low == ord("-")))
    if signs[first].any():
        letters = np.append(np.flatnonzero(is_in & ~signs), len(low))
        first = np.minimum(letters[np.searchsorted(letters, first)], last)
    some = last - first >= 2
    first, last = first[some], last[some]
    inside = np.zeros(len(low) + 1, np.int8)
    inside[first] += 1
    inside[last] -= 1
    offsets = np.append(0, np.cumsum(last - first))
    places = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(low[np.cumsum(inside[:-1], dtype=np.int8).view(bool)])]).dictionary_encode()
    words = places.dictionary.cast(pa.string())
    sorted_ = pc.sort_indices(words)
    nth = np.empty(len(words), np.int64)
    nth[sorted_.to_numpy()] = np.arange(len(words))
    upto = np.searchsorted(first, ends)
    dl = np.diff(upto)
    code = np.sort(np.repeat(np.arange(len(dl)), dl) * max(1, len(words)) + nth[places.indices.to_numpy()])
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    doc, word = np.divmod(code[starts], max(1, len(words)))
    n = np.diff(np.append(starts, len(code))).astype(np.int32)
    each = pa.StructArray.from_arrays([words.take(sorted_).take(pa.array(word)), pa.array(n)], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(dl) + 1)).astype(np.int32)), each), dl


def _build(spark: SparkSession, counted: DataFrame, path: str | None) -> PostingsIndex:
    index = PostingsIndex(spark, path or new_path(spark, "postings_index"))
    for t in ("dead", "gone"):  # tables that a first generation has nothing for
        spark.createDataFrame([], SCHEMAS[t].rpartition(",")[0]).write.parquet(f"{index.path}/{t}/gen=0")
    return index._add(counted, 0, None)


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> PostingsIndex:
    """The index of all rows of ``docs``, at ``path`` or in the shared folder. A null text has no token and counts as a document; an empty table gives an index without hits."""
    return _build(docs.sparkSession, _counted(docs, id_col, text_col), path)


def _plan(levels: DataFrame) -> DataFrame:
    """Of ``qid``, ``term``, ``level``, ``w``, ``n``, ``top``: with ``next`` (the bound of the level below), ``gain`` (by how much reading the level lowers the bound of what is left), and what is ``before`` it of the bound and of postings (``before_n``), in the order of reading.

    Levels of a term are read from the highest down: the gain a posting that orders them never rises on the way.
    """
    down = Window.partitionBy("qid", "term").orderBy(F.desc("level"))
    p = levels.withColumn("next", F.coalesce(F.lead("top").over(down), F.lit(0.0)))
    p = p.withColumn("top", F.max("top").over(Window.partitionBy("qid", "term").orderBy("level"))).withColumn("next", F.least("next", "top")).withColumn("gain", F.col("w") * (F.col("top") - F.col("next")))
    p = p.withColumn("density", F.min(F.col("gain") / F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy("qid").orderBy(F.desc("density"), "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("gain").over(Window.partitionBy("qid"))
    return p.select("qid", "term", "level", "w", "n", "next", "gain", (total - F.coalesce(F.sum("gain").over(order), F.lit(0.0))).alias("before"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before_n"))
