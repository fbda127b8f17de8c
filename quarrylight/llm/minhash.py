"""Near-duplicate documents by ProbMinHash over weighted word shingles.

1. ``sketches``: a text's shingles (runs of ``k`` words), weighted by 1 + ln(occurrences): a line that a text repeats a
   hundred times must not drown the rest of it. Each shingle is a Poisson
   process of arrivals with its weight as rate; an arrival lands in a random register, and a register keeps the shingle
   that arrives first. Two texts agree in a register with the probability Jaccard similarity of their shingle weights. A
   shingle's later arrivals are only drawn while they could still be first somewhere. Texts with equal word sequences
   share one sketch (a *class*). A text whose shingles differ in occurrences has a second sketch with all weights 1, whose
   registers agree with the plain Jaccard similarity; for the others both are the same.
2. Both sketches' registers are banded; classes that share a band of either meet in a bucket. Buckets of a few classes give all their pairs, larger
   ones a pair of each class with the bucket's first. Pairs are verified on the exact shingle weights, links give connected
   components.
3. A large bucket whose classes are one component by then has no more to tell. In the others, each class outside the
   bucket's largest component is compared with a member of it, another one in each band. What is still apart is cut into
   blocks, those of the largest component for themselves, and compared block against block (but not within that component) by
   signatures, each pair only in the first band that both share and only while its ends are
   apart, so that a group of copies costs time in proportion to its size, and no pair that could join two components is
   left out. The pairs that the signatures let pass are verified as in 2. Where they are many more than the classes, the
   bucket's blocks are compared once more with the shingles at hand, so that pairs are never listed in their square.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import saved
from quarrylight.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Classes of a bucket whose pairs are listed as rows; larger buckets are compared in blocks of BLOCK.
LISTED = 8
BLOCK = 256
#: Rows of a large bucket that one task takes in a join.
PIECE = 256
#: Candidates for each class of a pair of blocks that leave it as rows; beyond that the bucket is compared with the shingles at hand, in blocks of DENSE_BYTES.
LIKELY = 4
DENSE_BYTES = 32 << 20
#: A pair of a block is verified if this much less than the similarity is estimated: over four standard errors of the estimate.
SLACK = 0.16

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, marks and digits."""
    return _WORD.findall(text.lower()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer (public): an avalanche over 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit numbers of words, kept in two bounded halves."""

    def __init__(self, most: int = 200_000):
        self.most, self.new, self.old = most, {}, {}

    def __call__(self, w: str) -> int:
        h = self.old.get(w)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[w] = h
        return h

    def all(self, ws: list[str]) -> np.ndarray:
        get = self.new.get
        return np.array([get(w) or self(w) for w in ws], np.uint64)


def _class_of(numbers: np.ndarray) -> str | None:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).hexdigest() if len(numbers) else None


def shingles(numbers: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and how often each occurs; a text of fewer than k words is one shingle, one without words has none."""
    if not len(numbers):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    with np.errstate(over="ignore"):
        k = min(k, len(numbers))
        n = len(numbers) - k + 1
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = _mixed(h * _MIX + numbers[j : j + n])
    s, counts = np.unique(h, return_counts=True)
    return s, counts.astype(np.int32)


def prob_minhash(items: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """(texts, registers) int32: the shingle that came first in each register. ``items`` hold hashes and counts and are not empty.

    All texts of the list advance together, one arrival a round. A shingle stops once its next arrival comes after the
    last first arrival of its text: it can no longer win a register.
    """
    n = len(items)
    of = np.repeat(np.arange(n), [len(s) for s, _ in items])
    h = np.concatenate([s for s, _ in items])
    rate = weight(np.concatenate([c for _, c in items]))
    best = np.full(n * registers, np.inf)
    won = np.zeros(n * registers, np.uint64)
    t = np.zeros(len(h))
    with np.errstate(over="ignore"):
        draw = _mixed(h + _MIX)
        round_ = 0
        while len(h):
            round_ += 1
            draw = _mixed(draw + _MIX * np.uint64(round_))
            t = t - np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
            place = of * registers + ((_mixed(draw ^ _MIX) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((h, t))
            first = np.full(n * registers, -1, np.int64)
            first[place[order][::-1]] = order[::-1]  # the earliest arrival is written last
            hit = np.flatnonzero(first >= 0)
            cand = first[hit]
            better = t[cand] < best[hit]
            best[hit[better]], won[hit[better]] = t[cand[better]], h[cand[better]]
            last = best.reshape(n, registers).max(1)
            go = t < last[of]
            of, h, rate, t, draw = of[go], h[go], rate[go], t[go], draw[go]
        return (_mixed(won) >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(n, registers)


def weight(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def similarity_of(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> float:
    """The larger of the probability Jaccard similarity of two texts' weighted shingles and the plain one of their sets, from sorted shingles and their counts."""
    if (an == an[:1]).all() and (bn == bn[:1]).all():
        return probability_jaccard(a, an, b, bn)
    common = len(np.intersect1d(a, b, assume_unique=True))
    plain = common / (len(a) + len(b) - common) if common else 0.0
    return max(plain, probability_jaccard(a, weight(an), b, weight(bn)))


def probability_jaccard(a: np.ndarray, aw: np.ndarray, b: np.ndarray, bw: np.ndarray) -> float:
    """Sum over the common elements x of 1 / sum over z of max(a(z)/a(x), b(z)/b(x)). Sorted elements with their weights. With equal weights this is the Jaccard similarity of the sets."""
    if not len(a) or not len(b):
        return 0.0
    common, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if (aw == aw[0]).all() and (bw == bw[0]).all():
        return len(common) / (len(a) + len(b) - len(common))
    x, y = aw[ia].astype(np.float64), bw[ib].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    r = x / y
    from_right = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    upto = np.concatenate([[0.0], np.cumsum(y)])
    k = np.searchsorted(r, r, "left")
    only_a, only_b = aw.sum() - x.sum(), bw.sum() - y.sum()
    return float((1 / ((only_a + from_right[k]) / x + (only_b + upto[k]) / y)).sum())


def _sketch_batches(batches, registers: int, k: int, group_words: int = 60_000):
    """Per text: class key (of the word sequence; null without words), signature bytes, those of the set (null if they are the same)."""
    number = Words()
    for b in batches:
        texts = b.column(1).to_pylist()
        keys, sigs, flats = [None] * len(texts), [None] * len(texts), [None] * len(texts)
        at, items, size = [], [], 0

        def flush():
            if items:
                for i, row in zip(at, prob_minhash(items, registers)):
                    sigs[i] = row.astype("<i4").tobytes()
            uneven = [(i, s, n) for i, (s, n) in zip(at, items) if (n != n[0]).any()]
            if uneven:
                for (i, _, _), row in zip(uneven, prob_minhash([(s, np.ones_like(n)) for _, s, n in uneven], registers)):
                    flats[i] = row.astype("<i4").tobytes()

        for i, text in enumerate(texts):
            ws = number.all(words(text))
            keys[i] = _class_of(ws)
            if not len(ws):
                continue
            items.append(shingles(ws, k))
            at.append(i)
            size += len(ws)
            if size > group_words:
                flush()
                at, items, size = [], [], 0
        flush()
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(keys, pa.string()), pa.array(sigs, pa.binary()), pa.array(flats, pa.binary())], names=["id", *b.schema.names[2:], "class", "sig", "flat"])


#: Two 64-bit hashes that together name a row's id and text, nulls told from empty texts.
ROW_KEY = {"k1": 17, "k2": 23}


def _row_key(id_col: str, text_col: str) -> dict[str, Column]:
    return {name: F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(text_col).isNull(), F.col(id_col), F.col(text_col)) for name, seed in ROW_KEY.items()}


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """``id``, ``k1`` and ``k2`` (ROW_KEY), ``class`` (null without words), ``sig`` (bands * rows little-endian 32-bit registers), ``flat`` (those with all weights 1; null where they are the same)."""
    kind = df.schema[id_col].dataType.simpleString()
    m = bands * rows
    rows_ = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in _row_key(id_col, text_col).items()))
    return rows_.mapInArrow(lambda it: _sketch_batches(it, m, k), f"id {kind}, k1 long, k2 long, class string, sig binary, flat binary")


def _weights(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``class``, ``items`` (sorted 64-bit shingles), ``counts`` (empty if all are equal), a row for each class of ``wanted`` (``id``, ``class``). An id may have several texts: only those of the wanted class count."""

    def run(batches):
        number = Words()
        for b in batches:
            rows = []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = number.all(words(t))
                if _class_of(ws) == c:
                    s, n = shingles(ws, k)
                    rows.append((c, s.astype("<u8").tobytes(), b"" if (n == n[0]).all() else n.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["class", "items", "counts"])

    return docs.join(wanted, "id").select("class", "text").mapInArrow(run, "class string, items binary, counts binary").dropDuplicates(["class"])


def _unpack(items: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(items, "<u8")
    return s, np.frombuffer(counts, "<i4") if len(counts) else np.ones(len(s), np.int32)


class _Sets:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _block_pairs(pdf: pd.DataFrame, bands: int, rows: int, similarity: float, sets: _Sets):
    """Pairs (as row numbers) of one pair of blocks that may be linked, in no band before this one's, and whose ends ``sets`` holds apart when the pair is asked for. Sorted rows of ``block``, ``sig``, ``flat``, all of one bucket of ``band``."""
    band, block = int(pdf["band"].iloc[0]), pdf["block"].to_numpy()
    sig = np.stack([np.frombuffer(s, "<i4") for s in pdf["sig"]])
    flat = np.stack([np.frombuffer(s if f is None else f, "<i4") for s, f in zip(pdf["sig"], pdf["flat"])])
    uneven = np.array([f is not None for f in pdf["flat"]])
    same_block = block[0] == block[-1]
    left = np.arange(len(block)) if same_block else np.flatnonzero(block == block[0])
    right = left if same_block else np.flatnonzero(block == block[-1])
    for i in left:
        others = right[right > i] if same_block else right
        if not len(others):
            continue
        agreed = [sig[others] == sig[i]]
        if uneven[i] or uneven[others].any():  # a bucket holds the bands of both sketches
            agreed += [flat[others] == flat[i], sig[others] == flat[i], flat[others] == sig[i]]
        seen = np.logical_or.reduce([same.reshape(len(others), bands, rows).all(2)[:, :band].any(1) for same in agreed])
        likely = np.logical_or.reduce([same.mean(1) >= similarity - SLACK for same in agreed[:2]])
        for j in others[likely & ~seen]:
            if sets.find(i) != sets.find(j):
                yield i, j


def _sorted_block(pdf: pd.DataFrame) -> tuple[pd.DataFrame, _Sets]:
    """The rows by block and class, and the sets of rows that ``comp``, the component so far, has joined."""
    pdf = pdf.sort_values(["block", "class"])
    sets, first = _Sets(len(pdf)), {}
    for i, c in enumerate(pdf["comp"]):
        sets.join(i, first.setdefault(c, i))
    return pdf, sets


def _candidates(pdf: pd.DataFrame, bands: int, rows: int, similarity: float) -> list[tuple]:
    """The pairs of one pair of blocks that have to be verified (``a``, ``b``), or, where they are more than LIKELY a class, one row that names the bucket as dense (``band``, ``key``)."""
    pdf, sets = _sorted_block(pdf)
    names, found = pdf["class"].tolist(), []
    for i, j in _block_pairs(pdf, bands, rows, similarity, sets):
        if len(found) == LIKELY * len(names):
            return [(None, None, int(pdf["band"].iloc[0]), int(pdf["key"].iloc[0]))]
        found.append((names[i], names[j], None, None))
    return found


def _block_links(pdf: pd.DataFrame, bands: int, rows: int, similarity: float) -> list[tuple[str, str]]:
    """Links that connect what the pairs of one pair of blocks connect (not all pairs), with the shingles at hand: rows also have ``items``, ``counts``."""
    pdf, sets = _sorted_block(pdf)
    names, items, counts = pdf["class"].tolist(), pdf["items"].tolist(), pdf["counts"].tolist()
    links = []
    for i, j in _block_pairs(pdf, bands, rows, similarity, sets):
        if similarity_of(*_unpack(items[i], counts[i]), *_unpack(items[j], counts[j])) >= similarity:
            sets.join(i, j)
            links.append((names[i], names[j]))
    return links


def _apart(rows: DataFrame) -> DataFrame:
    """The buckets of ``rows`` (``band``, ``key``, ``n``, ``class``, ``comp``) that hold several components: ``main``, the largest of them, ``in_main``, its members in the bucket, and ``centre``, one of these that differs from band to band."""
    each = rows.groupBy("band", "key", "comp").agg(F.count("*").alias("held"), F.min(F.struct(F.xxhash64("class", "band").alias("h"), "class")).alias("c"), F.first("n").alias("n"))
    largest = each.groupBy("band", "key").agg(F.max(F.struct("held", "comp", "c")).alias("x"), F.first("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    return largest.select("band", "key", "n", F.col("x.comp").alias("main"), F.col("x.held").alias("in_main"), F.col("x.c.class").alias("centre"))


def _deal(members: DataFrame, per: Column) -> DataFrame:
    """Members of _apart() buckets (with ``main``, ``in_main``, ``comp``), in blocks of ``per``: those of the main component in blocks of their own, which meet the others' blocks but not each other. A class goes to every pair of blocks that its own block is in: adds ``block``, ``i``, ``j``."""
    main = F.col("comp") == F.col("main")
    own = members.withColumns({"others": F.ceil((F.col("n") - F.col("in_main")) / per).cast("int"), "mains": F.ceil(F.col("in_main") / per).cast("int")})
    own = own.withColumn("block", (F.pmod(F.xxhash64("class"), F.when(main, F.col("mains")).otherwise(F.col("others"))) + F.when(main, F.col("others")).otherwise(0)).cast("int"))
    meets = F.col("others") + F.when(main, 0).otherwise(F.col("mains"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "others", "mains")


def _by_bucket(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """``members`` (``band``, ``key``, ``n``, ``class``, ...) joined with ``buckets`` (``band``, ``key``, ``n`` and more), a bucket of n members in n / PIECE pieces, so that none fills one task."""
    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    split = members.withColumn("piece", F.pmod(F.xxhash64("class", F.lit(1)), pieces).cast("int"))
    return split.join(buckets.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("n"), ["band", "key", "piece"]).drop("piece")


def _groups(df: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int, k: int) -> tuple[DataFrame, DataFrame]:
    """The saved sketches() of ``df`` and ``class``, ``class_id`` for each class of a row with an id."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sk = saved(sketches(docs, "id", "text", bands, rows, k), "sketches")
    reps = saved(sk.where("class is not null and id is not null").groupBy("class").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("flat").alias("flat")), "reps")

    # Buckets: (band, key) with two classes at least. Equal buckets in several bands count once, in the first.
    width = 4 * rows
    keyed = lambda c: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.substring(F.col(c), b * width + 1, F.lit(width)), b).alias("key")))
    banded = reps.select("class", F.explode(F.when(F.col("flat").isNull(), keyed("sig")).otherwise(F.array_union(keyed("sig"), keyed("flat")))).alias("x")).select("class", "x.*")
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("members"), F.min("class").alias("low")).where("n > 1")
    sizes = sizes.groupBy("n", "members", "low").agg(F.min(F.struct("band", "key")).alias("x")).select("n", "x.*")
    member = saved(banded.join(sizes, ["band", "key"]).select("band", "key", "n", "class"), "members")

    few = member.where(F.col("n") <= LISTED).groupBy("band", "key").agg(F.sort_array(F.collect_set("class")).alias("c"))
    listed = few.select(F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice(F.col("c"), i + 2, LISTED), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    many = saved(member.where(F.col("n") > LISTED), "large_buckets")
    star = _by_bucket(many, many.groupBy("band", "key").agg(F.min("class").alias("a"), F.first("n").alias("n"))).where("class != a").select("a", F.col("class").alias("b"))
    pairs = saved(listed.union(star).distinct(), "pairs")

    # Exact weights, only of classes that met another one.
    involved = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "class")
    first = reps.join(involved, "class", "left_semi").select(F.col("rep").alias("id"), "class")
    weighted = saved(_weights(docs, first, k), "weights")

    one = weighted.select(F.col("class").alias("a"), F.col("items").alias("ai"), F.col("counts").alias("ac"))
    two = weighted.select(F.col("class").alias("b"), F.col("items").alias("bi"), F.col("counts").alias("bc"))

    def verify(batches):
        for t in batches:
            cols = [t.column(c) for c in ("ai", "ac", "bi", "bc")]
            good = []
            for row in range(t.num_rows):  # one pair at a time, straight from Arrow's buffers
                ai, ac, bi, bc = (c[row].as_buffer() for c in cols)
                good.append(similarity_of(*_unpack(ai, ac), *_unpack(bi, bc)) >= similarity)
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(candidates: DataFrame) -> DataFrame:
        return candidates.join(one, "a").join(two, "b").select("a", "b", "ai", "ac", "bi", "bc").mapInArrow(verify, "a string, b string")

    links = saved(verified(pairs), "links")

    def placed(members: DataFrame, found: DataFrame) -> DataFrame:
        return members.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("component", "class")).drop("component")

    def tree(found: DataFrame) -> DataFrame:
        return found.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    # Large buckets that are not one component yet: who is outside the largest component meets a member of it, another one in each band.
    so_far = saved(components(links, "a", "b"), "components")
    open_ = placed(many, so_far)
    outside = _by_bucket(open_, _apart(open_)).where("comp != main")
    again = saved(verified(outside.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()), "second_links")
    so_far = saved(components(tree(so_far).union(again), "a", "b"), "components")

    # Those that are still not one, block against block by signatures alone: only pairs that may be linked fetch shingles.
    open_ = placed(many, so_far)
    dealt = _deal(_by_bucket(open_, _apart(open_)).join(reps.select("class", "sig", "flat"), "class"), F.lit(BLOCK))
    dealt = dealt.select("band", "key", "i", "j", "block", "class", "comp", "sig", "flat")

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_candidates(pdf, bands, rows, similarity), columns=["a", "b", "band", "key"]).astype({"band": "Int32", "key": "Int64"})

    met = saved(dealt.groupBy("band", "key", "i", "j").applyInPandas(candidates, "a string, b string, band int, key long"), "candidates")
    edges = saved(tree(so_far).union(verified(met.where("a is not null").select("a", "b").distinct())), "linked")

    # Buckets with too many such pairs, once more with the shingles in the block, each verified only while its ends are apart.
    dense = met.where("a is null").select("band", "key").distinct()
    if not dense.isEmpty():
        rest = placed(_by_bucket(many, dense.join(many.groupBy("band", "key").agg(F.first("n").alias("n")), ["band", "key"])), components(edges, "a", "b"))
        size = weighted.select("class", (F.octet_length("items") + F.octet_length("counts")).alias("size"))
        sized = saved(_by_bucket(rest, _apart(rest)).join(size, "class"), "dense")
        blocks = sized.groupBy("band", "key").agg(F.first("n").alias("n"), F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.first("n") * DENSE_BYTES / F.sum("size")))).alias("per"))
        heavy = _deal(_by_bucket(sized, blocks).join(reps.select("class", "sig", "flat"), "class").join(weighted, "class"), F.col("per"))
        heavy = heavy.select("band", "key", "i", "j", "block", "class", "comp", "sig", "flat", "items", "counts")

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_block_links(pdf, bands, rows, similarity), columns=["a", "b"])

        edges = saved(edges.union(heavy.groupBy("band", "key", "i", "j").applyInPandas(compare, "a string, b string")), "all_links")

    ids = reps.select("class", "rep")
    edges = edges.join(ids.withColumnRenamed("class", "a"), "a").withColumnRenamed("rep", "x").join(ids.withColumnRenamed("class", "b"), "b").withColumnRenamed("rep", "y").select("x", "y")
    comp = components(edges, "x", "y")
    return sk, saved(ids.join(comp, ids.rep == comp.node, "left").select("class", F.coalesce("component", "rep").alias("class_id")), "classes")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """``id_col``, ``class_id`` (smallest id of the group), ``kept`` (id = class_id): one row per row of ``df``.

    Two texts are linked if the probability Jaccard similarity of their k-word shingles, weighted by 1 + ln(occurrences),
    or the plain one of the sets is ``similarity`` or more (the same number for texts that repeat no shingle); groups are
    what links connect. Texts with
    the same words in the same order belong together. A null text, an empty one or one without words is in a group of its
    own. Rows with the same id are one document if they hold the same words; else each takes the smallest class id of its
    own text. A row with a null id gets a null class and is kept. Other columns are not read; an empty table gives an
    empty result. With 24 bands of 5 registers of each measure's sketch a pair of similarity 0.8 in either is missed with a
    probability below 0.0001.
    """
    sk, named = _groups(df, id_col, text_col, similarity, bands, rows, k)
    out = sk.select("id", "class").join(named, "class", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_col), own.alias("class_id"), F.coalesce(own == F.col("id"), F.lit(True)).alias("kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """The rows of ``df``, with all its columns, that are the kept one of their group as classes() has it.

    A row is judged by its id and its own text: where an id has several texts, only those whose own group has that id stay.
    Of rows with equal id and the same words in the same order one stays, as of those with equal id and text; rows with a
    null id stay, but for repeats of the same text. Only hashes of id and text are joined, under names that clash with no
    column of ``df``.
    """
    sk, named = _groups(df, id_col, text_col, similarity, bands, rows, k)
    judged = sk.select("id", "k1", "k2", "class").join(named, "class", "left").where("id is null or class_id is null or class_id = id")
    text = F.when(F.col("id").isNull() | F.col("class").isNull(), F.concat_ws(":", "k1", "k2")).otherwise(F.col("class"))
    own, nth = {n: f"{n}_{uuid.uuid4().hex}" for n in ROW_KEY}, f"nth_{uuid.uuid4().hex}"
    kept = judged.groupBy("id", text.alias("of")).agg(F.min(F.struct("k1", "k2")).alias("x")).select(*(F.col(f"x.{n}").alias(own[n]) for n in ROW_KEY))
    keyed = df.withColumns({own[n]: c for n, c in _row_key(id_col, text_col).items()})
    repeats = Window.partitionBy(*own.values()).orderBy(F.lit(0))
    return keyed.join(kept, list(own.values()), "left_semi").withColumn(nth, F.row_number().over(repeats)).where(F.col(nth) == 1).select(*df.columns)
