"""Merkle manifest of a dataset: a tree of SHA-256 digests over each group's rows and over the groups' roots.

Leaves are ranked in their group by one order of the whole table. A level partitions the nodes by group and parent index; the
ordered list of a parent's children, collected over the full frame, is both the parent's preimage and each child's siblings,
and the first child alone stands for the parent in the next level, so a level holds a sixteenth of the one below. The roots of
the groups are the leaves of a last tree. Proofs go down again: a node's path is its siblings and its parent's path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import saved
from quarrylight.operators.order import numbered

FANOUT = 16
#: A path's element: the place among the siblings, and the digests of all of them.
PATH = "array<struct<at:int,run:array<string>>>"


def preimage(*values: Column) -> Column:
    """What a leaf's digest is taken of: of each value its UTF-8 byte count, ``:`` and the value, or ``-`` for a null."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_digest(*values: Column) -> Column:
    return F.sha2(preimage(*values), 256)


def run_digest(run: Column) -> Column:
    """The digest of a node: that of its children's hexadecimal digests, one after the other."""
    return F.sha2(F.array_join(run, ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to by ``path``: at each level it takes its place among the siblings."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.concat(F.array_join(F.slice(x["run"], 1, x["at"]), ""), own, F.array_join(F.slice(x["run"], x["at"] + 2, F.size(x["run"])), "")), 256))


def siblings(path: Column) -> Column:
    """The siblings' digests, level by level from the leaf to the root and from left to right, without the node's own."""
    return F.flatten(F.transform(path, lambda x: F.concat(F.slice(x["run"], 1, x["at"]), F.slice(x["run"], x["at"] + 2, F.size(x["run"])))))


@dataclass
class Tree:
    """``nodes``: ``grp``, ``pos``, ``n`` (the group's nodes there), ``digest``, ``run`` (the children's digests) of each level above the leaves; ``roots``: ``grp``, ``root``."""

    levels: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    """``leaves``: the rows with ``grp``, ``pos``, ``n`` and ``digest``; ``inner``: the trees of the groups; ``outer``: the tree over their roots; ``subroots``: ``grp``, ``pos``, ``n``, ``root``."""

    leaves: DataFrame
    inner: Tree
    outer: Tree
    subroots: DataFrame
    fanout: int

    def root(self) -> str | None:
        """The root of everything; None for an empty table."""
        found = self.outer.roots.take(1)
        return found[0].root if found else None


def tree(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """The levels above ``leaves`` (``grp``, ``pos`` from 0 without gaps, ``n``, ``digest``). A group of one node is done: its leaf is its root."""
    kids = Window.partitionBy("grp", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = leaves.select("grp", "pos", "n", "digest")
    levels, roots, most = [], [below.where("n = 1")], below.agg(F.max("n")).collect()[0][0] or 0
    while most > 1:
        family = below.where("n > 1").withColumn("parent", F.floor(F.col("pos") / fanout).cast("long")).withColumn("run", F.collect_list("digest").over(kids))
        up = family.where(F.col("pos") % fanout == 0).select("grp", F.col("parent").alias("pos"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), run_digest(F.col("run")).alias("digest"), "run")
        below = saved(up, "merkle_level")
        levels.append(below)
        roots.append(below.where("n = 1").select("grp", "pos", "n", "digest"))
        most = -(-most // fanout)
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    return Tree(levels, out.select("grp", F.col("digest").alias("root")))


def build(df: DataFrame, digest: Column, group: str = "source", order: list[str] | None = None, carry: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of ``df``: leaves have the digest ``digest``, groups are the values of ``group`` (null is one of them), in a group leaves ascend by ``order`` (nulls first) and, where they tie, by their digest, so that any order of the input gives the same root; in the last tree groups ascend by value, null first.

    ``carry`` names what else a leaf keeps beside ``order`` and ``group``. Repeated rows are leaves each. An empty table has no
    nodes. A group may hold most rows: places come from one order of the table, which is cut into ranges anywhere.
    """
    order = order or ["doc_id"]
    keep = {"o" + str(k): F.col(c) for k, c in enumerate(order)} | {"c" + str(k): v for k, v in enumerate((carry or {}).values())}
    hashed = saved(df.select(F.col(group).alias("g"), digest.alias("digest"), *[v.alias(k) for k, v in keep.items()]), "leaves")  # texts are read once; the order's sample reads this
    placed = numbered(hashed.withColumn("spread", F.rand(7)), ["g", *[f"o{k}" for k in range(len(order))], "digest", "spread"], "number").drop("spread")
    groups = saved(placed.groupBy("g").agg((F.min("number") - 1).alias("grp"), F.count("*").alias("n")), "groups")
    on = groups.select(F.col("g").alias("g_"), "grp", "n")
    found = placed.join(on, F.col("g").eqNullSafe(F.col("g_")))  # a group of many rows is split by the skew join, or the groups are few and are sent
    leaves = saved(found.select("g", "grp", (F.col("number") - 1 - F.col("grp")).alias("pos"), "n", "digest", *keep), "placed")
    inner = tree(leaves, fanout)
    ranked = numbered(inner.roots, ["grp"], "number")
    many = groups.count()
    subroots = saved(ranked.select("grp", (F.col("number") - 1).alias("pos"), F.lit(many).cast("long").alias("n"), "root"), "subroots")
    outer = tree(subroots.select(F.lit(0).cast("long").alias("grp"), "pos", "n", F.col("root").alias("digest")), fanout)
    names = dict(zip(keep, [*order, *(carry or {})]))
    return Manifest(leaves.select(F.col("g").alias(group), *[F.col(k).alias(v) for k, v in names.items() if v != group], "grp", "pos", "n", "digest"), inner, outer, subroots, fanout)


def _down(nodes: DataFrame, levels: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` (``grp``, ``pos``, ``n`` and others) with ``root`` and ``path``. ``levels`` are those above them; ``roots`` has ``grp``, ``root`` and ``path`` of each group's last node, that is, what stands above it."""
    if not levels:
        return nodes.join(roots, "grp")
    run = f"run_{len(levels)}"
    families = _down(levels[0].select("grp", "pos", "n", F.col("run").alias(run)), levels[1:], roots, fanout)
    families = families.select("grp", F.col("pos").alias("parent"), run, "root", "path")
    alone = roots.join(nodes.where("n = 1").select("grp"), "grp").select("grp", F.lit(0).cast("long").alias("parent"), F.lit(None).cast("array<string>").alias(run), "root", "path")
    met = nodes.withColumn("parent", F.floor(F.col("pos") / fanout).cast("long")).join(families.unionByName(alone), ["grp", "parent"])
    own = F.struct((F.col("pos") % fanout).cast("int").alias("at"), F.col(run).alias("run"))
    return met.withColumn("path", F.when(F.col(run).isNull(), F.col("path")).otherwise(F.concat(F.array(own), F.col("path")))).drop("parent", run)


def proofs(m: Manifest) -> DataFrame:
    """The manifest's leaves with ``leaf``, ``subroot``, ``root`` and ``path``, the siblings of every level from the leaf to the root."""
    top = m.outer.roots.select("grp", "root", F.array().cast(PATH).alias("path"))
    outer = m.subroots.select(F.lit(0).cast("long").alias("grp"), "pos", "n", F.col("grp").alias("inner_grp"), F.col("root").alias("subroot"))
    subs = _down(outer, m.outer.levels, top, m.fanout).select(F.col("inner_grp").alias("grp"), F.struct("subroot", "root").alias("root"), "path")
    leaves = _down(m.leaves, m.inner.levels, subs, m.fanout)
    kept = [c for c in m.leaves.columns if c not in ("grp", "pos", "n", "digest")]
    return leaves.select(*kept, F.col("digest").alias("leaf"), F.col("root.subroot").alias("subroot"), F.col("root.root").alias("root"), "path")


def tamper_check(df: DataFrame, columns: list[str], changed: dict[str, Column], when: Column, id_col: str = "doc_id", group: str = "source", fanout: int = FANOUT) -> DataFrame:
    """``id_col``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``: a row per row of ``df``.

    Leaves are digests of ``columns``. Where ``when`` holds (null: it doesn't) the row is tampered with: ``changed`` gives what
    its columns become. ``folded_root`` is what the row as it now is leads to by the untampered siblings; ``verified`` tells
    whether that is the root. ``proof_sha256`` is the digest of the siblings' digests.
    """
    now = F.when(F.coalesce(when, F.lit(False)), leaf_digest(*[changed.get(c, F.col(c)) for c in columns]))
    m = build(df, leaf_digest(*[F.col(c) for c in columns]), group, [id_col], {"tampered_leaf": now}, fanout)
    out = proofs(m).withColumn("folded_root", fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return out.select(id_col, "leaf", "subroot", "root", run_digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
