"""The knowledge graph: entities, mentions and relations as three tables, built when documents are ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_id(prefix: str, *parts: str):
    """A stable id: the prefix and 18 hex digits of the parts' SHA-256."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 18))


def entity_table(found: DataFrame) -> DataFrame:
    """``entity_id``, ``name``, ``normalized``, ``type``, ``confidence`` of extracted entities over all documents; the largest confidence counts."""
    return found.groupBy("normalized", "type").agg(F.min("name").alias("name"), F.max("confidence").alias("confidence")).withColumn("entity_id", node_id("entity", "normalized", "type"))


def mention_table(found: DataFrame) -> DataFrame:
    """``entity_id``, ``doc_id``."""
    return found.select(node_id("entity", "normalized", "type").alias("entity_id"), "doc_id").distinct()


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the one with the largest ``order`` of each key: aggregated map-side, so a key with many versions is no hot spot."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*key, "x.*")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``neighbour``, ``name``, ``direction`` of (``src``, ``dst``) edges, both ways, with the neighbour's name."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("in").alias("direction"))
    return out.unionByName(back).distinct().join(nodes.select(F.col("id").alias("neighbour"), "name"), "neighbour")


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed``, ``node``, ``hops`` of everything within ``depth`` hops, each node at its smallest distance; a visited pair is not expanded again."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(both, frontier.node == both.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def orphans(nodes: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that neither a mention nor a relation names: three anti-joins."""
    left = nodes.join(mentions.select("entity_id"), "entity_id", "left_anti")
    left = left.join(edges.select(F.col("src").alias("entity_id")), "entity_id", "left_anti")
    return left.join(edges.select(F.col("dst").alias("entity_id")), "entity_id", "left_anti")


def without_document(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    return mentions.join(documents.select("doc_id"), "doc_id", "left_anti")


def shared_entities(mentions: DataFrame, min_docs: int = 2) -> DataFrame:
    """Entities that several documents name."""
    return mentions.groupBy("entity_id").agg(F.countDistinct("doc_id").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def context(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id``, ``n_entities``, ``entities`` (names in order, comma-joined)."""
    named = mentions.join(nodes.select("entity_id", "name"), "entity_id")
    return named.groupBy("doc_id").agg(F.count("*").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("entities"))
