"""Knowledge-graph queries: over extracted entities, and over the star schema's region, nation, customer and supplier edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import extract as X
from quarrylight.operators import graph as G
from quarrylight.queries.base import query, read
from quarrylight.queries.extract import ENT, SRC, graph_source

_E = ENT.replace("GROUP BY ALL HAVING", "GROUP BY doc_id, 2, type HAVING")
_ID = "'entity-' || substring(sha256(normalized || '|' || type), 1, 18)"
BASE = f"WITH {SRC}, {_E}, m AS (SELECT DISTINCT {_ID} AS entity_id, doc_id FROM e), n AS (SELECT {_ID} AS entity_id, normalized, type, min(name) AS name, max(confidence) AS confidence FROM e GROUP BY normalized, type)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.entities(graph_source(spark, sf_dir))


@query("kg_entities", BASE + " SELECT * FROM n")
def kg_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.entity_table(found(spark, sf_dir))


@query("kg_mentions", BASE + " SELECT * FROM m")
def kg_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mention_table(found(spark, sf_dir))


@query("kg_shared_entities", BASE + " SELECT entity_id, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1 HAVING n_docs >= 2")
def kg_shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_entities(kg_mentions(spark, sf_dir))


@query("kg_context", BASE + " SELECT doc_id, count(*) AS n_entities, string_agg(DISTINCT name, ',' ORDER BY name) AS entities FROM m JOIN n USING (entity_id) GROUP BY doc_id")
def kg_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found(spark, sf_dir)
    return G.context(G.mention_table(f), G.entity_table(f))


@query("graph_chunks", BASE + ", s AS (SELECT m.entity_id, m.doc_id, length(src.text) AS n_chars, row_number() OVER (PARTITION BY m.entity_id ORDER BY length(src.text) DESC, m.doc_id) AS rank FROM m JOIN src USING (doc_id)) SELECT entity_id, doc_id, n_chars, rank::INT AS rank, 0.82::DOUBLE AS score FROM s WHERE rank <= 3")
def graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each entity the three longest texts that mention it."""
    from pyspark.sql import Window

    m = kg_mentions(spark, sf_dir).join(graph_source(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars")), "doc_id")
    w = Window.partitionBy("entity_id").orderBy(F.desc("n_chars"), "doc_id")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("entity_id", "doc_id", "n_chars", "rank", F.lit(0.82).alias("score"))


GONE = ", gone AS (SELECT doc_id + 1000 AS doc_id FROM documents WHERE source = 'src3'), kept AS (SELECT * FROM m WHERE doc_id NOT IN (SELECT doc_id FROM gone))"


def gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one source, which are deleted from the graph."""
    return read(spark, sf_dir, "documents").where("source = 'src3'").select((F.col("doc_id") + 1000).alias("doc_id"))


@query("kg_orphans", BASE + GONE + " SELECT entity_id, name FROM n WHERE entity_id NOT IN (SELECT entity_id FROM kept)")
def kg_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities left alone once a source's documents are deleted."""
    f = found(spark, sf_dir)
    left = G.without_document(G.mention_table(f), gone(spark, sf_dir))
    none = spark.createDataFrame([], "src string, dst string")
    return G.orphans(G.entity_table(f), left, none).select("entity_id", "name")


@query("kg_document_cascade", BASE + GONE + " SELECT doc_id, count(*) AS n_mentions FROM kept GROUP BY doc_id")
def kg_document_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.without_document(kg_mentions(spark, sf_dir), gone(spark, sf_dir))
    return m.groupBy("doc_id").agg(F.count("*").alias("n_mentions"))


EDGES = """edges AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
nodes AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 'c' || c_custkey, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""


def star(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: read(spark, sf_dir, name)
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("nation").select(k("n", "n_nationkey").alias("src"), k("r", "n_regionkey").alias("dst")).union(t("customer").select(k("c", "c_custkey"), k("n", "c_nationkey"))).union(t("supplier").select(k("s", "s_suppkey"), k("n", "s_nationkey")))
    nodes = t("nation").select(k("n", "n_nationkey").alias("id"), F.col("n_name").alias("name")).union(t("region").select(k("r", "r_regionkey"), "r_name")).union(t("customer").select(k("c", "c_custkey"), "c_name")).union(t("supplier").select(k("s", "s_suppkey"), "s_name"))
    return edges.distinct(), nodes


@query("kg_neighbors", f"WITH {EDGES} SELECT node, neighbour, direction, name FROM (SELECT src AS node, dst AS neighbour, 'out' AS direction FROM edges UNION ALL SELECT dst, src, 'in' FROM edges) JOIN nodes ON id = neighbour")
def kg_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(*star(spark, sf_dir))


@query(
    "kg_bfs2",
    f"""WITH RECURSIVE {EDGES}, both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION ALL SELECT seed, dst, hops + 1 FROM walk JOIN both_ ON node = src WHERE hops < 2)
SELECT seed, node, min(hops)::INT AS hops FROM walk GROUP BY seed, node""",
)
def kg_bfs2(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = star(spark, sf_dir)
    return G.reach(edges, nodes.where(F.col("id").startswith("r")).select("id"), 2)
