"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe, embed_dedup, hnsw, html_text, langid, licenses, merkle, minhash, packing, pq, quality, sharding, warc
from quarrylight.llm.common import read, small_batches
from quarrylight.session import ship


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def ready(spark: SparkSession) -> None:
    ship(spark)
    small_batches(spark)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer())


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.where(fold("doc_id", 3) != 1))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return html_text.main_text(read(spark, sf_dir, "pages"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.QualityModel:
    return quality.fit(docs, labels.where(fold("doc_id", 5) != 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality_model(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    manifest, folder = warc.archive(read(spark, sf_dir, "pages"))
    got = warc.read_records(manifest, folder)
    return got.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("spans")


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return minhash.classes(read(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer())


#: Shards of op11_rendezvous: all of one weight, and one more.
SHARDS = [1.0] * 8
GROWN_SHARDS = [1.0] * 9


def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read(spark, sf_dir, "documents"), SHARDS, GROWN_SHARDS)


#: What a leaf of op12_merkle is made of, and the letters that tampering changes.
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(read(spark, sf_dir, "documents"), LEAF, {"text": F.translate("text", UPPER, LOWER)}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return pq.compress(read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_language_id": op2_language_id,
        "op3_main_text": op3_main_text,
        "op4_quality": op4_quality,
        "op5_warc": op5_warc,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_licenses": op7_licenses,
        "op8_probminhash": op8_probminhash,
        "op9_hnsw": op9_hnsw,
        "op10_best_fit": op10_best_fit,
        "op11_rendezvous": op11_rendezvous,
        "op12_merkle": op12_merkle,
        "op13_filtering_lloyd": op13_filtering_lloyd,
        "pipeline": pipeline,
    }


WARC_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to FROM f"""

EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= {embed_dedup.COSINE}),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id) LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a) USING (vec_id)"""


def _license_sql() -> str:
    """The scan of op7_licenses by a join of spelled-out runs."""
    kinds = [(label, text, True) for label, text in licenses.BASE] + [(label, text, False) for label, text in licenses.TEMPLATES]
    rows = ", ".join(f"({n}, '{label}', {exact}, {licenses.template_words(text)!r})" for n, (label, text, exact) in enumerate(kinds))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(tpl, label, exact, w)),
tg AS (SELECT tpl, label, exact, len(w) AS t_words, i - 1 AS tpos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d)),
votes AS (SELECT doc_id, tpl, label, exact, t_words, pos - tpos AS diagonal, list(DISTINCT tpos) AS spots FROM dg JOIN tg USING (run) GROUP BY ALL),
far AS (SELECT *, CASE WHEN exact OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) > {licenses.NEAR}, true) THEN 1 ELSE 0 END AS far FROM votes),
g AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal) AS grp FROM far),
m AS (SELECT doc_id, tpl, label, exact, t_words, grp, len(list_distinct(flatten(list(spots)))) / (t_words - 2) AS share, min(diagonal + list_min(spots)) AS first, max(diagonal + list_max(spots) + 2) AS last FROM g GROUP BY doc_id, tpl, label, exact, t_words, grp),
long AS (SELECT doc_id, tpl, grp FROM m WHERE NOT exact AND last - first + 1 > {licenses.STRETCH} * t_words),
p AS (SELECT a.doc_id, a.tpl, a.label, a.exact, a.t_words, len(list_distinct(flatten(list(b.spots)))) / (a.t_words - 2) AS share, min(b.diagonal + list_min(b.spots)) AS first, max(b.diagonal + list_max(b.spots) + 2) AS last
  FROM g a JOIN long USING (doc_id, tpl, grp) CROSS JOIN range(0, {licenses.NEAR} + 1) AS r(width) JOIN g b ON a.doc_id = b.doc_id AND a.tpl = b.tpl AND b.diagonal BETWEEN a.diagonal AND a.diagonal + r.width GROUP BY a.doc_id, a.tpl, a.label, a.exact, a.t_words, a.diagonal, r.width),
s AS (SELECT * FROM (SELECT * EXCLUDE (grp) FROM m UNION ALL FROM p) WHERE CASE WHEN exact THEN share = 1 ELSE share >= {licenses.COVER} AND last - first + 1 <= {licenses.STRETCH} * t_words END),
x AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(first) FILTER (exact) AS first_word, max(first) FILTER (exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN x USING (doc_id)"""


#: CRC-32 by bytes in SQL: ``crc_table`` is a relation of one row, crc_of() reads it.
CRC_TABLE = "(SELECT list(t ORDER BY n) AS crc_table FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM (SELECT unnest(range(256)) AS n)))"


def crc_of(text: str) -> str:
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {values}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"


RENDEZVOUS_SQL = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, {crc_of("coalesce(text, '')")} AS text_crc32, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') AS key FROM documents, {CRC_TABLE}),
t AS (SELECT *, list_transform(range({len(GROWN_SHARDS)}), lambda n: -ln((('0x' || substr(md5(n || '|' || key), 1, 13))::BIGINT + 0.5) / 4503599627370496)) AS times FROM d),
s AS (SELECT *, list_position(times[1:{len(SHARDS)}], list_min(times[1:{len(SHARDS)}]))::INTEGER - 1 AS shard, list_position(times, list_min(times))::INTEGER - 1 AS grown_shard FROM t)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM s"""


def _merkle_sql(inner: int = 7, outer: int = 5) -> str:
    """Levels written out: enough for 16^7 rows a source and 16^5 sources. A group of one node stays as it is."""
    leaf = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ["doc_id", "source", "lang", "n_chars", text]) + ")"
    parts = [
        f"d AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN {crc_of('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS bad FROM documents, {CRC_TABLE})",
        "r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "i0 AS (SELECT g, pos, n, leaf AS digest FROM r)",
    ]
    up = lambda own, below, g: f"{own} AS (SELECT {g}, pos // 16 AS pos, (max(n) + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE max(digest) END AS digest, CASE WHEN max(n) > 1 THEN list(digest ORDER BY pos) END AS run FROM {below} GROUP BY {g}, pos // 16)"
    parts += [up(f"i{k}", f"i{k - 1}", "g") for k in range(1, inner + 1)]
    parts += [f"o0 AS (SELECT 0 AS z, g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, digest FROM i{inner})"]
    parts += [up(f"o{k}", f"o{k - 1}", "z") for k in range(1, outer + 1)]
    join = "".join(f" JOIN i{k} ON i{k}.g IS NOT DISTINCT FROM r.g AND i{k}.pos = r.pos // {16 ** k}" for k in range(1, inner + 1)) + " JOIN o0 ON o0.g IS NOT DISTINCT FROM r.g" + "".join(f" JOIN o{k} ON o{k}.pos = o0.pos // {16 ** k}" for k in range(1, outer + 1))
    steps = [(f"i{k}.run", f"r.pos // {16 ** (k - 1)} % 16") for k in range(1, inner + 1)] + [(f"o{k}.run", f"o0.pos // {16 ** (k - 1)} % 16") for k in range(1, outer + 1)]
    before, after = (lambda run, at: f"array_to_string({run}[1:{at}], '')"), (lambda run, at: f"array_to_string({run}[{at} + 2:], '')")
    proof = " || ".join(f"CASE WHEN {run} IS NULL THEN '' ELSE {before(run, at)} || {after(run, at)} END" for run, at in steps)
    parts += [f"p AS (SELECT r.doc_id, r.leaf, i{inner}.digest AS subroot, o{outer}.digest AS root, sha256({proof}) AS proof_sha256, coalesce(r.bad, r.leaf) AS f0, {', '.join(f'{run} AS run{k}, {at} AS at{k}' for k, (run, at) in enumerate(steps))} FROM r{join})"]
    for k in range(len(steps)):
        parts += [f"f{k + 1} AS (SELECT * EXCLUDE (f0), CASE WHEN run{k} IS NULL THEN f0 ELSE sha256({before(f'run{k}', f'at{k}')} || f0 || {after(f'run{k}', f'at{k}')}) END AS f0 FROM {'p' if not k else f'f{k}'})"]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, f0 AS folded_root, f0 = root AS verified FROM f{len(steps)}"


def _pq_sql() -> str:
    """Rounds written out: every part against every entry."""
    parts = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, q, e[q * (len(e) // {pq.PARTS}) + 1:(q + 1) * (len(e) // {pq.PARTS})] AS x FROM v, (SELECT unnest(range({pq.PARTS})) AS q))",
        f"c0 AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {pq.ENTRIES}))",
    ]
    near = lambda k: f"a{k} AS (SELECT vec_id, label, q, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := entry)) AS best FROM p JOIN c{k} USING (q) GROUP BY vec_id, label, q)"
    for k in range(pq.ROUNDS):
        parts += [near(k), f"m{k} AS (SELECT q, entry, list(floor(s / n)::BIGINT ORDER BY place) AS c FROM (SELECT q, best.entry AS entry, place, sum(x[place]) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS place) GROUP BY ALL) GROUP BY q, entry)"]
        parts += [f"c{k + 1} AS (SELECT c{k}.q, c{k}.entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (q, entry))"]
    last = pq.ROUNDS
    parts += [near(last), f"r AS (SELECT vec_id, label, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY q) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY vec_id, label)"]
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY q, entry)) FROM c{last}) AS codebooks_sha256 FROM r"


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": WARC_SQL, "op6_embedding_dedup": EMBEDDING_SQL, "op7_licenses": _license_sql(), "op11_rendezvous": RENDEZVOUS_SQL, "op12_merkle": _merkle_sql(), "op13_filtering_lloyd": _pq_sql()}
