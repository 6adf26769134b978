"""The operators on their whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import ann, exact, jaccard, mixing, packing, quality, repeats, sharding, urls

SHARDS = [f"shard-{i:02d}" for i in range(48)]
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = jaccard.jaccard_join(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = mixing.quality_weights(table(spark, sf_dir, "labels"))
    return mixing.mix(table(spark, sf_dir, "documents"), weights).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.substring_dedup(table(spark, sf_dir, "documents"), columns="id, n_symbols, n_removed, kept_sha256")
    return out.withColumnsRenamed({"id": "doc_id", "n_symbols": "n_words"})


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.byte_dedup(table(spark, sf_dir, "documents"), columns="id, n_symbols, n_removed, n_spans, kept_sha256")
    return out.withColumnsRenamed({"id": "doc_id", "n_symbols": "n_bytes"})


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), RULES).withColumnRenamed("id", "page_id")


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_mixing, op3_quality, op4_packing, op5_exact_dedup, op6_substring_dedup, op7_sharding, op8_suffix_dedup, op9_nearest, op10_url_filter)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP2 = r"""
WITH q AS (SELECT doc_id AS qid, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':0'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / coalesce(w, 1.0::DOUBLE) AS key
  FROM documents LEFT JOIN q ON doc_id = qid),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM s),
l AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE * 150 / 100.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS room,
         sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM o),
f AS (SELECT n AS fn, room AS fr, share AS fs FROM l WHERE room / share * weight < cap ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN fn IS NULL OR n < fn THEN cap ELSE weight * fr / fs END AS target FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
b AS (SELECT *, round(target - whole * source_size)::BIGINT AS budget FROM p)
SELECT doc_id, size, source_size, target,
       (size * whole + greatest(0, least(size, budget - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

OP10 = r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(v, length(h || q)) AS v FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

OP9 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


# The table of slots is written out, one letter for each slot; the tests fill it anew by brute force.
_LETTERS = "".join(chr(65 + s) for s in sharding.lookup_table(SHARDS))
OP7 = f"""
WITH d AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents),
t AS (SELECT '{_LETTERS}' AS letters)
SELECT d.*, 'shard-' || lpad((ascii(substr(letters, slot + 1, 1)) - 65)::VARCHAR, 2, '0') AS shard FROM d, t
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op7_sharding": OP7, "op5_exact_dedup": OP5, "op9_nearest": OP9, "op10_url_filter": OP10}
