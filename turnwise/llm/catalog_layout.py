"""Queries of the operators that choose, place and find rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import gnat
from turnwise.llm.common import BLANK_SEPARATED, source_table
from turnwise.llm.mixing import BITS, mixed
from turnwise.llm.registry import query
from turnwise.llm.sharding import TABLE_SIZE, filled_table, placed
from turnwise.llm.topk import EVERY, K, SCALE, top_k

_UNIT = 1 << BITS

MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{BLANK_SEPARATED}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
c AS (SELECT *, source_size * 2 AS cap, CAST(source_size * 2 AS DOUBLE) / weight AS ratio FROM w),
o AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS capped, coalesce(sum(weight) OVER before, 0) AS passed,
         (SELECT sum(source_size) FROM c) AS all_sizes, (SELECT sum(weight) FROM c) AS all_weights
  FROM c WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
l AS (SELECT *, (1.5::DOUBLE * all_sizes - capped) / (all_weights - passed) AS level FROM o),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM c
),
e AS (
  SELECT d.doc_id, d.source, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size * {_UNIT}::DOUBLE) AS BIGINT) ELSE 0 END AS expected,
         CAST('0x' || substr(md5('mix/' || coalesce('s:' || d.source, 'null')), 1, {BITS // 4}) AS BIGINT) AS shift
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
p AS (
  SELECT *, CAST((coalesce(sum(expected) OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + shift) % {_UNIT} AS BIGINT) AS start
  FROM e
)
SELECT doc_id, source, size, source_size, target, (start + expected) // {_UNIT} AS copies, (start + expected) // {_UNIT} * size AS taken FROM p
"""


@query("op1_mix", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(source_table(spark, sf_dir, "documents")).drop("text_digest")


TOP_K_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v AS q, v AS c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {K}
"""


@query("op6_top_k", TOP_K_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(source_table(spark, sf_dir, "embeddings"))


SHARD_SQL = f"""
WITH slots AS (
  SELECT unnest(generate_series(0, {TABLE_SIZE - 1})) AS slot, CAST(unnest(string_split('{",".join(map(str, filled_table()))}', ',')) AS INT) AS number
),
d AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(text), 'none')), 1, 15) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents
)
SELECT doc_id, CAST(d.slot AS INT) AS slot, 'shard-' || lpad(CAST(number AS VARCHAR), 3, '0') AS shard FROM d JOIN slots USING (slot)
"""


@query("op9_shard", SHARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(source_table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % {gnat.SHIFTED} = 0 THEN (label + 1) % {gnat.LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {gnat.SCALE}) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v AS a, v AS c WHERE a.vec_id % {gnat.ANCHORS} = 0 AND c.vec_id <> a.vec_id AND len(a.x) = len(c.x)
),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.r ORDER BY s.score DESC, s.vec_id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE p.r <= {gnat.POSITIVES} AND {gnat.LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {gnat.HIGH} * positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE r <= {gnat.NEGATIVES}
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gnat.hard_negatives(source_table(spark, sf_dir, "embeddings"))
