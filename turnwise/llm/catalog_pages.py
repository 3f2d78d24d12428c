"""Queries of the operators on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.common import source_table
from turnwise.llm.registry import query
from turnwise.llm.warc import REVISIT_BYTES, archive

WARC_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, url, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
r AS (
  SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS first_page
  FROM d WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN place > 1 AND payload_bytes >= {REVISIT_BYTES} THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN place > 1 AND payload_bytes >= {REVISIT_BYTES} THEN first_page END AS refers_to
FROM r
"""


@query("op13_warc", WARC_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(source_table(spark, sf_dir, "pages")).drop("target_uri", "intact")
