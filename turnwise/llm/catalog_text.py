"""Queries of the operators over document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.common import LOWER, UPPER, source_table
from turnwise.llm.decontaminate import WINDOW, WORDS_SQL, decontaminate
from turnwise.llm.quotes import ATTRIBUTION, MARKS, reply_conversations
from turnwise.llm.registry import query
from turnwise.llm.simhash import near_duplicates

_CUT = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS_SQL}')"

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {_CUT} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_CUT} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS s FROM i WHERE len(w) > 0)
),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, ns WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, dw.n, s, item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op10_decontaminate", DECONTAMINATE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(source_table(spark, sf_dir, "documents"), source_table(spark, sf_dir, "benchmark"))


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(source_table(spark, sf_dir, "documents"))


_NORMAL = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

REPLY_ORDER_SQL = rf"""
WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) - 1 AS pos, coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
),
split AS (SELECT conv, pos, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS lines FROM m),
cut AS (SELECT conv, pos, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM split),
marked AS (SELECT *, regexp_extract(line, '{MARKS}', 0) AS marks FROM cut),
l0 AS (SELECT conv, pos, i, line, CAST(length(marks) - length(replace(marks, '>', '')) AS INT) AS level, substr(line, length(marks) + 1) AS content FROM marked),
l AS (
  SELECT *, regexp_matches(line, '{ATTRIBUTION}') AND (coalesce(lead(level) OVER w, 0) > level OR (trim(coalesce(lead(content) OVER w, 'x')) = '' AND coalesce(lead(level, 2) OVER w, 0) > level)) AS attribution,
         coalesce(level <> lag(level) OVER w, true) AS opens
  FROM l0 WINDOW w AS (PARTITION BY conv, pos ORDER BY i)
),
body AS (SELECT conv, pos, regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT attribution), ''), '^\s+|\s+$', '', 'g') AS body FROM l GROUP BY conv, pos),
runs AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY conv, pos ORDER BY i) AS passage FROM l),
passages AS (SELECT conv, pos, passage, level, string_agg(content, chr(10) ORDER BY i) AS text FROM runs WHERE level > 0 GROUP BY ALL),
quoted AS (
  SELECT conv, pos, passage, level, unit, length(unit) AS size
  FROM (SELECT conv, pos, passage, level, unnest(list_distinct(list_transform([text] || string_split_regex(text, '\n\s*\n') || string_split_regex(text, '\n'), lambda x: {_NORMAL.format("x")}))) AS unit FROM passages) WHERE unit <> ''
),
said AS (
  SELECT DISTINCT conv, pos, unit FROM (SELECT conv, pos, unnest(list_transform([body] || string_split_regex(body, '\n\s*\n') || string_split_regex(body, '\n'), lambda x: {_NORMAL.format("x")})) AS unit FROM body) WHERE unit <> ''
),
origins AS (SELECT q.*, (SELECT max(s.pos) FROM said s WHERE s.conv = q.conv AND s.unit = q.unit AND s.pos < q.pos) AS origin FROM quoted q),
linked AS (SELECT conv, pos, passage, level, arg_max(origin, (size, origin)) FILTER (WHERE origin IS NOT NULL) AS parent FROM origins GROUP BY ALL),
per AS (SELECT conv, pos, arg_max(parent, (-level, -passage)) FILTER (WHERE parent IS NOT NULL) AS quoted, count(*) AS n_passages, count(parent) AS n_linked FROM linked GROUP BY conv, pos),
edges AS (
  SELECT conv, m.pos, coalesce(quoted, CASE WHEN m.pos > 0 THEN m.pos - 1 END) AS parent, quoted IS NOT NULL AS linked, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked
  FROM m LEFT JOIN per USING (conv, pos)
),
walk AS (
  SELECT conv, pos, [pos] AS path FROM edges WHERE parent IS NULL
  UNION ALL SELECT e.conv, e.pos, w.path || [e.pos] FROM walk w JOIN edges e ON e.conv = w.conv AND e.parent = w.pos
)
SELECT m.conv_id, m.turn, m.role, row_number() OVER (PARTITION BY conv ORDER BY path) - 1 AS position, CAST(len(path) - 1 AS BIGINT) AS depth, p.turn AS parent_turn, linked, n_passages, n_linked, body
FROM m JOIN edges USING (conv, pos) JOIN walk USING (conv, pos) JOIN body USING (conv, pos) LEFT JOIN m p ON p.conv = m.conv AND p.pos = edges.parent
"""


@query("op7_reply_order", REPLY_ORDER_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_conversations(source_table(spark, sf_dir, "conversations"))
