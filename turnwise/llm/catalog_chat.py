"""Queries of the operators on conversations that edit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.common import BLANK_SEPARATED, source_table
from turnwise.llm.registry import query
from turnwise.llm.repair import CHANGE, DELETE, FINAL, INSERT, KEEP, NAMES, STATES, TURN, repair_damaged

_NOT_BLANK = BLANK_SEPARATED.removesuffix("+")


def _value(cost: str, letter: str, text: str, state: int, source: str) -> str:
    v = f"{source}{state}"
    return f"{{'c': {v}.c + {cost}, 'a': '{letter}' || {v}.a, 't': {text} || {v}.t}}"


def _edits(state: int) -> str:
    """The best value of a state in front of a row, without insertions: deletion, keeping and another role."""
    kept = [f"WHEN ini = '{'sua'[i]}' THEN {_value('extra', 'K', line, KEEP[state][i], 'v')}" for i in range(3) if KEEP[state][i] is not None for line in ["role || ':' || text || chr(10)"]]
    keep = f"CASE WHEN NOT lost THEN CASE {' '.join(kept)} END END"
    turn = f"CASE WHEN NOT lost THEN {_value(f'{CHANGE} + extra', 'R', f"'{NAMES[TURN[state]]}:' || text || chr(10)", TURN[state], 'v')} END"
    return f"list_sort(list_filter([{_value(str(DELETE), 'D', "''", state, 'v')}, {keep}, {turn}], lambda x: x IS NOT NULL))[1]"


def _inserted(state: int) -> str:
    """The same with up to two insertions in front."""
    empty = lambda s: f"'{NAMES[TURN[s]]}:' || chr(10)"
    once, twice = TURN[state], TURN[TURN[state]]
    return f"list_sort([n{state}, {_value(str(INSERT), 'I', empty(state), once, 'n')}, {_value(str(2 * INSERT), 'II', f'{empty(state)} || {empty(once)}', twice, 'n')}])[1]"


def _ends(state: int) -> str:
    edits, lines = "", []
    while state not in FINAL:
        edits, lines, state = edits + "I", [*lines, f"'{NAMES[TURN[state]]}:' || chr(10)"], TURN[state]
    return f"{{'c': CAST({INSERT * len(edits)} AS BIGINT), 'a': '{edits}', 't': {' || '.join(lines) or "''"}}}"


_EACH = lambda make, name: ", ".join(f"{make(s)} AS {name}{s}" for s in STATES)

REPAIR_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
),
g AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
),
k AS (
  SELECT g.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM g, crc
),
d AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM k WHERE kind <> 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM d),
f AS (
  SELECT *, left(role, 1) AS ini, regexp_matches(text, '{_NOT_BLANK}') AS said, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS again,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ('.', '!', '?') AS ended
  FROM p
),
r AS (
  SELECT conv, turn, pos, role, text, ini, NOT said AS blank, said AND again AS duplicate, said AND NOT again AND NOT ended AS truncated,
         lag(ini) OVER (PARTITION BY conv ORDER BY pos) || ini NOT IN ('su', 'ua', 'au') AS illegal, NOT said OR again AS lost,
         CASE WHEN said AND NOT again AND NOT ended THEN 1 ELSE 0 END AS extra
  FROM f
),
b AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv
),
v(conv, pos, v0, v1, v2, v3) AS (
  SELECT conv, n + 1, {", ".join(_ends(s) for s in STATES)} FROM b
  UNION ALL
  SELECT conv, pos, {", ".join(_inserted(s) for s in STATES)}
  FROM (SELECT r.conv, r.pos, {_EACH(_edits, "n")} FROM v JOIN r ON r.conv = v.conv AND r.pos = v.pos - 1)
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(left(v0.t, greatest(len(v0.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM g) AS o LEFT JOIN b ON b.conv = o.conv LEFT JOIN v ON v.conv = o.conv AND v.pos = 1
"""


@query("op11_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(source_table(spark, sf_dir, "conversations"))
