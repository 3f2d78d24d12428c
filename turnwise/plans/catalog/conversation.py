"""Conversations: groups, turns, replies, tool calls, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import atoms as atom_ops
from turnwise.operators import turns as turn_ops
from turnwise.plans.catalog.registry import query
from turnwise.session import materialize
from turnwise.sources import bridge


def atoms_sql(gaps: bool = False) -> str:
    origin = "WHEN role = 'user' AND length(text) % 5 = 0 THEN 'injected_user_shaped' " if gaps else ""
    visible = "NOT (role = 'assistant' AND (conv_id + turn) % 3 = 0)" if gaps else "true"
    return f"""
    atoms AS (
      SELECT 'sess:conv:' || conv_id AS session_ref, turn AS pos, 'a:' || conv_id || ':' || turn AS atom_id, role AS actor_kind,
             CASE {origin}WHEN role = 'user' THEN 'user_authored' WHEN role = 'assistant' THEN 'assistant_authored'
                  ELSE 'source_instruction' END AS origin_kind,
             strftime(epoch_ms(1704067200000 + conv_id * 3600000 + turn * 60000), '%Y-%m-%dT%H:%M:%S.%gZ') AS time_key,
             text, CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 3) END AS model, {visible} AS visible
      FROM conversations)"""


GROUPS_SQL = """
    c1 AS (SELECT *, actor_kind = 'user' AS is_user, actor_kind = 'assistant' AND visible AS is_reply,
                  sum(CASE WHEN actor_kind = 'assistant' AND visible THEN 1 ELSE 0 END) OVER w AS replies_so_far,
                  sum(CASE WHEN actor_kind = 'user' THEN 1 ELSE 0 END) OVER w AS users_so_far
           FROM atoms WINDOW w AS (PARTITION BY session_ref ORDER BY pos)),
    c2 AS (SELECT *, is_user AND (users_so_far = 1 OR origin_kind = 'user_authored') AS is_anchor FROM c1),
    c3 AS (SELECT *, lag(CASE WHEN is_anchor THEN replies_so_far END IGNORE NULLS) OVER (PARTITION BY session_ref ORDER BY pos)
                  AS replies_at_anchor FROM c2),
    c4 AS (SELECT *, CASE WHEN is_user AND (users_so_far = 1 OR (origin_kind = 'user_authored' AND replies_so_far > replies_at_anchor))
                  THEN 1 ELSE 0 END AS starts FROM c3),
    tagged AS (SELECT *, sum(starts) OVER (PARTITION BY session_ref ORDER BY pos) - 1 AS group_index FROM c4)"""

TOOLS_SQL = """
    ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
    atoms AS (SELECT 'sess:ev:' || user_id AS session_ref, event_id AS pos, 'a:' || event_id AS atom_id, event_type, k,
                     CASE WHEN event_type IN ('view','click') THEN 'tool' WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END AS actor_kind,
                     event_type NOT IN ('view','click') AS is_text, event_type <> 'error' AS visible,
                     CASE WHEN event_type = 'signup' THEN 'user_authored' ELSE 'x' END AS origin_kind,
                     strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS time_key
              FROM ev)"""

TOOL_GROUPS_SQL = TOOLS_SQL + """,
    t1 AS (SELECT *, actor_kind = 'user' AS is_user, actor_kind = 'assistant' AND visible AS is_reply FROM atoms),
    t2 AS (SELECT *, sum(CASE WHEN is_reply THEN 1 ELSE 0 END) OVER (PARTITION BY session_ref ORDER BY pos) AS replies_so_far FROM t1),
    t3 AS (SELECT *, lag(CASE WHEN is_user THEN replies_so_far END IGNORE NULLS) OVER (PARTITION BY session_ref ORDER BY pos) AS at_anchor FROM t2),
    t4 AS (SELECT *, CASE WHEN is_user AND (at_anchor IS NULL OR replies_so_far > at_anchor) THEN 1 ELSE 0 END AS starts FROM t3),
    tagged AS (SELECT *, sum(starts) OVER (PARTITION BY session_ref ORDER BY pos) - 1 AS group_index FROM t4)"""


def tagged_conversations(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    return materialize(turn_ops.tag_groups(bridge.conversation_atoms(spark, sf_dir, gaps)), "tagged")


def tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(turn_ops.tag_groups(bridge.event_atoms(spark, sf_dir)), "tagged")


@query(
    "atomize_order",
    f"""WITH {TOOLS_SQL}
    SELECT 'ev-' || session_ref AS session_ref, atom_id AS fragment_id,
           row_number() OVER (PARTITION BY session_ref ORDER BY left(time_key, 13), k, pos) - 1 AS pos,
           CASE WHEN event_type IN ('view','click') THEN 'tool' WHEN event_type = 'signup' THEN 'user' ELSE 'assistant' END AS actor_kind,
           CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' ELSE 'text' END AS content_kind
    FROM atoms WHERE event_type <> 'error'""",
)
def atomize_order(spark, sf_dir):
    # Hour-wide time keys make many fragments share one, so that the order rests on seq_no and the record.
    kind = F.col("event_type")
    fragments = bridge.events(spark, sf_dir).select(
        F.concat(F.lit("a:"), F.col("event_id")).alias("fragment_id"),
        F.lit("ev").alias("source_id"),
        F.lit("generic").alias("source_platform"),
        F.concat(F.lit("ev-sess:ev:"), F.col("user_id")).alias("session_ref"),
        F.lit("b").alias("blob_id"),
        F.concat(F.lit("r:"), F.col("event_id")).alias("record_id"),
        F.col("event_id").alias("ordinal"),
        F.col("k").alias("seq_no"),
        F.when(kind == "view", "tool_call")
        .when(kind == "click", "tool_result")
        .when(kind == "error", "session_meta")
        .otherwise("text")
        .alias("fragment_kind"),
        F.when(kind == "signup", "user").alias("actor_kind"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH"), F.lit(":00:00.000Z")).alias("time_key"),
    )
    from turnwise.schemas import FRAGMENT, complete

    return atom_ops.atomize(complete(fragments, FRAGMENT)).select("session_ref", "fragment_id", "pos", "actor_kind", "content_kind")


@query(
    "edges_tool_result",
    f"""WITH {TOOLS_SQL},
    seen AS (SELECT *, lag(CASE WHEN event_type = 'view' THEN atom_id END IGNORE NULLS)
                    OVER (PARTITION BY session_ref, k ORDER BY pos) AS call_atom
             FROM atoms WHERE event_type IN ('view', 'click'))
    SELECT session_ref, atom_id AS from_atom_id, call_atom AS to_atom_id, 'tool_result_for' AS edge_kind,
           sha1('edge::ev::' || session_ref || '::' || atom_id || '::' || call_atom || '::tool_result_for') AS edge_id
    FROM seen WHERE event_type = 'click' AND call_atom IS NOT NULL""",
)
def edges_tool_result(spark, sf_dir):
    edges = atom_ops.edges_tool_result(bridge.event_atoms(spark, sf_dir))
    return edges.select("session_ref", "from_atom_id", "to_atom_id", "edge_kind", "edge_id")


@query(
    "edges_spawned_from",
    f"""WITH {TOOLS_SQL},
    seen AS (SELECT *, lag(CASE WHEN actor_kind = 'assistant' THEN atom_id END IGNORE NULLS)
                    OVER (PARTITION BY session_ref ORDER BY pos) AS text_atom FROM atoms)
    SELECT session_ref, atom_id AS from_atom_id, text_atom AS to_atom_id, 'spawned_from' AS edge_kind
    FROM seen WHERE event_type = 'view' AND text_atom IS NOT NULL""",
)
def edges_spawned_from(spark, sf_dir):
    edges = atom_ops.edges_spawned_from(bridge.event_atoms(spark, sf_dir))
    return edges.select("session_ref", "from_atom_id", "to_atom_id", "edge_kind")


@query(
    "submission_groups",
    f"""WITH {atoms_sql(True)}, {GROUPS_SQL}
    SELECT session_ref, group_index, count(*) FILTER (is_user) AS atom_count,
           count(*) FILTER (is_user AND origin_kind = 'user_authored') AS authored_count,
           min(time_key) FILTER (is_user) AS started_at, max(time_key) FILTER (is_user) AS ended_at, bool_or(is_reply) AS assistant_seen
    FROM tagged WHERE group_index >= 0 GROUP BY session_ref, group_index""",
)
def submission_groups(spark, sf_dir):
    tagged = turn_ops.tag_groups(bridge.conversation_atoms(spark, sf_dir, gaps=True))
    return turn_ops.submission_groups(tagged).select(
        "session_ref", "group_index", "atom_count", "authored_count", "started_at", "ended_at", "assistant_seen"
    )


@query(
    "submission_edges",
    f"""WITH {atoms_sql(True)}, {GROUPS_SQL},
    users AS (SELECT session_ref, atom_id, lag(atom_id) OVER (PARTITION BY session_ref, group_index ORDER BY pos) AS prior FROM tagged WHERE is_user)
    SELECT session_ref, atom_id AS from_atom_id, prior AS to_atom_id, kind AS edge_kind
    FROM users, (VALUES ('same_submission'), ('continuation_of')) v(kind) WHERE prior IS NOT NULL""",
)
def submission_edges(spark, sf_dir):
    edges = turn_ops.edges_submission(tagged_conversations(spark, sf_dir))
    return edges.select("session_ref", "from_atom_id", "to_atom_id", "edge_kind")


@query(
    "context_spans",
    f"""WITH {TOOL_GROUPS_SQL}
    SELECT session_ref, group_index, atom_id, sha1('turn::ev::' || session_ref || '::' || group_index) AS turn_id
    FROM tagged WHERE group_index >= 0 AND NOT is_user""",
)
def context_spans(spark, sf_dir):
    spans = turn_ops.context_spans(turn_ops.tag_groups(bridge.event_atoms(spark, sf_dir)))
    return spans.select("session_ref", "group_index", "atom_id", "turn_id")


_TURN_TEXT = r"trim(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || ' ')"


@query(
    "user_turns",
    f"""WITH {atoms_sql(True)}, {GROUPS_SQL},
    per AS (SELECT session_ref, group_index, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (is_user) AS raw_text,
                   string_agg(nullif({_TURN_TEXT}, ''), chr(10) || chr(10) ORDER BY pos) FILTER (is_user AND origin_kind = 'user_authored') AS canonical_text,
                   count(*) FILTER (is_user) AS message_count, min(time_key) FILTER (is_user) AS submission_started_at,
                   max(time_key) AS last_context_activity_at_any,
                   coalesce(max(CASE WHEN is_reply THEN time_key END), max(CASE WHEN is_user THEN time_key END)) AS last_context_activity_at,
                   count(*) FILTER (is_reply) AS assistant_reply_count,
                   arg_min(model, pos) FILTER (is_reply) AS primary_model,
                   bool_or(is_user AND origin_kind = 'user_authored') AS authored
            FROM tagged WHERE group_index >= 0 GROUP BY session_ref, group_index)
    SELECT sha1('turn::conv::' || session_ref || '::' || group_index) AS turn_id, session_ref, group_index, raw_text, canonical_text, message_count,
           submission_started_at, last_context_activity_at, assistant_reply_count, primary_model,
           CASE WHEN assistant_reply_count = 0 THEN 'no_assistant_reply' END AS zero_token_reason
    FROM per WHERE authored""",
)
def user_turns(spark, sf_dir):
    tagged = tagged_conversations(spark, sf_dir)
    return turn_ops.turns_with_context(tagged).select(
        "turn_id",
        "session_ref",
        "group_index",
        "raw_text",
        "canonical_text",
        "message_count",
        "submission_started_at",
        "last_context_activity_at",
        "assistant_reply_count",
        "primary_model",
        "zero_token_reason",
    )


@query(
    "last_activity",
    f"""WITH {TOOL_GROUPS_SQL}
    SELECT session_ref, group_index,
           coalesce(arg_max(time_key, pos) FILTER (NOT is_user AND visible), arg_max(time_key, pos) FILTER (is_user)) AS last_context_activity_at
    FROM tagged WHERE group_index >= 0 GROUP BY session_ref, group_index""",
)
def last_activity(spark, sf_dir):
    tagged = turn_ops.tag_groups(bridge.event_atoms(spark, sf_dir))
    return turn_ops.last_activity(tagged).select("session_ref", "group_index", "last_context_activity_at")


@query(
    "assistant_replies",
    f"""WITH {TOOL_GROUPS_SQL},
    r AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'm' || (k % 5) END AS own FROM tagged WHERE group_index >= 0 AND is_reply)
    SELECT session_ref, group_index, atom_id,
           row_number() OVER (PARTITION BY session_ref, group_index ORDER BY pos) - 1 AS reply_index,
           own AS model, event_type || ' ' || k AS content, time_key AS created_at
    FROM r""",
)
def assistant_replies(spark, sf_dir):
    replies = turn_ops.assistant_replies(tagged_events(spark, sf_dir))
    return replies.select("session_ref", "group_index", "atom_id", "reply_index", "model", "content", "created_at")


@query(
    "system_messages",
    """WITH sys AS (SELECT conv_id, turn, text,
              lag(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS after_user,
              lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, role FROM conversations)
    SELECT 'sess:conv:' || conv_id AS session_ref, 'notice ' || text AS content,
           row_number() OVER (PARTITION BY conv_id, after_user ORDER BY turn) - 1 AS sequence
    FROM sys WHERE role = 'assistant' AND after_user IS NOT NULL AND turn % 2 = 1""",
)
def system_messages(spark, sf_dir):
    # Odd assistant rows are re-labelled as system notices, so that notices occur inside contexts.
    atoms = bridge.conversation_atoms(spark, sf_dir)
    notice = (F.col("actor_kind") == "assistant") & (F.col("pos") % 2 == 1)
    atoms = atoms.withColumns(
        {
            "text": F.when(notice, F.concat(F.lit("notice "), F.col("text"))).otherwise(F.col("text")),
            "actor_kind": F.when(notice, "system").otherwise(F.col("actor_kind")),
        }
    )
    # Every prompt keeps its own group here: the origin platform opens a group per authored prompt.
    atoms = atoms.withColumn("source_platform", F.lit("antigravity"))
    return turn_ops.system_messages(turn_ops.tag_groups(atoms)).select("session_ref", "content", "sequence")


@query(
    "tool_calls",
    f"""WITH {TOOL_GROUPS_SQL},
    ctx AS (SELECT * FROM tagged WHERE group_index >= 0 AND NOT is_user),
    spawn AS (SELECT *, lag(CASE WHEN actor_kind = 'assistant' THEN struct_pack(a := atom_id, g := group_index, v := visible) END IGNORE NULLS)
                     OVER (PARTITION BY session_ref ORDER BY pos) AS s FROM tagged),
    match AS (SELECT *, lag(CASE WHEN event_type = 'view' THEN atom_id END IGNORE NULLS)
                     OVER (PARTITION BY session_ref, k ORDER BY pos) AS call_atom FROM tagged WHERE event_type IN ('view', 'click')),
    result AS (SELECT call_atom, arg_min(atom_id, pos) AS result_atom, arg_min(group_index, pos) AS result_group
               FROM match WHERE event_type = 'click' AND call_atom IS NOT NULL GROUP BY call_atom),
    last_reply AS (SELECT session_ref, group_index, arg_max(atom_id, pos) AS last_atom FROM ctx WHERE is_reply GROUP BY 1, 2)
    SELECT c.session_ref, c.group_index, c.atom_id, 'tool' || (c.k % 5) AS tool_name,
           row_number() OVER (PARTITION BY c.session_ref, c.group_index ORDER BY c.pos) - 1 AS sequence,
           CASE WHEN r.result_group = c.group_index THEN 'out ' || substr(r.result_atom, 3) END AS output,
           CASE WHEN coalesce(CASE WHEN c.s.g = c.group_index AND c.s.v THEN c.s.a END, l.last_atom) IS NULL
                THEN sha1('assistant-reply::' || c.session_ref || '::synthetic')
                ELSE sha1('assistant-reply::ev::' || c.session_ref || '::' || coalesce(CASE WHEN c.s.g = c.group_index AND c.s.v THEN c.s.a END, l.last_atom))
           END AS reply_id
    FROM spawn c LEFT JOIN result r ON r.call_atom = c.atom_id
         LEFT JOIN last_reply l ON l.session_ref = c.session_ref AND l.group_index = c.group_index
    WHERE c.event_type = 'view' AND c.group_index >= 0""",
)
def tool_calls(spark, sf_dir):
    calls = turn_ops.tool_calls(tagged_events(spark, sf_dir))
    return calls.select("session_ref", "group_index", "atom_id", "tool_name", "sequence", "output", "reply_id")


@query(
    "context_summary",
    f"""WITH {TOOL_GROUPS_SQL}
    SELECT sha1('turn::ev::' || session_ref || '::' || group_index) AS turn_id,
           count(*) FILTER (is_reply) AS assistant_reply_count, count(*) FILTER (event_type = 'view') AS tool_call_count,
           arg_min('m' || (k % 5), pos) FILTER (is_reply) AS primary_model,
           CASE WHEN count(*) FILTER (is_reply) = 0 THEN 'no_assistant_reply' END AS zero_token_reason
    FROM tagged WHERE group_index >= 0 GROUP BY session_ref, group_index""",
)
def context_summary(spark, sf_dir):
    tagged = tagged_events(spark, sf_dir)
    summary = turn_ops.context_summary(turn_ops.user_turns(tagged), turn_ops.assistant_replies(tagged), turn_ops.tool_calls(tagged))
    return summary.select("turn_id", "assistant_reply_count", "tool_call_count", "primary_model", "zero_token_reason")


@query(
    "turn_lineage",
    f"""WITH {TOOL_GROUPS_SQL},
    refs AS (SELECT sha1('turn::ev::' || session_ref || '::' || group_index) AS turn_id, substr(atom_id, 3) AS n, substr(session_ref, 9) AS u
             FROM tagged WHERE group_index >= 0)
    SELECT turn_id, 'fragment' AS ref_kind, 'f:' || n AS ref FROM refs
    UNION ALL SELECT turn_id, 'record', 'r:' || n FROM refs
    UNION ALL SELECT DISTINCT turn_id, 'blob', 'b:' || u FROM refs""",
)
def turn_lineage(spark, sf_dir):
    tagged = tagged_events(spark, sf_dir)
    return turn_ops.turn_lineage(tagged, turn_ops.user_turns(tagged))
