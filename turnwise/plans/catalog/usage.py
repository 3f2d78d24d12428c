"""Token usage over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import tokens
from turnwise.functions.tokens import FIELDS, pack
from turnwise.operators import turns as turn_ops
from turnwise.operators import usage as usage_ops
from turnwise.plans.catalog.registry import query
from turnwise.schemas import ATOM, complete
from turnwise.session import materialize
from turnwise.sources import bridge

EV = "ev AS (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events)"

SIGNALS = f"""{EV},
    sig AS (SELECT 'a:' || event_id AS atom_id, 'sess:ev:' || user_id AS session_ref, event_id AS pos, iso AS time_key,
                   CAST(k AS VARCHAR) AS message_id, CAST(event_id % 3 AS VARCHAR) AS request_id, event_type = 'click' AS is_sidechain,
                   CAST(floor(value) AS BIGINT) AS input_tokens, k AS cache_read, k * 2 AS output_tokens, CAST(floor(value) AS BIGINT) + k * 3 AS total
            FROM ev)"""

TURNS = f"""{EV},
    turns AS (SELECT 't:' || event_id AS turn_id, 'sess:ev:' || user_id AS session_ref, event_type AS source_id,
        CASE WHEN k % 7 <> 0 THEN 'p' || (k % 7) END AS project_id,
        CASE WHEN k % 7 = 0 THEN 'unlinked' WHEN k % 7 < 4 THEN 'committed' ELSE 'candidate' END AS link_state,
        iso AS submission_started_at, strftime(ts + to_seconds(k), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_context_activity_at,
        CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END AS replies, event_type <> 'error' AS has_usage,
        CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS u_in,
        CASE WHEN event_type <> 'error' AND k % 3 = 0 THEN k END AS u_read, CASE WHEN event_type <> 'error' AND k % 4 = 0 THEN k END AS u_create,
        CASE WHEN event_type <> 'error' AND k % 5 = 1 THEN k END AS u_cached, CASE WHEN event_type <> 'error' THEN k * 2 END AS u_out,
        CASE WHEN event_type <> 'error' AND k % 2 = 0 THEN CAST(floor(value) AS BIGINT) + k * 3 END AS u_total,
        CASE WHEN event_type = 'error' AND k % 4 = 0 THEN k END AS declared,
        CASE WHEN k % 10 <> 0 THEN 'm' || (k % 5) END AS primary_model
      FROM ev),
    resolved AS (SELECT *, u_in IS NOT NULL OR declared IS NOT NULL AS has_token_usage,
        coalesce(u_cached, CASE WHEN u_read IS NOT NULL OR u_create IS NOT NULL THEN coalesce(u_read, 0) + coalesce(u_create, 0) END) AS cached,
        coalesce(u_total, CASE WHEN u_in IS NOT NULL THEN u_in + u_out + coalesce(
            CASE WHEN u_read IS NOT NULL OR u_create IS NOT NULL THEN coalesce(u_read, 0) + coalesce(u_create, 0) END, u_cached, 0) END, declared) AS total
      FROM turns)"""

SESSIONS = """sess AS (SELECT 'sess:ev:' || user_id AS session_ref, user_id,
        CASE WHEN user_id % 3 = 0 THEN 'view' ELSE 'click' END AS source_id,
        CASE WHEN user_id % 2 = 0 THEN 'codex' ELSE 'claude_code' END AS source_platform,
        CASE WHEN user_id % 6 <> 5 THEN 'h' || (user_id % 4) END AS host_id,
        CASE WHEN user_id % 7 = 0 THEN 'm' || (user_id % 3) END AS model,
        CASE WHEN user_id % 5 <> 4 THEN 'Topic ' || (user_id % 20) END AS title,
        'Topic ' || (user_id % 20) AS canonical_title,
        CASE WHEN user_id % 4 <> 3 THEN '/work/app' || (user_id % 13) || '/sub' || (user_id % 3) END AS working_directory,
        strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at,
        count(*) AS turn_count, CASE WHEN user_id % 9 = 0 THEN 'p' || (user_id % 7) END AS primary_project_id
      FROM events GROUP BY user_id)"""


def facts_sql(keep_zero: bool = False, where: str = "true") -> str:
    zero = "true" if keep_zero else "(zero_token_reason IS NULL OR has_token_usage)"
    return f"""{TURNS}, {SESSIONS},
    fx AS (SELECT t.turn_id, t.source_id,
        CASE WHEN t.source_id = 'signup' THEN t.source_id
             ELSE upper(t.source_id[1]) || t.source_id[2:] || ' (slot-' || t.source_id || ')' END AS source_label,
        coalesce(s.host_id, CASE WHEN t.source_id <> 'signup' THEN 'host-x' END, 'unknown') AS host_id, t.project_id,
        CASE WHEN t.project_id IS NULL OR t.project_id = 'p6' THEN 'Unassigned' ELSE 'Project ' || t.project_id[2:] END AS project_label,
        coalesce(t.primary_model, s.model, 'unknown') AS model, left(t.submission_started_at, 10) AS day, left(t.submission_started_at, 7) AS month,
        t.has_token_usage, CASE WHEN replies = 0 AND NOT has_token_usage THEN 'no_assistant_reply' END AS zero_token_reason,
        coalesce(u_in, 0) AS input_tokens, coalesce(cached, 0) AS cached_input_tokens, coalesce(u_out, 0) AS output_tokens,
        0::BIGINT AS reasoning_output_tokens, coalesce(total, 0) AS total_tokens, s.working_directory
      FROM resolved t LEFT JOIN sess s USING (session_ref)),
    facts AS (SELECT * EXCLUDE (working_directory) FROM fx WHERE {zero} AND {where})"""


TOTALS = """count(*) AS turn_count, count(*) FILTER (has_token_usage) AS turns_with_token_usage,
    CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (has_token_usage)::DOUBLE / count(*) END AS turn_coverage_ratio,
    count(*) FILTER (model <> 'unknown') AS turns_with_primary_model, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
    CAST(sum(cached_input_tokens) AS BIGINT) AS total_cached_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(reasoning_output_tokens) AS BIGINT) AS total_reasoning_output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens"""

ROLLUP_KEYS = {
    "model": ("model", "model"),
    "project": ("coalesce(project_id, 'unassigned')", "project_label"),
    "source": ("source_id", "source_label"),
    "host": ("host_id", "host_id"),
    "day": ("day", "day"),
    "month": ("month", "month"),
}


def rollup_sql(dimension: str) -> str:
    key, label = ROLLUP_KEYS[dimension]
    return f"SELECT '{dimension}' AS dimension, {key} AS key, any_value({label}) AS label, {TOTALS} FROM facts GROUP BY {key}"


def facts(spark, sf_dir, **filters):
    return usage_ops.usage_facts(
        bridge.usage_turns(spark, sf_dir),
        bridge.usage_sessions(spark, sf_dir),
        bridge.usage_sources(spark, sf_dir, known=False),
        bridge.usage_projects(spark, sf_dir, known=False),
        **filters,
    )


@query(
    "usage_dedupe",
    f"""WITH {SIGNALS},
    best AS (SELECT *, row_number() OVER (PARTITION BY message_id, request_id
                ORDER BY is_sidechain, input_tokens + cache_read + output_tokens DESC, time_key, session_ref, pos) AS rank FROM sig)
    SELECT atom_id, session_ref, message_id, request_id, total AS total_tokens FROM best WHERE rank = 1""",
)
def usage_dedupe(spark, sf_dir):
    kept = usage_ops.dedupe_usage(bridge.usage_signals(spark, sf_dir))
    return kept.select("atom_id", "session_ref", "message_id", "request_id", F.col("usage.total_tokens").alias("total_tokens"))


def _coarse_signals(spark, sf_dir):
    signals = bridge.usage_signals(spark, sf_dir)
    small = {n: F.lit(None) for n in FIELDS} | {"input_tokens": F.col("usage.input_tokens") % 8, "output_tokens": F.col("usage.output_tokens")}
    return signals.withColumn("usage", pack(small, F.lit(None)))


@query(
    "usage_replay_removal",
    f"""WITH {SIGNALS},
    s AS (SELECT *, input_tokens % 8 AS small FROM sig)
    SELECT atom_id, message_id, is_sidechain FROM s WHERE NOT is_sidechain
    UNION ALL
    SELECT atom_id, message_id, is_sidechain FROM s a WHERE is_sidechain AND NOT EXISTS (
      SELECT 1 FROM s m WHERE NOT m.is_sidechain AND m.message_id = a.message_id AND m.small = a.small AND m.output_tokens = a.output_tokens)""",
)
def usage_replay_removal(spark, sf_dir):
    return usage_ops.drop_sidechain_replay(_coarse_signals(spark, sf_dir)).select("atom_id", "message_id", "is_sidechain")


def _counter_signals(spark, sf_dir):
    """Checkpoints whose cumulative counter exceeds them by a small base, so that base and model make the key."""
    rows = bridge.usage_signals(spark, sf_dir)
    now = {n: F.lit(None) for n in FIELDS} | {"input_tokens": F.col("usage.input_tokens"), "output_tokens": F.col("usage.output_tokens")}
    base = F.col("pos") % 4
    ahead = {n: F.lit(None) for n in FIELDS} | {
        "input_tokens": F.col("usage.input_tokens") + base,
        "output_tokens": F.col("usage.output_tokens") + base * 10,
    }
    keyed = F.col("pos") % 5 != 0
    return rows.withColumns({"cumulative_usage": pack(ahead, F.lit(None)), "usage": F.when(keyed, pack(now, F.lit(None)))})


@query(
    "usage_deltas",
    f"""WITH {SIGNALS},
    c AS (SELECT *, pos % 4 AS base, pos % 5 <> 0 AS keyed, input_tokens + pos % 4 AS cum_in, output_tokens + pos % 4 * 10 AS cum_out FROM sig),
    w AS (SELECT *, max(input_tokens) OVER k AS peak_in, max(output_tokens) OVER k AS peak_out,
                 lag(cum_in) OVER s AS before_in, lag(cum_out) OVER s AS before_out
          FROM c WINDOW k AS (PARTITION BY session_ref, keyed, base ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        s AS (PARTITION BY session_ref ORDER BY pos))
    SELECT atom_id,
           CASE WHEN keyed THEN greatest(0, input_tokens - coalesce(peak_in, 0)) ELSE greatest(0, cum_in - coalesce(before_in, 0)) END AS delta_input,
           CASE WHEN keyed THEN greatest(0, output_tokens - coalesce(peak_out, 0)) ELSE greatest(0, cum_out - coalesce(before_out, 0)) END AS delta_output
    FROM w""",
)
def usage_deltas(spark, sf_dir):
    deltas = usage_ops.usage_deltas(_counter_signals(spark, sf_dir))
    return deltas.select(
        "atom_id", F.col("delta_usage.input_tokens").alias("delta_input"), F.col("delta_usage.output_tokens").alias("delta_output")
    )


def _billed_atoms(spark, sf_dir):
    """Sign-ups prompt, purchases reply, everything else is a usage signal."""
    rows = bridge.events(spark, sf_dir)
    kind, k = F.col("event_type"), F.col("k")
    text = kind.isin("signup", "purchase")
    numbers = {n: F.lit(None) for n in FIELDS} | {"output_tokens": k, "total_tokens": k * 2, "cached_input_tokens": F.when(k % 3 == 0, k)}
    atoms = rows.select(
        F.concat(F.lit("a:"), F.col("event_id")).alias("atom_id"),
        F.lit("ev").alias("source_id"),
        F.lit("generic").alias("source_platform"),
        F.concat(F.lit("sess:ev:"), F.col("user_id")).alias("session_ref"),
        F.col("event_id").alias("pos"),
        F.when(kind == "signup", "user").when(text, "assistant").otherwise("system").alias("actor_kind"),
        F.when(kind == "signup", "user_authored").when(text, "assistant_authored").otherwise("source_meta").alias("origin_kind"),
        F.when(text, "text").otherwise("meta_signal").alias("content_kind"),
        F.when(~text, "token_usage_signal").alias("signal_kind"),
        F.when(text, "show").otherwise("hide").alias("display_policy"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time_key"),
        F.lit("t").alias("text"),
        F.when(kind != "view", F.concat(F.lit("msg-"), k % 4)).alias("message_id"),
        F.when(~text, pack(numbers, F.lit(None))).alias("usage"),
        F.when(kind == "error", "token_count").alias("source_event_type"),
        F.when((kind == "click") & (k % 5 == 0), pack({n: F.lit(None) for n in FIELDS} | {"total_tokens": k}, F.lit(None))).alias("delta_usage"),
    )
    return materialize(turn_ops.tag_groups(complete(atoms, ATOM)), "billed")


ATTRIBUTION = f"""{EV},
    atm AS (SELECT *, 'sess:ev:' || user_id AS session_ref, event_type = 'signup' AS is_user, event_type = 'purchase' AS is_reply,
                  event_type NOT IN ('signup', 'purchase') AS is_signal, CASE WHEN event_type <> 'view' THEN k % 4 END AS message,
                  CASE WHEN event_type = 'purchase' THEN event_id END AS reply FROM ev),
    b1 AS (SELECT *, sum(is_reply::INT) OVER (PARTITION BY session_ref ORDER BY event_id) AS replies_so_far FROM atm),
    b2 AS (SELECT *, lag(CASE WHEN is_user THEN replies_so_far END IGNORE NULLS) OVER (PARTITION BY session_ref ORDER BY event_id) AS at_anchor FROM b1),
    b3 AS (SELECT *, sum(CASE WHEN is_user AND (at_anchor IS NULL OR replies_so_far > at_anchor) THEN 1 ELSE 0 END)
                  OVER (PARTITION BY session_ref ORDER BY event_id) - 1 AS g FROM b2),
    b4 AS (SELECT *, last_value(reply IGNORE NULLS) OVER (PARTITION BY session_ref, g ORDER BY event_id) AS prev,
                  first_value(reply IGNORE NULLS) OVER (PARTITION BY session_ref, g ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next,
                  last_value(reply IGNORE NULLS) OVER (PARTITION BY session_ref, g, message ORDER BY event_id) AS same
           FROM b3 WHERE g >= 0 AND NOT is_user),
    b5 AS (SELECT *, CASE WHEN message IS NOT NULL THEN coalesce(same, next, prev) ELSE coalesce(prev, next) END AS target FROM b4 WHERE is_signal)"""


@query(
    "usage_attribution",
    f"""WITH {ATTRIBUTION}
    SELECT 'a:' || event_id AS atom_id, sha1('assistant-reply::ev::' || session_ref || '::a:' || target) AS reply_id FROM b5 WHERE target IS NOT NULL""",
)
def usage_attribution(spark, sf_dir):
    return usage_ops.attribute_signals(_billed_atoms(spark, sf_dir)).select("atom_id", "reply_id")


REPLY_USAGE = f"""{ATTRIBUTION},
    sig AS (SELECT *, CASE WHEN event_type = 'click' AND k % 5 = 0 THEN k END AS delta, CASE WHEN k % 3 = 0 THEN k END AS cached FROM b5 WHERE target IS NOT NULL),
    per AS (SELECT target, bool_or(delta IS NOT NULL) AS deltas, bool_and(event_type = 'error') AS checkpoints, count(*) AS n, count(delta) AS nd,
                   sum(delta) AS d, arg_max(k, event_id) AS last_k, arg_max(k % 3, event_id) AS last_mod, sum(k) AS s, sum(cached) AS c FROM sig GROUP BY target),
    replies AS (SELECT event_id, session_ref, g FROM b4 WHERE is_reply),
    ru AS (SELECT r.*, p.target IS NOT NULL AS billed,
             CASE WHEN deltas THEN d WHEN checkpoints THEN last_k * 2 ELSE s * 2 END AS total,
             CASE WHEN deltas THEN CASE WHEN nd >= 2 THEN 0 END WHEN checkpoints THEN CASE WHEN last_mod = 0 THEN last_k END
                  WHEN n >= 2 THEN coalesce(c, 0) ELSE c END AS cached
           FROM replies r LEFT JOIN per p ON p.target = r.event_id)"""


@query(
    "reply_usage",
    f"""WITH {REPLY_USAGE}
    SELECT 'a:' || event_id AS atom_id, CAST(total AS BIGINT) AS total_tokens, CAST(cached AS BIGINT) AS cached_input_tokens FROM ru""",
)
def reply_usage(spark, sf_dir):
    tagged = _billed_atoms(spark, sf_dir)
    billed = usage_ops.reply_usage(turn_ops.assistant_replies(tagged), usage_ops.attribute_signals(tagged))
    return billed.select("atom_id", F.col("usage.total_tokens").alias("total_tokens"), F.col("usage.cached_input_tokens").alias("cached_input_tokens"))


@query(
    "turn_usage",
    f"""WITH {REPLY_USAGE}
    SELECT sha1('turn::ev::' || session_ref || '::' || g) AS turn_id,
           CAST(sum(total) AS BIGINT) AS total_tokens,
           CAST(CASE WHEN count(*) FILTER (billed) >= 2 THEN coalesce(sum(cached), 0) ELSE max(cached) END AS BIGINT) AS cached_input_tokens
    FROM ru GROUP BY session_ref, g""",
)
def turn_usage(spark, sf_dir):
    tagged = _billed_atoms(spark, sf_dir)
    billed = usage_ops.reply_usage(turn_ops.assistant_replies(tagged), usage_ops.attribute_signals(tagged))
    usage = usage_ops.turn_usage(billed)
    return usage.select(
        "turn_id",
        F.col("token_usage.total_tokens").alias("total_tokens"),
        F.col("token_usage.cached_input_tokens").alias("cached_input_tokens"),
    )


@query(
    "resolve_turn_usage",
    f"""WITH {TURNS}
    SELECT turn_id, has_token_usage, u_in AS input_tokens, cached AS cached_input_tokens, u_out AS output_tokens, total AS total_tokens FROM resolved""",
)
def resolve_turn_usage(spark, sf_dir):
    resolved = usage_ops.resolve_turn_usage(bridge.usage_turns(spark, sf_dir))
    return resolved.select("turn_id", "has_token_usage", "input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")


@query(
    "session_usage",
    f"""WITH {TURNS}
    SELECT session_ref, count(*) FILTER (has_token_usage) AS turns_with_token_usage, CAST(sum(total) AS BIGINT) AS total_tokens
    FROM resolved GROUP BY session_ref""",
)
def session_usage(spark, sf_dir):
    return usage_ops.session_usage(bridge.usage_turns(spark, sf_dir))


@query("usage_facts", f"WITH {facts_sql()} SELECT * FROM facts")
def usage_facts(spark, sf_dir):
    return facts(spark, sf_dir)


@query(
    "usage_facts_filtered",
    "WITH "
    + facts_sql(
        True,
        "project_id IN ('p1', 'p2', 'p6') AND source_id IN ('view', 'error') AND host_id IN ('h0', 'h1', 'host-x') AND day >= '2024-01-05' "
        "AND (working_directory = '/work/app3' OR starts_with(working_directory, '/work/app3/'))",
    )
    + " SELECT * FROM facts",
)
def usage_facts_filtered(spark, sf_dir):
    return facts(
        spark,
        sf_dir,
        directory_scope="/work/./app3/",
        project_ids=["p1", "p2", "p6"],
        source_ids=["view", "error"],
        host_ids=["h0", "h1", "host-x"],
        after_date="2024-01-05",
        include_known_zero_token=True,
    )


@query("usage_overview", f"WITH {facts_sql()} SELECT {TOTALS.replace('AS turn_count', 'AS total_turns', 1)} FROM facts")
def usage_overview(spark, sf_dir):
    return usage_ops.usage_overview(facts(spark, sf_dir))


def _register_rollup(dimension: str) -> None:
    @query(f"usage_by_{dimension}", f"WITH {facts_sql()} {rollup_sql(dimension)}")
    def rollup(spark, sf_dir):
        return usage_ops.usage_rollup(facts(spark, sf_dir), dimension)


for _dimension in ROLLUP_KEYS:
    _register_rollup(_dimension)


@query("usage_rollups", f"WITH {facts_sql()} " + " UNION ALL ".join(rollup_sql(d).replace("any_value(", "(").replace(f"GROUP BY {ROLLUP_KEYS[d][0]}", f"GROUP BY {ROLLUP_KEYS[d][0]}, {ROLLUP_KEYS[d][1]}") for d in ROLLUP_KEYS))
def usage_rollups(spark, sf_dir):
    return usage_ops.usage_rollups(facts(spark, sf_dir))


@query(
    "usage_share",
    f"""WITH {facts_sql()}, r AS ({rollup_sql("source")})
    SELECT key, label, total_tokens, total_tokens / CASE WHEN sum(total_tokens) OVER () = 0 THEN 1 ELSE sum(total_tokens) OVER () END AS token_share FROM r""",
)
def usage_share(spark, sf_dir):
    share = usage_ops.usage_share(usage_ops.usage_rollup(facts(spark, sf_dir), "source"))
    return share.select("key", "label", "total_tokens", "token_share")


@query(
    "excluded_zero_token_turns",
    f"WITH {facts_sql(True)} SELECT count(*) FILTER (zero_token_reason IS NOT NULL AND NOT has_token_usage) AS excluded_zero_token_turns FROM facts",
)
def excluded_zero_token_turns(spark, sf_dir):
    return usage_ops.excluded_zero_token(facts(spark, sf_dir, include_known_zero_token=True))


@query(
    "model_summary",
    f"""WITH {TURNS}, {SESSIONS},
    uses AS (SELECT session_ref, model AS m, '' AS seen_at, '' AS id FROM sess WHERE model IS NOT NULL
             UNION ALL SELECT session_ref, primary_model, submission_started_at, turn_id FROM turns WHERE primary_model IS NOT NULL),
    firsts AS (SELECT session_ref, m, min((seen_at, id)) AS first_use FROM uses GROUP BY 1, 2),
    lists AS (SELECT session_ref, string_agg(m, ', ' ORDER BY first_use) AS models, count(*) AS n FROM firsts GROUP BY 1)
    SELECT s.session_ref, models, CASE WHEN n IS NULL THEN '-' WHEN n = 1 THEN models ELSE 'mixed (' || models || ')' END AS model_label
    FROM sess s LEFT JOIN lists USING (session_ref)""",
)
def model_summary(spark, sf_dir):
    return usage_ops.model_summary(bridge.usage_sessions(spark, sf_dir), bridge.usage_turns(spark, sf_dir))
