"""Token usage: billing signals, their attribution to replies and turns, and usage statistics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import paths, timekeys, tokens
from turnwise.functions.ordered import last_value, next_value, position_chunk, running_max, with_running
from turnwise.functions.text import strip
from turnwise.functions.tokens import FIELDS
from turnwise.operators.atoms import SESSION
from turnwise.operators.turns import TURN, in_context, is_visible_reply, reply_id
from turnwise.session import materialize

def _zero() -> Column:
    return F.lit(0).cast("bigint")


# --- billing signals -------------------------------------------------------------------------------------------------


def dedupe_usage(signals: DataFrame) -> DataFrame:
    """Keep one signal per source, message and request: main thread first, then larger total, then more fields, then earliest.

    The winner's id is aggregated (with map-side combine) rather than ranked in a window, so copies of one message
    never meet in one task. Signals without a message id all stay.
    """
    counted = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")
    total = reduce(add, [F.coalesce(F.col(f"usage.{n}"), _zero()) for n in counted])
    columns = set(signals.columns)
    said = [F.col(f"usage.{n}") for n in (*FIELDS, "model")] + [F.col(c) for c in ("request_id", "model", "stop_reason") if c in columns]
    filled = reduce(add, [value.isNotNull().cast("int") for value in said])
    # min over a struct: smaller is better, so preferred-high values are negated.
    rank = F.struct(
        F.coalesce(F.col("is_sidechain"), F.lit(False)).cast("int").alias("sidechain"),
        (-total).alias("total"),
        (-filled).alias("filled"),
        F.col("time_key").alias("time_key"),
        F.col("session_ref").alias("session_ref"),
        F.col("pos").alias("pos"),
        F.col("atom_id").alias("atom_id"),
    )
    keyed = F.col("message_id").isNotNull()
    best = (
        signals.where(keyed)
        .groupBy("source_id", "message_id", "request_id")
        .agg(F.min(rank).alias("best"))
        .select(F.col("best.atom_id").alias("atom_id"))
    )
    return signals.where(keyed).join(best, "atom_id", "left_semi").select(*signals.columns).unionByName(signals.where(~keyed))


def drop_sidechain_replay(signals: DataFrame) -> DataFrame:
    """Drop side-thread signals that repeat a main-thread signal of the same source and message number for number."""
    numbers = ["input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens", "total_tokens"]
    print_of = F.concat_ws("|", *[F.coalesce(F.col(f"usage.{n}").cast("string"), F.lit("_")) for n in numbers])
    marked = signals.withColumn("_print", print_of)
    side = F.coalesce(F.col("is_sidechain"), F.lit(False)) & F.col("message_id").isNotNull()
    main = (
        marked.where(~F.coalesce(F.col("is_sidechain"), F.lit(False)) & F.col("message_id").isNotNull())
        .select("source_id", "message_id", "_print")
        .distinct()
    )
    kept = marked.where(side).join(main, ["source_id", "message_id", "_print"], "left_anti")
    return marked.where(~side).unionByName(kept.select(*marked.columns)).drop("_print")


def baseline_key(cumulative: Column, checkpoint: Column) -> Column:
    """Identity of a counter: its model and cumulative minus checkpoint, field by field; null if nothing is known."""
    parts = [
        F.coalesce((cumulative.getField(n) - F.coalesce(checkpoint.getField(n), _zero())).cast("string"), F.lit("_")) for n in FIELDS
    ]
    known = F.coalesce(*[cumulative.getField(n) for n in FIELDS]).isNotNull()
    model = F.coalesce(cumulative.getField("model"), checkpoint.getField("model"), F.lit(""))
    return F.when(cumulative.isNotNull() & checkpoint.isNotNull() & known, F.concat_ws("|", model, *parts))


def _less(now: Column, before: Column) -> Column:
    """now - before per field, not below zero; absent only where both are."""
    fields = {
        n: F.when(
            now.getField(n).isNotNull() | before.getField(n).isNotNull(),
            F.greatest(_zero(), F.coalesce(now.getField(n), _zero()) - F.coalesce(before.getField(n), _zero())),
        )
        for n in FIELDS
    }
    return F.when(before.isNull(), now).otherwise(tokens.pack(fields, now.getField("model")))


def usage_deltas(signals: DataFrame) -> DataFrame:
    """Turn running counters into increments, as ``delta_usage``.

    With a baseline key the increment is the checkpoint minus the running maximum of that key before it (per field);
    without one it is the difference to the session's previous cumulative value.
    """
    keyed = signals.withColumn("_key", baseline_key(F.col("cumulative_usage"), F.col("usage")))
    chunk = [position_chunk("pos")]
    with_key = with_running(
        keyed.where(F.col("_key").isNotNull()),
        [*SESSION, "_key"],
        ["pos"],
        chunk,
        **{f"_max_{n}": running_max(F.col(f"usage.{n}"), inclusive=False) for n in FIELDS},
        _seen=last_value(F.lit(True), inclusive=False),
    )
    peak = F.when(F.col("_seen"), tokens.pack({n: F.col(f"_max_{n}") for n in FIELDS}, F.lit(None)))
    by_key = with_key.withColumn("delta_usage", _less(F.col("usage"), peak)).select(*signals.columns, "delta_usage")
    in_session = with_running(keyed, SESSION, ["pos"], chunk, _before=last_value(F.col("cumulative_usage"), inclusive=False))
    by_session = in_session.where(F.col("_key").isNull()).withColumn(
        "delta_usage", F.when(F.col("cumulative_usage").isNotNull(), _less(F.col("cumulative_usage"), F.col("_before")))
    )
    return by_key.unionByName(by_session.select(*signals.columns, "delta_usage"))


# --- attribution -----------------------------------------------------------------------------------------------------


def attribute_signals(tagged: DataFrame) -> DataFrame:
    """Give each usage signal of a context the reply it pays for; signals of a turn without replies drop out.

    With a message id: the latest earlier reply of that id in the turn, else the next reply of any id, else the last
    one. Without: the latest earlier reply, else the next one.
    """
    is_signal = F.col("signal_kind") == "token_usage_signal"
    columns = ["atom_id", "message_id", "usage", "delta_usage", "source_event_type", "stop_reason"]
    rows = tagged.where(in_context() & (is_visible_reply() | F.coalesce(is_signal, F.lit(False)))).select(
        *TURN, "pos", *columns, F.coalesce(is_signal, F.lit(False)).alias("is_signal"), F.when(is_visible_reply(), reply_id()).alias("reply")
    )
    chunk = [position_chunk("pos")]
    around = with_running(
        rows, TURN, ["pos"], chunk, _prev=last_value(F.col("reply"), False), _next=next_value(F.col("reply"), False)
    )
    around = materialize(around, "signals")  # read by three branches below
    same = with_running(
        around.where(F.col("message_id").isNotNull()), [*TURN, "message_id"], ["pos"], chunk, _same=last_value(F.col("reply"), False)
    ).where("is_signal")
    with_id = same.withColumn("reply_id", F.coalesce("_same", "_next", "_prev"))
    without = around.where(F.col("is_signal") & F.col("message_id").isNull()).withColumn("reply_id", F.coalesce("_prev", "_next"))
    out = [*TURN, "pos", *columns, "reply_id"]
    return with_id.select(*out).unionByName(without.select(*out)).where(F.col("reply_id").isNotNull())


def reply_usage(replies: DataFrame, attributed: DataFrame) -> DataFrame:
    """Replies with the usage their signals add up to; replies without signals keep their own."""
    usage, delta, pos = F.col("usage"), F.col("delta_usage"), F.col("pos")
    per_reply = attributed.groupBy("reply_id").agg(
        F.bool_or(delta.isNotNull()).alias("deltas"),
        F.bool_and(F.coalesce(F.col("source_event_type") == "token_count", F.lit(False))).alias("checkpoints"),
        tokens.merged_aggregate(delta, pos).alias("summed_deltas"),
        tokens.merged_aggregate(usage, pos).alias("summed"),
        F.max_by(F.struct(usage.alias("usage"), F.col("stop_reason").alias("stop_reason")), pos).alias("last"),
    )
    resolved = F.when(F.col("deltas"), F.col("summed_deltas")).when(F.col("checkpoints"), F.col("last.usage")).otherwise(F.col("summed"))
    joined = replies.join(per_reply.select("reply_id", resolved.alias("_resolved"), F.col("last.stop_reason").alias("_stop")), "reply_id", "left")
    found = F.col("_resolved").isNotNull()
    return joined.withColumns(
        {
            "usage": F.coalesce("_resolved", "usage"),
            "model": F.when(found & (F.col("model") == "unknown"), F.coalesce("_resolved.model", "model")).otherwise(F.col("model")),
            "stop_reason": F.coalesce("stop_reason", F.when(found, F.col("_stop"))),
        }
    ).select(*replies.columns)


def turn_usage(replies: DataFrame) -> DataFrame:
    """Merged usage per turn; one usage stays as reported, several are summed with absent counted as zero."""
    return replies.groupBy("turn_id").agg(tokens.merged_aggregate(F.col("usage"), F.col("pos")).alias("token_usage"))


def resolve_turn_usage(turns: DataFrame) -> DataFrame:
    """Per turn: whether usage is known, cached input with fallback, and the total with fallback to the summary's."""
    read, creation = F.col("token_usage.cache_read_input_tokens"), F.col("token_usage.cache_creation_input_tokens")
    cached = F.coalesce(
        F.col("token_usage.cached_input_tokens"),
        F.when(read.isNotNull() | creation.isNotNull(), F.coalesce(read, _zero()) + F.coalesce(creation, _zero())),
    )
    declared = F.col("total_tokens")
    known = F.coalesce(*[F.col(f"token_usage.{n}") for n in FIELDS], declared).isNotNull()
    return turns.select(
        *[c for c in turns.columns if c not in ("token_usage", "total_tokens")],
        known.alias("has_token_usage"),
        F.col("token_usage.input_tokens").alias("input_tokens"),
        cached.alias("cached_input_tokens"),
        F.col("token_usage.output_tokens").alias("output_tokens"),
        F.col("token_usage.reasoning_output_tokens").alias("reasoning_output_tokens"),
        F.coalesce(tokens.structured_total(F.col("token_usage")), declared).alias("total_tokens"),
    )


def session_usage(turns: DataFrame) -> DataFrame:
    """Per session: turns with usage and the summed total, null if no turn knows one."""
    return resolve_turn_usage(turns).groupBy("session_ref").agg(
        F.count_if("has_token_usage").alias("turns_with_token_usage"), F.sum("total_tokens").alias("total_tokens")
    )


# --- statistics ------------------------------------------------------------------------------------------------------

TOKEN_SUMS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
DIMENSIONS = ("model", "project", "source", "host", "day", "month")


def usage_facts(
    turns: DataFrame,
    sessions: DataFrame,
    sources: DataFrame,
    projects: DataFrame,
    *,
    directory_scope: str | None = None,
    project_ids: list[str] | None = None,
    source_ids: list[str] | None = None,
    host_ids: list[str] | None = None,
    after_date: str | None = None,
    include_known_zero_token: bool = False,
) -> DataFrame:
    """One usage row per turn with its labels. Filters on the turn's own columns run before the lookups."""
    if project_ids:
        turns = turns.where(F.col("project_id").isin(*project_ids))
    if source_ids:
        turns = turns.where(F.col("source_id").isin(*source_ids))
    if after_date:
        turns = turns.where(timekeys.day(F.col("submission_started_at")) >= after_date)
    if directory_scope:
        sessions = sessions.where(paths.scope_match(F.col("working_directory"), directory_scope))
    session = sessions.select("session_ref", F.col("host_id").alias("_session_host"), F.col("model").alias("_session_model"))
    source = sources.select(
        "source_id",
        F.concat(F.col("display_name"), F.lit(" ("), F.col("slot_id"), F.lit(")")).alias("_source_label"),
        F.col("host_id").alias("_source_host"),
    )
    project = projects.select("project_id", F.col("display_name").alias("_project_label"))
    joined = (
        resolve_turn_usage(turns)
        .join(session, "session_ref", "inner" if directory_scope else "left")
        .join(source, "source_id", "left")
        .join(project, "project_id", "left")
    )
    host = F.coalesce("_session_host", "_source_host", F.lit("unknown"))
    reason = F.coalesce(
        F.col("zero_token_reason"), F.when((F.col("assistant_reply_count") == 0) & ~F.col("has_token_usage"), "no_assistant_reply")
    )
    facts = joined.select(
        "turn_id",
        "source_id",
        F.coalesce("_source_label", "source_id").alias("source_label"),
        host.alias("host_id"),
        "project_id",
        F.coalesce("_project_label", F.lit("Unassigned")).alias("project_label"),
        F.coalesce("primary_model", "_session_model", F.lit("unknown")).alias("model"),
        timekeys.day(F.col("submission_started_at")).alias("day"),
        timekeys.month(F.col("submission_started_at")).alias("month"),
        "has_token_usage",
        reason.alias("zero_token_reason"),
        *[F.coalesce(name, _zero()).alias(name) for name in TOKEN_SUMS],
    )
    if host_ids:
        facts = facts.where(F.col("host_id").isin(*host_ids))
    if not include_known_zero_token:
        facts = facts.where(F.col("zero_token_reason").isNull() | F.col("has_token_usage"))
    return facts


def _totals() -> list[Column]:
    return [
        F.count("*").alias("turn_count"),
        F.count_if("has_token_usage").alias("turns_with_token_usage"),
        F.when(F.count("*") == 0, 0.0).otherwise(F.count_if("has_token_usage") / F.count("*")).alias("turn_coverage_ratio"),
        F.count_if(F.col("model") != "unknown").alias("turns_with_primary_model"),
        *[F.coalesce(F.sum(name), _zero()).alias(f"total_{name}".replace("total_total", "total")) for name in TOKEN_SUMS],
    ]


def usage_overview(facts: DataFrame) -> DataFrame:
    """One row of totals over all usage rows."""
    return facts.agg(*_totals()).withColumnRenamed("turn_count", "total_turns")


def _dimension_columns(facts: DataFrame) -> DataFrame:
    project = F.coalesce("project_id", F.lit("unassigned"))
    return facts.select(
        "*",
        F.array(
            *[
                F.struct(F.lit(name).alias("dimension"), key.alias("key"), label.alias("label"))
                for name, key, label in (
                    ("model", F.col("model"), F.col("model")),
                    ("project", project, F.col("project_label")),
                    ("source", F.col("source_id"), F.col("source_label")),
                    ("host", F.col("host_id"), F.col("host_id")),
                    ("day", F.col("day"), F.col("day")),
                    ("month", F.col("month"), F.col("month")),
                )
            ]
        ).alias("_dimensions"),
    )


def usage_rollup(facts: DataFrame, dimension: str) -> DataFrame:
    """Totals per key of one dimension: dates ascending, everything else by tokens, turns and label."""
    at = F.get("_dimensions", F.lit(DIMENSIONS.index(dimension)))
    keyed = _dimension_columns(facts).withColumns({"key": at.getField("key"), "label": at.getField("label")})
    rows = keyed.groupBy("key").agg(F.min("label").alias("label"), *_totals())
    rows = rows.select(F.lit(dimension).alias("dimension"), *rows.columns)
    if dimension in ("day", "month"):
        return rows.orderBy("key")
    return rows.orderBy(F.desc("total_tokens"), F.desc("turn_count"), "label")


def usage_rollups(facts: DataFrame) -> DataFrame:
    """All six dimensions in one pass: rows fan out six-fold and are combined on the map side before the shuffle."""
    fanned = _dimension_columns(facts).select("*", F.inline("_dimensions"))
    return fanned.groupBy("dimension", "key", "label").agg(*_totals())


def excluded_zero_token(facts_with_zero: DataFrame) -> DataFrame:
    """Turns left out of the statistics because they are known to have used no tokens."""
    hidden = F.col("zero_token_reason").isNotNull() & ~F.col("has_token_usage")
    return facts_with_zero.agg(F.count_if(hidden).alias("excluded_zero_token_turns"))


def usage_share(rollup: DataFrame) -> DataFrame:
    """Share of each rollup row in all tokens; the window runs over rollup rows, one per key, not over turns."""
    total = F.sum("total_tokens").over(Window.partitionBy("dimension"))
    return rollup.withColumn("token_share", F.col("total_tokens") / F.when(total == 0, 1).otherwise(total))


def model_summary(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Per session its own model and those of its turns in order of first use: a display label and a plain list."""
    first_use = (
        turns.where(F.col("primary_model").isNotNull())
        .groupBy("session_ref", "primary_model")
        .agg(F.min(F.struct("submission_started_at", "turn_id")).alias("at"))
    )
    listed = first_use.groupBy("session_ref").agg(F.array_sort(F.collect_list(F.struct("at", "primary_model"))).alias("used"))
    joined = sessions.select("session_ref", "model").join(listed, "session_ref", "left")
    own = F.array_compact(F.array(F.nullif(strip(F.col("model")), F.lit(""))))
    used = F.coalesce(F.transform("used", lambda u: strip(u.primary_model)), F.array().cast("array<string>"))
    models = F.filter(F.array_distinct(F.concat(own, used)), lambda m: m != "")
    known = F.filter(models, lambda m: F.lower(m) != "unknown")
    return joined.select(
        "session_ref",
        F.when(F.size(known) == 0, "-")
        .when(F.size(known) == 1, F.get(known, F.lit(0)))
        .otherwise(F.concat(F.lit("mixed ("), F.array_join(known, ", "), F.lit(")")))
        .alias("model_label"),
        F.nullif(F.array_join(models, ", "), F.lit("")).alias("models"),
    )
