"""Submission groups, user turns and what happened inside them.

``tag_groups`` numbers the groups of every session once; everything else filters and aggregates its output. Groups and
turns are keyed by (source, session, group index), and a turn's replies and tool calls stay flat rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import masks, paths, text, tokens
from turnwise.functions.ids import stable_id
from turnwise.functions.ordered import last_value, position_chunk, running_min, running_sum, with_running
from turnwise.operators.atoms import SESSION

TURN = [*SESSION, "group_index"]
PREVIEW = 140


def is_user_atom() -> Column:
    kind = (F.col("actor_kind") == "user") & (F.col("content_kind") == "text")
    return kind & F.col("origin_kind").isin("user_authored", "injected_user_shaped")


def is_visible_reply() -> Column:
    return (F.col("actor_kind") == "assistant") & (F.col("content_kind") == "text") & (F.col("display_policy") != "hide")


def is_activity() -> Column:
    spoken = (F.col("content_kind") == "text") & F.col("actor_kind").isin("user", "assistant")
    return (F.col("display_policy") != "hide") & (F.col("content_kind").isin("tool_call", "tool_result") | spoken)


def in_context() -> Column:
    """Inside the span of a group without being one of its members."""
    return F.col("group_index").isNotNull() & ~is_user_atom()


def turn_id() -> Column:
    return stable_id("turn", F.col("source_id"), F.col("session_ref"), F.col("group_index"))


def reply_id(atom_id: Column | None = None) -> Column:
    return stable_id("assistant-reply", F.col("source_id"), F.col("session_ref"), F.col("atom_id") if atom_id is None else atom_id)


def tag_groups(atoms: DataFrame) -> DataFrame:
    """Add ``group_index`` (null before the first group) and ``starts_group`` to every atom.

    A user atom opens a group if it is the session's first, or if it is authored and a visible assistant text came
    after the previous anchor (the first user atom or any authored one). One platform opens a group per authored atom.
    """
    authored = is_user_atom() & (F.col("origin_kind") == "user_authored")
    seen = with_running(
        atoms.withColumn("_chunk", position_chunk("pos")),
        SESSION,
        ["pos"],
        ["_chunk"],
        _authored_at=last_value(F.when(authored, F.col("pos")), inclusive=False),
        _first_at=running_min(F.when(is_user_atom(), F.col("pos")), inclusive=False),
        _reply_at=last_value(F.when(is_visible_reply(), F.col("pos")), inclusive=False),
    )
    fresh = F.coalesce(F.col("source_platform") == "antigravity", F.lit(False))
    replied = F.coalesce(F.col("_reply_at") > F.coalesce("_authored_at", "_first_at"), F.lit(False))
    starts = is_user_atom() & (F.col("_first_at").isNull() | (authored & (fresh | replied)))
    marked = seen.withColumn("starts_group", starts).drop("_authored_at", "_first_at", "_reply_at")
    numbered = with_running(marked, SESSION, ["pos"], ["_chunk"], _groups=running_sum(F.col("starts_group").cast("bigint")))
    return numbered.withColumn("group_index", F.when(F.col("_groups") > 0, F.col("_groups") - 1)).drop("_groups", "_chunk")


def submission_groups(tagged: DataFrame) -> DataFrame:
    """One row per group: its size, bounds and whether an assistant text followed inside it."""
    members = F.when(is_user_atom(), F.col("pos"))
    return (
        tagged.where(F.col("group_index").isNotNull())
        .groupBy(*TURN)
        .agg(
            F.count_if(is_user_atom()).alias("atom_count"),
            F.count_if(is_user_atom() & (F.col("origin_kind") == "user_authored")).alias("authored_count"),
            F.min_by("time_key", members).alias("started_at"),
            F.max_by("time_key", members).alias("ended_at"),
            F.bool_or(is_visible_reply()).alias("assistant_seen"),
        )
        .withColumn("group_id", stable_id("candidate", "submission_group", F.col("source_id"), F.col("session_ref"), F.col("group_index")))
    )


def edges_submission(tagged: DataFrame) -> DataFrame:
    """Each further user atom of a group to the one before it, as same_submission and continuation_of."""
    users = tagged.where(is_user_atom()).select(*TURN, "pos", "atom_id")
    before = with_running(
        users, SESSION, ["pos"], [position_chunk("pos")], _prior=last_value(F.struct("atom_id", "group_index"), inclusive=False)
    ).where(F.col("_prior.group_index") == F.col("group_index"))
    return before.select(
        *SESSION,
        F.col("atom_id").alias("from_atom_id"),
        F.col("_prior.atom_id").alias("to_atom_id"),
        F.explode(F.array(F.lit("same_submission"), F.lit("continuation_of"))).alias("edge_kind"),
    ).withColumn(
        "edge_id",
        stable_id("edge", F.col("source_id"), F.col("session_ref"), F.col("from_atom_id"), F.col("to_atom_id"), F.col("edge_kind")),
    )


def context_spans(tagged: DataFrame) -> DataFrame:
    """Atoms between a group's first atom and the next group's, group members excluded."""
    return tagged.where(in_context()).select(*TURN, "pos", "atom_id", "content_kind", turn_id().alias("turn_id"))


def user_messages(tagged: DataFrame, templates=masks.BUILTIN_TEMPLATES) -> DataFrame:
    """User atoms of every group with their masked display form."""
    injected = F.col("origin_kind") == "injected_user_shaped"
    keep_blocks = F.coalesce(F.col("source_platform") == "antigravity", F.lit(False)) & ~injected
    every = masks.select_templates("user_message", templates)
    secrets = masks.select_templates("user_message", templates, masks.PROMPT_BLOCK_IDS)
    body = F.coalesce("text", F.lit(""))
    spans = F.when(keep_blocks, masks.mask_spans(body, secrets)).otherwise(masks.mask_spans(body, every))
    rows = tagged.where(is_user_atom()).select(
        *TURN, "pos", "atom_id", "time_key", body.alias("raw_text"), injected.alias("is_injected"), spans.alias("spans")
    )
    shown = rows.withColumn("display_segments", masks.display_segments(F.col("raw_text"), F.col("spans"), F.col("is_injected")))
    return shown.withColumn("canonical_text", masks.canonical_text(F.col("display_segments"))).drop("spans")


def user_turns(tagged: DataFrame, templates=masks.BUILTIN_TEMPLATES) -> DataFrame:
    """One turn per group with at least one authored message."""
    messages = user_messages(tagged, templates)
    parts = F.array_sort(F.collect_list(F.struct("pos", "raw_text", "canonical_text", "display_segments")))
    turns = (
        messages.groupBy(*TURN)
        .agg(
            parts.alias("parts"),
            F.bool_or(~F.col("is_injected")).alias("authored"),
            F.min_by("time_key", "pos").alias("submission_started_at"),
            F.max_by("time_key", "pos").alias("group_ended_at"),
            F.count("*").alias("message_count"),
        )
        .where("authored")
    )
    canonical = F.array_join(F.filter(F.transform("parts", lambda p: p.canonical_text), lambda t: t != ""), "\n\n")
    segments = masks.join_segments(F.transform("parts", lambda p: p.display_segments))
    return turns.select(
        turn_id().alias("turn_id"),
        *TURN,
        F.array_join(F.transform("parts", lambda p: p.raw_text), "\n\n").alias("raw_text"),
        segments.alias("display_segments"),
        F.coalesce(F.nullif(canonical, F.lit("")), masks.fallback_text(segments)).alias("canonical_text"),
        "message_count",
        "submission_started_at",
        F.col("submission_started_at").alias("created_at"),
        "group_ended_at",
    )


def last_activity(tagged: DataFrame) -> DataFrame:
    """Latest conversation activity per group: in its context, else among its members, else the group's end."""
    return (
        tagged.where(F.col("group_index").isNotNull())
        .groupBy(*TURN)
        .agg(
            F.coalesce(
                F.max_by("time_key", F.when(is_activity() & ~is_user_atom(), F.col("pos"))),
                F.max_by("time_key", F.when(is_activity() & is_user_atom(), F.col("pos"))),
                F.max_by("time_key", F.when(is_user_atom(), F.col("pos"))),
            ).alias("last_context_activity_at")
        )
    )


def system_messages(tagged: DataFrame) -> DataFrame:
    """Visible system texts of each context, numbered in order."""
    visible = (F.col("actor_kind") == "system") & (F.col("content_kind") == "text") & (F.col("display_policy") != "hide")
    rows = tagged.where(in_context() & visible).select(*TURN, "pos", "atom_id", "time_key", F.coalesce("text", F.lit("")).alias("content"))
    numbered = with_running(rows, TURN, ["pos"], [position_chunk("pos")], sequence=running_sum(F.lit(1), inclusive=False))
    return numbered.select(
        stable_id("system-message", F.col("source_id"), F.col("session_ref"), F.col("atom_id")).alias("system_message_id"),
        turn_id().alias("turn_id"),
        *TURN,
        "sequence",
        "content",
        F.col("time_key").alias("created_at"),
    )


def assistant_replies(tagged: DataFrame, sessions: DataFrame | None = None, templates=masks.BUILTIN_TEMPLATES) -> DataFrame:
    """Visible assistant texts of each context with the model in force.

    A reply without a model takes the latest one named before it in the turn (by a model signal or another reply),
    then the session's, then ``unknown``. ``sessions`` gives (source_id, session_ref, model).
    """
    own = F.when(is_visible_reply(), F.coalesce(F.col("model"), F.col("usage.model")))
    signalled = F.when(F.col("signal_kind") == "model_signal", F.col("model"))
    rows = tagged.where(in_context() & (is_visible_reply() | (F.col("signal_kind") == "model_signal")))
    seen = with_running(
        rows,
        TURN,
        ["pos"],
        [position_chunk("pos")],
        _active=last_value(F.nullif(F.coalesce(own, signalled), F.lit("unknown")), inclusive=False),
        reply_index=running_sum(is_visible_reply().cast("bigint"), inclusive=False),
    ).where(is_visible_reply())
    if sessions is None:
        seen = seen.withColumn("_session_model", F.lit(None).cast("string"))
    else:
        models = sessions.select(*SESSION, F.col("model").alias("_session_model"))
        seen = seen.join(models, SESSION, "left")
    content = F.coalesce("text", F.lit(""))
    canonical = masks.masked_text(content, "assistant_reply", templates)
    return seen.select(
        reply_id().alias("reply_id"),
        turn_id().alias("turn_id"),
        *TURN,
        "pos",
        "atom_id",
        "reply_index",
        content.alias("content"),
        canonical.alias("canonical_text"),
        F.coalesce(F.col("model"), F.col("usage.model"), F.col("_active"), F.col("_session_model"), F.lit("unknown")).alias("model"),
        "message_id",
        "stop_reason",
        "usage",
        F.col("time_key").alias("created_at"),
    ).withColumn("content_preview", text.truncate(F.coalesce(F.nullif("canonical_text", F.lit("")), "content"), PREVIEW))


def visible_calls(tagged: DataFrame) -> DataFrame:
    return tagged.where(in_context() & (F.col("content_kind") == "tool_call") & (F.col("display_policy") != "hide"))


def _called_from(tagged: DataFrame) -> DataFrame:
    """Visible tool calls of each context with ``_text``, the latest assistant text before them, hidden ones included."""
    said = (F.col("actor_kind") == "assistant") & (F.col("content_kind") == "text")
    narrow = ["pos", "atom_id", "time_key", "tool_name", "tool_input"]
    rows = tagged.where(said | (F.col("content_kind") == "tool_call")).select(
        *TURN, *narrow, said.alias("_said"), (is_visible_reply() & in_context()).alias("_replies"),
        (in_context() & (F.col("content_kind") == "tool_call") & (F.col("display_policy") != "hide")).alias("_shown"),
    )
    text_before = last_value(F.when(F.col("_said"), F.struct("atom_id", "group_index", "_replies")), inclusive=False)
    seen = with_running(rows, SESSION, ["pos"], [position_chunk("pos")], _text=text_before)
    return seen.where("_shown").select(*TURN, *narrow, "_text")


def _first_results(tagged: DataFrame) -> DataFrame:
    """(call_atom, r): the first result of each call, with the group whose context it is in."""
    tools = tagged.where(F.col("content_kind").isin("tool_call", "tool_result") & (F.col("call_id") != "")).select(
        *TURN, "call_id", "pos", "atom_id", "content_kind", "tool_output", in_context().alias("_inside")
    )
    call = F.when(F.col("content_kind") == "tool_call", F.col("atom_id"))
    seen = with_running(tools, [*SESSION, "call_id"], ["pos"], [position_chunk("pos")], call_atom=last_value(call, inclusive=False))
    results = seen.where((F.col("content_kind") == "tool_result") & F.col("call_atom").isNotNull())
    first = F.min_by(F.struct(F.when(F.col("_inside"), F.col("group_index")).alias("group"), F.coalesce("tool_output", F.lit("")).alias("output")), "pos")
    return results.groupBy("call_atom").agg(first.alias("r"))


def tool_calls(tagged: DataFrame, templates=masks.BUILTIN_TEMPLATES) -> DataFrame:
    """Visible tool calls of each context with the reply they belong to and their first result inside the context."""
    calls = with_running(_called_from(tagged), TURN, ["pos"], [position_chunk("pos")], sequence=running_sum(F.lit(1), inclusive=False))
    last_reply = tagged.where(in_context() & is_visible_reply()).groupBy(*TURN).agg(F.max_by("atom_id", "pos").alias("last_reply_atom"))
    own_reply = F.when(F.col("_text._replies") & (F.col("_text.group_index") == F.col("group_index")), F.col("_text.atom_id"))
    answered = calls.join(last_reply, TURN, "left").join(_first_results(tagged), F.col("atom_id") == F.col("call_atom"), "left")
    joined = answered.withColumns(
        {"chosen": F.coalesce(own_reply, F.col("last_reply_atom")), "result_output": F.when(F.col("r.group") == F.col("group_index"), F.col("r.output"))}
    )
    given = F.coalesce("tool_input", F.lit("{}"))
    return joined.select(
        stable_id("tool-call", F.col("source_id"), F.col("session_ref"), F.col("atom_id")).alias("tool_call_id"),
        turn_id().alias("turn_id"),
        *TURN,
        "pos",
        "atom_id",
        "sequence",
        F.coalesce("tool_name", F.lit("tool_call")).alias("tool_name"),
        given.alias("input"),
        text.truncate(masks.masked_text(given, "tool_input", templates), PREVIEW).alias("input_summary"),
        F.col("result_output").alias("output"),
        text.truncate(masks.masked_text(F.col("result_output"), "tool_output", templates), PREVIEW).alias("output_preview"),
        F.when(F.col("chosen").isNotNull(), reply_id(F.col("chosen")))
        .otherwise(stable_id("assistant-reply", F.col("session_ref"), "synthetic"))
        .alias("reply_id"),
        F.col("time_key").alias("created_at"),
    )


def context_summary(turns: DataFrame, replies: DataFrame, tools: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Per turn: reply and tool counts, merged usage, first reply's model, errors and why there are no tokens."""
    per_reply = replies.groupBy("turn_id").agg(
        F.count("*").alias("replies"),
        F.min_by("model", "pos").alias("first_model"),
        F.bool_or(F.coalesce(F.col("stop_reason") == "error", F.lit(False))).alias("errors"),
        tokens.merged_aggregate(F.col("usage"), F.col("pos")).alias("token_usage"),
    )
    per_tool = tools.groupBy("turn_id").agg(F.count("*").alias("calls"))
    base = turns.select("turn_id", *SESSION).join(per_reply, "turn_id", "left").join(per_tool, "turn_id", "left")
    model = F.col("first_model")
    if sessions is not None:
        base = base.join(sessions.select(*SESSION, F.col("model").alias("_session_model")), SESSION, "left")
        model = F.coalesce(model, F.col("_session_model"))
    count = F.coalesce("replies", F.lit(0))
    return base.select(
        "turn_id",
        count.alias("assistant_reply_count"),
        F.coalesce("calls", F.lit(0)).alias("tool_call_count"),
        "token_usage",
        F.col("token_usage.total_tokens").alias("total_tokens"),
        model.alias("primary_model"),
        F.coalesce("errors", F.lit(False)).alias("has_errors"),
        F.when(count == 0, "no_assistant_reply").alias("zero_token_reason"),
    )


def turn_lineage(tagged: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct fragments, records and captures behind each turn, as flat (turn, kind, ref) rows."""
    refs = F.array(
        F.struct(F.lit("fragment").alias("ref_kind"), F.col("fragment_id").alias("ref")),
        F.struct(F.lit("record").alias("ref_kind"), F.col("record_id").alias("ref")),
        F.struct(F.lit("blob").alias("ref_kind"), F.col("blob_id").alias("ref")),
    )
    rows = tagged.where(F.col("group_index").isNotNull()).select(turn_id().alias("turn_id"), F.inline(refs))
    return rows.where(F.coalesce("ref", F.lit("")) != "").distinct().join(turns.select("turn_id"), "turn_id", "left_semi")


def turn_path_text(tagged: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct paths and their last segments named by a turn's session and atoms, joined by blanks in first-seen order.

    Distinct (turn, path) pairs are formed before anything is collected. ``sessions`` gives working_directory,
    source_native_project_ref and resume_working_directory.
    """
    named = ["working_directory", "source_native_project_ref", "resume_working_directory"]
    of_session = turns.select("turn_id", *SESSION).join(sessions.select(*SESSION, *named), SESSION, "left")
    from_session = of_session.select(
        "turn_id", F.posexplode(F.flatten(F.array(*[F.coalesce(paths.path_parts(F.col(c)), F.array().cast("array<string>")) for c in named]))).alias("rank", "part")
    ).select("turn_id", F.lit(-1).cast("bigint").alias("pos"), F.col("rank").cast("int"), "part")
    signals = tagged.where(F.col("group_index").isNotNull() & (F.col("path").isNotNull() | F.col("repo_root").isNotNull()))
    listed = F.flatten(F.array(*[F.coalesce(paths.path_parts(F.col(c)), F.array().cast("array<string>")) for c in ("path", "repo_root")]))
    # Members of a group come before its context.
    from_atoms = signals.select(turn_id().alias("turn_id"), "pos", F.posexplode(listed).alias("rank", "part"))
    from_atoms = from_atoms.join(turns.select("turn_id"), "turn_id", "left_semi").select("turn_id", "pos", "rank", "part")
    first = (
        from_session.unionByName(from_atoms)
        .groupBy("turn_id", "part")
        .agg(F.min(F.struct("pos", "rank")).alias("at"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "part")))
    return first.groupBy("turn_id").agg(F.array_join(F.transform(ordered, lambda p: p.part), " ").alias("path_text"))


def turns_with_context(tagged: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """User turns with last activity and context summary in one table; tool calls are counted, not built."""
    turns = user_turns(tagged)
    summary = context_summary(turns, assistant_replies(tagged, sessions), visible_calls(tagged).select(turn_id().alias("turn_id")), sessions)
    return turns.join(last_activity(tagged), TURN, "left").join(summary, "turn_id", "left")
