"""Event logs: one record per thing that happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, roles, timekeys, tokens
from turnwise.functions.bind import bind
from turnwise.functions.paths import path_identity
from turnwise.sources.formats import core
from turnwise.sources.formats.core import SAY, item, items, some

# Event types that only mark the life of a task.
LIFECYCLE = (
    "context_compacted",
    "thread_goal_updated",
    "task_started",
    "task_complete",
    "turn_aborted",
    "entered_review_mode",
    "exited_review_mode",
    "thread_rolled_back",
    "item_completed",
    "thread_settings_applied",
)


def delegation_facts(parsed: DataFrame) -> DataFrame:
    """Per delegated session (from its own session_meta): parent, agent and where its own history starts."""
    v = F.col("v")
    spawn = "payload.source.subagent.thread_spawn"
    metas = parsed.where(jsonv.string(v, "type") == "session_meta").select(
        "session_ref",
        "source_platform",
        "ordinal",
        jsonv.string(v, "payload.id").alias("id"),
        jsonv.string(v, f"{spawn}.parent_thread_id", "payload.parent_thread_id").alias("d_parent"),
        jsonv.string(v, f"{spawn}.agent_nickname", "payload.agent_nickname", "payload.source.subagent.other").alias("d_name"),
        jsonv.string(v, f"{spawn}.agent_path", "payload.agent_path").alias("d_path"),
        jsonv.number(v, "payload.subagent_history_start_ordinal").alias("d_start"),
        (jsonv.is_object(jsonv.member(v, "payload.source.subagent")) | F.coalesce(jsonv.string(v, "payload.thread_source") == "subagent", F.lit(False))).alias("is_sub"),
    )
    own = metas.where(F.col("is_sub") & (F.col("session_ref") == F.concat(F.lit("sess:"), F.col("source_platform"), F.lit(":"), F.col("id"))))
    return own.groupBy("session_ref").agg(
        F.min_by(F.struct("d_parent", "d_name", F.coalesce("d_path", "d_name").alias("d_agent"), "d_start"), "ordinal").alias("delegation")
    )


def fragments_event_log(parsed: DataFrame) -> DataFrame:
    """Rows ``{timestamp, type, payload}``: session and turn context, response items, events.

    In a delegated session nothing a user or developer row says counts as user text, and rows before the session's own
    history are inherited. The cumulative and last token counts are kept; increments come from ``usage_deltas``.
    """
    v, p = F.col("v"), F.col("p")
    read = parsed.join(delegation_facts(parsed), "session_ref", "left").withColumns(
        {
            "p": bind(jsonv.member(v, "payload"), lambda m: F.when(jsonv.is_object(m), m)),
            "type": F.coalesce(jsonv.string(v, "type"), F.lit("unknown")),
            "time_key": F.coalesce(timekeys.coerce(jsonv.string(v, "timestamp")), F.col("observed_at")),
            "delegated": F.col("delegation.d_parent").isNotNull() | F.col("delegation.d_agent").isNotNull(),
            "inherited": F.coalesce(F.col("ordinal") < F.col("delegation.d_start"), F.lit(False)),
        }
    )
    read = read.withColumns(
        {
            "p_type": F.coalesce(jsonv.string(p, "type"), F.lit("unknown")),
            "role": F.coalesce(jsonv.string(p, "role"), F.lit("assistant")),
            "cwd": jsonv.string(p, "cwd"),
            "p_model": jsonv.string(p, "model"),
            "call": F.coalesce(jsonv.string(p, "call_id"), F.concat(F.lit("event:"), F.col("record_id"))),
            "own_meta": F.concat(F.lit("sess:"), F.col("source_platform"), F.lit(":"), jsonv.string(p, "id")) == F.col("session_ref"),
            "usage": tokens.extract(F.when(jsonv.string(p, "type") == "message", p).otherwise(F.coalesce(core.first_present(p, "info"), p))),
            "cumulative": tokens.extract(F.coalesce(core.first_present(p, "info"), p), tokens.CUMULATIVE_MEMBERS),
            "text_stop": roles.normalize_stop_reason(jsonv.string(p, "stop_reason")),
            "said": F.nullif(jsonv.string(p, "message"), F.lit("")),
        }
    )
    kind, p_type, inherited = F.col("type"), F.col("p_type"), F.col("inherited")
    delegated = F.coalesce("delegated", F.lit(False))
    actor = roles.map_role(F.col("role"))

    def handed_down(text: Column) -> Column:
        policy = F.when(F.length(text) > roles.COLLAPSE_ABOVE, "collapse").otherwise("show")
        return item("text", actor_kind="system", origin_kind="delegated_instruction", display_policy=policy, text=text)

    def hidden(label: Column) -> Column:
        return item("unknown", source_event_type=label, detail=F.to_json(p))

    def call(name: Column | str, given: Column) -> Column:
        return item("tool_call", call_id=F.col("call"), tool_name=name, tool_input=given)

    def result(output: Column) -> Column:
        return item("tool_result", call_id=F.col("call"), tool_output=output)

    def message_part(entry: Column) -> Column:
        passed_on = delegated & (inherited | F.col("role").isin("user", "developer"))
        opaque = jsonv.string(entry, "type").isin("reasoning", "encrypted_content", "thinking", "redacted_thinking")
        return bind(
            core.content_text(entry),
            lambda text: F.when((text != "") & passed_on, handed_down(text))
            .when(text != "", item(SAY, actor_kind=actor, text=text))
            .when(opaque, item("unknown", source_event_type=jsonv.string(entry, "type")))
            .otherwise(core.unknown(entry, "codex_unsupported_content_item")),
        )

    def agent_part(entry: Column) -> Column:
        return bind(core.content_text(entry), lambda text: F.when(text != "", handed_down(text)).otherwise(item("unknown", source_event_type="encrypted_content")))

    parts = F.filter(jsonv.array(p, "content"), jsonv.is_object)
    message = F.transform(parts, message_part).cast(core.ITEM_ARRAY)
    usage = F.col("usage")
    message = F.concat(message, items(some(~core.has_say(message) & usage.isNotNull(), core.usage_item(F.col("text_stop")))))
    relation = core.relation_json(
        parent_uuid=F.col("delegation.d_parent"),
        child_session_id=jsonv.string(p, "id"),
        is_sidechain=F.lit(True),
        agent_id=F.col("delegation.d_agent"),
        agent_nickname=F.col("delegation.d_name"),
    )
    own = F.coalesce("own_meta", F.lit(False))
    session = items(
        some(own & F.col("delegation.d_parent").isNotNull(), item("session_relation", relation=relation)),
        item("session_meta", detail=F.to_json(p)),
        some((~inherited | own) & (F.col("cwd") != ""), item("workspace_signal", path=F.col("cwd"))),
        some((~inherited | own) & (F.col("p_model") != ""), item("model_signal", model=F.col("p_model"))),
    )
    turn = items(
        some(~inherited & (F.col("cwd") != ""), item("workspace_signal", path=F.col("cwd"))),
        some(~inherited & (F.col("p_model") != ""), item("model_signal", model=F.col("p_model"))),
    )
    search_input = F.to_json(
        F.struct(
            jsonv.string(p, "query", "action.query").alias("query"),
            jsonv.string(p, "action.url").alias("url"),
            jsonv.string(p, "action.pattern").alias("pattern"),
            jsonv.string(p, "action.type").alias("action_type"),
        )
    )
    search_output = F.to_json(F.struct(jsonv.string(p, "query").alias("query"), jsonv.string(p, "action.type").alias("action_type")))
    given = core.tool_input(core.first_present(p, "arguments", "input"))
    output = F.coalesce(jsonv.string(p, "output"), F.to_json(core.first_present(p, "output")), F.lit("{}"))
    response = (
        F.when(p_type == "message", message)
        .when(p_type == "agent_message", F.transform(parts, agent_part).cast(core.ITEM_ARRAY))
        .when(p_type == "reasoning", items(item("unknown", source_event_type="reasoning")))
        .when(p_type.isin("function_call", "custom_tool_call"), items(call(F.coalesce(jsonv.string(p, "name"), p_type), given)))
        .when(p_type.isin("function_call_output", "custom_tool_call_output"), items(result(output)))
        .when(p_type == "web_search_call", items(call("web_search", search_input)))
        .when(p_type == "tool_search_call", items(call("tool_search", core.object_or_empty(jsonv.member(p, "arguments")))))
        .when(p_type == "tool_search_output", items(result(output)))
    )
    counted = core.usage_item(source_event_type="token_count")
    said = F.col("said")
    invocation = F.coalesce(F.to_json(core.first_present(p, "invocation.arguments", "arguments")), F.lit("{}"))
    returned = F.coalesce(jsonv.string(p, "result"), F.to_json(core.first_present(p, "result", "error")), F.lit("{}"))
    event = (
        F.when((p_type == "token_count") & usage.isNotNull(), items(counted))
        .when(said.isNotNull() & (p_type == "user_message"), items(F.when(delegated, handed_down(said)).otherwise(item(SAY, actor_kind="user", text=said))))
        .when(
            said.isNotNull() & (p_type == "agent_message"),
            items(
                F.when(delegated & inherited, handed_down(said)).otherwise(item(SAY, actor_kind="assistant", text=said)),
                some(~(delegated & inherited), hidden(p_type)),
            ),
        )
        .when(p_type == "web_search_call", items(call("web_search", search_input)))
        .when(p_type == "web_search_end", items(result(search_output)))
        .when(p_type == "tool_search_call", items(call("tool_search", core.object_or_empty(jsonv.member(p, "arguments")))))
        .when(p_type == "tool_search_output", items(result(output)))
        .when(
            p_type == "mcp_tool_call_end",
            items(call(F.coalesce(jsonv.string(p, "invocation.tool", "tool"), F.lit("mcp_tool")), invocation), result(returned)),
        )
        .when(
            p_type == "patch_apply_end",
            items(
                call("apply_patch", core.object_or_empty(jsonv.member(p, "changes"))),
                result(F.coalesce(jsonv.string(p, "stdout", "stderr"), F.lit(""))),
            ),
        )
        .when(p_type.isin("token_count", "user_message", "agent_message", "agent_reasoning", *LIFECYCLE), items(hidden(p_type)))
    )
    there = p.isNotNull()
    pieces = (
        F.when(there & (kind == "session_meta"), session)
        .when(there & (kind == "turn_context"), turn)
        .when(there & (kind == "response_item"), response)
        .when(there & (kind == "compacted"), items(hidden(F.coalesce(jsonv.string(p, "type"), kind))))
        .when(kind.isin("world_state", "inter_agent_communication_metadata"), items(item("unknown", source_event_type=kind)))
        .when(there & (kind == "event_msg"), event)
    )
    unhandled = items(core.unknown(v, "codex_unhandled_record_type"))
    return core.to_pieces(read.withColumns({"items": F.coalesce(pieces, unhandled), "text_usage": usage, "usage_on_text": kind == "response_item"}))


# Wire records that are evidence only.
WIRE_EVIDENCE = (
    "llm.request",
    "llm.tools_snapshot",
    "permission.record_approval_result",
    "permission.set_mode",
    "plan_mode.cancel",
    "plan_mode.enter",
    "swarm_mode.enter",
    "swarm_mode.exit",
    "tools.set_active_tools",
)


def fragments_wire(parsed: DataFrame) -> DataFrame:
    """Wire events: prompts and steers by origin, loop events, usage records; a state sidecar names the session."""
    v = F.col("v")
    read = parsed.withColumns(
        {
            "kind": F.coalesce(jsonv.string(v, "type"), F.lit("unknown")),
            "created": timekeys.coerce(jsonv.string(v, "createdAt")),
            "sent": timekeys.from_millis(jsonv.number(v, "time")),
            "event_kind": jsonv.string(v, "event.type"),
            "part_kind": jsonv.string(v, "event.part.type"),
            "origin": jsonv.string(v, "origin.kind"),
            "model": jsonv.string(v, "modelAlias", "model"),
            "title": jsonv.string(v, "title"),
            "workspace": path_identity(jsonv.string(v, "workDir")),
        }
    ).withColumn("time_key", F.coalesce(F.when(F.col("pointer") == "state", F.col("created")).otherwise(F.col("sent")), "observed_at"))
    kind, origin = F.col("kind"), F.col("origin")
    direct = origin.isNull() | (origin == "user")
    background = (kind == "turn.steer") & F.coalesce(origin == "background_task", F.lit(False))
    speaker = F.when(direct | background, "user").otherwise("system")
    from_whom = (
        F.when(direct, "user_authored")
        .when(background, "injected_user_shaped")
        .when(origin == "system_trigger", "automation_trigger")
        .otherwise("source_instruction")
    )

    def typed_in(entry: Column) -> Column:
        text = jsonv.string(entry, "text")
        spoken = item("text", actor_kind=speaker, origin_kind=from_whom, display_policy=F.when(direct, "show").otherwise("collapse"), text=text, source_event_type=kind)
        return F.when((jsonv.string(entry, "type") == "text") & (text != ""), spoken).otherwise(core.unknown(entry, "kimi_unsupported_input_item"))

    entered = F.transform(F.filter(jsonv.array(v, "input"), jsonv.is_object), typed_in).cast(core.ITEM_ARRAY)
    thinks = F.col("part_kind") == "think"
    uttered = F.when(thinks, jsonv.string(v, "event.part.think")).otherwise(jsonv.string(v, "event.part.text"))
    spoken = item(
        "text",
        actor_kind="assistant",
        origin_kind="assistant_authored",
        display_policy=F.when(thinks, "collapse").otherwise("show"),
        text=uttered,
        message_id=jsonv.string(v, "event.uuid"),
    )
    loop = (
        F.when(F.col("event_kind").isin("step.begin", "step.end"), core.no_items())
        .when((F.col("event_kind") == "content.part") & F.col("part_kind").isin("text", "think") & (uttered != ""), items(spoken))
        .when(
            F.col("event_kind") == "tool.call",
            items(
                item(
                    "tool_call",
                    call_id=jsonv.string(v, "event.toolCallId", "event.uuid"),
                    tool_name=F.coalesce(jsonv.string(v, "event.name"), F.lit("tool.call")),
                    tool_input=core.object_or_empty(jsonv.member(v, "event.args")),
                )
            ),
        )
        .when(
            F.col("event_kind") == "tool.result",
            items(
                item(
                    "tool_result",
                    call_id=jsonv.string(v, "event.toolCallId", "event.parentUuid"),
                    tool_output=core.tool_output(core.first_present(v, "event.result.output", "event.result")),
                )
            ),
        )
    )
    none = F.lit(None)
    numbers = {name: none for name in tokens.FIELDS} | {
        "input_tokens": jsonv.number(v, "usage.inputOther"),
        "cache_read_input_tokens": jsonv.number(v, "usage.inputCacheRead"),
        "cache_creation_input_tokens": jsonv.number(v, "usage.inputCacheCreation"),
        "output_tokens": jsonv.number(v, "usage.output"),
    }
    known = F.coalesce(*[numbers[n] for n in ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens")]).isNotNull()
    usage = bind(tokens.pack(numbers, jsonv.string(v, "model")), lambda u: u.withField("total_tokens", tokens.structured_total(u)))
    state = items(
        item("session_meta", detail=F.to_json(v)),
        some(F.col("title") != "", item("title_signal", title=F.col("title"))),
        some(F.col("workspace").isNotNull(), item("workspace_signal", path=F.col("workspace"))),
    )
    echo = (kind == "context.append_message") & F.coalesce(jsonv.string(v, "message.role") == "user", F.lit(False))
    pieces = (
        F.when(F.col("pointer") == "state", state)
        .when(kind == "metadata", items(item("session_meta", detail=F.to_json(v))))
        .when(kind == "config.update", items(some(F.col("model") != "", item("model_signal", model=F.col("model")))))
        .when(kind.isin("turn.prompt", "turn.steer"), F.when(F.size(entered) > 0, entered).otherwise(items(core.unknown(v, "kimi_input_text_missing"))))
        .when(echo, items(core.dropped("kimi_duplicate_user_context_echo")))
        .when(kind == "context.append_loop_event", loop)
        .when(kind == "usage.record", items(some(known, core.usage_item(source_event_type="usage.record"))))
        .when(kind.isin(*WIRE_EVIDENCE), core.no_items())
    )
    return core.to_pieces(
        read.withColumns({"items": F.coalesce(pieces, items(core.unknown(v, "kimi_unhandled_record_type"))), "text_usage": usage, "usage_on_text": F.lit(False)})
    )
