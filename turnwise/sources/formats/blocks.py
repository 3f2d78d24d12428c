"""Records whose message content is a list of typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, roles, timekeys, tokens
from turnwise.functions.bind import bind
from turnwise.functions.paths import path_identity
from turnwise.functions.text import strip
from turnwise.sources.formats import core
from turnwise.sources.formats.core import SAY, item, items, some


def _block(entry: Column, actor: Column, code: str, thinking: str, extra_calls: tuple[str, ...] = ()) -> Column:
    """One content block as an item. ``thinking`` tells how reasoning blocks are kept: ``opaque``, ``text`` or ``say``."""
    kind = F.coalesce(jsonv.string(entry, "type"), F.lit("unknown"))

    def pick(named: Column) -> Column:
        kind, text = named.getField("kind"), named.getField("text")
        branch = F.when(
            kind.isin("tool_use", *extra_calls),
            item(
                "tool_call",
                call_id=jsonv.string(entry, "id"),
                tool_name=F.coalesce(jsonv.string(entry, "name"), kind),
                tool_input=core.object_or_empty(jsonv.member(entry, "input")),
                source_event_type=F.when(kind != "tool_use", kind),
            ),
        ).when(
            kind == "tool_result",
            item("tool_result", call_id=jsonv.string(entry, "tool_use_id"), tool_output=core.tool_output(jsonv.member(entry, "content"))),
        )
        if thinking == "opaque":
            branch = branch.when(kind.isin("thinking", "redacted_thinking"), item("unknown", source_event_type=kind))
            mark = item(
                "text",
                actor_kind="system",
                origin_kind="source_meta",
                display_policy="hide",
                text=strip(text),
                audit="interruption_marker_excluded|info|dropped_for_projection",
            )
            branch = branch.when(roles.is_interruption(text), mark)
        elif thinking == "text":
            kept = item("text", actor_kind="system", origin_kind="source_meta", display_policy="collapse", text=jsonv.string(entry, "thinking"))
            branch = branch.when((kind == "thinking") & (jsonv.string(entry, "thinking") != ""), kept)
        return branch.when(text != "", item(SAY, actor_kind=actor, text=text)).otherwise(core.unknown(entry, code))

    return bind(F.struct(kind.alias("kind"), core.content_text(entry).alias("text")), pick)


def _blocks(message: Column, actor: Column, code: str, thinking: str, extra_calls: tuple[str, ...] = ()) -> Column:
    objects = F.filter(jsonv.array(message, "content"), jsonv.is_object)
    return F.transform(objects, lambda entry: _block(entry, actor, code, thinking, extra_calls)).cast(core.ITEM_ARRAY)


def fragments_message_blocks(parsed: DataFrame) -> DataFrame:
    """Rows with session fields around a ``message`` of blocks; usage is billed per (message, request, side thread)."""
    v, message = F.col("v"), F.col("message")
    kind = jsonv.string(v, "type")
    base = parsed.withColumns(
        {
            "message": jsonv.member(v, "message"),
            "time_key": F.coalesce(timekeys.coerce(jsonv.string(v, "timestamp")), F.col("observed_at")),
            "cwd": jsonv.string(v, "cwd"),
            "parent": jsonv.string(v, "parentUuid", "parentId"),
            "side": jsonv.boolean(v, "isSidechain"),
        }
    )
    role = F.coalesce(jsonv.string(message, "role"), F.when(kind == "assistant", "assistant").when(kind == "user", "user").otherwise("system"))
    read = base.withColumns(
        {
            "actor": roles.map_role(role),
            "text_model": jsonv.string(message, "model"),
            "text_stop": roles.normalize_stop_reason(jsonv.string(message, "stop_reason")),
            "mid": jsonv.string(message, "id"),
            "request": F.coalesce(jsonv.string(v, "requestId", "request_id"), jsonv.string(message, "requestId", "request_id")),
            "plain": jsonv.string(message, "content"),
            "billed": core.with_model(tokens.extract(message), jsonv.string(message, "model")),
        }
    )
    actor, side = F.col("actor"), F.coalesce("side", F.lit(False))
    spoken = F.concat(
        items(some(F.col("plain") != "", item(SAY, actor_kind=actor, text=F.col("plain")))),
        _blocks(message, actor, "claude_unsupported_content_item", "opaque", ("server_tool_use",)),
    )
    signals = items(
        some(F.col("cwd") != "", item("workspace_signal", path=F.col("cwd"))),
        some(
            (F.col("parent") != "") | side,
            item("session_relation", relation=core.relation_json(parent_uuid=F.col("parent"), is_sidechain=side)),
        ),
        some((actor == "assistant") & (F.col("text_model") != ""), item("model_signal", model=F.col("text_model"))),
    )
    bill = items(
        some(
            F.col("billed").isNotNull() & (actor == "assistant"),
            core.usage_item(F.col("text_stop"), message_id=F.col("mid"), request_id=F.col("request"), is_sidechain=F.col("side")),
        )
    )
    return core.to_pieces(
        read.withColumns({"items": F.concat(signals, spoken, bill), "signal_count": F.size(signals), "text_usage": F.col("billed"), "usage_on_text": F.lit(False), "text_message_id": F.when(actor == "assistant", F.col("mid"))})
    )


def fragments_factory(parsed: DataFrame) -> DataFrame:
    """Typed rows (session_start, message, lifecycle) and a settings sidecar with session-wide usage."""
    v, message = F.col("v"), F.col("message")
    base = parsed.withColumns(
        {
            "kind": F.coalesce(jsonv.string(v, "type"), F.lit("unknown")),
            "message": jsonv.member(v, "message"),
            "time_key": F.coalesce(timekeys.coerce(jsonv.string(v, "timestamp")), F.col("observed_at")),
        }
    )
    read = base.withColumns(
        {
            "actor": roles.map_role(F.coalesce(jsonv.string(message, "role"), F.lit("assistant"))),
            "text_stop": roles.normalize_stop_reason(jsonv.string(message, "stop_reason")),
            "billed": tokens.extract(message),
            "settings_usage": tokens.extract(core.first_present(v, "tokenUsage", "usage")),
            "settings_model": jsonv.string(v, "model"),
            "title": jsonv.string(v, "sessionTitle", "title"),
            "cwd": jsonv.string(v, "cwd"),
            "parent": jsonv.string(v, "callingSessionId", "calling_session_id", "parentUuid", "parent_uuid", "parentId", "parent_id"),
            "tool": jsonv.string(v, "callingToolUseId", "calling_tool_use_id", "parentToolRef", "parent_tool_ref"),
            "agent": jsonv.string(v, "agentId", "agent_id", "childAgentKey", "child_agent_key"),
            "side": F.coalesce(jsonv.boolean(v, "isSidechain"), jsonv.boolean(v, "sidechain")),
        }
    ).withColumn("said_model", F.coalesce(jsonv.string(message, "model"), F.col("billed.model")))
    actor = F.col("actor")
    usage = core.with_model(F.col("billed"), F.col("said_model"))
    related = F.coalesce("parent", "tool", "agent").isNotNull() | F.coalesce("side", F.lit(False))
    relation = core.relation_json(parent_uuid=F.col("parent"), is_sidechain=F.col("side"), parent_tool_ref=F.col("tool"), agent_id=F.col("agent"))
    spoken = _blocks(message, actor, "factory_droid_unsupported_content_item", "text")
    signals = items(
        some(related, item("session_relation", relation=relation)),
        some((actor == "assistant") & (F.col("said_model") != ""), item("model_signal", model=F.col("said_model"))),
    )
    unbilled = items(some(~core.has_say(spoken) & usage.isNotNull() & (actor == "assistant"), core.usage_item(F.col("text_stop"))))
    todo = jsonv.array(v, "todos")
    summary = F.coalesce(jsonv.string(v, "summary", "summaryText", "summary_text"), jsonv.string(v, "finalText", "final_text"), jsonv.string(v, "todos"))
    lifecycle = core.relation_json(
        status=jsonv.string(v, "status"),
        reason=jsonv.string(v, "reason"),
        todo_item_count=F.nullif(F.size(todo), F.lit(0)),
        text_present=summary.isNotNull(),
        text_bytes=F.length(summary),
    )
    settings = items(
        some(F.col("settings_model") != "", item("model_signal", model=F.col("settings_model"))),
        some(F.col("settings_usage").isNotNull(), core.usage_item(source_event_type="settings_token_usage")),
    )
    start = items(
        item("session_meta", detail=F.to_json(v)),
        some(F.col("title") != "", item("title_signal", title=F.col("title"))),
        some(F.col("cwd") != "", item("workspace_signal", path=F.col("cwd"))),
    )
    pieces = (
        F.when(F.col("pointer") == "settings", settings)
        .when(F.col("kind") == "session_start", start)
        .when((F.col("kind") == "message") & jsonv.is_object(message), F.concat(signals, spoken, unbilled))
        .when(F.col("kind").isin("todo_state", "session_end", "compaction_state"), items(item("unknown", source_event_type=F.col("kind"), detail=lifecycle)))
        .otherwise(items(core.unknown(v, "factory_droid_unhandled_record_type")))
    )
    count = F.when(F.col("kind") == "message", F.size(signals)).otherwise(0)
    return core.to_pieces(read.withColumns({"items": pieces, "signal_count": count, "text_usage": F.when(F.col("pointer") == "settings", F.col("settings_usage")).otherwise(usage)}))


def fragments_thread(parsed: DataFrame) -> DataFrame:
    """A thread's root (title, first workspace tree) and its messages of blocks."""
    v = F.col("v")
    sent = F.coalesce(
        timekeys.coerce(jsonv.string(v, "timestamp")),
        timekeys.from_millis(jsonv.number(v, "meta.sentAt")),
        timekeys.from_millis(jsonv.number(v, "created")),
        F.col("observed_at"),
    )
    tree = F.get(F.filter(jsonv.array(v, "env.initial.trees"), lambda t: jsonv.string(t, "uri") != ""), F.lit(0))
    read = parsed.withColumns(
        {
            "time_key": sent,
            "actor": roles.map_role(F.coalesce(jsonv.string(v, "role"), F.lit("assistant"))),
            "text_stop": roles.normalize_stop_reason(jsonv.string(v, "state.stopReason", "stopReason")),
            "billed": tokens.extract(jsonv.member(v, "usage")),
            "title": jsonv.string(v, "title"),
            "uri": jsonv.string(tree, "uri"),
        }
    ).withColumn("said_model", F.coalesce(jsonv.string(v, "model"), F.col("billed.model")))
    actor = F.col("actor")
    usage = core.with_model(F.col("billed"), F.col("said_model"))
    spoken = _blocks(v, actor, "amp_unsupported_content_item", "say")
    root = items(
        some(F.col("title") != "", item("title_signal", title=F.col("title"))),
        some(F.col("uri") != "", item("workspace_signal", path=path_identity(F.col("uri")))),
    )
    message = F.concat(
        items(some((actor == "assistant") & (F.col("said_model") != ""), item("model_signal", model=F.col("said_model")))),
        spoken,
        items(some(~core.has_say(spoken) & usage.isNotNull() & (actor == "assistant"), core.usage_item(F.col("text_stop")))),
    )
    count = F.when((actor == "assistant") & (F.col("said_model") != ""), 1).otherwise(0)
    pieces = F.when(F.col("pointer") == "root", root).otherwise(message)
    return core.to_pieces(read.withColumns({"items": pieces, "signal_count": count, "text_usage": usage}))
