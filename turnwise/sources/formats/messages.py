"""Flat message rows with their own tool-call lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, roles, timekeys, tokens
from turnwise.functions.paths import decode_percent, path_identity
from turnwise.functions.text import strip
from turnwise.sources.formats import core
from turnwise.sources.formats.core import SAY, item, items, some


def fragments_multi_agent(parsed: DataFrame) -> DataFrame:
    """Messages with millisecond times, plus metadata rows of subagents, sessions and conversations."""
    v = F.col("v")
    read = parsed.withColumns(
        {
            "time_key": F.coalesce(timekeys.from_millis(jsonv.number(v, "timestamp")), timekeys.coerce(jsonv.string(v, "timestamp")), F.col("observed_at")),
            "role": jsonv.string(v, "role"),
            "content": jsonv.string(v, "content"),
            "error": F.coalesce(jsonv.boolean(v, "metadata.is_error"), jsonv.boolean(v, "metadata.isError"), F.lit(False)),
            "billed": tokens.extract(jsonv.member(v, "metadata.usage")),
            "text_stop": roles.normalize_stop_reason(jsonv.string(v, "stop_reason", "stopReason")),
            "label": jsonv.string(v, "label"),
            "title": jsonv.string(v, "title"),
            "session_model": jsonv.string(v, "sessionModel"),
            "directory": jsonv.string(v, "path"),
            "parent": jsonv.string(v, "parentSessionKey"),
        }
    ).withColumn("actor", roles.map_role(F.coalesce("role", F.lit("system"))))
    actor, content = F.col("actor"), F.col("content")
    spoken = items(
        some(
            (strip(content) != "") & F.col("error"),
            item("text", actor_kind=actor, origin_kind="source_meta", display_policy="show", text=strip(content)),
        ),
        some((strip(content) != "") & ~F.col("error"), item(SAY, actor_kind=actor, text=content)),
    )
    calls = F.transform(
        F.filter(jsonv.array(v, "toolCalls"), jsonv.is_object),
        lambda c: item(
            "tool_call",
            call_id=jsonv.string(c, "id"),
            tool_name=F.coalesce(jsonv.string(c, "name"), F.lit("unknown_tool")),
            tool_input=F.coalesce(
                F.when(jsonv.is_object(jsonv.member(c, "arguments")), F.to_json(jsonv.member(c, "arguments"))),
                F.when(jsonv.is_object(F.try_parse_json(jsonv.string(c, "arguments"))), jsonv.string(c, "arguments")),
                F.lit("{}"),
            ),
        ),
    ).cast(core.ITEM_ARRAY)
    answered = items(
        some(
            (F.col("role") == "tool") & (content != ""),
            item("tool_result", call_id=jsonv.string(v, "toolCallId", "tool_call_id", "tool_use_id"), tool_output=content),
        )
    )
    billed = items(some(~core.has_say(spoken) & F.col("billed").isNotNull() & (actor == "assistant"), core.usage_item()))
    message = F.concat(spoken, calls, answered, billed)
    empty = (F.size(message) == 0) & content.isNull()
    relation = core.relation_json(parent_uuid=F.col("parent"), is_sidechain=F.lit(True), agent_id=jsonv.string(v, "agentId"), relation_kind=F.lit("subagent"))
    titled = item("title_signal", title=F.col("title"))
    pieces = (
        F.when(
            (F.col("parent") != "") & (jsonv.string(v, "sessionKey") != ""),
            items(some(F.col("label") != "", item("title_signal", title=F.col("label"))), item("session_relation", relation=relation)),
        )
        .when(F.col("role").isNull() & (jsonv.string(v, "sessionId") != ""), items(some(F.col("title") != "", titled)))
        .when(
            F.col("role").isNull() & jsonv.string(v, "id").startswith("CID-"),
            items(
                some((F.col("title") != "") & (F.col("title") != "Session"), titled),
                some(F.col("session_model") != "", item("model_signal", model=F.col("session_model"))),
                some(F.col("directory") != "", item("workspace_signal", path=F.col("directory"))),
            ),
        )
        .when(empty, items(core.dropped("accio_empty_record")))
        .otherwise(message)
    )
    return core.to_pieces(read.withColumns({"items": pieces, "text_usage": F.col("billed")}))


def _plain_text(value: Column, path: str) -> Column:
    """A string member, or the texts of a list of parts joined by line ends."""
    parts = F.transform(jsonv.array(value, path), lambda e: F.coalesce(jsonv.as_string(e), core.content_text(e)))
    return F.coalesce(jsonv.string(value, path), F.nullif(F.array_join(F.filter(parts, lambda t: t != ""), "\n"), F.lit("")))


def fragments_chat_history(parsed: DataFrame) -> DataFrame:
    """Chat rows by type, with synthetic users, collapsed reasoning, tool calls and a summary sidecar."""
    v = F.col("v")
    read = parsed.withColumns(
        {
            "kind": F.coalesce(jsonv.string(v, "type"), F.lit("unknown")),
            "said_at": F.coalesce(timekeys.coerce(jsonv.string(v, "timestamp")), timekeys.from_millis(jsonv.number(v, "timestamp")), F.col("observed_at")),
            "created": timekeys.coerce(jsonv.string(v, "created_at")),
            "content": _plain_text(v, "content"),
            "summary": _plain_text(v, "summary"),
            "synthetic": F.coalesce(jsonv.string(v, "synthetic_reason") != "", F.lit(False)),
            "said_model": jsonv.string(v, "model_id", "model"),
            "billed": tokens.extract(v),
            "title": jsonv.string(v, "generated_title", "session_summary", "title"),
            "current_model": jsonv.string(v, "current_model_id", "model"),
            "directory": path_identity(F.coalesce(jsonv.string(v, "info.cwd", "git_root_dir"), decode_percent(jsonv.string(v, "encoded_cwd")))),
            "parent": jsonv.string(v, "parent_session_id", "info.parent_session_id"),
        }
    ).withColumn("time_key", F.when(F.col("pointer") == "summary", F.coalesce("created", "observed_at")).otherwise(F.col("said_at")))
    kind, content = F.col("kind"), F.col("content")
    instruction = item("text", actor_kind="system", origin_kind="source_instruction", display_policy="collapse", text=content)
    missing = core.unknown(v, "grok_input_text_missing")
    calls = F.transform(
        F.filter(jsonv.array(v, "tool_calls"), jsonv.is_object),
        lambda c: item(
            "tool_call",
            call_id=jsonv.string(c, "id", "call_id"),
            tool_name=F.coalesce(jsonv.string(c, "name", "tool_name"), F.lit("tool_call")),
            tool_input=core.tool_input(core.first_present(c, "arguments", "args", "input")),
        ),
    ).cast(core.ITEM_ARRAY)
    assistant = F.concat(
        items(
            some(F.col("said_model") != "", item("model_signal", model=F.col("said_model"))),
            some(content != "", item(SAY, actor_kind="assistant", text=content)),
        ),
        calls,
        items(some(F.col("billed").isNotNull(), core.usage_item(source_event_type="assistant"))),
    )
    reasoning = item(
        "text", actor_kind="assistant", origin_kind="assistant_authored", display_policy="collapse", text=F.col("summary"), message_id=jsonv.string(v, "id")
    )
    backend = item(
        "tool_call",
        call_id=jsonv.string(v, "kind.id", "id"),
        tool_name=F.coalesce(jsonv.string(v, "kind.tool_type", "kind.name", "tool_type"), F.lit("backend_tool_call")),
        tool_input=core.tool_input(core.first_present(v, "kind.action", "action")),
        source_event_type="backend_tool_call",
    )
    answered = item(
        "tool_result", call_id=jsonv.string(v, "tool_call_id", "call_id"), tool_output=core.tool_output(core.first_present(v, "content", "output", "result"))
    )
    sidecar = items(
        some(F.col("parent") != "", item("session_relation", relation=core.relation_json(parent_uuid=F.col("parent")))),
        item("session_meta", detail=F.to_json(v)),
        some(F.col("title") != "", item("title_signal", title=F.col("title"))),
        some(F.col("directory").isNotNull(), item("workspace_signal", path=F.col("directory"))),
        some(F.col("current_model") != "", item("model_signal", model=F.col("current_model"))),
    )
    unhandled = items(core.unknown(v, "grok_unhandled_record_type"))
    pieces = (
        F.when(F.col("pointer") == "summary", sidecar)
        .when(kind == "system", items(F.when(content != "", instruction).otherwise(missing)))
        .when((kind == "user") & F.col("synthetic"), items(F.when(content != "", instruction).otherwise(missing)))
        .when(kind == "user", items(F.when(content != "", item(SAY, actor_kind="user", text=content)).otherwise(missing)))
        .when(kind == "assistant", F.when(F.size(assistant) > 0, assistant).otherwise(unhandled))
        .when(kind == "reasoning", items(some(F.col("summary") != "", reasoning)))
        .when(kind == "backend_tool_call", items(backend))
        .when(kind == "tool_result", items(answered))
        .otherwise(unhandled)
    )
    return core.to_pieces(read.withColumns({"items": pieces, "text_model": F.col("said_model"), "text_usage": F.col("billed"), "usage_on_text": F.lit(False)}))


def fragments_cron_runs(parsed: DataFrame) -> DataFrame:
    """Runs of scheduled jobs: a title, an automation relation and the run's summary as system text."""
    v = F.col("v")
    read = parsed.withColumns(
        {
            "time_key": F.coalesce(
                timekeys.coerce(jsonv.string(v, "timestamp")),
                timekeys.coerce(jsonv.string(v, "runAt")),
                timekeys.from_millis(jsonv.number(v, "runAtMs", "startedAtMs")),
                F.col("observed_at"),
            ),
            "job": jsonv.string(v, "jobId", "job_id"),
            "run_session": jsonv.string(v, "sessionId", "session_id"),
            "run_key": jsonv.string(v, "sessionKey", "session_key"),
            "status": jsonv.string(v, "status"),
            "summary": jsonv.string(v, "summary"),
        }
    )
    relation = core.relation_json(
        parent_uuid=F.col("run_session"), session_key=F.col("run_key"), job_id=F.col("job"), status=F.col("status"), relation_kind=F.lit("automation_run")
    )
    pieces = items(
        some(F.col("job") != "", item("title_signal", title=F.concat(F.lit("cron:"), F.col("job")))),
        some(F.coalesce("job", "run_session", "run_key", "status").isNotNull(), item("session_relation", relation=relation)),
        some(F.col("summary") != "", item("text", actor_kind="system", origin_kind="source_meta", display_policy="show", text=F.col("summary"))),
    )
    return core.to_pieces(read.withColumn("items", pieces))
