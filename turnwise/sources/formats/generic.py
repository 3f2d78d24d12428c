"""The loose message shape shared by most exporters: many spellings for session facts, roles and content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, roles, timekeys, tokens
from turnwise.functions.bind import bind
from turnwise.functions.paths import path_identity
from turnwise.functions.text import strip
from turnwise.sources.formats import core
from turnwise.sources.formats.core import SAY, item, items, some

# Where exporters put a fact, in order of preference.
WORKSPACE = (
    "cwd", "workingDirectory", "working_directory", "workspacePath", "directory", "metadata.cwd", "metadata.workingDirectory",
    "session.cwd", "session.workingDirectory", "message.cwd", "workspace.path", "workspace.uri", "project.path",
    "antigravityLive.summary.workspaces[0].workspaceFolderAbsoluteUri",
)
REPO_ROOT = (
    "repoRoot", "repo_root", "metadata.repoRoot", "metadata.repo_root", "session.repoRoot", "session.repo_root", "message.repoRoot",
    "message.repo_root", "workspace.repoRoot", "workspace.repo_root", "workspace.gitRootAbsoluteUri", "project.repoRoot",
    "project.repo_root", "antigravityLive.summary.workspaces[0].gitRootAbsoluteUri",
)
REPO_REMOTE = (
    "repoRemote", "repo_remote", "metadata.repoRemote", "metadata.repo_remote", "session.repoRemote", "session.repo_remote",
    "message.repoRemote", "message.repo_remote", "workspace.repoRemote", "workspace.repo_remote", "workspace.gitOriginUrl",
    "project.repoRemote", "project.repo_remote", "project.gitOriginUrl", "repository.gitOriginUrl",
    "antigravityLive.summary.workspaces[0].repository.gitOriginUrl",
)
MODEL = (
    "model", "modelId", "model_id", "modelName", "model_name", "providerModel", "metadata.model", "session.model", "message.model",
    "data.modelId", "data.model",
)
TITLE = ("title", "name", "label", "sessionTitle", "session.title")
PARENT = (
    "parentUuid", "parentId", "parent_id", "callingSessionId", "calling_session_id", "session.parentUuid", "session.parentId",
    "session.parent_id", "session.callingSessionId", "session.calling_session_id",
)
CHILD = ("childSessionId", "child_session_id", "session.childSessionId", "session.child_session_id")
PARENT_TOOL = (
    "parentToolRef", "parent_tool_ref", "callingToolUseId", "calling_tool_use_id", "session.parentToolRef", "session.parent_tool_ref",
    "session.callingToolUseId", "session.calling_tool_use_id",
)
AGENT = (
    "agentId", "agent_id", "childAgentKey", "child_agent_key", "session.agentId", "session.agent_id", "session.childAgentKey",
    "session.child_agent_key",
)
# Where a message may hold its usage, in order; what is nested in it is read by ``tokens.extract``.
USAGE = ("usage", "token_usage", "tokenUsage", "tokens", "metadata.usage", "metadata.token_usage", "metadata.tokenUsage", "metadata.tokens")
ROLE = ("role", "author.role", "author.type", "author", "sender.role", "sender", "from", "info.role")
ROLE_ALIASES = {
    "user": ("human", "user", "operator"),
    "assistant": ("assistant", "ai", "model", "bot", "tool"),
    "system": ("developer", "system", "instruction"),
}


def generic_role(value: Column) -> Column:
    """Role of a message by any of its spellings, or by a type that is itself a role."""

    def alias(word: Column) -> Column:
        mapped = word
        for target, spellings in ROLE_ALIASES.items():
            mapped = F.when(word.isin(*spellings), target).otherwise(mapped)
        return mapped

    stated = F.nullif(F.lower(strip(jsonv.string(value, *ROLE))), F.lit(""))
    kind = F.lower(strip(jsonv.string(value, "type")))
    return F.coalesce(bind(stated, alias), F.when(kind.isin("user", "assistant", "system", "developer"), kind))


def tag(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(word), "([a-z0-9])([A-Z])", "$1_$2"), r"[\s-]+", "_"))


def _entries(message: Column, path: str) -> Column:
    """Entries of a content member that is a list, one object or one string."""

    def spread(given: Column) -> Column:
        listed = F.coalesce(F.try_variant_get(given, "$", "array<variant>"), F.array().cast("array<variant>"))
        usable = F.filter(listed, lambda e: jsonv.is_object(e) | (F.coalesce(strip(jsonv.as_string(e)), F.lit("")) != ""))
        alone = jsonv.is_object(given) | (F.coalesce(strip(jsonv.as_string(given)), F.lit("")) != "")
        return F.when(jsonv.is_array(given), usable).when(alone, F.array(given)).otherwise(F.array().cast("array<variant>"))

    return F.coalesce(bind(jsonv.member(message, path), spread), F.array().cast("array<variant>"))


def _call(entry: Column, kind: Column | None = None) -> Column:
    name = F.coalesce(jsonv.string(entry, "name", "tool_name"), kind if kind is not None else F.lit("tool_call"))
    return item(
        "tool_call",
        call_id=jsonv.string(entry, "id", "call_id", "tool_call_id"),
        tool_name=name,
        tool_input=core.tool_input(core.first_present(entry, "input", "arguments", "args")),
    )


def _result(entry: Column) -> Column:
    return item(
        "tool_result",
        call_id=jsonv.string(entry, "tool_use_id", "call_id", "id"),
        tool_output=core.tool_output(core.first_present(entry, "content", "output", "result", "text")),
    )


def _piece(entry: Column, actor: Column) -> Column:
    def pick(named: Column) -> Column:
        kind, text = named.getField("kind"), named.getField("text")
        synthetic = F.coalesce(jsonv.boolean(entry, "synthetic"), F.lit(False))
        instruction = item("text", actor_kind="system", origin_kind="source_instruction", display_policy="collapse", text=text)
        return (
            F.when(kind.isin("tool_use", "tool_call", "function_call"), _call(entry, kind))
            .when(kind.isin("tool_result", "function_result", "function_call_output"), _result(entry))
            .when((text != "") & synthetic, instruction)
            .when(text != "", item(SAY, actor_kind=actor, text=text))
            .otherwise(core.unknown(entry, "unsupported_content_item"))
        )

    bare = jsonv.as_string(entry)
    kind = F.when(bare.isNotNull(), "text").otherwise(F.coalesce(tag(jsonv.string(entry, "type")), F.lit("unknown")))
    return bind(F.struct(kind.alias("kind"), F.coalesce(bare, core.content_text(entry)).alias("text")), pick)


def prefilter_records(parsed: DataFrame) -> DataFrame:
    """Mark records that are kept as evidence only: skipped-run echoes (with an audit) and turn_ended rows (without)."""
    v = F.col("v")
    echo = (F.col("source_platform") == "codebuddy") & (
        F.coalesce(jsonv.boolean(v, "providerData.skipRun"), F.lit(False)) | F.coalesce(jsonv.string(v, "type") == "skip_run", F.lit(False))
    )
    ended = F.col("source_platform").isin("cursor", "cursor_agent") & (jsonv.string(v, "type") == "turn_ended")
    return parsed.withColumn("dropped", F.when(F.coalesce(echo, F.lit(False)), "echo").when(F.coalesce(ended, F.lit(False)), "ended"))


def fragments_generic(parsed: DataFrame) -> DataFrame:
    v, message = F.col("v"), F.col("message")
    said_at = [timekeys.coerce(jsonv.string(v, name)) for name in ("timestamp", "updatedAt", "createdAt", "created_at")]
    inner = jsonv.member(v, "message")
    read = prefilter_records(parsed).withColumns(
        {
            "message": bind(inner, lambda m: F.when(jsonv.is_object(m), m)),
            "time_key": F.coalesce(*said_at, F.col("observed_at")),
            "workspace": path_identity(jsonv.string(v, *WORKSPACE)),
            "root": path_identity(jsonv.string(v, *REPO_ROOT)),
            "remote": F.nullif(strip(jsonv.string(v, *REPO_REMOTE)), F.lit("")),
            "named_model": jsonv.string(v, *MODEL),
            "title": jsonv.string(v, *TITLE),
            "parent": jsonv.string(v, *PARENT),
            "child": jsonv.string(v, *CHILD),
            "parent_tool": jsonv.string(v, *PARENT_TOOL),
            "agent": jsonv.string(v, *AGENT),
            "side": F.coalesce(*[jsonv.boolean(v, name) for name in ("isSidechain", "sidechain", "session.isSidechain")]),
        }
    ).withColumn("message", F.coalesce("message", "v"))
    read = read.withColumns(
        {
            "role": F.coalesce(generic_role(v), generic_role(message)),
            "billed": tokens.extract(F.coalesce(core.first_present(message, *USAGE), core.first_present(v, "usage", "providerData.usage"))),
            "text_stop": roles.normalize_stop_reason(
                F.coalesce(jsonv.string(message, "stop_reason", "stopReason"), jsonv.string(v, "stop_reason", "stopReason"))
            ),
            "entries": F.concat(*[_entries(message, name) for name in ("content", "parts", "blocks")]),
            "calls": F.concat(
                F.filter(jsonv.array(message, "tool_calls"), jsonv.is_object),
                F.array_compact(F.array(bind(jsonv.member(message, "tool_call"), lambda m: F.when(jsonv.is_object(m), m)))),
            ),
            "results": F.concat(
                F.filter(jsonv.array(message, "tool_results"), jsonv.is_object),
                F.array_compact(F.array(bind(jsonv.member(message, "tool_result"), lambda m: F.when(jsonv.is_object(m), m)))),
            ),
            "spare": F.nullif(jsonv.string(message, "text", "output_text", "input_text", "output", "response", "message"), F.lit("")),
        }
    ).withColumns({"actor": roles.map_role(F.coalesce("role", F.lit("assistant"))), "role_tag": tag(F.col("role"))})
    actor = F.col("actor")
    content = F.concat(
        F.transform("entries", lambda e: _piece(e, actor)).cast(core.ITEM_ARRAY),
        F.transform("calls", lambda e: _call(e)).cast(core.ITEM_ARRAY),
        F.transform("results", _result).cast(core.ITEM_ARRAY),
    )
    only_text = items(some(strip(F.col("spare")) != "", item(SAY, actor_kind=actor, text=F.col("spare"))))
    whole_result = items(
        item(
            "tool_result",
            call_id=jsonv.string(message, "toolUseId", "tool_use_id", "toolCallId", "tool_call_id", "id"),
            tool_output=core.tool_output(jsonv.member(message, "content")),
        )
    )
    read = read.withColumn("spoken", F.when(F.size(F.concat("entries", "calls", "results")) == 0, only_text).otherwise(content))
    spoken = F.col("spoken")
    read = read.withColumn("spoken", F.when(F.col("role_tag").isin("tool_result", "toolresult") & (F.size(spoken) > 0), whole_result).otherwise(spoken))
    related = F.coalesce("parent", "parent_tool", "agent").isNotNull() | F.coalesce("side", F.lit(False))
    relation = core.relation_json(
        parent_uuid=F.col("parent"),
        child_session_id=F.col("child"),
        is_sidechain=F.col("side"),
        parent_tool_ref=F.col("parent_tool"),
        agent_id=F.col("agent"),
    )
    signals = items(
        some(F.col("workspace").isNotNull(), item("workspace_signal", path=F.col("workspace"), repo_root=F.col("root"), repo_remote=F.col("remote"))),
        some(F.col("named_model") != "", item("model_signal", model=F.col("named_model"))),
        some(F.col("title") != "", item("title_signal", title=F.col("title"))),
        some(related, item("session_relation", relation=relation)),
    )
    nothing = F.col("role").isNull() & (F.size("spoken") == 0)
    unbilled = items(some(~core.has_say(F.col("spoken")) & F.col("billed").isNotNull() & (actor == "assistant"), core.usage_item(F.col("text_stop"))))
    read = read.withColumn("signals", signals)
    pieces = (
        F.when(F.col("dropped") == "echo", items(core.dropped("codebuddy_skiprun_command_echo")))
        .when(F.col("dropped") == "ended", core.no_items())
        .when(nothing & (F.size("signals") > 0), F.col("signals"))
        .when(nothing, items(core.unknown(v, "unhandled_record")))
        .otherwise(F.concat("signals", "spoken", unbilled))
    )
    return core.to_pieces(read.withColumns({"items": pieces, "signal_count": F.size("signals"), "text_usage": F.col("billed")}))
