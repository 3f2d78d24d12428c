"""Conversations as real records of every format: calls, results, usage, models, titles, places and relations.

Every message becomes the records that a tool of the format would write for it, and what the profile reads out of them is
compared fact by fact: (conv, turn, kind, what).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import jsonv
from turnwise.plans.catalog.registry import query
from turnwise.schemas import RECORD, complete
from turnwise.sources import bridge, files
from turnwise.sources.formats import fragments_of

def _struct(**members):
    return F.struct(*[(v if hasattr(v, "alias") else F.lit(v)).alias(n) for n, v in members.items()])


class _Row:
    """What the records of a message are made of."""

    def __init__(self) -> None:
        conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
        self.conv, self.turn, self.role, self.text = conv, turn, role, F.col("text")
        self.call, self.tool, self.output = self.id("c:"), F.concat(F.lit("tool-"), turn % 3), F.concat(F.lit("found "), turn)
        self.input = F.struct(F.concat(F.lit("/f/"), conv).alias("path"))
        self.model, self.place, self.title = F.concat(F.lit("m"), conv % 3), F.concat(F.lit("/w/p"), conv % 9), F.concat(F.lit("Talk "), conv)
        self.parent = F.when(conv % 4 == 0, F.concat(F.lit("s"), conv - 1))
        self.fresh, self.cached, self.written = turn + 100, conv % 50 + 10, turn + 5
        self.first, self.says, self.is_user = turn == 0, role == "assistant", role == "user"
        self.returned = F.array(_struct(type="tool_result", tool_use_id=self.call, content=F.array(_struct(type="text", text=self.output))))

    def id(self, prefix):
        return F.concat(F.lit(prefix), F.col("conv_id"), F.lit(":"), F.col("turn"))

    def usage(self, inp="input_tokens", read="cache_read_input_tokens", out="output_tokens", **more):
        return _struct(**{inp: self.fresh, read: self.cached, out: self.written}, **more)

    def blocks(self, thought=None):
        """Content blocks of a message: what is thought, what is said, and the call of a tool."""
        none = lambda kind: F.lit(None).cast(kind)
        block = lambda **said: _struct(**({"type": none("string"), "text": none("string"), "thinking": none("string"), "id": none("string"), "name": none("string"), "input": none("struct<path:string>")} | said))
        thinks = F.when(self.says & F.lit(thought).isNotNull(), block(type="thinking", thinking=F.lit(thought).cast("string")))
        return F.array_compact(F.array(thinks, block(type="text", text=self.text), F.when(self.says, block(type="tool_use", id=self.call, name=self.tool, input=self.input))))


def _record(suffix, members, when=None, pointer=None):
    """One record of a row; members of null are left out of its JSON."""
    made = F.struct(F.lit(suffix).alias("suffix"), F.lit(pointer).cast("string").alias("pointer"), F.to_json(_struct(**members)).alias("raw_json"))
    return made if when is None else F.when(when, made)


def _facts(spark, sf_dir, profile, platform, *records):
    """(conv, turn, kind, what) of all fragments of all records."""
    rows = bridge.table(spark, sf_dir, "conversations")
    each = rows.select("conv_id", "turn", F.posexplode(F.array_compact(F.array(*records))).alias("no", "r"))
    raw = each.select(
        F.lit("conv").alias("source_id"), F.lit(platform).alias("source_platform"), F.concat(F.lit("b:"), F.col("conv_id")).alias("blob_id"), F.lit("/logs/a.jsonl").alias("origin_path"),
        F.concat(F.lit("sess:conv:"), F.col("conv_id")).alias("session_ref"), F.concat_ws(":", "conv_id", "turn", "r.suffix").alias("record_id"), (F.col("turn") * 8 + F.col("no")).alias("ordinal"), F.col("r.pointer").alias("pointer"),
        F.lit("2024-01-01T00:00:00.000Z").alias("observed_at"), F.col("r.raw_json").alias("raw_json"),
    )
    fragments, _ = fragments_of(complete(raw, RECORD), profile)
    return told(fragments)


def told(fragments):
    kind = F.col("fragment_kind")
    fact = lambda name, *parts: F.struct(F.lit(name).alias("kind"), F.concat_ws(":", *parts).alias("what"))
    numbers = lambda c: [F.coalesce(F.col(f"{c}.{n}").cast("string"), F.lit("-")) for n in ("input_tokens", "cache_read_input_tokens", "output_tokens", "total_tokens")]
    said = F.array(
        F.when(kind == "text", fact("text", "actor_kind", F.md5(F.trim("text")))),
        F.when(kind == "tool_call", fact("tool_call", "call_id", "tool_name", "tool_input")),
        F.when(kind == "tool_result", fact("tool_result", "call_id", "tool_output")),
        F.when(kind == "model_signal", fact("model", "model")),
        F.when(kind == "workspace_signal", fact("place", "path")),
        F.when(kind == "title_signal", fact("title", "title")),
        F.when(kind == "session_relation", fact("parent", F.coalesce(jsonv.string(F.try_parse_json("relation"), "parent_uuid"), F.lit("-")))),
        F.when(kind.isin("session_meta", "unknown"), fact("kept", kind)),
        F.when(F.col("usage").isNotNull(), fact("usage", *numbers("usage"))),
        F.when(F.col("cumulative_usage").isNotNull(), fact("running", *numbers("cumulative_usage"))),
    )
    at = F.split("record_id", ":")
    found = fragments.select(F.get(at, F.lit(0)).cast("bigint").alias("conv"), F.get(at, F.lit(1)).cast("bigint").alias("turn"), F.explode(F.array_compact(said)).alias("f"))
    return found.select("conv", "turn", "f.kind", "f.what")


# --- what is to be found -------------------------------------------------------------------------------------------------

ROWS = """c AS (SELECT conv_id AS conv, turn, role, md5(trim(text)) AS said, 'c:' || conv_id || ':' || turn AS call, 'tool-' || (turn % 3) AS tool, '{"path":"/f/' || conv_id || '"}' AS input, 'found ' || turn AS output,
    'm' || (conv_id % 3) AS model, '/w/p' || (conv_id % 9) AS place, 'Talk ' || conv_id AS title, 's' || (conv_id - 1) AS parent, 100 + turn AS fresh, 10 + conv_id % 50 AS cached, 5 + turn AS written FROM conversations)"""
_PARTS = {
    "text": "SELECT conv, turn, 'text' AS kind, role || ':' || said AS what FROM c",
    "calls": "SELECT conv, turn, 'tool_call', call || ':' || tool || ':' || input FROM c WHERE role = 'assistant' UNION ALL SELECT conv, turn, 'tool_result', call || ':' || output FROM c WHERE role = 'assistant'",
    "usage": "SELECT conv, turn, 'usage', fresh || ':' || cached || ':' || written || ':' || (fresh + cached + written) FROM c WHERE role = 'assistant'",
    "models": "SELECT conv, turn, 'model', model FROM c WHERE role = 'assistant'",
    "model": "SELECT conv, turn, 'model', model FROM c WHERE turn = 0",
    "place": "SELECT conv, turn, 'place', place FROM c WHERE turn = 0",
    "title": "SELECT conv, turn, 'title', title FROM c WHERE turn = 0",
    "parent": "SELECT conv, turn, 'parent', parent FROM c WHERE turn = 0 AND conv % 4 = 0",
    "meta": "SELECT conv, turn, 'kept', 'session_meta' FROM c WHERE turn = 0",
    "thoughts": "SELECT conv, turn, 'kept', 'unknown' FROM c WHERE role = 'assistant'",
}


def _sql(*parts, more=()):
    return f"WITH {ROWS} " + " UNION ALL ".join([*(_PARTS[p] for p in parts), *more])


# --- formats -------------------------------------------------------------------------------------------------------------


@query("shapes_generic", _sql("text", "calls", "usage", "models", "place", "title", "parent"))
def shapes_generic(spark, sf_dir):
    """Usage lies two members below the message's own."""
    g = _Row()
    call = F.array(_struct(id=g.call, name=g.tool, arguments=g.input))
    head = _record("head", {"cwd": F.concat(F.lit("/w/./"), F.substring(g.place, 4, 9)), "title": g.title, "parentId": g.parent}, g.first)
    message = _record("said", {
        "role": g.role, "content": F.array(_struct(type="text", text=g.text)), "tool_calls": F.when(g.says, call), "model": F.when(g.says, g.model),
        "usage": F.when(g.says, _struct(metadata=_struct(tokens=g.usage("promptTokens", "cacheReadTokens", "completionTokens")))), "stopReason": F.when(g.says, "stop"),
    })
    result = _record("out", {"role": "assistant", "tool_results": F.array(_struct(call_id=g.call, output=g.output))}, g.says)
    return _facts(spark, sf_dir, "generic", "gemini", head, message, result)


@query("shapes_message_blocks", _sql("text", "calls", "usage", "models", "place", "parent", "thoughts"))
def shapes_message_blocks(spark, sf_dir):
    g = _Row()
    message = _struct(id=g.id("m"), role=g.role, model=F.when(g.says, g.model), stop_reason=F.when(g.says, "tool_use"), usage=F.when(g.says, g.usage()), content=g.blocks("hm"))
    said = _record("said", {"type": g.role, "requestId": g.id("q"), "cwd": F.when(g.first, g.place), "parentUuid": F.when(g.first, g.parent), "message": message})
    result = _record("out", {"type": "user", "message": _struct(role="user", content=g.returned)}, g.says)
    return _facts(spark, sf_dir, "message_blocks", "claude_code", said, result)


@query(
    "shapes_event_log",
    _sql("text", "calls", "usage", "model", "place", "meta", more=["SELECT conv, turn, 'running', (fresh * 10) || ':' || '-' || ':' || (written * 10) || ':' || ((fresh + written) * 10) FROM c WHERE role = 'assistant'"]),
)
def shapes_event_log(spark, sf_dir):
    """The tool counts cached tokens as a part of its input; running totals stand beside the last ones."""
    g = _Row()
    head = _record("head", {"type": "session_meta", "payload": _struct(id=g.id("x"), cwd=g.place)}, g.first)
    context = _record("context", {"type": "turn_context", "payload": _struct(model=g.model)}, g.first)
    part = F.array(_struct(type=F.when(g.says, "output_text").otherwise("input_text"), text=g.text))
    said = _record("said", {"type": "response_item", "payload": _struct(type="message", role=g.role, content=part)})
    call = _record("call", {"type": "response_item", "payload": _struct(type="function_call", name=g.tool, call_id=g.call, arguments=F.to_json(g.input))}, g.says)
    result = _record("out", {"type": "response_item", "payload": _struct(type="function_call_output", call_id=g.call, output=g.output)}, g.says)
    last = _struct(input_tokens=g.fresh + g.cached, cached_input_tokens=g.cached, output_tokens=g.written)
    count = _struct(type="token_count", info=_struct(last_token_usage=last, total_token_usage=_struct(input_tokens=g.fresh * 10, output_tokens=g.written * 10)))
    return _facts(spark, sf_dir, "event_log", "codex", head, context, said, call, result, _record("use", {"type": "event_msg", "payload": count}, g.says))


@query("shapes_factory", _sql("text", "calls", "usage", "models", "place", "title", "parent", "meta", more=["SELECT conv, turn, 'model', model FROM c WHERE turn = 0", "SELECT conv, turn, 'usage', fresh || ':' || cached || ':' || written || ':' || (fresh + cached + written) FROM c WHERE turn = 0"]))
def shapes_factory(spark, sf_dir):
    """With a settings document that holds the session's model and usage."""
    g = _Row()
    start = _record("head", {"type": "session_start", "title": g.title, "cwd": g.place}, g.first)
    settings = _record("settings", {"model": g.model, "tokenUsage": g.usage("inputTokens", "cacheReadTokens", "outputTokens")}, g.first, "settings")
    message = _struct(role=g.role, model=F.when(g.says, g.model), usage=F.when(g.says, g.usage()), content=g.blocks())
    said = _record("said", {"type": "message", "parentId": F.when(g.first, g.parent), "message": message})
    result = _record("out", {"type": "message", "message": _struct(role="user", content=g.returned)}, g.says)
    return _facts(spark, sf_dir, "factory", "factory_droid", start, settings, said, result)


@query("shapes_thread", _sql("text", "calls", "usage", "models", "place", "title"))
def shapes_thread(spark, sf_dir):
    g = _Row()
    trees = F.array(_struct(uri=F.concat(F.lit("file://"), g.place)))
    root = _record("root", {"title": g.title, "env": _struct(initial=_struct(trees=trees))}, g.first, "root")
    said = _record("said", {"role": g.role, "content": g.blocks(), "usage": F.when(g.says, g.usage("inputTokens", "cacheReadInputTokens", "outputTokens", model=g.model)), "state": _struct(stopReason="end_turn")})
    return _facts(spark, sf_dir, "thread", "amp", root, said, _record("out", {"role": "user", "content": g.returned}, g.says))


@query(
    "shapes_multi_agent",
    _sql("text", "calls", "usage", "model", "place", "title", "parent", more=["SELECT conv, turn, 'text', 'assistant:' || md5(output) FROM c WHERE role = 'assistant'", "SELECT conv, turn, 'title', 'Agent ' || title FROM c WHERE turn = 0 AND conv % 4 = 0"]),
)
def shapes_multi_agent(spark, sf_dir):
    """With rows about the conversation and about subagents; what a tool returns is also said."""
    g = _Row()
    meta = _record("head", {"id": g.id("CID-"), "title": g.title, "sessionModel": g.model, "path": g.place}, g.first)
    agent = _record("agent", {"sessionKey": g.id("k"), "parentSessionKey": g.parent, "label": F.concat(F.lit("Agent "), g.title), "agentId": "a"}, g.first & g.parent.isNotNull())
    call = F.array(_struct(id=g.call, name=g.tool, arguments=g.input))
    said = _record("said", {"role": g.role, "content": g.text, "toolCalls": F.when(g.says, call), "metadata": F.when(g.says, _struct(usage=g.usage()))})
    return _facts(spark, sf_dir, "multi_agent", "accio", meta, agent, said, _record("out", {"role": "tool", "content": g.output, "toolCallId": g.call}, g.says))


@query(
    "shapes_chat_history",
    _sql("text", "calls", "usage", "models", "model", "place", "title", "parent", "meta", more=["SELECT conv, turn, 'text', 'assistant:' || md5('thought ' || turn) FROM c WHERE role = 'assistant'"]),
)
def shapes_chat_history(spark, sf_dir):
    """With a summary document, reasoning rows, and usage in the message's metadata."""
    g = _Row()
    summary = _record("summary", {"generated_title": g.title, "info": _struct(cwd=g.place), "current_model_id": g.model, "parent_session_id": g.parent}, g.first, "summary")
    call = F.array(_struct(id=g.call, name=g.tool, arguments=F.to_json(g.input)))
    said = _record("said", {"type": g.role, "content": g.text, "tool_calls": F.when(g.says, call), "model_id": F.when(g.says, g.model), "metadata": F.when(g.says, _struct(usage=g.usage()))})
    thought = _record("thought", {"type": "reasoning", "summary": F.array(_struct(type="text", text=F.concat(F.lit("thought "), g.turn)))}, g.says)
    return _facts(spark, sf_dir, "chat_history", "grok", summary, said, thought, _record("out", {"type": "tool_result", "tool_call_id": g.call, "content": g.output}, g.says))


@query("shapes_wire", _sql("text", "calls", "usage", "model", "place", "title", "meta"))
def shapes_wire(spark, sf_dir):
    """Prompts, loop events, usage records, a state document and a change of the model."""
    g = _Row()
    state = _record("state", {"title": g.title, "workDir": g.place}, g.first, "state")
    config = _record("config", {"type": "config.update", "modelAlias": g.model}, g.first)
    part = _struct(type="text", text=g.text)
    prompt = _record("said", {"type": "turn.prompt", "input": F.array(part), "origin": F.when(g.role == "system", _struct(kind="hook"))}, ~g.says)
    said = _record("said", {"type": "context.append_loop_event", "event": _struct(type="content.part", part=part)}, g.says)
    call = _record("call", {"type": "context.append_loop_event", "event": _struct(type="tool.call", toolCallId=g.call, name=g.tool, args=g.input)}, g.says)
    result = _record("out", {"type": "context.append_loop_event", "event": _struct(type="tool.result", toolCallId=g.call, result=_struct(output=g.output))}, g.says)
    usage = _record("use", {"type": "usage.record", "usage": g.usage("inputOther", "inputCacheRead", "output"), "model": g.model}, g.says)
    return _facts(spark, sf_dir, "wire", "kimi", state, config, prompt, said, call, result, usage)


@query(
    "records_cron_runs",
    f"""WITH {ROWS} SELECT conv, turn, 'title' AS kind, 'cron:job-' || conv AS what FROM c WHERE role <> 'system'
    UNION ALL SELECT conv, turn, 'parent', CASE WHEN conv % 4 = 0 THEN parent ELSE '-' END FROM c
    UNION ALL SELECT conv, turn, 'text', 'system:' || said FROM c""",
)
def records_cron_runs(spark, sf_dir):
    """Every message as the run of a scheduled job; system messages know no job."""
    g = _Row()
    run = _record("run", {"jobId": F.when(g.role != "system", F.concat(F.lit("job-"), g.conv)), "sessionId": g.parent, "status": "ok", "runAtMs": F.lit(1_704_067_200_000), "summary": g.text})
    return _facts(spark, sf_dir, "cron_runs", "openclaw", run)


@query(
    "dropped_records",
    """SELECT conv_id AS conv, turn, 'kept' AS outcome FROM conversations WHERE turn % 3 = 0 UNION ALL SELECT conv_id, turn, 'codebuddy_skiprun_command_echo' FROM conversations WHERE turn % 3 > 0""",
)
def dropped_records(spark, sf_dir):
    """Echoes of skipped runs, told by a flag or by their type, leave an audit and no fragment."""
    g = _Row()
    echo = _record("said", {
        "role": "user", "content": g.text, "type": F.when(g.turn % 3 == 2, "skip_run"), "providerData": F.when(g.turn % 3 == 1, _struct(skipRun=True)),
    })
    rows = bridge.table(spark, sf_dir, "conversations").select("conv_id", "turn", echo.alias("r"))
    raw = rows.select(F.lit("conv").alias("source_id"), F.lit("codebuddy").alias("source_platform"), F.concat(F.lit("b:"), g.conv).alias("blob_id"), F.lit("/logs/a.jsonl").alias("origin_path"),
        F.concat(F.lit("sess:conv:"), g.conv).alias("session_ref"), F.concat_ws(":", g.conv, g.turn, "r.suffix").alias("record_id"), g.turn.alias("ordinal"), F.lit("2024-01-01T00:00:00.000Z").alias("observed_at"), F.col("r.raw_json").alias("raw_json"))
    fragments, audits = fragments_of(complete(raw, RECORD), "generic")
    outcome = fragments.select("record_id", F.lit("kept").alias("outcome")).unionByName(audits.select(F.col("scope_ref").alias("record_id"), F.col("diagnostic_code").alias("outcome")))
    at = F.split("record_id", ":")
    return outcome.select(F.get(at, F.lit(0)).cast("bigint").alias("conv"), F.get(at, F.lit(1)).cast("bigint").alias("turn"), "outcome")


@query(
    "recorded_steps",
    f"""WITH {ROWS} SELECT conv, turn, 'text' AS kind, CASE role WHEN 'user' THEN 'user:' WHEN 'system' THEN 'system:' ELSE 'assistant:' END || said AS what FROM c WHERE role <> 'assistant' OR turn % 4 <> 3
    UNION ALL SELECT conv, turn, 'tool_call', 'step-' || conv || ':run_command:{{"id":"step-' || conv || '","type":"CORTEX_STEP_TYPE_RUN_COMMAND"}}' FROM c WHERE role = 'assistant' AND turn % 4 = 3""",
)
def recorded_steps(spark, sf_dir):
    """Conversations as the steps of a recorded trajectory: prompts, plans, notices, errors, and steps that are calls."""
    g = _Row()
    called = g.says & (g.turn % 4 == 3)
    kind = F.when(g.is_user, "USER_INPUT").when(g.role == "system", "ERROR_MESSAGE").when(called, "CORTEX_STEP_TYPE_RUN_COMMAND").when(g.turn % 4 == 1, "CORTEX_STEP_TYPE_PLANNER_RESPONSE").otherwise("NOTIFY_USER")
    step = _struct(
        id=F.when(called, F.concat(F.lit("step-"), g.conv)), type=kind, userInput=F.when(g.is_user, _struct(items=F.array(_struct(text=g.text)))), errorMessage=F.when(g.role == "system", _struct(message=g.text)),
        plannerResponse=F.when(g.says & (g.turn % 4 == 1), _struct(response=g.text)), notifyUser=F.when(g.says & (g.turn % 2 == 0), _struct(message=g.text)),
    )
    rows = bridge.table(spark, sf_dir, "conversations")
    steps = rows.select(F.concat(F.lit("sess:conv:"), g.conv).alias("session_ref"), g.turn.alias("position"), F.parse_json(F.to_json(step)).alias("v"))
    made = files.records_from_steps(steps)
    conv = F.substring("session_ref", 11, 20)
    raw = made.select(F.lit("conv").alias("source_id"), F.lit("antigravity").alias("source_platform"), F.concat(F.lit("b:"), conv).alias("blob_id"), F.lit("/logs/a.jsonl").alias("origin_path"), "session_ref",
        F.concat_ws(":", conv, "position").alias("record_id"), F.col("position").alias("ordinal"), F.coalesce("observed_at", F.lit("2024-01-01T00:00:00.000Z")).alias("observed_at"), "raw_json")
    return told(fragments_of(complete(raw, RECORD), "generic")[0])


@query(
    "content_flattening",
    """WITH c AS (SELECT conv_id AS conv, turn, (conv_id + turn) % 6 AS shape, 'a' || turn AS a, 'b' || conv_id AS b FROM conversations)
    SELECT conv, turn,
      CASE shape WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN a || chr(10) || b WHEN 3 THEN '{"deep":{"x":"' || a || '"}}' WHEN 4 THEN '' ELSE '{"n":' || turn || '}' END AS output,
      CASE shape WHEN 0 THEN '{"raw":"' || a || '"}' WHEN 1 THEN '{"items":["' || a || '",{"text":"' || b || '"}]}' WHEN 2 THEN '{"items":[{"text":"' || a || '"},{"content":"' || b || '"}]}'
        WHEN 3 THEN '{"deep":{"x":"' || a || '"}}' WHEN 4 THEN '{}' ELSE '{"n":' || turn || '}' END AS input,
      CASE shape WHEN 2 THEN a || chr(10) || b WHEN 0 THEN a END AS said
    FROM c""",
)
def content_flattening(spark, sf_dir):
    """What a tool was given and what it returned, as text, list (of which only objects are said), object, JSON in a text, or
    nothing; and the text of a content entry."""
    from turnwise.sources.formats import core

    rows = bridge.table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    shape, a, b = (conv + turn) % 6, F.concat(F.lit("a"), turn), F.concat(F.lit("b"), conv)
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    given = (
        F.when(shape == 0, q(a)).when(shape == 1, F.concat(F.lit("["), q(a), F.lit(',{"text":'), q(b), F.lit("}]")))
        .when(shape == 2, F.concat(F.lit('[{"text":'), q(a), F.lit('},{"content":'), q(b), F.lit("}]")))
        .when(shape == 3, F.concat(F.lit('{"deep":{"x":'), q(a), F.lit("}}"))).when(shape == 4, "null").otherwise(F.concat(F.lit('"{\\"n\\":'), turn, F.lit('}"')))
    )
    entry = F.when(shape == 0, F.concat(F.lit('{"text":'), q(a), F.lit("}"))).when(shape == 2, F.concat(F.lit('{"content":'), given, F.lit("}"))).otherwise('{"other":1}')
    read = rows.select(conv.alias("conv"), turn.alias("turn"), F.parse_json(given).alias("v"), F.parse_json(entry).alias("e"))
    return read.select("conv", "turn", core.tool_output(F.col("v")).alias("output"), core.tool_input(F.col("v")).alias("input"), core.content_text(F.col("e")).alias("said"))
