import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import atoms as atom_ops
from turnwise.operators import turns as turn_ops
from turnwise.session import materialize
from turnwise.sources.formats import fragments_of


def records(spark, platform, rows, pointer=None, path="/logs/a.jsonl", session="s1"):
    data = [
        ("src", platform, "b", path, f"sess:{platform}:{session}", f"r{i}", i, pointer, f"2024-01-01T00:00:{i:02d}.000Z", r if isinstance(r, str) else json.dumps(r))
        for i, r in enumerate(rows)
    ]
    names = "source_id string, source_platform string, blob_id string, origin_path string, session_ref string, record_id string, ordinal long, pointer string, observed_at string, raw_json string"
    return spark.createDataFrame(data, names).coalesce(1)


def kinds(fragments):
    rows = fragments.orderBy("ordinal", "arrival").collect()
    return [(r.fragment_kind, r.actor_kind, r.text or r.tool_name or r.tool_output or r.model or r.path or r.title) for r in rows]


def test_unparsed_records_are_kept_with_an_audit(spark):
    fragments, audits = fragments_of(records(spark, "generic", ["{broken", "[1]"]), "generic")
    assert [k for k, *_ in kinds(fragments)] == ["unknown", "unknown"]
    assert sorted(r.diagnostic_code for r in audits.collect()) == ["record_json_parse_failed", "record_not_object"]


def test_generic_messages(spark):
    rows = [
        {"cwd": "/w/./a", "role": "human", "content": "hello", "timestamp": "2024-05-01T00:00:00Z"},
        {
            "author": {"role": "bot"},
            "parts": [{"type": "text", "text": "hi"}, {"type": "toolUse", "id": "c1", "name": "grep", "input": {"q": 1}}],
            "usage": {"prompt_tokens": 5, "completion_tokens": 2},
            "finish": 1,
            "stopReason": "stop",
        },
        {"role": "assistant", "tool_results": [{"call_id": "c1", "output": "found"}], "usage": {"input_tokens": 1}},
        {"what": "?"},
    ]
    fragments, audits = fragments_of(records(spark, "gemini", rows), "generic")
    assert kinds(fragments) == [
        ("workspace_signal", None, "/w/a"),
        ("text", "user", "hello"),
        ("text", "assistant", "hi"),
        ("tool_call", None, "grep"),
        ("tool_result", None, "found"),
        ("token_usage_signal", None, None),
        ("unknown", None, None),
    ]
    said = fragments.where("text = 'hi'").first()
    assert (said.usage.input_tokens, said.usage.total_tokens, said.stop_reason) == (5, 7, "end_turn")
    assert [r.diagnostic_code for r in audits.collect()] == ["unhandled_record"]


def test_message_blocks(spark):
    rows = [
        {"type": "user", "sessionId": "s1", "cwd": "/w", "message": {"role": "user", "content": "go"}},
        {
            "type": "assistant",
            "requestId": "q1",
            "message": {
                "id": "m1",
                "role": "assistant",
                "model": "opal",
                "stop_reason": "tool_use",
                "usage": {"input_tokens": 10, "cache_read_input_tokens": 20, "output_tokens": 5},
                "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "ls", "input": {}}],
            },
        },
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}, {"text": "b"}]}]}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "[Request interrupted by user]"}]}},
    ]
    fragments, audits = fragments_of(records(spark, "claude_code", rows), "message_blocks")
    assert kinds(fragments) == [
        ("workspace_signal", None, "/w"),
        ("text", "user", "go"),
        ("model_signal", None, "opal"),
        ("unknown", None, None),
        ("text", "assistant", "ok"),
        ("tool_call", None, "ls"),
        ("token_usage_signal", None, "opal"),
        ("tool_result", None, "a\nb"),
        ("text", "system", "[Request interrupted by user]"),
    ]
    bill = fragments.where("fragment_kind = 'token_usage_signal'").first()
    assert (bill.message_id, bill.request_id, bill.usage.total_tokens) == ("m1", "q1", 35)
    assert [(r.diagnostic_code, r.severity) for r in audits.collect()] == [("interruption_marker_excluded", "info")]


def test_event_log_of_a_delegated_session(spark):
    spawn = {"subagent": {"thread_spawn": {"parent_thread_id": "p", "agent_nickname": "scout"}}}
    rows = [
        {"type": "session_meta", "payload": {"id": "s1", "cwd": "/w", "source": spawn, "subagent_history_start_ordinal": 2}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "inherited"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "call_id": "c", "arguments": "{\"x\":1}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "fine"}},
        {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 10, "cached_input_tokens": 4, "output_tokens": 3}, "total_token_usage": {"input_tokens": 30, "output_tokens": 9}}}},
        {"type": "event_msg", "payload": {"type": "task_started"}},
    ]
    fragments, _ = fragments_of(records(spark, "codex", rows), "event_log")
    found = kinds(fragments)
    assert ("text", "system", "inherited") in found and ("text", "system", "do it") in found and ("text", "assistant", "done") in found
    assert ("tool_call", None, "sh") in found and ("tool_result", None, "fine") in found
    count = fragments.where("fragment_kind = 'token_usage_signal'").first()
    assert (count.usage.input_tokens, count.usage.total_tokens, count.cumulative_usage.input_tokens) == (6, 13, 30)
    relation = fragments.where("fragment_kind = 'session_relation'").first()
    assert json.loads(relation.relation)["parent_uuid"] == "p"


SINGLE = [
        ("factory", "factory_droid", "settings", {"model": "x", "tokenUsage": {"inputTokens": 3}}, [("model_signal", None, "x"), ("token_usage_signal", None, None)]),
        ("factory", "factory_droid", None, {"type": "session_start", "title": "T", "cwd": "/c"}, [("session_meta", None, None), ("title_signal", None, "T"), ("workspace_signal", None, "/c")]),
        ("factory", "factory_droid", None, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "u"}]}}, [("text", "user", "u")]),
        ("factory", "factory_droid", None, {"type": "todo_state", "todos": [{}]}, [("unknown", None, None)]),
        ("thread", "amp", "root", {"title": "T", "env": {"initial": {"trees": [{"uri": "file:///w/x"}]}}}, [("title_signal", None, "T"), ("workspace_signal", None, "/w/x")]),
        ("thread", "amp", None, {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "a"}]}, [("model_signal", None, "m"), ("text", "assistant", "a")]),
        ("multi_agent", "accio", None, {"role": "tool", "content": "out", "toolCallId": "c"}, [("text", "assistant", "out"), ("tool_result", None, "out")]),
        ("multi_agent", "accio", None, {"id": "CID-1", "title": "Session", "sessionModel": "m", "path": "/p"}, [("model_signal", None, "m"), ("workspace_signal", None, "/p")]),
        ("multi_agent", "accio", None, {"role": "assistant", "content": "bad", "metadata": {"is_error": True}}, [("text", "assistant", "bad")]),
        ("chat_history", "grok", None, {"type": "user", "content": "x", "synthetic_reason": "s"}, [("text", "system", "x")]),
        ("chat_history", "grok", None, {"type": "assistant", "content": "x", "model_id": "m", "tool_calls": [{"id": "1", "name": "f", "arguments": "{}"}]}, [("model_signal", None, "m"), ("text", "assistant", "x"), ("tool_call", None, "f")]),
        ("chat_history", "grok", "summary", {"generated_title": "G", "info": {"cwd": "/g"}, "current_model_id": "m"}, [("session_meta", None, None), ("title_signal", None, "G"), ("workspace_signal", None, "/g"), ("model_signal", None, "m")]),
        ("wire", "kimi", None, {"type": "turn.prompt", "input": [{"type": "text", "text": "q"}], "time": 1704067200000}, [("text", "user", "q")]),
        ("wire", "kimi", None, {"type": "turn.steer", "origin": {"kind": "background_task"}, "input": [{"type": "text", "text": "q"}]}, [("text", "user", "q")]),
        ("wire", "kimi", None, {"type": "context.append_loop_event", "event": {"type": "content.part", "part": {"type": "think", "think": "h"}}}, [("text", "assistant", "h")]),
        ("wire", "kimi", None, {"type": "usage.record", "usage": {"inputOther": 1, "inputCacheRead": 2, "output": 3}}, [("token_usage_signal", None, None)]),
        ("wire", "kimi", None, {"type": "llm.request"}, []),
        ("cron_runs", "openclaw", None, {"jobId": "j", "status": "ok", "summary": "ran", "runAtMs": 1704067200000}, [("title_signal", None, "cron:j"), ("session_relation", None, None), ("text", "system", "ran")]),
        ("generic", "codebuddy", None, {"type": "skip_run", "role": "user", "content": "x"}, []),
        ("generic", "cursor_agent", None, {"type": "turn_ended", "role": "user", "content": "x"}, []),
]


@pytest.mark.parametrize("profile", sorted({case[0] for case in SINGLE}))
def test_single_records(spark, profile):
    """All single-record cases of a profile in one run, one record each."""
    cases = [case for case in SINGLE if case[0] == profile]
    parts = [records(spark, case[1], [case[3]], case[2], session=f"c{i}").withColumn("ordinal", F.lit(i)) for i, case in enumerate(cases)]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    fragments, _ = fragments_of(everything.coalesce(1), profile)
    found = [[] for _ in cases]
    for r in fragments.orderBy("ordinal", "arrival").collect():
        found[r.ordinal].append((r.fragment_kind, r.actor_kind, r.text or r.tool_name or r.tool_output or r.model or r.path or r.title))
    assert found == [case[4] for case in cases]


def test_records_to_turns(spark):
    rows = [
        {"role": "user", "content": "one"},
        {"role": "assistant", "content": "first"},
        {"role": "user", "content": "<environment_context>x</environment_context>\ntwo"},
        {"role": "assistant", "content": [{"type": "text", "text": "second"}]},
    ]
    fragments, _ = fragments_of(records(spark, "lobechat", rows), "generic")
    atoms = materialize(atom_ops.atomize(materialize(fragments, "fragments")), "atoms")
    tagged = materialize(turn_ops.tag_groups(atoms), "tagged")
    turns = turn_ops.turns_with_context(tagged).orderBy("group_index").collect()
    assert [(t.canonical_text, t.assistant_reply_count) for t in turns] == [("one", 1), ("two", 1)]


# Own numbers and members of one, two and three levels; the fourth level is not read.
NESTED = {"usage": {"input_tokens": 1}, "metadata": {"token_usage": {"output_tokens": 20, "tokens": {"input_tokens": 300, "usage": {"input_tokens": 9000}}}}}


@pytest.mark.parametrize(
    "profile, platform, record, total",
    [
        ("chat_history", "grok", {"type": "assistant", "content": "ok", **NESTED}, 321),
        ("message_blocks", "claude_code", {"type": "assistant", "message": {"role": "assistant", "content": "ok", **NESTED}}, 321),
        ("factory", "factory_droid", {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}], **NESTED}}, 321),
        ("generic", "generic", {"role": "assistant", "content": "ok", "usage": NESTED}, 321),
        ("event_log", "codex", {"type": "event_msg", "payload": {"type": "token_count", "info": NESTED}}, 321),
    ],
)
def test_nested_usage_of_records(spark, profile, platform, record, total):
    fragments, _ = fragments_of(records(spark, platform, [record]), profile)
    assert [r.usage.total_tokens for r in fragments.where("usage IS NOT NULL").collect()] == [total]


def test_cumulative_usage_in_nested_members(spark):
    record = {"type": "event_msg", "payload": {"type": "token_count", "info": {"usage": {"input_tokens": 5}, "totalUsage": {"input_tokens": 7, "total_usage": {"input_tokens": 40}}}}}
    row = fragments_of(records(spark, "codex", [record]), "event_log")[0].where("usage IS NOT NULL").first()
    assert (row.usage.input_tokens, row.cumulative_usage.input_tokens) == (5, 47)
