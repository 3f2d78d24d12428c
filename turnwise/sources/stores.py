"""Exported stores as the records that sessions are read from: headers first, then messages in order."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, timekeys
from turnwise.functions.ordered import with_position
from turnwise.functions.paths import path_identity
from turnwise.functions.text import session_title, strip
from turnwise.sources.files import from_kv_store, from_prompt_history

STORE_RECORD = ["session_ref", "position", "pointer", "observed_at", "raw_json"]


def _json(**members: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(n) for n, v in members.items()]))


# --- composers -----------------------------------------------------------------------------------------------------------

# Where a composer and a bubble may name their model, their title and their directory.
COMPOSER_MODEL = ("modelConfig.modelName", "model", "modelName", "latestModel")
BUBBLE_MODEL = ("modelInfo.modelName", "modelName", "model")
COMPOSER_TITLE = ("name", "title", "subtitle")
COMPOSER_PLACE = ("workspacePath", "cwd", "workingDirectory", "context.workspacePath")


def composer_records(kv: DataFrame, platform: str = "cursor") -> DataFrame:
    """Records of the composers of key-value stores: ``kv`` gives (store, storage_key, storage_value).

    A composer that is in several stores is read from the one that has most bubbles of it, the first store on ties. Its
    header names title, model (else that of its first bubble that knows one) and directory; a composer without bubbles
    has no records.
    """
    found = from_kv_store(kv)
    key = ["store", "composer_id"]
    richest = found.groupBy(*key).agg(F.count("*").alias("n")).groupBy("composer_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "store")).alias("best"))
    chosen = richest.select("composer_id", F.col("best.store").alias("store"))
    bubble = F.try_parse_json("raw_json")
    at = F.coalesce(timekeys.coerce(jsonv.string(bubble, "createdAt")), timekeys.from_millis(jsonv.number(bubble, "createdAt")))
    said = found.join(chosen, key).select(*key, "position", "raw_json", at.alias("observed_at"), jsonv.string(bubble, *BUBBLE_MODEL).alias("model"))
    heads = kv.where(F.col("storage_key").startswith("composerData:")).select(
        "store", F.col("storage_key").substr(F.lit(14), F.length("storage_key")).alias("composer_id"), F.try_parse_json("storage_value").alias("v")
    )
    v = F.col("v")
    facts = heads.select(*key, jsonv.string(v, *COMPOSER_TITLE).alias("title"), jsonv.string(v, *COMPOSER_MODEL).alias("named"), path_identity(jsonv.string(v, *COMPOSER_PLACE)).alias("cwd"))
    bubbles = said.groupBy(*key).agg(F.min_by("model", F.when(F.col("model").isNotNull(), F.col("position"))).alias("used"), F.min("observed_at").alias("observed_at"))
    ref = F.concat(F.lit(f"sess:{platform}:"), "composer_id")
    told = facts.join(bubbles, key).withColumn("model", F.coalesce("named", "used"))
    meta = told.where(F.coalesce("title", "model", "cwd").isNotNull()).select(
        ref.alias("session_ref"), F.lit(-1).cast("bigint").alias("position"), F.lit("meta").alias("pointer"), "observed_at", _json(id=ref, title=F.col("title"), model=F.col("model"), cwd=F.col("cwd")).alias("raw_json")
    )
    # Bubbles come in order of their times; those without one come first, as they are listed.
    timed = with_position(said.select(*key, "raw_json", "observed_at", F.col("position").alias("listed")), key, ["observed_at", "listed"], "position")
    rows = timed.select(ref.alias("session_ref"), F.col("position").cast("bigint").alias("position"), F.concat(F.lit("bubble["), "position", F.lit("]")).alias("pointer"), "observed_at", "raw_json")
    return meta.unionByName(rows)


# --- prompt history ------------------------------------------------------------------------------------------------------


def prompt_history_records(kv: DataFrame, base: str, platform: str = "cursor") -> DataFrame:
    """Records of workspaces' prompt lists: a header and one user message per prompt, in order of time.

    ``kv`` gives (workspace, storage_key, storage_value), the workspace as a path. A session's title is the name of the
    first composer that the workspace names, else its first prompt; its id is a digest of the workspace.
    """
    prompts = from_prompt_history(kv, base)
    place = path_identity(F.col("workspace"))
    ref = F.concat(F.lit(f"sess:{platform}:prompt-history:"), F.sha1(F.coalesce(place, F.col("workspace"))))
    placed = with_position(prompts, ["workspace"], ["observed_at", "ordinal"], "position")
    rows = placed.select(
        ref.alias("session_ref"), F.col("position").cast("bigint").alias("position"), F.concat(F.lit("prompt["), "position", F.lit("]")).alias("pointer"), "observed_at",
        _json(id=F.col("id"), role=F.lit("user"), content=F.col("text"), cwd=place).alias("raw_json"),
    )
    named = kv.where(F.col("storage_key") == "composer.composerData").select("workspace", F.try_parse_json("storage_value").alias("v"))
    names = F.filter(F.transform(jsonv.array(F.col("v"), "allComposers"), lambda c: strip(jsonv.string(c, "name"))), lambda n: n != "")
    titles = named.groupBy("workspace").agg(F.max(F.get(names, F.lit(0))).alias("composer"))
    first = prompts.groupBy("workspace").agg(F.min_by(F.struct("text", "observed_at"), F.struct("observed_at", "ordinal")).alias("f"))
    head = first.join(titles, "workspace", "left").select(
        ref.alias("session_ref"), F.lit(-1).cast("bigint").alias("position"), F.lit("meta").alias("pointer"), F.col("f.observed_at").alias("observed_at"),
        _json(id=ref, title=F.coalesce("composer", session_title(F.col("f.text"))), cwd=place).alias("raw_json"),
    )
    return head.unionByName(rows)


# --- message envelopes ---------------------------------------------------------------------------------------------------


def _usage(value: Column) -> Column:
    """Token counts of an envelope or a finished step as the usage members that records are read by."""
    numbers = {
        "input_tokens": ("input", "input_tokens"), "output_tokens": ("output", "output_tokens"), "reasoning_output_tokens": ("reasoning", "reasoning_output_tokens"),
        "cache_read_input_tokens": ("cache.read", "cache_read_input_tokens"), "cache_creation_input_tokens": ("cache.write", "cache_creation_input_tokens"), "total_tokens": ("total", "total_tokens"),
    }
    read = {n: jsonv.number(value, *names).cast("bigint") for n, names in numbers.items()}
    total = read.pop("total_tokens")
    zero = F.lit(0).cast("bigint")
    every = reduce(add, [F.coalesce(c, zero) for c in read.values()])
    return F.when(F.coalesce(total, *read.values()).isNotNull(), _json(**read, total_tokens=F.coalesce(total, every)))


def drawn_parts(parts: DataFrame) -> DataFrame:
    """(message_id, items, usage, reason) of (message_id, name, doc): what the parts of a message say, in order of name.

    Texts and reasoning are text items; a tool part is a call, and a result if its state holds one; the last finished
    step gives the usage and the stop reason.
    """
    v = F.col("v")
    kind, text, call = jsonv.string(v, "type"), jsonv.string(v, "text"), jsonv.string(v, "callID", "callId")
    output = F.coalesce(*[jsonv.member(v, f"state.{m}") for m in ("output", "result", "metadata")])
    given = F.coalesce(F.to_json(jsonv.member(v, "state.input")), F.lit("{}"))
    called = F.to_json(F.struct(F.lit("tool_call").alias("type"), call.alias("id"), jsonv.string(v, "tool", "name").alias("name"), F.try_parse_json(given).alias("input")))
    returned = F.when(output.isNotNull(), F.to_json(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), output.alias("content"))))
    spoken = F.when(strip(text) != "", F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    items = F.array_compact(F.when(kind.isin("text", "reasoning"), F.array(spoken)).when(kind == "tool", F.array(called, returned)).otherwise(F.array().cast("array<string>")))
    finished = kind == "step-finish"
    read = parts.select("message_id", "name", F.try_parse_json("doc").alias("v")).where(jsonv.is_object(v))
    told = read.select("message_id", "name", items.alias("items"), F.when(finished, _usage(jsonv.member(v, "tokens"))).alias("usage"), F.when(finished, jsonv.string(v, "reason")).alias("reason"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("name")))
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("name", "items"))), lambda p: p["items"]))
    return told.groupBy("message_id").agg(ordered.alias("items"), last("usage").alias("usage"), last("reason").alias("reason"))


def envelope_records(sessions: DataFrame, messages: DataFrame, parts: DataFrame, platform: str = "opencode") -> DataFrame:
    """Records of sessions, messages and parts that are documents of their own.

    Inputs give (id, doc) for sessions, (id, session_id, doc) for messages and (message_id, name, doc) for parts. Every
    message becomes one record that holds its text, calls, results, stop reason and usage; what the envelope says itself
    counts before what its parts say. A session that names a title, a model, a directory or a parent has a header.
    """
    v = F.col("v")
    # A document that is no object says nothing of its own, but the message it stands for has its parts.
    said = messages.select(F.col("id").alias("mid"), "session_id", F.coalesce(F.try_parse_json("doc"), F.parse_json(F.lit("{}"))).alias("v"))
    drawn = drawn_parts(parts)
    joined = said.join(drawn, said["mid"] == drawn["message_id"], "left")
    at = F.coalesce(*[timekeys.coerce(jsonv.string(v, n)) for n in ("timestamp", "info.timestamp", "createdAt", "info.createdAt")], timekeys.from_millis(jsonv.number(v, "time.created")))
    inline = F.transform(F.filter(jsonv.array(v, "parts"), jsonv.is_object), lambda p: F.to_json(p))
    pieces = F.transform(F.concat(inline, F.coalesce("items", F.array().cast("array<string>"))), lambda j: F.parse_json(j))
    usage = F.coalesce(_usage(jsonv.member(v, "tokens")), _usage(jsonv.member(v, "usage")), F.col("usage"))
    body = F.struct(
        F.coalesce(jsonv.string(v, "id", "info.id"), F.col("mid")).alias("id"), F.coalesce(jsonv.string(v, "sessionID", "sessionId"), F.col("session_id")).alias("sessionId"),
        jsonv.string(v, "parentID", "parentId", "info.parentID", "info.parentId").alias("parentId"), jsonv.string(v, "agentId", "agent", "info.agentId", "info.agent").alias("agentId"),
        jsonv.string(v, "role", "info.role").alias("role"), jsonv.string(v, "modelID", "model", "info.model").alias("model"), path_identity(jsonv.string(v, "path.cwd")).alias("cwd"),
        at.alias("timestamp"), F.coalesce(jsonv.string(v, "finish", "stopReason", "info.stopReason"), F.col("reason")).alias("stopReason"), F.try_parse_json(usage).alias("usage"), pieces.alias("parts"),
    )
    rows = joined.select("session_id", "mid", at.alias("observed_at"), F.to_json(body).alias("raw_json"))
    placed = with_position(rows, ["session_id"], ["mid"], "position")
    ref = F.concat(F.lit(f"sess:{platform}:"), "session_id")
    records = placed.select(ref.alias("session_ref"), F.col("position").cast("bigint").alias("position"), F.concat(F.lit("messages["), "position", F.lit("]")).alias("pointer"), "observed_at", "raw_json")
    heads = sessions.select(F.col("id").alias("session_id"), F.try_parse_json("doc").alias("v"))
    made = F.coalesce(*[timekeys.coerce(jsonv.string(v, n)) for n in ("createdAt", "created_at")], *[timekeys.from_millis(jsonv.number(v, n)) for n in ("createdAt", "created", "time.created")])
    facts = heads.select("session_id", made.alias("observed_at"), jsonv.string(v, "title", "name").alias("title"), jsonv.string(v, "model").alias("model"), path_identity(jsonv.string(v, "directory", "cwd")).alias("cwd"), jsonv.string(v, "parentID", "parentId").alias("parent"))
    meta = facts.where(F.coalesce("title", "model", "cwd", "parent").isNotNull()).select(
        ref.alias("session_ref"), F.lit(-1).cast("bigint").alias("position"), F.lit("meta").alias("pointer"), "observed_at",
        _json(id=ref, title=F.col("title"), model=F.col("model"), cwd=F.col("cwd"), parentUuid=F.col("parent")).alias("raw_json"),
    )
    return meta.unionByName(records)
