"""Splitting of user-role text into authored and injected chunks.

Most user text carries no marker at all and stays in the JVM as one authored chunk; only marked text goes through the
Arrow UDF, whose peeling of nested envelopes is inherently sequential.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.roles import AUTOMATION_PREFIX, CONTINUATION_PREFIX, DELEGATION_PREFIXES, SYNTHETIC_PREFIXES
from turnwise.functions.text import strip

CHUNK_TYPE = "array<struct<origin_kind:string,text:string,display_policy:string>>"

# Envelopes peeled off the front of a prompt, as (whole envelope, opening words).
LEADING_ENVELOPES = (
    (r"# AGENTS\.md instructions[^\n]*\n\n<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>\s*", "# AGENTS.md instructions"),
    (r"<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>\s*", "<INSTRUCTIONS>"),
    (r"<environment_context>[\s\S]*?</environment_context>\s*", "<environment_context>"),
    (r"<system-reminder>[\s\S]*?</system-reminder>\s*", "<system-reminder>"),
    (r"## Skills\nA skill is a set of local instructions[\s\S]*?</INSTRUCTIONS>\s*", "## Skills\nA skill is a set of local instructions"),
    (r"<skills_instructions>[\s\S]*?</skills_instructions>\s*", "<skills_instructions>"),
    (r"<permissions instructions>[\s\S]*?</permissions instructions>\s*", "<permissions instructions>"),
    (r"<collaboration_mode>[\s\S]*?</collaboration_mode>\s*", "<collaboration_mode>"),
)
# Tags wrapped around prompts by one editor family.
PROMPT_TAGS = (
    "timestamp",
    "manually_attached_skills",
    "user_query",
    "user_info",
    "agent_transcripts",
    "attached_files",
    "open_and_recently_viewed_files",
    "cursor_rules_context",
    "always_applied_workspace_rules",
    "system_reminder",
    "system-reminder",
)
PROMPT_TAG_PLATFORMS = ("cursor", "cursor_agent")
REQUEST_MARKER = "[User Request]"
RULES_PREFIX = "[Assistant Rules"
COMMAND_PREFIXES = ("<command-name>", "<command-message>", "<command-args>")

_ENVELOPES = [re.compile(pattern) for pattern, _ in LEADING_ENVELOPES]
_TAG = re.compile("<(" + "|".join(re.escape(tag) for tag in PROMPT_TAGS) + r")>([\s\S]*?)</\1>")
_COMMAND = re.compile(r"<command-(name|message|args)>([\s\S]*?)</command-\1>")
_UNKNOWN_TAG = re.compile(r"<[\w:-]+[\s>]")


def _injected(text: str) -> dict:
    return {"origin_kind": "injected_user_shaped", "text": text, "display_policy": "collapse"}


def _authored(text: str) -> dict:
    return {"origin_kind": "user_authored", "text": text, "display_policy": None}


def command_chunks(text: str) -> list[dict] | None:
    """Chunks of a text made of command tags only, else None."""
    if not text.startswith(COMMAND_PREFIXES) or _COMMAND.sub("", text).strip():
        return None
    fields: dict[str, str] = {}
    for name, body in _COMMAND.findall(text):
        fields.setdefault(name, body.strip())
    name, message, args = (fields.get(key) or "" for key in ("name", "message", "args"))
    bare = name.lstrip("/").strip()
    command = (bare or message.lstrip("/").strip()).lower()
    said = args or message or bare
    if (command == "clear" and not args) or not said:
        return [_injected(text)]
    return [_injected(text), _authored(said)]


def prompt_tag_chunks(text: str) -> list[dict] | None:
    """Tagged blocks become injected chunks; the query body and untagged rest become one authored chunk at the end."""
    tags = list(_TAG.finditer(text))
    if not tags:
        return None
    chunks: list[dict] = []
    said: list[str] = []

    def outside(piece: str) -> None:
        piece = piece.strip()
        if piece and _UNKNOWN_TAG.match(piece):
            chunks.append(_injected(piece))
        elif piece:
            said.append(piece)

    at = 0
    for tag in tags:
        outside(text[at : tag.start()])
        chunks.append(_injected(tag.group(0)))
        if tag.group(1) == "user_query" and tag.group(2).strip():
            said.append(tag.group(2).strip())
        at = tag.end()
    outside(text[at:])
    return chunks + ([_authored("\n\n".join(said))] if said else [])


def _peel(text: str) -> tuple[list[dict], str]:
    peeled: list[dict] = []
    rest = text
    while hit := next((m for m in (envelope.match(rest) for envelope in _ENVELOPES) if m), None):
        peeled.append(_injected(hit.group(0).strip()))
        rest = rest[hit.end() :].strip()
    return peeled, rest


def chunks_of(text: str, tagged_prompts: bool) -> list[dict]:
    """Chunks of trimmed text that is neither delegated nor an automation trigger."""
    commands = command_chunks(text)
    if commands is not None:
        return commands
    tagged = prompt_tag_chunks(text) if tagged_prompts else None
    if tagged is not None:
        return tagged
    before, marker, after = text.partition(REQUEST_MARKER)
    if marker:
        return ([_injected(before.strip())] if before.strip() else []) + ([_authored(after.strip())] if after.strip() else [])
    peeled, rest = _peel(text)
    if peeled:
        return peeled + ([_authored(rest)] if rest else [])
    openings = (RULES_PREFIX, CONTINUATION_PREFIX, *SYNTHETIC_PREFIXES, *(opening for _, opening in LEADING_ENVELOPES))
    return [_injected(text)] if text.startswith(openings) else [_authored(text)]


def _split_marked(texts: pd.Series, tagged_prompts: pd.Series) -> pd.Series:
    return pd.Series([None if text is None else chunks_of(text, bool(tagged)) for text, tagged in zip(texts, tagged_prompts)])


def split_user_text(text: Column, platform: Column, file_path: Column) -> Column:
    """Array of (origin_kind, text, display_policy) chunks of one user-role text."""
    whole = strip(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    tagged_prompts = F.coalesce(platform.isin(*PROMPT_TAG_PLATFORMS), F.lit(False))
    delegated = F.coalesce((platform == "claude_code") & file_path.rlike(r"(^|[\\/])subagents([\\/]|$)"), F.lit(False))
    for prefix in DELEGATION_PREFIXES:
        delegated = delegated | whole.startswith(prefix)

    marked = whole.contains(REQUEST_MARKER) | (tagged_prompts & whole.contains("<"))
    for opening in (*COMMAND_PREFIXES, RULES_PREFIX, CONTINUATION_PREFIX, *SYNTHETIC_PREFIXES, *(o for _, o in LEADING_ENVELOPES)):
        marked = marked | whole.startswith(opening)

    def single(kind: str) -> Column:
        return F.array(
            F.struct(F.lit(kind).alias("origin_kind"), whole.alias("text"), F.lit(None).cast("string").alias("display_policy"))
        )

    needs_udf = marked & ~delegated & ~whole.startswith(AUTOMATION_PREFIX) & (platform != "antigravity")
    return (
        F.when(F.coalesce(whole, F.lit("")) == "", F.array().cast(CHUNK_TYPE))
        .when(platform == "antigravity", single("user_authored"))
        .when(delegated, single("delegated_instruction"))
        .when(whole.startswith(AUTOMATION_PREFIX), single("automation_trigger"))
        .when(needs_udf, F.pandas_udf(_split_marked, CHUNK_TYPE)(F.when(needs_udf, whole), tagged_prompts))
        .otherwise(single("user_authored"))
    )
