"""Small vocabulary mappings: roles, stop reasons, origins, display policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import strip

# Spellings of a stop reason, after lower-casing and joining words with "_".
STOP_REASONS = {
    "end_turn": ("end_turn", "end", "stop", "completed", "complete", "finished"),
    "tool_use": ("tool_use", "tool_call", "tool_calls", "function_call", "function_calls"),
    "max_tokens": ("max_tokens", "length", "token_limit"),
    "error": ("error", "failed", "failure", "abort", "aborted", "cancelled", "canceled", "interrupted"),
}

# Opening words of user-shaped text that no user typed.
SYNTHETIC_PREFIXES = (
    "<user_action>",
    "<task-notification>",
    "<turn_aborted>",
    "<local-command-caveat>",
    "<local-command-stdout>",
    "<bash-input>",
    "<bash-stdout>",
    "The following is the Codex agent history added since",
    "The following is the Codex agent history whose request action you are assessing",
)
CONTINUATION_PREFIX = "This session is being continued from a previous conversation"
DELEGATION_PREFIXES = ("[Subagent Context]", "You are running as a subagent")
AUTOMATION_PREFIX = "[cron:"
INTERRUPTION_MARKERS = (
    "[Request interrupted by user]",
    "I'll stop here for now.",
    "I'll stop here to avoid making too many changes at once.",
    "Stopping here to let you review the changes.",
)
COLLAPSE_ABOVE = 180


def any_prefix(text: Column, prefixes) -> Column:
    found = F.lit(False)
    for prefix in prefixes:
        found = found | text.startswith(prefix)
    return found


def map_role(role: Column) -> Column:
    return F.when(role.isin("user", "human"), "user").when(role.isin("developer", "system"), "system").otherwise("assistant")


def normalize_stop_reason(reason: Column) -> Column:
    word = F.regexp_replace(F.lower(strip(reason)), r"[\s-]+", "_")
    mapped = F.lit(None).cast("string")
    for target, spellings in STOP_REASONS.items():
        mapped = F.when(word.isin(*spellings), target).otherwise(mapped)
    return mapped


def is_interruption(text: Column) -> Column:
    return strip(text).isin(*INTERRUPTION_MARKERS)


def classify_origin(platform: Column, file_path: Column, text: Column) -> Column:
    """Origin of trimmed user-role text, envelopes apart."""
    in_subagent_file = (platform == "claude_code") & file_path.rlike(r"(^|/)subagents(/|$)")
    return (
        F.when(F.coalesce(in_subagent_file, F.lit(False)) | any_prefix(text, DELEGATION_PREFIXES), "delegated_instruction")
        .when(text.startswith(AUTOMATION_PREFIX), "automation_trigger")
        .when(any_prefix(text, (*SYNTHETIC_PREFIXES, CONTINUATION_PREFIX)), "injected_user_shaped")
        .otherwise("user_authored")
    )


def display_policy(origin_kind: Column, text: Column) -> Column:
    special = origin_kind.isin("injected_user_shaped", "delegated_instruction", "automation_trigger")
    return F.when(special & (F.length(text) > COLLAPSE_ABOVE), "collapse").otherwise("show")
