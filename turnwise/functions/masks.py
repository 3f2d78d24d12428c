"""Masking of injected scaffolding and secrets.

A mask table holds one row per rule. Matching is order-dependent (a lower-priority match that overlaps an accepted one
is dropped whole), which no chain of ``regexp_replace`` expresses; an Arrow UDF does it, and only on rows whose text
passes a JVM-side guard.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import tidy_lines


@dataclass(frozen=True)
class MaskTemplate:
    template_id: str
    match_type: str  # regex | prefix | contains
    pattern: str
    label: str
    priority: int
    applies_to: tuple[str, ...]
    active: bool = True


_PROMPT = ("user_message", "system_message")
_ALL = ("user_message", "system_message", "assistant_reply", "tool_input", "tool_output")

# The built-in mask rules (id, kind, pattern, label, priority, contexts).
BUILTIN_TEMPLATES = (
    MaskTemplate("mask-agents-md-instructions", "regex", r"# AGENTS\.md instructions[^\n]*\n\n<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>", "Agent Instructions", 0, _PROMPT),
    MaskTemplate("mask-standalone-instructions-block", "regex", r"<INSTRUCTIONS>[\s\S]*?</INSTRUCTIONS>", "Instructions", 1, _PROMPT),
    MaskTemplate("mask-environment-context-block", "regex", r"<environment_context>[\s\S]*?</environment_context>", "Environment Context", 2, _PROMPT),
    MaskTemplate("mask-system-reminder-block", "regex", r"<system-reminder>[\s\S]*?</system-reminder>", "System Reminder", 3, _PROMPT),
    MaskTemplate("mask-codex-skills-catalog", "regex", r"## Skills\nA skill is a set of local instructions[\s\S]*?</INSTRUCTIONS>", "Skills Instructions", 4, _PROMPT),
    MaskTemplate("mask-skills-instructions-block", "regex", r"<skills_instructions>[\s\S]*?</skills_instructions>", "Skills Instructions", 5, _PROMPT),
    MaskTemplate("mask-permissions-instructions-block", "regex", r"<permissions instructions>[\s\S]*?</permissions instructions>", "Permissions Instructions", 6, _PROMPT),
    MaskTemplate("mask-collaboration-mode-block", "regex", r"<collaboration_mode>[\s\S]*?</collaboration_mode>", "Collaboration Mode", 7, _PROMPT),
    MaskTemplate("mask-system-prompt-prefix", "prefix", "You are", "System Prompt", 8, ("system_message", "assistant_reply")),
    MaskTemplate("mask-openai-key", "regex", r"sk-[A-Za-z0-9]{20,}", "API Key", 9, _ALL),
    MaskTemplate("mask-private-key", "regex", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "Private Key", 10, _ALL),
    MaskTemplate("mask-bearer-token", "regex", r"Bearer\s+[A-Za-z0-9._\-]{16,}", "Bearer Token", 11, _ALL),
)
PROMPT_BLOCK_IDS = tuple(t.template_id for t in BUILTIN_TEMPLATES[:8])
# A masked prefix ends before the first of these, else with the text.
PREFIX_ENDS = ("\n\n====", "\n\n---", "\n\nUser:", "\n\nHuman:", "\n\n# ")

SPAN_TYPE = "array<struct<start:int,end:int,template_id:string,label:string>>"
SEGMENT_TYPE = "array<struct<type:string,content:string,mask_label:string,mask_char_count:int,mask_template_id:string,original_content:string>>"


def select_templates(context: str, templates=BUILTIN_TEMPLATES, exclude=()) -> list[MaskTemplate]:
    chosen = [t for t in templates if t.active and context in t.applies_to and t.template_id not in exclude]
    return sorted(chosen, key=lambda t: t.priority)


def _prefix_end(text: str) -> int:
    for mark in PREFIX_ENDS:
        at = text.find(mark)
        if at >= 0:
            return at
    return len(text)


def _accepted_spans(text: str, rules: list[tuple[MaskTemplate, re.Pattern | None]]) -> list[tuple]:
    taken: list[tuple] = []
    for rule, compiled in rules:
        if rule.match_type == "prefix":
            found = [(0, _prefix_end(text))] if text.startswith(rule.pattern) else []
        else:
            found = [m.span() for m in compiled.finditer(text)]
        for start, end in found:
            if not any(start < other[1] and other[0] < end for other in taken):
                taken.append((start, end, rule.template_id, rule.label))
    return sorted(taken, key=lambda span: span[0])


def _compiled(templates: list[MaskTemplate]) -> list[tuple[MaskTemplate, re.Pattern | None]]:
    source = {"regex": lambda t: re.compile(t.pattern), "contains": lambda t: re.compile(re.escape(t.pattern))}
    return [(t, source[t.match_type](t) if t.match_type in source else None) for t in templates]


def may_match(text: Column, templates: list[MaskTemplate]) -> Column:
    """JVM-side test whether any rule can match; only such rows do work in Python.

    Blanks mean the same on both sides: Unicode blanks, and the four separators that only Python counts as blanks.
    """
    guard = F.lit(False)
    plain = F.translate(text, "\x1c\x1d\x1e\x1f", "    ")
    for t in templates:
        if t.match_type == "prefix":
            guard = guard | text.startswith(t.pattern)
        elif t.match_type == "contains":
            guard = guard | text.contains(t.pattern)
        else:
            guard = guard | plain.rlike("(?U)" + t.pattern)
    return guard


def mask_spans(text: Column, templates: list[MaskTemplate]) -> Column:
    """Accepted mask spans of a text, in order (code-point offsets, end exclusive)."""
    rules = _compiled(templates)

    @F.pandas_udf(SPAN_TYPE)
    def spans(batch: pd.Series) -> pd.Series:
        names = ("start", "end", "template_id", "label")
        return batch.map(lambda value: None if value is None else [dict(zip(names, span)) for span in _accepted_spans(value, rules)])

    guard = may_match(text, templates)
    return F.when(guard, spans(F.when(guard, text))).otherwise(F.array().cast(SPAN_TYPE))


def masked_text(text: Column, context: str, templates=BUILTIN_TEMPLATES) -> Column:
    """Canonical text of a single non-injected text in one context."""
    chosen = select_templates(context, templates)
    rules = _compiled(chosen)

    def without_masks(value: str) -> str:
        kept, at = [], 0
        for start, end, _, _ in _accepted_spans(value, rules):
            kept.append(value[at:start])
            at = end
        return "".join(kept) + value[at:]

    @F.pandas_udf("string")
    def remaining(batch: pd.Series) -> pd.Series:
        return batch.map(lambda value: None if value is None else without_masks(value))

    guard = may_match(text, chosen)
    return tidy_lines(F.when(guard, remaining(F.when(guard, text))).otherwise(text))


def display_segments(text: Column, spans: Column, injected: Column) -> Column:
    """Text cut at its spans: plain (or injected) pieces and masked pieces, in order."""
    kind = F.when(injected, "injected").otherwise("text")
    none = F.lit(None).cast("string")

    def plain(start: Column, end: Column) -> Column:
        return F.struct(
            kind.alias("type"),
            F.substring(text, start + 1, end - start).alias("content"),
            none.alias("mask_label"),
            F.lit(None).cast("int").alias("mask_char_count"),
            none.alias("mask_template_id"),
            none.alias("original_content"),
        )

    def masked(span: Column) -> Column:
        size = span.getField("end") - span.getField("start")
        return F.struct(
            F.lit("masked").alias("type"),
            F.concat(F.lit("[MASKED: "), span.getField("label"), F.lit("]")).alias("content"),
            span.getField("label").alias("mask_label"),
            size.alias("mask_char_count"),
            span.getField("template_id").alias("mask_template_id"),
            F.substring(text, span.getField("start") + 1, size).alias("original_content"),
        )

    def piece(span: Column, index: Column) -> Column:
        before = F.when(index == 0, F.lit(0)).otherwise(F.get(spans, index - 1).getField("end"))
        start = span.getField("start")
        return F.when(start > before, F.array(plain(before, start), masked(span))).otherwise(F.array(masked(span)))

    last_end = F.coalesce(F.get(spans, F.size(spans) - 1).getField("end"), F.lit(0))
    tail = F.when(last_end < F.length(text), F.array(plain(last_end, F.length(text)))).otherwise(F.array().cast(SEGMENT_TYPE))
    cut = F.concat(F.flatten(F.transform(spans, piece)).cast(SEGMENT_TYPE), tail.cast(SEGMENT_TYPE))
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(plain(F.lit(0), F.length(text))).cast(SEGMENT_TYPE))


def canonical_text(segments: Column) -> Column:
    """What is left for readers and search: no masked and no injected pieces, lines tidied."""
    kept = F.filter(segments, lambda s: ~s.getField("type").isin("masked", "injected"))
    return tidy_lines(F.array_join(F.transform(kept, lambda s: s.getField("content")), ""))


def fallback_text(segments: Column) -> Column:
    """Canonical text of a fully masked message: labels stand for masked pieces."""
    shown = F.filter(segments, lambda s: s.getField("type") != "injected")
    words = F.transform(
        shown,
        lambda s: F.when(
            s.getField("type") == "masked", F.concat(F.lit("["), F.coalesce(s.getField("mask_label"), F.lit("Masked")), F.lit("]"))
        ).otherwise(s.getField("content")),
    )
    return tidy_lines(F.array_join(words, ""))


def join_segments(messages: Column) -> Column:
    """Segments of several messages in order, a blank-line text segment between messages."""
    none = F.lit(None).cast("string")
    gap = F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.lit("\n\n").alias("content"),
            none.alias("mask_label"),
            F.lit(None).cast("int").alias("mask_char_count"),
            none.alias("mask_template_id"),
            none.alias("original_content"),
        )
    ).cast(SEGMENT_TYPE)
    return F.flatten(F.transform(messages, lambda m, i: F.when(i == 0, m).otherwise(F.concat(gap, m))))
