"""Questions a tool put to the user, with the answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.ids import stable_id
from turnwise.operators.atoms import SESSION, edges_tool_result

# The asking tool of each platform, and the words that precede wrapped answers.
ASK_TOOLS = {"claude_code": "AskUserQuestion", "codex": "request_user_input"}
WRAPPED = "Your questions have been answered:"

ANSWER_TYPE = "array<struct<question_index:int,question:string,selected_label:string,free_text:string>>"


def _questions(given: str | None) -> list[dict]:
    try:
        listed = json.loads(given or "{}").get("questions")
    except (ValueError, AttributeError):
        return []
    return [q for q in listed if isinstance(q, dict)] if isinstance(listed, list) else []


def _first_text(entry: dict, *names: str) -> str | None:
    return next((entry[n] for n in names if isinstance(entry.get(n), str)), None)


def _label(question: dict | None, said: str | None) -> str | None:
    """Option label equal to what was said, exactly or ignoring case."""
    said = (said or "").strip()
    options = question.get("options") if question else None
    labels = [_first_text(o, "label", "value", "name") for o in options if isinstance(o, dict)] if isinstance(options, list) else []
    labels = [label for label in labels if label]
    if not said:
        return None
    return next((x for x in labels if x == said), next((x for x in labels if x.lower() == said.lower()), None))


def _answer(index: int, question: dict | None, said: str | None, rest: list[str] = ()) -> dict:
    label = _label(question, said)
    free = ", ".join(rest) or None if label else ", ".join([x for x in (said, *rest) if x]) or None
    text = question.get("question") if question else None
    return {"question_index": index, "question": text if isinstance(text, str) else None, "selected_label": label, "free_text": free}


def answers_of(questions: list[dict], output: str | None) -> list[dict]:
    """Answers by id, by position, from wrapped pairs, or the plain text itself."""
    output = output or ""
    at = lambda i: questions[i] if 0 <= i < len(questions) else None
    try:
        parsed = json.loads(output)
    except ValueError:
        parsed = None
    if isinstance(parsed, dict) and isinstance(parsed.get("answers"), dict):
        slots, used, found = parsed["answers"], set(), []
        for index, question in enumerate(questions):
            key = question.get("id") if isinstance(slots.get(question.get("id")), dict) else next((k for k in slots if k not in used), None)
            if key is None:
                continue
            used.add(key)
            listed = slots[key].get("answers") if isinstance(slots[key], dict) else None
            said = [x for x in listed if isinstance(x, str) and x] if isinstance(listed, list) else []
            if said:
                found.append(_answer(index, question, said[0], said[1:]))
        return found
    if isinstance(parsed, (dict, list)):
        entries = [e for e in (parsed if isinstance(parsed, list) else [parsed]) if isinstance(e, dict)]
        names = ("selected_label", "label", "value", "answer", "text", "free_text")
        stated = [e["question_index"] if isinstance(e.get("question_index"), int) else i for i, e in enumerate(entries)]
        return [{**_answer(i, at(i), _first_text(e, *names)), "question_index": stated[i]} for i, e in enumerate(entries)]
    pairs = re.findall(r'"([^"]*)"\s*=\s*"([^"]*)"', output.split(WRAPPED, 1)[1]) if WRAPPED in output else []
    if pairs:
        texts = [q.get("question") for q in questions]
        places = [texts.index(q) if q in texts else i for i, (q, _) in enumerate(pairs)]
        return [_answer(place, at(place), said) for place, (_, said) in zip(places, pairs)]
    if not output:
        return []
    hit = next((i for i, q in enumerate(questions) if _label(q, output)), 0)
    return [_answer(hit, at(hit), output)]


def ask_user_turns(atoms: DataFrame) -> DataFrame:
    """One row per answered question call: the call, its last result, and the answers matched to the questions."""

    def match(inputs: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([answers_of(_questions(given), output) if _questions(given) else None for given, output in zip(inputs, outputs)])

    asks = F.lit(False)
    for platform, tool in ASK_TOOLS.items():
        asks = asks | ((F.col("source_platform") == platform) & (F.col("tool_name") == tool))
    calls = atoms.where((F.col("content_kind") == "tool_call") & asks).select(
        *SESSION, F.col("atom_id").alias("call_atom"), "tool_name", "tool_input"
    )
    last = edges_tool_result(atoms).groupBy("to_atom_id").agg(F.max_by("from_atom_id", "from_pos").alias("result_atom"))
    results = atoms.where(F.col("content_kind") == "tool_result").select(
        F.col("atom_id").alias("result_atom"), F.col("time_key").alias("created_at"), "tool_output"
    )
    joined = calls.join(last, calls["call_atom"] == last["to_atom_id"]).join(results, "result_atom")
    answered = joined.withColumn("answers", F.pandas_udf(match, ANSWER_TYPE)("tool_input", "tool_output"))
    return answered.where(F.col("answers").isNotNull()).select(
        stable_id("aqq", F.col("source_id"), F.col("call_atom"), F.col("result_atom")).alias("ask_id"),
        *SESSION,
        "tool_name",
        "created_at",
        "call_atom",
        "result_atom",
        "answers",
    )
