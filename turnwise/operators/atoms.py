"""Fragments to ordered conversation atoms, and the edges between tool atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.ids import stable_id
from turnwise.functions.ordered import last_value, position_chunk, with_position, with_running
from turnwise.schemas import ATOM, complete

SESSION = ["source_id", "session_ref"]
SIGNALS = ("workspace_signal", "model_signal", "token_usage_signal", "session_relation", "title_signal", "unknown")


def atomize(fragments: DataFrame) -> DataFrame:
    """One atom per fragment except session metadata, densely numbered per session by (time, seq, capture, record)."""
    kind = F.col("fragment_kind")
    text, tool, signal = kind == "text", kind.isin("tool_call", "tool_result"), kind.isin(*SIGNALS)
    kept = fragments.where(text | tool | signal)
    order = ["time_key", "seq_no", "blob_id", "ordinal", "arrival", "fragment_id"]
    placed = with_position(
        kept.na.fill("", ["blob_id"]).na.fill(0, ["ordinal", "arrival"]),
        SESSION,
        order,
    )
    atoms = placed.select(
        "*",
        stable_id("atom", F.col("source_id"), F.col("fragment_id")).alias("atom_id"),
        F.when(text, "text").when(tool, kind).otherwise("meta_signal").alias("content_kind"),
        F.when(signal, kind).alias("signal_kind"),
    )
    return complete(
        atoms.withColumns(
            {
                "actor_kind": F.when(text, F.coalesce("actor_kind", F.lit("assistant"))).when(tool, "tool").otherwise("system"),
                "origin_kind": F.when(text, F.coalesce("origin_kind", F.lit("assistant_authored")))
                .when(tool, "tool_generated")
                .otherwise("source_meta"),
                "display_policy": F.when(text, F.coalesce("display_policy", F.lit("show"))).when(tool, "show").otherwise("hide"),
                "text": F.when(text, F.coalesce("text", F.lit(""))).otherwise(F.col("text")),
            }
        ),
        ATOM,
    )


def _edge(df: DataFrame, to: Column, kind: str) -> DataFrame:
    return df.select(
        stable_id("edge", F.col("source_id"), F.col("session_ref"), F.col("atom_id"), to, kind).alias("edge_id"),
        *SESSION,
        F.col("atom_id").alias("from_atom_id"),
        to.alias("to_atom_id"),
        F.lit(kind).alias("edge_kind"),
        F.col("pos").alias("from_pos"),
    )


def edges_tool_result(atoms: DataFrame) -> DataFrame:
    """Each tool result to the latest earlier call with its call id in the session; unmatched results have no edge."""
    tools = atoms.where(F.col("content_kind").isin("tool_call", "tool_result") & (F.col("call_id") != "")).select(
        *SESSION, "call_id", "pos", "atom_id", "content_kind"
    )
    call = F.when(F.col("content_kind") == "tool_call", F.col("atom_id"))
    seen = with_running(tools, [*SESSION, "call_id"], ["pos"], [position_chunk("pos")], call_atom=last_value(call, False))
    return _edge(seen.where((F.col("content_kind") == "tool_result") & F.col("call_atom").isNotNull()), F.col("call_atom"), "tool_result_for")


def edges_spawned_from(atoms: DataFrame) -> DataFrame:
    """Each tool call to the latest earlier assistant text of the session, hidden ones included."""
    said = (F.col("actor_kind") == "assistant") & (F.col("content_kind") == "text")
    rows = atoms.where(said | (F.col("content_kind") == "tool_call")).select(*SESSION, "pos", "atom_id", "content_kind", "actor_kind")
    seen = with_running(rows, SESSION, ["pos"], [position_chunk("pos")], text_atom=last_value(F.when(said, F.col("atom_id")), False))
    return _edge(seen.where((F.col("content_kind") == "tool_call") & F.col("text_atom").isNotNull()), F.col("text_atom"), "spawned_from")
