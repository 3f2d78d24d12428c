"""Column sets of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions.tokens import USAGE_TYPE

# What a fragment or atom can say beyond its place in the session; absent members are null.
PAYLOAD = {
    "text": "string",
    "message_id": "string",
    "request_id": "string",
    "is_sidechain": "boolean",
    "model": "string",
    "stop_reason": "string",
    "source_event_type": "string",
    "usage": USAGE_TYPE,
    "cumulative_usage": USAGE_TYPE,
    "delta_usage": USAGE_TYPE,
    "call_id": "string",
    "tool_name": "string",
    "tool_input": "string",
    "tool_output": "string",
    "path": "string",
    "repo_root": "string",
    "repo_remote": "string",
    "title": "string",
    "relation": "string",  # JSON object of a session relation
    "detail": "string",  # JSON object with whatever else the record said
}

RECORD = {
    "source_id": "string",
    "source_platform": "string",
    "blob_id": "string",
    "origin_path": "string",
    "session_ref": "string",
    "record_id": "string",
    "ordinal": "bigint",
    "pointer": "string",
    "observed_at": "string",
    "raw_json": "string",
}

FRAGMENT = {
    "fragment_id": "string",
    "source_id": "string",
    "source_platform": "string",
    "session_ref": "string",
    "blob_id": "string",
    "record_id": "string",
    "ordinal": "bigint",
    "seq_no": "bigint",
    "arrival": "bigint",
    "fragment_kind": "string",
    "actor_kind": "string",
    "origin_kind": "string",
    "display_policy": "string",
    "time_key": "string",
    **PAYLOAD,
}

ATOM = {
    "atom_id": "string",
    "fragment_id": "string",
    "source_id": "string",
    "source_platform": "string",
    "session_ref": "string",
    "blob_id": "string",
    "record_id": "string",
    "pos": "bigint",
    "actor_kind": "string",
    "origin_kind": "string",
    "content_kind": "string",
    "signal_kind": "string",
    "display_policy": "string",
    "time_key": "string",
    **PAYLOAD,
}


def complete(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Bring ``df`` to a column set: cast what is there, null what is not, drop the rest."""
    present = set(df.columns)
    return df.select(
        *[(F.col(name) if name in present else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()]
    )
