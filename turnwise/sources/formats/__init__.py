"""Format profiles: each turns raw records of one transcript shape into pieces, which are fragments and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from turnwise.sources.formats import blocks, events, generic, messages
from turnwise.session import materialize
from turnwise.sources.formats.core import NO_FRAGMENT, audits_in, fragments_in, parse_records

PROFILES = {
    "generic": generic.fragments_generic,
    "message_blocks": blocks.fragments_message_blocks,
    "factory": blocks.fragments_factory,
    "thread": blocks.fragments_thread,
    "event_log": events.fragments_event_log,
    "wire": events.fragments_wire,
    "multi_agent": messages.fragments_multi_agent,
    "chat_history": messages.fragments_chat_history,
    "cron_runs": messages.fragments_cron_runs,
}

# Which profile reads which platform.
PLATFORM_PROFILE = {
    "codex": "event_log",
    "claude_code": "message_blocks",
    "factory_droid": "factory",
    "amp": "thread",
    "accio": "multi_agent",
    "kimi": "wire",
    "grok": "chat_history",
    "cursor": "generic",
    "cursor_agent": "generic",
    "antigravity": "generic",
    "gemini": "generic",
    "opencode": "generic",
    "openclaw": "generic",
    "lobechat": "generic",
    "codebuddy": "generic",
    "zcode": "generic",
}


def fragments_of(records: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(fragments, audits) of records by profile name; records that do not parse become ``unknown`` fragments."""
    pieces = PROFILES[profile](parse_records(records))
    return fragments_in(pieces), audits_in(pieces)


def parse_stage(records: DataFrame, profile: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The same in one pass: records are parsed once, fragments and audits are read from what was written, and the counts
    of the stage (records, unparsed, fragments, audits) are observed while it is."""
    seen = Observation()
    kept, audited = ~F.col("fragment_kind").isin(*NO_FRAGMENT), F.col("audit").isNotNull()
    counts = {
        "records": F.count_if("heads_record"),
        "unparsed": F.count_if(F.split_part("audit", F.lit("|"), F.lit(1)).isin("record_json_parse_failed", "record_not_object")),
        "fragments": F.count_if(kept),
        "audits": F.count_if(audited),
    }
    pieces = PROFILES[profile](parse_records(records)).observe(seen, *[c.alias(n) for n, c in counts.items()])
    written = materialize(pieces, "pieces")
    return fragments_in(written), audits_in(written), {n: int(seen.get[n]) for n in counts}
