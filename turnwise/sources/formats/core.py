"""What all profiles share: the parse gate, items, and the step from items to fragments.

A profile describes a record as an array of *items* (one struct per piece). The array is exploded once, user text is
split into chunks, and the pieces get their ids; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, roles, usertext
from turnwise.functions.bind import bind
from turnwise.functions.ids import stable_id
from turnwise.functions.tokens import USAGE_TYPE
from turnwise.schemas import FRAGMENT, PAYLOAD, RECORD, complete

SAY = "say"  # text still to be split into chunks by who speaks
ITEM_ARRAY = "array<struct<kind:string,fields:map<string,string>>>"
FIELDS = ("actor_kind", "origin_kind", "display_policy", *[name for name, kind in PAYLOAD.items() if kind == "string"], "is_sidechain", "audit")
KEYS = [name for name in RECORD if name != "raw_json"]
CHUNK_SPACE = 1 << 20  # chunks of one item keep their place between items


def item(kind: str, **fields) -> Column:
    """One piece of a record: its kind and the fields it says something about."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [part for name, v in fields.items() for part in (F.lit(name), value(v).cast("string"))]
    said = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(kind).alias("kind"), said.alias("fields"))


def some(condition: Column, piece: Column) -> Column:
    return F.when(condition, piece)


def items(*pieces: Column) -> Column:
    """Array of the pieces that are there."""
    return F.array_compact(F.array(*pieces)).cast(ITEM_ARRAY)


def no_items() -> Column:
    return F.array().cast(ITEM_ARRAY)


def parse_records(records: DataFrame) -> DataFrame:
    """Records with their parsed value ``v`` and ``gate``, the code of those that are no JSON object (null for the others)."""
    # The parser stops behind the first value; inside brackets anything that follows it is an error or a second element.
    bracketed = F.try_parse_json(F.concat(F.lit("["), F.col("raw_json"), F.lit("]")))
    tried = complete(records, RECORD).withColumn("_values", F.try_variant_get(bracketed, "$", "array<variant>"))
    tried = tried.withColumn("v", F.when(F.size("_values") == 1, F.get("_values", F.lit(0)))).drop("_values")
    gate = F.when(F.col("v").isNull(), "record_json_parse_failed").when(~jsonv.is_object(F.col("v")), "record_not_object")
    return tried.withColumn("gate", gate)


def fragment_id() -> Column:
    return stable_id("fragment", F.col("source_id"), F.col("session_ref"), F.col("record_id"), F.col("arrival"), F.col("fragment_kind"))


def record_audits(df: DataFrame, code: Column, severity: str | Column, loss_kind: Column, detail: Column) -> DataFrame:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(
        "source_id",
        "session_ref",
        "blob_id",
        F.col("record_id").alias("scope_ref"),
        F.lit("parse_source_fragments").alias("stage_kind"),
        code.alias("diagnostic_code"),
        severity.alias("severity"),
        loss_kind.alias("loss_kind"),
        detail.alias("detail"),
    )


def content_text(entry: Column) -> Column:
    """Text of a content item: its own text, else the texts of the parts it holds."""
    parts = F.transform(jsonv.array(entry, "content"), lambda part: jsonv.string(part, "text", "content"))
    joined = F.nullif(F.array_join(F.filter(parts, lambda t: t != ""), "\n"), F.lit(""))
    return F.coalesce(F.nullif(jsonv.string(entry, "text", "thinking", "output_text", "input_text", "content"), F.lit("")), joined)


def tool_output(value: Column) -> Column:
    """Tool output as text: strings as they are, parts joined by line ends, objects as JSON."""

    def flat(given: Column) -> Column:
        entries = F.coalesce(given.cast("array<variant>"), F.array().cast("array<variant>"))
        texts = F.transform(F.filter(entries, jsonv.is_object), lambda e: F.coalesce(jsonv.string(e, "text", "content"), F.to_json(e)))
        return (
            F.when(jsonv.is_array(given), F.array_join(texts, "\n"))
            .when(jsonv.is_object(given), F.to_json(given))
            .otherwise(F.coalesce(jsonv.as_string(given), F.lit("")))
        )

    return bind(F.try_variant_get(value, "$", "variant"), flat)


def tool_input(value: Column) -> Column:
    """Tool input as a JSON object: parsed from a string, else wrapped."""

    def flat(given: Column) -> Column:
        text = jsonv.as_string(given)
        parsed = F.try_parse_json(text)
        wrapped = lambda name, v: F.to_json(F.struct(v.alias(name)))
        return (
            F.when(given.isNull() | F.is_variant_null(given), "{}")
            .when(jsonv.is_object(given), F.to_json(given))
            .when(text.isNotNull() & jsonv.is_object(parsed), F.to_json(parsed))
            .when(text.isNotNull(), F.when(F.trim(text) == "", "{}").otherwise(wrapped("raw", text)))
            .when(jsonv.is_array(given), wrapped("items", given))
            .otherwise(wrapped("value", given))
        )

    return F.coalesce(bind(F.try_variant_get(value, "$", "variant"), flat), F.lit("{}"))


def object_or_empty(value: Column) -> Column:
    return bind(value, lambda v: F.when(jsonv.is_object(v), F.to_json(v)).otherwise("{}"))


def first_present(value: Column, *paths: str) -> Column:
    """First of the members that is there and not null, as a VARIANT."""
    found = [bind(jsonv.member(value, p), lambda m: F.when(m.isNotNull() & ~F.is_variant_null(m), m)) for p in paths]
    return F.coalesce(*found)


def relation_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


#: What a piece is besides a fragment: only an audit, or a record of which nothing is left.
NO_FRAGMENT = ("audit_only", "nothing")
PIECE = FRAGMENT | {"audit": "string", "heads_record": "boolean"}


def to_pieces(df: DataFrame) -> DataFrame:
    """Everything that comes of records with ``items``, ``time_key`` and what the first text of a record carries: one row
    per fragment or audit, and one for a record of which nothing is left.

    ``signal_count`` pieces at the front are numbered on their own, the rest again from zero; ``arrival`` keeps their order.
    ``text_usage`` (unless ``usage_on_text`` is false), ``text_stop``, ``text_message_id`` and ``text_model`` go onto the first assistant chunk.
    Records that did not pass the gate become unknown fragments with an audit each, whatever the profile made of them.
    """
    on_text = F.col("usage_on_text") if "usage_on_text" in df.columns else F.lit(True)
    df = df.withColumn("usage_on_text", on_text)
    if "signal_count" not in df.columns:
        df = df.withColumn("signal_count", F.lit(0))
    defaults = {"text_usage": USAGE_TYPE, "cumulative": USAGE_TYPE, "text_stop": "string", "text_message_id": "string", "text_model": "string"}
    for name, kind in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    shut = F.col("gate").isNotNull()
    refused = items(item("unknown", detail=F.col("raw_json"), audit=F.concat("gate", F.lit("|warning|unknown_fragment"))))
    df = df.withColumns({"items": F.when(shut, refused).otherwise(F.col("items")), "signal_count": F.when(shut, 0).otherwise(F.col("signal_count")), "time_key": F.when(shut, F.col("observed_at")).otherwise(F.col("time_key"))})
    said = F.transform("items", lambda i: (i.kind == SAY) & (i.fields["actor_kind"] == "assistant"))
    # The outer form keeps records without items, and adds no size filter, which the optimizer would push below by
    # repeating the whole item expression.
    placed = df.select(*KEYS, "time_key", *defaults, (F.array_position(said, True) - 1).alias("_first_say"), "signal_count", "usage_on_text", F.posexplode_outer("items").alias("item_no", "item"))
    local = F.when(F.col("item_no") < F.col("signal_count"), F.col("item_no")).otherwise(F.col("item_no") - F.col("signal_count"))
    flat = placed.select(*KEYS, "time_key", *defaults, "item_no", "usage_on_text", local.alias("local_no"), (F.col("item_no") == F.col("_first_say")).alias("_first"),
        F.coalesce("item.kind", F.lit("nothing")).alias("kind"),
        *[F.col("item.fields")[name].alias(name) for name in FIELDS],
    )
    talk = F.col("kind") == SAY
    user = talk & (F.col("actor_kind") == "user")
    whole = F.array(
        F.struct(
            F.when(F.col("actor_kind") == "assistant", "assistant_authored").otherwise("source_instruction").alias("origin_kind"),
            F.col("text").alias("text"),
            F.lit(None).cast("string").alias("display_policy"),
        )
    )
    chunks = F.when(user, usertext.split_user_text(F.when(user, F.col("text")), F.col("source_platform"), F.col("origin_path"))).when(talk, whole)
    split = flat.withColumn("_chunks", chunks).select("*", F.posexplode_outer("_chunks").alias("chunk_no", "chunk"))
    first, bill = talk & F.col("_first"), F.col("kind") == "token_usage_signal"
    shown = F.coalesce("chunk.display_policy", roles.display_policy(F.col("chunk.origin_kind"), F.col("chunk.text")))
    done = split.withColumns(
        {
            "fragment_kind": F.when(talk & F.col("chunk").isNull(), "nothing").when(talk, "text").otherwise(F.col("kind")),
            "seq_no": F.col("local_no").cast("bigint") * CHUNK_SPACE + F.coalesce("chunk_no", F.lit(0)),
            "arrival": F.col("item_no").cast("bigint") * CHUNK_SPACE + F.coalesce("chunk_no", F.lit(0)),
            "origin_kind": F.when(talk, F.col("chunk.origin_kind")).otherwise(F.col("origin_kind")),
            "display_policy": F.when(talk, shown).otherwise(F.col("display_policy")),
            "text": F.when(talk, F.col("chunk.text")).otherwise(F.col("text")),
            "usage": F.when((first & F.col("usage_on_text")) | bill, F.col("text_usage")),
            "cumulative_usage": F.when(bill, F.col("cumulative")),
            "stop_reason": F.when(first, F.col("text_stop")).otherwise(F.col("stop_reason")),
            "message_id": F.when(first, F.col("text_message_id")).otherwise(F.col("message_id")),
            "model": F.when(first, F.coalesce("text_model", "model")).when(bill, F.coalesce("model", "text_usage.model")).otherwise(F.col("model")),
            # An audit belongs to its item, and a record is counted at its first piece.
            "audit": F.when(F.coalesce("chunk_no", F.lit(0)) == 0, F.col("audit")),
            "heads_record": (F.coalesce("item_no", F.lit(0)) == 0) & (F.coalesce("chunk_no", F.lit(0)) == 0),
        }
    ).withColumn("fragment_id", fragment_id())
    return complete(done, PIECE)


def fragments_in(pieces: DataFrame) -> DataFrame:
    return pieces.where(~F.col("fragment_kind").isin(*NO_FRAGMENT)).select(*FRAGMENT)


def audits_in(pieces: DataFrame) -> DataFrame:
    told = [F.split_part("audit", F.lit("|"), F.lit(n)) for n in (1, 2, 3)]
    return record_audits(pieces.where(F.col("audit").isNotNull()), told[0], told[1], told[2], told[0])


def unknown(v: Column, code: str) -> Column:
    """A piece nobody understands: kept as an unknown fragment, with a warning."""
    return item("unknown", detail=F.to_json(v), audit=f"{code}|warning|unknown_fragment")


def dropped(code: str) -> Column:
    """A record kept as evidence only, with an informational audit and no fragment."""
    return item("audit_only", audit=f"{code}|info|dropped_for_projection")


def usage_item(stop: Column | None = None, **fields) -> Column:
    """A billing signal; it carries the record's ``text_usage`` (and ``cumulative``)."""
    return item("token_usage_signal", **({} if stop is None else {"stop_reason": stop}), **fields)


def has_say(pieces: Column) -> Column:
    return F.exists(pieces, lambda i: (i.kind == SAY) & (i.fields["actor_kind"] == "assistant"))


def with_model(usage: Column, model: Column) -> Column:
    """Usage with the message's model where it names none itself."""
    return bind(usage, lambda u: F.when(u.isNotNull(), u.withField("model", F.coalesce(u.getField("model"), model))))
