"""Token-usage structs: normalisation, totals and merging with absent kept apart from zero."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions import jsonv
from turnwise.functions.bind import bind

FIELDS = (
    "input_tokens",
    "cache_read_input_tokens",
    "cache_creation_input_tokens",
    "cached_input_tokens",
    "output_tokens",
    "reasoning_output_tokens",
    "total_tokens",
)
USAGE_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in FIELDS) + ",model:string>"

# Spellings under which transcripts report each number, first match wins.
SPELLINGS = {
    "input_tokens": ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens", "input_token_count", "inputTokenCount"),
    "cache_read_input_tokens": ("cache_read_input_tokens", "cacheReadInputTokens", "cacheReadTokens", "cache_read_tokens"),
    "cache_creation_input_tokens": (
        "cache_creation_input_tokens",
        "cacheCreationInputTokens",
        "cacheCreationTokens",
        "cache_creation_tokens",
    ),
    "cached_input_tokens": ("cached_input_tokens", "cachedInputTokens"),
    "output_tokens": (
        "output_tokens",
        "outputTokens",
        "completion_tokens",
        "completionTokens",
        "output_token_count",
        "outputTokenCount",
    ),
    "reasoning_output_tokens": ("reasoning_output_tokens", "reasoningOutputTokens", "thinkingTokens", "thinking_tokens"),
    "total_tokens": ("total_tokens", "totalTokens", "total_token_count", "totalTokenCount"),
}
# Members that may hold a nested usage object.
USAGE_MEMBERS = (
    "usage",
    "token_usage",
    "tokenUsage",
    "tokens",
    "token_count",
    "tokenCount",
    "metadata",
    "last_token_usage",
    "lastTokenUsage",
)
CUMULATIVE_MEMBERS = ("total_token_usage", "totalTokenUsage", "total_usage", "totalUsage", "info")
# Levels of members that are looked into.
DEPTH = 3
PAYLOAD_MEMBERS = ("token_usage", "usage", "tokenUsage")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def pack(values: dict[str, Column], model: Column) -> Column:
    return F.struct(*[values[name].cast("bigint").alias(name) for name in FIELDS], model.cast("string").alias("model"))


def normalize(raw: Column) -> Column:
    """Usage struct from raw numbers: a cache lump becomes cache read, a missing total is derived; null if all absent."""

    def resolve(given: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        values = {name: given.getField(name) for name in FIELDS}
        read, creation, lump = (values[n] for n in ("cache_read_input_tokens", "cache_creation_input_tokens", "cached_input_tokens"))
        lumped = lump.isNotNull() & read.isNull() & creation.isNull()
        split = read.isNotNull() | creation.isNotNull()
        cache_read = F.when(lumped, lump).otherwise(read)
        fresh = F.when(lumped, values["input_tokens"] - lump).otherwise(values["input_tokens"])
        cached = F.coalesce(lump, F.when(split, F.coalesce(creation, zero) + F.coalesce(read, zero)))
        derived = reduce(add, [F.coalesce(part, zero) for part in (fresh, values["output_tokens"], creation, cache_read)])
        resolved = {
            "input_tokens": fresh,
            "cache_read_input_tokens": cache_read,
            "cached_input_tokens": cached,
            "total_tokens": F.coalesce(values["total_tokens"], derived),
        }
        packed = pack({**values, **resolved}, given.getField("model"))
        return F.when(F.coalesce(*values.values()).isNotNull(), packed)

    return bind(raw, resolve)


def from_object(value: Column) -> Column:
    """Usage struct of one JSON object, without looking into nested members."""

    def read(given: Column) -> Column:
        values = {name: jsonv.number(given, *keys) for name, keys in SPELLINGS.items()}
        return F.when(is_object(given), normalize(pack(values, F.try_variant_get(given, "$.model", "string"))))

    return bind(value, read)


def merge(usages: list[Column] | Column) -> Column:
    """Sum of usage structs (columns, or one array of them) in order; a single one stays as it is, among several an absent field counts as zero."""

    def total(known: Column) -> Column:
        zero = F.lit(0).cast("bigint")

        def summed(name: str) -> Column:
            return F.aggregate(known, zero, lambda acc, u: acc + F.coalesce(u.getField(name), zero))

        models = F.array_compact(F.transform(known, lambda u: u.getField("model")))
        both = pack({n: summed(n) for n in FIELDS}, F.try_element_at(models, F.lit(-1)))
        return F.when(F.size(known) > 1, both).otherwise(F.get(known, F.lit(0)))

    listed = F.array(*usages) if isinstance(usages, list) else usages
    return bind(F.array_compact(listed), total)


def extract(value: Column, members: tuple[str, ...] = USAGE_MEMBERS) -> Column:
    """Usage of a JSON object: that of each declared member, down to three levels, merged with its own numbers."""

    def objects(held: Column, depth: int) -> Column:
        """An object and those in its members, each after what it holds."""
        if not depth:
            return F.array(held)
        inner = F.filter(F.array(*[F.try_variant_get(held, f"$.{member}", "variant") for member in members]), is_object)
        return F.concat(F.flatten(F.transform(inner, lambda one: objects(one, depth - 1))), F.array(held))

    def total(given: Column) -> Column:
        return F.when(is_object(given), merge(F.transform(objects(given, DEPTH), from_object)))

    return bind(value, total)


def from_payload(value: Column) -> Column:
    """Usage a message carries: its usage member if it has one, else whatever its own members say."""
    holder = F.coalesce(*[F.try_variant_get(value, f"$.{member}", "variant") for member in PAYLOAD_MEMBERS], value)
    return bind(holder, extract)


def structured_total(usage: Column) -> Column:
    """Declared total, else input + cache + output, where cache is read + creation if either is known."""
    zero = F.lit(0).cast("bigint")
    read, creation = usage.getField("cache_read_input_tokens"), usage.getField("cache_creation_input_tokens")
    cache = F.coalesce(
        F.when(read.isNotNull() | creation.isNotNull(), F.coalesce(read, zero) + F.coalesce(creation, zero)),
        usage.getField("cached_input_tokens"),
    )
    parts = [usage.getField("input_tokens"), cache, usage.getField("output_tokens")]
    known = F.coalesce(*parts).isNotNull()
    return F.coalesce(
        usage.getField("total_tokens"), F.when(known, reduce(add, [F.coalesce(p, zero) for p in parts]))
    )


def merged_aggregate(usage: Column, order: Column) -> Column:
    """``merge`` as an aggregate over the rows of a group."""
    several = F.count(usage) >= 2
    zero = F.lit(0).cast("bigint")
    values = {
        n: F.when(several, F.coalesce(F.sum(usage.getField(n)), zero)).otherwise(F.max(usage.getField(n))) for n in FIELDS
    }
    model = F.max_by(usage.getField("model"), F.when(usage.getField("model").isNotNull(), order))
    return F.when(F.count(usage) > 0, pack(values, model))
