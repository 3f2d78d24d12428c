"""Typed access to VARIANT members: a member of another type counts as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"


def member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def as_string(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def string(value: Column, *paths: str) -> Column:
    """First of the paths that holds a JSON string."""
    found = [F.when(F.schema_of_variant(member(value, p)) == "STRING", F.try_variant_get(value, f"$.{p}", "string")) for p in paths]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def number(value: Column, *paths: str) -> Column:
    found = [F.when(F.schema_of_variant(member(value, p)).rlike(NUMBERS), F.try_variant_get(value, f"$.{p}", "double")) for p in paths]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def boolean(value: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(member(value, path)) == "BOOLEAN", F.try_variant_get(value, f"$.{path}", "boolean"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def array(value: Column, path: str) -> Column:
    """Elements of a JSON array as VARIANTs; empty if there is none."""
    return F.coalesce(F.try_variant_get(value, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
