"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(part)


def stable_id(*parts) -> Column:
    """SHA-1 of the parts joined by ``::`` (strings are literals, columns are values)."""
    return F.sha1(F.concat_ws("::", *[F.coalesce(_col(part).cast("string"), F.lit("")) for part in parts]))


def composite_key(prefix: str, *parts) -> Column:
    """``prefix-`` plus the dash-joined parts, with runs outside ``[a-zA-Z0-9._-]`` turned into one dash."""
    joined = F.concat_ws("-", *[F.coalesce(_col(part).cast("string"), F.lit("")) for part in parts])
    return F.concat(F.lit(f"{prefix}-"), F.regexp_replace(joined, r"[^a-zA-Z0-9._-]+", "-"))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters of a string, as eight hex digits."""
    offset, prime, size = 2166136261, 16777619, 4294967296  # fixed values of the hash
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != F.lit("")), lambda c: F.ascii(c).cast("bigint"))
    hashed = F.aggregate(
        codes,
        F.lit(offset).cast("bigint"),
        lambda acc, code: F.pmod(acc.bitwiseXOR(code) * F.lit(prime).cast("bigint"), F.lit(size).cast("bigint")),
    )
    return F.lower(F.lpad(F.hex(hashed), 8, "0"))


def host_id(hostname: Column) -> Column:
    return F.concat(F.lit("host-"), fnv1a32(F.lower(F.trim(hostname))))


def source_instance_id(host: Column, slot: Column, base_dir: Column) -> Column:
    """``base_dir`` is expected as a path identity (see ``paths.path_identity``)."""
    return F.concat(F.lit("srcinst-"), slot, F.lit("-"), fnv1a32(F.concat(host, F.lit("|"), base_dir)))
