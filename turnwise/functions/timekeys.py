"""Time keys are ISO-8601 UTC strings with milliseconds; they order like the instants they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(instant: Column) -> Column:
    return F.date_format(instant, ISO_PATTERN)


def from_millis(millis: Column) -> Column:
    return iso(F.timestamp_millis(millis.cast("bigint")))


def coerce(text: Column) -> Column:
    """A parseable time string as a time key, anything else null."""
    return iso(F.try_to_timestamp(F.nullif(text, F.lit(""))))


def instant(time_key: Column) -> Column:
    return F.try_to_timestamp(time_key)


def millis(time_key: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(time_key))


def day(time_key: Column) -> Column:
    return F.substring(time_key, 1, 10)


def month(time_key: Column) -> Column:
    return F.substring(time_key, 1, 7)
