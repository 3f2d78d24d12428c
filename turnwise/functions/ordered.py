"""Running values over ordered rows without ever putting one key into one task.

A plain ``Window.partitionBy(session).orderBy(pos)`` sends a whole session to one task. A session may hold a third of
all rows, so the scan is done in two levels: rows are windowed inside bounded chunks of a session, each chunk is
summarised to one row (with map-side combine), the summaries are windowed per session, and every row combines its local
value with what its chunk inherits. A chunk expression must not decrease along the order; ``position_chunk`` bounds a
chunk by row count where rows are numbered. Where they are not, ``with_running_ranged`` cuts the rows of all keys into
ranges of about equal size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.session import materialize

CHUNK_ROWS = 65_536


@dataclass(frozen=True)
class Running:
    how: str  # sum | max | min | last | next
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def running_min(value: Column, inclusive: bool = True) -> Running:
    return Running("min", value, inclusive)


def last_value(value: Column, inclusive: bool = True) -> Running:
    """Latest non-null value at or before the row."""
    return Running("last", value, inclusive)


def next_value(value: Column, inclusive: bool = True) -> Running:
    """Earliest non-null value at or after the row."""
    return Running("next", value, inclusive)


def position_chunk(pos: str, rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(pos) / F.lit(rows))


def _over(spec: Running, forward, backward) -> Column:
    window = backward if spec.how == "next" else forward
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    if spec.how in ("last", "next"):
        return F.last(spec.value, ignorenulls=True).over(frame)
    return getattr(F, spec.how)(spec.value).over(frame)


def _summary(spec: Running, order: list[str]) -> Column:
    if spec.how in ("last", "next"):
        at = F.when(spec.value.isNotNull(), F.struct(*[F.col(name) for name in order]))
        return F.max_by(spec.value, at) if spec.how == "last" else F.min_by(spec.value, at)
    return getattr(F, spec.how)(spec.value)


def _combine(how: str, local: Column, inherited: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(inherited, F.lit(0))
    if how == "max":
        return F.greatest(local, inherited)
    if how == "min":
        return F.least(local, inherited)
    return F.coalesce(local, inherited)


def with_running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunks: list[Column | str],
    **specs: Running,
) -> DataFrame:
    """Add one column per spec. ``order`` columns ascend; ``chunks`` run from fine to coarse.

    A chunk given by column name keeps the partitioning of an earlier scan over the same chunks.
    """
    levels = [chunk if isinstance(chunk, str) else f"_chunk{i}_{len(chunks)}" for i, chunk in enumerate(chunks)]
    chunked = df.select("*", *[c.alias(level) for c, level in zip(chunks, levels) if not isinstance(c, str)])
    chunk_key = [*keys, levels[0]]
    forward = Window.partitionBy(*chunk_key).orderBy(*order)
    backward = Window.partitionBy(*chunk_key).orderBy(*[F.desc(name) for name in order])
    local = chunked.select("*", *[_over(spec, forward, backward).alias(f"_local_{name}") for name, spec in specs.items()])

    # A fine chunk belongs to the coarse one it starts in, so the levels need not divide each other.
    summary = chunked.groupBy(*chunk_key).agg(
        *[F.min(level).alias(level) for level in levels[1:]],
        *[_summary(spec, order).alias(f"_part_{name}") for name, spec in specs.items()],
    )
    inherited = {name: Running(spec.how, F.col(f"_part_{name}"), False) for name, spec in specs.items()}
    if len(levels) == 1:
        ahead = Window.partitionBy(*keys).orderBy(levels[0])
        behind = Window.partitionBy(*keys).orderBy(F.desc(levels[0]))
        carry = summary.select(*chunk_key, *[_over(spec, ahead, behind).alias(f"_carry_{name}") for name, spec in inherited.items()])
    else:
        carry = with_running(
            summary, keys, [levels[0]], levels[1:], **{f"_carry_{n}": s for n, s in inherited.items()}
        ).select(*chunk_key, *[f"_carry_{name}" for name in specs])

    joined = local.join(carry, chunk_key, "left")
    return joined.select(
        *[F.col(name) for name in df.columns],
        *[_combine(spec.how, F.col(f"_local_{name}"), F.col(f"_carry_{name}")).alias(name) for name, spec in specs.items()],
    )


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows cut into ranges of key and order, written once with the number of their range in ``_range``.

    The bounds come from a sample of the rows, so that a range holds about its share of them whatever their keys and
    times are. Rows equal in all of key and order come in no certain order, so their place in the input may cut between
    them. Nulls come first, as in the windows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, "_place")
    return materialize(placed.drop("_place").select("*", F.spark_partition_id().alias("_range")), "ranges")


def with_running_ranged(df: DataFrame, keys: list[str], order: list[str], **specs: Running) -> DataFrame:
    """``with_running`` over ranges bounded in rows; the input is evaluated once and ``order`` may hold nulls.

    Rows that come from ``ranged`` with the same key and order are scanned as they are, and keep their ``_range``.
    """
    cut = df if "_range" in df.columns else ranged(df, keys, order)
    return with_running(cut, keys, order, ["_range"], **specs).select(*df.columns, *specs)


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Dense zero-based position of each row within its key."""
    return with_running_ranged(df, keys, order, **{name: running_sum(F.lit(1), inclusive=False)})
