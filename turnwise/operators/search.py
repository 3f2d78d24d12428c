"""Ranked search over turns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text, timekeys
from turnwise.functions.bind import bind

_SPECIAL = re.compile(r"([.*+?^${}()|\[\]\\])")
RECENCY_DAYS = 90
SPANS = "array<struct<start:int,end:int>>"
OBSERVED = (
    "workspace_path",
    "workspace_path_normalized",
    "repo_root",
    "repo_remote",
    "repo_fingerprint",
    "source_native_project_ref",
)


def search_terms(query: str | None) -> list[str]:
    """Distinct lower-cased words of a query, in order."""
    return list(dict.fromkeys((query or "").strip().lower().split()))


def search_candidates(turns: DataFrame, sessions: DataFrame | None = None, observations: DataFrame | None = None) -> DataFrame:
    """Turns with the text to search: the whole canonical text, and every path known for the turn.

    Path fields of a session's observations are made distinct (with map-side combine) before they are joined to text.
    """
    path_parts = [F.col("path_text")]
    if sessions is not None:
        named = ["working_directory", "resume_working_directory", "source_native_project_ref"]
        present = [c for c in named if c in sessions.columns]
        turns = turns.join(sessions.select("session_ref", *[F.col(c).alias(f"_s_{c}") for c in present]), "session_ref", "left")
        path_parts += [F.col(f"_s_{c}") for c in present]
    if observations is not None:
        fields = [c for c in OBSERVED if c in observations.columns]
        parts = F.array_compact(F.array(*[text.optional(F.col(c)) for c in fields]))
        distinct = observations.select("session_ref", F.explode(parts).alias("part")).distinct()
        per_session = distinct.groupBy("session_ref").agg(F.array_join(F.sort_array(F.collect_list("part")), " ").alias("_observed"))
        turns = turns.join(per_session, "session_ref", "left")
        path_parts.append(F.col("_observed"))
    extra = [c for c in turns.columns if c.startswith("_s_") or c == "_observed"]
    parts = F.filter(F.array_compact(F.array(*path_parts)), lambda p: p != "")
    return turns.withColumns(
        {
            "canonical_text": F.coalesce("canonical_text", F.lit("")),
            "path_text": F.nullif(F.array_join(parts, " "), F.lit("")),
        }
    ).drop(*extra)


def search_match(terms: list[str]) -> Column:
    """Every term occurs in the canonical text, or every term occurs in the path text."""

    def all_in(column: str) -> Column:
        lowered = F.lower(F.coalesce(column, F.lit("")))
        found = F.lit(True)
        for term in terms:
            found = found & lowered.contains(term)
        return found

    return all_in("canonical_text") | all_in("path_text")


def highlights(column: Column, terms: list[str]) -> Column:
    """Spans of all case-insensitive hits of all terms; overlapping or touching spans are merged."""
    if not terms:
        return F.array().cast(SPANS)

    def hits(term: str) -> Column:
        size = len(term)

        def advance(acc: Column, piece: Column) -> Column:
            at = acc.getField("at") + F.length(piece)
            span = F.struct(at.alias("start"), (at + size).alias("end"))
            return F.struct((at + size).alias("at"), F.concat(acc.getField("spans"), F.array(span)).alias("spans"))

        # The pieces between hits give the offsets; the piece after the last hit starts no span.
        pieces = F.split(F.lower(column), _SPECIAL.sub(r"\\\1", term), -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
        return bind(pieces, lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), start, advance).getField("spans"))

    def fold(acc: Column, span: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last.getField("start").alias("start"), F.greatest(last.getField("end"), span.getField("end")).alias("end"))
        apart = (F.size(acc) == 0) | (span.getField("start") > last.getField("end"))
        return F.when(apart, F.concat(acc, F.array(span))).otherwise(
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))
        )

    every = F.array_sort(F.concat(*[F.when(F.contains(F.lower(column), F.lit(t)), hits(t)).otherwise(F.array().cast(SPANS)) for t in terms]))
    return F.aggregate(every, F.array().cast(SPANS), fold)


def relevance(spans: Column, submitted: Column, now_ms: int) -> Column:
    """Ten per merged highlight plus up to five for recency, which fades over about a hundred quarters."""
    age = F.greatest(F.lit(0), F.lit(now_ms) - F.coalesce(timekeys.millis(submitted), F.lit(0)))
    quarters = age / F.lit(RECENCY_DAYS * 24 * 60 * 60 * 1000.0)
    recency = F.lit(5.0) * F.greatest(F.lit(0.0), F.lit(1.0) - F.log1p(quarters) / F.log1p(F.lit(100.0)))
    return F.size(spans) * F.lit(10.0) + recency


def search_filters(
    df: DataFrame,
    project_id: str | None = None,
    source_ids: list[str] | None = None,
    link_states: list[str] | None = None,
    value_axes: list[str] | None = None,
) -> DataFrame:
    """Keep turns of one project and of the given sets; an empty set does not filter."""
    if project_id:
        df = df.where(F.col("project_id") == project_id)
    for column, values in (("source_id", source_ids), ("link_state", link_states), ("value_axis", value_axes)):
        if values:
            df = df.where(F.col(column).isin(*values))
    return df


def search_hits(candidates: DataFrame, query: str, now_ms: int, **filters) -> DataFrame:
    """All matching turns with highlights and score; filters on plain columns run before any text work."""
    terms = search_terms(query)
    matched = search_filters(candidates, **filters)
    if terms:
        matched = matched.where(search_match(terms))
    scored = matched.withColumn("highlights", highlights(F.col("canonical_text"), terms))
    return scored.withColumn("relevance_score", relevance(F.col("highlights"), F.col("submission_started_at"), now_ms))


def ranked(hits: DataFrame) -> list[Column]:
    return [F.desc("relevance_score"), F.desc("submission_started_at"), F.asc("turn_id")]


def search(candidates: DataFrame, query: str, now_ms: int, limit: int = 50, offset: int = 0, **filters) -> tuple[DataFrame, DataFrame]:
    """One page of hits, best first (a bounded top-k, no global sort), and the exact number of hits."""
    hits = search_hits(candidates, query, now_ms, **filters)
    page = hits.orderBy(*ranked(hits)).offset(offset).limit(limit)
    terms = search_terms(query)
    counted = search_filters(candidates, **filters)
    total = (counted.where(search_match(terms)) if terms else counted).agg(F.count("*").alias("total"))
    return page, total


def search_groups(hits: DataFrame, projects: DataFrame) -> DataFrame:
    """Hits per project, groups ordered by their best hit; hits without a known project form one bucket.

    The best hit is an aggregate over (score, time, id) and needs no rank over all hits.
    """
    names = projects.select("project_id", F.col("display_name").alias("_name"))
    placed = hits.join(names, "project_id", "left")
    known = F.col("_name").isNotNull()
    best = F.min(
        F.struct(
            (-F.col("relevance_score")).alias("score"),
            (-timekeys.millis(F.col("submission_started_at"))).alias("time"),
            F.col("turn_id").alias("turn_id"),
        )
    )
    grouped = placed.groupBy(
        F.when(known, F.col("project_id")).otherwise("__unlinked__").alias("project_key"),
        F.when(known, F.col("_name")).otherwise("Unlinked").alias("project_name"),
    ).agg(F.count("*").alias("hits"), best.alias("best"))
    return grouped.orderBy("best").select("project_key", "project_name", "hits", F.col("best.turn_id").alias("best_turn_id"))
