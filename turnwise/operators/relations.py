"""Delegated sessions and automation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv
from turnwise.functions.ids import composite_key
from turnwise.functions.text import strip
from turnwise.session import materialize

# Members under which a relation names its ends, first match wins.
PARENT_MEMBERS = ("parent_uuid", "callingSessionId", "calling_session_id", "parentId", "parent_id")
CHILD_MEMBERS = ("child_session_ref", "childSessionId", "child_session_id", "session_uuid", "session_id")
TOOL_MEMBERS = ("parent_tool_ref", "callingToolUseId", "calling_tool_use_id")
AGENT_MEMBERS = ("agent_id", "agentId", "childAgentKey", "child_agent_key")


def _strings(detail: Column) -> Column:
    """All text members of an object, trimmed; other members and blank ones are absent."""
    members = F.map_filter(F.try_variant_get(detail, "$", "map<string,variant>"), lambda k, v: F.schema_of_variant(v) == "STRING")
    return F.map_filter(F.transform_values(members, lambda k, v: strip(v.cast("string"))), lambda k, v: v != "")


def _first(members: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at("_said", F.lit(m)) for m in members])


def relation_edges(fragments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Relations of known sessions: automation runs, and delegations (side threads or anything with a parent).

    The members of a relation are read into one map, and everything else looks them up there.
    """
    detail = F.col("_detail")
    parsed = fragments.select("fragment_id", "session_ref", "time_key", "relation", F.try_parse_json("relation").alias("_detail")).where(jsonv.is_object(detail))
    said = parsed.select("*", _strings(detail).alias("_said"), F.coalesce(jsonv.boolean(detail, "is_sidechain"), F.lit(False)).alias("is_sidechain"))
    named = said.select(
        "fragment_id",
        "session_ref",
        "time_key",
        "relation",
        _first(("relation_kind",)).alias("_kind"),
        "is_sidechain",
        _first(PARENT_MEMBERS).alias("parent_ref"),
        _first(CHILD_MEMBERS).alias("child_ref"),
        _first(TOOL_MEMBERS).alias("parent_tool_ref"),
        _first(AGENT_MEMBERS).alias("child_agent_key"),
        _first(("session_key",)).alias("session_key"),
        _first(("job_id",)).alias("job_id"),
        _first(("status",)).alias("status"),
    )
    kind = F.when(F.col("_kind") == "automation_run", "automation_run").when(
        F.col("is_sidechain") | F.col("parent_ref").isNotNull(), "delegated_session"
    )
    evidence = sessions.select("session_ref", "source_id", "source_platform", F.col("title").alias("evidence_title"), F.col("canonical_title").alias("evidence_canonical_title"))
    edges = named.withColumn("relation_kind", kind).where(F.col("relation_kind").isNotNull()).drop("_kind").join(evidence, "session_ref")
    own_child = F.when(F.col("relation_kind") == "delegated_session", F.col("session_ref"))
    # Edges are read once per end and viewpoint below; parsing them once is cheaper than repeating it.
    return materialize(edges.withColumn("child_is_evidence", F.col("child_ref").isNull() & own_child.isNotNull()), "relation-edges")


def resolve_session_refs(refs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Resolve (ref, source_id, source_platform) to a session id: unique in the source, else on the platform, else overall.

    A session answers to its id, its native id and its id without the ``sess:<platform>:`` prefix. Only counts and one id
    per (alias, source) leave the aggregation, so aliases shared by many sessions stay cheap.
    """
    bare = F.nullif(F.regexp_extract("session_ref", r"(?s)^sess:[^:]+:(.+)$", 1), F.lit(""))
    aliases = F.array_distinct(F.array_compact(F.array("session_ref", F.nullif(F.col("source_session_id"), F.lit("")), bare)))
    named = sessions.select("session_ref", "source_id", "source_platform", F.explode(aliases).alias("ref"))
    found = [F.count("*").alias("n"), F.min("session_ref").alias("hit")]
    by_source = named.groupBy("ref", "source_id", "source_platform").agg(*found)
    again = [F.sum("n").alias("n"), F.min("hit").alias("hit")]

    def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(*again).where(F.col("n") == 1).select(*keys, F.col("hit").alias(name))

    asked = refs.select("ref", "source_id", "source_platform").where(F.col("ref").isNotNull()).distinct()
    return (
        asked.join(unique(by_source, ["ref", "source_id"], "_source"), ["ref", "source_id"], "left")
        .join(unique(by_source, ["ref", "source_platform"], "_platform"), ["ref", "source_platform"], "left")
        .join(unique(by_source, ["ref"], "_any"), "ref", "left")
        .select("ref", "source_id", "source_platform", F.coalesce("_source", "_platform", "_any").alias("resolved"))
    )


def resolved_edges(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Edges with the sessions their two ends resolve to."""
    context = ["source_id", "source_platform"]
    refs = edges.select(F.col("parent_ref").alias("ref"), *context).unionByName(edges.select(F.col("child_ref").alias("ref"), *context))
    known = resolve_session_refs(refs, sessions)
    parent = known.select(F.col("ref").alias("parent_ref"), *context, F.col("resolved").alias("parent_session"))
    child = known.select(F.col("ref").alias("child_ref"), *context, F.col("resolved").alias("_child"))
    joined = edges.join(parent, ["parent_ref", *context], "left").join(child, ["child_ref", *context], "left")
    return joined.withColumn("child_session", F.when(F.col("child_is_evidence"), F.col("session_ref")).otherwise(F.col("_child"))).drop("_child")


def related_work(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows seen from each end of an edge; see ``merge_related`` for one row per id.

    A delegation shows inbound on the child and outbound on a different parent; an automation run shows on itself and
    outbound on a different owner. An end that does not resolve keeps the reference it was given.
    """
    ends = materialize(resolved_edges(edges, sessions), "relation-ends")
    delegated = ends.where(F.col("relation_kind") == "delegated_session")
    automated = ends.where(F.col("relation_kind") == "automation_run")
    parent_ref = F.coalesce("parent_session", "parent_ref")
    child_ref = F.coalesce("child_session", "child_ref", "session_ref")
    owner_ref = F.coalesce("parent_session", "parent_ref", "session_ref")
    run_key = F.coalesce("session_key", "fragment_id")
    none = F.lit(None).cast("string")

    def delegation(df: DataFrame, viewpoint: str, direction: str, target: Column, target_session: str) -> DataFrame:
        key = F.concat_ws(
            ":",
            F.lit("delegated"),
            F.coalesce(parent_ref, F.lit("unknown-parent")),
            child_ref,
            F.coalesce("child_agent_key", F.lit("")),
            F.lit(direction),
        )
        return df.select(
            composite_key("session-related-work", F.col(viewpoint), key).alias("id"),
            F.col(viewpoint).alias("query_session_ref"),
            "source_id",
            "source_platform",
            F.col("session_ref").alias("evidence_session_ref"),
            parent_ref.alias("parent_session_ref"),
            child_ref.alias("child_session_ref"),
            none.alias("automation_owner_session_ref"),
            "relation_kind",
            F.lit("session").alias("target_kind"),
            F.lit(direction).alias("direction"),
            target.alias("target_session_ref"),
            none.alias("target_run_ref"),
            F.lit(True).alias("transcript_primary"),
            F.when(F.col("is_sidechain"), 0.95).otherwise(0.8).alias("evidence_confidence"),
            "parent_tool_ref",
            "child_agent_key",
            none.alias("automation_job_ref"),
            none.alias("automation_run_key"),
            F.col(target_session).alias("_titled"),
            "status",
            "time_key",
            "fragment_id",
            "relation",
        )

    def automation(df: DataFrame, viewpoint: str, direction: str) -> DataFrame:
        job = F.coalesce("job_id", F.lit(""))
        key = F.concat_ws(":", F.lit("automation"), owner_ref, F.col("session_ref"), job, run_key, F.lit(direction))
        return df.select(
            composite_key("session-related-work", F.col(viewpoint), key).alias("id"),
            F.col(viewpoint).alias("query_session_ref"),
            "source_id",
            "source_platform",
            F.col("session_ref").alias("evidence_session_ref"),
            none.alias("parent_session_ref"),
            none.alias("child_session_ref"),
            owner_ref.alias("automation_owner_session_ref"),
            "relation_kind",
            F.lit("automation_run").alias("target_kind"),
            F.lit(direction).alias("direction"),
            owner_ref.alias("target_session_ref"),
            composite_key("automation-run", F.col("source_id"), F.col("session_ref"), job, run_key).alias("target_run_ref"),
            F.lit(False).alias("transcript_primary"),
            F.lit(0.95).alias("evidence_confidence"),
            "parent_tool_ref",
            none.alias("child_agent_key"),
            F.col("job_id").alias("automation_job_ref"),
            F.col("session_key").alias("automation_run_key"),
            F.col("session_ref").alias("_titled"),
            "status",
            "time_key",
            "fragment_id",
            "relation",
        )

    other_parent = F.col("parent_session").isNotNull() & (F.col("child_session").isNull() | (F.col("parent_session") != F.col("child_session")))
    other_owner = F.col("parent_session").isNotNull() & (F.col("parent_session") != F.col("session_ref"))
    rows = (
        delegation(delegated.where(F.col("child_session").isNotNull()), "child_session", "inbound", parent_ref, "parent_session")
        .unionByName(delegation(delegated.where(other_parent), "parent_session", "outbound", child_ref, "child_session"))
        .unionByName(automation(automated, "session_ref", "self"))
        .unionByName(automation(automated.where(other_owner), "parent_session", "outbound"))
    )
    titles = sessions.select(F.col("session_ref").alias("_titled"), "title", "canonical_title")
    return rows.join(titles, "_titled", "left").drop("_titled")


def merge_related(rows: DataFrame) -> DataFrame:
    """One row per id: earliest and latest time, distinct fragments, first known attributes, last known status.

    Details merge member by member, the latest fragment winning, so no list of all details of an id is built.
    """
    order = F.struct("time_key", "fragment_id")
    keep_first = ["parent_tool_ref", "child_agent_key", "automation_job_ref", "automation_run_key"]
    same = [
        c
        for c in rows.columns
        if c not in ("id", "time_key", "fragment_id", "relation", "status", *keep_first)
    ]
    merged = rows.groupBy("id").agg(
        *[F.min_by(c, order).alias(c) for c in same],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep_first],
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"),
        F.min("time_key").alias("created_at"),
        F.max("time_key").alias("updated_at"),
        F.countDistinct("fragment_id").alias("fragment_count"),
    )
    entries = F.from_json("relation", "map<string,string>")
    members = rows.select("id", order.alias("at"), F.explode(entries).alias("member", "value"))
    latest = members.groupBy("id", "member").agg(F.max_by("value", "at").alias("value"))
    detail = latest.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("member", "value")))).alias("raw_detail"))
    return merged.join(detail, "id", "left")
