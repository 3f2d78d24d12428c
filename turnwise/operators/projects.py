"""Linking of sessions and turns to projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import paths, timekeys
from turnwise.functions.bind import bind
from turnwise.functions.ids import composite_key, stable_id
from turnwise.functions.ordered import last_value, next_value, with_running_ranged
from turnwise.functions.text import optional
from turnwise.operators.atoms import SESSION
from turnwise.session import discard, materialize

# Reasons in order of preference.
REASONS = (
    "repo_fingerprint_match",
    "repo_remote_match",
    "repo_root_match",
    "source_native_project",
    "workspace_path_continuity",
    "weak_path_hint",
    "metadata_hint",
    "manual_override",
)
OBSERVATION = {
    "observation_id": "string",
    "source_id": "string",
    "session_ref": "string",
    "observed_at": "string",
    "confidence": "double",
    "workspace_path": "string",
    "repo_root": "string",
    "repo_remote": "string",
    "repo_fingerprint": "string",
    "source_native_project_ref": "string",
}


# --- observations ----------------------------------------------------------------------------------------------------


def project_observations(atoms: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session and distinct workspace the last workspace signal; sessions without one observe their native reference."""
    signals = atoms.where((F.col("signal_kind") == "workspace_signal") & (F.col("path") != ""))
    keyed = signals.withColumn("_workspace", F.coalesce(paths.path_identity(F.col("path")), F.col("path")))
    last = keyed.groupBy(*SESSION, "_workspace").agg(
        F.max_by(F.struct("path", "repo_root", "repo_remote", "time_key"), "pos").alias("at")
    )
    native = sessions.select(*SESSION, "source_native_project_ref")
    remote = paths.normalize_remote(F.col("at.repo_remote"))
    seen = last.join(native, SESSION, "left").select(
        stable_id("candidate", "project_observation", F.col("source_id"), F.col("session_ref"), F.col("_workspace")).alias("observation_id"),
        *SESSION,
        F.col("at.time_key").alias("observed_at"),
        F.lit(0.5).alias("confidence"),
        F.col("at.path").alias("workspace_path"),
        paths.path_identity(F.col("at.repo_root")).alias("repo_root"),
        remote.alias("repo_remote"),
        paths.remote_fingerprint(remote).alias("repo_fingerprint"),
        "source_native_project_ref",
    )
    first = atoms.groupBy(*SESSION).agg(F.min_by("time_key", "pos").alias("_first_at"))
    silent = sessions.where(F.col("source_native_project_ref").isNotNull()).join(last.select(*SESSION).distinct(), SESSION, "left_anti")
    none = F.lit(None).cast("string")
    by_ref = silent.join(first, SESSION, "left").select(
        stable_id("candidate", "project_observation", F.col("source_id"), F.col("session_ref"), F.col("source_native_project_ref")).alias("observation_id"),
        *SESSION,
        F.coalesce("_first_at", "updated_at", "created_at").alias("observed_at"),
        F.lit(0.35).alias("confidence"),
        none.alias("workspace_path"),
        none.alias("repo_root"),
        none.alias("repo_remote"),
        none.alias("repo_fingerprint"),
        "source_native_project_ref",
    )
    return seen.unionByName(by_ref)


def fallback_observations(
    sessions: DataFrame, turns: DataFrame, observations: DataFrame, lineage: DataFrame, blobs: DataFrame, sources: DataFrame
) -> DataFrame:
    """Observations for sessions with turns but none of their own: their workspace, else the one project folder named by
    all captures behind their turns. ``lineage`` gives (turn_id, ref_kind, ref), ``blobs`` (blob_id, origin_path)."""
    lone = sessions.join(turns.select("session_ref").distinct(), "session_ref", "left_semi").join(
        observations.select("session_ref").distinct(), "session_ref", "left_anti"
    )
    captures = (
        lineage.where(F.col("ref_kind") == "blob")
        .join(turns.select("turn_id", "session_ref"), "turn_id")
        .select("session_ref", F.col("ref").alias("blob_id"))
        .distinct()
        .join(lone.select("session_ref", "source_id", "source_platform"), "session_ref")
        .join(blobs.select("blob_id", "origin_path"), "blob_id")
        .join(sources.select("source_id", "base_dir"), "source_id")
    )
    named = captures.select("session_ref", paths.native_project_ref(F.col("source_platform"), F.col("base_dir"), F.col("origin_path")).alias("_ref"))
    single = (
        named.where(F.col("_ref").isNotNull())
        .groupBy("session_ref")
        .agg(F.min("_ref").alias("_ref"), F.max("_ref").alias("_other"))
        .where(F.col("_ref") == F.col("_other"))
        .select("session_ref", "_ref")
    )
    workspace = paths.path_identity(F.col("working_directory"))
    native = F.coalesce("source_native_project_ref", "_ref")
    none = F.lit(None).cast("string")
    found = lone.join(single, "session_ref", "left").withColumns({"_workspace": workspace, "_native": native})
    return found.where(F.coalesce("_workspace", "_native").isNotNull()).select(
        composite_key("candidate", F.lit("project_observation_fallback"), F.col("source_id"), F.col("session_ref"), F.coalesce("_workspace", "_native")).alias(
            "observation_id"
        ),
        *SESSION,
        F.coalesce("updated_at", "created_at").alias("observed_at"),
        F.when(F.col("_workspace").isNotNull(), 0.5).otherwise(0.35).alias("confidence"),
        F.col("working_directory").alias("workspace_path"),
        none.alias("repo_root"),
        none.alias("repo_remote"),
        none.alias("repo_fingerprint"),
        F.col("_native").alias("source_native_project_ref"),
    )


def hydrate_observations(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """Observations of known sessions with normalised paths and the workspace relative to its repository."""
    context = sessions.select("session_ref", "host_id", "source_platform", F.col("working_directory").alias("_directory"))
    joined = observations.join(context, "session_ref")
    workspace = F.coalesce(optional(F.col("workspace_path")), F.col("_directory"))
    spelled = joined.select(
        *[c for c in OBSERVATION if c not in ("workspace_path", "repo_root", "repo_remote", "repo_fingerprint", "source_native_project_ref")],
        workspace.alias("workspace_path"),
        paths.path_identity(workspace).alias("workspace_path_normalized"),
        paths.path_identity(optional(F.col("repo_root"))).alias("repo_root"),
        *[optional(F.col(c)).alias(c) for c in ("repo_remote", "repo_fingerprint", "source_native_project_ref")],
        "host_id",
        "source_platform",
    )
    path, root = F.col("workspace_path_normalized"), F.col("repo_root")
    inside = path.startswith(F.concat(root, F.lit("/")))
    below = path.substr(F.length(root) + 2, F.length(path))
    return spelled.withColumn("workspace_subpath", F.when(path == root, ".").when(inside, F.coalesce(F.nullif(below, F.lit("")), F.lit("."))))


# --- rules and components --------------------------------------------------------------------------------------------


def is_weak_path(path: Column) -> Column:
    """Scratch directories say little about a project."""
    # The folders that count as scratch.
    low = F.lower(path)
    last = F.coalesce(paths.basename(low), F.lit(""))
    return (
        low.isin("/root", "/tmp")
        | low.startswith("/tmp/")
        | low.contains("/.config/aionui/aionui/claude-temp-")
        | low.contains("/.config/aionui/aionui/codex-temp-")
        | last.isin("tmp", "temp", "scratchpad")
        | last.startswith("claude-temp-")
        | last.startswith("codex-temp-")
    )


def classify(observations: DataFrame) -> DataFrame:
    """Add ``linkage_scope`` and ``rules`` (at most three structs: reason, priority, confidence, key).

    Committed rules need repository evidence and a workspace; only observations without one get candidate rules.
    """
    workspace = F.coalesce("workspace_subpath", "workspace_path_normalized")
    host = F.concat(F.lit("host:"), F.col("host_id"))
    weak = is_weak_path(F.col("workspace_path_normalized"))

    def rule(reason, confidence, key: Column) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        priority = F.array_position(F.array(*[F.lit(r) for r in REASONS]), reason).cast("int")
        made = F.struct(reason.alias("reason"), priority.alias("priority"), F.lit(confidence).cast("double").alias("confidence") if isinstance(confidence, float) else confidence.cast("double").alias("confidence"), key.alias("key"))
        return F.when(key.isNotNull(), made)

    committed = F.array_compact(
        F.array(
            rule("repo_fingerprint_match", 0.95, F.concat(F.lit("fingerprint:"), F.col("repo_fingerprint"), F.lit("|workspace:"), workspace)),
            rule("repo_remote_match", 0.85, F.concat(host, F.lit("|remote:"), F.col("repo_remote"), F.lit("|workspace:"), workspace)),
            rule("repo_root_match", 0.82, F.concat(host, F.lit("|repo_root:"), F.col("repo_root"), F.lit("|workspace:"), workspace)),
        )
    )
    candidate = F.array_compact(
        F.array(
            rule("source_native_project", 0.7, F.concat(host, F.lit("|native:"), F.col("source_native_project_ref"))),
            rule(
                F.when(weak, "weak_path_hint").otherwise("workspace_path_continuity"),
                F.when(weak, 0.42).otherwise(0.55),
                F.concat(host, F.lit("|workspace:"), F.col("workspace_path_normalized")),
            ),
            rule("metadata_hint", 0.6, F.concat(host, F.lit("|remote_hint:"), F.col("repo_remote"))),
        )
    )
    both = observations.withColumns({"_committed": committed, "_candidate": candidate})
    has_committed = F.size("_committed") > 0
    return both.withColumns(
        {
            "rules": F.when(has_committed, F.col("_committed")).otherwise(F.col("_candidate")),
            "linkage_scope": F.when(has_committed, "committed").when(F.size("_candidate") > 0, "candidate"),
        }
    ).drop("_committed", "_candidate")


def link_rules(observations: DataFrame) -> DataFrame:
    """One row per observation and rule that applies to it."""
    return classify(observations).select("observation_id", "linkage_scope", F.inline("rules"))


def connected_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node reachable from every node: (node, label).

    Each round passes labels over the edges and then follows label pointers, which shortens long chains by half. Minima
    are combined on the map side, the join side that can be hot (the edges of a hub) is the one the skew-join rule splits,
    and every round is written to the shared folder. The loop ends when no label moved; there is no round limit.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "link-edges"
    )
    labels = replaced = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        offered = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("offer"))
        lowered = labels.join(offered, labels["node"] == offered["b"], "left").select(
            "node", "label", F.least("label", "offer").alias("next")
        )
        lowered = materialize(lowered, "labels")
        target = lowered.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        jumped = lowered.join(target, "next").select("node", F.col("jump").alias("label"), (F.col("label") != F.col("jump")).alias("moved"))
        jumped = materialize(jumped, "labels")
        # A round is replaced as a whole: what it read is deleted once the next labels are written.
        discard(replaced, lowered)
        labels, replaced = jumped.select("node", "label"), jumped
        if jumped.where("moved").limit(1).count() == 0:
            discard(both)
            return labels


def link_components(classified: DataFrame) -> DataFrame:
    """Observations that share a key, directly or through others: (observation_id, linkage_scope, component, rules ...).

    Components are found on keys, not observations: equal key sets collapse to one row first, so a key that a third of
    all observations share costs one edge.
    """
    scoped = classified.where(F.col("linkage_scope").isNotNull())
    keys = F.transform("rules", lambda r: F.concat(F.col("linkage_scope"), F.lit("|"), r.key))
    with_keys = materialize(scoped.withColumn("_keys", keys), "link-keys")
    sets = materialize(with_keys.select("_keys").distinct(), "key-sets")
    nodes = sets.select(F.explode("_keys").alias("node")).distinct()
    pairs = sets.where(F.size("_keys") > 1).select(F.col("_keys")[0].alias("a"), F.explode(F.slice("_keys", F.lit(2), F.size("_keys"))).alias("b"))
    labels = connected_labels(pairs.distinct(), nodes)
    joined = with_keys.withColumn("node", F.get("_keys", F.lit(0))).join(labels, "node")
    return joined.withColumnRenamed("label", "component").drop("node", "_keys")


def primary_rule(components: DataFrame) -> DataFrame:
    """The rule that names a component: rules shared by several observations first, then reason, confidence, key."""
    rules = components.select("component", "linkage_scope", "observation_id", F.inline("rules"))
    per_key = rules.groupBy("component", "linkage_scope", "key", "reason", "priority", "confidence").agg(F.count("*").alias("shared_by"))
    rank = F.struct(
        (F.col("shared_by") <= 1).cast("int").alias("single"),
        F.col("priority"),
        (-F.col("confidence")).alias("confidence"),
        F.col("key"),
        F.col("reason"),
    )
    best = per_key.groupBy("component", "linkage_scope").agg(F.min(rank).alias("best"))
    return best.select(
        "component",
        "linkage_scope",
        F.col("best.reason").alias("reason"),
        (-F.col("best.confidence")).alias("rule_confidence"),
        F.col("best.key").alias("key"),
        F.concat(F.lit("project-"), F.substring(F.sha1(F.col("best.key")), 1, 12)).alias("project_id"),
    )


def _clamped(base: float, ceiling: float, *steps: tuple[Column, float]) -> Column:
    score = F.lit(base)
    for condition, gain in steps:
        score = score + F.when(condition, gain).otherwise(0.0)
    return F.round(F.least(F.lit(ceiling), F.greatest(F.lit(base), score)), 2)


def project_confidence(components: DataFrame, primary: DataFrame) -> DataFrame:
    """Linkage state and confidence per component; a workspace seen in two or more sessions becomes committed."""
    metrics = components.groupBy("component").agg(
        F.countDistinct("session_ref").alias("sessions"),
        F.countDistinct("source_platform").alias("platforms"),
        F.bool_or(F.col("repo_root").isNotNull()).alias("has_root"),
    )
    two, three = F.col("sessions") >= 2, F.col("sessions") >= 3
    mixed, rooted = F.col("platforms") >= 2, F.col("has_root")
    # Base score, ceiling and steps of each reason.
    continuity = _clamped(0.68, 0.88, (two, 0.12), (three, 0.05), (mixed, 0.03), (rooted, 0.03))
    score = (
        F.when(F.col("linkage_scope") == "committed", F.round("rule_confidence", 2))
        .when(F.col("reason") == "workspace_path_continuity", continuity)
        .when(F.col("reason") == "source_native_project", _clamped(0.72, 0.87, (two, 0.08), (three, 0.04), (mixed, 0.03)))
        .when(F.col("reason") == "metadata_hint", _clamped(0.6, 0.78, (two, 0.08), (mixed, 0.04)))
        .when(F.col("reason") == "weak_path_hint", _clamped(0.42, 0.6, (two, 0.08), (three, 0.04), (mixed, 0.03)))
        .otherwise(F.round("rule_confidence", 2))
    )
    promoted = (F.col("reason") == "workspace_path_continuity") & two
    return primary.join(metrics, "component").select(
        "component",
        "project_id",
        "reason",
        F.when((F.col("linkage_scope") == "committed") | promoted, "committed").otherwise("candidate").alias("linkage_state"),
        score.alias("confidence"),
        F.col("sessions").alias("observed_sessions"),
        F.col("platforms").alias("observed_platforms"),
    )


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _slug(name: Column, project_id: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(slugify(name), F.lit("")), F.lit("project")), F.lit("-"), F.substring(project_id, -6, 6))


MOST_COMMON = ("workspace_path_normalized", "repo_root", "repo_remote", "repo_fingerprint", "source_native_project_ref", "workspace_subpath")


def project_identity(components: DataFrame, confidence: DataFrame) -> DataFrame:
    """Projects with their most common attributes (first seen wins a tie), names and time bounds."""
    linked = components.select("component", "observation_id", "observed_at", "source_platform", "host_id", *MOST_COMMON)
    votes = linked.select(
        "component",
        F.struct("observed_at", "observation_id").alias("at"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value")) for c in MOST_COMMON])),
    ).where(F.coalesce("value", F.lit("")) != "")
    counted = votes.groupBy("component", "attribute", "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    winners = counted.groupBy("component", "attribute").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "value")).alias("best"))
    wide = winners.groupBy("component").agg(
        *[F.max(F.when(F.col("attribute") == c, F.col("best.value"))).alias(f"common_{c}") for c in MOST_COMMON]
    )
    bounds = linked.groupBy("component").agg(F.min("observed_at").alias("created_at"), F.max("observed_at").alias("updated_at"))

    def names(column: str, alias: str) -> DataFrame:
        distinct = linked.where(F.col(column).isNotNull()).select("component", column).distinct()
        return distinct.groupBy("component").agg(F.sort_array(F.collect_list(column)).alias(alias))

    joined = (
        confidence.join(bounds, "component")
        .join(wide, "component", "left")
        .join(names("source_platform", "source_platforms"), "component", "left")
        .join(names("host_id", "host_ids"), "component", "left")
    )
    remote, root = F.col("common_repo_remote"), F.col("common_repo_root")
    repo = F.coalesce(paths.decode_percent(paths.basename(remote)), F.when(remote.isNull(), paths.decode_percent(F.coalesce(paths.basename(root), root))))
    workspace, sub = F.col("common_workspace_path_normalized"), F.col("common_workspace_subpath")
    name = (
        F.when(repo.isNotNull() & sub.isNotNull() & (sub != "."), F.concat(repo, F.lit("/"), sub))
        .when(workspace.isNotNull(), F.coalesce(paths.basename(workspace), workspace))
        .otherwise(F.coalesce(repo, F.col("common_source_native_project_ref"), F.lit("project")))
    )
    return joined.withColumn("display_name", name).select(
        "project_id",
        "component",
        "display_name",
        _slug(F.col("display_name"), F.col("project_id")).alias("slug"),
        "linkage_state",
        "confidence",
        F.col("reason").alias("link_reason"),
        F.lit("none").alias("manual_override_status"),
        workspace.alias("primary_workspace_path"),
        F.col("common_source_native_project_ref").alias("source_native_project_ref"),
        root.alias("repo_root"),
        remote.alias("repo_remote"),
        F.col("common_repo_fingerprint").alias("repo_fingerprint"),
        F.coalesce("source_platforms", F.array().cast("array<string>")).alias("source_platforms"),
        F.coalesce("host_ids", F.array().cast("array<string>")).alias("host_ids"),
        "created_at",
        "updated_at",
    )


def linked_observations(hydrated: DataFrame, components: DataFrame, confidence: DataFrame) -> DataFrame:
    """Every observation, with project, state and reason where it belongs to a component."""
    placed = components.select("observation_id", "component").join(
        confidence.select("component", "project_id", "linkage_state", F.col("reason").alias("link_reason")), "component"
    )
    return hydrated.join(placed.drop("component"), "observation_id", "left")


# --- turns -----------------------------------------------------------------------------------------------------------


def link_turns(turns: DataFrame, observations: DataFrame, projects: DataFrame) -> DataFrame:
    """Link each turn to the latest linked observation of its session at or before its last activity, else the earliest.

    The as-of lookup is one ordered scan over turns and observations of a session, in ranges bounded by rows; no pairs of
    turns and observations are formed. A turn without activity comes before all observations and gets the earliest.
    """
    seen = observations.where(F.col("project_id").isNotNull()).select(
        "session_ref",
        F.col("observed_at").alias("_at"),
        F.lit(0).alias("_kind"),
        F.col("observation_id").alias("_id"),
        F.col("project_id").alias("_observed"),
    )
    asked = turns.select(
        "session_ref",
        F.col("last_context_activity_at").alias("_at"),
        F.lit(1).alias("_kind"),
        F.col("turn_id").alias("_id"),
        F.lit(None).cast("string").alias("_observed"),
    )
    found = with_running_ranged(
        seen.unionByName(asked),
        ["session_ref"],
        ["_at", "_kind", "_id"],
        _before=last_value(F.col("_observed")),
        _after=next_value(F.col("_observed")),
    ).where(F.col("_kind") == 1)
    chosen = found.select(F.col("_id").alias("turn_id"), F.coalesce("_before", "_after").alias("project_id"))
    options = seen.select("session_ref", F.col("_observed").alias("p")).distinct().groupBy("session_ref").agg(
        F.sort_array(F.collect_list("p")).alias("_options")
    )
    known = projects.select("project_id", F.col("slug").alias("project_ref"), "linkage_state", F.col("confidence").alias("project_confidence"))
    base = turns.drop("project_id", "project_ref", "link_state", "project_confidence", "candidate_project_ids")
    joined = base.join(chosen.join(known, "project_id"), "turn_id", "left").join(options, "session_ref", "left")
    return joined.withColumns(
        {
            "link_state": F.coalesce("linkage_state", F.lit("unlinked")),
            "candidate_project_ids": F.when(F.col("linkage_state") == "candidate", F.col("_options")),
        }
    ).drop("linkage_state", "_options")


def override_observations(observations: DataFrame, overrides: DataFrame) -> DataFrame:
    """Observations named by an override, or of a session named by one, are committed to its project."""
    by_kind = lambda kind, key, alias: overrides.where(F.col("target_kind") == kind).select(
        F.col("target_ref").alias(key), F.col("project_id").alias(alias)
    )
    joined = observations.join(by_kind("observation", "observation_id", "_own"), "observation_id", "left").join(
        by_kind("session", "session_ref", "_session"), "session_ref", "left"
    )
    forced = F.coalesce("_own", "_session")
    return joined.withColumns(
        {
            "linkage_state": F.when(forced.isNotNull(), "committed").otherwise(F.col("linkage_state")),
            "link_reason": F.when(forced.isNotNull(), "manual_override").otherwise(F.col("link_reason")),
            "project_id": F.coalesce(forced, "project_id"),
        }
    ).drop("_own", "_session")


def override_projects(projects: DataFrame, overrides: DataFrame) -> DataFrame:
    """Projects plus the ones only overrides name; every overridden project counts as committed by hand."""
    named = overrides.groupBy("project_id").agg(F.min_by(F.struct("display_name", "created_at", "updated_at"), "created_at").alias("o"))
    joined = projects.join(named.withColumn("_named", F.lit(True)), "project_id", "left").drop("o")
    forced = F.coalesce("_named", F.lit(False))
    kept = joined.withColumns(
        {
            "linkage_state": F.when(forced, "committed").otherwise(F.col("linkage_state")),
            "link_reason": F.when(forced, "manual_override").otherwise(F.col("link_reason")),
            "manual_override_status": F.when(forced, "applied").otherwise(F.col("manual_override_status")),
        }
    ).drop("_named")
    added = named.join(projects.select("project_id"), "project_id", "left_anti").select(
        "project_id",
        F.col("o.display_name").alias("display_name"),
        _slug(F.col("o.display_name"), F.col("project_id")).alias("slug"),
        F.lit("committed").alias("linkage_state"),
        F.lit(1.0).alias("confidence"),
        F.lit("manual_override").alias("link_reason"),
        F.lit("applied").alias("manual_override_status"),
        F.array().cast("array<string>").alias("source_platforms"),
        F.array().cast("array<string>").alias("host_ids"),
        F.col("o.created_at").alias("created_at"),
        F.col("o.updated_at").alias("updated_at"),
    )
    return kept.unionByName(added, allowMissingColumns=True)


def override_turns(turns: DataFrame, overrides: DataFrame, projects: DataFrame) -> DataFrame:
    """Turns named by an override, or of a session named by one, are committed with confidence one."""
    of_turn = overrides.where(F.col("target_kind") == "turn").select(F.col("target_ref").alias("turn_id"), F.col("project_id").alias("_own"))
    of_session = overrides.where(F.col("target_kind") == "session").select(F.col("target_ref").alias("session_ref"), F.col("project_id").alias("_session"))
    slugs = projects.select(F.col("project_id").alias("_forced"), F.col("slug").alias("_slug"))
    joined = (
        turns.join(of_turn, "turn_id", "left")
        .join(of_session, "session_ref", "left")
        .withColumn("_forced", F.coalesce("_own", "_session"))
        .join(slugs, "_forced", "left")
    )
    forced = F.col("_forced").isNotNull()
    return joined.withColumns(
        {
            "project_id": F.coalesce("_forced", "project_id"),
            "project_ref": F.when(forced, F.col("_slug")).otherwise(F.col("project_ref")),
            "link_state": F.when(forced, "committed").otherwise(F.col("link_state")),
            "project_confidence": F.when(forced, 1.0).otherwise(F.col("project_confidence")),
            "candidate_project_ids": F.when(forced, F.array("_forced")).otherwise(F.col("candidate_project_ids")),
        }
    ).drop("_own", "_session", "_forced", "_slug")


def project_counts(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count_if(F.col("link_state") == "committed").alias("committed_turn_count"),
        F.count_if(F.col("link_state") == "candidate").alias("candidate_turn_count"),
        F.countDistinct("session_ref").alias("session_count"),
        F.max("last_context_activity_at").alias("last_activity_at"),
    )


def projects_with_counts(projects: DataFrame, turns: DataFrame) -> DataFrame:
    joined = projects.join(project_counts(turns), "project_id", "left")
    activity = F.greatest("updated_at", "last_activity_at")
    zero = ["committed_turn_count", "candidate_turn_count", "session_count"]
    return joined.withColumns({"project_last_activity_at": activity, "updated_at": activity}).drop("last_activity_at").na.fill(0, zero)


def session_primary_project(turns: DataFrame) -> DataFrame:
    """Per session the project of its newest committed turn, else of its newest linked turn."""
    rank = F.struct(
        (F.col("link_state") != "committed").cast("int").alias("loose"),
        (-timekeys.millis(F.col("last_context_activity_at"))).alias("age"),
        F.col("turn_id").alias("turn_id"),
    )
    return turns.where(F.col("project_id").isNotNull()).groupBy("session_ref").agg(F.min_by("project_id", rank).alias("primary_project_id"))


def linking_review(projects: DataFrame, turns: DataFrame) -> dict[str, DataFrame]:
    """What a reviewer goes through: committed and candidate projects, unlinked and candidate turns."""
    recency = F.desc_nulls_last("project_last_activity_at")
    return {
        "committed_projects": projects.where(F.col("linkage_state") == "committed").orderBy(recency),
        "candidate_projects": projects.where(F.col("linkage_state") == "candidate").orderBy(F.desc("confidence"), recency),
        "unlinked_turns": turns.where(F.col("link_state") == "unlinked").orderBy(F.desc("submission_started_at")),
        "candidate_turns": turns.where(F.col("link_state") == "candidate").orderBy(
            F.coalesce("project_confidence", F.lit(0.0)).desc(), F.desc("submission_started_at")
        ),
    }


def linked_path_text(turns: DataFrame, sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """Paths of a turn, its session and its project with their last segments, distinct, in that order."""
    of_session = ["working_directory", "source_native_project_ref", "resume_working_directory"]
    of_session = [c for c in of_session if c in sessions.columns]
    of_project = [c for c in ("primary_workspace_path", "repo_root", "source_native_project_ref") if c in projects.columns]
    joined = turns.join(sessions.select("session_ref", *[F.col(c).alias(f"_s{c}") for c in of_session]), "session_ref", "left").join(
        projects.select("project_id", *[F.col(c).alias(f"_p{c}") for c in of_project]), "project_id", "left"
    )
    values = ["path_text", *[f"_s{c}" for c in of_session], *[f"_p{c}" for c in of_project]]
    listed = F.flatten(F.array(*[F.array_compact(F.array(F.nullif(F.col(v), F.lit("")), paths.basename(F.col(v)))) for v in values]))
    text = bind(listed, lambda parts: F.nullif(F.trim(F.array_join(F.array_distinct(parts), " ")), F.lit("")))
    return joined.withColumn("path_text", text).select(*turns.columns)


def link_snapshot(sessions: DataFrame, turns: DataFrame, observations: DataFrame, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """Projects, linked turns, sessions with their primary project and linked observations in one go."""
    hydrated = materialize(hydrate_observations(observations, sessions), "observations")
    components = materialize(link_components(classify(hydrated)), "components")
    confidence = materialize(project_confidence(components, primary_rule(components)), "projects")
    projects = project_identity(components, confidence).drop("component")
    linked = linked_observations(hydrated, components, confidence)
    if overrides is not None:
        linked = override_observations(linked, overrides)
        projects = override_projects(projects, overrides)
    projects = materialize(projects, "projects")
    linked_turns = link_turns(turns, linked, projects)
    if overrides is not None:
        linked_turns = override_turns(linked_turns, overrides, projects)
    linked_turns = materialize(linked_turns, "linked-turns")
    return {
        "projects": projects_with_counts(projects, linked_turns),
        "turns": linked_path_text(linked_turns, sessions, projects),
        "sessions": sessions.drop("primary_project_id").join(session_primary_project(linked_turns), "session_ref", "left"),
        "observations": linked,
    }
