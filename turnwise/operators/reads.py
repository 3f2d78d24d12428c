"""List, latest, tree, show and reference reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import paths, timekeys
from turnwise.functions.ordered import last_value, next_value, ranged, running_sum, with_running_ranged
from turnwise.functions.text import optional
from turnwise.operators.usage import model_summary, session_usage
from turnwise.session import materialize

# The key of the bucket for turns without a project, and the platform with ids of its own.
UNLINKED_KEY = "__unlinked__"
CODEX = "codex"


# --- lists -----------------------------------------------------------------------------------------------------------


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("source_id")


def source_health(sources: DataFrame) -> DataFrame:
    status = F.when(F.col("sync_status").isin("healthy", "stale"), F.col("sync_status")).otherwise("error")
    return sources.groupBy(status.alias("health")).agg(F.count("*").alias("sources"))


def project_order() -> list[Column]:
    turns = F.col("committed_turn_count") + F.col("candidate_turn_count")
    activity = F.coalesce("project_last_activity_at", "updated_at")
    return [turns.desc(), F.desc("session_count"), activity.desc(), F.asc("display_name"), F.asc("project_id")]


def list_projects(projects: DataFrame, limit: int | None = None) -> DataFrame:
    """Projects with turns, the busiest first."""
    listed = projects.where(F.col("committed_turn_count") + F.col("candidate_turn_count") > 0).orderBy(*project_order())
    return listed if limit is None else listed.limit(limit)


def with_last_message(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    last = turns.groupBy("session_ref").agg(F.max("last_context_activity_at").alias("last_message_at"))
    return sessions.join(last, "session_ref", "left")


def session_order() -> list[Column]:
    """Sessions with messages by their last one; sessions without follow, by their own times."""
    silent = F.col("last_message_at").isNull()
    return [
        silent.asc(),
        F.coalesce("last_message_at", "updated_at").desc(),
        F.desc("created_at"),
        F.asc("session_ref"),
    ]


def order_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    return with_last_message(sessions, turns).orderBy(*session_order())


def session_places(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with ``place``, their number from 1 in the order of ``order_sessions``, without sorting in one task."""
    last = F.lit(1 << 62)
    keyed = with_last_message(sessions, turns).withColumns(
        {
            "_k0": F.col("last_message_at").isNull(),
            "_k1": F.coalesce(-timekeys.millis(F.coalesce("last_message_at", "updated_at")), last),
            "_k2": F.coalesce(-timekeys.millis(F.col("created_at")), last),
        }
    )
    placed = with_running_ranged(keyed, [], ["_k0", "_k1", "_k2", "session_ref"], place=running_sum(F.lit(1)))
    return placed.drop("_k0", "_k1", "_k2")


def top_level_sessions(sessions: DataFrame, related: DataFrame) -> DataFrame:
    """Sessions that are not the resolved child of a delegation (one platform shows its children elsewhere)."""
    children = related.where(
        (F.col("source_platform") == CODEX)
        & (F.col("relation_kind") == "delegated_session")
        & (F.col("direction") == "inbound")
        & (F.col("child_session_ref") == F.col("query_session_ref"))
    ).select(F.col("query_session_ref").alias("session_ref"))
    return sessions.join(children, "session_ref", "left_anti")


def latest_sessions(sessions: DataFrame, turns: DataFrame, related: DataFrame, limit: int = 20) -> DataFrame:
    """Newest top-level sessions with turns. The page is cut first; models and tokens are summed for its sessions only."""
    kept = top_level_sessions(sessions, related).where(F.col("turn_count") > 0)
    page = with_last_message(kept, turns).orderBy(*session_order()).limit(limit)
    of_page = turns.join(page.select("session_ref"), "session_ref", "left_semi")
    return page.join(model_summary(page, of_page), "session_ref", "left").join(session_usage(of_page), "session_ref", "left")


def turn_recency() -> list[Column]:
    return [F.desc("submission_started_at"), F.desc("created_at"), F.asc("turn_id")]


def turn_chronology() -> list[Column]:
    return [F.asc("submission_started_at"), F.asc("created_at"), F.asc("turn_id")]


def latest_turns(turns: DataFrame, limit: int = 20) -> DataFrame:
    return turns.orderBy(*turn_recency()).limit(limit)


def session_turns(turns: DataFrame, session_ref: str) -> DataFrame:
    return turns.where(F.col("session_ref") == session_ref).orderBy(*turn_chronology())


def project_turns(turns: DataFrame, project_id: str) -> DataFrame:
    return turns.where(F.col("project_id") == project_id).orderBy(*turn_recency())


# --- directory scope -------------------------------------------------------------------------------------------------


def scope_sessions(sessions: DataFrame, scope: str | None, fold_case: bool = False) -> DataFrame:
    if not scope:
        return sessions
    return sessions.where(paths.scope_match(F.col("working_directory"), scope, fold_case))


def scope_turns(turns: DataFrame, sessions: DataFrame, scope: str | None, fold_case: bool = False) -> DataFrame:
    if not scope:
        return turns
    return turns.join(scope_sessions(sessions, scope, fold_case).select("session_ref"), "session_ref", "left_semi")


def scope_projects(projects: DataFrame, sessions: DataFrame, turns: DataFrame, scope: str | None, fold_case: bool = False) -> DataFrame:
    """Projects whose own paths, or any of whose sessions, lie in the directory."""
    if not scope:
        return projects
    inside = scope_sessions(sessions, scope, fold_case).select("session_ref", "primary_project_id")
    by_turn = turns.where(F.col("project_id").isNotNull()).select("session_ref", "project_id").join(inside, "session_ref", "left_semi")
    by_session = inside.where(F.col("primary_project_id").isNotNull()).select(F.col("primary_project_id").alias("project_id"))
    reached = by_turn.select("project_id").unionByName(by_session).distinct().withColumn("_reached", F.lit(True))
    own = paths.scope_match(F.col("primary_workspace_path"), scope, fold_case) | paths.scope_match(F.col("repo_root"), scope, fold_case)
    return projects.join(reached, "project_id", "left").where(own | F.coalesce("_reached", F.lit(False))).drop("_reached")


# --- trees -----------------------------------------------------------------------------------------------------------


def project_sessions(projects: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct (project, session) edges: by a turn of the session, or as the session's primary project."""
    by_turn = turns.where(F.col("project_id").isNotNull()).select("project_id", "session_ref").distinct()
    by_turn = by_turn.join(sessions.select("session_ref"), "session_ref", "left_semi")
    by_session = sessions.where(F.col("primary_project_id").isNotNull()).select(F.col("primary_project_id").alias("project_id"), "session_ref")
    edges = by_turn.select("project_id", "session_ref").unionByName(by_session).distinct()
    return edges.join(projects.select("project_id"), "project_id", "left_semi")


def project_tree(projects: DataFrame, sessions: DataFrame, turns: DataFrame, related: DataFrame, scope: str | None = None) -> DataFrame:
    """Project, session, turn edges; sessions of no project appear with a null project, childless nodes with nulls below.

    Stays flat: a project's subtree is a set of rows, never one nested value. With a scope, projects without a session
    inside it are left out.
    """
    scoped = scope_sessions(top_level_sessions(sessions, related), scope)
    edges = project_sessions(projects, scoped, turns)
    of_project = edges.join(turns.select("project_id", "session_ref", "turn_id"), ["project_id", "session_ref"], "left")
    free = scoped.join(edges.select("session_ref").distinct(), "session_ref", "left_anti").select("session_ref")
    unlinked = free.join(turns.select("session_ref", "turn_id"), "session_ref", "left").select(
        F.lit(None).cast("string").alias("project_id"), "session_ref", "turn_id"
    )
    tree = of_project.select("project_id", "session_ref", "turn_id").unionByName(unlinked)
    if scope:
        return tree
    empty = projects.select("project_id").join(edges.select("project_id").distinct(), "project_id", "left_anti")
    none = F.lit(None).cast("string")
    return tree.unionByName(empty.select("project_id", none.alias("session_ref"), none.alias("turn_id")))


def project_entries(projects: DataFrame, turns: DataFrame) -> DataFrame:
    """Projects with counts over their turns, and one pseudo project for turns of no listed project."""
    counts = [
        F.count("*").alias("turn_count"),
        F.countDistinct("session_ref").alias("session_count"),
    ]
    per_project = turns.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(*counts)
    listed = projects.join(per_project, "project_id", "left").select(
        F.col("project_id").alias("key"),
        "display_name",
        "linkage_state",
        F.coalesce("primary_workspace_path", "repo_root").alias("workspace_path"),
        F.coalesce(per_project["session_count"], F.lit(0)).alias("session_count"),
        F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        F.coalesce("project_last_activity_at", "updated_at").alias("last_activity_at"),
    )
    # Listed newest first, so the last one is the oldest turn.
    oldest = F.max_by(
        "last_context_activity_at",
        F.struct(-timekeys.millis(F.col("submission_started_at")), -timekeys.millis(F.col("created_at")), F.col("turn_id")),
    )
    loose = turns.join(projects.select("project_id"), "project_id", "left_anti")
    bucket = loose.agg(*counts, oldest.alias("last_activity_at")).where(F.col("turn_count") > 0)
    return listed.unionByName(
        bucket.select(
            F.lit(UNLINKED_KEY).alias("key"),
            F.lit("Unlinked / candidate-only").alias("display_name"),
            F.lit("unlinked").alias("linkage_state"),
            F.lit(None).cast("string").alias("workspace_path"),
            "session_count",
            "turn_count",
            "last_activity_at",
        )
    )


# --- show ------------------------------------------------------------------------------------------------------------


def show_session(sessions: DataFrame, turns: DataFrame, session_ref: str) -> DataFrame:
    """The session's row with each of its turns, in order."""
    session = sessions.where(F.col("session_ref") == session_ref).select("session_ref", "title", "source_platform", "working_directory", "updated_at")
    own = turns.where(F.col("session_ref") == session_ref).select("session_ref", "turn_id", "submission_started_at", "created_at", "project_id")
    return session.join(own, "session_ref", "left").orderBy(*turn_chronology())


def show_turn(turns: DataFrame, sessions: DataFrame, projects: DataFrame, turn_id: str, context: dict[str, DataFrame] | None = None) -> DataFrame:
    """The turn with its session and project, and with its context where the tables of it are given.

    ``context`` may hold ``replies``, ``system_messages`` and ``tool_calls``, each with turn_id and pos; they come as one
    array each, in order. Only the rows of the one turn are gathered.
    """
    session = sessions.select("session_ref", F.col("title").alias("session_title"), "source_platform")
    project = projects.select("project_id", F.col("display_name").alias("project_name"), "linkage_state")
    shown = turns.where(F.col("turn_id") == turn_id).join(session, "session_ref", "left").join(project, "project_id", "left")
    for name, rows in (context or {}).items():
        own = rows.where(F.col("turn_id") == turn_id)
        members = [c for c in own.columns if c not in ("turn_id", "pos")]
        listed = own.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("pos", *members))).alias(name))
        shown = shown.join(listed, "turn_id", "left")
    return shown


def show_project(projects: DataFrame, turns: DataFrame, project_id: str) -> DataFrame:
    project = projects.where(F.col("project_id") == project_id).select("project_id", "display_name", "linkage_state")
    own = turns.where(F.col("project_id") == project_id).select("project_id", "turn_id", "session_ref", "submission_started_at", "created_at")
    return project.join(own, "project_id", "left").orderBy(*turn_recency())


def show_source(sources: DataFrame, sessions: DataFrame, audits: DataFrame, source_id: str) -> DataFrame:
    """The source's status with its number of sessions and of audits by severity above info."""
    counted = sessions.where(F.col("source_id") == source_id).groupBy("source_id").agg(F.count("*").alias("sessions"))
    found = audits.where(F.col("source_id") == source_id).groupBy("source_id").agg(F.count_if(F.col("severity") != "info").alias("problems"))
    return (
        sources.where(F.col("source_id") == source_id)
        .select("source_id", "slot_id", "display_name", "sync_status")
        .join(counted, "source_id", "left")
        .join(found, "source_id", "left")
        .na.fill(0, ["sessions", "problems"])
    )


# --- references ------------------------------------------------------------------------------------------------------


def lookup_key(value: Column) -> Column:
    """Spelling under which references and aliases are compared."""
    return F.lower(F.coalesce(paths.path_identity(value), F.trim(value), F.lit("")))


def resolve_refs(refs: DataFrame, entities: DataFrame, aliases: list[str], prefix_aliases: list[str] = ()) -> DataFrame:
    """Resolve short references against entities ``(id, alias columns)``.

    An exact id wins; else a unique alias; else a unique id prefix or prefix-alias. Several hits are ``ambiguous``, none
    ``not_found``, a blank reference never matches. Everything is joined by equality, and on spellings that are counted
    first: one row per alias, and one per prefix, cut to the lengths that occur among the references still open. So rows
    grow with entities times those lengths, and never with references times entities.
    """
    asked = refs.select("ref").distinct().select("ref", lookup_key(F.col("ref")).alias("key")).where(F.col("key") != "")

    def counted(hits: DataFrame, *by: str) -> DataFrame:
        """(spelling, id) rows to the number of ids and the smallest of each spelling."""
        return hits.distinct().groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))

    own = entities.select("id").distinct().select(F.col("id").alias("ref"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("first_id"))
    exact = asked.join(own, "ref").select("ref", "n", "first_id")
    rest = asked.join(exact, "ref", "left_anti")
    by_alias = exact.limit(0)
    if aliases:
        named = entities.select("id", F.explode(F.array(*[lookup_key(F.col(a)) for a in aliases])).alias("key")).where(F.col("key") != "")
        by_alias = rest.join(counted(named, "key"), "key").select("ref", "n", "first_id")
        rest = rest.join(by_alias, "ref", "left_anti")

    # An id is compared with a reference as it is written, an alias with its lookup spelling. Ids that fit in both ways
    # are counted by both heads and taken off once.
    rest = materialize(rest, "open-refs")
    lengths = [(r[0], r[1]) for r in rest.select(F.length("ref"), F.length("key")).distinct().collect()]

    def heads(text: Column, sizes: list[int]) -> Column:
        cut = [F.when(F.length(text) >= n, text.substr(F.lit(1), F.lit(n))) for n in sorted(set(sizes))]
        return F.explode(F.array_compact(F.array(*cut)))

    by_prefix = exact.limit(0)
    if lengths:
        by_id = counted(entities.select("id", heads(F.col("id"), [n for n, _ in lengths]).alias("ref")).join(rest.select("ref"), "ref", "left_semi"), "ref")
        by_prefix = by_id
    if lengths and prefix_aliases:
        spelled = entities.select("id", F.explode(F.array(*[lookup_key(F.col(a)) for a in prefix_aliases])).alias("alias")).where(F.col("alias") != "").distinct()
        keys = rest.select("key").distinct()
        other = counted(spelled.select("id", heads(F.col("alias"), [n for _, n in lengths]).alias("key")).join(keys, "key", "left_semi"), "key")
        fits = [F.when((F.length("id") >= i) & (F.length("alias") >= a), F.struct(F.substring("id", 1, i).alias("ref"), F.substring("alias", 1, a).alias("key"))) for i, a in lengths]
        both = spelled.select("id", F.inline(F.array_compact(F.array(*fits)))).join(rest, ["ref", "key"], "left_semi")
        twice = counted(both, "ref", "key").select("ref", F.col("n").alias("twice"))
        sides = rest.join(by_id.select("ref", F.col("n").alias("n_id"), F.col("first_id").alias("one")), "ref", "left")
        sides = sides.join(other.select("key", F.col("n").alias("n_alias"), F.col("first_id").alias("two")), "key", "left").join(twice, "ref", "left")
        total = F.coalesce("n_id", F.lit(0)) + F.coalesce("n_alias", F.lit(0)) - F.coalesce("twice", F.lit(0))
        by_prefix = sides.select("ref", total.alias("n"), F.least("one", "two").alias("first_id")).where("n > 0")
    best = exact.unionByName(by_alias).unionByName(by_prefix)
    joined = refs.select("ref").distinct().join(best, "ref", "left")
    n = F.col("n")
    return joined.select(
        "ref",
        F.when(n == 1, F.col("first_id")).alias("id"),
        F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("not_found").alias("status"),
        F.coalesce(n, F.lit(0)).alias("candidates"),
    )


def common_prefix(left: Column, right: Column) -> Column:
    """Number of leading characters two strings share (0 where one is null)."""
    size = F.when(left.isNotNull() & right.isNotNull(), F.least(F.length(left), F.length(right)))
    first = F.filter(F.sequence(F.lit(1), size), lambda i: left.substr(F.lit(1), i) != right.substr(F.lit(1), i))
    return F.coalesce(F.when(size > 0, F.coalesce(F.get(first, F.lit(0)) - 1, size)), F.lit(0))


def display_refs(ids: DataFrame, minimum: int = 8) -> DataFrame:
    """Shortest prefix of each id, at least ``minimum`` long, that no other id starts with; the whole id if there is none.

    In sorted order only the neighbours matter. The order is scanned in ranges bounded by rows, so ids that begin alike
    do not meet in one task.
    """
    near = with_running_ranged(ids.select("id"), [], ["id"], _before=last_value(F.col("id"), False), _after=next_value(F.col("id"), False))
    shared = F.greatest(common_prefix(F.col("id"), F.col("_before")), common_prefix(F.col("id"), F.col("_after")))
    size = F.greatest(F.lit(minimum), shared + 1)
    return near.select("id", F.col("id").substr(F.lit(1), size).alias("display_ref"))


def session_labels(sessions: DataFrame) -> DataFrame:
    """Session titles, prefixed with the shortest unique native reference where several sessions share one.

    Uniqueness holds within a title; titles and references are scanned in ranges bounded by rows.
    """
    base = F.coalesce(optional(F.col("title")), "source_session_id", "session_ref")
    labelled = sessions.select("session_ref", "source_platform", "source_session_id", base.alias("base")).withColumn("key", F.lower("base"))
    shared = labelled.groupBy("key").agg(F.count("*").alias("_same")).where(F.col("_same") > 1)
    unique = labelled.join(shared, "key", "left_anti").select("session_ref", F.col("base").alias("label"))

    def shortest(df: DataFrame, ref: Column) -> DataFrame:
        # A reference that another one extends has no unique prefix: every prefix of it also starts the other.
        order = df.select("key", "session_ref", ref.alias("ref")).where(F.col("ref").isNotNull())
        near = with_running_ranged(
            order,
            ["key"],
            ["ref", "session_ref"],
            _before=last_value(F.col("ref"), False),
            _after=next_value(F.col("ref"), False),
        )
        common = F.greatest(common_prefix(F.col("ref"), F.col("_before")), common_prefix(F.col("ref"), F.col("_after")))
        size = F.greatest(F.least(F.lit(8), F.length("ref")), common + 1)
        return near.select("session_ref", F.when(size <= F.length("ref"), F.col("ref").substr(F.lit(1), size)).alias("short"))

    crowded = labelled.join(shared.select("key"), "key", "left_semi")
    native = shortest(crowded, optional(F.col("source_session_id"))).withColumnRenamed("short", "native_short")
    canonical = shortest(crowded, F.col("session_ref")).withColumnRenamed("short", "own_short")
    marked = crowded.join(native, "session_ref", "left").join(canonical, "session_ref", "left")
    prefix = F.coalesce("native_short", "own_short", "source_platform")
    return unique.unionByName(marked.select("session_ref", F.concat(prefix, F.lit(" · "), F.col("base")).alias("label")))


def session_runs(turns: DataFrame) -> DataFrame:
    """Contiguous runs of one session in the turn list (newest first), with the session's number of listed turns.

    The list is cut once into ranges bounded by rows, and both scans run over them. Turns without a time come last.
    """
    last = F.lit(1 << 62)
    newest_first = turns.select(
        "turn_id", "session_ref", F.coalesce(-timekeys.millis(F.col("submission_started_at")), last).alias("_at"), F.coalesce(-timekeys.millis(F.col("created_at")), last).alias("_made")
    )
    order = ["_at", "_made", "turn_id"]
    cut = ranged(newest_first, [], order)
    before = with_running_ranged(cut, [], order, _before=last_value(F.col("session_ref"), False))
    opens = (F.col("_before").isNull() | (F.col("_before") != F.col("session_ref"))).cast("bigint")
    numbered = with_running_ranged(before.withColumn("_opens", opens), [], order, run=running_sum(F.col("_opens")), position=running_sum(F.lit(1), inclusive=False))
    runs = numbered.groupBy("run", "session_ref").agg(F.min("position").alias("first_index"), F.count("*").alias("run_length"))
    visible = turns.groupBy("session_ref").agg(F.count("*").alias("visible_turns"))
    return runs.join(visible, "session_ref")


# --- subsets ---------------------------------------------------------------------------------------------------------


def subset_by_sessions(tables: dict[str, DataFrame], refs: DataFrame) -> dict[str, DataFrame]:
    """Every table cut to the given sessions."""
    wanted = refs.select("session_ref").distinct()
    return {name: df.join(wanted, "session_ref", "left_semi") for name, df in tables.items()}


def select_contexts(contexts: DataFrame, mode: str, targets: DataFrame | None = None) -> DataFrame:
    """Context rows to keep: ``full`` all, ``none`` none (the scan is pruned away), ``matching`` those of target turns."""
    if mode == "full":
        return contexts
    if mode == "none":
        return contexts.where(F.lit(False))
    if mode == "matching" and targets is not None:
        return contexts.join(targets.select("turn_id").distinct(), "turn_id", "left_semi")
    raise ValueError(f"unknown context mode {mode!r}")
