"""Audits and source statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, timekeys, tokens
from turnwise.functions.ids import stable_id
from turnwise.functions.ordered import last_value, running_sum, with_running, with_running_ranged
from turnwise.operators.reads import with_last_message

# Processing stages in order.
STAGES = (
    "capture",
    "extract_records",
    "parse_source_fragments",
    "atomize",
    "derive_candidates",
    "finalize_projections",
    "apply_masks",
    "index_projections",
)
OVERSIZED_BYTES = 64 * 1024 * 1024


def _issue(df: DataFrame, code: str, entity: str, ref: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(entity).alias("entity"), ref.alias("id"), detail.alias("detail"))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _duplicates(df: DataFrame, column: str, entity: str, words: str) -> DataFrame:
    """One issue per surplus row; rows are counted with map-side combine before any row is repeated."""
    counted = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    surplus = counted.select(column, F.explode(F.sequence(F.lit(2).cast("bigint"), "n")))
    return _issue(surplus, "duplicate-id", entity, F.col(column), F.lit(words))


def _missing(df: DataFrame, known: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose reference is set but names nothing."""
    return df.where(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def _before(df: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """Each row with the values of the row before it in the list; scanned in chunks of positions."""
    levels = [F.floor(F.col(position) / 65_536)]
    return with_running(df, [], [position], levels, _prev=last_value(F.struct(*columns), inclusive=False))


def audit(sources: DataFrame, projects: DataFrame, sessions: DataFrame, turns: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Broken promises between the tables, one row per issue (code, entity, id, detail).

    ``position`` on turns and sessions is their place in the list as delivered; without it order is not checked.
    """
    quoted = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    issues = [
        _duplicates(sources, "source_id", "source", "two sources share this id"),
        _duplicates(projects, "project_id", "project", "two projects share this id"),
        _duplicates(sessions, "session_ref", "session", "two sessions share this id"),
        _duplicates(turns, "turn_id", "turn", "two turns share this id"),
        _issue(_missing(sessions, sources, "source_id", "source_id"), "missing-source", "session", F.col("session_ref"), _text("no source called ", F.col("source_id"))),
        _issue(_missing(turns, sources, "source_id", "source_id"), "missing-source", "turn", F.col("turn_id"), _text("no source called ", F.col("source_id"))),
        _issue(_missing(turns, sessions, "session_ref", "session_ref"), "missing-session", "turn", F.col("turn_id"), _text("no session called ", F.col("session_ref"))),
        _issue(_missing(turns, projects, "project_id", "project_id"), "missing-project", "turn", F.col("turn_id"), _text("no project called ", F.col("project_id"))),
        _issue(
            _missing(sessions, projects, "primary_project_id", "project_id"),
            "session-primary-project",
            "session",
            F.col("session_ref"),
            _text("main project is ", F.col("primary_project_id"), ", which the table lacks"),
        ),
        _issue(
            turns.where(F.col("project_id").isNotNull() & (F.col("link_state") == "unlinked")),
            "projected-unlinked-turn",
            "turn",
            F.col("turn_id"),
            _text("state says unlinked, yet the row names ", F.col("project_id")),
        ),
    ]
    total = turns.withColumn("_total", tokens.structured_total(F.col("token_usage"))).where(F.col("_total") != F.col("total_tokens"))
    issues.append(
        _issue(
            total,
            "turn-usage-total-mismatch",
            "turn",
            F.col("turn_id"),
            _text("usage adds up to ", F.col("_total").cast("string"), ", the total column has ", F.col("total_tokens").cast("string")),
        )
    )
    per_session = turns.groupBy("session_ref").agg(F.count("*").alias("_turns"))
    counted = sessions.join(per_session, "session_ref", "left").na.fill(0, ["_turns"])
    issues.append(
        _issue(
            counted.where(~F.col("turn_count").eqNullSafe(F.col("_turns"))),
            "session-turn-count",
            "session",
            F.col("session_ref"),
            _text("turn_count is ", quoted("turn_count"), ", counted ", F.col("_turns").cast("string")),
        )
    )
    per_project = turns.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(
        F.count_if(F.col("link_state") == "committed").alias("_committed"),
        F.count_if(F.col("link_state") == "candidate").alias("_candidate"),
        F.countDistinct("session_ref").alias("_sessions"),
    )
    tallied = projects.join(per_project, "project_id", "left").na.fill(0, ["_committed", "_candidate", "_sessions"])
    issues.append(
        _issue(
            tallied.where((F.col("committed_turn_count") != F.col("_committed")) | (F.col("candidate_turn_count") != F.col("_candidate"))),
            "project-turn-count",
            "project",
            F.col("project_id"),
            _text("committed/candidate columns hold ", quoted("committed_turn_count"), "/", quoted("candidate_turn_count"), ", counted ", quoted("_committed"), "/", quoted("_candidate")),
        )
    )
    issues.append(
        _issue(
            tallied.where(F.col("session_count") != F.col("_sessions")),
            "project-session-count",
            "project",
            F.col("project_id"),
            _text("session_count is ", quoted("session_count"), ", counted ", quoted("_sessions")),
        )
    )
    if "position" in turns.columns:
        at = [(-timekeys.millis(F.col("submission_started_at"))).alias("a"), (-timekeys.millis(F.col("created_at"))).alias("b"), F.col("turn_id").alias("turn_id")]
        ordered = _before(turns.select("turn_id", "position", F.struct(*at).alias("at")), "turn_id", "position", ["at"])
        late = ordered.where(F.col("_prev.at") > F.col("at"))
        issues.append(_issue(late, "turns-not-recency-ordered", "snapshot", F.col("turn_id"), _text("listed behind ", F.col("_prev.at.turn_id"), ", which should come later")))
    if "position" in sessions.columns:
        silent = F.col("last_message_at").isNull()
        at = F.struct(
            silent.alias("silent"),
            (-timekeys.millis(F.coalesce("last_message_at", "updated_at"))).alias("a"),
            (-timekeys.millis(F.col("created_at"))).alias("b"),
            F.col("session_ref").alias("session_ref"),
        )
        expected = with_last_message(sessions, turns).select("session_ref", "position", at.alias("at"), "last_message_at")
        wanted = with_running_ranged(
            expected.select("at", F.col("at.silent").alias("k0"), F.col("at.a").alias("k1"), F.col("at.b").alias("k2"), F.col("at.session_ref").alias("k3")),
            [],
            ["k0", "k1", "k2", "k3"],
            place=running_sum(F.lit(1), inclusive=False),
        ).select("place", F.col("k3").alias("expected_ref"))
        wrong = sessions.select("session_ref", F.col("position").alias("place")).join(wanted, "place").where(F.col("session_ref") != F.col("expected_ref"))
        issues.append(
            _issue(
                wrong,
                "sessions-not-recency-ordered",
                "snapshot",
                F.col("session_ref"),
                _text("place ", (F.col("place") + 1).cast("string"), " belongs to ", F.col("expected_ref")),
            )
        )
    if contexts is not None:
        issues.append(_duplicates(contexts, "turn_id", "context", "two contexts share this turn"))
        loose = contexts.join(turns.select("turn_id").distinct(), "turn_id", "left_anti")
        issues.append(_issue(loose, "missing-context-turn", "context", F.col("turn_id"), F.lit("no turn with this id")))
    found = issues[0]
    for more in issues[1:]:
        found = found.unionByName(more)
    return found


def loss_audits(found: DataFrame) -> DataFrame:
    """Audit rows with stable ids from (source_id, scope_ref, loss_kind, detail) and optional stage, code, severity."""
    present = set(found.columns)
    given = lambda name, default: F.coalesce(F.col(name), default) if name in present else default
    stage = given("stage_kind", F.lit("parse_source_fragments"))
    code = given("diagnostic_code", F.col("loss_kind"))
    return found.select(
        stable_id("loss-audit", F.col("source_id"), stage, code, F.col("scope_ref"), F.col("detail")).alias("audit_id"),
        "source_id",
        stable_id("stage-run", F.col("source_id"), stage).alias("stage_run_id"),
        stage.alias("stage_kind"),
        code.alias("diagnostic_code"),
        given("severity", F.lit("warning")).alias("severity"),
        "scope_ref",
        "loss_kind",
        "detail",
    )


def loss_by_stage(audits: DataFrame) -> DataFrame:
    """Audits above info per source and stage."""
    return audits.groupBy("source_id", "stage_kind").agg(F.count_if(F.col("severity") != "info").alias("failures"))


def stage_runs(counts: DataFrame, audits: DataFrame) -> DataFrame:
    """Eight stages per source with what went in and came out; ``counts`` has one row per source with the table sizes."""
    n = {name: F.col(name) for name in ("blobs", "records", "fragments", "atoms", "sessions", "turns")}
    derived = n["sessions"] + n["turns"]
    flow = {
        "capture": (F.lit(1).cast("bigint"), n["blobs"]),
        "extract_records": (n["blobs"], n["records"]),
        "parse_source_fragments": (n["records"], n["fragments"]),
        "atomize": (n["fragments"], n["atoms"]),
        "derive_candidates": (n["atoms"], derived),
        "finalize_projections": (derived, derived),
        "apply_masks": (n["turns"], n["turns"]),
        "index_projections": (n["turns"], n["turns"]),
    }
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("stage_kind"), F.lit(i).alias("stage_no"), flow[s][0].alias("input_count"), flow[s][1].alias("output_count"))
            for i, s in enumerate(STAGES)
        ]
    )
    runs = counts.select("source_id", F.inline(rows)).join(loss_by_stage(audits), ["source_id", "stage_kind"], "left").na.fill(0, ["failures"])
    unparseable = F.col("stage_kind").isin("extract_records", "parse_source_fragments")
    return runs.select(
        stable_id("stage-run", F.col("source_id"), F.col("stage_kind")).alias("stage_run_id"),
        "source_id",
        "stage_kind",
        "input_count",
        "output_count",
        F.col("output_count").alias("success_count"),
        F.col("failures").alias("failure_count"),
        F.when(unparseable, F.col("failures")).otherwise(0).alias("unparseable_count"),
        F.when((F.col("failures") > 0) & (F.col("output_count") == 0), "error").otherwise("success").alias("status"),
    )


def source_status(sources: DataFrame, sessions: DataFrame, turns: DataFrame, file_errors: DataFrame) -> DataFrame:
    """Healthy if anything was read, else error if files failed, else stale (also where no file was seen); with totals.

    ``sources`` may carry ``files_observed``; ``file_errors`` gives (source_id, file_order, detail).
    """
    per_session = sessions.groupBy("source_id").agg(F.count("*").alias("total_sessions"))
    per_turn = turns.groupBy("source_id").agg(F.count("*").alias("total_turns"))
    failed = file_errors.groupBy("source_id").agg(F.count("*").alias("_failed"), F.min_by("detail", "file_order").alias("_detail"))
    observed = F.col("files_observed") if "files_observed" in sources.columns else F.lit(1)
    joined = (
        sources.select("source_id", observed.alias("_files"))
        .join(per_session, "source_id", "left")
        .join(per_turn, "source_id", "left")
        .join(failed, "source_id", "left")
        .na.fill(0, ["total_sessions", "total_turns", "_failed"])
    )
    alive = (F.col("total_sessions") > 0) | (F.col("total_turns") > 0)
    more = F.when(F.col("_failed") > 1, F.concat(F.lit(" (+"), F.col("_failed") - 1, F.lit(" more)"))).otherwise("")
    return joined.select(
        "source_id",
        F.when(F.col("_files") == 0, "stale").when(alive, "healthy").when(F.col("_failed") > 0, "error").otherwise("stale").alias("sync_status"),
        F.concat("_detail", more).alias("error_message"),
        "total_sessions",
        "total_turns",
    )


def extraction_audits(blobs: DataFrame, records: DataFrame, max_bytes: int = OVERSIZED_BYTES) -> DataFrame:
    """Captures without records, records that are not JSON objects, and files too large to be read whole.

    ``blobs`` may carry ``by_line``: files read line by line have no size limit.
    """
    by_line = F.col("by_line") if "by_line" in blobs.columns else F.lit(False)
    empty = blobs.join(records.select("blob_id").distinct(), "blob_id", "left_anti")
    broken = records.where(~jsonv.is_object(F.try_parse_json("raw_json")))
    large = blobs.where((F.col("size_bytes") > max_bytes) & ~by_line)

    def row(df: DataFrame, scope: str, stage: str, code: str, kind: str, severity: str, words: Column) -> DataFrame:
        return df.select(
            "source_id",
            F.lit(stage).alias("stage_kind"),
            F.lit(code).alias("diagnostic_code"),
            F.lit(severity).alias("severity"),
            F.lit(kind).alias("loss_kind"),
            F.col(scope).alias("scope_ref"),
            words.alias("detail"),
        )

    over = _text("file of ", F.col("size_bytes").cast("string"), f" bytes exceeds the limit of {max_bytes}")
    return loss_audits(
        row(empty, "blob_id", "extract_records", "records_missing", "dropped_for_projection", "error", F.lit("capture without records"))
        .unionByName(row(broken, "record_id", "extract_records", "record_unparseable", "unknown_fragment", "warning", F.lit("record is not a JSON object")))
        .unionByName(row(large, "blob_id", "capture", "blob_too_large", "unknown_fragment", "warning", over))
    )


# Things that must not occur in shared text, as (label, texts of which one occurs in every match, pattern).
LEAK_PATTERNS = (
    ("unexpected home path", ("/Users/",), r"""/Users/(?!mock_user/)[^/\s"')]+/"""),
    ("unsanitized git forge host", ("gitea.",), r"\bgitea\.[A-Za-z0-9.-]+\b"),
    ("unsanitized temp root", ("/private/var/folders/",), r"/private/var/folders/(?!mock/)"),
    ("unsanitized temp root", ("/var/folders/",), r"/var/folders/(?!mock/)"),
    ("unsanitized launchd socket", ("/private/tmp/com.apple.launchd.",), r"/private/tmp/com\.apple\.launchd\.(?!mock/)"),
    ("unsanitized vscode git socket", ("vscode-git-",), r"vscode-git-(?!mock\.sock)[A-Za-z0-9]+"),
    ("email address", ("@",), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("GitHub token", ("ghp_",), r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("OpenAI-style token", ("sk-",), r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("authorization header", ("Authorization:",), r"Authorization:\s+Bearer (?!\$\{token\})[A-Za-z0-9._-]{16,}"),
    ("bearer token", ("Bearer ",), r"Bearer (?!\$\{token\})[A-Za-z0-9._-]{16,}"),
    (
        "unsanitized shell integration nonce",
        ('Nonce":"', 'NONCE":"', 'nonce":"'),
        r'"(?:shellIntegrationNonce|VSCODE_NONCE|nonce)":"(?!mock-shell-integration-nonce")'
        r'[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"',
    ),
)


def leak_scan(df: DataFrame, key: str, column: str, patterns: tuple[tuple[str, tuple[str, ...], str], ...] = LEAK_PATTERNS, private_names: tuple[str, ...] = ()) -> DataFrame:
    """One row per (row, label) where a forbidden pattern occurs; the patterns are literals of one projection.

    A pattern is tried only on texts that hold one of its literal texts, which is a plain search for bytes.
    ``private_names`` are user names that must not occur, by themselves or as owners on a forge.
    """
    names = [(name, re.escape(name)) for name in private_names]
    patterns = (*patterns, *[("real username", (n,), p) for n, p in names], *[("real GitHub path", (f"github.com/{n}",), r"github\.com/" + p) for n, p in names])
    text = F.col(column)

    def occurs(literals: tuple[str, ...], pattern: str) -> Column:
        there = F.lit(False)
        for literal in literals:
            there = there | text.contains(literal)
        return there & text.rlike(pattern)

    found = F.array_compact(F.array(*[F.when(occurs(literals, pattern), F.lit(label)) for label, literals, pattern in patterns]))
    return df.select(key, F.explode(F.array_distinct(found)).alias("label"))
