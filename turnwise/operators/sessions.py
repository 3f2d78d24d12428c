"""Sessions from atoms: titles, bounds, merging over files and overlapping captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import jsonv, masks, timekeys
from turnwise.functions.text import session_title
from turnwise.operators.atoms import SESSION
from turnwise.operators.turns import is_activity

DAY_MS = 24 * 60 * 60 * 1000


def hydrate_sessions(atoms: DataFrame) -> DataFrame:
    """Per session: last workspace and model signal, title and masked title from the first prompt that yields one.

    Explicit title signals win over prompts.
    """
    workspace = (F.col("signal_kind") == "workspace_signal") & F.col("path").isNotNull()
    model = (F.col("signal_kind") == "model_signal") & F.col("model").isNotNull()
    titled = (F.col("signal_kind") == "title_signal") & F.col("title").isNotNull()
    authored = (F.col("actor_kind") == "user") & (F.col("origin_kind") == "user_authored")
    told = atoms.withColumn("_title", F.when(authored, session_title(F.col("text"))))
    at = F.when(F.col("_title").isNotNull(), F.col("pos"))
    found = told.groupBy(*SESSION).agg(
        F.min("source_platform").alias("source_platform"),
        F.max_by("path", F.when(workspace, F.col("pos"))).alias("working_directory"),
        F.max_by("model", F.when(model, F.col("pos"))).alias("model"),
        F.min_by("title", F.when(titled, F.col("pos"))).alias("_signal"),
        F.min_by(F.struct("_title", "text"), at).alias("_first"),
    )
    # Only the prompt that gives the title is masked, one per session.
    masked = session_title(masks.masked_text(F.col("_first.text"), "user_message"))
    return found.select(
        *SESSION,
        "source_platform",
        "working_directory",
        "model",
        F.coalesce("_signal", "_first._title").alias("title"),
        F.coalesce("_signal", masked).alias("canonical_title"),
    )


def session_bounds(atoms: DataFrame, given: DataFrame | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """Created and updated time per session: what the format said, else first atom and last activity.

    If both are equal and the newest file of the session changed up to a day later, that counts as the update.
    ``given`` has (session key, created_at, updated_at), ``blobs`` (session key, file_modified_at).
    """
    seen = atoms.groupBy(*SESSION).agg(
        F.min_by("time_key", "pos").alias("_first"),
        F.coalesce(F.max_by("time_key", F.when(is_activity(), F.col("pos"))), F.max_by("time_key", "pos")).alias("_last"),
    )
    created, updated = F.col("_first"), F.col("_last")
    if given is not None:
        seen = seen.join(given.select(*SESSION, F.col("created_at").alias("_created"), F.col("updated_at").alias("_updated")), SESSION, "left")
        created, updated = F.coalesce("_created", created), F.coalesce("_updated", updated)
    bounds = seen.select(*SESSION, created.alias("created_at"), updated.alias("updated_at"))
    if blobs is None:
        return bounds
    touched = blobs.groupBy(*SESSION).agg(F.max("file_modified_at").alias("_touched"))
    late = (
        (F.col("updated_at") == F.col("created_at"))
        & (F.col("_touched") > F.col("created_at"))
        & (timekeys.millis(F.col("_touched")) - timekeys.millis(F.col("updated_at")) <= DAY_MS)
    )
    return bounds.join(touched, SESSION, "left").select(
        *SESSION, "created_at", F.when(F.coalesce(late, F.lit(False)), F.col("_touched")).otherwise(F.col("updated_at")).alias("updated_at")
    )


MERGE_FIRST = ("title", "canonical_title", "working_directory", "model", "source_native_project_ref", "source_session_id", "host_id")


def merge_sessions(drafts: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One session per id from per-file drafts: first known attributes by arrival, widest time bounds."""
    firsts = [c for c in MERGE_FIRST if c in drafts.columns]
    return drafts.groupBy("session_ref").agg(
        F.min_by("source_id", arrival).alias("source_id"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(arrival))).alias(c) for c in firsts],
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.count("*").alias("files"),
    )


def suppress_overlap(records: DataFrame) -> DataFrame:
    """Where composer and transcript captures hold the same session, keep one side.

    Of several composer captures the one with most user records stays (the first on ties). It then wins against all
    transcripts together unless they have more user records. Metadata records of dropped composers stay, transcripts go
    whole. ``records`` carries session_ref, capture_id, capture_kind (``composer`` or ``transcript``), capture_order,
    is_user, is_meta.
    """
    per_capture = records.groupBy("session_ref", "capture_id", "capture_kind").agg(
        F.count_if(F.col("is_user") & ~F.col("is_meta")).alias("users"), F.min("capture_order").alias("order")
    )
    composer = F.col("capture_kind") == "composer"
    rank = F.when(composer, F.struct((-F.col("users")).alias("users"), "order", "capture_id"))
    sides = per_capture.groupBy("session_ref").agg(
        F.min(rank).alias("_best"),
        F.count_if(~composer).alias("_transcripts"),
        F.coalesce(F.sum(F.when(~composer, F.col("users"))), F.lit(0)).alias("_said"),
    )
    both = F.col("_best").isNotNull() & (F.col("_transcripts") > 0)
    composer_wins = -F.col("_best.users") >= F.col("_said")
    winner = F.col("capture_id") == F.col("_best.capture_id")
    kept = F.when(composer, F.col("is_meta") | (winner & (~both | composer_wins))).otherwise(~both | ~composer_wins)
    return records.join(sides, "session_ref").where(kept).select(*records.columns)


def suppressed_bounds(records: DataFrame) -> DataFrame:
    """Time bounds and captures of sessions from the records that ``suppress_overlap`` kept of theirs.

    ``records`` has observed_at besides; times of records that were dropped do not reach into the session.
    """
    kept = suppress_overlap(records)
    return kept.groupBy("session_ref").agg(
        F.min("observed_at").alias("created_at"),
        F.max("observed_at").alias("updated_at"),
        F.count_distinct("capture_id").alias("captures"),
        F.count_if("is_user").alias("user_records"),
    )


def drop_empty_sessions(sessions: DataFrame, turns: DataFrame, atoms: DataFrame) -> DataFrame:
    """Sessions with a turn or an atom."""
    alive = turns.select("session_ref").unionByName(atoms.select("session_ref")).distinct()
    return sessions.join(alive, "session_ref", "left_semi")


def _quoted(argument: Column) -> Column:
    wrapped = F.concat(F.lit("'"), F.replace(argument, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(argument.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), argument).otherwise(wrapped)


# How each tool reopens a session.
RESUME_TOOLS = {"codex": "codex resume ", "claude_code": "claude --resume ", "grok": "grok -r ", "cursor_agent": "cursor-agent --resume "}


def resume_command(platform: Column, native_id: Column, directory: Column, delegated: Column) -> Column:
    """Shell command that reopens a session in its directory; none for delegated sessions or other platforms."""
    tool = F.lit(None).cast("string")
    for name, words in RESUME_TOOLS.items():
        tool = F.when(platform == name, words).otherwise(tool)
    command = F.concat(F.lit("cd "), _quoted(directory), F.lit(" && "), tool, _quoted(native_id))
    return F.when(~F.coalesce(delegated, F.lit(False)), command)


# The members of a file's first record that name its session, and the part of its path that does.
NATIVE_MEMBERS = {"amp": ("id",), "gemini": ("sessionId", "id"), "codex": ("payload.id",), "claude_code": ("sessionId",)}
NATIVE_PATHS = {"kimi": r"/(session_[^/]+)/agents/main/wire\.jsonl$", "grok": r"([^/]+)/chat_history\.jsonl$"}


def native_id(platform: Column, file_path: Column, first_record: Column) -> Column:
    """The session's own id, as the platform writes it into the first record (a VARIANT) or the path of a file."""
    path = F.translate(file_path, "\\", "/")
    found = F.lit(None).cast("string")
    for name, members in NATIVE_MEMBERS.items():
        found = F.when(platform == name, F.nullif(jsonv.string(first_record, *members), F.lit(""))).otherwise(found)
    for name, pattern in NATIVE_PATHS.items():
        found = F.when(platform == name, F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))).otherwise(found)
    return found


def session_key(platform: Column, native_id: Column, file_path: Column) -> Column:
    """``sess:<platform>:<native id>``, with the file's stem where no native id is known."""
    stem = F.regexp_replace(F.element_at(F.split(file_path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.lit("sess:"), platform, F.lit(":"), F.coalesce(F.nullif(native_id, F.lit("")), stem))


def native_session_id(platform: Column, session_ref: Column) -> Column:
    """Inverse of ``session_key``; null for ids of another shape."""
    prefix = F.concat(F.lit("sess:"), platform, F.lit(":"))
    rest = session_ref.substr(F.length(prefix) + 1, F.length(session_ref))
    return F.when(session_ref.startswith(prefix), F.nullif(rest, F.lit("")))
