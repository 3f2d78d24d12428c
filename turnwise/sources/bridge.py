"""Views that put the operators on plain analytics tables (conversations, events, documents, pages)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import timekeys
from turnwise.functions.ordered import with_position
from turnwise.functions.tokens import FIELDS, pack
from turnwise.schemas import ATOM, complete

EPOCH_MS = 1_704_067_200_000  # 2024-01-01T00:00:00Z
HOUR_MS = 3_600_000
MINUTE_MS = 60_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after_start(minutes: Column) -> Column:
    return timekeys.from_millis(F.lit(EPOCH_MS) + minutes.cast("bigint") * MINUTE_MS)


def conversation_atoms(spark: SparkSession, sf_dir: str, gaps: bool = False) -> DataFrame:
    """Atoms of ``conversations``; with ``gaps`` some replies are hidden and some prompts count as injected."""
    rows = table(spark, sf_dir, "conversations")
    role = F.col("role")
    origin = F.when(role == "user", "user_authored").when(role == "assistant", "assistant_authored").otherwise("source_instruction")
    hidden = F.lit(False)
    if gaps:
        hidden = (role == "assistant") & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
        origin = F.when((role == "user") & (F.length("text") % 5 == 0), "injected_user_shaped").otherwise(origin)
    key = F.concat(F.col("conv_id"), F.lit(":"), F.col("turn"))
    return complete(
        rows.select(
            F.concat(F.lit("a:"), key).alias("atom_id"),
            F.concat(F.lit("f:"), key).alias("fragment_id"),
            F.concat(F.lit("r:"), key).alias("record_id"),
            F.concat(F.lit("b:"), F.col("conv_id")).alias("blob_id"),
            F.lit("conv").alias("source_id"),
            F.lit("generic").alias("source_platform"),
            F.concat(F.lit("sess:conv:"), F.col("conv_id")).alias("session_ref"),
            F.col("turn").alias("pos"),
            role.alias("actor_kind"),
            origin.alias("origin_kind"),
            F.lit("text").alias("content_kind"),
            F.when(hidden, "hide").otherwise("show").alias("display_policy"),
            timekeys.from_millis(F.lit(EPOCH_MS) + F.col("conv_id") * HOUR_MS + F.col("turn") * MINUTE_MS).alias("time_key"),
            "text",
            F.when(role == "assistant", F.concat(F.lit("m"), F.col("conv_id") % 3)).alias("model"),
        ),
        ATOM,
    )


def event_k(df: DataFrame) -> Column:
    return F.get_json_object(df["props"], "$.k").cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", event_k(df).alias("k"))


def event_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of ``events``: views are tool calls, clicks tool results, purchases replies, sign-ups prompts."""
    kind = F.col("event_type")
    rows = events(spark, sf_dir)
    return complete(
        rows.select(
            F.concat(F.lit("a:"), F.col("event_id")).alias("atom_id"),
            F.concat(F.lit("f:"), F.col("event_id")).alias("fragment_id"),
            F.concat(F.lit("r:"), F.col("event_id")).alias("record_id"),
            F.concat(F.lit("b:"), F.col("user_id")).alias("blob_id"),
            F.lit("ev").alias("source_id"),
            F.lit("generic").alias("source_platform"),
            F.concat(F.lit("sess:ev:"), F.col("user_id")).alias("session_ref"),
            F.col("event_id").alias("pos"),
            F.when(kind.isin("view", "click"), "tool").when(kind == "signup", "user").otherwise("assistant").alias("actor_kind"),
            F.when(kind.isin("view", "click"), "tool_generated")
            .when(kind == "signup", "user_authored")
            .otherwise("assistant_authored")
            .alias("origin_kind"),
            F.when(kind == "view", "tool_call").when(kind == "click", "tool_result").otherwise("text").alias("content_kind"),
            F.when(kind == "error", "hide").otherwise("show").alias("display_policy"),
            timekeys.iso(F.col("ts")).alias("time_key"),
            F.concat(kind, F.lit(" "), F.col("k")).alias("text"),
            F.when(kind.isin("view", "click"), F.concat(F.lit("c"), F.col("k"))).alias("call_id"),
            F.when(kind == "view", F.concat(F.lit("tool"), F.col("k") % 5)).alias("tool_name"),
            F.when(kind == "view", F.concat(F.lit('{"k":'), F.col("k"), F.lit("}"))).alias("tool_input"),
            F.when(kind == "click", F.concat(F.lit("out "), F.col("event_id"))).alias("tool_output"),
            F.when(kind == "purchase", F.concat(F.lit("m"), F.col("k") % 5)).alias("model"),
        ),
        ATOM,
    )


def usage_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing signals of ``events``, one per row, with the numbers spread over a usage struct."""
    rows = events(spark, sf_dir)
    numbers = {name: F.lit(None) for name in FIELDS}
    numbers["input_tokens"] = F.floor("value")
    numbers["cache_read_input_tokens"] = F.col("k")
    numbers["output_tokens"] = F.col("k") * 2
    numbers["total_tokens"] = F.floor("value").cast("bigint") + F.col("k") * 3
    return rows.select(
        F.concat(F.lit("a:"), F.col("event_id")).alias("atom_id"),
        F.lit("ev").alias("source_id"),
        F.concat(F.lit("sess:ev:"), F.col("user_id")).alias("session_ref"),
        F.col("event_id").alias("pos"),
        timekeys.iso(F.col("ts")).alias("time_key"),
        F.col("k").cast("string").alias("message_id"),
        (F.col("event_id") % 3).cast("string").alias("request_id"),
        (F.col("event_type") == "click").alias("is_sidechain"),
        pack(numbers, F.lit(None)).alias("usage"),
    )


def usage_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with usage, one per event; errors carry none, some models and projects are missing."""
    rows = events(spark, sf_dir)
    k = F.col("k")
    numbers = {name: F.lit(None) for name in FIELDS}
    numbers["input_tokens"] = F.floor("value")
    numbers["cache_read_input_tokens"] = F.when(k % 3 == 0, k)
    numbers["cache_creation_input_tokens"] = F.when(k % 4 == 0, k)
    numbers["cached_input_tokens"] = F.when(k % 5 == 1, k)
    numbers["output_tokens"] = k * 2
    numbers["total_tokens"] = F.when(k % 2 == 0, F.floor("value").cast("bigint") + k * 3)
    usage = F.when(F.col("event_type") != "error", pack(numbers, F.lit(None)))
    return rows.select(
        F.concat(F.lit("t:"), F.col("event_id")).alias("turn_id"),
        F.concat(F.lit("sess:ev:"), F.col("user_id")).alias("session_ref"),
        F.col("event_type").alias("source_id"),
        F.when(k % 7 != 0, F.concat(F.lit("p"), k % 7)).alias("project_id"),
        F.when(k % 7 == 0, "unlinked").when(k % 7 < 4, "committed").otherwise("candidate").alias("link_state"),
        timekeys.iso(F.col("ts")).alias("submission_started_at"),
        timekeys.iso(F.col("ts")).alias("created_at"),
        timekeys.from_millis(F.unix_millis("ts") + k * 1000).alias("last_context_activity_at"),
        F.when(k % 11 == 0, 0).otherwise(1).alias("assistant_reply_count"),
        usage.alias("token_usage"),
        F.when((F.col("event_type") == "error") & (k % 4 == 0), k).alias("total_tokens"),
        F.when(k % 10 != 0, F.concat(F.lit("m"), k % 5)).alias("primary_model"),
        F.lit(None).cast("string").alias("zero_token_reason"),
    )


def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions behind ``usage_turns``: one per user, hosts and working directories derived from the user id."""
    rows = events(spark, sf_dir)
    user = F.col("user_id")
    per_user = rows.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("turn_count"))
    return per_user.select(
        F.concat(F.lit("sess:ev:"), user).alias("session_ref"),
        F.when(user % 3 == 0, "view").otherwise("click").alias("source_id"),
        F.when(user % 2 == 0, "codex").otherwise("claude_code").alias("source_platform"),
        F.when(user % 6 != 5, F.concat(F.lit("h"), user % 4)).alias("host_id"),
        F.when(user % 5 != 4, F.concat(F.lit("Topic "), user % 20)).alias("title"),
        F.concat(F.lit("Topic "), user % 20).alias("canonical_title"),
        F.when(user % 7 == 0, F.concat(F.lit("m"), user % 3)).alias("model"),
        F.when(user % 4 != 3, F.concat(F.lit("/work/app"), user % 13, F.lit("/sub"), user % 3)).alias("working_directory"),
        F.concat(F.lit("n-"), user).alias("source_session_id"),
        timekeys.iso(F.col("first_ts")).alias("created_at"),
        timekeys.iso(F.col("last_ts")).alias("updated_at"),
        "turn_count",
        F.when(user % 9 == 0, F.concat(F.lit("p"), user % 7)).alias("primary_project_id"),
    )


def usage_sources(spark: SparkSession, sf_dir: str, known: bool = True) -> DataFrame:
    """One source per event type, with counts by which it is healthy, stale or failed.

    Without ``known``, one type has no source, for reads that have to cope with turns of a missing one.
    """
    rows = events(spark, sf_dir)
    kind = F.col("event_type")
    per_type = rows.groupBy("event_type").agg(F.count("*").alias("total_turns"), F.countDistinct("user_id").alias("total_sessions"))
    return per_type.where(F.lit(known) | (kind != "signup")).select(
        kind.alias("source_id"),
        F.concat(F.lit("slot-"), kind).alias("slot_id"),
        F.initcap(kind).alias("display_name"),
        F.when(kind == "error", "codex").otherwise("claude_code").alias("source_platform"),
        F.lit("host-x").alias("host_id"),
        F.when(kind == "error", "error").when(kind == "view", "stale").otherwise("healthy").alias("sync_status"),
        "total_sessions",
        "total_turns",
    )


def usage_projects(spark: SparkSession, sf_dir: str, known: bool = True) -> DataFrame:
    """Projects named by ``usage_turns``; without ``known`` one is left out, so that turns point at a missing project."""
    turns = usage_turns(spark, sf_dir).where(F.col("project_id").isNotNull() & (F.lit(known) | (F.col("project_id") != "p6")))
    number = F.substring("project_id", 2, 9).cast("int")
    per_project = turns.groupBy("project_id").agg(
        F.count_if(F.col("link_state") == "committed").alias("committed_turn_count"),
        F.count_if(F.col("link_state") == "candidate").alias("candidate_turn_count"),
        F.countDistinct("session_ref").alias("session_count"),
        F.max("last_context_activity_at").alias("project_last_activity_at"),
        F.min("submission_started_at").alias("created_at"),
    )
    return per_project.select(
        "*",
        F.col("project_last_activity_at").alias("updated_at"),
        F.concat(F.lit("Project "), number).alias("display_name"),
        F.concat(F.lit("project-"), number, F.lit("-"), F.col("project_id")).alias("slug"),
        F.when(number < 4, "committed").otherwise("candidate").alias("linkage_state"),
        (F.lit(0.5) + number / 100).alias("confidence"),
        F.concat(F.lit("/work/app"), number).alias("primary_workspace_path"),
        F.when(number % 2 == 0, F.concat(F.lit("/work/app"), number)).alias("repo_root"),
    )


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable turns of ``documents``; labels give the value axis."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality"))
    doc = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("t:"), F.lpad(doc.cast("string"), 9, "0")).alias("turn_id"),
        F.concat(F.lit("sess:doc:"), doc % 50).alias("session_ref"),
        F.col("source").alias("source_id"),
        F.col("text").alias("canonical_text"),
        F.concat(F.col("source"), F.lit(" "), F.col("lang")).alias("path_text"),
        F.when(doc % 3 != 0, F.concat(F.lit("p"), doc % 4)).alias("project_id"),
        F.when(doc % 3 == 0, "unlinked").when(doc % 2 == 0, "committed").otherwise("candidate").alias("link_state"),
        F.when(F.col("quality") == 0, "archived").otherwise("active").alias("value_axis"),
        minutes_after_start(doc).alias("submission_started_at"),
        minutes_after_start(doc).alias("created_at"),
    )


def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project observations of ``pages``: the url host is the remote, the first path segment the workspace."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    segment = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1)
    page = F.col("page_id")
    remote = F.when(page % 3 != 1, host)
    return pages.select(
        F.concat(F.lit("o:"), F.lpad(page.cast("string"), 9, "0")).alias("observation_id"),
        F.lit("web").alias("source_id"),
        F.concat(F.lit("sess:web:"), F.floor(page / 3)).alias("session_ref"),
        minutes_after_start(page).alias("observed_at"),
        F.lit(0.5).alias("confidence"),
        F.when(page % 5 != 3, F.concat(F.lit("/"), segment)).alias("workspace_path"),
        F.when(page % 7 == 2, F.concat(F.lit("/"), segment)).alias("repo_root"),
        remote.alias("repo_remote"),
        F.when(page % 2 == 0, F.sha1(remote)).alias("repo_fingerprint"),
        F.when(page % 11 == 0, F.concat(F.lit("native-"), page % 4)).alias("source_native_project_ref"),
    )


def page_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id")
    number = F.col("number")
    per_session = pages.groupBy(F.floor(F.col("page_id") / 3).cast("bigint").alias("number")).agg(
        F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page")
    )
    return per_session.select(
        F.concat(F.lit("sess:web:"), number).alias("session_ref"),
        F.lit("web").alias("source_id"),
        F.when(number % 3 == 0, "codex").otherwise("grok").alias("source_platform"),
        F.concat(F.lit("h"), number % 2).alias("host_id"),
        F.when(number % 4 == 0, F.concat(F.lit("/home/u"), number % 5)).alias("working_directory"),
        F.lit(None).cast("string").alias("source_native_project_ref"),
        minutes_after_start(F.col("first_page")).alias("created_at"),
        minutes_after_start(F.col("last_page")).alias("updated_at"),
    )


def page_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns over the page sessions; activity falls between the observations."""
    page = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id").select(
        F.concat(F.lit("t:"), F.lpad(page.cast("string"), 9, "0")).alias("turn_id"),
        F.concat(F.lit("sess:web:"), F.floor(page / 3)).alias("session_ref"),
        F.lit("web").alias("source_id"),
        minutes_after_start(page).alias("submission_started_at"),
        timekeys.from_millis(F.lit(EPOCH_MS) + page * MINUTE_MS + (page % 3 - 1) * 90_000).alias("last_context_activity_at"),
        F.concat(F.lit("src/"), page % 10).alias("path_text"),
    )


def relation_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of all ``events``: sign-ups and some views delegate, purchases and some clicks are automation runs.

    Other views and clicks say nothing of a relation; errors have one that names neither a parent nor a job.
    """
    rows = events(spark, sf_dir)
    kind, k = F.col("event_type"), F.col("k")
    delegates = (kind == "signup") | ((kind == "view") & (k % 5 == 0))
    runs = (kind == "purchase") | ((kind == "click") & (k % 5 == 1))
    relation = F.when(
        delegates,
        F.to_json(
            F.struct(
                F.concat(F.lit(""), F.col("k") * 2).alias("parent_uuid"),
                (F.col("value") > 100).alias("is_sidechain"),
                F.when(F.col("k") % 2 == 0, F.concat(F.lit("agent-"), F.col("k") % 5)).alias("agent_id"),
                F.when(F.col("k") % 3 == 0, "done").alias("status"),
            )
        ),
    ).when(
        runs,
        F.to_json(
            F.struct(
                F.lit("automation_run").alias("relation_kind"),
                F.concat(F.lit("job-"), F.col("k")).alias("job_id"),
                F.when(F.col("k") % 4 == 0, F.concat(F.lit("run-"), F.col("k") % 8)).alias("session_key"),
                F.when(F.col("k") % 6 == 0, F.concat(F.lit(""), F.col("k") % 20)).alias("parent_id"),
            )
        ),
    ).when(kind == "error", '{"status":"broken","parent_id":" "}')
    return rows.select(
        F.concat(F.lit("f:"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("fragment_id"),
        F.concat(F.lit("sess:ev:"), F.col("user_id")).alias("session_ref"),
        timekeys.iso(F.col("ts")).alias("time_key"),
        relation.alias("relation"),
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as pieces of transcript files: (name, bucket, place, conv_id, turn, line, ending, piece).

    A file holds every other turn of twenty conversations, so every conversation is in two files. Lines end in LF, CRLF or
    CR by file, and some are followed by a blank line.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    bucket = F.floor(F.col("conv_id") / 20)
    said = timekeys.from_millis(F.lit(EPOCH_MS) + F.col("conv_id") * HOUR_MS + ((F.col("turn") * 7) % 5) * MINUTE_MS)
    line = F.to_json(F.struct(F.col("conv_id").alias("conv"), "turn", "role", said.alias("timestamp")))
    ending = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (bucket % 3 + 1).cast("int"))
    pieces = rows.select("conv_id", "turn", bucket.alias("bucket"), F.concat(F.lit("c"), bucket, F.lit("-"), F.col("turn") % 2, F.lit(".jsonl")).alias("name"), line.alias("line"), ending.alias("ending"))
    blank = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), "ending")).otherwise("")
    return with_position(pieces.withColumn("piece", F.concat("line", "ending", blank)), ["name"], ["conv_id", "turn"], "place")


def write_files(pieces: DataFrame, folder: str) -> None:
    """Write the pieces (name, place, piece) of every name, in order, as one file of a folder or of a folder below it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        now, out, made = None, None, {""}
        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != now:
                    if out is not None:
                        out.close()
                    if (parent := name.rpartition("/")[0]) not in made:
                        fs.create_dir(f"{root}/{parent}", recursive=True)
                        made.add(parent)
                    now, out = name, fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(piece.encode())
            yield batch.select([0])
        if out is not None:
            out.close()

    # Opening and closing files takes longer than their bytes, by which partitions would be merged.
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_pieces = pieces.select("name", "place", "piece").repartition(parts, "name").sortWithinPartitions("name", "place")
    sorted_pieces.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def delete_files(names: DataFrame, folder: str) -> None:
    """Delete the named files of a folder."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if fs.get_file_info(f"{root}/{name}").type == pa.fs.FileType.File:
                    fs.delete_file(f"{root}/{name}")
            yield batch

    names.select("name").distinct().mapInArrow(delete, "name string").write.format("noop").mode("overwrite").save()
