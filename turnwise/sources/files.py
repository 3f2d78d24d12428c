"""Transcript files and exported stores as record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.functions import jsonv, timekeys
from turnwise.functions.bind import bind
from turnwise.functions.ids import stable_id
from turnwise.functions.ordered import last_value, next_value, position_chunk, with_position, with_running
from turnwise.schemas import RECORD, complete
from turnwise.session import materialize
from turnwise.sources import ranges


def blob_id(source_id: Column, path: Column, checksum: Column) -> Column:
    return stable_id("blob", source_id, path, checksum)


def read_jsonl(spark: SparkSession, paths: str | list[str], source_id: str, platform: str = "generic", range_bytes: int = ranges.RANGE_BYTES) -> DataFrame:
    """One record per non-empty line, numbered densely within its file; broken lines are kept and judged later.

    Files of any size are read in byte ranges; ordinals, checksums and ids do not depend on the size of a range.
    """
    files = materialize(ranges.listed(spark, paths), "listing")
    hashed = materialize(ranges.file_digests(files).withColumnRenamed("checksum", "mark"), "digests")
    return _records(ranges.numbered_lines(hashed, range_bytes).withColumnRenamed("mark", "checksum"), source_id, platform)


def _records(numbered: DataFrame, source_id: str, platform: str) -> DataFrame:
    source = F.lit(source_id)
    blob = blob_id(source, F.col("origin_path"), F.col("checksum"))
    shaped = numbered.select(
        source.alias("source_id"),
        F.lit(platform).alias("source_platform"),
        "origin_path",
        blob.alias("blob_id"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "raw_json",
    )
    return complete(shaped.withColumn("record_id", stable_id("record", F.col("blob_id"), F.col("ordinal"))), RECORD)


def with_session_keys(records: DataFrame) -> DataFrame:
    """Add ``session_ref``: by the id that the platform writes into a file's first record or its path, else by its stem."""
    from turnwise.operators.sessions import native_id, session_key

    first = records.groupBy("blob_id", "source_platform", "origin_path").agg(F.min_by("raw_json", "ordinal").alias("_first"))
    platform, path = F.col("source_platform"), F.col("origin_path")
    keys = first.select("blob_id", session_key(platform, native_id(platform, path, F.try_parse_json("_first")), path).alias("session_ref"))
    return complete(records.drop("session_ref").join(keys, "blob_id"), RECORD)


def attach_sidecars(records: DataFrame, sidecars: DataFrame, key: Column, pointer: str) -> DataFrame:
    """Add each sidecar document to the transcript of the same key as one more record behind its lines.

    ``sidecars`` gives (key, raw_json); ``key`` derives the same key from a record's path.
    """
    last = records.groupBy(*[c for c in RECORD if c not in ("record_id", "ordinal", "pointer", "observed_at", "raw_json")]).agg(
        F.max("ordinal").alias("_last"), F.max("observed_at").alias("observed_at")
    )
    extra = last.withColumn("key", key).join(sidecars.select("key", "raw_json"), "key")
    named = extra.withColumns(
        {
            "ordinal": F.col("_last") + 1,
            "pointer": F.lit(pointer),
            "record_id": stable_id("record", F.col("blob_id"), F.lit(pointer)),
        }
    )
    return records.unionByName(complete(named, RECORD))


def impute_ordinal_time(records: DataFrame, base: Column) -> DataFrame:
    """Records without a time get the base time plus their number in milliseconds."""
    made = timekeys.iso(F.timestamp_millis(timekeys.millis(base) + F.col("ordinal")))
    return records.withColumn("observed_at", F.coalesce("observed_at", made))


def impute_fill_time(records: DataFrame, fallback: str) -> DataFrame:
    """Records without a time take the previous one's, else the next one's, else the fallback; scanned in chunks."""
    seen = with_running(
        records, ["blob_id"], ["ordinal"], [position_chunk("ordinal")], _prev=last_value(F.col("observed_at")), _next=next_value(F.col("observed_at"))
    )
    return seen.withColumn("observed_at", F.coalesce("_prev", "_next", F.lit(fallback))).drop("_prev", "_next")


# --- inventory and capture -------------------------------------------------------------------------------------------


def inventory(spark: SparkSession, roots: list[str], pattern: str, priority: dict[str, int] | None = None, limit: int | None = None) -> DataFrame:
    """Files under the roots whose path matches, best priority first; only metadata is read."""
    rank = F.lit(0)
    for rule, value in (priority or {}).items():
        rank = F.when(F.col("path").rlike(rule), value).otherwise(rank)
    files = ranges.listed(spark, roots).withColumnRenamed("origin_path", "path").where(F.col("path").rlike(pattern)).select("path", "length", "modificationTime", rank.alias("priority"))
    ordered = files.orderBy("priority", "path")
    return ordered if limit is None else ordered.limit(limit)


def missing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    """Roots that do not exist, by the file system each root names."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [(root, jvm.org.apache.hadoop.fs.Path(root)) for root in roots]
    return [root for root, path in paths if not path.getFileSystem(conf).exists(path)]


def capture(spark: SparkSession, roots: str | list[str], source_id: str, glob: str | None = None) -> DataFrame:
    """Checksum, size, modification time and latest said time of every file, with its capture id.

    A file is hashed block by block, and only its last records are looked at for their time.
    """
    files = materialize(ranges.listed(spark, roots, glob), "listing")
    digests = ranges.file_digests(files).join(files.select("uri", "modificationTime"), "uri")
    said = F.transform("said", lambda t: timekeys.coerce(t))
    return digests.select(
        blob_id(F.lit(source_id), F.col("origin_path"), F.col("checksum")).alias("blob_id"),
        F.lit(source_id).alias("source_id"),
        "origin_path",
        "checksum",
        F.col("length").alias("size_bytes"),
        timekeys.iso(F.col("modificationTime")).alias("file_modified_at"),
        F.array_max(said).alias("content_max_timestamp"),
    )


def content_max_timestamp(records: DataFrame, tail: int = 5) -> DataFrame:
    """Latest time among the last few parseable records of each capture; of equal times the later record's counts."""
    timed = records.withColumn("v", F.try_parse_json("raw_json")).where(jsonv.is_object(F.col("v")))
    said = timed.select("blob_id", "ordinal", timekeys.coerce(jsonv.string(F.col("v"), "timestamp")).alias("said_at"))
    # rank <= n lets Spark keep only n rows per capture before the shuffle.
    last = said.withColumn("rank", F.row_number().over(Window.partitionBy("blob_id").orderBy(F.desc("ordinal")))).where(F.col("rank") <= tail)
    return last.groupBy("blob_id").agg(F.max("said_at").alias("content_max_timestamp"))


def tail_capture(blobs: DataFrame) -> DataFrame:
    """The current capture of each append-only file: the largest, the first on ties."""
    rank = F.struct((-F.col("size_bytes")).alias("size"), "captured_at", "blob_id")
    return blobs.groupBy("source_id", "origin_path").agg(F.min_by(F.struct("blob_id", "size_bytes", "checksum", "captured_at"), rank).alias("b")).select(
        "source_id", "origin_path", "b.*"
    )


def changed_files(inventory_now: DataFrame, previous: DataFrame, since: str | None = None, now: str | None = None) -> DataFrame:
    """Files not seen before with the same size and checksum; with ``since`` only those modified after the cut.

    ``since`` is an ISO time or an age such as ``30m``, ``12h``, ``7d`` or ``2w`` before ``now``.
    """
    known = previous.select("origin_path", "size_bytes", "checksum")
    changed = inventory_now.join(known, ["origin_path", "size_bytes", "checksum"], "left_anti")
    if since is None:
        return changed
    units = {"m": 60, "h": 3600, "d": 86400, "w": 7 * 86400}
    if since[-1] in units and since[:-1].isdigit():
        cut = timekeys.iso(F.timestamp_seconds(F.unix_seconds(F.try_to_timestamp(F.lit(now))) - int(since[:-1]) * units[since[-1]]))
    else:
        cut = timekeys.coerce(F.lit(since))
    return changed.where(F.col("file_modified_at") >= cut)


def files_to_read(now: DataFrame, previous: DataFrame) -> DataFrame:
    """Files that are new or whose size or modification time changed, told from the listing alone.

    Both sides give (origin_path, size_bytes, file_modified_at); no content is read, so a file that was captured before
    with equal size and time is reused as it is.
    """
    same = previous.select("origin_path", "size_bytes", "file_modified_at").distinct()
    return now.join(same, ["origin_path", "size_bytes", "file_modified_at"], "left_anti")


# --- exported stores -------------------------------------------------------------------------------------------------


def from_session_tables(session: DataFrame, message: DataFrame, part: DataFrame, task_link: DataFrame) -> DataFrame:
    """Records of a relational store: a session row with its latest time and parent, its messages, each with its parts.

    Sessions without messages are dropped; a message's parts are bounded by the message.
    """
    parts = part.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "data"))), lambda p: p.data).alias("parts"))
    said = message.join(parts, message["id"] == parts["message_id"], "left").select(
        F.col("session_id"), F.col("id").alias("mid"), F.col("time_created"), F.col("data"), "parts"
    )
    body = F.concat(
        F.lit('{"info":'), F.coalesce("data", F.lit("{}")), F.lit(',"parts":['), F.coalesce(F.array_join("parts", ","), F.lit("")), F.lit("]}")
    )
    rows = said.select(
        "session_id", F.col("time_created").alias("at"), F.concat(F.lit("m:"), F.col("mid")).alias("pointer"), body.alias("raw_json")
    )
    touched = message.groupBy("session_id").agg(F.max("time_updated").alias("last_message"))
    parent = task_link.groupBy(F.col("child_session_id").alias("session_id")).agg(
        F.min_by(F.struct("parent_session_id", "agent_type", "model", "status"), "time_created").alias("link")
    )
    heads = (
        session.withColumnRenamed("id", "session_id")
        .join(touched, "session_id")
        .join(parent, "session_id", "left")
        .select(
            "session_id",
            F.col("time_created").alias("at"),
            F.lit("meta").alias("pointer"),
            F.to_json(
                F.struct(
                    F.col("title"),
                    F.col("directory"),
                    F.greatest("time_updated", "last_message").alias("updated"),
                    F.coalesce("link.parent_session_id", "parent_id").alias("parentId"),
                    F.col("link.agent_type").alias("agentId"),
                    F.col("link.model").alias("model"),
                )
            ).alias("raw_json"),
        )
    )
    return heads.unionByName(rows)


def join_envelopes(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Message documents with their session's header and their parts in name order, one row per message.

    Inputs give (id, doc) for sessions, (id, session_id, doc) for messages and (message_id, name, doc) for parts.
    """
    listed = parts.groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "doc"))), lambda p: p.doc).alias("parts"))
    header = sessions.select(F.col("id").alias("session_id"), F.col("doc").alias("session_doc"))
    joined = messages.join(header, "session_id", "left").join(listed, messages["id"] == listed["message_id"], "left")
    body = F.concat(
        F.lit('{"session":'),
        F.coalesce("session_doc", F.lit("{}")),
        F.lit(',"message":'),
        F.col("doc"),
        F.lit(',"parts":['),
        F.coalesce(F.array_join("parts", ","), F.lit("")),
        F.lit("]}"),
    )
    return joined.select("session_id", F.col("id").alias("message_id"), body.alias("raw_json"))


def from_kv_store(kv: DataFrame) -> DataFrame:
    """Bubbles of every composer row of a key-value store, in composer order: (composer_id, position, raw_json).

    A referenced bubble is looked up by equality under its possible keys, the first spelling that exists counting. A
    composer none of whose references exist takes the bubbles filed under its own prefix, by their time and key. With a
    column ``store`` every store is read by itself, and the column stays.
    """
    store = ["store"] if "store" in kv.columns else []
    key = [*store, "composer_id"]
    composers = kv.where(F.col("storage_key").startswith("composerData:")).select(
        *store, F.col("storage_key").substr(F.lit(14), F.length("storage_key")).alias("composer_id"), F.try_parse_json("storage_value").alias("v")
    )
    headers = F.concat(jsonv.array(F.col("v"), "fullConversationHeadersOnly"), jsonv.array(F.col("v"), "conversation"))
    refs = composers.select(*key, F.posexplode(headers).alias("position", "ref")).withColumn("bubble", jsonv.string(F.col("ref"), "bubbleId", "id"))
    cid, bid = F.col("composer_id"), F.col("bubble")
    spellings = F.array(
        F.concat_ws(":", F.lit("bubbleId"), cid, bid),
        F.concat_ws(":", F.lit("bubbleId"), bid),
        F.concat_ws(":", F.lit("bubble"), cid, bid),
        F.concat_ws(":", F.lit("bubble"), bid),
        bid,
    )
    tried = refs.where(bid.isNotNull()).select(*key, "position", F.posexplode(spellings).alias("rank", "storage_key"))
    found = tried.join(kv, [*store, "storage_key"]).groupBy(*key, "position").agg(F.min_by("storage_value", "rank").alias("raw_json"))
    own = kv.where(F.col("storage_key").startswith("bubbleId:")).withColumn("composer_id", F.split_part("storage_key", F.lit(":"), F.lit(2)))
    orphan = composers.select(*key).join(found.select(*key).distinct(), key, "left_anti")
    bubble = F.try_parse_json("storage_value")
    made = F.coalesce(timekeys.coerce(jsonv.string(bubble, "createdAt")), timekeys.from_millis(jsonv.number(bubble, "createdAt")), F.lit("~"))
    timed = own.join(orphan, key).select(*key, made.alias("made"), "storage_key", F.col("storage_value").alias("raw_json"))
    filed = with_position(timed, key, ["made", "storage_key"], "position").select(*key, "position", "raw_json")
    return found.select(*key, F.col("position").cast("bigint"), "raw_json").unionByName(filed)


def from_prompt_history(kv: DataFrame, base: str) -> DataFrame:
    """User records of a workspace's prompt list (``generations``, else ``prompts`` if no entry has a text), one session per workspace.

    ``kv`` gives (workspace, storage_key, storage_value); a prompt without a time gets the base time plus its number of seconds.
    """
    wanted = kv.where(F.col("storage_key").isin("aiService.generations", "aiService.prompts"))
    entries = wanted.select("workspace", "storage_key", F.posexplode(F.from_json("storage_value", "array<variant>")).alias("ordinal", "entry"))
    told = entries.withColumn("said", jsonv.string(F.col("entry"), "textDescription", "text", "prompt")).where(F.trim("said") != "")
    # A list without a usable text does not count, so the next one is read.
    first = told.groupBy("workspace").agg(F.min("storage_key").alias("storage_key"))
    listed = told.join(first, ["workspace", "storage_key"])
    at = F.coalesce(
        timekeys.from_millis(jsonv.number(F.col("entry"), "unixMs")),
        timekeys.from_millis(timekeys.millis(F.lit(base)) + F.col("ordinal") * 1000),
    )
    named = F.coalesce(jsonv.string(F.col("entry"), "generationUUID", "id"), F.sha1(F.concat_ws(":", "said", "ordinal")))
    return listed.select("workspace", "ordinal", at.alias("observed_at"), F.col("said").alias("text"), named.alias("id"))


def read_thread_docs(spark: SparkSession, paths: str | list[str], source_id: str, platform: str = "amp") -> DataFrame:
    """A thread document as its root record and one record per message."""
    v = F.col("v")
    whole = spark.read.text(paths, wholetext=True).select(
        ranges.plain_path(F.col("_metadata.file_path")).alias("origin_path"), F.sha1("value").alias("checksum"), F.try_parse_json("value").alias("v")
    )
    created = F.coalesce(timekeys.coerce(jsonv.string(v, "created_at")), timekeys.from_millis(jsonv.number(v, "created")))
    root = F.struct(F.lit("root").alias("pointer"), F.to_json(F.struct(*[jsonv.member(v, n).alias(n) for n in ("id", "title", "created", "env")])).alias("raw_json"))
    messages = F.transform(F.filter(jsonv.array(v, "messages"), jsonv.is_object), lambda m: F.struct(F.lit("message").alias("pointer"), F.to_json(m).alias("raw_json")))
    rows = whole.select("origin_path", "checksum", jsonv.string(v, "id").alias("native"), created.alias("created"), F.posexplode(F.concat(F.array(root), messages)).alias("ordinal", "r"))
    said = F.try_parse_json("r.raw_json")
    items = F.flatten(F.transform(jsonv.array(said, "content"), lambda c: F.array(jsonv.number(c, "startTime"), jsonv.number(c, "finalTime"))))
    # The latest of the times a message names; a message without any has the thread's.
    sent = F.greatest(timekeys.from_millis(jsonv.number(said, "meta.sentAt")), timekeys.coerce(jsonv.string(said, "timestamp")), timekeys.from_millis(F.array_max(items)))
    shaped = rows.select(
        F.lit(source_id).alias("source_id"),
        F.lit(platform).alias("source_platform"),
        "origin_path",
        blob_id(F.lit(source_id), F.col("origin_path"), F.col("checksum")).alias("blob_id"),
        F.concat(F.lit(f"sess:{platform}:"), F.col("native")).alias("session_ref"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        F.col("r.pointer").alias("pointer"),
        F.coalesce(sent, "created").alias("observed_at"),
        F.col("r.raw_json").alias("raw_json"),
    )
    return complete(shaped.withColumn("record_id", stable_id("record", F.col("blob_id"), F.col("ordinal"))), RECORD)


# Members that hold the messages of a conversation, and those that name it.
MESSAGE_MEMBERS = ("messages", "items", "turns", "history", "entries", "parts")
MESSAGE_MAPS = ("messageMap", "mapping")
ID_MEMBERS = ("id", "sessionId", "conversationId", "chatId")
TIME_MEMBERS = ("timestamp", "createdAt", "created_at", "updatedAt", "updated_at", "time", "date", "sentAt", "create_time", "update_time", "startTime")


def message_time(message: Column) -> Column:
    """First usable time of a message: an ISO string or epoch milliseconds under any known name."""
    spelled = [F.coalesce(timekeys.coerce(jsonv.string(message, n)), timekeys.from_millis(jsonv.number(message, n))) for n in TIME_MEMBERS]
    return F.coalesce(*spelled)


def normalized_message(value: Column, default_cwd: Column) -> Column:
    """(observed_at, raw_json) of a message in any of the shapes exports use; null if it has neither role nor content.

    The message itself may sit under ``message`` or ``info``. Its content is a content member, the parts beside it or
    rich text; usage, stop reason, model and directory are looked for in it, then around it.
    """
    from turnwise.functions import roles, tokens
    from turnwise.sources.formats.core import first_present
    from turnwise.sources.formats.generic import generic_role

    def inner(name: str) -> Column:
        return bind(jsonv.member(value, name), lambda m: F.when(jsonv.is_object(m), m))

    def build(held: Column) -> Column:
        base, info = held.getField("base"), held.getField("info")
        content = F.coalesce(first_present(base, "content", "items", "text"), first_present(value, "parts"), first_present(base, "richText"), first_present(value, "richText"))
        role = F.coalesce(generic_role(base), generic_role(value), generic_role(info))
        at = F.coalesce(
            *[timekeys.coerce(jsonv.string(base, n)) for n in ("timestamp", "createdAt", "updatedAt")],
            timekeys.coerce(jsonv.string(value, "timestamp")),
            timekeys.coerce(jsonv.string(info, "createdAt")),
            *[timekeys.from_millis(jsonv.number(base, n)) for n in ("timestamp", "createdAt", "created")],
            *[timekeys.from_millis(jsonv.number(info, n)) for n in ("createdAt", "created")],
            timekeys.from_millis(jsonv.number(value, "createdAt")),
            message_time(value),
        )
        stop = F.coalesce(jsonv.string(base, "stop_reason", "stopReason"), jsonv.string(info, "stopReason"), jsonv.string(value, "stopReason"))
        record = F.struct(
            F.coalesce(jsonv.string(base, "id"), jsonv.string(value, "id")).alias("id"),
            F.coalesce(role, F.lit("assistant")).alias("role"),
            content.alias("content"),
            F.get(F.array_compact(F.transform(F.array(value, info, base), lambda v: tokens.extract(v))), F.lit(0)).alias("usage"),
            roles.normalize_stop_reason(stop).alias("stopReason"),
            F.coalesce(jsonv.string(base, "model"), jsonv.string(info, "model"), jsonv.string(value, "model")).alias("model"),
            F.coalesce(jsonv.string(value, "cwd", "workspacePath", "directory"), default_cwd).alias("cwd"),
        )
        return F.when(role.isNotNull() | content.isNotNull(), F.struct(at.alias("observed_at"), F.to_json(record).alias("raw_json"), role.alias("role")))

    message, info = inner("message"), inner("info")
    return bind(F.struct(F.coalesce(message, info, value).alias("base"), info.alias("info")), build)


def read_conversation_docs(docs: DataFrame, containers: tuple[str, ...] = ("conversations", "sessions", "chats", "data")) -> DataFrame:
    """Messages of exported conversations: (origin_path, conversation_id, position, observed_at, raw_json), metadata first.

    ``docs`` gives (origin_path, v). A document is one conversation, a list of them, or holds a list under one of the
    declared container members. Conversations of one id in a document are one: the first one's metadata, and the
    distinct messages of all in order of time. Conversations without a user or assistant row are dropped.
    """
    v = F.col("v")
    many = F.concat(*[jsonv.array(v, c) for c in containers])
    itself = F.try_variant_get(v, "$", "array<variant>")
    convs = F.when(jsonv.is_array(v), itself).when(F.size(many) > 0, many).otherwise(F.array(v))
    held = docs.select("origin_path", F.posexplode(convs).alias("conv_no", "c"))
    c = F.col("c")
    mapped = F.map_values(F.coalesce(*[F.try_variant_get(c, f"$.{m}", "map<string,variant>") for m in MESSAGE_MAPS]))
    listed = F.coalesce(*[F.try_variant_get(c, f"$.{m}", "array<variant>") for m in MESSAGE_MEMBERS], mapped, F.array().cast("array<variant>"))
    stem = F.regexp_replace(F.element_at(F.split("origin_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    named = held.select(
        "origin_path",
        F.coalesce(jsonv.string(c, *ID_MEMBERS), F.concat(stem, F.lit("-"), F.col("conv_no"))).alias("conversation_id"),
        "conv_no",
        F.to_json(F.struct(*[jsonv.member(c, n).alias(n) for n in ("title", "model", "cwd", "directory", "createdAt", "updatedAt")])).alias("head"),
        message_time(c).alias("head_at"),
        jsonv.string(c, "cwd", "directory").alias("cwd"),
        F.filter(listed, jsonv.is_object).alias("messages"),
    )
    key = ["origin_path", "conversation_id"]
    each = named.select(*key, "conv_no", "cwd", F.posexplode("messages").alias("place", "m"))
    said = each.select(*key, "conv_no", "place", normalized_message(F.col("m"), F.col("cwd")).alias("r")).where(F.col("r").isNotNull())
    # Repeats of a message keep the place of the first one; untimed messages stay in front, in the order given.
    first = said.groupBy(*key, "r.raw_json", "r.observed_at", "r.role").agg(F.min(F.struct("conv_no", "place")).alias("at"))
    flat = materialize(first.select(*key, "raw_json", "observed_at", "role", "at.conv_no", "at.place"), "messages")
    spoken = flat.where(F.col("role").isin("user", "assistant")).select(*key).distinct()
    heads = named.groupBy(*key).agg(F.min_by(F.struct("head", "head_at"), "conv_no").alias("h")).join(spoken, key, "left_semi")
    meta = heads.select(*key, F.lit(-1).cast("bigint").alias("position"), F.col("h.head_at").alias("observed_at"), F.col("h.head").alias("raw_json"))
    rows = with_position(flat.join(spoken, key, "left_semi"), key, ["observed_at", "conv_no", "place"], "position")
    return meta.unionByName(rows.select(*key, F.col("position").cast("bigint").alias("position"), "observed_at", "raw_json"))


def records_from_steps(steps: DataFrame) -> DataFrame:
    """Message records of a recorded trajectory: ``steps`` gives (session_ref, position, v)."""
    v = F.col("v")
    kind = F.regexp_replace(jsonv.string(v, "type"), "^CORTEX_STEP_TYPE_", "")
    user = jsonv.string(v, "userInput.userResponse", "userInput.text", "userInput.items[0].text")
    planned = jsonv.string(v, "plannerResponse.modifiedResponse", "plannerResponse.response", "plannerResponse.text")
    told = jsonv.string(v, "notifyUser.notificationContent", "notifyUser.message", "taskBoundary.taskSummary", "taskBoundary.taskName")
    failed = jsonv.string(v, "errorMessage.error.userErrorMessage", "errorMessage.message")
    role = F.when(kind == "USER_INPUT", "user").when(kind == "ERROR_MESSAGE", "system").otherwise("assistant")
    content = F.when(kind == "USER_INPUT", user).when(kind == "ERROR_MESSAGE", failed).otherwise(F.coalesce(planned, told))
    at = F.coalesce(timekeys.coerce(jsonv.string(v, "metadata.createdAt", "createdAt")), F.lit(None).cast("string"))
    tool = F.when(content.isNull() & kind.isNotNull(), F.lower(kind))
    call = F.struct(F.lit("tool_call").alias("type"), tool.alias("name"), jsonv.string(v, "id").alias("id"), v.alias("input"))
    body = F.when(tool.isNull(), F.to_json(F.struct(role.alias("role"), content.alias("content")))).otherwise(
        F.to_json(F.struct(F.lit("assistant").alias("role"), F.array(call).alias("content")))
    )
    return steps.where(kind.isNotNull()).select("session_ref", "position", at.alias("observed_at"), body.alias("raw_json"))
