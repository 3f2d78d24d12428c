"""Files that are read, captured and followed while they grow, and streams, over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.ordered import with_position
from turnwise.functions.tokens import FIELDS
from turnwise.plans.catalog.linking import ISO
from turnwise.plans.catalog.registry import query
from turnwise.plans.catalog.usage import EV, TURNS
from turnwise.session import materialize, work_dir
from turnwise.sources import bridge, files
from turnwise.streaming import ingest

#: The pieces of transcript files that ``bridge.transcript_lines`` makes.
PIECES = f"""said AS (SELECT *, conv_id // 20 AS bucket, 'c' || (conv_id // 20) || '-' || (turn % 2) || '.jsonl' AS name,
      CASE conv_id // 20 % 3 WHEN 0 THEN chr(10) WHEN 1 THEN chr(13) || chr(10) ELSE chr(13) END AS ending,
      '{{"conv":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '","timestamp":"' || strftime(epoch_ms(1704067200000 + conv_id * 3600000 + ((turn * 7) % 5) * 60000), {ISO}) || '"}}' AS line
      FROM conversations),
    pieces AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY conv_id, turn) - 1 AS place, count(*) OVER (PARTITION BY name) AS n,
      line || ending || CASE WHEN turn % 3 = 0 THEN '  ' || ending ELSE '' END AS piece FROM said)"""


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def _written(spark, sf_dir):
    folder = work_dir(spark, "transcripts")
    bridge.write_files(bridge.transcript_lines(spark, sf_dir), folder)
    return folder


def _said(lines):
    read = {n: F.get_json_object("raw_json", f"$.{n}") for n in ("conv", "turn", "role")}
    return [read["conv"].cast("bigint").alias("conv"), read["turn"].cast("bigint").alias("turn"), read["role"].alias("role")]


LINES = f"WITH {PIECES} SELECT name, place AS ordinal, conv_id AS conv, turn, role FROM pieces"


@query("read_jsonl", LINES)
def read_jsonl(spark, sf_dir):
    records = files.read_jsonl(spark, _written(spark, sf_dir), "conv")
    return records.select(_name("origin_path").alias("name"), "ordinal", *_said(records))


@query("read_byte_ranges", LINES)
def read_byte_ranges(spark, sf_dir):
    """The same files in ranges of 256 bytes: lines, and their two line-end bytes, lie across the edges of most."""
    records = files.read_jsonl(spark, _written(spark, sf_dir), "conv", range_bytes=256)
    return records.select(_name("origin_path").alias("name"), "ordinal", *_said(records))


@query(
    "capture_files",
    f"""WITH {PIECES}, numbered AS (SELECT *, json_extract_string(line, '$.timestamp') AS said_at FROM pieces)
    SELECT name, CAST(sum(strlen(piece)) AS BIGINT) AS size_bytes, sha1(string_agg(piece, '' ORDER BY place)) AS checksum, max(said_at) FILTER (place >= n - 5) AS content_max_timestamp
    FROM numbered GROUP BY name""",
)
def capture_files(spark, sf_dir):
    return files.capture(spark, _written(spark, sf_dir), "conv").select(_name("origin_path").alias("name"), "size_bytes", "checksum", "content_max_timestamp")


@query(
    "inventory_files",
    f"""WITH {PIECES}, f AS (SELECT name, CAST(sum(strlen(piece)) AS BIGINT) AS length, CASE WHEN name LIKE '%-0.jsonl' THEN 1 ELSE 2 END AS priority FROM pieces GROUP BY name),
    r AS (SELECT *, row_number() OVER (ORDER BY priority, name) AS place FROM f WHERE NOT regexp_matches(name, 'c[0-9]*7-'))
    SELECT name, length, priority, 1 AS missing_roots FROM r WHERE place <= 30""",
)
def inventory_files(spark, sf_dir):
    """The first thirty files, those of even turns first, with one file in ten left out by its name, and one root that is missing."""
    folder = _written(spark, sf_dir)
    found = files.inventory(spark, [folder], r"/c[0-9]*[0-689]-[01]\.jsonl$", {r"-1\.jsonl$": 2, r"-0\.jsonl$": 1}, limit=30)
    missing = len(files.missing_roots(spark, [folder, f"{folder}-gone"]))
    return found.select(_name("path").alias("name"), "length", F.col("priority").cast("int").alias("priority"), F.lit(missing).alias("missing_roots"))


@query(
    "attach_sidecars",
    f"""WITH {PIECES} SELECT name, place AS ordinal, CAST(place AS VARCHAR) AS pointer, line AS raw_json FROM pieces
    UNION ALL SELECT name, max(n), 'meta.json', '{{"bucket":' || min(bucket) || '}}' FROM pieces WHERE bucket % 2 = 0 GROUP BY name""",
)
def attach_sidecars(spark, sf_dir):
    """Every other bucket has a document beside its two transcripts."""
    records = files.read_jsonl(spark, _written(spark, sf_dir), "conv")
    records = records.withColumn("pointer", F.coalesce("pointer", F.col("ordinal").cast("string")))
    buckets = bridge.transcript_lines(spark, sf_dir).filter("bucket % 2 = 0").select("bucket").distinct()
    sidecars = buckets.select(F.col("bucket").cast("string").alias("key"), F.to_json(F.struct("bucket")).alias("raw_json"))
    key = F.regexp_extract("origin_path", r"/c([0-9]+)-[01]\.jsonl$", 1)
    return files.attach_sidecars(records, sidecars, key, "meta.json").select(_name("origin_path").alias("name"), "ordinal", "pointer", "raw_json")


# --- files that grow ---------------------------------------------------------------------------------------------------

# By bucket: 0 and 1 are appended to (of 1 the last line was cut short), 2 stays, 3 gets another head, 4 is deleted; of
# every seventh bucket nothing is there at first.
HALF = "CASE bucket % 5 WHEN 0 THEN n // 2 WHEN 1 THEN n // 2 ELSE n END"
CHANGES = f"""{PIECES}, f AS (SELECT name, min(bucket) AS bucket, min(n) AS n, CAST(sum(strlen(piece)) AS BIGINT) AS length, CAST(coalesce(sum(strlen(piece)) FILTER (place < {HALF}), 0) AS BIGINT) AS before FROM pieces GROUP BY name),
    changes AS (SELECT *, CASE WHEN bucket % 7 = 6 OR (bucket % 5 = 0 AND n < 2) THEN 'new' WHEN bucket % 5 = 0 THEN 'appended' WHEN bucket % 5 = 2 THEN 'unchanged' WHEN bucket % 5 = 4 THEN 'gone' ELSE 'rewritten' END AS status
      FROM f WHERE NOT (bucket % 5 = 4 AND bucket % 7 = 6))"""


def _grown(spark, sf_dir):
    """Files followed over two runs; what became of them in the second, and the follower."""
    folder = work_dir(spark, "transcripts")
    pieces = materialize(bridge.transcript_lines(spark, sf_dir), "pieces")
    kind = F.col("bucket") % 5
    n = pieces.groupBy("name").agg(F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    held = pieces.join(n, "name").filter(F.col("bucket") % 7 != 6)
    cut = F.when((kind == 1) & (F.col("place") == half), F.substring("line", 1, 10))
    draft = F.when(kind == 3, F.concat(F.replace("line", F.lit('"role"'), F.lit('"part"')), "ending"))
    first = held.filter((kind > 1) | (F.col("place") < half) | (kind == 1) & (F.col("place") == half))
    bridge.write_files(first.withColumn("piece", F.coalesce(cut, draft, "piece")), folder)
    follower = ingest.GrowingFiles(spark, folder, work_dir(spark, "followed"), glob="*.jsonl", range_bytes=700, chunk_bytes=256)
    follower.run()
    bridge.write_files(pieces.filter((~kind.isin(2, 4)) | (F.col("bucket") % 7 == 6) & (kind == 2)), folder)
    bridge.delete_files(pieces.filter(kind == 4), folder)
    return follower.run(), follower


@query(
    "append_detection",
    f"""WITH {CHANGES} SELECT name, status, CASE status WHEN 'appended' THEN before WHEN 'unchanged' THEN length ELSE 0 END AS start,
    CASE status WHEN 'appended' THEN n // 2 WHEN 'unchanged' THEN n ELSE 0 END AS base FROM changes""",
)
def append_detection(spark, sf_dir):
    """Files written in two steps: which were appended to, and from which byte and record on they are read."""
    changes, _ = _grown(spark, sf_dir)
    return changes.select(_name("origin_path").alias("name"), "status", "start", "base")


@query(
    "stream_records",
    f"""WITH {CHANGES} SELECT p.name, p.place AS ordinal, CASE status WHEN 'rewritten' THEN 1 ELSE 0 END AS generation, conv_id AS conv, turn, role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
    FROM pieces p JOIN changes c ON c.name = p.name WHERE status <> 'gone'""",
)
def stream_records(spark, sf_dir):
    """Records after files were added, appended to, rewritten and deleted, gathered by conversation from two files each."""
    _, follower = _grown(spark, sf_dir)
    records = follower.records()
    told = records.select(_name("origin_path").alias("name"), "ordinal", F.col("generation").cast("int").alias("generation"), *_said(records))
    return with_position(told, ["conv"], ["turn", "name"], "pos")


# --- streams -----------------------------------------------------------------------------------------------------------


def _stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(
    "stream_sessions",
    f"WITH {TURNS} SELECT session_ref, count(*) AS turn_count, max(last_context_activity_at) AS last_activity_at FROM turns WHERE CAST(substr(turn_id, 3) AS BIGINT) % 10 <> 7 GROUP BY 1",
)
def stream_sessions(spark, sf_dir):
    """Sessions over turns that are delivered, delivered again, corrected and taken away, in no order."""
    _stateful(spark)
    source, target, state = work_dir(spark, "turns"), work_dir(spark, "sessions"), work_dir(spark, "state")
    number = F.substring("turn_id", 3, 20).cast("bigint")
    turns = bridge.usage_turns(spark, sf_dir).select("session_ref", "turn_id", number.alias("number"), F.col("last_context_activity_at").alias("right_at"))
    wrong = F.when(F.col("number") % 4 == 0, "2999-01-01T00:00:00.000Z").otherwise(F.col("right_at"))
    columns = ["session_ref", "turn_id"]
    deliveries = [
        turns.select(*columns, F.lit(1).alias("version"), wrong.alias("last_activity_at"), F.lit(False).alias("deleted")),
        turns.filter("number % 4 = 0").select(*columns, F.lit(2).alias("version"), F.col("right_at").alias("last_activity_at"), F.lit(False).alias("deleted")),
        turns.filter("number % 3 = 0").select(*columns, F.lit(1).alias("version"), wrong.alias("last_activity_at"), F.lit(False).alias("deleted")),
        turns.filter("number % 10 = 7").select(*columns, F.lit(3).alias("version"), F.lit(None).cast("string").alias("last_activity_at"), F.lit(True).alias("deleted")),
    ]
    for delivery in deliveries:
        delivery.write.mode("append").parquet(source)
        ingest.upsert_sessions(spark.readStream.schema(delivery.schema).parquet(source), target, state)
    return ingest.merged_sessions(spark, target)


# Fixed choice of what the counters count: running values of all seven fields, some of them left out now and then.
COUNTERS = {
    "input_tokens": ("floor(value)", "CAST(floor(value) AS BIGINT)"),
    "cache_read_input_tokens": ("k", "k"),
    "cache_creation_input_tokens": ("k % 40", "k % 40"),
    "cached_input_tokens": ("CASE WHEN k % 3 > 0 THEN k * 3 END", "CASE WHEN k % 3 > 0 THEN k * 3 END"),
    "output_tokens": ("k * 2", "k * 2"),
    "reasoning_output_tokens": ("event_id % 1000", "event_id % 1000"),
    "total_tokens": ("floor(value) + k * 3", "CAST(floor(value) AS BIGINT) + k * 3"),
}


@query(
    "stream_usage_deltas",
    f"""WITH {EV}, c AS (SELECT 'sess:ev:' || user_id AS session_ref, CAST(k % 2 AS VARCHAR) AS counter, event_id AS pos, {", ".join(f"{sql} AS {name}" for name, (_, sql) in COUNTERS.items())} FROM ev),
    peaks AS (SELECT *, {", ".join(f"coalesce(max({name}) OVER w, 0) AS peak_{name}" for name in FIELDS)} FROM c
      WINDOW w AS (PARTITION BY session_ref, counter ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT session_ref, counter, pos, {", ".join(f"greatest(coalesce({name}, 0) - peak_{name}, 0) AS {delta}" for name, delta in ingest.DELTAS.items())}
    FROM peaks WHERE pos >= (SELECT count(*) // 2 FROM events)""",
)
def stream_usage_deltas(spark, sf_dir):
    """Increments of a stream that starts from what a batch left, stops, and goes on with what is appended."""
    _stateful(spark)
    rows = bridge.events(spark, sf_dir).select(
        F.concat(F.lit("sess:ev:"), "user_id").alias("session_ref"), (F.col("k") % 2).cast("string").alias("counter"), F.col("event_id").alias("pos"), *[F.expr(e).cast("long").alias(n) for n, (e, _) in COUNTERS.items()]
    )
    rows = materialize(rows, "checkpoints")
    count = rows.count()
    source, target, state = work_dir(spark, "checkpoints"), work_dir(spark, "deltas"), work_dir(spark, "state")
    known = ingest.batch_peaks(rows.filter(F.col("pos") < count // 2))
    for part in (F.col("pos").between(count // 2, count * 3 // 4 - 1), F.col("pos") >= count * 3 // 4):
        rows.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        deltas = ingest.stream_usage_deltas(stream, known).writeStream.format("parquet").option("path", target).option("checkpointLocation", state)
        deltas.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(ingest.DELTA_SCHEMA).parquet(target)
