"""Exports and compact projections.

An export is a folder of line files and a manifest. Rows are dealt to tasks by the range of their place, every task
writes one file under a name of its own, and the commit gives the files of the attempts that count their final names, in
order, writes the manifest with their kinds, lines, bytes and checksums, and deletes what other attempts left. Without a
manifest there is no export.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pyarrow
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from turnwise.functions import timekeys
from turnwise.sources import ranges

MANIFEST, UNFINISHED = "manifest.json", "_unfinished"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri:
        scheme, colon, rest = uri.partition(":/")
        uri = f"{scheme}:///{rest.lstrip('/')}" if colon else f"file://{uri}"
    return pyarrow.fs.FileSystem.from_uri(uri)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    lines: int = 0
    bytes: int = 0
    sha256: str = ""
    kinds: Counter = field(default_factory=Counter)


class LineWriter(DataSourceWriter):
    """Writes rows (kind, line) of a partition as one file, and all files as one export."""

    def __init__(self, path: str, suffix: str, title: str) -> None:
        self.path, self.suffix, self.title = path, suffix, title

    def write(self, rows) -> Part:
        fs, root = _open(self.path)
        folder = f"{root}/{UNFINISHED}"
        fs.create_dir(folder, recursive=True)
        part = Part(TaskContext.get().partitionId(), uuid.uuid4().hex)
        sha = hashlib.sha256()
        with fs.open_output_stream(f"{folder}/{part.name}", compression=None) as out:
            for kind, line in rows:
                data = f"{line}\n".encode()
                out.write(data)
                sha.update(data)
                part.lines, part.bytes = part.lines + 1, part.bytes + len(data)
                part.kinds[kind] += 1
        part.sha256 = sha.hexdigest()
        return part

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        kept = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.partition)
        parts = []
        for number, part in enumerate(kept):
            name = f"part-{number:06d}.{self.suffix}"
            fs.move(f"{root}/{UNFINISHED}/{part.name}", f"{root}/{name}")
            parts.append({"name": name, "lines": part.lines, "bytes": part.bytes, "sha256": part.sha256, "kinds": dict(part.kinds)})
        self._clear(fs, root)
        total = Counter()
        for part in kept:
            total.update(part.kinds)
        said = {"title": self.title, "lines": sum(total.values()), "kinds": [[k, total[k]] for k in EXPORT_KINDS if total[k]], "parts": parts}
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(said, indent=1).encode())

    def abort(self, messages) -> None:
        self._clear(*_open(self.path))

    @staticmethod
    def _clear(fs: pyarrow.fs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{UNFINISHED}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{root}/{UNFINISHED}")


class LineExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_export"

    def schema(self) -> str:
        return "kind string, line string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], self.options.get("suffix", "txt"), self.options.get("title", ""))


def write_export(rows: DataFrame, path: str, suffix: str, title: str) -> None:
    """Write rows (rank, k1, k2, k3, kind, line) in this order; ``path`` must not hold an export yet."""
    spark = rows.sparkSession
    fs, root = _open(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an export")
    spark.dataSource.register(LineExport)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["rank", "k1", "k2", "k3"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("kind", "line")
    placed.write.format("line_export").mode("append").option("suffix", suffix).option("title", title).save(path)


def read_manifest(path: str) -> dict:
    fs, root = _open(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """(place, line) of an export of one JSON object a line, numbered over all its files."""
    fs, root = _open(path)
    base, rows = 0, []
    for part in read_manifest(path)["parts"]:
        rows.append((f"{path.rstrip('/')}/{part['name']}", part["name"], part["bytes"], base))
        base += part["lines"]
    files = spark.createDataFrame(rows, "uri string, origin_path string, length long, base long")
    return ranges.numbered_lines(files).select(F.col("ordinal").alias("place"), F.col("raw_json").alias("line"))


def broken_parts(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the files of an export whose bytes are not those of the manifest; each is read by one task, in blocks."""
    parts = [(f"{path.rstrip('/')}/{p['name']}", p["name"], p["bytes"], p["sha256"]) for p in read_manifest(path)["parts"]]

    def check(batches):
        for batch in batches:
            wrong = []
            for uri, name, size, want in zip(*(c.to_pylist() for c in batch.columns)):
                file, sha = ranges.Bytes(uri), hashlib.sha256()
                for block in file.blocks(0, file.length):
                    sha.update(block)
                if file.length != size or sha.hexdigest() != want:
                    wrong.append(name)
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array(wrong, pyarrow.string())], names=["name"])

    listed = spark.createDataFrame(parts, "uri string, name string, size long, sha256 string")
    return listed.repartition(max(1, len(parts)), "name").mapInArrow(check, "name string")


# Object kinds in export order.
EXPORT_KINDS = ("manifest", "host", "source", "project", "session", "related_work", "turn", "context", "ask_user_question", "loss_audit")
#: What orders the rows of a kind: times (newest first), then an id.
ORDER = {
    "source": ((), "source_id"),
    "project": ((), "project_id"),
    "session": (("updated_at", "created_at"), "session_ref"),
    "related_work": ((), "id"),
    "turn": (("submission_started_at", "created_at"), "turn_id"),
    "context": ((), "turn_id"),
    "ask_user_question": ((), "turn_id"),
    "loss_audit": ((), "audit_id"),
}


def _placed(df: DataFrame, kind: str, line: Column) -> DataFrame:
    times, key = ORDER.get(kind, ((), None))
    at = [-timekeys.millis(F.col(c)) for c in times if c in df.columns]
    at += [F.lit(0)] * (2 - len(at))
    last = F.col(key).cast("string") if key in df.columns else line
    return df.select(F.lit(EXPORT_KINDS.index(kind)).alias("rank"), at[0].cast("bigint").alias("k1"), at[1].cast("bigint").alias("k2"), last.alias("k3"), F.lit(kind).alias("kind"), line.alias("line"))


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows


def export_rows(tables: dict[str, DataFrame], schema: str) -> DataFrame:
    """One JSON line per object, ``{schema, kind, value}``, with its place: kinds in fixed order, rows as ORDER tells."""
    made = []
    for kind in EXPORT_KINDS:
        if kind in tables:
            value = F.struct(*[F.col(c) for c in tables[kind].columns])
            made.append(_placed(tables[kind], kind, F.to_json(F.struct(F.lit(schema).alias("schema"), F.lit(kind).alias("kind"), value.alias("value")))))
    return _union(made)


def export_jsonl(tables: dict[str, DataFrame], path: str, schema: str = "transcript-export/v1") -> None:
    """Write all tables as one export of JSON lines; a line's place in it is the same in every run."""
    write_export(export_rows(tables, schema), path, "jsonl", schema)


def markdown_rows(tables: dict[str, DataFrame], title: str = "Transcript export") -> DataFrame:
    """Lines of a readable export: a head with the number of objects of each kind, then the turns, newest first."""
    names = [k for k in EXPORT_KINDS if k in tables]
    counts = [tables[k].agg(F.lit(n).cast("bigint").alias("k1"), F.concat(F.lit(f"- {k}: "), F.count("*").cast("string")).alias("line")) for n, k in enumerate(names)]
    spark = tables["turn"].sparkSession
    fixed = spark.createDataFrame([(-2, f"# {title}\n"), (len(names), "\n## Turns\n")], "k1 bigint, line string")
    head = _union([fixed, *counts]).select(F.lit(0).alias("rank"), "k1", F.lit(0).cast("bigint").alias("k2"), F.lit("").alias("k3"), F.lit("manifest").alias("kind"), "line")
    block = F.concat(F.lit("### "), F.coalesce("submission_started_at", F.lit("-")), F.lit(" · "), "turn_id", F.lit("\n\n"), F.coalesce("canonical_text", F.lit("")), F.lit("\n"))
    return head.unionByName(_placed(tables["turn"], "turn", block))


def export_markdown(tables: dict[str, DataFrame], path: str, title: str = "Transcript export") -> None:
    """Write a head with counts and the turns, newest first, as one export of text."""
    write_export(markdown_rows(tables, title), path, "md", title)


# Members of the compact form of each entity.
COMPACT = {
    "source": ("source_id", "slot_id", "display_name", "sync_status", "total_sessions", "total_turns"),
    "project": ("project_id", "display_name", "linkage_state", "primary_workspace_path", "repo_root", "session_count", "turn_count", "last_activity_at"),
    "session": (
        "session_ref", "source_id", "source_platform", "title", "created_at", "updated_at", "activity_at", "turn_count", "working_directory",
        "source_session_id", "primary_project_id",
    ),
    "turn": ("turn_id", "session_ref", "source_id", "project_id", "submission_started_at", "last_context_activity_at", "link_state", "model", "assistant_reply_count"),
    "reply": ("reply_id", "created_at", "model", "stop_reason", "canonical_text"),
    "related_work": ("id", "relation_kind", "direction", "target_session_ref", "status"),
    "loss_audit": ("audit_id", "stage_kind", "diagnostic_code", "severity", "detail"),
}


def compact(kind: str, df: DataFrame) -> DataFrame:
    """The compact form of an entity table: fixed members, null where the table does not know one."""
    derived = {
        "project": {
            "turn_count": lambda: F.col("committed_turn_count") + F.col("candidate_turn_count"),
            "last_activity_at": lambda: F.coalesce("project_last_activity_at", "updated_at"),
        },
        "session": {"title": lambda: F.col("canonical_title"), "activity_at": lambda: F.coalesce("last_message_at", "updated_at") if "last_message_at" in df.columns else F.col("updated_at")},
        "turn": {"model": lambda: F.col("primary_model")},
    }.get(kind, {})
    present = set(df.columns)
    return df.select(
        *[
            (derived[name]() if name in derived else F.col(name) if name in present else F.lit(None).cast("string")).alias(name)
            for name in COMPACT[kind]
        ]
    )
