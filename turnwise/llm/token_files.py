"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, one after the other:

* frames: each the ids (little-endian unsigned 32-bit) of one or more whole documents, compressed by itself;
* a skippable frame with the directory: per document its id, the frame it is in, its first byte there and its length;
* a skippable frame with the seek table of the zstandard seekable format: per frame its compressed and plain size and
  the low 32 bits of the XXH64 of its plain bytes, then the number of frames and the closing magic number.

Any zstandard reader decompresses the file as a whole. A reader that wants some documents reads the two tables at the
end, then only the frames that hold them, and checks each frame it reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import file_uri, materialize
from turnwise.llm.encoding import encoder

#: Fixed by the zstandard format: the kinds of skippable frame used, and the end of a seek table.
SEEK_KIND, DIRECTORY_KIND = 0x184D2A5E, 0x184D2A5D
SEEK_MAGIC = 0x8F92EAB1
#: Plain bytes at which a frame is closed, and a file; a longer document makes a longer frame.
FRAME_BYTES, FILE_BYTES = 128 << 10, 256 << 20

_ENTRY = np.dtype([("doc_id", "<i8"), ("known", "<u4"), ("frame", "<u4"), ("at", "<u8"), ("size", "<u8")])


class ShardWriter:
    """Writes one file. Every attempt of a task has names of its own; which files count is told by the table of files."""

    def __init__(self, uri: str) -> None:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.out = fs.open_output_stream(path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=1, write_checksum=False)
        self.pending: list[bytes] = []
        self.pending_bytes = self.bytes = 0
        self.seek: list[tuple[int, int, int]] = []
        self.entries: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.entries.append((doc_id or 0, int(doc_id is not None), len(self.seek), self.pending_bytes, len(ids)))
        self.pending.append(ids)
        self.pending_bytes += len(ids)
        self.bytes += len(ids)
        if self.pending_bytes >= FRAME_BYTES:
            self._close_frame()

    def _close_frame(self) -> None:
        plain = b"".join(self.pending)
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.seek.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.pending_bytes = [], 0

    def close(self) -> None:
        if self.pending:
            self._close_frame()
        directory = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(struct.pack("<II", DIRECTORY_KIND, len(directory) + 8) + directory + struct.pack("<Q", len(self.entries)))
        table = b"".join(struct.pack("<III", *row) for row in self.seek)
        self.out.write(struct.pack("<II", SEEK_KIND, len(table) + 9) + table + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC))
        self.out.close()


class ShardReader:
    def __init__(self, uri: str) -> None:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.uri, self.file, size = uri, fs.open_input_file(path), fs.get_file_info(path).size
        frames, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{uri}: no seek table with checksums at the end")
        table_at = size - 9 - 12 * frames
        self.seek = np.frombuffer(self._read(table_at, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        (count,) = struct.unpack("<Q", self._read(table_at - 16, 8))
        self.entries = np.frombuffer(self._read(table_at - 16 - count * _ENTRY.itemsize, count * _ENTRY.itemsize), _ENTRY)
        self.starts = np.concatenate([[0], np.cumsum(self.seek[:, 0])]).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        packed, plain, check = (int(x) for x in self.seek[k])
        data = self.unzip.decompress(self._read(int(self.starts[k]), packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.uri}: frame {k} does not match its checksum")
        return data

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, place in the file, ids) of all documents, or of the wanted ids; other frames are not read."""
        chosen = np.arange(len(self.entries))
        if wanted is not None:
            chosen = np.flatnonzero(np.isin(self.entries["doc_id"], np.array(list(wanted), np.int64)) & (self.entries["known"] == 1))
        last, data = -1, b""
        for place in chosen.tolist():
            doc_id, known, frame, at, size = (int(x) for x in self.entries[place])
            if frame != last:
                last, data = frame, self.frame(frame)
            yield doc_id if known else None, place, data[at : at + size]


_FILES = "shard bigint, part bigint, uri string"
_IDS = "doc_id bigint, shard bigint, part bigint, place bigint, ids binary"


def _write(path: str, end_id: int | None, folder: str):
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, writer, done, attempt = None, 0, None, [], uuid.uuid4().hex
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py() if shard is None else shard
            ids, counts = encoder(path).encoded(batch.column(1))
            ids, ends = ids.astype("<u4", copy=False), np.cumsum(counts)
            for doc_id, first, last in zip(batch.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                if writer is None:
                    done.append((shard, part, f"{folder}/ids-{shard:08d}-{part:05d}-{attempt}.zst"))
                    writer, part = ShardWriter(done[-1][2]), part + 1
                writer.add(doc_id, ids[first:last].tobytes() + end)
                if writer.bytes >= FILE_BYTES:
                    writer.close()
                    writer = None
        if writer is not None:
            writer.close()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["shard", "part", "uri"])

    return write


def write_token_files(documents: DataFrame, path: str, folder: str, end_id: int | None = 1) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending doc_id order; returns (shard, part, uri).

    The order of (shard, part) and the place in a file is the order of doc_id, nulls last; rows of one id, or of none, come
    in the order of a hash of their texts and may spread over several files. ``folder`` is a shared folder; null texts are
    empty and hold the end id only; an empty table writes no file. Texts are moved once, before they are encoded, and each
    task writes what it has sorted. A file counts once the task that wrote it is committed to the table returned; files of
    attempts that were lost are deleted then.
    """
    spark = documents.sparkSession
    folder = file_uri(folder)
    target, local = pa.fs.FileSystem.from_uri(folder)
    target.create_dir(local, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    # Rows equal in id and text may be a third of all, so their place in the input cuts between them.
    keyed = texts.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    key = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("place")]
    sorted_texts = keyed.repartitionByRange(parts, *key).sortWithinPartitions(*key).select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    files = materialize(sorted_texts.mapInArrow(_write(path, end_id, folder), _FILES), "token-files")
    _sweep(files, folder)
    return files


def _sweep(files: DataFrame, folder: str) -> None:
    """Delete token files of the folder that no committed task has written."""

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(1).to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(file_uri(uri))
                fs.delete_file(path)
            yield batch.select([0])

    name = lambda uri: F.element_at(F.split(uri, "/"), -1)
    written = files.select(name("uri").alias("name"))
    there = files.sparkSession.read.format("binaryFile").option("pathGlobFilter", "ids-*.zst").load(folder).select(name("path").alias("name"), "path")
    there.join(written, "name", "left_anti").mapInArrow(delete, "name string").write.format("noop").mode("overwrite").save()


def _per_file(files: DataFrame) -> DataFrame:
    """The table of files dealt to one task each."""
    return files.repartition(max(1, min(files.count(), 100_000)), F.col("shard"), F.col("part"))


def read_token_files(files: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, shard, part, place, ids) of all documents of the files, or of the wanted ids only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, uri in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows, size = [], 0
                for doc_id, place, ids in ShardReader(uri).documents(wanted):
                    rows.append((doc_id, shard, part, place, ids))
                    size += len(ids)
                    if size >= 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)

    return _per_file(files).mapInArrow(read, _IDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.binary())], names=["doc_id", "shard", "part", "place", "ids"])


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files to one row per document: where it begins in its file, its ids and their checksum."""
    for batch in batches:
        for shard, part, uri in zip(*(batch.column(k).to_pylist() for k in range(3))):
            at, rows = 0, []
            for doc_id, _, ids in ShardReader(uri).documents():
                rows.append((doc_id, shard, part, at, len(ids) // 4, zlib.crc32(ids)))
                at += len(ids) // 4
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_SUMMARY)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=_SUMMARY)


_SUMMARY = ["doc_id", "shard", "part", "at", "n_tokens", "ids_crc32"]


def token_layout(files: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    read = materialize(_per_file(files).mapInArrow(_summary, ", ".join(f"{c} bigint" for c in _SUMMARY)), "token-layout")
    sizes = read.groupBy("shard", "part").agg(F.sum("n_tokens").alias("ids"))
    # One row per file of up to FILE_BYTES; the running sum over them is the only thing one task does alone.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return read.join(bases, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
