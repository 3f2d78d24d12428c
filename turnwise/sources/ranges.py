"""Files read by byte ranges: lines, digests and tails in bounded memory, however long a file is.

A file is cut into ranges of equal size; a task reads one of them, or several small ones. A line belongs to the range in which it
begins, so CR, LF and CRLF at the edge of a range, and lines longer than one, need no special care elsewhere. Ranges are
read twice for lines: first they are only counted, and a running sum over the ranges of a file (not over its lines) gives
the number each range begins with, so lines are numbered densely without being sorted or moved.

Files are opened by the tasks through pyarrow's file systems (local or mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.session import materialize

#: Bytes of a range, of a chunk with a digest of its own, and of one read.
RANGE_BYTES, CHUNK_BYTES, BLOCK_BYTES = 64 << 20, 64 << 20, 4 << 20
#: Bytes at the end of a file in which its last records are looked for, and how many of them count.
TAIL_BYTES, TAIL_RECORDS = 64 << 10, 5
#: A task of file reading gets about so many bytes or ranges, whichever are fewer; what would make fewer tasks than so
#: many to a core is cut finer, and no stage has more tasks than the last of these.
TASK_BYTES, TASK_ROWS, TASKS_PER_CORE, MOST_TASKS = 64 << 20, 1024, 4, 100_000
#: Bytes read at a time behind the end of a range, where only its last line is finished.
LOOK_BYTES = 4 << 10
#: What is cut off around a line: the blanks and line ends of ECMAScript's trim (fixed values).
BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def plain_path(path: Column) -> Column:
    """Path of a file without scheme and percent signs, as transcripts name it."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def listed(spark: SparkSession, roots: str | list[str], glob: str | None = None) -> DataFrame:
    """(uri, origin_path, length, modificationTime) of the files under the roots that are not empty; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(roots).select(F.col("path").alias("uri"), plain_path(F.col("path")).alias("origin_path"), "length", "modificationTime")


def dealt(work: DataFrame, begin: str | None, end: str) -> DataFrame:
    """Rows of a written table of work (uri, and columns with the bytes they begin and end at), spread over tasks by bytes and number.

    Many small ranges share a task, and those next to each other in a file meet there in order, so a file is not opened
    anew for each. Without ``begin`` a row is a whole file.
    """
    size = F.col(end) - F.col(begin) if begin else F.col(end)
    rows, total = work.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    cores = work.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-int(total) // TASK_BYTES), -(-rows // TASK_ROWS), cores * TASKS_PER_CORE)
    near = [F.col("uri"), *([F.floor(F.col(begin) / TASK_BYTES)] if begin else [])]
    return work.repartition(max(1, min(rows, tasks, MOST_TASKS)), *near).sortWithinPartitions("uri", *([begin] if begin else []))


class Bytes:
    """A file read forward in blocks."""

    def __init__(self, uri: str) -> None:
        if "://" not in uri:
            scheme, colon, rest = uri.partition(":/")
            uri = f"{scheme}:///{rest.lstrip('/')}" if colon else f"file://{uri}"
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.length = self.file.size()

    def close(self) -> None:
        self.file.close()

    def read(self, start: int, end: int) -> bytes:
        """Bytes from ``start`` to ``end``, fewer where the file ends."""
        self.file.seek(start)
        return self.file.read(max(min(end, self.length) - start, 0))

    def blocks(self, start: int, end: int) -> Iterator[bytes]:
        end = min(end, self.length)
        for at in range(start, end, BLOCK_BYTES):
            yield self.read(at, min(at + BLOCK_BYTES, end))


class Opener:
    """Opens files, each only once as long as it is asked for again and again."""

    def __init__(self) -> None:
        self.uri, self.file = None, None

    def __call__(self, uri: str) -> Bytes:
        if uri != self.uri:
            if self.file is not None:
                self.file.close()
            self.uri, self.file = uri, Bytes(uri)
        return self.file


def pieces(file: Bytes, start: int, end: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, content) of what lies between line ends and begins from ``start`` to ``end``; a file counts up to ``length``."""
    at = ahead = start
    held = b""
    while ahead < length and at < end:
        # Little is read behind the end; a line longer than a block is read in ever longer ones.
        step, until = (BLOCK_BYTES, end) if ahead < end else (LOOK_BYTES, length)
        block = file.read(ahead, min(ahead + max(step, len(held)), until))
        if not block:
            break
        ahead += len(block)
        found = (held + block).splitlines(keepends=True)
        # The last one may go on, or its CR may be the first half of CRLF.
        held = found.pop() if ahead < length and not found[-1].endswith(b"\n") else b""
        for piece in found:
            if at >= end:
                return
            yield at, piece.rstrip(b"\r\n")
            at += len(piece)
    if held and at < end:
        yield at, held.rstrip(b"\r\n")


def _next_line(file: Bytes, start: int, end: int) -> int:
    """The byte behind the first line end from ``start`` to ``end``, or ``end``."""
    at = start
    for block in file.blocks(start, end):
        ends = [k for k in (block.find(b"\n"), block.find(b"\r")) if k >= 0]
        if ends:
            at += min(ends)
            return at + (2 if file.read(at, at + 2) == b"\r\n" else 1)
        at += len(block)
    return end


def lines(file: Bytes, start: int, end: int, length: int) -> Iterator[tuple[int, str]]:
    """(first byte, text) of the lines that begin from ``start`` to ``end`` and are not blank, without blanks around."""
    first = start
    if start:
        around = file.read(start - 1, start + 1)
        if around == b"\r\n":
            first = start + 1
        elif around[:1] not in (b"\n", b"\r"):
            first = _next_line(file, start, end)
    for at, piece in pieces(file, first, end, length):
        text = piece.decode("utf-8", "replace").strip(BLANKS)
        if text:
            yield at, text


_RANGE = "uri string, origin_path string, length long, base long, mark string, begin long, end long"
_LINE = "origin_path string, mark string, ordinal long, at long, raw_json string"


def byte_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Ranges of files (uri, origin_path, length, and start, base and mark where they are given)."""
    given = [(F.col(c) if c in files.columns else F.lit(none)).cast(kind).alias(c) for c, none, kind in (("start", 0, "long"), ("base", 0, "long"), ("mark", None, "string"))]
    held = files.select("uri", "origin_path", "length", *given).filter("start < length")
    begin = F.explode(F.sequence("start", F.col("length") - 1, F.lit(size).cast("long"))).alias("begin")
    return held.select("uri", "origin_path", "length", "base", "mark", begin).withColumn("end", F.least(F.col("begin") + size, "length"))


def numbered_lines(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(origin_path, mark, ordinal, at, raw_json) of every line that is not blank, in ranges of ``size`` bytes.

    ``files`` has (uri, origin_path, length) as ``listed`` gives them, and may have ``start``, the byte to begin at,
    ``base``, the number of the first line there, and ``mark``, a text that its lines are to carry. Bytes behind ``length`` are not read, so a file that grows meanwhile
    gives what it held when it was listed. Ordinals are dense and the same whatever the size of a range; bytes that are
    no UTF-8 become U+FFFD. An empty file gives no line.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opener()
        for batch in batches:
            uris, lengths, begins, ends = (batch.column(k).to_pylist() for k in (0, 2, 5, 6))
            found = [sum(1 for _ in lines(opened(u), b, e, n)) for u, n, b, e in zip(uris, lengths, begins, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "n"])

    work = materialize(byte_ranges(files, size), "byte-ranges")
    counted = materialize(dealt(work, "begin", "end").mapInArrow(count, f"{_RANGE}, n long"), "line-counts")
    # As many rows as a file has ranges.
    before = Window.partitionBy("uri").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))
    based = materialize(counted.withColumn("base", first).filter("n > 0").drop("n"), "line-bases")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, rows, held = Opener(), [], 0
        for batch in batches:
            for uri, path, length, base, mark, begin, end in zip(*(batch.column(k).to_pylist() for k in range(7))):
                for ordinal, (at, text) in enumerate(lines(opened(uri), begin, end, length), base):
                    rows.append((path, mark, ordinal, at, text))
                    held += len(text)
                    if held >= BLOCK_BYTES or len(rows) == 4096:
                        yield _line_batch(rows)
                        rows, held = [], 0
        if rows:
            yield _line_batch(rows)

    return dealt(based, "begin", "end").mapInArrow(read, _LINE)


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["origin_path", "mark", "ordinal", "at", "raw_json"])


def extent_digests(extents: DataFrame) -> DataFrame:
    """Add digest (SHA-1) and last_byte to rows of (uri, origin_path, chunk, begin, end); both null where the file is shorter."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opener()
        for batch in batches:
            out = []
            for uri, begin, end in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                file, sha, last, read = opened(uri), hashlib.sha1(), None, 0
                for block in file.blocks(begin, end):
                    sha.update(block)
                    last, read = block[-1], read + len(block)
                out.append((sha.hexdigest(), last) if read == end - begin else (None, None))
            digests, lasts = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(lasts, pa.int32())], names=[*batch.schema.names, "digest", "last_byte"])

    work = materialize(extents.select("uri", "origin_path", "chunk", "begin", "end"), "extents")
    return dealt(work, "begin", "end").mapInArrow(digest, "uri string, origin_path string, chunk long, begin long, end long, digest string, last_byte int")


def chunk_digests(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """(uri, origin_path, chunk, begin, end, digest, last_byte) of every chunk of ``size`` bytes, the last one shorter."""
    cut = byte_ranges(files, size)
    return extent_digests(cut.select("uri", "origin_path", F.floor(F.col("begin") / size).cast("long").alias("chunk"), "begin", "end"))


def file_digests(files: DataFrame) -> DataFrame:
    """(uri, origin_path, length, checksum, said): SHA-1 of every file, and the timestamps its last records say.

    A file passes through one task block by block, since SHA-1 has no parallel form; ``extent_digests`` has one. ``said``
    lists the text under ``timestamp`` (null if it is no text) of the last TAIL_RECORDS lines that are JSON, from the
    last on, within the last TAIL_BYTES; a line that begins before them does not count.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Opener()
        for batch in batches:
            checksums, said = [], []
            for uri, length in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                file, sha = opened(uri), hashlib.sha1()
                for block in file.blocks(0, length):
                    sha.update(block)
                checksums.append(sha.hexdigest())
                said.append(_last_said(file, length))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(checksums, pa.string()), pa.array(said, pa.list_(pa.string()))], names=[*batch.schema.names, "checksum", "said"])

    work = materialize(files.select("uri", "origin_path", "length"), "files")
    return dealt(work, None, "length").mapInArrow(digest, "uri string, origin_path string, length long, checksum string, said array<string>")


def _last_said(file: Bytes, length: int) -> list[str | None]:
    start, said = max(0, length - TAIL_BYTES), []
    for _, text in reversed(list(lines(file, start, length, length))):
        try:
            value = json.loads(text)
        except ValueError:
            continue
        stamp = value.get("timestamp") if isinstance(value, dict) else None
        said.append(stamp if isinstance(stamp, str) and stamp else None)
        if len(said) == TAIL_RECORDS:
            break
    return said
