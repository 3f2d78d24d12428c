"""WARC archives: one record per page, equal payloads stored once, and a reader that follows verified boundaries.

Writing needs no Python: a record is the text of a row, and the blank lines behind it are the line separator, so Spark's
own text writer commits the files. A payload that an earlier page already has is a revisit record without body.

Reading cuts files into byte ranges. A task looks for the magic of a record in its range and gives, for each place that
has a well-formed header, the place where its successor must begin. Magic inside payloads gives such candidates too; which
ones are records is decided by following successors from the start of each file. Inside a range that is one backward pass
over its candidates, which leaves for each the first place beyond the range; between ranges it is pointer jumping over
the few places that ranges lead to, in a number of rounds that grows with the logarithm of the ranges of a file. A range
is then read again from the one place where the chain enters it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import discard, file_uri, join_split, materialize, work_dir

#: Payloads from this size on are stored once.
REVISIT_BYTES = 100
#: Bytes of a file that one task looks through, and of one read.
RANGE_BYTES, BLOCK_BYTES = 8 << 20, 1 << 20
#: Up to this many payloads that occur more than once (of about 100 bytes each) are broadcast to the pages.
BROADCAST_PAYLOADS = 100_000

#: Fixed by the format.
BREAK, END = "\r\n", "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Own field with the page's number; readers pass over fields they do not know.
PAGE_FIELD = "X-Page-Id"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


# --- writing -----------------------------------------------------------------------------------------------------------


def _pages(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload").cast("long")})


def _first(*columns: str) -> Column:
    """Orders by the columns, nulls last."""
    return F.struct(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def shared_payloads(rows: DataFrame) -> DataFrame:
    """Payloads of several of ``rows`` (page_id, url, digest, size): digest, page and address of the first, pages, repeats.

    The first is the smallest page_id, then the smallest url, nulls last; ``repeats`` rows are equal to it in both.
    """
    each = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    first = F.min_by(F.struct("page_id", "url", "n"), _first("page_id", "url"))
    return each.groupBy("digest").agg(first.alias("f"), F.sum("n").alias("pages")).filter("pages > 1").select(
        "digest", F.col("f.page_id").alias("first_page"), F.col("f.url").alias("first_url"), F.col("f.n").alias("repeats"), "pages"
    )


def _record_id(kind: str, digest: Column, *more: Column) -> Column:
    """A urn of a digest of what makes the record one of its kind."""
    parts = [F.coalesce(c.cast("string"), F.lit("-")) for c in more]
    h = F.md5(F.concat_ws("/", F.lit(kind), F.hex(digest), *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _header_text(url: Column) -> Column:
    """An address on one line: line ends would end the header field."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: str, record_id: Column, date: str, refers: list[Column], body: Column) -> Column:
    block = F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(END), body)
    fields = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _header_text(F.col("url"))),
        F.concat(F.lit(f"{PAGE_FIELD}: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.lower(F.hex("digest"))),
        *refers,
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(BREAK, *fields), F.lit(END), block)


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC/1.1 record per row of ``pages`` (page_id, url, html) into files of ``folder``.

    The payload is the html in UTF-8, null as empty. Of rows with equal payloads of REVISIT_BYTES or more the one with the
    smallest page_id, then url (nulls last) is a response, the others are revisits of it; rows equal in everything are one
    response and revisits. All other rows are responses. Null page_ids and urls are left out of the header; other columns
    are not read; an empty table writes no record. Every file is committed by Spark's writer, so a lost attempt leaves none.
    """
    rows = _pages(pages)
    narrow = materialize(rows.select("page_id", "url", "digest", "size"), "payloads")
    shared = materialize(shared_payloads(narrow), "shared")
    found = shared.agg(F.count("*"), F.coalesce(F.max("repeats"), F.lit(0))).first()
    if found[0] <= BROADCAST_PAYLOADS:
        known = rows.join(F.broadcast(shared.drop("pages")), "digest", "left")
    else:
        known = join_split(rows, shared, "digest", "pages", narrow.count(), "left")
    first = F.col("page_id").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url"))
    known = known.withColumn("one", F.when(F.col("repeats").isNull(), F.lit("alone")).when(first & (F.col("repeats") > 1), F.lit("repeated")).when(first, F.lit("first")).otherwise(F.lit("again")))

    def response(one: str) -> Column:
        # Rows of a payload that is stored more than once may be equal, so their place tells them apart.
        own = [F.col("page_id"), F.spark_partition_id(), F.monotonically_increasing_id()] if one == "alone" else []
        return _record("response", _record_id(one if one == "alone" else "first", F.col("digest"), *own), date, [], F.col("payload"))

    refers = [
        F.concat(F.lit("WARC-Refers-To: "), _record_id("first", F.col("digest"))),
        F.concat(F.lit("WARC-Refers-To-Target-URI: "), _header_text(F.col("first_url"))),
        F.lit(f"WARC-Refers-To-Date: {date}"),
        F.lit(f"WARC-Profile: {PROFILE}"),
    ]

    def revisit(*own: Column) -> Column:
        return _record("revisit", _record_id("again", F.col("digest"), F.col("page_id"), *own), date, refers, F.lit(""))

    value = F.when(F.col("one") == "alone", response("alone")).when(F.col("one") == "first", response("first")).when(
        F.col("one") == "again", revisit(F.spark_partition_id(), F.monotonically_increasing_id())
    )
    records = [known.select("one", value.alias("value")).filter("one <> 'repeated'").select("value")]
    if found[1] > 1:
        # Rows equal in page_id, url and payload: one of them is the response, and nothing tells which.
        same = known.filter("one = 'repeated'").groupBy("digest", "page_id", "url", "first_url", "size").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
        numbered = same.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        records.append(numbered.select(F.when(F.col("copy") == 1, response("first")).otherwise(revisit(F.col("url"), F.col("copy"))).alias("value")))
    reduce(DataFrame.unionByName, records).write.option("lineSep", END).text(folder)
    discard(narrow, shared)


# --- reading -----------------------------------------------------------------------------------------------------------


class _Bytes:
    """A file read forward in blocks; only what lies between the place asked for and the end of a block is held."""

    def __init__(self, uri: str) -> None:
        fs, path = pa.fs.FileSystem.from_uri(file_uri(uri))
        self.file, self.start, self.held = fs.open_input_file(path), 0, b""
        self.length = self.file.size()

    def upto(self, at: int, end: int) -> memoryview:
        """Bytes from ``at`` to ``end``, fewer at the end of the file."""
        end = min(end, self.length)
        have = self.start + len(self.held)
        if not self.start <= at <= have:
            self.start, self.held, have = at, b"", at
        if end > have:
            self.file.seek(have)
            more = self.file.read(max(end - have, min(BLOCK_BYTES, self.length - have)))
            self.held, self.start = self.held[at - self.start :] + more, at
        return memoryview(self.held)[at - self.start : max(end - self.start, 0)]


def _header(data: _Bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Header fields of the record at ``at`` and the place behind them; None if it is not a well-formed header."""
    size = 2048
    while True:
        block = bytes(data.upto(at, at + size))
        if MAGIC.match(block) is None:
            return None
        place, fields = 10, {}
        while (end := block.find(b"\r\n", place)) > place:
            name, colon, value = block[place:end].partition(b":")
            if not colon or not NAME.fullmatch(name) or b"\n" in value:
                return None
            fields[name.decode().lower()] = value.strip(b" \t").decode("utf-8", "replace")
            place = end + 2
        if end == place:
            return fields, place + at + 2
        if at + len(block) >= data.length or b"\n" in block[place:]:
            return None
        size *= 4


def _record_at(data: _Bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields of the record at ``at``, where its block begins and where its successor must; None if no whole record is here."""
    head = _header(data, at)
    if head is None or "warc-type" not in head[0] or not re.fullmatch("[0-9]{1,18}", head[0].get("content-length", "")):
        return None
    behind = head[1] + int(head[0]["content-length"]) + len(END)
    return (*head, behind) if behind <= data.length else None


def _number(text: str) -> int | None:
    number = int(text) if re.fullmatch("-?[0-9]{1,19}", text) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def ranges(spark: SparkSession, folder: str, size: int = RANGE_BYTES) -> DataFrame:
    """(path, length, start) of all byte ranges of the files of a folder, dealt to as many tasks as there are ranges."""
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "length")
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    cut = materialize(cut, "ranges")
    return cut.repartition(max(1, min(cut.count(), 100_000)), "path", "start")


def candidates(cut: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(path, start, at, next, out): places of a range that look like a record, and where they lead.

    ``next`` is where the record behind must begin; ``out`` the first place beyond the range that its successors lead to,
    the file's length at its end, or null if they end at a place that is no record.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data, headers, end = _Bytes(path), _Bytes(path), min(start + size, length)
                places, following, block = [], [], start
                while block < end:
                    # A magic may begin at the last byte of a block and go on in the next.
                    view = data.upto(block, min(block + BLOCK_BYTES, end) + 9)
                    for found in MAGIC.finditer(view):
                        at = block + found.start()
                        if at < min(block + BLOCK_BYTES, end) and (record := _record_at(headers, at)) is not None:
                            places.append(at)
                            following.append(record[2])
                    block += BLOCK_BYTES
                out, leads = [0] * len(places), {}
                for k in range(len(places) - 1, -1, -1):
                    ahead = following[k]
                    leads[places[k]] = out[k] = ahead if ahead >= end else leads.get(ahead)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(places), pa.string()), pa.array([start] * len(places), pa.int64()), *(pa.array(c, pa.int64()) for c in (places, following, out))],
                    names=["path", "start", "at", "next", "out"],
                )

    return cut.mapInArrow(look, "path string, start long, at long, next long, out long")


def entries(found: DataFrame) -> DataFrame:
    """(path, at): the places where the chain of records of a file enters a range, by pointer jumping from its start."""
    wanted = found.filter("out IS NOT NULL").select("path", F.col("out").alias("at")).distinct()
    # Only places that some range leads to, or a file begins with, can be entered.
    nodes = materialize(found.join(wanted, ["path", "at"], "left_semi").unionByName(found.filter("at = 0")).select("path", "at", "out").distinct(), "places")
    reached = materialize(nodes.filter("at = 0").select("path", "at"), "entered")
    jumps, count = nodes, reached.count()
    while True:
        ahead = reached.join(jumps, ["path", "at"]).filter("out IS NOT NULL").select("path", F.col("out").alias("at"))
        more = materialize(ahead.join(nodes, ["path", "at"], "left_semi").unionByName(reached).distinct(), "entered")
        grown = more.count()
        discard(reached)
        reached = more
        if grown == count:
            return reached
        count = grown
        then = jumps.select("path", F.col("at").alias("out"), F.col("out").alias("beyond"))
        doubled = materialize(jumps.join(then, ["path", "out"]).select("path", "at", F.col("beyond").alias("out")), "jumps")
        if jumps is not nodes:
            discard(jumps)
        jumps = doubled


_RECORD = "path string, at long, length long, warc_type string, record_id string, target_uri string, page_id long, refers_to_record string, declared_digest string, payload binary"


def read_warc(spark: SparkSession, folder: str, size: int = RANGE_BYTES) -> DataFrame:
    """Records of all WARC files of a folder, one row each, in ranges of ``size`` bytes.

    Columns: path, at and length of the record, warc_type, record_id, target_uri, page_id (null if it has none),
    refers_to_record, declared_digest (hex, null if it is not SHA-256) and payload (the block, or behind the HTTP header
    of a response; empty for revisits). A record is what the chain of lengths from the file's start reaches; text that
    looks like a record inside a payload is not one. Where a file breaks off, its records end. No file gives no row.
    """
    cut = ranges(spark, folder, size)
    found = materialize(candidates(cut, size), "candidates")
    entered = entries(found)
    begin = F.col("at") - F.col("at") % size
    walks = entered.join(cut.select("path", "length").distinct(), "path").select("path", "at", F.least(begin + size, F.col("length")).alias("end"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, end in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data, rows, held = _Bytes(path), [], 0
                while at < end and (record := _record_at(data, at)) is not None:
                    fields, begin, behind = record
                    block = bytes(data.upto(begin, behind - len(END)))
                    if fields.get("content-type", "").startswith("application/http"):
                        block = block[block.find(b"\r\n\r\n") + 4 :] if b"\r\n\r\n" in block else b""
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
                    rows.append((
                        path, at, behind - at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), _number(fields.get(PAGE_FIELD.lower(), "")),
                        fields.get("warc-refers-to"), digest[7:].lower() if digest.lower().startswith("sha256:") else None, b"" if kind == "revisit" else block,
                    ))
                    held, at = held + len(block), behind
                    if held >= BLOCK_BYTES or len(rows) >= 1024:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    tasks = max(1, min(entered.count(), 100_000))
    return walks.repartition(tasks, "path", "at").mapInArrow(walk, _RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [c.strip().split(" ") for c in _RECORD.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), names)], names=[n for n, _ in names])


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, intact.

    Size and digest are those of the payload read; a revisit has those of the response it refers to, whose page_id is
    ``refers_to``, or null where the archive does not hold that response. ``intact``: the digest in the header is right.
    """
    read = read_warc(spark, folder)
    own = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    told = materialize(read.withColumns(own).drop("payload", "path", "at", "length"), "records")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "intact"]
    right = F.coalesce(F.col("declared_digest") == F.col("payload_digest"), F.lit(False)).alias("intact")
    stored = told.filter("warc_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "target_uri", right)
    again = told.filter("warc_type = 'revisit'")
    cited = again.groupBy(F.col("refers_to_record").alias("record_id")).agg(F.count("*").alias("cited"))
    origins = materialize(
        cited.join(told.filter("warc_type <> 'revisit'").select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"), "record_id")
        .groupBy("record_id").agg(F.min(F.struct("refers_to", "payload_bytes", "payload_digest")).alias("o"), F.first("cited").alias("cited")).select("record_id", "o.*", "cited"),
        "origins",
    )
    facts = again.select(F.col("refers_to_record").alias("record_id"), "page_id", "target_uri", "declared_digest", F.col("warc_type").alias("record_type"))
    named = facts.filter("record_id IS NOT NULL")
    found = join_split(named, origins, "record_id", "cited", again.count(), "left").unionByName(facts.filter("record_id IS NULL"), allowMissingColumns=True)
    return stored.select(*names).unionByName(found.withColumn("intact", F.coalesce(F.col("declared_digest") == F.col("payload_digest"), F.lit(False))).select(*names))


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives into ``folder`` (a new shared one by default) and read them back, as ``archived``."""
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    write_warc(pages, folder)
    return archived(spark, folder)
