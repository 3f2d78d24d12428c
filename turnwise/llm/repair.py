"""Repair of conversations: the cheapest edits after which roles alternate as a chat does.

A conversation is to read: at most one system message first, then user and assistant in turn, or nothing at all. Rows may be
kept, given another role, deleted, or empty rows inserted. The lattice of edits has a node for every number of rows
passed and every state of the pattern; in a state every edit leads to one node, so the edits' initials (the audit) tell the
path. The cheapest path is found by Dijkstra's search from both ends: when the two heaps' least costs exceed the best
meeting, every edge that joins both sides at that cost has been seen, and the least concatenation of the prefix, the
edge and the suffix is taken.

Rows are numbered and judged as narrow rows, and a task solves chunks of a bounded number of them. A conversation of one
chunk is done then. Of a longer one each chunk gives its cheapest costs between all states; these are added up from the
end, each chunk is solved once per state it may begin in, with the costs that remain behind it, and the states are followed
from the start. An insertion between two chunks belongs to the later one, so audits of equal cost part within a chunk.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import materialize, prefix_sums, runs, text_digest

#: Rows of a chunk: what one search holds.
CHUNK_ROWS = 4096
#: Solved patterns of up to so many rows that a worker remembers, and how many of them.
REMEMBERED_ROWS, REMEMBERED = 32, 100_000
DELETE, CHANGE, INSERT = 3, 2, 2
#: States: nothing yet, behind the system message, behind a user, behind an assistant; the latter and the first may end.
STATES, FINAL = range(4), {0: 0, 3: 0}
#: State behind an inserted or changed row, and behind a kept row by its role's initial (s, u, a, other).
TURN = (2, 2, 3, 2)
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
NAMES = {2: "user", 3: "assistant"}
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {(0, 1), (1, 2), (2, 1)}
FAR = 1 << 60


# --- the search --------------------------------------------------------------------------------------------------------


def _leaving(codes: bytes, i: int, state: int, closing: bool) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Edits that leave a node: (initial, cost, node). Insertions behind the last row are for the closing chunk."""
    if i < len(codes) or closing:
        yield "I", INSERT, (i, TURN[state])
    if i < len(codes):
        initial, fault = codes[i] & 3, codes[i] >> 2
        yield "D", DELETE, (i + 1, state)
        if fault in (SOUND, TRUNCATED):
            extra = int(fault == TRUNCATED)
            if KEEP[state][initial] is not None:
                yield "K", extra, (i + 1, KEEP[state][initial])
            yield "R", CHANGE + extra, (i + 1, TURN[state])


def _entering(codes: bytes, i: int, state: int, closing: bool) -> Iterator[tuple[str, int, tuple[int, int]]]:
    """Edits that lead to a node: (initial, cost, node they come from)."""
    if i < len(codes) or closing:
        for before in STATES:
            if TURN[before] == state:
                yield "I", INSERT, (i, before)
    if i:
        initial, fault = codes[i - 1] & 3, codes[i - 1] >> 2
        yield "D", DELETE, (i - 1, state)
        if fault in (SOUND, TRUNCATED):
            extra = int(fault == TRUNCATED)
            for before in STATES:
                if KEEP[before][initial] == state:
                    yield "K", extra, (i - 1, before)
                if TURN[before] == state:
                    yield "R", CHANGE + extra, (i - 1, before)


def solve(codes: bytes, entry: dict[int, int], final: dict[int, int], closing: bool) -> tuple[int, str] | None:
    """Least cost of a path from the entry states to the final ones, whose costs count, and the ASCII-least audit of it.

    ``codes`` has a byte per row: the initial of its role and, from the third bit on, its fault.
    """
    n = len(codes)
    cost = [{(0, s): c for s, c in entry.items()}, {(n, s): c for s, c in final.items()}]
    heaps = [[(c, node) for node, c in side.items()] for side in cost]
    done: list[dict[tuple[int, int], int]] = [{}, {}]
    steps = _leaving, _entering
    best = FAR
    for side in (0, 1):
        heapq.heapify(heaps[side])
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if len(done[0]) <= len(done[1]) else 1
        c, node = heapq.heappop(heaps[side])
        if node in done[side]:
            continue
        done[side][node] = c
        # A node both sides have seen closes a path, of edges seen from one side each.
        best = min(best, c + cost[1 - side].get(node, FAR))
        for _, more, other in steps[side](codes, *node, closing):
            if c + more < cost[side].get(other, FAR):
                cost[side][other] = c + more
                heapq.heappush(heaps[side], (c + more, other))
                best = min(best, c + more + cost[1 - side].get(other, FAR))
    if best >= FAR:
        return None
    prefix: dict[tuple[int, int], str] = {}
    for node in sorted(done[0], key=lambda x: (x[0], done[0][x])):
        c = done[0][node]
        said = [prefix[b] + e for e, w, b in _entering(codes, *node, closing) if b in prefix and done[0][b] + w == c]
        prefix[node] = min([*said, *[""] * (node[0] == 0 and entry.get(node[1]) == c)])
    suffix: dict[tuple[int, int], str] = {}
    for node in sorted(done[1], key=lambda x: (-x[0], done[1][x])):
        c = done[1][node]
        said = [e + suffix[a] for e, w, a in _leaving(codes, *node, closing) if a in suffix and done[1][a] + w == c]
        suffix[node] = min([*said, *[""] * (node[0] == n and final.get(node[1]) == c)])
    # Every node of a cheapest path was reached from one side below that side's least open cost, so the path has an edge
    # between a node of the first side and one of the second, or lies on one side as a whole.
    met = [prefix[x] for x in prefix if x[0] == n and done[0][x] + final.get(x[1], FAR) == best]
    met += [suffix[x] for x in suffix if x[0] == 0 and entry.get(x[1], FAR) + done[1][x] == best]
    for x in prefix:
        met += [prefix[x] + e + suffix[a] for e, w, a in _leaving(codes, *x, closing) if a in suffix and done[0][x] + w + done[1][a] == best]
    return best, min(met)


def passed(codes: bytes, audit: str, state: int) -> int:
    """State behind the edits of a chunk."""
    row = 0
    for edit in audit:
        if edit == "I":
            state = TURN[state]
            continue
        if edit != "D":
            state = TURN[state] if edit == "R" else KEEP[state][codes[row] & 3]
        row += 1
    return state


_solved: dict[bytes, tuple[int, str]] = {}


def whole(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a conversation of one chunk; the commonest patterns come again and again."""
    if codes in _solved:
        return _solved[codes]
    found = solve(codes, {0: 0}, FINAL, True)
    if len(codes) <= REMEMBERED_ROWS:
        if len(_solved) >= REMEMBERED:
            _solved.clear()
        _solved[codes] = found
    return found


def illegal_pairs(codes: bytes) -> int:
    initials = [c & 3 for c in codes]
    return sum(pair not in LEGAL for pair in zip(initials, initials[1:]))


# --- rows --------------------------------------------------------------------------------------------------------------


def plain_rows(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text): conv is never null, a null role or text is one space."""
    c = conversations
    conv_id = c["conv_id"].cast("long")
    return c.select(
        F.coalesce(conv_id.cast("string"), F.lit("none")).alias("conv"), conv_id.alias("conv_id"), c["turn"].cast("long").alias("turn"),
        F.coalesce(c["role"].cast("string"), F.lit(" ")).alias("role"), F.coalesce(c["text"].cast("string"), F.lit(" ")).alias("text"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Plain rows, damaged by the checksum of ``conv_id:turn`` (null: one space): of twenty kinds one drops the row, one
    empties its text, one takes its stops away, one repeats it, one makes it a user's."""
    key = F.concat_ws(":", *[F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")])
    text, role = F.col("text"), F.col("role")
    kind = F.pmod(F.crc32(key), F.lit(20))
    return (
        rows.withColumn("kind", kind)
        .filter("kind <> 0")
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(role))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
        .select(*rows.columns)
    )


def row_order() -> list[Column]:
    """Turn (null first), then role and digest of the text: rows equal in all of it are equal."""
    return [F.col("turn").isNotNull(), F.col("turn"), F.col("role"), F.col("content")]


def judged(rows: DataFrame) -> DataFrame:
    """(conv, pos, code) of plain rows: pos counts them in order, code holds the role's initial and the first fault."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    head = F.left("role", F.lit(1))
    initial = F.when(head == "s", 0).when(head == "u", 1).when(head == "a", 2).otherwise(3)
    narrow = rows.select("conv", "turn", "role", text_digest(F.col("text")).alias("content"), initial.alias("initial"), fault.alias("fault"))
    numbered = materialize(prefix_sums(narrow, ["conv"], row_order(), "rows", pos=F.lit(1)), "numbered")
    # The first of equal rows has a place that no other row has, so this join has no hot key.
    first = numbered.groupBy("conv", "role", "content").agg(F.min("pos").alias("pos")).select("conv", "pos", F.lit(True).alias("new"))
    told = numbered.join(first, ["conv", "pos"], "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("new").isNull(), DUPLICATE).otherwise(F.col("fault"))
    return told.select("conv", "pos", (F.col("initial") + fault * 4).cast("int").alias("code"))


_CHUNK = "conv string, chunk long, cost long, audit string, illegal long, blank long, duplicate long, truncated long, codes binary, matrix array<long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows in order: a conversation of one chunk is solved, of a longer one every chunk has its matrix of costs."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64())]
    names = [c.strip().split(" ")[0] for c in _CHUNK.split(",")]
    out = []
    for (conv, chunk, limit), table in runs(batches, 3):
        codes = np.asarray(table.column(4)).astype(np.uint8).tobytes()
        closing = len(codes) < limit
        faults = np.bincount(np.frombuffer(codes, np.uint8) >> 2, minlength=4)
        cost = audit = matrix = None
        if closing and chunk == 0:
            cost, audit = whole(codes)
        else:
            found = [solve(codes, {a: 0}, {b: 0}, closing) for a in STATES for b in STATES]
            matrix = [FAR if f is None else f[0] for f in found]
        out.append((conv, int(chunk), cost, audit, illegal_pairs(codes), *map(int, faults[1:]), None if matrix is None else codes, matrix))
        if len(out) == 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


# --- conversations of several chunks -----------------------------------------------------------------------------------


def _costs_behind(chunk_rows: int):
    """Chunks from the last to the first: what is left to pay behind each, by state, and in all from the start of the first."""

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, []
        for batch in batches:
            rows = []
            for conv, chunk, n, matrix in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if conv != now:
                    # A last chunk that is full does not know that it is the last: an empty one closes behind it.
                    now = conv
                    left = [solve(b"", {s: 0}, FINAL, True)[0] for s in STATES] if n == chunk_rows else [FINAL.get(s, FAR) for s in STATES]
                before = [min(min(matrix[a * 4 + b] + left[b] for b in STATES), FAR) for a in STATES]
                rows.append((conv, chunk, left, before[0]))
                left = before
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.int64())],
                names=["conv", "chunk", "left", "total"],
            )

    return behind


def _ways(chunk_rows: int):
    """Per chunk and state it may begin in: the state it ends in and the audit, given the costs behind it."""

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, audits = [], []
            for codes, left in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                final = {s: c for s, c in enumerate(left) if c < FAR}
                found = [solve(codes, {s: 0}, final, len(codes) < chunk_rows) for s in STATES]
                ends.append([None if f is None else passed(codes, f[1], s) for s, f in zip(STATES, found)])
                audits.append([None if f is None else f[1] for f in found])
            first = [[c[0] & 3, c[-1] & 3, len(c)] for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string())), pa.array(first, pa.list_(pa.int32()))],
                names=["conv", "chunk", "ends", "audits", "edge"],
            )

    return ways


def _followed(chunk_rows: int):
    """Chunks from the first to the last: the state each begins in, whether the pair at its head is illegal, and the closing edits."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last = None, 0, None
        for batch in batches:
            rows = []
            for conv, chunk, ends, (first, final, n), is_last in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if conv != now:
                    now, state, last = conv, 0, None
                begin, state = state, ends[state]
                tail = solve(b"", {state: 0}, FINAL, True)[1] if is_last and n == chunk_rows else ""
                rows.append((conv, chunk, begin, int(last is not None and (last, first) not in LEGAL), tail))
                last = final
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string())],
                names=["conv", "chunk", "state", "joint", "tail"],
            )

    return follow


def _joined_chunks(long: DataFrame, chunk_rows: int) -> DataFrame:
    """Solved rows, one per conversation, of conversations of several chunks; what goes from chunk to chunk is narrow."""
    back = long.select("conv", "chunk", F.octet_length("codes").alias("n"), "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    left = materialize(back.mapInArrow(_costs_behind(chunk_rows), "conv string, chunk long, left array<long>, total long"), "costs-behind")
    ways = long.join(left, ["conv", "chunk"]).select("conv", "chunk", "codes", "left").mapInArrow(
        _ways(chunk_rows), "conv string, chunk long, ends array<int>, audits array<string>, edge array<int>"
    )
    ways = materialize(ways, "ways")
    top = left.groupBy("conv").agg(F.max("chunk").alias("top"), F.min_by("total", "chunk").alias("cost"))
    ahead = ways.join(top, "conv").select("conv", "chunk", "ends", "edge", (F.col("chunk") == F.col("top")).alias("is_last")).repartition("conv").sortWithinPartitions("conv", "chunk")
    states = materialize(ahead.mapInArrow(_followed(chunk_rows), "conv string, chunk long, state int, joint long, tail string"), "states")
    pieces = states.join(ways, ["conv", "chunk"]).select("conv", "chunk", "joint", F.concat(F.element_at("audits", F.col("state") + 1), "tail").alias("piece"))
    audits = pieces.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "").alias("audit"), F.sum("joint").alias("joint"))
    counts = long.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("illegal", "blank", "duplicate", "truncated")])
    return counts.join(audits, "conv").join(top, "conv").select("conv", "cost", "audit", (F.col("illegal") + F.col("joint")).alias("illegal"), "blank", "duplicate", "truncated")


# --- the repaired conversations ----------------------------------------------------------------------------------------

_HEAD = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "conv string, place long, role string, text string, edit string"


class _Reader:
    """Applies the edits of one conversation to its rows as they come by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, TURN[self.state]
            yield NAMES[self.state], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEEP[self.state]["sua".index(role[0])]
            yield role, text, edit
        elif edit == "R":
            self.state = TURN[self.state]
            yield NAMES[self.state], text, edit


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Heads and rows in order, one at a time: (conv, head, None), then (conv, None, row) for each of its rows."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for conv, kind, role, text, *head in zip(*columns):
            yield (conv, head, None) if kind == 0 else (conv, None, (role, text))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [*[pa.int64()] * 7, pa.string(), pa.string()]
    names = [*_HEAD, "repaired_sha256"]
    head, reader, digest, out, between = None, None, None, [], ""

    def feed(lines) -> None:
        nonlocal between
        for role, text, _ in lines:
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"

    def close() -> None:
        feed(reader.inserted())
        out.append((*head, digest.hexdigest()))

    for _, new, row in _stream(batches):
        if new is None:
            feed(reader.row(*row))
            continue
        if head is not None:
            close()
        head, reader, digest, between = new, _Reader(new[-1]), hashlib.sha256(), ""
        if len(out) >= 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
    if head is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.strip().split(" ")[0] for c in _ROW.split(",")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    reader, last, place, out, size = None, None, 0, [], 0

    def take(lines) -> None:
        nonlocal place, size
        for role, text, edit in lines:
            out.append((last, place, role, text, edit))
            place, size = place + 1, size + len(text)

    for conv, head, row in _stream(batches):
        if head is None:
            take(reader.row(*row))
        else:
            if reader is not None:
                take(reader.inserted())
            reader, last, place = _Reader(head[-1]), conv, 0
        if len(out) >= 512 or size >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out, size = [], 0
    if reader is not None:
        take(reader.inserted())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


class Repair:
    """Heads (one row per conversation: its counts, cost and audit) and its rows, in the order in which edits apply."""

    def __init__(self, rows: DataFrame, originals: DataFrame, chunk_rows: int = CHUNK_ROWS) -> None:
        """``rows`` are the plain rows to repair, ``originals`` the plain rows that name the conversations to report."""
        self.rows = rows
        codes = judged(rows).select("conv", F.floor(F.col("pos") / chunk_rows).cast("long").alias("chunk"), F.lit(chunk_rows).cast("long").alias("limit"), "pos", "code")
        parts = materialize(codes.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "pos").mapInArrow(_chunks, _CHUNK), "chunks")
        names = ["conv", "cost", "audit", "illegal", "blank", "duplicate", "truncated"]
        solved = parts.filter("matrix IS NULL").select(*names)
        long = parts.filter("matrix IS NOT NULL")
        if not long.isEmpty():
            solved = solved.unionByName(_joined_chunks(long, chunk_rows))
        turn = F.col("turn").cast("decimal(20,0)")
        missing = F.max(turn) - F.min(turn) + 1 - F.count_distinct("turn")
        most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
        gaps = rows.groupBy("conv").agg(F.least(F.coalesce(missing, F.lit(0)), most).cast("long").alias("gaps"))
        every = originals.select("conv", "conv_id").distinct()
        zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
        self.heads = materialize(every.join(gaps, "conv", "left").join(solved, "conv", "left").fillna({**zeros, "audit": ""}).select("conv", *_HEAD), "heads")

    def _in_order(self) -> DataFrame:
        """A conversation's head, then its rows. All of them pass one task, a row at a time: a checksum of the whole
        conversation can be taken in no other way."""
        nothing = {"turn": "long", "role": "string", "content": "binary", "text": "string"}
        heads = self.heads.select("conv", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], *_HEAD)
        empty = [F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _HEAD]
        rows = self.rows.select("conv", F.lit(1).alias("kind"), "turn", "role", text_digest(F.col("text")).alias("content"), "text", *empty)
        parts = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = heads.unionByName(rows).repartition(parts, "conv").sortWithinPartitions("conv", "kind", *row_order())
        return both.select("conv", "kind", "role", "text", *_HEAD)

    def digests(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        return self._in_order().mapInArrow(_digests, _RESULT)

    def conversations(self) -> DataFrame:
        """The repaired conversations: conv, place, role, text, edit (K kept, R role changed, I inserted)."""
        return self._in_order().mapInArrow(_edited, _ROW)


def repair(conversations: DataFrame) -> Repair:
    """Repair conversations (conv_id, turn, role, text) as they are.

    Rows of a conversation count in order of turn (null first), then role and a digest of the text; rows without conv_id
    are one conversation. A null role or text is one space, so such a text is blank. A row's fault is the first that
    holds: blank, duplicate (an earlier row has its role and text), truncated (its last character that is not blank is
    none of .!?). An empty text is blank; texts of any length are read whole. ``gaps`` counts turn numbers missing between
    the least and the greatest. An empty table gives no row; other columns are not read.
    """
    rows = plain_rows(conversations)
    return Repair(rows, rows)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage every conversation by the checksum of its rows, repair it, and tell what was found, one row per original
    conv_id; a conversation that loses all rows has zeros, an empty audit and the checksum of nothing."""
    rows = plain_rows(conversations)
    return Repair(damaged(rows), rows).digests()
