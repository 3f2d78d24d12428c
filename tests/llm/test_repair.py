"""Conversation repair against all edit sequences, and chunks against whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from turnwise.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost long, audit string, pos long, conv string, kind string"
BLANKS = " \t\n\x0b\x0c\r"


def _all_audits(codes, i, state, run=0):
    """Every way to finish from here, with at most two insertions in a row: (cost, audit)."""
    if i == len(codes) and state in (0, 3):
        yield 0, ""
    if run < 2:
        for c, a in _all_audits(codes, i, 3 if state == 2 else 2, run + 1):
            yield c + 2, "I" + a
    if i < len(codes):
        initial, fault = codes[i] & 3, codes[i] >> 2
        for c, a in _all_audits(codes, i + 1, state):
            yield c + 3, "D" + a
        if fault in (0, 3):
            extra = fault == 3
            for c, a in _all_audits(codes, i + 1, 3 if state == 2 else 2):
                yield c + 2 + extra, "R" + a
            to = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}[state].get(initial)
            if to is not None:
                for c, a in _all_audits(codes, i + 1, to):
                    yield c + extra, "K" + a


def test_search_from_both_ends():
    rng = random.Random(1)
    seen = {b""}
    for _ in range(1500):
        seen.add(bytes(rng.choice((0, 1, 1, 2, 2, 3)) + 4 * rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(rng.randint(1, 5))))
    for codes in seen:
        assert repair.whole(codes) == min(_all_audits(codes, 0, 0)), codes


def _best(codes):
    """Cost and audit by dynamic programming from the end."""
    value = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for code in reversed(codes):
        initial, fault, now = code & 3, code >> 2, {}
        for s in range(4):
            ways = [(value[s][0] + 3, "D" + value[s][1])]
            if fault in (0, 3):
                c, a = value[3 if s == 2 else 2]
                ways.append((c + 2 + (fault == 3), "R" + a))
                to = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}[s].get(initial)
                if to is not None:
                    ways.append((value[to][0] + (fault == 3), "K" + value[to][1]))
            now[s] = min(ways)
        value = {s: min(now[s], (now[3 if s == 2 else 2][0] + 2, "I" + now[3 if s == 2 else 2][1])) for s in range(4)}
    return value[0]


def _plain(rows, damage):
    """Per conv_id what is found, row by row."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, said in by.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        codes, seen = [], set()
        for _, role, text in said:
            tail = text.rstrip(BLANKS)
            fault = 1 if not tail else 2 if (role, text) in seen else 3 if tail[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append("sua".find(role[:1]) % 4 + 4 * fault if role else 3 + 4 * fault)
        turns = {t for t, *_ in said if t is not None}
        cost, audit = _best(codes)
        state, lines, rest = 0, [], iter(said)
        for edit in audit:
            if edit != "I":
                _, role, text = next(rest)
            if edit == "D":
                continue
            state = 1 if edit == "K" and role[0] == "s" else 3 if state == 2 else 2
            lines.append(f"{role}:{text}" if edit == "K" else f"{'user' if state == 2 else 'assistant'}:{text if edit == 'R' else ''}")
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(c >> 2 == f for c in codes) for f in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def _told(frame):
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def _rows(rng, conversations, longest):
    out = []
    for conv in range(conversations):
        said = [rng.choice(["One. ", "Two!", "Three?\n", "four", "Five. six", "", " \t", "é中😀."]) + str(rng.randrange(3)) * rng.randint(0, 1) for _ in range(rng.randint(0, longest))]
        for turn, text in enumerate(said):
            role = rng.choices(["user", "assistant", "system", "tool", ""], [6, 6, 1, 1, 0.3])[0] if turn else rng.choice(["system", "user"])
            out.append((conv, turn * rng.choice([1, 1, 1, 2]), role, text))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "KKK", 5, "x", "y") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("chunk", [4096, 3, 1])
def test_every_conversation(spark, chunk):
    rows = _rows(random.Random(2), 120, 12)
    plain = repair.plain_rows(_frame(spark, rows))
    assert _told(repair.Repair(plain, plain, chunk).digests()) == _plain(rows, False)
    assert _told(repair.Repair(repair.damaged(plain), plain, chunk).digests()) == _plain(rows, True)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", None), (None, 1, None, "What?"), (1, None, "user", "a."), (1, None, "user", "a."), (1, -5, "assistant", "b" * 300_000), (1, 9, "uber", "x."), (1, 10, "alice", "y.")]
    rows += [(2, k, "system", "Same.") for k in range(5)] + [(3, 1, "user", "tie."), (3, 1, "assistant", "tie."), (3, 1, "user", "tie!"), (4, -(1 << 63), "user", "Far."), (4, (1 << 63) - 1, "assistant", "Far.")]
    rows += [(k, t, None, None) for k in (50, 51) for t in (None, 1)] + [(100 + k, 0, "user", "Alone.") for k in range(60)]
    want = _plain(rows, True)
    want[4] = (min(want[4][0], (1 << 63) - 1), *want[4][1:])
    assert _told(repair.repair_damaged(_frame(spark, rows))) == want
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for k, v in want.items() if k and k >= 100)


def test_one_conversation_of_most_rows(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", "", f"Row {t}."])) for t in range(9000)] + _rows(rng, 30, 6)
    rows = [r for r in rows if r[0] != 7 or len(r) == 4]
    assert _told(repair.repair(_frame(spark, rows)).digests()) == _plain(rows, False)


def test_repaired_rows(spark):
    rows = _rows(random.Random(5), 40, 9)
    given = _frame(spark, rows)
    told = _plain(rows, False)
    by = defaultdict(list)
    for r in repair.repair(given).conversations().collect():
        by[r.conv].append((r.place, r.role, r.text, r.edit))
    for conv, found in told.items():
        lines = sorted(by.get(str(conv), []))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in lines).encode()).hexdigest() == found[7]
        assert "".join(e for *_, e in lines) == found[6].replace("D", "") and re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, r, _, _ in lines))


def test_nothing(spark):
    assert not _told(repair.repair_damaged(_frame(spark, []).filter("conv_id = 1")))
