"""WARC archives against a plain sequential reader and the plain roles of equal payloads."""

import hashlib
from collections import Counter
from pathlib import Path

import pytest

from turnwise.llm import warc
from turnwise.llm.common import work_dir

LONG = "<p>" + "again and again " * 20 + "</p>"
#: A whole record as the text of a page, with the blank lines that end one.
PLANTED = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
SCHEMA = "page_id long, url string, html string, digest string, size long, value string, one string, first_page long"


def _rows():
    rows = [
        (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, None, LONG), (None, "http://a/none", LONG),
        (7, "http://a/7", "short"), (8, "http://a/8", "short"), (11, "http://a/11", None), (12, None, ""),
        (20, "http://a/20", "x" * 150 + PLANTED + "y"), (21, "http://a/21", PLANTED * 3), (22, "u", "WARC/1.1\r\n" * 50), (23, "u", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n" + "z" * 200),
        (30, "http://a/\r\nInjected: 1", "é中😀" * 100), (31, "big", "wort " * 20_000), (32, "big", "\r\n\r\n" * 100),
        (40, "twice", "t" * 120), (40, "twice", "t" * 120), (40, "twice", "t" * 120), (41, "twice", "t" * 120), (None, None, "n" * 300), (None, None, "n" * 300),
    ]
    return [(*r, "d", 1, "v", "o", 4) for r in rows]


def _plain_roles(rows):
    """Roles told one by one in order of page_id and url, nulls last."""
    first, out = {}, []
    for page, url, html in sorted(((r[0], r[1], r[2] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        data = html.encode()
        again = len(data) >= 100 and data in first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return Counter(out)


def _walk(data):
    """Places of the records of a file, one after the other."""
    at, places = 0, []
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        length = next(int(x.split(b":")[1]) for x in data[at:head].split(b"\r\n") if x.startswith(b"Content-Length"))
        places.append(at)
        at = head + 4 + length + 4
    return places


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_roles_and_round_trip(spark, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", broadcast)
    rows = _rows()
    got = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == _plain_roles(rows)
    assert all(r.intact for r in got)


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_boundaries_at_any_range(spark, size):
    rows = _rows()
    folder = work_dir(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(2), folder)
    want = {(f.name, at) for f in Path(folder).glob("part-*") for at in _walk(f.read_bytes())}
    read = warc.read_warc(spark, folder, size).collect()
    assert len(read) == len(rows) and {(r.path.rsplit("/", 1)[1], r.at) for r in read} == want
    assert len({r.record_id for r in read}) == len(read)
    stored = {bytes(r.payload) for r in read if r.warc_type == "response"}
    assert stored == {(r[2] or "").encode() for r in rows}


def test_a_file_that_breaks_off(spark, tmp_path):
    folder = work_dir(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([(k, "u", f"page {k} " * 50) for k in range(20)], "page_id long, url string, html string").coalesce(1), folder)
    (whole,) = Path(folder).glob("part-*")
    data = whole.read_bytes()
    cut = tmp_path / "cut"
    cut.mkdir()
    (cut / "a.warc").write_bytes(data[:-30])
    (cut / "b.warc").write_bytes(b"no archive at all")
    (cut / "c.warc").write_bytes(b"")
    assert sorted(r.page_id for r in warc.read_warc(spark, str(cut), 512).collect()) == list(range(19))


def test_no_pages(spark):
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_payload_and_unknown_response(spark):
    rows = [(k, f"u{k}", LONG if k % 3 == 0 else f"{k} " * 60) for k in range(3000)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.filter("record_type = 'revisit'").count() == 999 and {r.refers_to for r in got.filter("record_type = 'revisit'").collect()} == {0}
