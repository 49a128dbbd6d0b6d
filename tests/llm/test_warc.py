import base64
import gzip
import hashlib
import io
import zlib

import pytest

from archivolt.llm import warc

PAGES = [
    (3, "http://a/", "<p>é</p>"), (1, "http://b/\r\nEvil: x", "<p>é</p>"), (2, None, ""), (4, "u", None), (5, "u", "x" * 3_000_000), (6, "u", "x" * 3_000_000),
    (7, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), (1, "http://c/", "<p>é</p>"), (None, "n", "only null"), (None, "n", "<p>é</p>"), (8, "u", "only"),
]
SCHEMA = "page_id long, url string, html string"


def _want(rows, least=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        low = min(same, default=None)
        original = None if low is None or page_id == low or len(data) < least else low
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if original is None else "revisit", original))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(frame, least):
    found = warc.round_trip(frame(PAGES, SCHEMA), least).collect()
    assert all(r.intact for r in found)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == _want(PAGES, least)


def test_archives_are_plain_gzip_members_of_warc_records(frame, scratch):
    archives = warc.write_archives(frame(PAGES, SCHEMA), warc.as_uri(scratch))
    payloads, n = {}, 0
    for row in archives.collect():
        path = row.path.removeprefix("file://")
        data = gzip.open(path).read()  # the public reader takes all members
        n += data.count(b"WARC-Record-ID")
        with open(path, "rb") as f:
            for chunks in warc.members(f):
                r = warc.read_record(chunks, payloads=True)
                if r["record_type"] == "response":
                    payloads[r["page_id"]] = r["payload"].decode()
    assert n == len(PAGES) == sum(r.records for r in archives.collect())
    assert payloads[5] == "x" * 3_000_000 and payloads[7] == PAGES[6][2] and payloads[2] == "" and payloads[8] == "only"


def test_no_pages(frame):
    assert warc.round_trip(frame([], SCHEMA)).collect() == []


def _member(raw):
    return b"".join(warc.gzip_member(iter([raw])))


def _read(data):
    return [warc.read_record(c) for c in warc.members(io.BytesIO(data))]


def test_damage_is_seen():
    raw = b"".join(warc.record(1, "u", b"payload", None))
    good = _read(_member(raw) * 2)
    assert [r["intact"] for r in good] == [True, True]
    assert not _read(_member(raw.replace(b"payload", b"pay1oad")))[0]["intact"]
    assert not _read(_member(raw + b"more"))[0]["intact"]
    with pytest.raises((EOFError, zlib.error)):
        _read(_member(raw)[:-20])
    with pytest.raises(ValueError):
        _read(_member(raw[:-12]))
    with pytest.raises(ValueError):
        _read(_member(b"no header end"))
    assert _read(b"") == []


@pytest.mark.parametrize("folder, uri", [("/a/b", "file:///a/b"), ("file:/a", "file:///a"), ("file:///a", "file:///a"), ("hdfs://n/a", "hdfs://n/a")])
def test_uris(folder, uri):
    assert warc.as_uri(folder) == uri
