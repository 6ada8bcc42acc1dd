"""Archives: round trips, offsets, revisits, and streams of every kind."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries as Q
from tessera.llm import warc as A

DATA = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, digest string, payload string, top string, revisit string, n_bytes string, archive string"


def frame(spark, rows):
    """Pages with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA)


def plain(rows, least=0):
    """A count of (page_id, bytes, digest, type, refers_to) of (page_id, url, html)."""
    order = {}
    for i, (page, url, html) in enumerate(rows):
        payload = (html or "").encode()
        best = order.get(payload)
        rank = ((page is not None, page or 0), (url is not None, (url or "").encode()), -i)
        if best is None or rank > best[0]:
            order[payload] = (rank, i)
    out = Counter()
    for i, (page, _, html) in enumerate(rows):
        payload = (html or "").encode()
        first = order[payload][1]
        response = first == i or len(payload) < least
        out[page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if response else "revisit", None if response else rows[first][0]] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


PAGES = [
    (5, "http://a/5", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (2, None, "<p>same</p>"), (7, "http://b/ x\r\nWARC-Type: metadata\t\x01", "other é日\U0001f600"),
    (1, "", None), (3, "u", ""), (4, "http://ü/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"),
    (None, "n", "<p>same</p>"), (None, "n", "alone"), (11, "z", "x" * 3_000_000), (12, "z", "twice"), (12, "z", "twice"), (12, "a", "twice"), (12, None, "twice"), (10, "y", "twice"),
    (13, "v", "other text of id 13"), (13, "v", "other"), (-4, "neg", "minus"),
]


@pytest.mark.parametrize(("sent", "archive", "alike"), [(500_000, 128 << 20, 10_000), (0, 1, 1), (0, 2000, 2)])
def test_round_trip(spark, tmp_path, monkeypatch, sent, archive, alike):
    monkeypatch.setattr(A, "MOST_SENT", sent)
    monkeypatch.setattr(A, "ALIKE", alike)
    monkeypatch.setattr(A.write, "__defaults__", (archive,))
    rows = PAGES + [(12, "z", "twice")] * 7
    got = A.archived(frame(spark, rows).repartition(3), folder=f"file://{tmp_path}/w", with_payload=True).cache()
    assert found(got) == plain(rows)
    known = Counter(((r[0], (r[2] or "").encode()) for r in rows))
    for r in got.where("record_type = 'response'").collect():
        assert known[r["page_id"], bytes(r["payload"])]
    assert got.where("record_type = 'revisit' and payload is not null").isEmpty()
    assert {r["target_uri"] for r in got.where("page_id = 7").collect()} == {"http://b/%20x%0D%0AWARC-Type:%20metadata%09%01"}
    got.unpersist()
    # every member of every archive is a whole record, where the sidecar says
    n = 0
    for path in Path(tmp_path, "w/members").glob("*.warc.gz"):
        data = path.read_bytes()
        at = 0
        for line in Path(f"{path}.idx").read_text().splitlines():
            offset, length, kind, _ = line.split(" ")
            assert int(offset) == at
            member = gzip.decompress(data[at : at + int(length)])
            assert member.startswith(b"WARC/1.1\r\n") and f"WARC-Type: {kind}".encode() in member and member.endswith(b"\r\n\r\n")
            at, n = at + int(length), n + 1
        assert at == len(data)
    assert n == len(rows)
    assert not Path(tmp_path, "w/whole").exists()


def test_revisits_name_the_record(spark, tmp_path):
    A.archived(frame(spark, PAGES), folder=f"file://{tmp_path}/w").count()
    ids, refers = set(), set()
    for path in Path(tmp_path, "w/members").glob("*.warc.gz"):
        for part in gzip.decompress(path.read_bytes()).split(b"WARC/1.1\r\n"):
            own = A.headers(b"WARC/1.1\r\n" + part.partition(b"\r\n\r\n")[0])
            if own.get("warc-record-id"):
                assert own["warc-record-id"] not in ids
                ids.add(own["warc-record-id"])
            refers |= {own["warc-refers-to"]} if "warc-refers-to" in own else set()
    assert refers and refers <= ids


def test_least_bytes(spark, tmp_path):
    assert found(A.archived(frame(spark, PAGES), folder=f"file://{tmp_path}/w", least_bytes=6)) == plain(PAGES, 6)


def test_empty(spark, tmp_path):
    assert A.archived(frame(spark, []), folder=f"file://{tmp_path}/w").collect() == []


RECORDS = [b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n" % (i, n) + bytes([65 + i]) * n + b"\r\n\r\n" for i, n in enumerate([0, 1, 5000, 70_000, 3])]


class Sink(A._Stream):
    def __init__(self):
        self.path, self.out, self.at, self.gzip = "x", io.BytesIO(), 0, None


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
@pytest.mark.parametrize("members", [[5], [1] * 5, [2, 3]])
def test_normalises_any_layout(monkeypatch, piece, members):
    """One member, one for each record, or between: the same archive comes out."""
    monkeypatch.setattr(A, "PIECE", piece)
    data, at = b"", 0
    for n in members:
        data += gzip.compress(b"".join(RECORDS[at : at + n]))
        at += n
    out, lines = Sink(), []
    assert A.normalised(io.BytesIO(data), out, lines.append) == 5
    made = out.out.getvalue()
    for line, want in zip(lines, RECORDS, strict=True):
        offset, length = map(int, line.split()[:2])
        assert zlib.decompress(made[offset : offset + length], 31) == want


def test_broken_streams():
    whole = gzip.compress(b"".join(RECORDS))
    for broken in (whole[:-9], gzip.compress(b"".join(RECORDS)[:-6]), gzip.compress(RECORDS[0][:20])):
        with pytest.raises(EOFError):
            A.normalised(io.BytesIO(broken), Sink(), lambda _: None)
    with pytest.raises(ValueError, match="version"):
        A.normalised(io.BytesIO(gzip.compress(b"hello\r\n\r\n")), Sink(), lambda _: None)


def test_a_wrong_digest_is_an_error():
    row = {"page_id": 1, "url": b"u", "payload": b"abc", "n_bytes": 3, "digest": hashlib.sha1(b"abd").hexdigest(), "top": None, "top_url": None, "top_n": None, "revisit": False}
    with pytest.raises(ValueError, match="digest"):
        A.parsed(A.record(row, "x"))


def test_files_of_lost_tasks_are_not_read(spark, tmp_path):
    """Leftovers of a failed attempt stand in the folder and change nothing."""
    rows, _ = A.decided(frame(spark, PAGES))
    manifest = A.write(rows, f"file://{tmp_path}/whole")
    members = A.normalise(manifest, f"file://{tmp_path}/members")
    for path in list(Path(tmp_path, "members").glob("*.gz")):
        Path(tmp_path, "members", "stray.warc.gz").write_bytes(path.read_bytes())
        Path(tmp_path, "members", "stray.warc.gz.idx").write_bytes(Path(f"{path}.idx").read_bytes())
    assert found(A.read(A.index(spark, members, f"file://{tmp_path}/members"))) == plain(PAGES)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    answer = con.execute(Q.ORACLES["op11_warc"])
    names = [d[0] for d in answer.description]
    want = Counter(tuple(r[names.index(c)] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in answer.fetchall())
    assert found(Q.op11_warc(spark, DATA)) == want
