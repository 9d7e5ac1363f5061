"""Web archives: exact round trips, revisits, assembly of captures."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tableprep.llm import warc
from tableprep.llm.queries import op11_warc

from helpers import FOLDER, HAVE

SCHEMA = "page_id long, url string, html string, HTML string, row int, first string, `a.b` int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "f", 2) for r in rows], SCHEMA)


def read_back(spark, df, **options):
    found = warc.captures(warc.read(spark, warc.write(df, **options)))
    page = F.filter(F.get("metadata", F.lit(0))["fields"], lambda f: f["name"] == "page-id")
    return found.select(F.get(page, F.lit(0))["value"].cast("long").alias("page_id"), "top", "requests", "metadata", "others").collect()


def expected(rows, least=0):
    """Kind and source of each row, by a plain loop over rows in order."""
    first, out = {}, []
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        again = len(data) >= least and data in first
        out.append((key, data, "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, key)
    return out


TEXTS = ["", None, "a", "a", "\r\n\r\n", "a\r\n", "\r\n", "x\r\n\r\ny", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é\u0000ß😀", "\n\r\n\r\r\n\r\n\r\n", "z" * 3_000_000]


def test_round_trip(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, "http://a/?q=\r\nX: y", f"http://h/{i}"]), t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "http://a/", "".join(rnd.choice("\r\nab") for _ in range(rnd.randrange(12)))) for i in range(300)]
    rows += [(None, None, "only"), (None, "u", "a"), (500, "u", "again"), (500, "u", "again")]
    got = read_back(spark, pages(spark, rows))
    assert len(got) == len(rows)
    want = sorted((k is None, k or 0, hashlib.sha1(d).hexdigest(), kind) for k, d, kind, _ in expected(rows))
    have = sorted((r.page_id is None, r.page_id or 0, base64.b32decode(r.top.payload_digest).hex(), r.top.type) for r in got)
    assert have == want
    texts = {k: d for k, d, _, _ in expected(rows)}
    for r in got:
        assert len(r.requests) == 1 and len(r.metadata) == 1 and not r.others
        if r.top.type == "response":
            assert r.top.digest_ok and bytes(r.top.payload) in (texts[r.page_id], b"only", b"a")
            assert r.top.payload_bytes == len(r.top.payload)
        else:
            assert r.top.payload_bytes == len(texts[r.page_id]) or r.page_id is None
    by_key = {r.page_id: r.top for r in got}
    assert by_key[3].refers_to.startswith("<urn:page:2:") and by_key[1].refers_to.startswith("<urn:page:0:")


def test_small_payloads_never_revisit(spark):
    rows = [(i, "u", t) for i, t in enumerate(["ab", "ab", "abcd", "abcd", "", ""])]
    got = {r.page_id: r.top.type for r in read_back(spark, pages(spark, rows), least=4)}
    assert got == {0: "response", 1: "response", 2: "response", 3: "revisit", 4: "response", 5: "response"}


def test_many_copies_meet_by_either_way(spark, monkeypatch):
    rows = [(i, "u", "hot" if i % 3 else f"t{i % 50}") for i in range(2000)]
    want = sorted((k, kind, src) for k, _, kind, src in expected(rows))

    def found():
        return sorted((r.page_id, r.top.type, int(r.top.refers_to.split(":")[2]) if r.top.refers_to else None)
                      for r in read_back(spark, pages(spark, rows)))

    assert found() == want
    monkeypatch.setattr(warc, "fits_broadcast", lambda *a: False)
    monkeypatch.setattr(warc, "HEAVY", 1)
    assert found() == want


def test_files_per_record_and_foreign_records(spark, tmp_path):
    def record(kind, ident, block, more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode()
        return gzip.compress(head + block + b"\r\n\r\n")

    http = "Content-Type: application/http\r\n"
    (tmp_path / "one.warc.gz").write_bytes(
        record("warcinfo", "i", b"software: x\r\n", "Content-Type: application/warc-fields\r\n")
        + record("response", "r1", b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody", http + "WARC-Concurrent-To: <q1>\r\n")
        + record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", http)
        + record("metadata", "m1", b"k: v\r\nbad line\r\n", "Content-Type: application/warc-fields\r\nWARC-Concurrent-To: <q1>\r\n"))
    (tmp_path / "two.warc.gz").write_bytes(
        record("metadata", "m2", b"", "WARC-Concurrent-To: <nowhere>\r\n")
        + record("resource", "s1", b"data") + record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\n", http + "WARC-Payload-Digest: sha1:WRONG\r\n"))
    got = {r.capture_id: r for r in warc.captures(warc.read(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["<i>", "<m2>", "<r1>", "<r2>", "<s1>"]
    one = got["<r1>"]
    assert one.top.http_status == 404 and bytes(one.top.payload) == b"body"
    assert [r.record_id for r in one.requests] == ["<q1>"] and [r.record_id for r in one.metadata] == ["<m1>"]
    assert [(f.name, f.value) for f in one.metadata[0].fields] == [("k", "v")]
    assert got["<i>"].top is None and [r.type for r in got["<i>"].others] == ["warcinfo"]
    assert got["<m2>"].top is None and len(got["<m2>"].metadata) == 1
    assert got["<r2>"].top.digest_ok is False and got["<s1>"].top.payload_bytes == 4


def test_damaged_files_raise(spark, tmp_path):
    whole = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n"
    for name, data in (("cut", whole), ("other", b"no archive\r\n\r\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.gz").write_bytes(gzip.compress(data))
        with pytest.raises(Exception, match="cut off|not a WARC record"):
            warc.read(spark, str(tmp_path / name)).collect()


def test_empty(spark):
    assert read_back(spark, pages(spark, [])) == []


@pytest.mark.skipif(not HAVE, reason="no tables")
def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    want = sorted((k, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), kind, src) for k, d, kind, src in expected(rows))
    assert sorted(tuple(r) for r in op11_warc(spark, FOLDER).collect()) == want
