import gzip
import hashlib

import pytest

from tallygrid.llm import staging
from tallygrid.llm import warc as W


def rows():
    big, other = "é" * 600, "x" * 999
    return [(1, "http://a/1", big), (2, "http://a/2", big), (5, None, big), (3, "http://b/\r\nX: y", other), (4, "u", other), (6, "u", None), (7, "u", ""), (8, "u", "y" * 1000), (9, "u", "z" * 300000), (9, "u", "z" * 300000)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT_BYTES", 300)
    pages = spark.createDataFrame([(*r, "q") for r in rows()], "page_id long, url string, html string, payload string").repartition(3)
    archives = W.write_archives(pages)
    got = {r.page_id: r for r in W.read_archives(archives).collect()}
    raw = b"".join(gzip.decompress(bytes(r.content)) for r in archives.collect())
    assert raw.count(b"WARC/1.1\r\n") == 10 and raw.count("é".encode() * 600) == 1
    for i, url, html in rows():
        body = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 5) if i in (1, 2) else ("response", None))
        assert r.url == (url and url.replace("\r\n", " "))
    assert W.read_archives(archives).count() == 10


def test_null_and_repeated_ids(spark, monkeypatch):
    one, two, three = "a" * 2000, "b" * 2000, "c" * 2000
    table = [(9, one), (9, two), (9, one), (5, one), (6, two), (None, two), (None, three), (None, three), (None, None), (4, "s"), (4, "s")]
    want = sorted(((p, h, t, r) for (p, h), t, r in zip(table, ["response"] * 3 + ["revisit"] * 3 + ["response"] * 5, [None] * 3 + [9] * 3 + [None] * 5, strict=True)), key=str)
    for limit in (48 << 20, 0):
        monkeypatch.setattr(staging, "BROADCAST_BYTES", limit)
        pages = spark.createDataFrame([(p, "u", h, 1, "d") for p, h in table], "page_id long, url string, html string, payload_bytes int, payload_digest string").repartition(3)
        archives = W.write_archives(pages)
        by_digest = {hashlib.sha1((h or "").encode()).hexdigest(): h for _, h in table}
        got = sorted(((r.page_id, by_digest[r.payload_digest], r.record_type, r.refers_to) for r in W.read_archives(archives).collect()), key=str)
        assert got == want
        ids = [h["WARC-Record-ID"] for r in archives.collect() for h, _ in W.parse(bytes(r.content))]
        assert len(ids) == len(set(ids)) == len(table)


def test_revisit_without_its_response_fails(spark):
    member = W._member(W.record(1, "u", "0" * 40, None, 2))
    lost = spark.createDataFrame([(bytearray(member),)], "content binary")
    with pytest.raises(Exception, match="no response"):
        W.read_archives(lost).collect()
    with pytest.raises(ValueError, match="cut off"):
        list(W.parse(member[:-4]))


def test_many_small_records_in_a_segment():
    raw = b"".join(W._member(W.record(k, "u", "d", b"x" * (k % 7))) for k in range(3000))
    assert [len(b) for _, b in W.parse(raw)] == [k % 7 for k in range(3000)]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.read_archives(W.write_archives(pages)).count() == 0
