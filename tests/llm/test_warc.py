import hashlib

import pytest
import zstandard

from pagewright.llm import warc

LONG = "<p>" + "ab " * 500 + "</p>"
ROWS = [(1, "http://a/1", LONG, 0), (2, "http://a/2\r\nx: y", LONG, 0), (5, None, LONG, 1), (3, "u", "short", 1), (4, "u", "short", 1), (6, "u", None, 2), (7, "u", "", 2), (None, "u", LONG, 3), (8, "u", "é" * 90000, 3), (9, "u", LONG + "é", 3), (9, "u", LONG + "é", 3)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload int")
    folder = warc.write_archives(pages, str(tmp_path / "a"), archive_bytes=3000)
    got = sorted(warc.read_archives(spark, folder).collect(), key=lambda r: (str(r.page_id), r.payload_bytes))
    assert len(got) == len(ROWS)
    want = {(i, (h or "").encode()) for i, _, h, _ in ROWS}
    for r in got:
        full = next(p for i, p in want if i == r.page_id and hashlib.sha1(p).hexdigest() == r.payload_digest)
        assert r.payload_bytes == len(full)
        assert bytes(r.payload) == (b"" if r.record_type == "revisit" else full)
    verdict = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert {v for v in verdict if v[1] == "revisit"} == {(1, "revisit", 5), (2, "revisit", 5), (None, "revisit", 5)}
    assert verdict.count((9, "response", None)) == 2


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(pages, str(tmp_path / "e"))).count() == 0


def archive():
    d = warc.train([b"abc"])
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d))
    p = b"hello" * 30
    one = warc.record_bytes(1, "u", "response", None, p, warc.sha1_header(p), len(p))
    return d, c, p, one


def test_flaws_are_found():
    d, c, p, one = archive()
    good = warc.dictionary_frame(d) + c.compress(one) * 2
    assert [r["block"] for r in warc.read_archive(good)] == [p, p]
    packed = zstandard.ZstdCompressor().compress(d)
    assert len(list(warc.read_archive(warc.dictionary_frame(packed) + c.compress(one)))) == 1
    bad = [good[:-3], good + b"xyz", warc.dictionary_frame(d) + c.compress(one[:-1]), warc.dictionary_frame(d) + c.compress(one.replace(b"hello", b"jello", 1)), warc.dictionary_frame(d) + c.compress(one.replace(b"WARC/1.1", b"WARC/9.9")), warc.dictionary_frame(d) + c.compress(one.replace(b"Content-Length: 150", b"Content-Length: 149")), warc.dictionary_frame(d) + c.compress(one.replace(b"WARC-Date", b"WARC-Dote"))]
    for data in bad:
        with pytest.raises(warc.BadArchive):
            list(warc.read_archive(data))


def test_repeated_headers_and_streams(monkeypatch):
    d, c, p, one = archive()
    twice = one.replace(b"WARC-Date", b"WARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Date", 1)
    assert next(warc.read_archive(warc.dictionary_frame(d) + c.compress(twice)))["head"]["warc-concurrent-to"] == "<a>\n<b>"
    with pytest.raises(warc.BadArchive):
        list(warc.read_archive(warc.dictionary_frame(d) + c.compress(one.replace(b"WARC-Date", b"WARC-Type: response\r\nWARC-Date", 1))))
    good = warc.dictionary_frame(d) + c.compress(one) * 5
    for size in (1, 7, 100):
        monkeypatch.setattr(warc, "CHUNK", size)
        assert [r["block"] for r in warc.read_archive(good)] == [p] * 5
