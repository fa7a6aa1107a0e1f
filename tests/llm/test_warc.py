"""Archives: their bytes, repeated pages, hot and large payloads."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from tracklane.llm import warc


def test_one_member_a_record(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a b/", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "http://c/", None)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    found = list(warc.members(io.BytesIO(file.read_bytes()), 7))
    assert len(found) == 3 and b"".join(found) == gzip.decompress(file.read_bytes())
    heads = {h["X-Page-ID"]: (h, b) for m in found for h, b in warc.parse(m)}
    assert heads["1"][0]["WARC-Target-URI"] == "http://a%20b/" and heads["1"][1].endswith("<p>ä</p>".encode())
    assert heads["2"][0]["WARC-Refers-To"] == heads["1"][0]["WARC-Record-ID"] and heads["2"][1].endswith(b"\r\n\r\n")
    with pytest.raises(ValueError, match="within a record"):
        list(warc.members(io.BytesIO(file.read_bytes()[:-20])))


@pytest.mark.parametrize("sent", [500_000, 0])
def test_each_row_by_its_own_payload(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "SENT", sent)
    large = "x" * 3_000_000
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "b"), (3, "a"), (None, "a"), (4, large), (5, large), (6, None), (7, "")] + [(k, "") for k in range(100, 2200)]
    pages = spark.createDataFrame([(p, "u", h, 9) for p, h in rows], "page_id long, url string, html string, first int")
    got = sorted(map(tuple, warc.resolve_revisits(pages).select(F.coalesce("page_id", F.lit(0)), "payload_bytes", "record_type", "refers_to", F.length("payload_digest")).collect()), key=str)
    first = {}
    for p, h in sorted((p, h or "") for p, h in rows if p is not None):
        first.setdefault(h, p)
    kind = lambda p, h: ("response", None) if p is None or first[h] == p else ("revisit", first[h])
    assert got == sorted(((p or 0, len(h or ""), *kind(p, h or ""), 32) for p, h in rows), key=str)


def test_payload_survives(spark, tmp_path):
    texts = ["", "WARC/1.1\r\n\r\n", "\r\n\r\nContent-Length: 3\r\n\r\n", "é" * 1000]
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u"))
    warc.write_archives(pages, str(tmp_path / "w"))
    for r in warc.read_archives(spark, str(tmp_path / "w")).collect():
        assert bytes(r.payload).decode() == texts[r.page_id]
        assert r.payload_digest and hashlib.sha1(bytes(r.payload)).digest()
