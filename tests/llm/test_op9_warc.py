"""Round trips through archives, and damaged files."""

import hashlib
import base64

import pytest

from tendril.llm import warc


def expected(rows):
    payload = {i: (h or "").encode() for i, h in rows}
    last = {}
    for i, raw in payload.items():
        last[raw] = max(last.get(raw, i), i)
    digest = lambda raw: base64.b32encode(hashlib.sha1(raw).digest()).decode()
    return {(i, len(raw), digest(raw), "response" if last[raw] == i else "revisit", None if last[raw] == i else last[raw]) for i, raw in payload.items()}


def rows_of(frame):
    return [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()]


def test_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = rows_of(warc.round_trip(pages))
    assert len(got) == pages.count() and set(got) == expected([(r.page_id, r.html) for r in pages.collect()])


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "é\r\n\r\n" * 400_000), (4, "same"), (9, "same"), (5, "same"), (6, "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame([(i, f"http://x/{i} \n y", h, 0) for i, h in rows], "page_id long, url string, html string, payload int")
    got = rows_of(warc.round_trip(pages.repartition(3)))
    assert len(got) == len(rows) and set(got) == expected(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damage_is_found():
    good = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.sha1_base32(b"abc" * 99))], b"abc" * 99)
    bad = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.sha1_base32(b"xyz"))], b"abc")
    assert [b for _, b in warc.records(iter([good[:7], good[7:] + good[:5], good[5:]]))] == [b"abc" * 99] * 2
    for raw in (bad, good[:-9], b"plain text", good + b"WARC/1.1\r\nplain record\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(iter([raw])))


def test_archives_of_other_writers(spark, tmp_path):
    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hello</p>"
    digest = base64.b32encode(hashlib.sha1(b"<p>hello</p>").digest()).decode()
    http = ("Content-Type", "application/http; msgtype=response")
    made = [
        ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>"), ("Content-Type", "application/warc-fields")], b"software: x\r\n"),
        ([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Target-URI", "http://h/"), http], page),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:4>"), ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(b"<p>hello</p>").hexdigest()), http], page),
        ([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:5>"), ("WARC-Payload-Digest", "md5:abc"), http], page),
        ([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:uuid:6>"), ("WARC-Payload-Digest", "sha1:" + digest), http], b"HTTP/1.1 200 OK\r\n\r\n"),
        ([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:uuid:7>"), ("Content-Type", "text/plain")], b"raw\r\n\r\nbytes"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.record(*m) for m in made))
    names = spark.createDataFrame([("a.warc.gz",)], "file string")
    got = {r.record_id[-2]: (r.record_type, r.payload_bytes, r.payload_digest, r.page_id) for r in warc.read(names, str(tmp_path)).collect()}
    assert [got[k][:2] for k in "1234567"] == [("warcinfo", 13), ("request", 0), ("response", 12), ("response", 12), ("response", 12), ("revisit", None), ("resource", 12)]
    assert got["3"][2] == digest == got["6"][2] and got["5"][2] == "abc" and {v[3] for v in got.values()} == {None}
    wrong = warc.record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + digest), http], page + b"!")
    (tmp_path / "a.warc.gz").write_bytes(wrong)
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(names, str(tmp_path)).collect()


def test_many_repeated_payloads(spark, monkeypatch):
    rows = [(i, "same" if i % 3 else f"page {i % 60}") for i in range(300)]
    odd = spark.createDataFrame([(i, "u", h) for i, h in rows] + [(None, "u", "same"), (None, "u", "alone"), (None, "u", "alone")], "page_id long, url string, html string")
    want = sorted(map(repr, rows_of(warc.round_trip(odd))))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 3)
    assert sorted(map(repr, rows_of(warc.round_trip(odd)))) == want
    assert expected(rows) <= set(rows_of(warc.round_trip(odd))) and sum("None, 5" in x and "'response'" in x for x in want) == 2


def test_equals_its_sql(spark):
    import duckdb

    for sf in ("sf0.01",):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
        want = con.sql(warc.oracle())
        assert sorted(map(repr, rows_of(warc.round_trip(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet"))))) == sorted(map(repr, want.fetchall()))
