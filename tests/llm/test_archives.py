"""ARC files to WARC and back: exact round trips, both versions, damaged files, revisits."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from sparktrail.llm import archives

_SCHEMA = "page_id long, url string, html string"
_TRICKY = [
    (1, "http://a.example/x y", "line one\nline two\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"),
    (2, "http://a.example/", "http://b.example/ 0.0.0.0 20000101000000 text/html 12\nHTTP/1.1 200 OK\n\n"),
    (3, None, None),
    (4, "dns:a.example", ""),
    (5, "http://a.example/ü", "Ünï\x00\x1f  \n\n\n"),
    (6, "https://a.example/long", "z\n" * 60_000 + "end without line end"),
    (None, "http://a.example/none", "no id"),
]


def _plain(rows, least=1000):
    tops = {}
    for key, _, html in rows:
        if key is not None and len((html or "").encode()) >= least:
            tops[html] = max(tops.get(html, key), key)
    out = []
    for key, _, html in rows:
        data, top = (html or "").encode(), tops.get(html)
        again = top is not None and top != key
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def _through(spark, df, folder, **how):
    archives.write_arc(df, f"{folder}/arc", **how)
    archives.write_warc(archives.deduplicated(archives.converted(archives.read_arc(spark, f"{folder}/arc"))), f"{folder}/warc")
    return archives.read_warc(spark, f"{folder}/warc")


def _told(records):
    rows = archives.resolved(records).collect()
    return sorted(((None if r.row_id is None else int(r.row_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in rows), key=str)


@pytest.mark.parametrize("versions", [(1,), (2,), (1, 2)])
def test_round_trip(spark, tmp_path, versions):
    copies = [(100 + i, "http://a.example/copy", "c" * 1000) for i in range(40)] + [(200 + i, "http://a.example/", "d" * 999) for i in range(3)] + [(120, "http://a.example/again", "c" * 1000), (139, "http://a.example/again", "c" * 1000), (None, None, "c" * 1000), (None, None, "e" * 1500), (None, None, "e" * 1500)]
    rows = _TRICKY[:3] + _TRICKY[4:] + copies
    df = spark.createDataFrame(rows, _SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("file", "block", "a.b", "payload")})
    records = _through(spark, df, tmp_path, versions=versions)
    assert _told(records) == _plain(rows)
    assert all(r.sound for r in records.select("sound").collect())
    back = {r.row_id: bytes(r.payload) for r in records.filter("kind = 'response'").collect()}
    assert all(back[str(k)] == (html or "").encode() for k, _, html in _TRICKY if k not in (None, 4))
    infos = records.filter("kind = 'warcinfo'").collect()
    assert len(infos) >= 1 and all(b"0 sparktrail" in bytes(r.payload) for r in infos)
    assert records.select("record_id").distinct().count() == records.count()


def test_documents_of_other_schemes_are_resources(spark, tmp_path):
    records = _through(spark, spark.createDataFrame([_TRICKY[3]], _SCHEMA), tmp_path)
    assert [(r.kind, r.uri) for r in records.filter("kind <> 'warcinfo'").collect()] == [("resource", "dns:a.example")]


def test_empty_table(spark, tmp_path):
    records = _through(spark, spark.createDataFrame([], _SCHEMA), tmp_path)
    assert archives.resolved(records).collect() == []


def _arc(path, data, packed=True):
    with (gzip.open if packed else open)(path, "wb") as f:
        f.write(data)


def test_versions_dates_and_damaged_documents(spark, tmp_path):
    """Files as others write them: short dates, types with spaces, wrong lengths, several members, no version block."""
    folder = tmp_path / "in"
    folder.mkdir()
    http = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\ngone\n"
    one = archives.version_block(1, "one.arc", "19970101") + b"\n"
    one += b"http://a.example/b c.html 10.0.0.1 199702031122 text/html; charset=x %d\n%s\n" % (len(http), http)
    one += b"http://a.example/old 10.0.0.2 19970203112233 text/plain 7\nno head\n"
    one += b"http://a.example/short 10.0.0.3 19970203112233 text/plain 4\nlonger than said\nlines\n"
    one += b"http://a.example/next 10.0.0.4 19970203112233 text/plain 2\nok\n"
    one += b"http://a.example/cut 10.0.0.5 19970203112233 text/plain 500\nhalf"
    _arc(folder / "one.arc.gz", one)
    two = archives.version_block(2, "two.arc", "20010101000000") + b"\nhttp://b.example/ 10.0.0.6 20010203040506 text/html 404 - - 99 two.arc %d\n%s\n" % (len(http), http)
    with open(folder / "two.arc.gz", "wb") as f:  # a member for each half
        f.write(gzip.compress(two[:80]) + gzip.compress(two[80:]))
    _arc(folder / "three.arc.gz", b"http://c.example/ 10.0.0.7 20020101 text/plain 3\nabc\n")
    got = {r.uri: r for r in archives.converted(archives.read_arc(spark, str(folder))).collect()}
    assert got["http://a.example/b c.html"].date == "1997-02-03T11:22:00Z" and got["http://a.example/b c.html"].mime == "text/html; charset=x"
    assert bytes(got["http://a.example/b c.html"].payload) == b"gone\n" and got["http://a.example/b c.html"].kind == "response"
    assert got["http://a.example/old"].kind == "resource" and bytes(got["http://a.example/old"].payload) == b"no head"
    assert got["http://a.example/short"].truncated and bytes(got["http://a.example/next"].payload) == b"ok"
    assert got["http://a.example/cut"].truncated and not got["http://a.example/next"].truncated
    assert got["http://b.example/"].kind == "response" and bytes(got["http://b.example/"].sha1) == hashlib.sha1(b"gone\n").digest()
    assert got["http://c.example/"].date == "2002-01-01T00:00:00Z"


def test_files_without_compression_are_read_in_order(spark, tmp_path):
    """Such a file is split between tasks; its lines are put together again."""
    folder = tmp_path / "plain"
    folder.mkdir()
    body = b"\n".join(b"line %d of many" % i for i in range(2000))
    data = archives.version_block(1, "p.arc", "20000101000000") + b"\n" + b"".join(b"http://p.example/%d 10.0.0.1 20000101000000 text/plain %d\n%s\n" % (i, len(body), body) for i in range(20))
    _arc(folder / "p.arc", data, packed=False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = archives.read_arc(spark, str(folder)).filter("version = 1 and type = 'text/plain'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(bytes(r.document) == body and not r.truncated for r in got) == 20


def test_identifiers_do_not_change(spark, tmp_path):
    archives.write_arc(spark.createDataFrame(_TRICKY, _SCHEMA), f"{tmp_path}/arc")
    ids = lambda: sorted(r[0] for r in archives.converted(archives.read_arc(spark, f"{tmp_path}/arc")).select("record_id").collect())
    assert ids() == ids()
    assert all(f.endswith(".gz") for f in os.listdir(f"{tmp_path}/arc") if f.startswith("part"))


def test_unsound_records_and_missing_targets(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http;\r\n msgtype=response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcde\r\n\r\n"
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <b>\r\nWARC-Refers-To: <z>\r\nContent-Type: application/http\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    folder = tmp_path / "in"
    folder.mkdir()
    _arc(folder / "x.warc.gz", good + again)
    rows = {r.record_id: r for r in archives.read_warc(spark, str(folder)).collect()}
    assert not rows["<a>"].sound and bytes(rows["<a>"].payload) == b"abcde"
    told = archives.resolved(archives.read_warc(spark, str(folder))).filter("record_type = 'revisit'").collect()
    assert [(r.payload_bytes, r.refers_to) for r in told] == [(None, None)]
