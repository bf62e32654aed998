"""Operator 13: legacy ARC archives to WARC, written and read by Spark.

An ARC file begins with a version block whose own lines say its version and the fields of its header lines: in version 1
the URL, address, date, type and length of a document, in version 2 also its result code, checksum, location, offset and
file. ``read_arc`` parses header lines by the fields that the file declares and takes as many bytes as they say.
``converted`` makes of each document what a WARC record needs: an identifier made of where the document stood, so that a
repeated task gives the same one; the date in ISO 8601 (short ones filled up); the type (``response`` for HTTP documents
with a status line, ``resource`` for others, ``warcinfo`` for version blocks); and SHA-1 digests of block and payload.
``deduplicated`` turns responses whose payload another one has into revisits, and ``write_warc`` writes the records.
``read_warc`` reads such archives, each record by its declared length.

Archives are gzip files of text lines as Spark writes and reads them: lines come in the order of a file, and records are
cut out of them one by one, so a worker holds one batch of lines and one record, however long the file is. Files without
compression, which Spark may read in splits, are put in order by file first. Bytes other than UTF-8 pass unchanged. Each
task writes a file of its own; a lost executor repeats its files. What must be compared across records (digests, ids) is
narrow, and copies of a payload meet in aggregations alone, so a payload that a third of the pages have skews nothing.

A null payload is the empty one; null and repeated ids and URLs are kept (a null URL is written as
``http://unknown.invalid/``). White space and control characters of URLs are percent-encoded. A document that ends before
its declared length, and one after which no header line follows, is kept and marked ``truncated``; reading goes on at the
next line that is a header. A file without a version block counts as version 1. Empty tables give archives without
records. Very long payloads are one record each. Of pages, other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktrail.llm.common import handing_back, materialize, shared_path, small, table

# The fields of header lines by version of the format, as version blocks declare them, and what each holds.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_FIELD = {b"URL": rb".+", b"Archive-date": rb"\d{8,14}", b"Content-type": rb".*", b"Result-code": rb"\d{3}|-", b"Offset": rb"\d+|-", b"Archive-length": rb"\d+"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: The header of HTTP documents that carries the id of a row through the archives.
ID_HEADER = "X-Row-Id"
NO_URL = "http://unknown.invalid/"
_BATCH_BYTES = 8 << 20


def _batches(rows: Iterable[tuple], schema: pa.Schema, size_of: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows; of few where the field ``size_of`` is large."""
    own, size = [], 0
    for row in rows:
        own.append(row)
        size += 64 if size_of is None else len(row[size_of] or b"") + 64
        if size >= _BATCH_BYTES or len(own) >= 4096:
            yield _batch(own, schema)
            own, size = [], 0
    if own:
        yield _batch(own, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema.names)


def _each(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[tuple]:
    """The rows of batches as tuples, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)


# ---- files of lines ----------------------------------------------------------------------------------------------


class Feed:
    """A file that comes as lines (without their line feeds), read by line or by length."""

    def __init__(self, lines: Iterator[bytes]):
        self._lines, self._left, self.at = lines, None, 0

    def line(self) -> bytes | None:
        line, self._left = (next(self._lines, None), None) if self._left is None else (self._left, None)
        self.at += 0 if line is None else len(line) + 1
        return line

    def back(self, line: bytes) -> None:
        """The line is read again."""
        self._left = line
        self.at -= len(line) + 1

    def read(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        parts, size = [], 0
        while size < n and (line := self.line()) is not None:
            parts.append(line)
            size += len(line) + 1
        data = b"\n".join([*parts, b""])
        if len(data) > n:
            self.back(data[n:-1])
        return data[:n]

    def filled_line(self) -> bytes | None:
        """The next line with anything in it."""
        while (line := self.line()) is not None:
            if line.strip():
                return line
        return None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of all files, the lines of a file together and in order."""
    raw = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    if all(f.endswith(".gz") for f in raw.inputFiles()):  # read by one task each
        return raw.select("file", "line")
    numbered = raw.withColumn("number", F.monotonically_increasing_id())
    return numbered.repartition("file").sortWithinPartitions("file", "start", "number").select("file", "line")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Feed]]:
    for file, rows in groupby(_each(batches, 4096), key=itemgetter(0)):
        yield file, Feed(line for _, line in rows)


def _written(blocks: DataFrame, path: str, separator: str) -> None:
    """One gzip file for each task, at gzip's fastest level: the column ``block``, each followed by the separator."""
    text = blocks.select(F.col("block").cast("string").alias("value"))
    text.write.option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip", lineSep=separator)


# ---- ARC ---------------------------------------------------------------------------------------------------------


def _url(url: str | None) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or NO_URL).encode())


def version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 sparktrail\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", date: str = "20000101000000", versions: tuple[int, ...] = (1, 2)) -> None:
    """The pages as HTTP documents in ARC files, one for each task, of the given versions in turn."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"pages-{part:06d}.arc"

        def blocks() -> Iterator[tuple[bytes]]:
            first = version_block(version, name, date)
            yield (first,)
            offset = len(first) + 1
            for key, where, content in _each(batches):
                content = content or b""
                own = b"" if key is None else f"{ID_HEADER}: {key}\r\n".encode()
                document = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n%s" % (len(content), own, content)
                fields = {"URL": _url(where).decode(), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(document).hexdigest() if version == 2 else "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(document))}
                block = " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + document
                offset += len(block) + 1
                yield (block,)

        yield from _batches(blocks(), pa.schema([("block", pa.binary())]), 0)

    narrow = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload"))
    _written(narrow.mapInArrow(lambda b: handing_back(b, write), "block binary"), path, "\n")


def header_pattern(fields: Iterable[bytes]) -> re.Pattern[bytes]:
    """A pattern of the header lines of a version, by the fields it declares; values of unknown fields have no spaces."""
    return re.compile(b" ".join(rb"(?P<%s>%s)" % (re.sub(rb"\W", b"_", f), _FIELD.get(f, rb"\S+")) for f in fields) + rb"\s*\Z")


_ARC = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("version", pa.int32()), ("url", pa.binary()), ("ip", pa.binary()), ("date", pa.binary()), ("type", pa.binary()), ("document", pa.binary()), ("truncated", pa.bool_())])


def arc_documents(file: str, feed: Feed) -> Iterator[tuple]:
    """The documents of one ARC file, its version block first, as rows of ``_ARC``."""
    version, pattern = 1, header_pattern(f.encode() for f in ARC_FIELDS[1])
    known = [header_pattern(f.encode() for f in fields) for fields in ARC_FIELDS.values()]
    while (line := feed.filled_line()) is not None:
        at = feed.at - len(line) - 1
        # the version block's own line is of the version that it declares
        found = next((m for m in (p.match(line) for p in reversed(known)) if m), None) if line.startswith(b"filedesc:") else pattern.match(line)
        if not found:
            continue
        told = found.groupdict()
        length = int(told["Archive_length"])
        document = feed.read(length)
        if line.startswith(b"filedesc:"):
            lines = [x.strip() for x in document.split(b"\n")]
            number = lines[0].split(b" ")[0]
            version = int(number) if number.isdigit() else 1
            declared = lines[1].split() if len(lines) > 1 else []
            if {b"URL", b"Archive-date", b"Archive-length"} <= set(declared):
                pattern = header_pattern(declared)
        after = feed.filled_line()
        lost = after is not None and not (pattern.match(after) or after.startswith(b"filedesc:"))
        if after is not None and not lost:
            feed.back(after)
        yield file, at, version, told["URL"], told.get("IP_address"), told["Archive_date"], told.get("Content_type"), document, len(document) < length or lost


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, version, url, ip, date, type, document, truncated) of every document of ARC files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for file, feed in _files(batches) for row in arc_documents(file, feed))
        yield from _batches(rows, _ARC, 7)

    schema = "file string, offset long, version int, url binary, ip binary, date binary, type binary, document binary, truncated boolean"
    return _lines(spark, path).mapInArrow(lambda b: handing_back(b, read), schema)


# ---- WARC records ------------------------------------------------------------------------------------------------

_STATUS = re.compile(rb"HTTP/\d(?:\.\d)?[ \t]+\d{3}")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def iso_date(date: bytes) -> str:
    """A date of 8 to 14 digits as WARC writes it."""
    d = date.decode().ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def digest_label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^%s:[ \t]*([^\r\n]*)" % re.escape(name.encode()), head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def _record(row: tuple) -> tuple:
    """(record_id, kind, uri, ip, date, mime, row_id, head, payload, sha1, sha256, truncated) of an ARC document."""
    file, offset, _, url, ip, date, mime, document, truncated = row
    uri = url.decode("utf-8", "replace")
    name = hashlib.sha1(f"{file.rsplit('/', 1)[-1]} {offset} {uri}".encode()).digest()
    identifier = f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}>"
    head, payload, kind = b"", document, "resource"
    if uri.startswith("filedesc:"):
        kind = "warcinfo"
    elif uri.lower().startswith(("http:", "https:")) and _STATUS.match(document):
        end = _HEAD_END.search(document)
        cut = end.end() if end else len(document)
        head, payload, kind = document[:cut], document[cut:], "response"
    return identifier, kind, uri, (ip or b"").decode("utf-8", "replace"), iso_date(date), (mime or b"").decode("utf-8", "replace"), http_header(head, ID_HEADER), head, payload, hashlib.sha1(payload).digest(), hashlib.sha256(payload).digest(), truncated


_RECORD = "record_id string, kind string, uri string, ip string, date string, mime string, row_id string, head binary, payload binary, sha1 binary, sha256 binary, truncated boolean"
_RECORD_ARROW = pa.schema([*((n, pa.string()) for n in ("record_id", "kind", "uri", "ip", "date", "mime", "row_id")), *((n, pa.binary()) for n in ("head", "payload", "sha1", "sha256")), ("truncated", pa.bool_())])


def converted(documents: DataFrame) -> DataFrame:
    """The documents of ``read_arc`` as WARC records, each with its identifier, type, date, digests and payload."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(map(_record, _each(batches)), _RECORD_ARROW, 8)

    columns = ("file", "offset", "version", "url", "ip", "date", "type", "document", "truncated")
    return documents.select(*columns).mapInArrow(lambda b: handing_back(b, convert), _RECORD)


def deduplicated(records: DataFrame, least: int = 1000) -> DataFrame:
    """``records`` with ``refers_to``, ``refers_uri`` and ``refers_date``: of responses with equal payloads of ``least``
    bytes or more that of the largest row id, for the others.

    Rows that share the largest id are responses all; those without an id are revisits, unless none of a payload has one.
    Payloads are equal if their lengths and two digests are. The records are read twice.
    """
    number = F.col("row_id").cast("long")
    key = ["sha1", "sha256", "size"]
    size = F.octet_length("payload").cast("long")
    narrow = records.filter("kind = 'response'").select("sha1", "sha256", size.alias("size"), number.alias("row"), "record_id", "uri", "date").filter(F.col("size") >= least)
    narrow = materialize(narrow, "digests")
    groups = narrow.groupBy(*key).agg(F.max("row").alias("top"), F.max_by(F.struct("record_id", "uri", "date"), F.struct("row", "record_id")).alias("target"), F.count("*").alias("n")).filter("n > 1 and top is not null")
    groups = small(materialize(groups.drop("n"), "groups"))
    told = records.withColumn("size", size).join(groups, key, "left")
    again = (F.col("kind") == "response") & F.col("top").isNotNull() & ~F.col("top").eqNullSafe(number)
    to = lambda f: F.when(again, F.col(f"target.{f}"))
    return told.select(*records.columns, to("record_id").alias("refers_to"), to("uri").alias("refers_uri"), to("date").alias("refers_date"))


def warc_record(row: tuple) -> bytes:
    """A record as it stands in a file, without the two line ends after it."""
    identifier, kind, uri, ip, date, mime, head, payload, sha1, truncated, refers_to, refers_uri, refers_date = row
    block = head if refers_to else head + payload
    http = kind == "response"
    fields = {
        "WARC-Type": "revisit" if refers_to else kind,
        "WARC-Record-ID": identifier,
        "WARC-Date": date,
        "WARC-Target-URI": None if kind == "warcinfo" else uri,
        "WARC-Filename": uri.removeprefix("filedesc://") if kind == "warcinfo" else None,
        "WARC-IP-Address": ip if ip not in ("", "0.0.0.0", "-") else None,
        "WARC-Profile": REVISIT_PROFILE if refers_to else None,
        "WARC-Refers-To": refers_to,
        "WARC-Refers-To-Target-URI": refers_uri,
        "WARC-Refers-To-Date": refers_date,
        "WARC-Block-Digest": digest_label(hashlib.sha1(block).digest()),
        "WARC-Payload-Digest": digest_label(sha1) if http else None,
        "WARC-Truncated": "unspecified" if truncated else None,
        "Content-Type": "application/http; msgtype=response" if http else mime or "application/octet-stream",
        "Content-Length": str(len(block)),
    }
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields.items() if v is not None), "", ""]
    return "\r\n".join(lines).encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one for each task, of the records of ``deduplicated``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((warc_record(row),) for row in _each(batches)), pa.schema([("block", pa.binary())]), 0)

    columns = ("record_id", "kind", "uri", "ip", "date", "mime", "head", "payload", "sha1", "truncated", "refers_to", "refers_uri", "refers_date")
    _written(records.select(*columns).mapInArrow(lambda b: handing_back(b, write), "block binary"), path, "\r\n\r\n")


_WARC = "file string, offset long, record_id string, kind string, uri string, date string, row_id string, payload_bytes long, payload_digest string, sound boolean, refers_to string, payload binary"
_WARC_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), *((n, pa.string()) for n in ("record_id", "kind", "uri", "date", "row_id")), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("sound", pa.bool_()), ("refers_to", pa.string()), ("payload", pa.binary())])


def warc_records(file: str, feed: Feed, payloads: bool = True) -> Iterator[tuple]:
    """The records of one WARC file as rows of ``_WARC``."""
    while (line := feed.filled_line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        at, told, name = feed.at - len(line) - 1, {}, ""
        while (line := feed.line()) is not None and line.strip():
            text = line.rstrip(b"\r").decode("utf-8", "replace")
            if text[0] in " \t" and name:  # a folded line
                told[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                name = name.strip().lower()
                told[name] = value.strip()
        length = int(told.get("content-length", 0))
        block = feed.read(length)
        head, payload = b"", block
        if told.get("content-type", "").startswith("application/http"):
            end = _HEAD_END.search(block)
            head, payload = (block[: end.end()], block[end.end() :]) if end else (block, b"")
        kind = told.get("warc-type")
        labels = {told.get("warc-block-digest"): block} | ({} if kind == "revisit" else {told.get("warc-payload-digest"): payload})
        sound = len(block) == length and all(digest_label(hashlib.sha1(b).digest()) == label for label, b in labels.items() if label and label.startswith("sha1:"))
        label = told.get("warc-payload-digest") or ""
        sha1 = base64.b32decode(label[5:]).hex() if kind == "revisit" and label.startswith("sha1:") else hashlib.sha1(payload).hexdigest()
        yield file, at, told.get("warc-record-id"), kind, told.get("warc-target-uri"), told.get("warc-date"), http_header(head, ID_HEADER), None if kind == "revisit" else len(payload), sha1, sound, told.get("warc-refers-to"), payload if payloads else None


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of WARC files: file, offset, record_id, kind, uri, date, row_id, payload_bytes (null for a revisit),
    payload_digest (SHA-1 in hex; a revisit's is the declared one), sound (length and digests are as declared), refers_to
    and, if asked for, payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for file, feed in _files(batches) for row in warc_records(file, feed, payloads))
        yield from _batches(rows, _WARC_ARROW, 11)

    return _lines(spark, path).mapInArrow(lambda b: handing_back(b, read), _WARC)


def resolved(records: DataFrame) -> DataFrame:
    """(row_id, payload_bytes, payload_digest, record_type, refers_to) of responses and revisits (of ``read_warc``).

    A revisit's length is that of the response it refers to; ``refers_to`` is that response's row id. A revisit of a record
    that is not there, or has another digest, has a null length.
    """
    own = materialize(records.filter("kind in ('response', 'revisit')").select("record_id", "kind", "row_id", "payload_bytes", "payload_digest", "refers_to"), "records")
    first = own.filter("kind = 'response'").select("row_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    again = own.filter("kind = 'revisit'").select("row_id", "payload_digest", F.col("refers_to").alias("wanted"))
    target = own.filter("kind = 'response'").select(F.col("record_id").alias("wanted"), F.col("row_id").alias("of"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    wanted = materialize(target.join(small(materialize(again.select("wanted").distinct(), "wanted")), "wanted", "left_semi"), "targets")
    met = again.join(small(wanted), "wanted", "left")
    length = F.when(F.col("digest") == F.col("payload_digest"), F.col("bytes"))
    return first.unionByName(met.select("row_id", length.alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to")))


def op13_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files of both versions, converted to WARC with revisits, and read back."""
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    write_warc(deduplicated(converted(read_arc(spark, arc))), warc)
    out = resolved(read_warc(spark, warc, payloads=False))
    return out.select(F.col("row_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP13_SQL = """
WITH held AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM held)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < 1000 OR top IS NULL OR page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 1000 OR page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM sized"""
