"""Legacy archive converter: ARC files of version 1 and 2 to WARC.

An ARC file starts with a version block (a ``filedesc`` record whose body names the
version and the fields of the header lines). Each record is a header line, its last
field the length of the body, and the body. Version 1 has five fields, version 2 ten;
fields are taken from the right, since an address may hold a space. The converter
follows declared lengths; a line that is no header is skipped up to the next one that
is.

For every record it makes what WARC asks for: an identifier (name-based, from file,
place and digest, so that a repeated task writes the same one), an ISO time from the
14-digit date, the record type, block and payload digests (base32 SHA-1) and the content
type. Among equal payloads of at least ``min_bytes`` bytes the record with the smallest
page number is the response and all others are revisits of it, which hold the
HTTP head only.

Files are written and read by Spark: a WARC record ends in two line ends, which is the
row separator of the text writer, so tasks that run twice leave one copy. Of the
payloads one copy is shuffled; digests meet by groups that are summed up before the
shuffle.

Defined results: a NULL payload is empty; a NULL url becomes ``about:blank``; a NULL
page number stays NULL, sorts after all others and can be referred to only as NULL;
repeated rows are one record each; an empty table gives no records; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.common import bounded_batches, shared_folder

# Format words of both archive kinds. Fixed values.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HEADER = re.compile(rb"^\S.* [0-9]{1,3}(?:\.[0-9]{1,3}){3} [0-9]{8,14} .*[0-9]+$")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
# A name of Hadoop's; the usual level writes files a few per cent smaller and takes longer.
GZIP_LEVEL = "THREE"
CHUNK = 1 << 20


class Bytes:
    """Lines and blocks of a file's content, plain or gzip (any number of members), inflated piece by piece."""

    def __init__(self, content: bytes):
        self.rest, self.buffer, self.at, self.place = content, b"", 0, 0
        self.zip = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if not self.rest:
            return False
        if self.zip is None:
            piece, self.rest = self.rest, b""
        else:
            piece = self.zip.decompress(self.rest, CHUNK)
            self.rest = self.zip.unconsumed_tail
            if self.zip.eof:
                self.rest, self.zip = self.zip.unused_data, zlib.decompressobj(31)
        self.buffer, self.at = self.buffer[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None when nothing is left."""
        while (end := self.buffer.find(b"\n", self.at)) < 0 and self._more():
            pass
        if end < 0:
            end = len(self.buffer)
            if end == self.at:
                return None
        out = self.buffer[self.at : end]
        self.place += end + 1 - self.at
        self.at = min(end + 1, len(self.buffer))
        return out.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            part = self.buffer[self.at : self.at + n - have]
            self.at += len(part)
            have += len(part)
            parts.append(part)
            if have < n and self.at >= len(self.buffer) and not self._more():
                break
        self.place += have
        return b"".join(parts)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, payload); a body that is no HTTP message is all payload."""
    if body[:5] != b"HTTP/":
        return b"", body
    end = body.find(b"\r\n\r\n")
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of an ARC file in order, its version block left out."""
    source, version = Bytes(content), 1
    while True:
        place = source.place
        line = source.line()
        if line is None:
            return
        if not HEADER.match(line):
            continue
        if line.startswith(b"filedesc:"):
            block = source.take(int(line.rsplit(b" ", 1)[1]))
            version = int(block[:1]) if block[:1] in b"12" and block[:1] else 1
            continue
        fields = line.rsplit(b" ", 4 if version == 1 else 9)
        if len(fields) != (5 if version == 1 else 10):
            continue
        head, payload = split_http(source.take(int(fields[-1])))
        yield {
            "place": place,
            "uri": fields[0].decode("utf-8", "replace"),
            "ip": fields[1].decode("ascii", "replace"),
            "date": iso_date(fields[2]),
            "mime": fields[3].decode("ascii", "replace"),
            "head": head,
            "payload": payload,
        }


def iso_date(digits: bytes) -> str:
    d = digits.decode().ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def page_number(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n", head)
    return int(found[1]) if found else None


def _render(date: str):
    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, begun = 1 + TaskContext.get().partitionId() % 2, False
        for batch in batches:
            rows = []
            if not begun:
                body = b"%d 0 stationflow\n%s\n" % (version, FIELDS[version])
                name = b"filedesc://pages.arc 0.0.0.0 %s text/plain " % date.encode()
                rows.append(name + (b"" if version == 1 else b"200 - - 0 pages.arc ") + b"%d\n" % len(body) + body)
                begun = True
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                mark = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"\r\n" + payload
                uri = re.sub(rb"\s", b"%20", (url or "about:blank").encode("utf-8", "surrogatepass"))
                more = b"" if version == 1 else b"200 - - 0 pages.arc "
                rows.append(b"%s 0.0.0.0 %s text/html %s%d\n%s" % (uri, date.encode(), more, len(body), body))
            yield pa.record_batch({"record": pa.array(rows, pa.binary())})

    return arcs


def write_arc(pages: DataFrame, folder: str, date: str = "20200101000000") -> None:
    """Pages (page_id, url, html) as gzipped ARC files, of version 1 and 2 in turn."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.col("html")).mapInArrow(_render(date), "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("zlib.compress.level", GZIP_LEVEL).option(
        "compression", "gzip"
    ).text(folder)


RECORD = (
    "archive string, place long, page_id long, uri string, ip string, date string, mime string,"
    " digest string, size long, block_digest string, head binary, payload binary"
)
_KINDS = {
    "archive": pa.string(), "place": pa.int64(), "page_id": pa.int64(), "uri": pa.string(), "ip": pa.string(),
    "date": pa.string(), "mime": pa.string(), "digest": pa.string(), "size": pa.int64(), "block_digest": pa.string(),
    "head": pa.binary(), "payload": pa.binary(),
}


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})


def _in_batches(rows: Iterator[dict], kinds: dict, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("payload") or b"")
        if size >= most:
            yield _batch(held, kinds)
            held, size = [], 0
    yield _batch(held, kinds)


def _parser(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for k in range(batch.num_rows):
                    path = batch.column(0)[k].as_py()
                    for r in arc_records(batch.column(1)[k].as_py()):
                        r |= {
                            "archive": path, "page_id": page_number(r["head"]), "digest": digest(r["payload"]),
                            "size": len(r["payload"]), "block_digest": digest(r["head"] + r["payload"]) if with_payload else None,
                        }
                        yield r if with_payload else r | {"head": None, "payload": None}

        return _in_batches(rows(), _KINDS)

    return parse


def read_arc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per ARC record below ``folder``. A file's content (compressed, if it is) is held by its task."""
    bounded_batches(spark, 1)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(_parser(with_payload), RECORD)


def record_id(archive: str, place: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{place}#{payload_digest}')}>"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own = record_id(r["archive"], r["place"], r["digest"])
            first = record_id(r["to_archive"], r["to_place"], r["digest"])
            revisit = own != first
            http = bool(r["head"])
            block = r["head"] if revisit else r["head"] + r["payload"]
            lines = [
                "WARC/1.1",
                f"WARC-Type: {'revisit' if revisit else 'response' if http else 'resource'}",
                f"WARC-Record-ID: {own}",
                f"WARC-Target-URI: {r['uri']}",
                f"WARC-Date: {r['date']}",
                f"WARC-IP-Address: {r['ip']}",
                f"WARC-Payload-Digest: sha1:{r['digest']}",
                f"WARC-Block-Digest: sha1:{digest(block) if revisit else r['block_digest']}",
                f"Content-Type: {'application/http; msgtype=response' if http else r['mime']}",
            ]
            if revisit:
                lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first}", "WARC-Truncated: length"]
            lines.append(f"Content-Length: {len(block)}")
            out.append(("\r\n".join(lines) + END).encode("utf-8", "surrogatepass") + block)
        yield pa.record_batch({"record": pa.array(out, pa.binary())})


def convert(spark: SparkSession, arcs: str, warcs: str, min_bytes: int = 0, per_file: int = 20_000) -> None:
    """Convert all ARC files below ``arcs`` to gzipped WARC files in the new folder ``warcs``."""
    index = read_arc(spark, arcs, with_payload=False).select("archive", "place", "page_id", "digest", "size")
    own = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "place")
    large = index.where(F.col("size") >= min_bytes)
    firsts = large.groupBy("digest").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = (
        large.join(firsts.select("digest", "first"), "digest")
        .where((F.col("archive") != F.col("first.archive")) | (F.col("place") != F.col("first.place")))
        .select("archive", "place", F.col("first.archive").alias("to_archive"), F.col("first.place").alias("to_place"))
    )
    joined = (
        read_arc(spark, arcs).join(later, ["archive", "place"], "left")
        .withColumns({"to_archive": F.coalesce("to_archive", "archive"), "to_place": F.coalesce("to_place", "place")})
        .select("archive", "place", "uri", "ip", "date", "mime", "digest", "block_digest", "head", "payload", "to_archive", "to_place")
    )
    bounded_batches(spark, 64)
    joined.mapInArrow(_compose, "record binary").select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", END
    ).option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).option("maxRecordsPerFile", per_file).text(warcs)


def warc_records(content: bytes) -> Iterator[dict]:
    source = Bytes(content)
    while (line := source.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while line := source.line():
            name, _, value = line.partition(b":")
            fields[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
        block = source.take(int(fields.get("content-length", 0)))
        http = fields.get("content-type", "").startswith("application/http")
        head, payload = split_http(block) if http else (b"", block)
        yield fields | {"head": head, "payload": payload}


WARC = (
    "record_id string, type string, uri string, date string, digest string, refers_to_id string,"
    " page_id long, size long, payload_ok boolean, payload binary"
)
_WARC_KINDS = {
    "record_id": pa.string(), "type": pa.string(), "uri": pa.string(), "date": pa.string(), "digest": pa.string(),
    "refers_to_id": pa.string(), "page_id": pa.int64(), "size": pa.int64(), "payload_ok": pa.bool_(), "payload": pa.binary(),
}


def _warc_parser(with_payload: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for content in batch.column(0):
                    for r in warc_records(content.as_py()):
                        revisit = r.get("warc-type") == "revisit"
                        said = r.get("warc-payload-digest", "").removeprefix("sha1:")
                        found = said if revisit else digest(r["payload"])
                        yield {
                            "record_id": r.get("warc-record-id"), "type": r.get("warc-type"),
                            "uri": r.get("warc-target-uri"), "date": r.get("warc-date"), "digest": found,
                            "refers_to_id": r.get("warc-refers-to"), "page_id": page_number(r["head"]),
                            "size": None if revisit else len(r["payload"]), "payload_ok": found == said,
                            "payload": r["payload"] if with_payload and not revisit else None,
                        }

        return _in_batches(rows(), _WARC_KINDS)

    return parse


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per WARC record; ``digest`` is worked out anew from what was read, but for revisits."""
    bounded_batches(spark, 1)
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(_warc_parser(with_payload), WARC)


def archived_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back; one row per page."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "archive")
    write_arc(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc", min_bytes)
    read = read_warc(spark, f"{folder}/warc", with_payload=False)
    first = read.where("type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("size").alias("first_size")
    )
    return read.join(first, "refers_to_id", "left").select(
        "page_id",
        F.coalesce("size", "first_size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.when(F.col("type") == "revisit", "revisit").otherwise("response").alias("record_type"),
        "refers_to",
        "uri",
        "record_id",
        "payload_ok",
    )
