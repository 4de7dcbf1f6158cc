"""WARC archives: a writer with revisit records, and a salvage reader.

write() makes one WARC/1.1 record a page. Of the pages with equal payloads of at least REVISIT_BYTES bytes, those of the
smallest page_id are responses and the others revisit it. Each record is a gzip member of its own. Spark's own
text writer writes the archives of about ARCHIVE_BYTES, so a lost task leaves no half archive behind.

read() checks each record: version line, header, length, end, block and payload digest. After a failed check it searches
for the next version line or gzip member at which a whole valid record starts, recovers from there, and logs the
bytes between as a quarantined gap with the reason. Plain records and gzip members, of one record or of many, may be
mixed. A member that fails its own check is quarantined whole. An archive is read by one task, up to 2 GiB.

Null payloads are empty. Null ids are written as "null" and read as null; a null id is never referred to while an
id is there. Null URLs have no target line; control characters and blanks of URLs are percent-encoded. Repeated
rows are records of their own. Other columns are ignored. An empty table gives an empty archive folder, read as no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.session import arrow_limits, cut, fresh_path, table

REVISIT_BYTES, ARCHIVE_BYTES, LEVEL, BROADCAST_DIGESTS = 100, 8 << 20, 6, 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
ROWS = "archive string, offset long, length long, status string, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
VERSION, FIELD = re.compile(rb"WARC/1\.\d\r\n"), re.compile(rb"([A-Za-z0-9-]+):")
FIELDS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def quoted(url: str) -> str:
    return re.sub("[%\t\n\x0b\x0c\r \x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def digested(pages: DataFrame) -> DataFrame:
    """(page_id, url, html in UTF-8, n, digest)."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"), F.sha2(html, 256).alias("digest"))


def record(page: int | None, url: str | None, html: bytes, n: int, digest: str, first: int | None = None) -> bytes:
    """A response record, or with first a revisit record that refers to that page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    block = http if first is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quoted(url)}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first)}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "n", "digest")), strict=True)
        packed = [zipped(record(*row)) for row in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "n", "digest")), pa.array(packed, pa.binary())], names=["page_id", "url", "n", "digest", "member"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Each page's member: the one it has, or else its record, compressed now."""
    for batch in batches:
        for i, u, html, n, d, m, f in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "n", "digest", "member", "first")), strict=True):
            if f is not None and f != i:
                yield zipped(record(i, u, b"", n, d, f))
            else:
                yield zipped(record(i, u, html, n, d)) if m is None else m


def settling(pages: DataFrame, revisit_bytes: int, broadcast_digests: int) -> DataFrame:
    """What settle() takes. While at most broadcast_digests payloads repeat, their digests are broadcast and no page is shuffled; the payloads of revisits stay behind. Beyond that pages are compressed first and joined with the digests by a shuffle, whose hot digests can be split; those that turn out to be revisits get another record then. Either way a task has one Python worker at a time: each takes memory of its own."""
    p = digested(pages)
    first = p.filter(F.col("n") >= revisit_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("same")).filter("same > 1").drop("same")
    first = cut(first, "digests")
    if first.count() <= broadcast_digests:
        p = p.join(F.broadcast(first), F.col("digest") == F.col("d"), "left")
        return p.withColumns({"html": F.when(F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id")), F.col("html")), "member": F.lit(None).cast("binary")}).drop("d")
    p = p.mapInArrow(compress, "page_id long, url string, n long, digest string, member binary")
    return p.join(first.hint("merge"), F.col("digest") == F.col("d"), "left").withColumn("html", F.lit(None).cast("binary")).drop("d")


def members(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """(member): each page's record as a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(settle(iter([batch])), pa.binary())], names=["member"])

    return settling(pages, revisit_bytes, broadcast_digests).mapInArrow(run, "member binary")


def write(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, broadcast_digests: int = BROADCAST_DIGESTS) -> None:
    """Archives of about archive_bytes: a task's members are put together in memory up to that size, a row an archive, and Spark's text writer writes a file a row; what it writes after each row is an empty gzip member, which ends the file."""
    arrow_limits(pages.sparkSession)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for m in settle(batches):
            held.append(m)
            size += len(m)
            if size >= archive_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    out = settling(pages, revisit_bytes, broadcast_digests).mapInArrow(bundle, "archive binary").select(F.col("archive").cast("string").alias("value"))
    out.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", zipped(b"").decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


class Damaged(ValueError):
    """A record that fails a check."""


def number(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


class Archive:
    """An archive's bytes. Remembers where the next header ends, so a search from many places looks at no byte twice."""

    def __init__(self, data: bytes) -> None:
        self.data, self.seen = data, (0, -1)

    def header_end(self, at: int) -> int:
        """Where the header that starts at this byte ends; the archive's length if nowhere."""
        if not self.seen[0] <= at <= self.seen[1]:
            end = self.data.find(b"\r\n\r\n", at)
            self.seen = (at, len(self.data) if end < 0 else end)
        return self.seen[1]


def header(archive: Archive, at: int) -> tuple[int, dict[str, str]]:
    """Where the block begins, and the fields by their lower-cased names. Lines are looked at one by one, up to the first that is malformed."""
    if not VERSION.match(archive.data, at):
        raise Damaged("no version line")
    end, head = archive.header_end(at), {}
    if end == len(archive.data):
        raise Damaged("no end of the header")
    at += 10
    while at < end:
        stop = archive.data.find(b"\r\n", at, end)
        stop = end if stop < 0 else stop
        m = FIELD.match(archive.data, at, stop)
        name = m and m[1].decode().lower()
        if not name or name in head:
            raise Damaged("a header line is malformed or comes twice")
        head[name] = archive.data[m.end() : stop].decode("utf-8", "replace").strip()
        at = stop + 2
    return end + 4, head


def parsed(archive: Archive, at: int) -> tuple[int, dict]:
    """The end of the plain record at this byte, and what it holds."""
    data = archive.data
    start, head = header(archive, at)
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        raise Damaged("no content length")
    end = start + int(head["content-length"])
    if data[end : end + 4] != END.encode():
        raise Damaged("the record doesn't end where its length says")
    block = data[start:end]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest")
    kind = head.get("warc-type")
    http, _, payload = block.partition(END.encode())
    said = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != said:
            raise Damaged("payload digest")
        size = len(payload)
    else:
        m = re.search(rb"(?im)^content-length: *(\d+)", http)
        size = int(m[1]) if m else None
    return end + 4, {"page_id": number(head.get("warc-record-id")), "url": unquoted(head.get("warc-target-uri")), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": number(head.get("warc-refers-to"))}


def unquoted(uri: str | None) -> str | None:
    return uri and re.sub("%(09|0A|0B|0C|0D|20|25|7F)", lambda m: chr(int(m[1], 16)), uri)


def member(data: bytes, at: int) -> tuple[int, bytes]:
    """The end of the gzip member at this byte, and its content; its CRC is checked."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= len(data):
                raise Damaged("the gzip member is cut off")
            out.append(z.decompress(data[pos : pos + 65536]))
            pos += 65536
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    return min(pos, len(data)) - len(z.unused_data), b"".join(out)


def records_at(archive: Archive, at: int) -> tuple[int, list[tuple[int, int, str | None, dict]]]:
    """The end of the plain record or gzip member at this byte, and its rows. All records of a member have the member's place; what is damaged between them is a gap there."""
    if archive.data[at : at + 2] != b"\x1f\x8b":
        end, got = parsed(archive, at)
        return end, [(at, end - at, None, got)]
    end, plain = member(archive.data, at)
    rows = list(salvage(plain)) or [(0, 0, None, {})]
    if rows[0][2] and len(rows) == 1:
        raise Damaged(rows[0][2])
    return end, [(at, end - at, why and f"in a gzip member: {why}", got) for _, _, why, got in rows]


def salvage(data: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """(offset, length, reason, record): the valid records in order, and the gaps between them, which have a reason. An empty gzip member, which may end an archive, has an empty record."""
    archive, at, gap, why = Archive(data), 0, None, ""
    version, gzip = -1, -1
    while at < len(data):
        try:
            end, rows = records_at(archive, at)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            version, gzip = (x if x > at or x == len(data) else f if (f := data.find(mark, at + 1)) >= 0 else len(data) for x, mark in ((version, b"WARC/1."), (gzip, b"\x1f\x8b\x08")))
            at = min(version, gzip)
            continue
        if gap is not None:
            yield gap, at - gap, why, {}
            gap = None
        yield from rows
        at = end
    if gap is not None:
        yield gap, at - gap, why, {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives (status ok) and for each quarantined gap (status gap, with its reason). path: a file, a folder or a pattern; every file counts, whatever its name, but hidden ones (_ or . first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = [(name.as_py(), a, n, "gap" if why else "ok", why, *(got.get(k) for k in FIELDS)) for a, n, why, got in salvage(content.as_py()) if why or got]
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                cols = list(zip(*rows, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["archive", "offset", "length", "status", "reason", *FIELDS])

    arrow_limits(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).filter("status = 'ok'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) n, sha256(h) d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) lowest FROM q)
SELECT page_id, n payload_bytes, d payload_digest,
  CASE WHEN n >= 100 AND lowest IS NOT NULL AND page_id IS DISTINCT FROM lowest THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN n >= 100 AND lowest IS NOT NULL AND page_id IS DISTINCT FROM lowest THEN lowest END refers_to
FROM f
"""
