"""WARC archives: a writer, and a reader that salvages what it can from damaged files.

Writer: one record per page, each a gzip member of its own, in archives of bounded size. Of records with equal payloads the
one with the largest page id is a ``response``, the others are ``revisit`` records that name it. Archives are written by
Spark's own writer, so any folder that Spark can write to will do. An archive opens with a ``warcinfo`` record and closes with
a short ``metadata`` record that says how many pages it holds; the last byte of a short gzip member is zero, and Spark's text
writer sets it as the end of its row.

Reader: goes from record to record. Every member has to decompress with a right checksum, every record needs a version
line, a header, as many bytes as it announces, the two line feeds behind them, and block and payload digests that agree.
After a failed check it looks for the next gzip member or version line whose record passes all of them, goes on from there,
and logs the bytes between as a gap with the reason. Zero bytes and line ends between records are padding, no gap.

Defined results: a null html is an empty payload, a null url leaves the target out, a null id the page header; null ids are
smaller than all others. Rows that repeat an id and a payload are written each; if theirs is the largest id, each is a
response. Rows of one id with different payloads are told apart by their digests. Headers are percent-encoded, so that a line
feed in a url starts no header. An empty table gives an empty archive folder and no rows. An archive is read by one task (Spark's
binary reader takes at most 2 GB); those written here hold about ``ARCHIVE`` bytes or one larger page.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.plans.scale import work_dir

ARCHIVE = 8 << 20  # compressed bytes of an archive
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|WARC/[0-9]\.[0-9]\r?\n")
PADDING = re.compile(rb"[\x00\r\n]*")
HEADER = 1 << 16  # a header is at most this long
END = re.compile(rb"\r?\n\r?\n")


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else quote(str(page_id), safe='')}>"


def page_record(page_id, url: str | None, html: bytes, refers_to, date: str) -> bytes:
    """The record of one page; ``refers_to`` (None: a response) is the page that holds its payload."""
    digest = sha1(html)
    common = [("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    if refers_to is None:
        return record("response", common, head + html)
    return record("revisit", [*common, ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)], head)


def member(data: bytes) -> bytes:
    return gzip.compress(data, 6, mtime=0)


def with_origin(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html`` (bytes) and ``refers_to``: the largest id with the same payload, if that is another.

    Only ids and digests meet by digest (the largest id per task first); pages then get theirs by id and digest, so a payload
    that very many pages share makes no large partition of pages.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    light = rows.filter(F.octet_length("html") >= least).select("page_id", "digest")
    largest = light.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min(F.struct(F.col("page_id").isNotNull(), "page_id")).alias("least"))
    # Groups of one id have no revisits.
    largest = largest.filter(~F.col("least.page_id").eqNullSafe(F.col("refers_to"))).drop("least")
    again = light.distinct().join(largest, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("__again"), F.col("digest").alias("__digest"), "refers_to")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("__again")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, least: int = 0, archive: int = ARCHIVE, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all ``pages`` (``page_id, url, html``) in ``folder``. Payloads of under ``least`` bytes are never revisited."""

    def closed(members: list[bytes]) -> bytes:
        last = member(record("metadata", [("WARC-Record-ID", "<urn:archive:end>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                             b"pages: %d\r\n" % (len(members) - 1)))
        return b"".join([*members, last])[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = member(record("warcinfo", [("WARC-Record-ID", "<urn:archive:start>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")],
                             b"format: WARC File Format 1.1\r\n"))
        members, size = [info], 0
        for b in batches:
            for page_id, url, html, origin in zip(*b.columns, strict=True):
                members.append(member(page_record(page_id.as_py(), url.as_py(), html.as_py(), origin.as_py(), date)))
                size += len(members[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([closed(members)], pa.binary())], ["archive"])
                    members, size = [info], 0
        if len(members) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([closed(members)], pa.binary())], ["archive"])

    (with_origin(pages, least).mapInArrow(run, "archive binary").select(F.col("archive").cast("string"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder))


class Damage(Exception):
    """Why the bytes at a place are no valid record."""


def parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: headers (lower-case names), block, and where it ends."""
    top = bytes(data[at:at + HEADER])
    if not re.match(rb"WARC/[0-9]\.[0-9]\r?\n", top):
        raise Damage("no version line")
    end = END.search(top)
    if not end:
        raise Damage("header without end")
    headers: dict[str, str] = {}
    for line in re.split(rb"\r?\n", top[:end.start()])[1:]:
        key, mark, value = line.partition(b":")
        if not mark or not key.strip():
            raise Damage("broken header line")
        key = key.strip().decode("utf-8", "replace").lower()
        if key in headers and key != "warc-concurrent-to":  # two headers run into each other
            raise Damage("repeated header field")
        headers[key] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Damage("missing header field")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Damage("no content length")
    start = at + end.end()
    stop = start + int(size)
    if stop > len(data):
        raise Damage("block cut short")
    after = bytes(data[stop:stop + 4])
    if after != b"\r\n\r\n" and after[:2] != b"\n\n":
        raise Damage("no end behind the block")
    block = bytes(data[start:stop])
    check(headers, block)
    return headers, block, stop + (4 if after == b"\r\n\r\n" else 2)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").replace(" ", "").startswith("application/http"):
        return block[m.end():] if (m := END.search(block)) else b""
    return block


def check(headers: dict[str, str], block: bytes) -> None:
    for key, part in (("warc-block-digest", block), ("warc-payload-digest", None)):
        kind, _, want = headers.get(key, "").partition(":")
        if kind.lower() != "sha1" or part is None and headers.get("warc-type") == "revisit":
            continue  # other digests are not checked; a revisit's payload lies elsewhere
        if sha1(payload_of(headers, block) if part is None else part) != want.upper():
            raise Damage(f"wrong {key.removeprefix('warc-').replace('-', ' ')}")


def unzip(data: memoryview, at: int) -> tuple[bytes, int]:
    """The gzip member at ``at`` and where it ends."""
    z = zlib.decompressobj(31)
    out, pos, step = [], at, 1 << 16
    try:
        while not z.eof:
            piece = data[pos:pos + step]
            if not piece:
                raise Damage("member cut short")
            out.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        raise Damage("member does not decompress") from e
    return b"".join(out), pos - len(z.unused_data)


def records_at(data: memoryview, at: int) -> tuple[list[tuple[dict[str, str], bytes]], int]:
    """The valid records that begin at ``at`` (all those of a gzip member, or one) and where they end."""
    if data[at:at + 2] != b"\x1f\x8b":
        headers, block, end = parse(data, at)
        return [(headers, block)], end
    inner, end = unzip(data, at)
    found, pos = [], PADDING.match(inner).end()
    while pos < len(inner):
        headers, block, pos = parse(inner, pos)
        found.append((headers, block))
        pos = PADDING.match(inner, pos).end()
    return found, end


def salvage(data: bytes) -> Iterator[tuple]:
    """``("record", offset, length, headers, block)`` and ``("gap", offset, length, reason)`` in the order of the file."""
    view, at, n = memoryview(data), 0, len(data)
    while (at := PADDING.match(data, at).end()) < n:
        try:
            found, end = records_at(view, at)
        except Damage as e:
            reason, first, found = str(e), at, []
            for m in START.finditer(data, at + 1):
                try:
                    found, end = records_at(view, at := m.start())
                    break
                except Damage:
                    continue
            if not found:
                yield "gap", first, n - first, reason
                return
            yield "gap", first, at - first, reason
        for headers, block in found:
            yield "record", at, end - at, headers, block
        at = end


def read(spark: SparkSession, folder: str, payloads: bool = True, id_type: str = "string") -> DataFrame:
    """What is in the archives of a folder, gaps included: ``archive, offset, length, kind`` (record or gap), ``reason`` (of a gap),
    ``record_type, page_id, url, payload_digest, payload_bytes, refers_to, payload`` (null unless asked for; a revisit has none)."""

    def page(value: str | None) -> str | None:
        return unquote(value[10:-1]) or None if value and value.startswith("<urn:page:") else None

    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("reason", pa.string()),
                        ("record_type", pa.string()), ("page", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(*b.columns, strict=True):
                rows, size = [], 0
                for kind, at, length, *more in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((path.as_py(), at, length, kind, more[0], *[None] * 7))
                    else:
                        h, block = more
                        type_ = h.get("warc-type")
                        body = None if type_ == "revisit" else payload_of(h, block)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (None if body is None else sha1(body))
                        url = h.get("warc-target-uri")
                        rows.append((path.as_py(), at, length, kind, None, type_, page(h.get("warc-record-id")), url, digest,
                                     None if body is None else len(body), page(h.get("warc-refers-to")), body if payloads else None))
                        size += len(block) if payloads else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content")
    out = files.mapInArrow(run, "archive string, offset long, length long, kind string, reason string, record_type string, page string, url string, "
                                "payload_digest string, payload_bytes long, refers string, payload binary")
    return out.select("archive", "offset", "length", "kind", "reason", "record_type", F.col("page").cast(id_type).alias("page_id"), "url",
                      "payload_digest", "payload_bytes", F.col("refers").cast(id_type).alias("refers_to"), "payload")


def resolve(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every page; a revisit's bytes are those of the
    response it names (null if that lies in a gap). Only responses that are named travel."""
    pages = found.filter(F.col("record_type").isin("response", "revisit"))
    own = pages.filter("record_type = 'response'")
    again = pages.filter("record_type = 'revisit'")
    named = (again.select("payload_digest", "refers_to").distinct()
             .join(own.select("payload_digest", F.col("page_id").alias("refers_to"), "payload_bytes").distinct(), ["payload_digest", "refers_to"]))
    again = again.drop("payload_bytes").join(named, ["payload_digest", "refers_to"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(cols).unionByName(again.select(cols))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder, reads them back and resolves the revisits."""
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    write(pages, folder, least)
    found = work_dir(spark, "warc_records")  # the archives are read once
    read(spark, folder, payloads=False, id_type=pages.schema["page_id"].dataType.simpleString()).drop("payload", "archive").write.parquet(found)
    return resolve(spark.read.parquet(found))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS largest FROM p
), b AS (
  SELECT *, '0x' || hex AS h FROM d
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM b
"""
