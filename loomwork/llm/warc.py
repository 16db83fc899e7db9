"""WARC from legacy ARC: parse, convert, write, read back.

ARC files start with a version block that names the fields of their header
lines (version 1: URL, IP, date, type, length; version 2 adds result code,
checksum, location, offset and file name). Records are cut by their declared
lengths alone. The converter synthesises what WARC asks for and ARC lacks:
identifiers (from page and digest, so the same on every run), ISO timestamps,
record types, block and payload digests.

Archives are gzip files with a member for each record. A task packs records until
a file's bytes are reached and Spark's text writer puts down each pack as a file;
it ends it with a zero byte, padding that gzip readers pass over. Files are read
back member by member, so no more than a file and one record are in memory.

Records with equal payloads of at least MIN_DUPLICATE bytes: the one with the
largest page_id is the response, the others are revisits without payload.

Defined results: null html is an empty payload; null url gets a urn; null
page_id counts as smaller than any; of rows with one page_id and one payload a
single one is the response; a payload that only rows without a page_id have has
no page to refer to, so each of them is a response; an empty table gives no
records; other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import scratch, settle, text_of

MIN_DUPLICATE = 1000
#: Compressed bytes of an archive file, but for the record that passes them.
FILE_BYTES = 16_000_000
#: Compressed bytes read at a time.
READ_BYTES = 1 << 14
#: Bytes of pages converted at a time.
ARC_BYTES = 4_000_000
ARC_DATE = "19991231235959"
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}


@dataclass(frozen=True)
class ArcRecord:
    version: int
    fields: dict[str, str]
    body: bytes


# --- ARC ------------------------------------------------------------------------


def arc_file(name: str, version: int, rows: list[tuple[str, str, bytes]], date: str = ARC_DATE) -> bytes:
    """An ARC file of (url, content type, network document)."""
    fields = ARC_FIELDS[version]
    spec = f"{version} 0 loomwork\n{' '.join(fields)}\n".encode()
    out = io.BytesIO()

    def put(url: str, ip: str, kind: str, body: bytes) -> None:
        known = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(out.tell()), "Filename": name, "Archive-length": str(len(body))}
        out.write(" ".join(known[f] for f in fields).encode() + b"\n" + body + b"\n")

    put(f"filedesc://{name}", "0.0.0.0", "text/plain", spec)
    for url, kind, body in rows:
        put(quote(url, safe="%:/?#[]@!$&'()*+,;=~"), "0.0.0.0", kind, body)
    return out.getvalue()


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first.

    A line has as many fields as its version says; the length is the last of
    them and rules where the record ends.
    """
    at, version, fields = 0, 0, []
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = content.index(b"\n", at)
        words = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(words[-1])
        body = content[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"record at {at} is shorter than its declared {length} bytes")
        if not version:
            if not words[0].startswith("filedesc:"):
                raise ValueError("no version block")
            first, _, rest = body.partition(b"\n")
            version = int(first.split()[0])
            fields = rest.partition(b"\n")[0].decode().split()
            if version not in ARC_FIELDS or len(fields) != len(ARC_FIELDS[version]):
                raise ValueError(f"unknown ARC version {version}")
        if len(words) > len(fields):  # a content type with blanks in it
            extra = len(words) - len(fields)
            words[3 : 4 + extra] = [" ".join(words[3 : 4 + extra])]
        yield ArcRecord(version, dict(zip(fields, words)), body)
        at = end + 1 + length


# --- WARC -----------------------------------------------------------------------


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, payload_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{payload_hex}')}>"


def iso_date(arc_date: str) -> str:
    """ARC dates have 8 to 14 digits; what is missing is midnight."""
    d = (arc_date + "000000")[:14] if len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header block with its blank line, headers, payload) of a network document."""
    head, sep, payload = body.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        headers[k.strip().lower()] = v.strip()
    return head + sep, headers, payload


def warc_record(rec: ArcRecord, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends after it."""
    lines = ["WARC/1.1"]
    if rec.fields["URL"].startswith("filedesc:"):
        kind, block, mime = "warcinfo", f"software: loomwork\r\nformat: WARC File Format 1.1\r\ndescription: from ARC version {rec.version}\r\n".encode(), "application/warc-fields"
        extra = [f"WARC-Record-ID: {record_id(rec.fields['URL'], hashlib.sha1(rec.body).hexdigest())}", f"WARC-Filename: {rec.fields['URL'][11:]}"]
    else:
        head, headers, payload = http_parts(rec.body)
        page, hexed = headers.get("x-page-id", ""), hashlib.sha1(payload).hexdigest()
        kind, block, mime = ("response", rec.body, "application/http;msgtype=response") if refers_to is None else ("revisit", head, "application/http;msgtype=response")
        extra = [f"WARC-Record-ID: {record_id(page, hexed)}", f"WARC-Target-URI: {rec.fields['URL']}", f"WARC-IP-Address: {rec.fields['IP-address']}", f"WARC-Payload-Digest: {digest32(payload)}"]
        if refers_to is not None:
            extra += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(str(refers_to), hexed)}", f"WARC-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Type: {kind}", *extra, f"WARC-Date: {iso_date(rec.fields['Archive-date'])}", f"WARC-Block-Digest: {digest32(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _record_at(content: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place; it is cut by Content-Length and must end in CRLF CRLF."""
    end = content.index(b"\r\n\r\n", at)
    first, *rest = content[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in rest)
    n = int(headers["Content-Length"])
    block = content[end + 4 : end + 4 + n]
    if len(block) != n or content[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise ValueError(f"record at {at} does not end where its length says")
    return headers, block, end + 8 + n


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive without compression."""
    at = 0
    while at < len(content):
        headers, block, at = _record_at(content, at)
        yield headers, block


def read_members(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip archive, member by member; zero bytes between and after members are padding."""
    at, view = 0, memoryview(content)
    while at < len(content):
        if not content[at]:
            at += 1
            continue
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(content):
                raise ValueError("the last member of an archive is cut short")
            parts.append(member.decompress(view[at : at + READ_BYTES]))
            at += READ_BYTES
        at = min(at, len(content)) - len(member.unused_data)
        yield from read_warc(b"".join(parts))


# --- over tables ------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """page_id, url, html, refers_to: the page whose payload a row repeats, or null."""
    payload = text_of("html")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("_d"))
    sums = settle(pages.select("page_id", "_d", F.octet_length("html").alias("_n")).filter(F.col("_n") >= min_duplicate))
    groups = sums.groupBy("_d").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_c")).filter("_c > 1")
    repeats = sums.join(groups, "_d").select(F.col("_d").alias("_rd"), F.col("page_id").alias("_rp"), "_keep")
    twice = repeats.groupBy("_rd", "_rp", "_keep").agg(F.count("*").alias("_same"))
    same_row = settle(twice.filter("_same > 1 or not _rp <=> _keep"))
    out = pages.join(same_row, F.col("page_id").eqNullSafe(F.col("_rp")) & (F.col("_d") == F.col("_rd")), "left")
    if same_row.filter("_same > 1 and _rp <=> _keep").limit(1).count():
        # rows that are wholly alike: the first of them is the response
        first = F.row_number().over(Window.partitionBy("page_id", "_d").orderBy("url")) == 1
        out = out.withColumn("_keep", F.when(F.col("page_id").eqNullSafe(F.col("_keep")) & first, F.lit(None)).otherwise(F.col("_keep")))
    return out.select("page_id", "url", "html", F.col("_keep").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, arc_version: int = 2, min_duplicate: int = MIN_DUPLICATE) -> None:
    """Each page as an ARC record, converted, in WARC files under ``path``."""

    def slices(batches):
        """Rows of about ARC_BYTES together."""
        for batch in batches:
            rows, n = [], 0
            for row in zip(*[batch.column(k) for k in range(4)]):
                i, url, html, ref = (v.as_py() for v in row)
                payload = html.encode("utf-8", "replace")
                rows.append((i, url, payload, ref))
                n += len(payload)
                if n >= ARC_BYTES:
                    yield rows
                    rows, n = [], 0
            if rows:
                yield rows

    def run(batches):
        pack, size = [], 0
        for part in slices(batches):
            rows = []
            for i, url, payload, _ in part:
                mark = "" if i is None else f"X-Page-Id: {i}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{mark}\r\n"
                rows.append((url or f"urn:page:{i}", "text/html", head.encode() + payload))
            legacy = read_arc(arc_file(f"pages-{part[0][0]}.arc", arc_version, rows))
            for k, r in enumerate(legacy):
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = press.compress(warc_record(r, None if k == 0 else part[k - 1][3]) + b"\r\n\r\n") + press.flush()
                pack.append(member)
                size += len(member)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(pack)], pa.binary())], names=["r"])
                    pack, size = [], 0
        if pack:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(pack)], pa.binary())], names=["r"])

    rows = with_revisits(pages, min_duplicate).mapInArrow(run, "r binary")
    rows.select(F.col("r").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile=1).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, date (and payload) of every page record."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string" + (", payload binary" if with_payload else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in read_members(content.as_py()):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    if digest32(block) != headers["WARC-Block-Digest"]:
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    _, http, payload = http_parts(block)
                    hexed = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    page, ref = http.get("x-page-id"), headers.get("WARC-Refers-To-Page")
                    row = [int(page) if page else None, int(http["content-length"]), hexed, headers["WARC-Type"], int(ref) if ref else None, headers["WARC-Target-URI"], headers["WARC-Date"]]
                    rows.append(row + [payload] * with_payload)
                    if len(rows) >= (256 if with_payload else 8192):
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
