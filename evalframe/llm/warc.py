"""Legacy archive converter: ARC files of version 1 and 2 become WARC records.

An ARC file starts with a version block that names the fields of its header
lines; each record is a header line, then as many bytes as it declares. The
converter parses both and synthesises what WARC wants and ARC lacks: record
identifiers, W3C timestamps, record types and digests. Files may be plain or
gzipped; a record that does not parse is reported and the next one is looked for.

Archives are written by Spark's text writer, which puts the bytes of a string
down as they are (Spark does not validate the UTF-8 of a cast binary; a test
holds it to that). A row is a chunk of whole gzip members of about CHUNK bytes,
and a file has at most FILE_CHUNKS of them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_folder, utf8

FETCHED = "20000101000000"
LEAST_PAYLOAD = 100
#: Bytes of a chunk that is written as one row (more only for a single longer record), and chunks of a file at most.
CHUNK, FILE_CHUNKS = 4_000_000, 16
#: Up to so many repeated payloads are broadcast (about 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 50_000
#: Header fields of the two versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs in RFC 4122


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def arc_parts(records: Iterable[ArcRecord], version: int) -> Iterator[bytes]:
    """The version block and the records of one ARC file, one by one."""
    about = f"{version} 0 evalframe\n{FIELDS[version]}\n".encode()
    middle = "200 - - 0 pages.arc " if version == 2 else ""
    yield f"filedesc://pages.arc 0.0.0.0 {FETCHED} text/plain {middle}{len(about)}\n".encode() + about + b"\n"
    for r in records:
        yield f"{r.url} {r.ip} {r.date} {r.content_type} {middle}{len(r.block)}\n".encode() + r.block + b"\n"


def write_arc(records: Iterable[ArcRecord], version: int) -> bytes:
    """One plain ARC file."""
    return b"".join(arc_parts(records, version))


#: What the header line of a record looks like, to find the next one after a record that does not parse.
HEADER_LINE = re.compile(rb"(?m)^[a-z][a-z0-9+.-]*://[^\n]* [^ \n]+ \d{8,14} [^ \n]+ (?:[^\n]* )?\d+\r?$")


def _record(data: bytes, at: int, names: list[str] | None) -> tuple[ArcRecord | None, int, list[str]]:
    """The record that begins at a place, where it ends, and the fields from there on; no record for a version block."""
    end = data.find(b"\n", at)
    if end < 0:
        raise ValueError("an ARC header line does not end")
    line = data[at:end].decode("utf-8").rstrip("\r")
    length = int(line.rpartition(" ")[2])
    block = data[end + 1 : end + 1 + length] if length >= 0 else b""
    if len(block) != length:
        raise ValueError("an ARC record is shorter than it declares")
    after = end + 1 + length
    if line.startswith("filedesc://"):
        version, _, rest = block.decode("utf-8").partition("\n")
        names = rest.split("\n")[0].rstrip("\r").split(" ")
        if int(version.split(" ")[0]) not in FIELDS or names[-1] != "Archive-length":
            raise ValueError(f"unknown ARC version: {version!r}")
        return None, after, names
    if names is None:
        raise ValueError("an ARC file starts with its version block")
    values = line.rsplit(" ", len(names) - 1)  # a url may hold blanks
    if len(values) != len(names):
        raise ValueError("an ARC header line does not have the declared fields")
    value = dict(zip(names, values, strict=True))
    return ArcRecord(value["URL"], value["IP-address"], value["Archive-date"], value["Content-type"], block), after, names


def scan_arc(data: bytes) -> Iterator[tuple[int, ArcRecord | None, str | None]]:
    """Place and record of each record of an ARC file, by the fields that its version block names and the declared lengths.

    What does not parse comes out as a place and what is wrong there; the scan
    goes on at the next line that looks like a record's header. A further version
    block, as in files put one after another, counts from there on.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        start = at
        try:
            record, at, names = _record(data, at, names)
        except (ValueError, KeyError) as e:
            later = HEADER_LINE.search(data, start + 1)
            at = later.start() if later else len(data)
            yield start, None, str(e)
        else:
            if record:
                yield start, record, None


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one plain ARC file; the first that does not parse is an error."""
    for _, record, error in scan_arc(data):
        if error:
            raise ValueError(error)
        yield record


def unpacked(data: bytes) -> tuple[bytes, list[tuple[int, str]]]:
    """The bytes of a plain or gzipped file, and places of members that are broken (they are left out)."""
    if not data.startswith(b"\x1f\x8b"):
        return data, []
    out: list[bytes] = []
    broken: list[tuple[int, str]] = []
    view, at = memoryview(data), 0
    while at < len(data):
        member, parts, read = zlib.decompressobj(31), [], at
        try:
            while not member.eof:
                if read == len(data):
                    raise ValueError("a gzip member is cut short")
                parts.append(member.decompress(view[read : read + 16_384]))
                read = min(len(data), read + 16_384)
            out += parts
            at = read - len(member.unused_data)
        except (zlib.error, ValueError) as e:
            broken.append((at, str(e)))
            later = data.find(b"\x1f\x8b\x08", at + 1)
            at = later if later >= 0 else len(data)
        while data[at : at + 1] == b"\0":  # padding between members
            at += 1
    return b"".join(out), broken


def warc_date(date: str) -> str:
    """An ARC date (8 to 14 digits) as a WARC timestamp."""
    d = date.ljust(14, "0") if len(date) >= 8 else FETCHED
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page: str) -> str:
    """The identifier of a page's record; the same whenever it is made again."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}')}>"


def clean_url(url: str) -> str:
    """A url fit for a header line: white space, controls and non-ASCII percent-encoded."""
    if url.isascii() and url.isprintable() and " " not in url and url:
        return url
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url) or "about:blank"


def http_header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode() if found else None


def chunks(members: Iterable[bytes], limit: int) -> Iterator[bytes]:
    """Members put together to chunks of about ``limit`` bytes."""
    held: list[bytes] = []
    size = 0
    for member in members:
        held.append(member)
        size += len(member)
        if size >= limit:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _write_chunks(rows: DataFrame, folder: str) -> None:
    """Write rows of one binary column ``value``, each a sequence of gzip members, below ``folder``.

    An empty member is the separator that Spark puts after each row, so every
    file is a valid sequence of members, and Spark's own commit protocol holds
    when tasks are repeated.
    """
    separator = EMPTY_MEMBER.decode("latin-1")
    text = rows.select(F.col("value").cast("string"))
    text.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_CHUNKS).text(folder)


def write_arcs(pages: DataFrame, folder: str) -> None:
    """Write pages (page_id, url, html) as gzipped ARC files below ``folder``, of version 1 and 2 in turn: the legacy archives that ``archive`` starts from."""
    limit = CHUNK

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[ArcRecord]:
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(html)}\r\n\r\n"
                yield ArcRecord(clean_url(url or ""), "0.0.0.0", FETCHED, "text/html", head.encode() + html)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        """Each as long as a chunk, so that every row begins with a version block."""
        coming, version = records(batches), 1
        for first in coming:
            size = 0

            def some(first: ArcRecord) -> Iterator[ArcRecord]:
                nonlocal size
                record: ArcRecord | None = first
                while record:
                    yield record
                    size += len(record.block)
                    record = next(coming, None) if size < limit else None

            yield b"".join(gzip.compress(part, 1, mtime=0) for part in arc_parts(some(first), version))
            version = 3 - version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in files(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], ["value"])

    _write_chunks(pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "value binary"), folder)


RECORD = "path string, at long, error string, page_id string, url string, date string, head binary, payload_bytes long, payload_digest string, member binary"


def read_arcs(files: DataFrame) -> DataFrame:
    """Records of ARC files (``path, content``), plain or gzipped, ready for ``write_warcs``.

    ``page_id`` is what the HTTP header X-Page-Id says, else date, url and place;
    ``head`` is the HTTP header, ``payload_bytes`` and ``payload_digest`` are of
    what follows it, and ``member`` is the gzipped WARC response record. Where a
    record does not parse, ``error`` says why, ``at`` is its place (in the
    unpacked file; of a broken gzip member, in the file itself), and the other
    columns are null. A task holds one file.
    """
    limit = CHUNK

    def found(path: str, data: bytes) -> Iterator[tuple]:
        plain, broken = unpacked(data)
        for at, error in broken:
            yield (path, at, error, *[None] * 7)
        for at, r, error in scan_arc(plain):
            if error:
                yield (path, at, error, *[None] * 7)
                continue
            head, _, payload = r.block.partition(b"\r\n\r\n")
            digest = hashlib.sha256(payload).hexdigest()
            page = http_header(head, "X-Page-Id")
            page = f"{r.date} {r.url} {path.rpartition('/')[2]}:{at}" if page is None else page or None
            url = clean_url(r.url)
            yield path, at, None, page, url, r.date, head, len(payload), digest, gzip.compress(warc_record(page or "", url, r.date, head, payload, digest), 3, mtime=0)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                held: list[tuple] = []
                size = 0
                for row in found(path.as_py(), data.as_py()):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= limit:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, RECORD)


def warc_record(page: str, url: str, date: str, head: bytes, payload: bytes, digest: str, first: str | None = None) -> bytes:
    """A WARC record: a response, or a revisit of page ``first`` if that is given (without the payload)."""
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {warc_date(date)}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
        payload = b""
    block = head + b"\r\n\r\n" + payload
    lines += [f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def first_pages(slim: DataFrame) -> DataFrame:
    """``(payload_digest, first)`` of payloads of LEAST_PAYLOAD bytes and more that several rows have, from ``page_id, payload_digest, payload_bytes``."""
    long = slim.where(F.col("payload_bytes") >= LEAST_PAYLOAD)
    return long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")


def write_warcs(records: DataFrame, firsts: DataFrame, folder: str) -> None:
    """Write parsed records as WARC files below ``folder``; ``firsts`` says of which payloads one record is the response and others revisit it.

    Up to MOST_BROADCAST repeated payloads are broadcast. More are joined by
    digest, where what is shuffled of a record is its gzipped member.
    """
    limit = CHUNK
    firsts = cut(firsts.select("payload_digest", F.col("first").cast("string").alias("first")))
    held = F.broadcast(firsts) if firsts.count() <= MOST_BROADCAST else firsts
    good = records.where("error is null").select("page_id", "url", "date", "head", "payload_digest", "member")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for i, (page, first) in enumerate(zip(column["page_id"].to_pylist(), column["first"].to_pylist(), strict=True)):
                if first is None or first == page:
                    yield column["member"][i].as_py()
                else:
                    url, date, head, digest = (column[c][i].as_py() for c in ("url", "date", "head", "payload_digest"))
                    yield gzip.compress(warc_record(page or "", url, date, head, b"", digest, first), 3, mtime=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(members(batches), limit):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.binary())], ["value"])

    _write_chunks(good.join(held, "payload_digest", "left").mapInArrow(run, "value binary"), folder)


def read_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record of a WARC file of gzip members, read as one stream."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as members, io.BufferedReader(members, 1 << 20) as stream:
        while line := stream.readline():
            head = [line]
            while (line := stream.readline()).strip():
                head.append(line)
            if head == [b"\r\n"]:
                continue
            header = b"".join(head)
            block = stream.read(int(http_header(header, "Content-Length") or 0))
            stream.read(4)  # the two line ends after a record
            yield header, block


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that Spark wrote below ``folder``, as ``path, content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)


def convert_files(files: DataFrame, folder: str) -> DataFrame:
    """Convert real ARC files (``path, content``, as ``spark.read.format("binaryFile")`` gives them) to WARC files below ``folder``.

    Returns the records that did not parse: ``path, at, error``. Of records with
    equal payloads, that with the smallest page id (without such a header: the
    oldest) is the response. No files give no records.
    """
    records = read_arcs(files)
    write_warcs(records, first_pages(records.where("error is null").select("page_id", "payload_digest", "payload_bytes")), folder)
    return records.where("error is not null").select("path", "at", "error")


def read_archives(files: DataFrame, page_kind: str = "long") -> DataFrame:
    """Read WARC files (``content``): a row per record with what its header and payload say."""
    page_type = pa.int64() if page_kind == "long" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                out: list[tuple] = []
                for head, block in read_warc(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = http_header(head, "WARC-Type")
                    whole = kind == "response"
                    digest = hashlib.sha256(payload).hexdigest() if whole else (http_header(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
                    n = len(payload) if whole else int(http_header(http, "Content-Length") or 0)
                    out.append((http_header(http, "X-Page-Id") or None, n, digest, kind, http_header(head, "X-Refers-To-Page-Id"), http_header(head, "WARC-Record-ID"), http_header(head, "WARC-Date"), http_header(head, "WARC-Target-URI")))
                columns = list(zip(*out, strict=True)) or [()] * 8
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 6]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                arrays[0], arrays[4] = arrays[0].cast(page_type), arrays[4].cast(page_type)
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "target_uri"])

    schema = f"page_id {page_kind}, payload_bytes long, payload_digest string, record_type string, refers_to {page_kind}, record_id string, date string, target_uri string"
    return files.select("content").mapInArrow(run, schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages as ARC, convert those files to WARC, read the archives back, and describe each record.

    All files are below the shared checkpoint folder. Returns ``page_id,
    payload_bytes, payload_digest, record_type, refers_to`` and ``record_id,
    date, target_uri``. Of records with equal payloads of at least LEAST_PAYLOAD
    bytes, that with the smallest page id is the response and the others revisit
    it; smaller payloads are all responses. Null html is an empty payload; a null
    url becomes ``about:blank``; a null page id counts as the largest and is kept
    (rows whose ids are all null have only responses); repeated rows of the
    smallest id are all responses; long html is written whole, as a chunk of its
    own. An empty table gives no rows. Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_arcs(pages, f"{folder}/arc")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    firsts = first_pages(pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("payload_bytes")))
    write_warcs(read_arcs(binary_files(spark, f"{folder}/arc")), firsts, f"{folder}/warc")
    page_kind = "long" if pages.schema["page_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    return read_archives(binary_files(spark, f"{folder}/warc"), page_kind)
