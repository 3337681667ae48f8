"""Legacy ARC archives: written, parsed by version and declared lengths, and converted to WARC.

Small pure functions work on one archive's bytes; Spark partitions the archives and moves the records.
Archives are written by Spark's text writer, whose row separator is the two line ends that close a
WARC record, so files appear only when a task commits and lost executors leave nothing behind.
"""

from __future__ import annotations

import base64
import hashlib
import ipaddress
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrail.llm.common import name
from echotrail.session import prepare, small_side, written
from echotrail.sources.files import scratch_path

# ---- fixed values of the formats ------------------------------------------------------------------
ARC1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
ARC2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
# ---------------------------------------------------------------------------------------------------

ARCHIVE_BYTES = 4 * 1024 * 1024
FILE_RECORDS = 8000
EPOCH = "20000101000000"
ROW_HEADER = "X-Row"

RECORD_SCHEMA = "archive string, version int, url string, ip string, date string, mime string, status int, row_key string, problem string, payload binary, digest string, head binary, kind string"
_RECORD_ARROW = pa.schema([
    ("archive", pa.string()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()),
    ("status", pa.int32()), ("row_key", pa.string()), ("problem", pa.string()), ("payload", pa.binary()), ("digest", pa.string()),
    ("head", pa.binary()), ("kind", pa.string())])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- ARC ------------------------------------------------------------------------------------------
def arc_head(archive: str, version: int) -> bytes:
    """The version block that opens an archive: a filedesc record whose body names the fields."""
    fields = ARC1_FIELDS if version == 1 else ARC2_FIELDS
    body = f"{version} 0 spark\n{fields}\n".encode()
    if version == 1:
        line = f"filedesc://{archive} 0.0.0.0 {EPOCH} text/plain {len(body)}\n"
    else:
        line = f"filedesc://{archive} 0.0.0.0 {EPOCH} text/plain 200 - - 0 {archive} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, archive: str, offset: int, url: str, row_key: str, payload: bytes) -> bytes:
    """One document: header line, the HTTP answer of the declared length, a line end.

    A header field cannot hold blanks or line ends, so those of a URL are escaped; the row key travels
    in a header of the HTTP answer, where ``~`` stands for null.
    """
    block = (f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ROW_HEADER}: {row_key}\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload
    place = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) for b in url.encode()).encode("latin-1") if url else b"-"
    if version == 1:
        line = place + f" 0.0.0.0 {EPOCH} text/html {len(block)}\n".encode()
    else:
        line = place + f" 0.0.0.0 {EPOCH} text/html 200 {payload_digest(payload)} - {offset} {archive} {len(block)}\n".encode()
    return line + block + b"\n"


def _http_parts(block: bytes) -> tuple[int | None, str | None, bytes, bytes | None]:
    """Status, row key, body and head of an HTTP answer; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return None, None, block, None
    # Old servers end lines without a carriage return.
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return None, None, block, None
    end, width = min(ends)
    head = [line.rstrip(b"\r") for line in block[:end].split(b"\n")]
    first = head[0].split(None, 2)
    status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
    key = None
    for line in head[1:]:
        field, _, value = line.partition(b":")
        if field.strip().lower() == ROW_HEADER.lower().encode():
            key = value.strip().decode("utf-8", "replace")
    return status, key, block[end + width:], block[:end + width]


def parse_arc(archive: str, content: bytes, versions: bool = False) -> Iterator[tuple]:
    """Records of one archive, plain or gzipped as a whole or by record; with ``versions`` also the
    version block, as a row of kind ``version``. Further on a filedesc URL is one like any other.

    The version block says how many fields a header line has; the last is always the declared length,
    and the URL is whatever stands before the others. A header line that cannot be read or a length
    beyond the end gives one row with ``problem`` and what bytes there are; reading then goes on at
    the next line that looks like a header, so nothing after a damaged record is lost.
    """
    if content[:2] == b"\x1f\x8b":
        content, broken = gunzip(content)
    else:
        broken = None
    version, fields, at, begun = 1, 5, 0, False
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        line_end = content.find(b"\n", at)
        line_end = len(content) if line_end < 0 else line_end
        parts = content[at:line_end].rstrip(b"\r").rsplit(b" ", fields - 1)
        is_head = not begun and content.startswith(b"filedesc://", at)
        begun = True
        if is_head:
            parts = content[at:line_end].rstrip(b"\r").split(b" ")
        if len(parts) < 5 or not parts[-1].isdigit() or not (is_head or len(parts) == fields):
            following = content.find(b"\n", at)
            following = len(content) if following < 0 else following + 1
            yield (archive, version, None, None, None, None, None, None, "header", content[at:following], None, "record")
            at = following
            continue
        start, size = line_end + 1, int(parts[-1])
        block = content[start:start + size]
        at = start + size
        if is_head:
            lead = block.split(b"\n", 1)[0].split()
            version = int(lead[0]) if lead and lead[0].isdigit() else 1
            fields = 5 if version == 1 else 10
            if versions:
                text = [p.decode("utf-8", "replace") for p in parts[:4]]
                yield (archive, version, *text, None, None, "short" if len(block) < size else None, block, None, "version")
            continue
        status, key, body, head = _http_parts(block)
        if fields == 10 and status is None and parts[4].isdigit():
            status = int(parts[4])
        text = [p.decode("utf-8", "replace") for p in parts[:4]]
        problem = "short" if len(block) < size else None
        yield (archive, version, text[0], text[1], text[2], text[3], status, key, problem, body, head, "record")
    if broken:
        yield (archive, version, None, None, None, None, None, None, broken, b"", None, "record")


def gunzip(content: bytes) -> tuple[bytes, str | None]:
    """All members of a gzip file; what follows a damaged member is reported, what came before kept."""
    out, rest = [], content
    while rest:
        unzip = zlib.decompressobj(31)
        try:
            out.append(unzip.decompress(rest))
        except zlib.error:
            return b"".join(out), "gzip"
        if not unzip.eof:
            return b"".join(out), "gzip"
        rest = unzip.unused_data.lstrip(b"\0")
    return b"".join(out), None


# ---- WARC -----------------------------------------------------------------------------------------
def warc_date(arc_date: str | None) -> str:
    """ISO time of a 14-digit ARC date; short dates are filled up, unreadable ones give the epoch of the archive."""
    digits = (arc_date or "")[:14]
    try:
        return datetime.strptime(digits + EPOCH[len(digits):], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return warc_date(EPOCH)


def record_id(*parts: str) -> str:
    """A name-based identifier, so that a repeated conversion gives the same one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(parts))}>"


def _shown(ip: str | None) -> bool:
    try:
        return not ipaddress.ip_address(ip or "").is_unspecified
    except ValueError:
        return False


def warc_record(row_key: str, url: str, date: str, mime: str, status: int | None, payload: bytes, digest: str, refers_to: str | None, refers_url: str | None = None,
                head: bytes | None = None, ip: str | None = None, archive: str | None = None, problem: str | None = None) -> bytes:
    """One record without its closing line ends: a response, or a revisit without payload.

    ``head`` is the HTTP head as it was received; without one there is only what is known of it.
    """
    http = head or (f"HTTP/1.0 {status or 200} OK\r\nContent-Type: {mime}\r\n{ROW_HEADER}: {row_key}\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    more = []
    if refers_to is not None:
        more = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_url or '', digest)}", f"WARC-Refers-To-Target-URI: {refers_url or ''}",
                f"WARC-Refers-To-Row: {refers_to}"]
    block = http if refers_to is not None else http + payload
    # Records without a row key are captures, told apart by their time.
    name_parts = (row_key, url, digest) if row_key != "~" else (row_key, url, digest, archive or "", date or "")
    return _warc("response" if refers_to is None else "revisit", record_id(*name_parts), date, "application/http; msgtype=response", block, url, digest, ip, archive, problem, more)


def _warc(kind: str, identifier: str, date: str | None, mime: str, block: bytes, url: str | None = None, digest: str | None = None, ip: str | None = None,
          archive: str | None = None, problem: str | None = None, more: list[str] = ()) -> bytes:
    head = [WARC_VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", f"WARC-Date: {warc_date(date)}"]
    head += [f"WARC-Target-URI: {url}"] * (url is not None) + [f"WARC-IP-Address: {ip}"] * _shown(ip)
    head += [f"WARC-Warcinfo-ID: {record_id('warcinfo', archive or '')}"] * (archive is not None and kind != "warcinfo")
    head += [f"WARC-Payload-Digest: sha1:{digest}"] * (digest is not None) + [f"WARC-Block-Digest: sha1:{payload_digest(block)}", f"Content-Type: {mime}", *more]
    head += ["WARC-Truncated: unspecified"] * (problem == "short") + [f"X-ARC-Problem: {problem}"] * (problem is not None)
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block


def warc_records(r: dict) -> list[bytes]:
    """The WARC records of one row of ``read_arc``, with what it revisits.

    HTTP answers keep their head; other blocks are resources of their own type. A version block gives a
    warcinfo record and is kept as metadata; so are bytes that belong to no record, with the problem.
    """
    archive, url, date, mime, payload, digest, problem = r["archive"], r["url"] or "", r["date"], r["mime"] or "application/octet-stream", r["payload"] or b"", r["digest"], r["problem"]
    if r["kind"] == "version":
        about = f"software: echotrail\r\nformat: WARC File Format 1.0\r\ndescription: converted from {archive}, ARC version {r['version']}\r\n".encode()
        return [_warc("warcinfo", record_id("warcinfo", archive), date, "application/warc-fields", about),
                _warc("metadata", record_id("version", archive, url), date, mime, payload, url, archive=archive, problem=problem)]
    if problem not in (None, "short"):
        return [_warc("metadata", record_id("problem", archive, problem, digest), date, "application/octet-stream", payload, archive=archive, problem=problem)]
    if r["head"] is None:
        return [_warc("resource", record_id("resource", archive, url, date or "", digest), date, mime, payload, url, digest, r["ip"], archive, problem)]
    return [warc_record(r["row_key"] or "~", url, date, mime, r["status"], payload, digest, r["refers_to"], r["refers_url"], r["head"], r["ip"], archive, problem)]


WARC_SCHEMA = "archive string, record_type string, record_id string, date string, url string, payload_digest string, refers_to string, row_key string, payload_bytes long, problem string, payload binary"
_WARC_ARROW = pa.schema([
    ("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
    ("refers_to", pa.string()), ("row_key", pa.string()), ("payload_bytes", pa.int64()), ("problem", pa.string()), ("payload", pa.binary())])


def parse_warc(archive: str, content: bytes, keep_payload: bool = True) -> Iterator[tuple]:
    """Records of one archive by their declared lengths; digests are checked against the bytes read.

    A revisit has no payload of its own; ``payload_bytes`` is what its HTTP headers declare. A record
    that cannot be read ends the archive with one row that has a ``problem``.
    """
    broken = None
    if content[:2] == b"\x1f\x8b":
        content, broken = gunzip(content)
    at = 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        lines = content[at:head_end].decode("utf-8", "replace").split("\r\n") if head_end >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            broken = broken or "header"
            break
        start, size = head_end + 4, int(fields["content-length"])
        block = content[start:start + size]
        at = start + size + len(RECORD_END)
        http = fields.get("content-type", "").startswith("application/http")
        _, key, payload, _ = _http_parts(block) if http else (None, None, block, None)
        revisit = fields.get("warc-type") == "revisit"
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        problem = "short" if len(block) < size else fields.get("x-arc-problem")
        declared = len(payload)
        if revisit:
            for line in block.split(b"\r\n"):
                if line.lower().startswith(b"content-length:"):
                    declared = int(line.split(b":")[1])
        elif digest is not None and payload_digest(payload) != digest:
            problem = problem or "digest"
        yield (archive, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), digest,
               fields.get("warc-refers-to-row"), key, declared, problem, payload if keep_payload else None)
    if broken:
        yield (archive, None, None, None, None, None, None, None, None, broken, None)


# ---- Spark ----------------------------------------------------------------------------------------
def _batches(rows: Iterator[tuple], schema: pa.Schema, bytes_at: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size; ``bytes_at`` is the column that holds the large values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[bytes_at] or b"")
        if size > ARCHIVE_BYTES or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _row_key(pages: DataFrame, id_col: str) -> Column:
    """The id as a header can carry it: text ids are URL-encoded, null is ``~``."""
    value = name(id_col).cast("string")
    return F.coalesce(F.url_encode(value) if isinstance(pages.select(name(id_col)).schema[0].dataType, T.StringType) else value, F.lit("~"))


def _row_id(column: str, id_type: T.DataType) -> Column:
    """The id behind a row key."""
    value = F.nullif(F.col(column), F.lit("~"))
    return F.url_decode(value) if isinstance(id_type, T.StringType) else value.cast(id_type)


def _page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        _row_key(pages, id_col).alias("k"), F.coalesce(name(url_col).cast("string"), F.lit("")).alias("u"),
        F.coalesce(name(html_col).cast("string"), F.lit("")).cast("binary").alias("b"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to archives of bounded size. Their names hold the task's partition, so no two are alike."""
    place = TaskContext.get().partitionId()

    def named(count: int) -> str:
        return f"part-{place:06d}-{count:06d}.arc"

    def archive_of(count: int, parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([named(count)]), pa.array([b"".join(parts)], pa.binary())], names=["path", "content"])

    count, parts, size = 0, [], 0
    for batch in batches:
        for row in zip(*batch.columns):
            key, url, body = (x.as_py() for x in row)
            version, archive = 1 + count % 2, named(count)
            if not parts:
                parts, size = [arc_head(archive, version)], 0
            parts.append(arc_record(version, archive, size, url, key, body))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive_of(count, parts)
                parts, count = [], count + 1
    if parts:
        yield archive_of(count, parts)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to records with their digests."""

    def rows():
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for record in parse_arc(path.as_py() or "", content.as_py() or b"", versions=True):
                    yield *record[:10], payload_digest(record[9]), *record[10:]

    yield from _batches(rows(), _RECORD_ARROW, 9)


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pack pages into ARC archives: ``path, content`` as Spark's binary file reader gives them.

    Archives alternate between versions 1 and 2 and end soon after ``ARCHIVE_BYTES``; a longer page is
    an archive alone.
    """
    return _page_rows(pages, id_col, url_col, html_col).mapInArrow(_pack, "path string, content binary")


def read_arc(files: DataFrame) -> DataFrame:
    """Records and version blocks of ARC archives given as ``path, content``; null content has none."""
    return files.select("path", "content").mapInArrow(_parse, RECORD_SCHEMA)


def records_through_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``read_arc(pages_to_arc(pages))`` in one step, so that a task hands each archive on within one worker."""
    return _page_rows(pages, id_col, url_col, html_col).mapInArrow(lambda batches: _parse(_pack(batches)), RECORD_SCHEMA)


def first_of_equal(records: DataFrame, key: Column, least_bytes: int = 0) -> DataFrame:
    """``row_key, digest, refers_to, refers_url`` of the records that revisit another: of equal payloads of at least
    ``least_bytes`` bytes the smallest ``key`` answers and the others refer to it.

    Only keys and digests are shuffled, with partial minima, so a payload that a third of all pages
    share is no hot group.
    """
    slim = written(records.filter(F.col("row_key").isNotNull() & F.col("problem").isNull() & (F.octet_length("payload") >= least_bytes)).select("row_key", "digest", "url", key.alias("_key")))
    first = slim.groupBy("digest").agg(F.min(F.struct(F.col("_key").isNull(), F.col("_key"), F.col("row_key"), F.col("url"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
    many = first.filter("_n > 1").select("digest", F.col("_first.row_key").alias("refers_to"), F.col("_first.url").alias("refers_url"))
    return slim.join(many, "digest").filter(F.col("row_key") != F.col("refers_to")).select("row_key", "digest", "refers_to", "refers_url").distinct()


def write_warc(records: DataFrame, revisits: DataFrame, path: str) -> None:
    """Write every ARC record into gzipped WARC archives under ``path``; see ``warc_records``."""
    if "refers_url" not in revisits.columns:
        revisits = revisits.withColumn("refers_url", F.lit(None).cast("string"))
    # A damaged record stays whole and revisits nothing.
    revisits = revisits.withColumn("problem", F.lit("none"))
    marked = records.withColumn("_problem", F.coalesce("problem", F.lit("none"))).join(
        small_side(revisits.withColumnRenamed("problem", "_problem"), 128), ["row_key", "digest", "_problem"], "left")
    inputs = ["archive", "version", "url", "ip", "date", "mime", "status", "row_key", "problem", "payload", "digest", "head", "kind", "refers_to", "refers_url"]

    def convert(batches):
        for batch in batches:
            out = [w for values in zip(*(batch.column(i).to_pylist() for i in range(len(inputs)))) for w in warc_records(dict(zip(inputs, values)))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    # The cast keeps the bytes as they are, and the separator is what closes each record.
    rows = marked.select(*inputs).mapInArrow(convert, "value binary").select(F.col("value").cast("string"))
    rows.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records of all WARC archives in a folder; null content has no records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def parse(batches):
        def rows():
            for batch in batches:
                for archive, content in zip(batch.column(0), batch.column(1)):
                    yield from parse_warc(archive.as_py() or "", content.as_py() or b"", keep_payload)

        yield from _batches(rows(), _WARC_ARROW, 10)

    return files.mapInArrow(parse, WARC_SCHEMA)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC archives read back: one row per page.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. Null html is an empty payload,
    and all empty payloads are equal, so the smallest page answers for them. Rows that repeat a page
    with the same payload are the same record and all carry its type; a null id comes last and stays
    null. An empty table gives an empty result.
    """
    spark = prepare(pages.sparkSession)
    id_type = pages.select(name(id_col)).schema[0].dataType
    records = records_through_arc(pages, id_col, url_col, html_col)
    revisits = first_of_equal(records, _row_id("row_key", id_type))
    path = scratch_path(spark, "warc")
    write_warc(records, revisits, path)
    back = read_warc(spark, path, keep_payload=False)
    return back.filter("record_type not in ('warcinfo', 'metadata') or record_type is null").select(
        _row_id("row_key", id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _row_id("refers_to", id_type).alias("refers_to"),
        "record_id", "date", "url", "problem")
