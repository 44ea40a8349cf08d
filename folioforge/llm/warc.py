"""WARC archives: writing with revisit records, and a salvage reader.

Writing.  Spark's text writer stores every row followed by a line separator.
A gzip member of less than 2**24 bytes ends with a zero byte (the top of its
length field); so a row holds the record's members without the last byte and
NUL is the separator.  That gives ordinary ``.warc.gz`` files with one gzip
member per record (a longer record is followed by an empty member), through
whatever file system Spark writes to.

Reading.  Each archive is walked member by member.  A record is accepted if its
member inflates with the right checksum, the version line and headers parse, the
block has the stated length, and the stated block digest is the block's.  After a
failed check the reader searches for the next place where a member (or, in a
plain archive, a version line) begins a record, goes on from there, and logs the
bytes in between as a quarantined gap.  A place counts as a member only if its
first bytes inflate to a version line, so bytes that look like one cost little.

An archive is read whole by one task, so it must be smaller than the two gigabytes
that Spark's reader of binary files takes; the writer keeps its own far below.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, join_hot, materialize, scratch, text_slices

LEAST_REVISIT = 1000
#: Bytes that an archive may have, that members are written together in, and that a member may inflate to.
ARCHIVE_BYTES, BUNDLE, MEMBER_BYTES = 512 << 20, 8 << 20, 1 << 30
MEMBER = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
ID = re.compile(r"<urn:page:(-?\d*)>")

RECORDS = "file string, offset long, length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
GAPS = "file string, start long, stop long, reason string"
READ = f"gap boolean, {RECORDS}, stop long, reason string"


def _clean(value: str) -> str:
    """A header value: line ends would break the header block."""
    return re.sub(r"[\r\n]+", " ", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, record_type: str) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {STAMP}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """``record`` as gzip; the last byte is always zero."""
    out = _gzip(record, level)
    return out if out[-1] == 0 else out + _gzip(b"", level)


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# writing --------------------------------------------------------------------


def _payloads(pages: DataFrame) -> DataFrame:
    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return picked.withColumn("sha1", F.sha1(F.encode("html", "utf-8"))).withColumn("n_bytes", F.octet_length("html").cast("long"))


def plan_records(pages: DataFrame, keys: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, sha1, n_bytes, refers_to: what each record will be.

    ``keys``: page_id, sha1, n_bytes of all pages.  ``refers_to`` is set on rows
    whose payload of at least ``least`` bytes also belongs to a row with a larger
    page_id; it is the largest such page_id.  Only pages whose payload occurs
    more than once (by a bitmap) are shuffled, and those by page, not by payload:
    a payload that a third of all pages share is dealt out evenly.
    """
    keys = keys.where(F.col("n_bytes") >= least)
    # groups of copies are aggregated before the shuffle; what remains is one
    # row for each payload that occurs more than once
    first = keys.groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("n_rows")).where("n_rows > 1")
    again = join_hot(keys, materialize(first, "warc-copies"), ["sha1", "n_bytes"], keys.count()).where("page_id is not null and page_id < response")
    again = materialize(again.select("page_id", "sha1", F.col("response").alias("refers_to")).distinct(), "warc-revisits")
    bits = F.broadcast(bitmap(again.select(F.xxhash64("sha1").alias("key")), again.count(), "warc-bitmap"))
    payload, may = _payloads(pages), in_bitmap(F.xxhash64("sha1"))
    out = ["page_id", "url", "html", "sha1", "n_bytes", "refers_to"]
    copied = payload.join(bits, may, "left_semi").join(again, ["page_id", "sha1"], "left")
    return copied.select(*out).union(payload.join(bits, may, "left_anti").withColumn("refers_to", F.lit(None).cast("long")).select(*out))


def write_warc(pages: DataFrame, path: str, least: int = LEAST_REVISIT, level: int = 6, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row below ``path``.  Null html = empty payload; a
    null page_id gives an identifier without a number.

    Archives are bounded in bytes.  Members go to the writer in bundles of at most
    BUNDLE bytes or one member, and a file has so many bundles that even the
    largest record in each would make no more than ``archive_bytes`` (or a
    single record that is larger).
    """
    largest = 1 << 10  # of headers, a member's framing and what does not compress
    keys = materialize(_payloads(pages).select("page_id", "sha1", "n_bytes", (F.col("n_bytes") + F.coalesce(F.octet_length(F.col("url")), F.lit(0))).alias("size")), "warc-keys")
    largest += (keys.agg(F.max("size")).first()[0] or 0) * 1001 // 1000
    bundle = max(min(BUNDLE, archive_bytes), largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def bundled() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
            held.clear()
            return out

        for b in text_slices(batches, 2):
            for page_id, url, html, sha1, _, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                kind = "response" if refers_to is None else "revisit"
                one = member(record_bytes(page_id, url, html.encode("utf-8"), sha1, refers_to, kind), level)
                if held and size + len(one) > bundle:
                    yield bundled()
                    size = 0
                held.append(one)
                size += len(one)
        if held:
            yield bundled()

    packed = plan_records(pages, keys.drop("size"), least).mapInArrow(run, "value binary")
    # the cast keeps the bytes as they are
    rows = packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none")
    rows.option("maxRecordsPerFile", max(1, archive_bytes // bundle)).text(path)


# reading --------------------------------------------------------------------


class Broken(ValueError):
    """A record that fails a check; none begins in what its headers cover, up to ``upto``."""

    def __init__(self, reason: str, upto: int):
        super().__init__(reason)
        self.upto = upto


class _LineEnds:
    """Where the next line end stands; as it is asked in ascending order, every
    byte is searched once."""

    def __init__(self, data: bytes):
        self.data, self.at = data, -1

    def after(self, at: int) -> int:
        if self.at < at:
            found = self.data.find(b"\r\n", at)
            self.at = found if found >= 0 else len(self.data)
        return self.at


def parse_record(data: bytes, proof: bool = False, at: int = 0, ends: _LineEnds | None = None) -> tuple[dict, int]:
    """Fields and end of the record at ``at``; Broken if a check fails, and with
    ``proof`` also if the record states no digest of its own.

    Headers are read line by line up to the first that is none.  A block is not
    looked at unless it ends where its header says, and not copied unless all
    checks hold.
    """
    v = VERSION.match(data, at)
    if not v:
        raise Broken("no version line", at)
    head, line, ends = {}, v.end(), ends or _LineEnds(data)
    while (end := ends.after(line)) != line:
        name, colon, value = data[line:end].partition(b":")
        # no valid text holds the first bytes of a member
        if not colon or end >= len(data) or MEMBER in name or MEMBER in value:
            raise Broken("headers without end" if end >= len(data) else "malformed header", line)
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        line = end + 2
    stated_length = head.get("content-length", "")
    if end >= len(data):
        raise Broken("headers without end", line)
    if not (stated_length.isascii() and stated_length.isdigit() and len(stated_length) < 19):
        raise Broken("no content length", line)
    start = end + 2
    stop = start + int(stated_length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("block of another length", line)
    stated = head.get("warc-block-digest", "").removeprefix("sha1:")
    if stated and stated != hashlib.sha1(memoryview(data)[start:stop]).hexdigest():
        raise Broken("block digest differs", line)
    if proof and not stated and (head.get("warc-type") == "revisit" or not head.get("warc-payload-digest")):
        raise Broken("no digest in a broken member", line)
    return _fields(head, data, start, stop), stop + 4


def _fields(head: dict, data: bytes, start: int, stop: int) -> dict:
    http = data.find(b"\r\n\r\n", start, stop)
    http, body = (http, http + 4) if http >= 0 else (stop, stop)
    revisit = head.get("warc-type") == "revisit"
    length = re.compile(rb"(?im)^content-length:[ \t]*(\d+)").search(data, start, http) if revisit else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit:
        own = hashlib.sha1(memoryview(data)[body:stop]).hexdigest()
        if digest and digest != own:
            raise Broken("payload digest differs", start)
        digest = own
    number = lambda x: int(m[1]) if (m := ID.fullmatch(x or "")) and m[1] else None
    return {
        "page_id": number(head.get("warc-record-id")),
        "url": head.get("warc-target-uri"),
        "record_type": head.get("warc-type"),
        "refers_to": number(head.get("warc-refers-to")) if revisit else None,
        "payload_bytes": int(length[1]) if length else stop - body,
        "payload_digest": digest,
        "payload": None if revisit else data[body:stop],
    }


def _inflate(data: memoryview, at: int, most: int = MEMBER_BYTES) -> tuple[bytes, int, str | None]:
    """The member at ``at``, where it ends, and what is wrong with it; of a broken
    one what comes before its error, of one that inflates to more than ``most``
    bytes that many."""
    z = zlib.decompressobj(31)
    out, pos, size = [], at, 0
    while not z.eof and pos < len(data):
        chunk, before = data[pos : pos + (1 << 16)], z.copy()
        try:
            out.append(z.decompress(chunk, most - size + 1))
        except zlib.error as e:
            for i in range(len(chunk)):
                try:
                    out.append(before.decompress(chunk[i : i + 1], most))
                except zlib.error:
                    break
            return b"".join(out), pos + i, f"member: {e}"
        size += len(out[-1])
        if size > most:
            return b"".join(out)[:most], pos + len(chunk) - len(z.unconsumed_tail), "member inflates to too much"
        pos += len(chunk)
    return b"".join(out), pos - len(z.unused_data), None if z.eof else "member without end"


def _begins(data: bytes, at: int) -> bool:
    """Whether a gzip member at ``at`` starts with a version line, within 2048 bytes."""
    if at + 4 > len(data) or data[at + 3] & 0xE0:
        return False
    z, got = zlib.decompressobj(31), b""
    try:
        for i in range(at, min(at + 2048, len(data)), 512):
            got += z.decompress(data[i : i + 512], 12 - len(got))
            if len(got) >= 12 or z.eof:
                break
    except zlib.error:
        return False
    return VERSION.match(got) is not None


class _Starts:
    """The places at which a record may begin, in ascending order of asking;
    every byte is searched once."""

    def __init__(self, data: bytes):
        self.data, self.member, self.line = data, -1, -1

    def after(self, at: int) -> int:
        data, n = self.data, len(self.data)
        if self.line < at:
            m = VERSION.search(data, at)
            self.line = m.start() if m else n
        while self.member < min(at, n) or self.member < self.line and not _begins(data, self.member):
            found = data.find(MEMBER, max(at, self.member + 1))
            self.member = found if found >= 0 else n
        return min(self.member, self.line)


def _records_of(text: bytes, proof: bool) -> tuple[list[dict], str | None]:
    """The records of an inflated member and the first thing wrong with it; after
    a record that fails, the next version line is looked for."""
    found, used, wrong, ends = [], 0, None, _LineEnds(text)
    while used < len(text):
        try:
            fields, used = parse_record(text, proof, used, ends)
        except Broken as e:
            wrong = wrong or str(e)
            m = VERSION.search(text, max(used + 1, e.upto))
            used = m.start() if m else len(text)
            continue
        found.append(fields)
    return found, wrong


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, stop, fields) and ("gap", start, stop, reason), in order.

    Records of one member have its place; where some of them fail, a gap at the
    member follows those that don't.  In a member that is itself broken, only
    records with a digest of their own are kept.
    """
    view, at, n = memoryview(data), 0, len(data)
    starts, ends = _Starts(data), _LineEnds(data)
    gap = reason = None
    while at < n:
        try:
            found = []
            if data[at : at + 3] == MEMBER:
                text, stop, broken = _inflate(view, at)
                found, wrong = _records_of(text, broken is not None)
                if broken and not found:
                    raise Broken(broken, at)
                if broken or wrong:
                    if gap is not None:
                        yield "gap", gap, at, reason
                    for fields in found:
                        yield "record", at, stop, fields
                    gap, reason = at, broken or wrong
                    at = starts.after(at + 1) if broken else stop
                    continue
            elif VERSION.match(data, at):
                fields, stop = parse_record(data, False, at, ends)
                found = [fields]
            else:
                raise Broken("neither member nor version line", at)
        except Broken as e:
            if gap is None:
                gap, reason = at, str(e)
            at = starts.after(max(at + 1, e.upto))
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        for fields in found:
            yield "record", at, stop, fields
        at = stop
    if gap is not None:
        yield "gap", gap, n, reason


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Everything found below ``path``: one row per record or gap (``gap``).

    Records: file, offset, length, page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (both of the full payload, also for revisits),
    payload (null for revisits).  Gaps: file, offset, stop, reason.
    """
    names = [f.strip().split()[0] for f in READ.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.strip().split()[1]]) for n, f in zip(names, READ.split(","))])
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, held = [], 0
                for kind, start, stop, x in salvage(content.as_py()):
                    row = {"gap": kind == "gap", "file": file, "offset": start, "stop": stop, "length": stop - start}
                    row |= {"reason": x} if kind == "gap" else x
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 2000 or held > 1 << 25:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    # one archive at a time in a worker's memory
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ)


def records(read: DataFrame) -> DataFrame:
    return read.where("not gap").drop("gap", "stop", "reason")


def quarantined(read: DataFrame) -> DataFrame:
    return read.where("gap").select("file", F.col("offset").alias("start"), "stop", "reason")


def warc_round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back.

    One row per input row: page_id, payload_bytes, payload_digest (SHA-1),
    record_type, refers_to.  Null html is an empty payload.  Of rows that repeat
    the largest page_id and the payload, all are responses.  A null page_id
    stays null; such a row is a response and nothing refers to it, unless no
    other row of the group has an identifier.  Empty table: empty result.
    """
    path = scratch(pages.sparkSession, "warc")
    write_warc(pages, path, least)
    read = read_warc(pages.sparkSession, path, with_payload=False)
    return records(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
